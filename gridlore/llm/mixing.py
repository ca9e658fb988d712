"""Mixing to target weights with soft membership: every document belongs to every domain by a posterior, and a
nonnegative rate per document makes the expected token totals of the domains meet their targets."""

from __future__ import annotations

import warnings
from functools import reduce
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.sampling import per_label
from gridlore.llm.text import let, numbers, saved, words

# The classifier hashes words into BUCKETS features, and learns from about PER_DOMAIN labelled documents of each domain
# (all of them where there are fewer). EVIDENCE words at most count as independent, so that posteriors stay soft.
BUCKETS, PER_DOMAIN, EVIDENCE = 4096, 4_000, 12.0
MOST_DOMAINS = 256
# Rounds that a fit may take before it gives up and says so, the pull to a rate of 1 at first and at last, and how near
# targets have to be met.
ROUNDS, RIDGE, LEAST_RIDGE, CLOSE = 500, 1e-3, 1.1e-7, 1e-4


class Memberships:
    """What the classifier has learnt: the domains, their log priors, and an array of log rates for each."""

    def __init__(self, domains: list[str], priors: list[float], weights: list[list[float]]):
        self.domains, self.priors, self.weights = domains, priors, weights

    def posterior(self, tokens: Column) -> Column:
        """Array of the domains' posteriors, to three decimals; without words it is the prior's."""
        if not self.domains:
            return F.array().cast("array<double>")
        tables = [numbers(w) for w in self.weights]

        def soft(at: Column) -> Column:
            n = F.greatest(F.size(at).cast("double"), F.lit(EVIDENCE))
            fit = lambda t: F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(t, i))
            logs = F.array(*(F.lit(p) + fit(t) * (EVIDENCE / n) for p, t in zip(self.priors, tables)))
            odds = let(logs, lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
            total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
            coarse = let(odds, lambda v: let(total(v), lambda t: F.transform(v, lambda x: F.round(x / t, 3))))
            return let(coarse, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))

        return let(F.transform(tokens, lambda w: _bucket(w)), soft)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def learn_memberships(labelled: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text") -> Memberships:
    """Naive Bayes over hashed words, from the rows whose domain isn't null. Of a domain with more than PER_DOMAIN
    documents, those count whose hashed id falls under the fraction that leaves about so many."""
    named = labelled.where(F.col(domain_col).isNotNull()).select(
        F.col(domain_col).cast("string").alias("d"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    sizes = {r["d"]: r["n"] for r in named.groupBy("d").agg(F.count("*").alias("n")).limit(MOST_DOMAINS + 1).collect()}
    if len(sizes) > MOST_DOMAINS:
        raise ValueError(f"{domain_col} has more than {MOST_DOMAINS} values")
    domains, total = sorted(sizes), sum(sizes.values())
    if not domains:
        return Memberships([], [], [])
    drawn = per_label(named, F.col("d"), F.col("id"), PER_DOMAIN)
    counts = drawn.select("d", F.explode(F.transform(words(F.lower("t")), lambda w: _bucket(w))).alias("b")).groupBy("b").agg(
        *(F.sum(F.when(F.col("d") == d, 1.0).otherwise(0.0)).alias(f"c{k}") for k, d in enumerate(domains)))
    every = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").na.fill(0.0)
    gathered = full.agg(F.sort_array(F.collect_list(F.struct("b", *(f"c{k}" for k in range(len(domains)))))).alias("rows"))

    def log_rates(name: str) -> Column:
        size = F.aggregate("rows", F.lit(0.5 * BUCKETS), lambda s, x: s + x[name])
        return let(size, lambda t: F.transform("rows", lambda x: F.log((x[name] + 0.5) / t)))

    by_domain = [log_rates(f"c{k}").alias(f"w{k}") for k in range(len(domains))]
    return Memberships(domains, [log(sizes[d] / total) for d in domains], [list(w) for w in gathered.select(*by_domain).first()])


def _rate(p: Column, pulls: list[float], floor: float) -> Column:
    """1 less the posterior's share in each domain's pull, projected onto rates of at least floor. The pulls are one
    constant array, so that the expression has the same form, and the same compiled code, in every round."""
    return F.greatest(F.lit(float(floor)), _free(p, pulls))


def _free(p: Column, pulls: list[float]) -> Column:
    flat = numbers(pulls)
    return F.lit(1.0) - reduce(lambda a, b: a + b, (F.get(p, i) * F.get(flat, i) for i in range(len(pulls))))


def fit_rates(members: DataFrame, targets: list[float], budget: float | None = None, floor: float = 0.0, over: str = "p") -> Column:
    """The rate as a column over the posterior `over`, fitted to rows (p, n_tokens).

    It minimises the sum of (expected total of a domain - its target)^2 / its present total, with a small pull to a rate
    of 1.
    At the minimum a rate is 1 less a pull for each domain by its posterior, or the floor; the pulls are found by Newton
    steps on the convex dual, whose number doesn't depend on how unlike the domains' shares are. The pull to 1 starts at
    RIDGE and is weakened tenfold until the targets are met within CLOSE. Where LEAST_RIDGE doesn't do it either, no rates
    meet them, or only ever larger rates of a few rows do: the rates of RIDGE stand, and what they miss is warned of.
    The rate of a document depends on its posterior only, so equal posteriors are summed first; each round is one
    aggregation that returns a number for each pair of domains. budget: the tokens to end with; by default as many as
    come in. With a floor of 1 no document is dropped, and the budget is by default the least that allows it.
    """
    k = len(targets)
    groups = saved(members.where(F.col("n_tokens") > 0).groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n")))
    at = lambda i: F.get("p", F.lit(i))
    now = [float(x or 0) for x in groups.agg(*(F.sum(F.col("n") * at(i)).alias(f"s{i}") for i in range(k))).first()]
    total = sum(now)
    if not total:
        return F.lit(1.0)
    share = [max(t, 1e-9) / sum(targets) for t in targets]
    if budget is None:
        budget = total if floor < 1 else max(x / s for x, s in zip(now, share))
    goal = np.array([s * budget / total for s in share])
    present = np.maximum(now, 1e-9 * total) / total
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """At the pulls y: the rates' part of the dual, the domains' totals, and the Gram matrix of the free rates."""
        free = groups.select("p", "n", _free(F.col("p"), list(y)).alias("f"))
        loose, low = F.col("f") > float(floor), float(floor)
        n, moves = F.col("n") / total, F.when(F.col("f") > low, F.col("n") / total).otherwise(0.0)
        row = free.agg(
            F.sum(n * F.when(loose, F.col("f") * F.col("f") / 2).otherwise(low * F.col("f") - low * low / 2)),
            *(F.sum(n * F.greatest(F.lit(low), F.col("f")) * at(i)) for i in range(k)),
            *(F.sum(moves * at(i) * at(j)) for i, j in pairs)).first()
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[1 + k:]):
            gram[i, j] = gram[j, i] = x
        return row[0], np.array(row[1:1 + k], float), gram

    # a domain without a target is measured by all tokens
    scale = np.where(np.array(targets) > 0, goal, goal.sum())
    off = lambda s: float(np.max(np.abs(s - goal) / scale))
    y, ridge, first, rounds = np.zeros(k), RIDGE, None, 0
    part, got, gram = sums(y)
    while True:
        dual = lambda y, part: part + goal @ y + ridge * (present @ (y * y)) / 2  # noqa: E731,B023
        while rounds < ROUNDS:
            slope = goal + ridge * present * y - got
            if np.all(np.abs(slope) <= CLOSE / 100 * goal + 1e-12):
                break
            way, size = -np.linalg.solve(gram + np.diag(ridge * present), slope), 1.0
            old = dual(y, part)
            while True:
                rounds += 1
                tried = sums(y + size * way)
                if dual(y + size * way, tried[0]) <= old + 1e-4 * size * (slope @ way) + 1e-15 * abs(old) or size < 1e-6:
                    break
                size /= 2
            y, (part, got, gram) = y + size * way, tried
        first = first or (y, got)
        if off(got) < CLOSE or ridge <= LEAST_RIDGE or rounds >= ROUNDS:
            break
        ridge /= 10
    if off(got) >= CLOSE:
        y, got = first
        parts = ", ".join(f"{x / g - 1:+.2%}" if t > 0 else f"{x / goal.sum():.2%} of all" for x, g, t in zip(got, goal, targets))
        warnings.warn(f"the rates miss their targets after {rounds} rounds, by domain: {parts}", stacklevel=2)
    return _rate(F.col(over), list(y), floor)


def mix(docs: DataFrame, memberships: Memberships, targets: dict[str, float] | None = None, budget: float | None = None,
        floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with four more columns: n_tokens, posterior (by the order of memberships.domains), rate and copies.

    targets: weight by domain, by default the square root of the domain's expected tokens; a domain that isn't named
    has none. copies is the rate rounded up or down by a hash of id and text, so that it is the rate on average. Null
    and empty texts have no tokens, the prior for a posterior and the rate that follows from it. Rows that repeat get
    the same values. Without labelled rows or tokens every rate is 1. Columns of docs that are named like one of the four
    are replaced by it; all others are kept as they are.
    """
    tokens = words(F.lower(F.col(text_col)))
    own = let(tokens, lambda t: F.struct(F.size(t).cast("long").alias("n_tokens"), memberships.posterior(t).alias("p")))
    if not memberships.domains:
        rate, source = F.lit(1.0), docs.withColumn("__mixed", own)
    else:
        source = docs.withColumn("__mixed", own)
        members = saved(source.select("__mixed.p", "__mixed.n_tokens"))
        if targets is None:
            k = len(memberships.domains)
            expected = members.agg(*(F.coalesce(F.sum(F.get("p", F.lit(i)) * F.col("n_tokens")), F.lit(0.0)) for i in range(k))).first()
            weights = [x ** 0.5 for x in expected]
        else:
            weights = [float(targets.get(d, 0.0)) for d in memberships.domains]
        rate = fit_rates(members, weights, budget, floor, "__mixed.p") if sum(weights) else F.lit(1.0)
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1_000_000)) / 1e6
    rated = source.withColumn("__rate", rate).withColumn("__chance", chance)
    copies = (F.floor("__rate") + F.when(F.col("__chance") < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("long")
    out = {"n_tokens": F.col("__mixed.n_tokens"), "posterior": F.col("__mixed.p"), "rate": F.col("__rate"), "copies": copies}
    return rated.withColumns(out).drop("__mixed", "__rate", "__chance")
