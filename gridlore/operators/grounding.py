"""Checks of written claims against computed evidence, as column expressions.

Every check works row by row on text columns inside the JVM. Only the search for
known data values joins: claims are split into words and matched with the values
by one word each, so no claim is paired with a value it cannot contain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.columns import col, numeric_columns, require, strip, text_columns
from gridlore.functions.shapes import value_frequencies
from gridlore.operators.facts import kept
from gridlore.operators.profile import outlier_profile

__all__ = [
    "numbers_in", "labelled_numbers", "visible_counts", "extract_numbers", "extract_labels",
    "ungrounded_numbers", "mislabelled_numbers", "overclaim_flags", "ungrounded_names",
    "known_values", "stray_values", "mentioned_values", "ground_claims", "makes_data_claims",
    "insight_claims", "tag_questions", "results_agree", "tables_differ", "leak_flag",
]

# --- fixed values: word lists, phrases and patterns --------------------------

NUMBER = r"(?<!\d)-?\d[\d,]*(?:\.\d+)?"
LABELLED = r"\b([A-Za-z][A-Za-z]{2,20})\s+(-?\d[\d,]*(?:\.\d+)?)\s*%?"
LABEL_STOPWORDS = (
    "has", "have", "had", "are", "was", "were", "with", "from", "than", "about", "over",
    "under", "around", "across", "between", "only", "just", "all", "and", "for", "the",
    "contains", "contain", "spans", "ranges", "approximately", "roughly", "nearly",
)
COMMON_WORDS = (
    "the", "this", "that", "these", "those", "there", "here", "then", "they",
    "and", "but", "for", "with", "from", "into", "over", "under", "about",
    "overall", "also", "based", "note", "result", "results", "answer",
    "total", "average", "count", "number", "value", "values", "data",
    "dataset", "column", "columns", "row", "rows", "table", "sales",
    "python", "sql", "dataframe", "verified", "unique",
    "distinct", "each", "every", "some", "most", "least", "both", "only",
    "yes", "not", "you", "your", "its", "our", "all", "any", "one", "two",
    "when", "where", "which", "while", "since", "because", "however",
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
CAUSAL_PHRASES = (
    "caused by", "was caused", "were caused", "caused the", "caused a",
    "causes the", "causes a",
    "led to", "resulted in", "resulting in", "due to the", "is due to",
    "because of the", "is because", "the reason for", "the reason behind",
    "significant correlation", "statistically significant", "is an outlier",
    "are outliers", "is an anomaly", "an anomaly", "are anomalies",
    "is anomalous", "this proves", "guaranteed to",
    "will definitely", "predicts that", "forecasts that",
)
HEDGE_PHRASES = (
    "don't have access", "do not have access",
    "no access to the", "unable to compute", "unable to access",
    "can't compute the exact", "cannot compute the exact",
    "i'm sorry, but i don't", "i am sorry, but i do not",
    "i don't have the actual data", "without access to the actual",
)
PREDICTION_PATTERNS = (
    r"\bwill(?:\s+\w+){0,2}\s+(?:increase|decrease|rise|fall|grow|drop|reach|remain|be|become|decline|improve|worsen)\b",
    r"\b(?:is|are|was|were)\s+(?:expected|projected|forecast)\s+to\b",
    r"\b(?:forecast|forecasts|forecasted|project|projects|projected|predict|predicts|predicted)\b",
    r"\b(?:likely|unlikely)\s+to\s+(?:increase|decrease|rise|fall|grow|drop|reach|remain|decline|improve|worsen)\b",
    r"\b(?:should|would)\s+(?:increase|decrease|rise|fall|grow|drop|reach|remain|decline|improve|worsen)\b",
)
RATIO = (
    r"\b(?:double[sd]?|doubling|twice|triple[sd]?|thrice|"
    r"\d+(?:\.\d+)?\s*(?:x|times)\b|times\s+(?:the|as|higher|more|larger|greater))"
)
SEVERITY = r"\b(?:outliers?|anomal\w*|spikes?|surges?|extremes?|extremely)\b"
LEAK_PATTERNS = (
    r"\b(?:system|developer|assistant)\s+(?:prompt|message|instruction)s?\b",
    r"\b(?:hidden|internal|secret|private)\s+(?:instructions?|prompt|rules?)\b",
    r"\b(?:api[_ -]?key|access[_ -]?token|secret[_ -]?key|credentials?)\b",
    r"\b(?:groq|openai)_[a-z0-9_]*key\b",
    r"\b(?:environment|env)\s+(?:variable|variables)\b.*\b(?:key|token|secret|password)\b",
    r"\b(?:reveal|print|show|disclose|quote|dump)\b.{0,60}\b(?:system prompt|developer message|hidden instructions|api key|credentials)\b",
)
QUESTION_TAGS = (
    ("causal", (
        r"^\s*(?:why|how\s+come)\b",
        r"\b(?:what\s+(?:caused|causes|explains)|reason|driver|drivers|factor|factors)\b",
    )),
    ("forecast", (
        r"\b(?:next|upcoming|coming)\s+(?:\d+\s+)?(?:day|days|week|weeks|month|months|quarter|quarters|year|years)\b",
        r"\b(?:future|going\s+forward|going\s+ahead)\b",
        r"\b(?:predict|forecast|forecasting|project|projected|projection|estimate|estimated|expected|expect)\b",
        r"\b(?:what|how\s+much|how\s+many)\b.*\bwill\b",
    )),
    ("chart", (
        r"\b(bar\s*chart|bar\s*plot|scatter|histogram|line\s*(?:chart|plot)?|pie\s*chart|pie|plot|graph|visuali[sz]e|draw|distribution)\b",
    )),
    ("comparison", (r"\b(compare|comparison|versus|vs\.?|higher|lower)\b",)),
    ("ranking", (
        r"\b(highest|maximum|max|largest|most|best)\b", r"\b(lowest|minimum|min|smallest|least)\b",
        r"\b(?:top|best|bottom|worst)\s+(\d+)\b", r"\b(rank|ranking|ranked)\b",
    )),
    ("count", (r"\bhow\s+many\b|\bnumber\s+of\b|\bcount\b",)),
)
CHART_TYPES = (
    ("histogram", r"\b(distribution|histogram)\b"),
    ("scatter", r"\bscatter\b"),
    ("line", r"\b(?:line|trend)\b"),
    ("pie", r"\bpie\b"),
)
# One of these words must occur for the pattern of the same place to match.
PREDICTION_WORDS = (
    ("will",), ("expected", "projected", "forecast"), ("forecast", "project", "predict"),
    ("likely",), ("should", "would"),
)
LEAK_WORDS = (
    ("prompt", "message", "instruction"), ("instruction", "prompt", "rule"),
    ("key", "token", "credential"), ("groq", "openai"), ("variable",),
    ("system prompt", "developer message", "hidden instructions", "api key", "credentials"),
)
MIN_VALUE_LENGTH = 3
TOLERANCE = 0.01

_U = "(?U)"  # words and boundaries follow Unicode


def _matches(c: Column, patterns: tuple[str, ...], flags: str = _U) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike(flags + p)
    return F.coalesce(hit, F.lit(False))


def _contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(c, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def _guarded(c: Column, patterns: tuple[str, ...], words: tuple, flags: str = _U) -> Column:
    """``_matches``, trying a pattern only on texts that hold one of its words."""
    hit = F.lit(False)
    for p, needed in zip(patterns, words, strict=True):
        hit = hit | (_contains_any(c, needed) & c.rlike(flags + p))
    return F.coalesce(hit, F.lit(False))


def _keep(items: Column, pool: Column, wanted) -> Column:
    """The items for which ``wanted(item, pool)`` holds; both are worked out once per row."""
    once = F.array(F.struct(items.alias("items"), pool.alias("pool")))
    kept = F.transform(once, lambda s: F.filter(s["items"], lambda x: wanted(x, s["pool"])))
    return F.get(kept, F.lit(0))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# --- numbers ----------------------------------------------------------------

def _as_double(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def numbers_in(c: Column) -> Column:
    """All numbers of a text as doubles; a minus glued to a digit is not a sign."""
    tokens = F.regexp_extract_all(_text(c), F.lit(NUMBER), 0)
    return F.filter(F.transform(tokens, _as_double), lambda x: x.isNotNull())


def labelled_numbers(c: Column) -> Column:
    """``(label, number)`` pairs: the word before each number; the first of a label counts."""
    text = _text(c)
    labels = F.transform(F.regexp_extract_all(text, F.lit(_U + LABELLED), 1), F.lower)
    values = F.transform(F.regexp_extract_all(text, F.lit(_U + LABELLED), 2), _as_double)
    pairs = F.filter(
        F.zip_with(labels, values, lambda a, b: F.struct(a.alias("label"), b.alias("number"))),
        lambda p: ~p["label"].isin(list(LABEL_STOPWORDS)) & p["number"].isNotNull(),
    )
    # the first of each label: later ones are dropped one by one
    empty = F.array().cast("array<struct<label:string,number:double>>")
    return F.aggregate(
        pairs, empty,
        lambda kept, p: F.when(F.exists(kept, lambda k: k["label"] == p["label"]), kept)
        .otherwise(F.array_append(kept, p)),
    )


def visible_counts(c: Column) -> Column:
    """Counts one can read off a printed result: its lines and the lengths of its lists."""
    text = _text(c)
    lines = F.size(F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x) != ""))
    line_counts = F.when(
        lines > 0, F.array(lines.cast("double"), F.greatest(lines - 1, F.lit(0)).cast("double"))
    ).otherwise(F.array().cast("array<double>"))
    lists = F.transform(
        F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), 1),
        lambda inner: F.size(F.filter(F.split(inner, ","), lambda x: F.trim(x) != "")).cast("double"),
    )
    return F.concat(line_counts, F.filter(lists, lambda n: n > 0))


def extract_numbers(df: DataFrame, name: str, ids: list[str]) -> DataFrame:
    """One row per number in the text, with its place."""
    require(df, name, *ids)
    return df.select(*map(col, ids), F.posexplode(numbers_in(col(name))).alias("place", "number"))


def extract_labels(df: DataFrame, name: str, ids: list[str]) -> DataFrame:
    """One row per labelled number in the text."""
    require(df, name, *ids)
    pairs = df.select(*map(col, ids), F.explode(labelled_numbers(col(name))).alias("p"))
    return pairs.select(*map(col, ids), "p.label", "p.number")


def _foreign_numbers(claim: Column, evidence: Column, allowed: Column) -> Column:
    pool = F.concat(numbers_in(evidence), visible_counts(evidence), numbers_in(allowed))
    return _keep(
        numbers_in(claim), pool, lambda n, known: ~F.exists(known, lambda v: F.abs(v - n) <= TOLERANCE)
    )


def _wrong_labels(claim: Column, evidence: Column) -> Column:
    def differs(p: Column, known: Column) -> Column:
        return F.exists(
            known,
            lambda v: (v["label"] == p["label"]) & (F.abs(v["number"] - p["number"]) > TOLERANCE),
        )

    wrong = _keep(labelled_numbers(claim), labelled_numbers(evidence), differs)
    return F.transform(wrong, lambda p: p["label"])


def _allowed(df: DataFrame, allowed: str | None) -> Column:
    return F.lit("") if allowed is None else col(allowed)


def ungrounded_numbers(df: DataFrame, claim: str, evidence: str, allowed: str | None = None) -> DataFrame:
    """Add the claim's numbers that neither the evidence nor the question holds."""
    require(df, claim, evidence, *([allowed] if allowed else []))
    bad = _foreign_numbers(col(claim), col(evidence), _allowed(df, allowed))
    return df.withColumn("ungrounded_numbers", bad)


def mislabelled_numbers(df: DataFrame, claim: str, evidence: str) -> DataFrame:
    """Add the labels whose number differs between claim and evidence."""
    require(df, claim, evidence)
    return df.withColumn("mislabelled", _wrong_labels(col(claim), col(evidence)))


# --- wording ----------------------------------------------------------------

def _causal(lowered: Column) -> Column:
    return _contains_any(lowered, CAUSAL_PHRASES)


def _prediction(lowered: Column) -> Column:
    return _guarded(lowered, PREDICTION_PATTERNS, PREDICTION_WORDS)


def _hedge(lowered: Column) -> Column:
    return _contains_any(lowered, HEDGE_PHRASES)


def overclaim_flags(df: DataFrame, name: str) -> DataFrame:
    """Add flags for causal or significance wording, predictions and hedging."""
    require(df, name)
    c = F.col("_lowered")
    flags = {"causal": _causal(c), "prediction": _prediction(c), "hedge": _hedge(c)}
    return df.withColumn("_lowered", F.lower(col(name))).withColumns(flags).drop("_lowered")


# Characters that may stand between a sentence's start and its first word.
_LEAD = r"[ \t*_#>|\"'(\-•]"
_NAME = r"(?<![A-Za-z0-9'’])([A-Z][a-z]{2,})(?![A-Za-z0-9])"
_FIRST_WORD = rf"(^|[.!?\n])({_LEAD}*)" + _NAME


def _singular(w: Column) -> Column:
    size = F.length(w)
    return (
        F.when(F.endswith(w, F.lit("ies")) & (size > 4), F.concat(F.substring(w, F.lit(1), size - 3), F.lit("y")))
        .when(F.endswith(w, F.lit("s")) & (size > 3), F.substring(w, F.lit(1), size - 1))
        .otherwise(w)
    )


def _names(c: Column) -> Column:
    """Capitalised words that do not begin a sentence."""
    inside = F.regexp_replace(_text(c), _FIRST_WORD, "$1$2x")
    return F.array_distinct(F.regexp_extract_all(inside, F.lit(_NAME), 1))


def _foreign_names(claim: Column, evidence: Column, allowed: Column) -> Column:
    pool = F.concat_ws(" ", _text(evidence), _text(allowed))
    words = F.transform(
        F.regexp_extract_all(pool, F.lit("[A-Za-z]{3,}"), 0), lambda w: _singular(F.lower(w))
    )
    return _keep(
        _names(claim), words,
        lambda w, known: ~F.array_contains(known, _singular(F.lower(w)))
        & ~F.lower(w).isin(list(COMMON_WORDS))
        & ~_singular(F.lower(w)).isin(list(COMMON_WORDS)),
    )


def ungrounded_names(df: DataFrame, claim: str, evidence: str, allowed: str | None = None) -> DataFrame:
    """Add name-like words of the claim found in neither evidence nor question."""
    require(df, claim, evidence, *([allowed] if allowed else []))
    bad = _foreign_names(col(claim), col(evidence), _allowed(df, allowed))
    return df.withColumn("ungrounded_names", bad)


# --- known values -----------------------------------------------------------

def known_values(df: DataFrame, names: list[str] | None = None, max_values: int | None = None) -> DataFrame:
    """Different lower-cased values of the text columns that look like categories.

    Values shorter than three characters and numbers are left out, and, if max_values is given, columns
    with more different values than that.
    """
    names = text_columns(df) if names is None else names
    freq = value_frequencies(df, names)
    if max_values is not None:
        small = freq.groupBy("column").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") <= max_values)
        freq = freq.join(F.broadcast(small), "column")
    kept = freq.select(F.lower(strip(F.col("value"))).alias("value")).distinct()
    plain = F.replace("value", F.lit("."), F.lit(""))
    return kept.filter((F.length("value") >= MIN_VALUE_LENGTH) & ~plain.rlike(r"(?U)^\d+$"))


_WORDS = r"(?U)\w+"


# Values whose index may be broadcast, and their signs in all; bits of the filter that texts' words pass before they meet it;
# the share of texts by which words are called rare (it decides which word finds a value, not what is found).
BROADCAST_VALUES, BROADCAST_SIGNS, FILTER_BITS, RARE_BY = 200_000, 16_000_000, 1 << 20, 0.02


def _words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_WORDS), 0))


def _index(values: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(value, _w): each value with its rarest word, of equally rare ones the longest; any text that holds the value holds
    this word whole. A value without a word has the empty one."""
    per = values.select("value", F.explode_outer(_words_of(F.col("value"))).alias("_w"))
    seen = texts.sample(RARE_BY, 17).select(F.explode(_words_of(F.lower(_text(col(text))))).alias("_w")).groupBy("_w").agg(
        F.count(F.lit(1)).alias("_df"))
    order = F.struct(F.coalesce("_df", F.lit(0)), -F.length("_w"), F.col("_w"))
    keyed = per.join(seen, "_w", "left").groupBy("value").agg(F.min_by("_w", order).alias("_w"))
    return kept(keyed.select("value", F.coalesce("_w", F.lit("")).alias("_w")))


def _slot(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(FILTER_BITS))


def _bits(index: DataFrame) -> Column:
    """FILTER_BITS bits as a constant array of longs: those that the index' words fall on."""
    slots = index.select(_slot(F.col("_w")).alias("s")).select(F.floor(F.col("s") / 64).cast("long").alias("id"), F.pmod("s", F.lit(64)).cast("int").alias("b"))
    own = slots.groupBy("id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits"))
    longs = [0] * (FILTER_BITS // 64)
    for r in own.collect():  # as many rows as the array is long at most
        longs[r["id"]] = r["bits"]
    return F.split(F.lit(" ".join(map(str, longs))), " ").cast("array<bigint>")


def _candidates(rows: DataFrame, text: Column, index: DataFrame) -> DataFrame:
    """rows with `value`, once for each value whose word the text holds.

    The index is broadcast if it is small, and texts are matched where they lie: of a text's words only those that pass
    the index' bits become rows. A larger index is met by the words, which takes the rows along.
    """
    facts = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    small = facts[0] <= BROADCAST_VALUES and facts[1] <= BROADCAST_SIGNS
    words = F.array_append(_words_of(F.lower(text)), F.lit(""))
    if small:
        bits = _bits(index)
        hit = lambda w: F.call_function("shiftright", F.get(bits, F.floor(_slot(w) / 64).cast("int")), F.pmod(_slot(w), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        words = F.filter(words, hit)
    return rows.withColumn("_w", F.explode(words)).join(F.broadcast(index) if small else index, "_w").drop("_w")


def _holds(text: Column, value: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)"))
    return F.coalesce(F.contains(text, value) & F.rlike(text, pattern), F.lit(False))


def _met(left: DataFrame, right: DataFrame, ids: list[str], how: str = "inner") -> DataFrame:
    """Joined on the ids, missing ones being equal to each other."""
    other = right.select(*[col(i).alias(f"_id{k}") for k, i in enumerate(ids)],
                         *[col(c) for c in right.columns if c not in ids])
    same = [col(i).eqNullSafe(F.col(f"_id{k}")) for k, i in enumerate(ids)]
    return left.join(other, same, how).drop(*[f"_id{k}" for k in range(len(ids))])


def mentioned_values(claims: DataFrame, ids: list[str], text: str, values: DataFrame) -> DataFrame:
    """``(ids…, value)`` for every known value that occurs as whole words in a text."""
    require(claims, text, *ids)
    texts = claims.select(*map(col, ids), F.lower(_text(col(text))).alias("_t"))
    found = _candidates(texts, F.col("_t"), _index(values, claims, text))
    return found.filter(_holds(F.col("_t"), F.col("value"))).drop("_t")


def stray_values(
    claims: DataFrame, values: DataFrame, ids: list[str], claim: str, evidence: str,
    allowed: str | None = None,
) -> DataFrame:
    """``(ids…, value)``: known values a claim names although its evidence does not.

    ``ids`` identify a claim.
    """
    require(claims, claim, evidence, *ids)
    texts = claims.select(
        *map(col, ids), F.lower(_text(col(claim))).alias("_t"),
        F.lower(_text(col(evidence))).alias("_e"), F.lower(_text(_allowed(claims, allowed))).alias("_a"),
    )
    found = _candidates(texts, F.col("_t"), _index(values, claims, claim))
    v = F.col("value")
    stray = _holds(F.col("_t"), v) & ~_holds(F.col("_e"), v) & ~_holds(F.col("_a"), v)
    return found.filter(stray).drop("_t", "_e", "_a")


# --- verdicts ---------------------------------------------------------------

def ground_claims(
    claims: DataFrame, ids: list[str], claim: str, evidence: str, allowed: str | None = None,
    values: DataFrame | None = None,
) -> DataFrame:
    """One row per claim: the problems found, in order, and whether it can be trusted."""
    require(claims, claim, evidence, *ids)
    c, e, a = col(claim), col(evidence), _allowed(claims, allowed)
    low = F.lower(c)
    checks = (
        ("causal", _causal(low)), ("prediction", _prediction(low)), ("hedge", _hedge(low)),
        ("number", F.size(_foreign_numbers(c, e, a)) > 0),
        ("label", F.size(_wrong_labels(c, e)) > 0),
        ("name", F.size(_foreign_names(c, e, a)) > 0),
    )
    problems = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks]))
    # texts are judged where they lie; only ids and problems meet the stray values
    found = claims.select(*map(col, ids), problems.alias("problems"))
    if values is not None:
        strays = stray_values(claims, values, ids, claim, evidence, allowed).select(*map(col, ids)).distinct()
        found = _met(found, strays.withColumn("_stray", F.lit(True)), ids, "left")
        found = found.select(*map(col, ids), F.when(F.col("_stray"), F.array_append("problems", F.lit("value"))).otherwise(F.col("problems")).alias("problems"))
    return found.withColumn("trustworthy", F.size("problems") == 0)


def makes_data_claims(
    df: DataFrame, ids: list[str], name: str, values: DataFrame | None = None,
    allowed: str | None = None,
) -> DataFrame:
    """One row per text: does it say anything about the data (digit, known value or name)."""
    require(df, name, *ids)
    c = col(name)
    speaks = c.rlike(r"(?U)\d") | (F.size(_foreign_names(c, F.lit(""), _allowed(df, allowed))) > 0)
    rows = df.select(*map(col, ids), F.coalesce(speaks, F.lit(False)).alias("_speaks"))
    if values is None:
        return rows.withColumnRenamed("_speaks", "makes_claim")
    named = mentioned_values(df, ids, name, values).select(*map(col, ids)).distinct()
    joined = _met(rows, named.withColumn("_named", F.lit(True)), ids, "left")
    return joined.select(
        *map(col, ids), (F.col("_speaks") | F.coalesce("_named", F.lit(False))).alias("makes_claim")
    )


def insight_claims(df: DataFrame, name: str, table: DataFrame | None = None) -> DataFrame:
    """Add flags for self-made ratios and for severity words no outlier check supports.

    ``table`` is the data the text is about; its columns with outliers may be called severe.
    """
    require(df, name)
    c = col(name)
    severe = _matches(c, (SEVERITY,), "(?iU)")
    if table is not None:
        names = numeric_columns(table)
        spread = outlier_profile(table, names).agg(F.struct(*[
            F.bool_or((F.col("column") == n) & F.coalesce(F.col("outliers") > 0, F.lit(False))).alias(f"c{i}")
            for i, n in enumerate(names)
        ]).alias("spread")).scalar() if names else None
        for i, n in enumerate(names):
            severe = severe & ~(spread[f"c{i}"] & F.contains(F.lower(c), F.lit(n.lower())))
    return df.withColumns({"ratio_claim": _matches(c, (RATIO,), "(?iU)"), "severity_claim": severe})


def tag_questions(df: DataFrame, name: str) -> DataFrame:
    """Add what a question asks for (first match) and the kind of chart, if it asks for one."""
    require(df, name)
    c = F.lower(col(name))
    tag = F.lit(None)
    for label, patterns in reversed(QUESTION_TAGS):
        tag = F.when(_matches(c, patterns), label).otherwise(tag)
    chart = F.lit("bar")
    for label, pattern in reversed(CHART_TYPES):
        chart = F.when(_matches(c, (pattern,)), label).otherwise(chart)
    rows = df.withColumn("tag", F.coalesce(tag, F.lit("other")))
    return rows.withColumn("chart_type", F.when(F.col("tag") == "chart", chart))


def leak_flag(df: DataFrame, name: str, markers: tuple[str, ...] = ()) -> DataFrame:
    """Add a flag for text that seems to disclose instructions or credentials, or holds one of the markers that the
    caller has put into its own instructions."""
    require(df, name)
    c = F.col("_lowered")
    marker = _contains_any(c, tuple(m.lower() for m in markers)) if markers else F.lit(False)
    rows = df.withColumn("_lowered", F.lower(col(name)))
    return rows.withColumn("leak", marker | _guarded(c, LEAK_PATTERNS, LEAK_WORDS, "(?Us)")).drop("_lowered")


# --- agreement of results ---------------------------------------------------

def results_agree(df: DataFrame, printed: str, single: str) -> DataFrame:
    """Add whether a printed result and a single value disagree.

    They agree when any printed number is within max(0.01, 0.01 %, 0.5 for whole
    numbers) of the value, of its hundredfold or of its hundredth. Anything that is
    not a single number, or no printed number, is not comparable and not a disagreement.
    """
    require(df, printed, single)
    raw = strip(col(single))
    value = F.when(~F.contains(raw, F.lit("\n")), _as_double(raw))
    numbers = numbers_in(col(printed))

    def near(n: Column) -> Column:
        whole = F.when(n == F.floor(n), 0.5).otherwise(0.0)
        tolerance = F.greatest(F.lit(0.01), F.abs(n) * 1e-4, whole)
        return (
            (F.abs(value - n) <= tolerance) | (F.abs(value * 100 - n) <= tolerance)
            | (F.abs(value / 100 - n) <= tolerance)
        )

    comparable = value.isNotNull() & (F.size(numbers) > 0)
    return df.withColumn("disagree", F.coalesce(comparable & ~F.exists(numbers, near), F.lit(False)))


def tables_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables holds, counting copies, with the side they are on."""
    only_a = a.exceptAll(b).withColumn("side", F.lit("first"))
    only_b = b.exceptAll(a).withColumn("side", F.lit("second"))
    return only_a.unionByName(only_b)
