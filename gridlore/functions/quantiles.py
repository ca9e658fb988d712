"""Exact quantiles without a global sort and without one task holding a column.

A value is read as three digits of an order-preserving code: sign, exponent and
the top 10 mantissa bits; the next 21 mantissa bits; and the value itself. Each
pass counts rows per digit (combined before the shuffle), finds by running sums
which digit holds the wanted ranks, and the next pass looks at those rows only.
Whatever the data, no running sum is longer than the digit has values, and equal
values always collapse to one count, so hot values cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions.columns import col


_EXPONENT = "floor(log2(abs(value)))"
_SCALED = f"((abs(value) / pow(2D, {_EXPONENT}) - 1D) * 1024D)"
_SIGN = "CAST(signum(value) AS BIGINT)"
_COARSE = (
    f"CASE WHEN value = 0D THEN 0L WHEN abs(value) = double('inf') THEN {_SIGN} * shiftleft(1L, 40) "
    f"ELSE {_SIGN} * (({_EXPONENT} + 1100L) * 2048L + floor({_SCALED}) + 2L) END"
)
_FINE = (
    f"CASE WHEN value = 0D OR abs(value) = double('inf') THEN 0L "
    f"ELSE {_SIGN} * floor(({_SCALED} - floor({_SCALED})) * 2097152D) END"
)


def coarse_digit(values: DataFrame) -> DataFrame:
    """Add ``slice``, the part of the number line ``value`` is in: a thousand per octave."""
    return values.withColumn("slice", F.expr(_COARSE))


def _narrow(counts: DataFrame, part: list[str], digit: str, wanted: str) -> DataFrame:
    """Keep the digits that hold a wanted rank; ranks become relative to the digit.

    The value range travels inside the hits, so that every use of this table reads
    the same columns and its aggregate is computed once.
    """
    upto = F.sum("n").over(
        Window.partitionBy(*map(col, part))
        .orderBy(col(digit))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hits = F.expr(
        f"transform(filter({wanted}, r -> r.rank >= _upto - n AND r.rank < _upto), r -> named_struct("
        "'slot', r.slot, 'rank', r.rank - (_upto - n), 'weight', r.weight, 'total', r.total, "
        "'low', _low, 'high', _high))"
    )
    placed = counts.withColumn("_upto", upto).withColumn("_found", hits)
    return placed.filter("size(_found) > 0").select(
        *map(col, part), col(digit), F.col("_found").alias("_hits")
    )


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    v = F.col("value")
    return rows.groupBy(*map(col, by)).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("_low"), F.max(v).alias("_high")
    )


def _inside(values: DataFrame, target: DataFrame, keys: list[str], digits: list[str], small: bool) -> DataFrame:
    """The values in a wanted digit, with that digit.

    With few keys the digits' value ranges are broadcast and compared, which is
    cheaper than computing digits; with many keys rows meet their digit by shuffle,
    on a key that spreads even one huge group.
    """
    if small:
        ranges = target.select(
            *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *digits,
            F.get("_hits", F.lit(0))["low"].alias("_low"), F.get("_hits", F.lit(0))["high"].alias("_high"),
        )
        same = [col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
        between = F.col("value").between(F.col("_low"), F.col("_high"))
        found = values.join(F.broadcast(ranges), [*same, between])
        return found.select(*map(col, keys), "value", *digits)
    made = {"_d1": _COARSE, "_d2": _FINE}
    rows = values.withColumns({d: F.expr(made[d]) for d in digits})
    return rows.join(target.select(*map(col, keys), *digits), [*keys, *digits])


def exact_quantiles(
    values: DataFrame, keys: list[str], probs: dict[str, float], small_keys: bool = True
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys``.

    ``values`` holds the keys and a non-missing double ``value``. The result has the
    keys, ``n`` and one column per entry of ``probs``. ``small_keys`` says that the
    number of key combinations is bounded by the schema (column names), so that the
    table of wanted digits may be broadcast.
    """
    values = values.select(*map(col, keys), "value")
    first = _counted(values.withColumn("_d1", F.expr(_COARSE)), [*keys, "_d1"])
    first = first.withColumn("_total", F.sum("n").over(Window.partitionBy(*map(col, keys))))
    wanted = ", ".join(
        f"named_struct('slot', {2 * slot + side}, 'rank', CAST({fn}((_total - 1) * {float(p)}D) AS BIGINT), "
        f"'weight', (_total - 1) * {float(p)}D - floor((_total - 1) * {float(p)}D), 'total', _total)"
        for slot, p in enumerate(probs.values())
        for side, fn in enumerate(("floor", "ceil"))
    )
    target1 = _narrow(first, keys, "_d1", f"array({wanted})")

    by = [*keys, "_d1"]
    second = _inside(values, target1, keys, ["_d1"], small_keys).withColumn("_d2", F.expr(_FINE))
    hits1 = target1.select(*map(col, by), "_hits")
    target2 = _narrow(_counted(second, [*by, "_d2"]).join(hits1, by), by, "_d2", "_hits")

    by = [*by, "_d2"]
    third = _inside(values, target2, keys, ["_d1", "_d2"], small_keys)
    counts = _counted(third, [*by, "value"])
    hits2 = target2.select(*map(col, by), "_hits")
    found = _narrow(counts.join(hits2, by), by, "value", "_hits").select(
        *map(col, keys), "value", F.explode("_hits").alias("h")
    )

    out = []
    for slot, name in enumerate(probs):
        low = f"max(CASE WHEN h.slot = {2 * slot} THEN value END)"
        high = f"max(CASE WHEN h.slot = {2 * slot + 1} THEN value END)"
        weight = f"max(CASE WHEN h.slot = {2 * slot} THEN h.weight END)"
        # equal neighbours need no interpolation (and infinities must not meet)
        between = f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * {weight} END"
        out.append(F.expr(between).alias(name))
    return found.groupBy(*map(col, keys)).agg(F.max("h.total").alias("n"), *out)


def approx_quantiles(values: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """One-pass sketch for exploratory use; the exact function is the default everywhere."""
    picked = F.percentile_approx("value", list(probs.values()), 10000)
    packed = values.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("n"), picked.alias("q"))
    return packed.select(
        *map(col, keys), "n", *[F.col("q")[i].alias(name) for i, name in enumerate(probs)]
    )
