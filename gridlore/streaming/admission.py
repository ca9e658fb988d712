"""Admission of calls per session: a minimum gap and a limit per sliding window.

Whether a call is admitted depends on which earlier calls were, so the decision is a
recurrence over time. Two calls at least one window apart cannot influence each
other, which cuts every session into bursts that are decided independently. A task
walks its bursts in time order, batch by batch, and keeps only the admitted times of
the current window, so memory does not grow with the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from gridlore.functions.columns import col, dtype_of, require

__all__ = ["session_admission", "window_usage", "session_admission_stream"]

MIN_GAP_S = 2.0
MAX_CALLS = 20
WINDOW_S = 600

MICROS = 1_000_000
# A stream's watermark begins in 1970; event times are told to it so much later, so that no year is before that.
SHIFT = 70_000_000_000 * MICROS


def _micros(df: DataFrame, ts: str) -> Column:
    dtype = dtype_of(df, ts)
    if isinstance(dtype, T.NumericType):
        return F.round(col(ts).cast("double") * MICROS).cast("long")
    if isinstance(dtype, T.TimestampNTZType):
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", start, col(ts))
    return F.unix_micros(col(ts).cast("timestamp"))


def _decide(
    admitted: list[int], now: int, follow_up: bool, gap: int, limit: int, window: int
) -> str | None:
    """The reason to reject, or None; ``admitted`` is pruned and extended in place."""
    keep = 0
    while keep < len(admitted) and now - admitted[keep] >= window:
        keep += 1
    del admitted[:keep]
    if not follow_up and admitted and now - admitted[-1] < gap:
        return "too soon"
    if len(admitted) >= limit:
        return "window full"
    admitted.append(now)
    return None


def _with_bursts(calls: DataFrame, sessions: list[str], window: int) -> DataFrame:
    """Add ``_burst``: the start of the run of calls with gaps below one window.

    A session is cut into time blocks first, so that a session with very many calls is
    looked at by many tasks; the blocks' edges are then stitched together.
    """
    block = F.floor(F.col("_t") / (window * 6))
    rows = calls.withColumn("_block", block)
    inside = Window.partitionBy(*map(col, sessions), "_block").orderBy("_t")
    new = F.col("_t") - F.lag("_t").over(inside) >= window
    rows = rows.withColumn("_start", F.when(new, F.col("_t")))
    opened = F.last("_start", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_inner", opened)
    # one row per session and block
    edges = rows.groupBy(*map(col, sessions), "_block").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("_inner").alias("_open")
    )
    across = Window.partitionBy(*map(col, sessions)).orderBy("_block")
    far = F.col("_first") - F.lag("_last").over(across) >= window
    begins = F.when(far | F.lag("_last").over(across).isNull(), F.col("_first"))
    edges = edges.withColumn("_begins", begins)
    # what a block leaves open for the next one, and what it inherits
    leaves = F.coalesce("_open", "_begins")
    inherited = F.last(leaves, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("_enter", F.coalesce("_begins", inherited)).select(
        *[col(s).alias(f"_k{i}") for i, s in enumerate(sessions)],
        F.col("_block").alias("_b"), "_enter",
    )
    same = [F.col("_block") == F.col("_b")]
    same += [col(s).eqNullSafe(F.col(f"_k{i}")) for i, s in enumerate(sessions)]
    joined = rows.join(edges, same)
    out = joined.withColumn("_burst", F.coalesce("_inner", "_enter"))
    return out.drop("_block", "_start", "_inner", "_b", "_enter", *[f"_k{i}" for i in range(len(sessions))])


def session_admission(
    df: DataFrame, session: str, ts: str, followup: str | None = None,
    min_gap_s: float = MIN_GAP_S, max_calls: int = MAX_CALLS, window_s: float = WINDOW_S,
    tie: str | None = None,
) -> DataFrame:
    """Add ``allowed`` and ``reason`` to every call.

    Calls of equal time are taken in the order of ``tie`` (or of all columns).
    """
    require(df, session, ts, *[c for c in (followup, tie) if c])
    gap, window = round(min_gap_s * MICROS), round(window_s * MICROS)
    calls = df.withColumns({
        "_t": _micros(df, ts),
        "_f": F.coalesce(col(followup).cast("boolean"), F.lit(False)) if followup else F.lit(False),
    })
    bursts = _with_bursts(calls, [session], window)
    order = [tie] if tie else df.columns
    placed = bursts.repartition(col(session), "_burst").sortWithinPartitions(
        col(session), "_burst", "_t", *[col(c) for c in order]
    )
    fields = list(placed.schema.fields) + [
        T.StructField("allowed", T.BooleanType()), T.StructField("reason", T.StringType())
    ]

    places = [placed.columns.index(c) for c in (session, "_burst", "_t", "_f")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, admitted = None, []
        for batch in batches:
            reasons = []
            for who, burst, now, follow in zip(*(batch.column(i).to_pylist() for i in places)):
                key = ("NaN" if who != who else who, burst)
                if key != current:
                    current, admitted = key, []
                reasons.append(_decide(admitted, now, follow, gap, max_calls, window))
            # the rows themselves pass through untouched
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())],
                names=[*batch.schema.names, "allowed", "reason"])

    decided = placed.mapInArrow(walk, T.StructType(fields))
    return decided.select(*[col(c) for c in df.columns], "allowed", "reason")


def window_usage(
    df: DataFrame, session: str, ts: str, max_calls: int = MAX_CALLS, window_s: float = WINDOW_S
) -> DataFrame:
    """Add calls used and left in the window that ends at each call.

    A session is cut into blocks of six windows. Each block also gets a copy of the
    calls of the window before it, so blocks are counted independently.
    """
    require(df, session, ts)
    window = round(window_s * MICROS)
    size = 6 * window
    rows = df.withColumn("_t", _micros(df, ts)).withColumn("_own", F.floor(F.col("_t") / size))
    into_next = F.pmod(F.col("_t"), F.lit(size)) > size - window
    blocks = F.when(into_next, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    spread = rows.withColumn("_block", F.explode(blocks))
    trailing = (
        Window.partitionBy(col(session), "_block").orderBy("_t").rangeBetween(-(window - 1), 0)
    )
    used = F.count(F.lit(1)).over(trailing)
    return (
        spread.withColumn("used", used).filter(F.col("_block") == F.col("_own"))
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(max_calls) - F.col("used")))
        .drop("_t", "_own", "_block")
    )


class _Admission(StatefulProcessor):
    """Keeps the admitted times of the current window per session. Rows pass through as they came."""

    def __init__(self, names: list[str], followup: str | None, gap: int, limit: int, window: int, ttl_ms: int | None, order: list[str]):
        self.names, self.followup, self.order = names, followup, order
        self.gap, self.limit, self.window, self.ttl_ms = gap, limit, window, ttl_ms

    def init(self, handle) -> None:
        self.times = handle.getListState("times", "t long", self.ttl_ms)

    def _decided(self, calls: list[Row], now: int | None = None) -> Iterator[Row]:
        """The calls in the order of their times and what is decided about them; of the admitted times those are kept that
        may matter to calls from ``now`` on."""
        admitted = [r[0] for r in self.times.get()] if self.times.exists() else []
        named = Row(*self.names, "allowed", "reason")
        calls.sort(key=lambda r: (r["_t"], [(r[c] is not None, r[c]) for c in self.order]))
        for r in calls:
            reason = _decide(admitted, r["_t"], bool(self.followup and r[self.followup]), self.gap, self.limit, self.window)
            yield named(*[r[c] for c in self.names], reason is None, reason)
        if now is not None:
            admitted = [t for t in admitted if now - t < self.window]
        self.last = admitted[-1] if admitted else None
        if admitted:
            self.times.put([(t,) for t in admitted])
        elif self.times.exists():
            self.times.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._decided(list(rows))

    def close(self) -> None:
        pass


class _Held(_Admission):
    """The same by event time: calls are held until the watermark has passed their time, when no earlier call can arrive,
    and are then decided in the order of their times. A timer for the earliest held call wakes a session; another, one
    window after its last admitted call, clears what is left of a silent one."""

    def __init__(self, *args, held: str):
        super().__init__(*args)
        self.held_schema = held

    def init(self, handle) -> None:
        super().init(handle)
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-(micros + SHIFT) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        calls = [tuple(r)[:-1] for r in rows]  # without the watermark's column
        if calls:
            self.held.appendList(calls)
            self._wake(min(c[-1] for c in calls))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 - SHIFT
        held = [Row(*[*self.names, "_t"])(*r) for r in self.held.get()] if self.held.exists() else []
        due, later = [r for r in held if r["_t"] <= passed], [r for r in held if r["_t"] > passed]
        yield from self._decided(due, passed)
        if due:
            if later:
                self.held.put([tuple(r) for r in later])
            else:
                self.held.clear()
        if later:
            self._wake(min(r["_t"] for r in later))
        elif self.last is not None:
            self._wake(self.last + self.window)


def session_admission_stream(
    sdf: DataFrame, session: str, ts: str, followup: str | None = None,
    min_gap_s: float = MIN_GAP_S, max_calls: int = MAX_CALLS, window_s: float = WINDOW_S,
    idle_s: float | None = None, late_s: float | None = None, tie: str | None = None,
) -> DataFrame:
    """``session_admission`` on a stream. Columns come back as they were, missing ones too. Needs the RocksDB state store.

    Without ``late_s`` calls are decided as they arrive, per session: within a micro-batch in time order (calls of equal
    time by ``tie``, or all columns), and the admitted times of the current window are the only state. With ``idle_s``
    (at least one window) the state of a session that has been silent that long by the clock is dropped, which bounds
    the state of a stream with ever new sessions.

    With ``late_s`` calls are decided by event time: a call waits until the watermark, the latest time seen less
    ``late_s``, has passed it, so that calls that arrive in any order within ``late_s`` are decided as in a batch. Calls
    that come later than that are left out, as by any watermark, and so are calls without a time; the last calls of a
    stream wait until later ones come. State is the calls held and the admitted times of sessions with a call in the last
    window.
    """
    require(sdf, session, ts, *[c for c in (followup, tie) if c])
    fields = list(sdf.schema.fields) + [
        T.StructField("allowed", T.BooleanType()), T.StructField("reason", T.StringType())
    ]
    rules = round(min_gap_s * MICROS), max_calls, round(window_s * MICROS)
    order = [tie] if tie else sdf.columns
    timed = sdf.withColumn("_t", _micros(sdf, ts))
    if late_s is None:
        processor = _Admission(sdf.columns, followup, *rules, None if idle_s is None else round(idle_s * 1000), order)
        mode = "none" if idle_s is None else "processingTime"
    else:
        if idle_s is not None:
            raise ValueError("idle_s is for calls decided as they arrive; by event time silent sessions are cleared anyway")
        processor = _Held(sdf.columns, followup, *rules, None, order, held=timed.schema)
        # the watermark's column stays outside the rows that the state holds
        timed = timed.withColumn("_event", F.timestamp_micros(F.col("_t") + F.lit(SHIFT))).withWatermark("_event", f"{round(late_s * 1000)} milliseconds")
        mode = "eventTime"
    return timed.groupBy(col(session)).transformWithState(
        statefulProcessor=processor, outputStructType=T.StructType(fields), outputMode="append", timeMode=mode)
