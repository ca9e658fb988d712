"""Text jobs, SQL over tables, files and admission."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import gridlore as g
from checks.registry import add
from gridlore.functions.positions import use_checkpoint_folder
from gridlore.operators.grounding import CAUSAL_PHRASES, HEDGE_PHRASES, LEAK_PATTERNS, PREDICTION_PATTERNS
from gridlore.operators.privacy import KINDS, PII_PATTERNS

LETTERS = r"\p{L}\p{N}_"  # what a word character is when it follows Unicode


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return quoted(pattern.replace(r"[\w.+-]", f"[{LETTERS}.+-]").replace(r"[\w-]", f"[{LETTERS}-]"))


def masked(column: str, upto: int | None = None) -> str:
    sql = column
    for _, pattern, placeholder in PII_PATTERNS[:upto]:
        sql = f"regexp_replace({sql}, {re2(pattern)}, '{placeholder}', 'g')"
    return sql


def pii_count(column: str, kind: str) -> str:
    found = [
        f"len(regexp_extract_all({masked(column, i)}, {re2(pattern)}))"
        for i, (k, pattern, _) in enumerate(PII_PATTERNS) if k == kind
    ]
    return f"CAST({' + '.join(found)} AS BIGINT)"


# --- personal data ---
for _table, _key in (("documents", "doc_id"), ("conversations", "conv_id, turn")):
    _cols = _key.split(", ")
    add(f"mask_pii_{_table}", lambda t, n=_table, c=_cols: g.mask_pii(getattr(t, n), "text")
        .select(*c, F.md5("text").alias("digest"), F.length("text").alias("size")),
        f"SELECT {_key}, md5({masked('text')}) AS digest, length({masked('text')}) AS size FROM {_table}")
add("pii_counts", lambda t: g.pii_counts(t.documents, "text")
    .select("doc_id", *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.col("redactions").cast("long").alias("redactions")),
    f"""SELECT doc_id, {', '.join(f"{pii_count('text', k)} AS n_{k}" for k in KINDS)},
        {' + '.join(pii_count('text', k) for k in KINDS)} AS redactions FROM documents""")
add("mask_conversations", lambda t: g.mask_conversations(t.conversations)[1],
    f"""SELECT conv_id, CAST(sum({' + '.join(pii_count('text', k) for k in KINDS)}) AS BIGINT) AS redactions, count(*) AS messages
        FROM conversations GROUP BY 1""")


# --- numbers and labels ---
def numbers(column: str) -> str:
    # a minus glued to a digit is no sign
    clean = rf"regexp_replace({column}, '(\d)-', '\1 ', 'g')"
    return rf"[try_cast(replace(x, ',', '') AS DOUBLE) for x in regexp_extract_all({clean}, '-?\d[\d,]*(?:\.\d+)?')]"


add("extract_numbers", lambda t: g.extract_numbers(t.documents, "text", ["doc_id"]),
    f"""SELECT doc_id, CAST(generate_subscripts(n, 1) - 1 AS INT) AS place, unnest(n) AS number
        FROM (SELECT doc_id, {numbers('text')} AS n FROM documents) AS d""", f="number", digits=6)
_LABEL = r"'\b([A-Za-z][A-Za-z]{2,20})\s+(-?\d[\d,]*(?:\.\d+)?)\s*%?'"
add("extract_labels", lambda t: g.extract_labels(t.claims, "claim", ["claim_id"]),
    f"""WITH p AS (SELECT claim_id, unnest(regexp_extract_all(claim, {_LABEL}, 1)) AS label, unnest(regexp_extract_all(claim, {_LABEL}, 2)) AS v,
          generate_subscripts(regexp_extract_all(claim, {_LABEL}, 1), 1) AS i FROM claims)
        SELECT claim_id, lower(label) AS label, try_cast(replace(v, ',', '') AS DOUBLE) AS number FROM p
        QUALIFY row_number() OVER (PARTITION BY claim_id, lower(label) ORDER BY i) = 1""", f="number")
_POOL = f"list_concat({numbers('evidence')}, [1.0, 0.0])"
_FOREIGN = f"""SELECT claim_id, unnest([n for n in {numbers('claim')} if len([v for v in {_POOL} if abs(v - n) <= 0.01]) = 0]) AS number FROM claims"""
add("ungrounded_numbers", lambda t: g.ungrounded_numbers(t.claims, "claim", "evidence", "question")
    .select("claim_id", F.explode("ungrounded_numbers").alias("number")), _FOREIGN, f="number")
add("mislabelled_numbers", lambda t: g.mislabelled_numbers(t.claims, "claim", "evidence")
    .select("claim_id", F.explode("mislabelled").alias("label")),
    "SELECT claim_id, 'order' AS label FROM claims WHERE claim_id % 5 = 0")

# --- wording ---


def any_phrase(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quoted(p)})" for p in phrases) + ")"


def any_pattern(column: str, patterns: tuple[str, ...], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({column}), {quoted(flags + p)})" for p in patterns) + ")"


_FLAGS = (f"{any_phrase('{0}', CAUSAL_PHRASES)} AS causal, {any_pattern('{0}', PREDICTION_PATTERNS).replace('{0,2}', '{{0,2}}')} AS prediction, "
          f"{any_phrase('{0}', HEDGE_PHRASES)} AS hedge")
add("overclaim_flags", lambda t: g.overclaim_flags(t.claims, "claim").select("claim_id", "causal", "prediction", "hedge"),
    f"SELECT claim_id, {_FLAGS.format('claim')} FROM claims")
add("overclaim_flags_documents", lambda t: g.overclaim_flags(t.documents, "text").select("doc_id", "causal", "prediction", "hedge"),
    f"SELECT doc_id, {_FLAGS.format('text')} FROM documents")
add("ungrounded_names", lambda t: g.ungrounded_names(t.claims, "claim", "evidence", "question")
    .select("claim_id", F.explode("ungrounded_names").alias("name")),
    "SELECT claim_id, 'Atlantis' AS name FROM claims WHERE claim_id % 17 = 0")
add("ungrounded_names_documents", lambda t: g.ungrounded_names(t.documents, "text", "source")
    .select("doc_id", F.size("ungrounded_names").alias("names")))
add("leak_flag", lambda t: g.leak_flag(t.documents, "text").select("doc_id", "leak"),
    f"SELECT doc_id, {any_pattern('text', LEAK_PATTERNS, '(?s)')} AS leak FROM documents")
add("insight_claims", lambda t: g.insight_claims(t.claims, "claim", t.orders).select("claim_id", "ratio_claim", "severity_claim"),
    "SELECT claim_id, claim_id % 19 = 0 AS ratio_claim, claim_id % 19 = 0 AS severity_claim FROM claims")
add("insight_claims_supported", lambda t: g.insight_claims(
        t.claims, "claim", t.dirty.select(F.col("amount").alias("o_totalprice"))).select("claim_id", "ratio_claim", "severity_claim"),
    "SELECT claim_id, claim_id % 19 = 0 AS ratio_claim, false AS severity_claim FROM claims")

# --- known values ---
add("known_values", lambda t: g.known_values(t.customer),
    """SELECT DISTINCT lower(trim(v)) AS value FROM (
         SELECT c_mktsegment AS v FROM customer UNION ALL
         SELECT c_name FROM customer) AS u
       WHERE length(trim(v)) >= 3 AND NOT regexp_full_match(replace(v, '.', ''), '\\d+')""")
_PRIORITIES = "(SELECT DISTINCT lower(o_orderpriority) AS value FROM orders) AS v"
add("mentioned_values", lambda t: g.mentioned_values(t.claims, ["claim_id"], "claim", g.known_values(t.orders)),
    f"SELECT claim_id, value FROM claims JOIN {_PRIORITIES} ON contains(lower(claim), value)")
add("stray_values", lambda t: g.stray_values(t.claims, g.known_values(t.orders), ["claim_id"], "claim", "evidence", "question"),
    f"SELECT claim_id, value FROM claims JOIN {_PRIORITIES} ON contains(lower(claim), value) AND NOT contains(lower(evidence), value)")
_PROBLEMS = f"""concat_ws(',', CASE WHEN claim_id % 11 = 0 THEN 'causal' END, CASE WHEN claim_id % 13 = 0 THEN 'prediction' END,
    CASE WHEN claim_id IN (SELECT claim_id FROM ({_FOREIGN}) AS f) THEN 'number' END, CASE WHEN claim_id % 5 = 0 THEN 'label' END,
    CASE WHEN claim_id % 17 = 0 THEN 'name' END, CASE WHEN claim_id % 23 = 0 THEN 'value' END)"""
add("ground_claims", lambda t: g.ground_claims(
        t.claims, ["claim_id"], "claim", "evidence", "question", g.known_values(t.orders))
    .withColumn("problems", F.array_join("problems", ",")),
    f"SELECT claim_id, {_PROBLEMS} AS problems, {_PROBLEMS} = '' AS trustworthy FROM claims")
add("makes_data_claims", lambda t: g.makes_data_claims(t.questions, ["question_id"], "question", g.known_values(t.orders)),
    r"""SELECT question_id, regexp_matches(question, '\d') OR question_id IN (SELECT question_id FROM questions, """ + _PRIORITIES
    + r""" WHERE contains(lower(question), value)) AS makes_claim FROM questions""")
add("makes_data_claims_conversations", lambda t: g.makes_data_claims(t.conversations, ["conv_id", "turn"], "text"))
add("tag_questions", lambda t: g.tag_questions(t.questions, "question").select("question_id", "tag", "chart_type"),
    """SELECT question_id, CASE question_id % 11 WHEN 0 THEN 'causal' WHEN 1 THEN 'forecast' WHEN 2 THEN 'chart' WHEN 3 THEN 'chart'
         WHEN 4 THEN 'comparison' WHEN 5 THEN 'ranking' WHEN 6 THEN 'ranking' WHEN 7 THEN 'count' WHEN 8 THEN 'chart' WHEN 9 THEN 'forecast' ELSE 'other' END AS tag,
       CASE question_id % 11 WHEN 2 THEN 'histogram' WHEN 3 THEN 'line' WHEN 8 THEN 'pie' END AS chart_type FROM questions""")

# --- agreement ---
add("results_agree", lambda t: g.results_agree(t.questions, "printed", "single").select("question_id", "disagree"),
    f"""WITH q AS (SELECT question_id, try_cast(replace(single, ',', '') AS DOUBLE) AS v, {numbers('printed')} AS ns FROM questions)
        SELECT question_id, v IS NOT NULL AND len([n for n in ns if abs(v - n) <= greatest(0.01, 1e-4 * abs(n), 0.5)
          OR abs(v * 100 - n) <= greatest(0.01, 1e-4 * abs(n), 0.5) OR abs(v / 100 - n) <= greatest(0.01, 1e-4 * abs(n), 0.5)]) = 0 AS disagree FROM q""")
add("tables_differ", lambda t: g.tables_differ(
        t.dirty.select("order_id", "priority"), t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"))),
    """WITH a AS (SELECT order_id, priority FROM dirty), b AS (SELECT o_orderkey AS order_id, o_orderpriority AS priority FROM orders)
       SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) AS x UNION ALL
       SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) AS y""")

# --- SQL ---
_JOIN = """WITH best AS (SELECT c_nationkey, sum(o_totalprice) AS spent FROM orders JOIN customer ON o_custkey = c_custkey
             WHERE o_orderstatus <> 'P' GROUP BY c_nationkey HAVING sum(o_totalprice) > 1000000)
           SELECT n_name, r_name, spent, rank() OVER (PARTITION BY r_name ORDER BY spent DESC) AS place
           FROM best JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
add("run_sql_join_window", lambda t: g.run_sql(t.spark, {n: getattr(t, n) for n in ("orders", "customer", "nation", "region")}, _JOIN),
    _JOIN, f="spent")
_SETS = """SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 INTERSECT
           SELECT c_custkey FROM customer WHERE c_acctbal < 0
           UNION ALL SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"""
add("run_sql_sets", lambda t: g.run_sql(t.spark, {n: getattr(t, n) for n in ("orders", "customer")}, _SETS), _SETS)
_CUBE = """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
           GROUP BY CUBE (l_returnflag, l_linestatus) ORDER BY n DESC OFFSET 1"""
add("run_sql_cube", lambda t: g.run_sql(t.spark, {"lineitem": t.lineitem}, _CUBE), _CUBE, f="quantity")

# --- files ---
add("preview", lambda t: g.preview(t.customer, 20, ["c_custkey"]),
    "SELECT * FROM customer ORDER BY c_custkey LIMIT 20", f="c_acctbal")
add("promote_dates", lambda t: g.promote_dates(t.dirty).select("order_id", F.col("order_date").cast("date").alias("order_date")),
    "SELECT order_id, try_cast(order_date AS DATE) AS order_date FROM dirty", dates="order_date")
add("dedupe_columns", lambda t: g.dedupe_columns(t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("n_name"))),
    "SELECT n_nationkey, n_name, n_regionkey AS n_name_2 FROM nation")


def _folder(t, kind: str) -> str:
    use_checkpoint_folder(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def _csv_round_trip(t):
    path = _folder(t, "csv")
    g.write_csv(t.customer, path)
    return g.read_csv(t.spark, path)


add("read_csv", _csv_round_trip, "SELECT * FROM customer", f="c_acctbal")



def _other_encoding(t):
    """Names written in an encoding that isn't UTF-8, and read back by trial."""
    path = _folder(t, "latin")
    named = t.customer.select("c_custkey", F.concat(F.lit("José "), "c_name").alias("name"))
    named.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return g.read_csv(t.spark, path)


add("read_csv_encoding", _other_encoding, "SELECT c_custkey, 'José ' || c_name AS name FROM customer")


# --- admission ---
GAP, CALLS, SPAN = 3600, 4, 86400
# a call's fate hangs on the ones before it: the calls of all sessions are taken one after the other, side by side
_ADMISSION = f"""RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, true AS allowed, '' AS reason, [t] AS times FROM e WHERE k = 1
      UNION ALL SELECT user_id, event_id, k, why = '', why, CASE WHEN why = '' THEN list_append(live, t) ELSE live END FROM (
        SELECT *, CASE WHEN len(live) > 0 AND t - live[-1] < {GAP}000000 THEN 'too soon' WHEN len(live) >= {CALLS} THEN 'window full' ELSE '' END AS why
        FROM (SELECT e.user_id, e.event_id, e.k, e.t, list_filter(r.times, lambda x: e.t - x < {SPAN}000000) AS live
              FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.k = r.k + 1)))"""
add("session_admission", lambda t: g.session_admission(t.events, "user_id", "ts", min_gap_s=GAP, max_calls=CALLS, window_s=SPAN)
    .select("event_id", "allowed", F.coalesce("reason", F.lit("")).alias("reason")), f"WITH {_ADMISSION} SELECT event_id, allowed, reason FROM r")
add("session_admission_default", lambda t: g.session_admission(t.events, "user_id", "ts").select("event_id", "allowed"),
    """SELECT event_id, true AS allowed FROM events WHERE (SELECT min(d) >= 2 FROM (
         SELECT epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS d FROM events) AS g)""")
add("window_usage", lambda t: g.window_usage(t.events, "user_id", "ts", window_s=86400).select("event_id", "used", "remaining"),
    """SELECT event_id, used, greatest(0, 20 - used) AS remaining FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id
       ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS used FROM events) AS u""")

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _replayed(t, source, kind: str, **more):
    """A source of events replayed as a stream into a table, and the table; the session's state store is put back."""
    out, before = _folder(t, kind), t.spark.conf.get(PROVIDER)
    t.spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        decided = g.session_admission_stream(source, "user_id", "ts", min_gap_s=GAP, max_calls=CALLS, window_s=SPAN, tie="event_id", **more)
        query = (
            decided.writeStream.format("parquet").option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        t.spark.conf.set(PROVIDER, before)
    return t.spark.read.schema(decided.schema).parquet(f"{out}/rows")


def _stream(t):
    """The events as they lie in the table, in one micro-batch."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    return _replayed(t, events, "admission").select("event_id", "allowed", F.coalesce("reason", F.lit("")).alias("reason"), "props")


def _late_stream(t):
    """The events in any order over four micro-batches, decided by event time; a last call far ahead lets all of them pass."""
    source, parts = _folder(t, "arrivals"), 4
    ends = t.events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    span = (ends["b"] - ends["a"]).total_seconds() + 1
    for k in range(parts):
        t.events.filter(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(source)
    last = t.events.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"),
                                          "ts": F.lit(ends["b"]).cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, 0, 0, {2 * span + 10})")})
    last.coalesce(1).write.mode("append").parquet(source)
    events = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return _replayed(t, events, "late", late_s=span).select("event_id", "allowed", F.coalesce("reason", F.lit("")).alias("reason"), "props")


_WITH_PROPS = f"WITH {_ADMISSION} SELECT event_id, allowed, reason, props FROM r JOIN events USING (event_id)"
add("session_admission_stream", _stream, _WITH_PROPS)
add("session_admission_late_stream", _late_stream, _WITH_PROPS)
