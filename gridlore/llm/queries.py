"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import (
    bpe, decontamination, jaccard, language, language_model, mixing, negatives, pii, quality, quality_rules, secrets, toxicity,
    trie,
)
from gridlore.llm.text import share, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return put


def labels(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """(doc_id, label) without the documents held out: those whose id's crc32 modulo 5 is 0."""
    return table(spark, folder, "labels").select("doc_id", label).where(share(F.col("doc_id"), 5) != 0)


@query("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate of every document, with its place, score and verdict."""
    docs = table(spark, folder, "documents")
    lexicon = secrets.learn_lexicon(docs)
    labelled = secrets.label_by_rule(secrets.findings(docs, lexicon))
    return secrets.scan(docs, lexicon, secrets.train_forest(labelled))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH pat AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, (SELECT p FROM pat)) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, (SELECT p FROM pat)) AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
       FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(s) WHERE len(w) > 0 AND item IS NOT NULL),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
       FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(s) WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, s, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT r, count(DISTINCT s + k) AS n_hit FROM (SELECT DISTINCT r, s, n FROM hit) h, unnest(range(0, h.n)) AS u(k) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids,
               list_sort(list_distinct(list(item))) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learnt from labels outside the fold held out."""
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(labels(spark, folder, "toxic"), docs=docs))


@query("op4_pii")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.learn(docs.where(share(F.col("doc_id"), 3) != 1)))


@query("op6_quality_classifier")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality, learnt from labels outside the fold held out."""
    docs = table(spark, folder, "documents")
    return quality.score_quality(docs, quality.learn(labels(spark, folder, "quality"), docs=docs))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents"))


@query("op9_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's rate and copies, for equal token totals of the four languages."""
    docs = table(spark, folder, "documents")
    known = mixing.learn_memberships(docs, "lang")
    mixed = mixing.mix(docs, known, {d: 1.0 for d in known.domains})
    return mixed.select("doc_id", "n_tokens", "posterior", "rate", "copies")


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "p_good", "votes")


# crc32 of an id's decimal digits: a table of 256 remainders, then one step for each digit
_CRC32 = """
crc_bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
             FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits)"""


def _crc32(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "xor(c >> 8, t[1 + xor(c, k) % 256])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, k: {step}), 4294967295)"


OP13_SQL = rf"""
WITH RECURSIVE {_CRC32},
t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS txt,
             md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
      FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS k FROM t),
h AS (SELECT c, {_crc32("c")} % 6 AS h FROM (SELECT DISTINCT c FROM t), crc_table),
r AS (SELECT h.c, n.k, id, txt FROM h JOIN n ON n.c = h.c - h.c % 100 AND n.k <= h.h
      UNION ALL SELECT n.c, n.k, id, txt FROM h JOIN n USING (c) WHERE n.k > h.h),
s AS (SELECT c, k, id, txt, row_number() OVER (PARTITION BY c ORDER BY k) AS d FROM r),
seq AS (SELECT h.c, coalesce(list(id ORDER BY d) FILTER (WHERE id IS NOT NULL), []) AS ids,
               coalesce(list(length(txt) ORDER BY d) FILTER (WHERE id IS NOT NULL), []) AS sizes FROM h LEFT JOIN s USING (c) GROUP BY h.c),
m AS (SELECT c, d, ids[1:d] AS p, CASE WHEN d > 0 THEN ids[1:d - 1] END AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(ids) AS ends
      FROM seq, unnest(range(0, len(ids) + 1)) AS u(d)),
g AS (SELECT p, any_value(up) AS up, d AS depth, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
             string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS members FROM m GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
full_ AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (p)),
below AS (SELECT p[1:a] AS p, sum((n_convs - 1) * size) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
          FROM full_, unnest(range(0, depth + 1)) AS u(a) GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.members, '')) AS ends_sha256
FROM full_ f JOIN below b USING (p) LEFT JOIN g q ON q.p = f.up
"""


def with_openings(convs: DataFrame) -> DataFrame:
    """convs (conv_id, seq) rebuilt: the first h turns of the conversation at the hundred below, then one's own turns after
    the first h, where h is the id's crc32 modulo 6."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 6 * trie.WIDTH).cast("int")
    first = convs.where("conv_id % 100 = 0").select(
        F.col("conv_id").alias("at"), F.substring("seq", F.lit(1), F.lit(5 * trie.WIDTH)).alias("opening"))
    met = convs.withColumn("at", F.col("conv_id") - F.col("conv_id") % 100).join(first, "at", "left")
    opening = F.coalesce(F.substring(F.col("opening"), F.lit(1), h), F.unhex(F.lit("")))
    return met.select("conv_id", F.concat(opening, F.substring(F.col("seq"), h + 1, F.length("seq"))).alias("seq"))


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    found = trie.prefix_trie(with_openings(trie.sequences(table(spark, folder, "conversations"))))
    met = found.nodes.join(trie.ends_digest(found.ends), "node_id", "left")
    return met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


@query("op12_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids and their decoded text, as digests."""
    import public_tokenizers

    rules = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    ids = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), rules).select("doc_id", "ids")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", " ")).alias("ids_sha256"),
                      digest(bpe.decoded(F.col("ids"), rules)).alias("decoded_sha256"))


OP11_SQL = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """For each anchor and positive the hardest negatives, all rows searched."""
    rows = table(spark, folder, "embeddings").where(negatives.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fixed = rows.select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), negatives.fixed_point(F.col("embedding")).alias("q"))
    return negatives.hard_negatives(fixed, F.col("id") % 100 == 0)
