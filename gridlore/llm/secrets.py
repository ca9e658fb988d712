"""Secret scans: long tokens are candidates, a random forest removes the false positives."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.text import let, numbers, whole

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
MARK = "\u0001"
NAMES = r"(?i)(secret|token|passw(or)?d|pwd|api[_ -]?key|access[_ -]?key|auth|credential|private[_ -]?key|bearer)"
HARMLESS = r"(?i)(example|sample|dummy|placeholder|your|fake|checksum|sha\d*|md5|digest|commit|uuid)"
HARMLESS_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"

FEATURES = ("length", "digits", "capitals", "switches", "transitions", "dictionary", "path_harmless",
            "named_before", "assigned", "quoted", "harmless_near")
# Parameters of the training: words of the dictionary, those of them matched inside candidates, and labelled findings
# of each class that the forest is grown from.
DICTIONARY, INSIDE, PER_CLASS = 20_000, 400, 4_000
TREES, DEPTH, SEED = 20, 5, 7


class Lexicon:
    """The corpus' frequent words and the letter transitions inside them."""

    def __init__(self, inside: list[str], transitions: list[float]):
        self.inside, self.transitions = inside, transitions


def learn_lexicon(docs: DataFrame, text_col: str = "text") -> Lexicon:
    """Counted over the words of all documents: the most frequent DICTIONARY words of four letters or more (ties by the
    word), and from them the log probability of each letter after each letter, with one added to every count."""
    found = docs.select(F.explode(F.split(F.lower(whole(F.col(text_col))), r"[^a-z]+")).alias("w"))
    top = (found.where(F.length("w").between(4, 15)).groupBy("w").count()
           .orderBy(F.desc("count"), "w").limit(DICTIONARY).collect())
    counts = [[1.0] * 26 for _ in range(26)]
    for w, n in top:
        for a, b in zip(w, w[1:]):
            counts[ord(a) - 97][ord(b) - 97] += n
    flat = [math.log(x / sum(row)) for row in counts for x in row]
    return Lexicon([w for w, _ in top[:INSIDE]], flat)


def _pieces(text: Column) -> Column:
    """The text cut at its candidates: what lies between them at even places, the candidates at odd places."""
    marked = F.regexp_replace(F.translate(text, MARK, " "), CANDIDATE, f"{MARK}$0{MARK}")
    return F.split(marked, MARK)


def _measured(value: Column, before: Column, after: Column, path: Column, lexicon: Lexicon) -> Column:
    """The features of one candidate, as a struct of doubles."""
    n = F.length(value).cast("double")
    without = lambda p: (n - F.length(F.regexp_replace(value, p, ""))) / n
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0")
    table = numbers(lexicon.transitions)

    def follow(codes: Column) -> Column:
        def one(i: Column) -> Column:
            a, b = F.get(codes, i), F.get(codes, i + 1)
            return F.when(a.between(0, 25) & b.between(0, 25), F.get(table, a * 26 + b)).otherwise(-7.0)
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 2), F.lit(0.0), lambda t, i: t + one(i)) / (F.size(codes) - 1)

    inside = "|".join(sorted(lexicon.inside, key=lambda w: (-len(w), w))) or "$^"
    flag = lambda c: c.cast("double")
    values = (
        n, without("[0-9]"), without("[A-Z]"), (F.length(shape) - 1) / (n - 1), let(F.transform(F.split(F.lower(value), ""), lambda c: F.ascii(c) - 97), follow),
        (n - F.length(F.regexp_replace(F.lower(value), f"({inside})", ""))) / n, flag(path.rlike(HARMLESS_PATH)),
        flag(before.rlike(NAMES)), flag(before.rlike(r"[=:]\s*[\"']?$")), flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        flag((before.rlike(HARMLESS)) | after.rlike(HARMLESS)),
    )
    return F.struct(*(v.alias(k) for k, v in zip(FEATURES, values)))


def candidates(text: Column, path: Column, lexicon: Lexicon) -> Column:
    """Array of the candidates of a whole text: place, value, the 60 signs before and after, and the features."""
    def each(p: Column) -> Column:
        def one(i: Column) -> Column:
            made = F.struct(i.alias("place"), F.get(p, i).alias("value"), F.length(F.get(p, i - 1)).alias("gap"),
                            F.right(F.get(p, i - 1), F.lit(60)).alias("before"),
                            F.left(F.get(p, i + 1), F.lit(60)).alias("after"))
            return let(made, lambda c: F.struct(
                c["place"].alias("place"), c["value"].alias("value"), c["gap"].alias("gap"), c["before"].alias("before"), c["after"].alias("after"),
                _measured(c["value"], c["before"], c["after"], path, lexicon).alias("x")))
        return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), one))
    return let(_pieces(text), each)


def label_by_rule(found: DataFrame) -> DataFrame:
    """Labelled findings where nobody has labelled any: a value with a digit that is assigned to a name of credentials
    is one (1); a value of digits only or letters only is none (0); the rest stays unlabelled and is left to the forest."""
    named = F.col("before").rlike(NAMES + r"\W{0,4}$") & F.col("before").rlike(r"[=:]\s*[\"']?$")
    digit, letter = F.col("value").rlike("[0-9]"), F.col("value").rlike("[A-Za-z]")
    label = F.when(named & digit & letter, 1.0).when(~digit | ~letter, 0.0)
    return found.withColumn("label", label).where(F.col("label").isNotNull())


def findings(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate of docs: value, before, after and the features."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    cells = docs.select(candidates(whole(F.col(text_col)), path, lexicon).alias("c"))
    return cells.select(F.explode("c").alias("c")).select("c.value", "c.before", "c.after", "c.x.*")


class Forest:
    """Trees as nested lists: [feature, threshold, left, right], or the leaf's probability of being a secret."""

    def __init__(self, trees: list):
        self.trees = trees

    def score(self, x: Column) -> Column:
        """The mean over the trees as a column, read from a struct of features; 0 without trees."""
        def walk(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(
                x[FEATURES[t[0]]] <= t[1], walk(t[2])).otherwise(walk(t[3]))
        total = reduce(lambda a, b: a + b, (walk(t) for t in self.trees), F.lit(0.0))
        return total / max(1, len(self.trees))


def train_forest(labelled: DataFrame) -> Forest:
    """A forest from labelled findings (the features and label 0 or 1). At most PER_CLASS different findings of each
    label are used, those with the least hash, a bound that doesn't depend on the table. One label alone grows nothing."""
    distinct = labelled.select(*FEATURES, "label", F.xxhash64("value", "before").alias("h")).dropDuplicates(["h"])
    parts = [distinct.where(F.col("label") == k).orderBy("h").limit(PER_CLASS) for k in (0.0, 1.0)]
    sample = parts[0].unionByName(parts[1]).repartition(4, "h").sortWithinPartitions("h").persist()
    try:
        if sample.select("label").distinct().count() < 2:
            return Forest([])
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
        model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(ready)
    finally:
        sample.unpersist()

    def nested(node):
        if node.numDescendants() == 0:
            stats = [float(v) for v in node.impurityStats().stats()]
            return stats[1] / max(sum(stats), 1e-12)
        return [node.split().featureIndex(), float(node.split().threshold()), nested(node.leftChild()), nested(node.rightChild())]

    return Forest([nested(t._java_obj.rootNode()) for t in model.trees])


def scan(docs: DataFrame, lexicon: Lexicon, forest: Forest, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source") -> DataFrame:
    """One row per candidate: the id, start and end (code points, end exclusive), value, score and is_secret.

    Null and empty texts have no candidates. A \\u0001 in a text counts as a blank. Rows that repeat, also with null
    ids, are reported each. An empty table gives no rows. Other columns are not read.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = whole(F.col(text_col))
    # a start is the length of all pieces before it, summed over the document's own rows
    base = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"),
                       candidates(text, path, lexicon).alias("c"))
    rows = base.select("__id", "__row", F.explode("c").alias("c")).select(
        "__id", "__row", "c.place", "c.value", "c.gap", "c.x")
    upto = Window.partitionBy("__row").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    placed = rows.withColumn("end", end.cast("long")).withColumn("score", forest.score(F.col("x")))
    return placed.select(F.col("__id").alias(id_col), (F.col("end") - F.length("value")).cast("long").alias("start"), "end",
                         "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, lexicon: Lexicon, forest: Forest, text_col: str = "text", path_col: str | None = "source",
           mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by mask, row by row: no shuffle, no row lost, the other columns as they were."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = F.col(text_col)

    def cleaned(p: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            x = _measured(piece, F.right(F.get(p, F.greatest(i - 1, F.lit(0))), F.lit(60)), F.left(F.get(p, i + 1), F.lit(60)), path, lexicon)
            return F.when(i % 2 == 0, piece).otherwise(
                let(x, lambda f: F.when(forest.score(f) >= 0.5, F.lit(mask)).otherwise(piece)))
        return F.when(F.size(p) > 1, F.array_join(F.transform(p, one), "")).otherwise(text)

    return docs.withColumn(text_col, let(_pieces(text), cleaned))
