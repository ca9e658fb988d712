"""Read-only SQL over named tables. What a statement does is read from the plan that Spark's own parser makes of it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

__all__ = ["run_sql", "check_sql"]

# What a query may start from: a named table, no table, or values written out. Files, table functions, names made at
# run time and older versions of a table are other kinds of leaf.
LEAVES = ("UnresolvedRelation", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation")
# Functions that call code of the JVM, and a function named by an expression.
OUTSIDE_CALLS = ("reflect", "try_reflect", "java_method")
NAMED_LATER = "ExpressionWithUnresolvedIdentifier"
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


class _Gate:
    """Walks a parsed plan and refuses what isn't a query over the allowed names."""

    def __init__(self, spark: SparkSession, tables: set[str]):
        find = spark._jvm.org.apache.spark.util.Utils.classForName  # Spark's own class loader
        kind = lambda name: find(name, True, False)
        self.changes = [kind(LOGICAL + n) for n in ("Command", "ParsedStatement")]
        self.with_plan = kind("org.apache.spark.sql.catalyst.expressions.PlanExpression")
        self.tables = tables

    def plan(self, node, known: frozenset[str]) -> None:
        name = node.getClass().getSimpleName()
        if any(c.isInstance(node) for c in self.changes):
            raise ValueError(f"Only queries can be run; this is a {name}.")
        if name == "UnresolvedWith":
            for bound in _each(node.cteRelations()):
                alias = bound._1().lower()
                self.plan(bound._2(), known | {alias} if node.allowRecursion() else known)
                known = known | {alias}
        elif name == "WithWindowDefinition":
            for window in _each(node.windowDefinitions().values().toSeq()):
                self.expression(window, known)
        elif name == "UnresolvedRelation":
            parts = list(_each(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in self.tables | known:
                raise ValueError(f"{'.'.join(parts)} is not one of the given tables.")
        elif node.children().isEmpty() and name.rstrip("$") not in LEAVES:
            raise ValueError(f"A query can't read from a {name}.")
        for e in _each(node.expressions()):
            self.expression(e, known)
        for child in _each(node.children()):
            self.plan(child, known)

    def expression(self, e, known: frozenset[str]) -> None:
        name = e.getClass().getSimpleName()
        if name == NAMED_LATER or (name == "UnresolvedFunction" and list(_each(e.nameParts()))[-1].lower() in OUTSIDE_CALLS):
            raise ValueError("A query can't call code outside the engine.")
        if self.with_plan.isInstance(e):
            self.plan(e.plan(), known)
        for child in _each(e.children()):
            self.expression(child, known)


def check_sql(spark: SparkSession, sql: str, tables: list[str]) -> None:
    """Refuse anything but one query that reads only the given tables and its own WITH names."""
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ValueError(f"This is not one SQL query: {e}") from e
    _Gate(spark, {t.lower() for t in tables}).plan(parsed, frozenset())


def run_sql(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run a checked query over tables given by name. The names hold during analysis alone: views that the session has
    under them are put back."""
    sql = sql.strip().rstrip(";")
    check_sql(spark, sql, list(views))
    own = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(f"`{name}`") for name in views if name.lower() in own}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
