"""Queries of symbols, calls, imports and summaries read from source texts. They are tested against parsers and fixtures; SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import facts as X
from treeline.operators import symbols as S
from treeline.plans.index_tables import from_latest_texts
from treeline.plans.registry import query
from treeline.sources.tables import spread

c = F.col


def graphs(spark: SparkSession, root: str) -> DataFrame:
    """One row per file: what is declared, used and imported. Texts are read once behind the scan."""
    from treeline.plans.index_tables import _stored, _version, latest_states

    rows = S.symbol_graphs(spread(_stored(spark, root, "content").select("pid", "path", _version(), "content"), "_k"), ["pid", "path", "_k"])
    return rows.join(latest_states(spark, root).select("_k"), "_k", "left_semi").dropDuplicates(["_k"]).drop("_k")


@query()
def s280_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Every declaration with its kind, parent, lines and signature."""
    return graphs(spark, root).select("pid", "path", "parser", F.explode("symbols").alias("s")).select("pid", "path", "parser", "s.*")


@query()
def s286_relations(spark: SparkSession, root: str) -> DataFrame:
    """Calls, imports and dependencies with the declaration they stand in; equal ones of a file as one, with their number and first line."""
    r = graphs(spark, root).select("pid", "path", F.explode("relations").alias("r")).select("pid", "path", "r.*")
    return r.groupBy("pid", "path", "source", "kind", "target").agg(F.count(F.lit(1)).alias("occurrences"), F.min("line").alias("line"))


@query()
def s229_imports(spark: SparkSession, root: str) -> DataFrame:
    """What files import: module, name in it, and local name."""
    return graphs(spark, root).select("pid", "path", F.explode("imports").alias("i")).select("pid", "path", "i.*").distinct()


@query()
def s287_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Packages of manifests and what they depend on."""
    r = graphs(spark, root).where("parser = 'manifest'").select("pid", "path", F.explode("relations").alias("r")).select("pid", "path", c("r.source").alias("package"), c("r.target").alias("dependency"))
    return r.distinct()


@query()
def s109_import_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Calls by an imported name with the one symbol it stands for: the module's alias and the imported name must lead to a single symbol, and the local name be imported once."""
    g = graphs(spark, root)
    sym = g.select("pid", c("path").alias("home"), F.explode("symbols").alias("s")).select("pid", "home", c("s.name").alias("imported")).distinct()
    sym = sym.select("pid", "home", "imported", F.explode(X.module_aliases(c("home"))).alias("alias"))
    imp = g.select("pid", "path", F.explode("imports").alias("i")).select("pid", "path", "i.module", "i.imported", "i.local").where("imported IS NOT NULL").distinct()
    once = imp.groupBy("pid", "path", "local").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    imp = imp.join(once, ["pid", "path", "local"]).withColumn("alias", F.regexp_replace("module", r"^(\./|crate::|\.+)", "")).where("alias <> ''")
    met = imp.join(sym, ["pid", "alias", "imported"]).select("pid", "path", "local", "imported", "home").distinct()
    one = met.groupBy("pid", "path", "local", "imported").agg(F.count(F.lit(1)).alias("n"), F.min("home").alias("home")).where("n = 1").drop("n")
    calls = g.select("pid", "path", F.explode("relations").alias("r")).where("r.kind = 'calls'").select("pid", "path", c("r.target").alias("local")).distinct()
    return one.join(calls, ["pid", "path", "local"], "left_semi")


@query()
def s291_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of documents and configurations (291) and the documentation that opens a file (245)."""
    return from_latest_texts(spark, root, lambda t: S.describe(t, ["pid", "path", "_k"]))


@query()
def s243_graph_summaries(spark: SparkSession, root: str) -> DataFrame:
    """A sentence about what each file declares."""
    s = graphs(spark, root).select("pid", "path", F.explode("symbols").alias("s")).select("pid", "path", "s.name", "s.kind", "s.line_start")
    return S.graph_summary(s, ["pid", "path"])
