"""Relevance of files to a query: tiers, evidence with reasons, and the files that stand near those found."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T

MOST_REASONS, MOST_SYMBOLS, MOST_CANDIDATES = 6, 50, 100
PATH, SUMMARY, SYMBOL, TEXT, PAIR, FAMILY, CONNECTION, MOST_GRAPH = 40, 20, 35, 15, 10, 2, 18, 32
# Kinds of symbols that count as evidence.
SYMBOL_KINDS = ["function", "method", "class", "struct", "enum", "trait", "interface", "type", "module", "value"]


def query_terms(text: str) -> list[str]:
    """Different lower-case words of a query, sorted."""
    return sorted({x.lower() for x in re.split(r"[\W_]+", text) if x})


def candidate_target(query: str, limit: int) -> int:
    """How many candidates are looked at for ``limit`` answers: three times as many, a hundred at most; just the limit without a query."""
    return limit if not query.strip() else max(limit, min(3 * limit, MOST_CANDIDATES))


def first_symbol(symbols: DataFrame, terms: list[str]) -> DataFrame:
    """(pid, path, symbol, term): of the first fifty symbols of a file, by name and signature, the first whose name, else signature, holds a term."""
    w = W.partitionBy("pid", "path").orderBy("name", "signature")
    s = symbols.where(F.col("symbol_kind").isin(SYMBOL_KINDS) & F.col("path").isNotNull()).select("pid", "path", "name", F.coalesce("signature", F.lit("")).alias("signature")).distinct()
    s = s.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST_SYMBOLS)
    s = s.withColumn("term", F.coalesce(T.first_term(F.col("name"), terms), T.first_term(F.col("signature"), terms))).where("term IS NOT NULL")
    return s.groupBy("pid", "path").agg(F.min_by(F.struct(F.col("name").alias("symbol"), "term"), "_n").alias("s")).select("pid", "path", "s.*")


def pair_candidates(path: Column) -> Column:
    """Paths that by custom hold the tests of a source, or the source of tests."""
    folder, base = P.parent(path), P.basename(path)
    stem, ext = F.regexp_replace(base, r"\.[^.]*$", ""), F.regexp_extract(base, r"(\.[^.]*)$", 1)
    at = lambda d, name: F.when(d == ".", name).otherwise(F.concat(d, F.lit("/"), name))
    tested = F.regexp_replace(F.regexp_replace(stem, "^test_", ""), "_test$", "")
    names = F.when(tested != stem, F.array(F.concat(tested, ext))).otherwise(F.array(F.concat(F.lit("test_"), base), F.concat(stem, F.lit("_test"), ext)))
    return F.flatten(F.transform(names, lambda n: F.array(at(folder, n), F.concat(F.lit("tests/"), n))))


def score_files(files: DataFrame, query: str) -> DataFrame:
    """Evidence of each file: exact_path, exact_name, reviewed, score, codes.

    files: pid, path, purpose, agent_reviewed, summary, symbol (name of a matching symbol or null), text_hit, paired, families (number of kinds of
    connections), matches (connections whose target holds a term). Columns that are null tell nothing. Without terms only an exact
    match counts.
    """
    terms, exact = query_terms(query), query.strip().replace("\\", "/").lower()
    hit = lambda col: T.first_term(F.coalesce(col, F.lit("")), terms).isNotNull() if terms else F.lit(False)
    low = F.lower(F.translate("path", "\\", "/"))
    exact_path, exact_name = (low == exact) & F.lit(bool(exact)), (P.basename(low) == exact) & F.lit(bool(exact))
    some = lambda name: F.coalesce(F.col(name), F.lit(False))
    in_path = hit(F.col("path")) & ~exact_path
    reviewed = some("agent_reviewed") & hit(F.col("purpose"))
    in_summary, symbol, text, pair = hit(F.col("summary")), F.col("symbol").isNotNull(), some("text_hit"), some("paired")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    graph = F.least(n("families") * FAMILY + n("matches") * CONNECTION, F.lit(MOST_GRAPH))
    points = lambda cond, k: F.when(cond, k).otherwise(0)
    score = points(in_path, PATH) + points(in_summary, SUMMARY) + points(symbol, SYMBOL) + points(text, TEXT) + points(pair, PAIR) + graph
    codes = [(exact_path, "exact_path"), (exact_name, "exact_name"), (in_path, "path"), (reviewed, "reviewed_purpose"), (in_summary, "summary"), (symbol, "symbol"), (text, "indexed_text"), (pair, "paired_file"), (n("families") > 0, "graph")]
    reasons = F.slice(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in codes))), 1, MOST_REASONS)
    return files.select("pid", "path", exact_path.alias("exact_path"), exact_name.alias("exact_name"), reviewed.alias("reviewed"), score.cast("int").alias("score"), reasons.alias("codes"))


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` files of each repository: exact path, exact name, reviewed purpose, score, then path. The rank is cut before the exchange."""
    w = W.partitionBy("pid").orderBy(F.desc("exact_path"), F.desc("exact_name"), F.desc("reviewed"), F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def appended(chosen: DataFrame, more: DataFrame, target: int) -> DataFrame:
    """``chosen`` (pid, path) with so many of ``more`` (pid, path), by path, that a repository has ``target`` files; none twice. ``source`` tells which is which.

    chosen is short, it holds no more than a page of each repository.
    """
    have = chosen.groupBy("pid").agg(F.count(F.lit(1)).alias("_have"))
    new = more.select("pid", "path").distinct().join(chosen.select("pid", "path"), ["pid", "path"], "left_anti")
    new = new.withColumn("_n", F.row_number().over(W.partitionBy("pid").orderBy("path"))).where(F.col("_n") <= target)
    new = new.join(have, "pid", "left").where(F.col("_n") + F.coalesce("_have", F.lit(0)) <= target)
    return chosen.select("pid", "path", F.lit("chosen").alias("source")).unionByName(new.select("pid", "path", F.lit("appended").alias("source")))
