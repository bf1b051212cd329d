"""Line search over texts: literal, regular expression or fuzzy, with context lines and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import text as T

MAX_PATTERN, MAX_CONTEXT, MAX_LIMIT, MAX_START = 64 * 1024, 20, 1000, 100_000


class SearchError(ValueError):
    """A search that is refused: both modes at once, an empty or too long pattern, or bounds out of range."""


def line_predicate(pattern: str, regex: bool = False, fuzzy: bool = False, case_sensitive: bool = True):
    """Predicate over a line column; refuses what the search contract refuses."""
    if regex and fuzzy:
        raise SearchError("regex and fuzzy exclude each other")
    if not pattern or len(pattern.encode()) > MAX_PATTERN:
        raise SearchError("pattern is empty or too long")
    if regex:
        return lambda line: line.rlike(pattern if case_sensitive else "(?i)" + pattern)
    if fuzzy:
        return lambda line: T.fuzzy(line, pattern) if case_sensitive else T.fuzzy(T.ascii_lower(line), pattern.lower())
    return lambda line: T.contains_line(line, pattern, case_sensitive)


def search_lines(texts: DataFrame, keys: list[str], pattern: str, context: int = 0, **mode) -> DataFrame:
    """(keys, line_no, line[, before, after]) of the lines that match.

    texts: keys and ``content``. Context comes from the text's own line array, so no window over lines and no
    shuffle is needed. For a case-sensitive literal the whole text is filtered first. Null texts hold no line.
    """
    if not 0 <= context <= MAX_CONTEXT:
        raise SearchError("context out of range")
    hit = line_predicate(pattern, **mode)
    literal = not mode.get("regex") and not mode.get("fuzzy")
    if literal:
        texts = texts.where(T.contains_line(F.col("content"), pattern, mode.get("case_sensitive", True)))
    rows = texts.select(*keys, T.lines(F.col("content")).alias("_l")).select(*keys, "_l", F.posexplode("_l").alias("_i", "line"))
    rows = rows.where(hit(F.col("line"))).withColumn("line_no", F.col("_i") + 1)
    if not context:
        return rows.select(*keys, "line_no", "line")
    before = F.slice("_l", F.greatest(F.col("_i") + 1 - context, F.lit(1)), F.least(F.col("_i"), F.lit(context)))
    after = F.slice("_l", F.col("_i") + 2, F.lit(context))
    return rows.select(*keys, "line_no", "line", before.alias("before"), after.alias("after"))


def page(rows: DataFrame, order: list[str], limit: int, start: int = 0, after: tuple | None = None) -> DataFrame:
    """Rows start..start+limit-1 of a total order, with their positions from 0.

    ``after``, the order values of the last row seen, goes on from there at any depth and at the cost of one page; positions
    then count from that row. ``start`` is bounded, as all rows before the page have to be ordered in one task.
    Null order values come first and can't be gone on from.
    """
    if not 0 < limit <= MAX_LIMIT or not 0 <= start <= MAX_START:
        raise SearchError("limit or start out of range")
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(order, after, strict=True))))
    top = rows.orderBy(*order).limit(start + limit)
    return top.withColumn("position", F.row_number().over(W.orderBy(*order)) - 1).where(F.col("position") >= start)


def bounded(files: DataFrame, size: Column, order: list[str], max_files: int, max_bytes: int, partition: list[str]) -> DataFrame:
    """Files of each partition in order until a bound is met: adds ``admitted`` and the first ``reason`` that stopped.

    Only the first ``max_files`` of a partition have to be added up, and a rank under a bound is cut before the exchange;
    whatever comes after the last of them is past the bound of files. Order values must tell the files of a partition apart.
    """
    w = W.partitionBy(*partition).orderBy(*order)
    first = files.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_files)
    over = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) > max_bytes
    first = first.select(*partition, *order, F.when(over, "bytes").alias("_over"), F.lit(True).alias("_in"))
    reason = F.when(F.col("_in").isNull(), "files").otherwise(F.col("_over"))
    out = files.join(first, [*partition, *order], "left").withColumn("reason", reason).drop("_over", "_in")
    return out.withColumn("admitted", F.col("reason").isNull())
