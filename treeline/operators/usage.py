"""Usage events: estimates by bucket, accounting without double counting, trends, instances, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400
IDLE = 24 * 3_600
FUTURE = 300
MAX_BIGINT = 2**63 - 1


def day_floor(epoch: Column) -> Column:
    return F.floor(epoch / DAY).cast("bigint") * DAY


def period_label(ts: Column, window: str) -> Column:
    """Label of the day, week (Monday first, days before the first Monday in week 00), month or year."""
    if window == "week":
        days = F.dayofyear(ts) - 1
        monday = F.weekday(ts)  # 0 = Monday
        return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(F.floor((days + 7 - monday) / 7).cast("string"), 2, "0"))
    return F.date_format(ts, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[window])


def saturated(total: Column) -> Column:
    """A wide sum as bigint, cut at its bounds."""
    return F.greatest(F.least(total, F.lit(MAX_BIGINT).cast("decimal(38,0)")), F.lit(-MAX_BIGINT - 1).cast("decimal(38,0)")).cast("bigint")


def wide_sum(c: str) -> Column:
    return saturated(F.sum(F.col(c).cast("decimal(38,0)")))


def observed(layer: Column, bucket: Column, confidence: Column) -> Column:
    return (layer == "observed_delta") | (bucket == "full_file_compression") | (confidence == "observed")


def modeled(layer: Column, bucket: Column, confidence: Column) -> Column:
    """Not the opposite of observed: an observed event of the modeled layer is both."""
    return (layer == "modeled_avoidance") | ~observed(layer, bucket, confidence)


def bucket_totals(events: DataFrame, dims: list[str]) -> DataFrame:
    """Calls and estimates by dimensions; events without either estimate are skipped. The rate is null when nothing was spent."""
    known = events.where("without_tokens IS NOT NULL AND with_tokens IS NOT NULL")
    g = known.groupBy(*dims).agg(F.count(F.lit(1)).alias("calls"), wide_sum("without_tokens").alias("without_tokens"), wide_sum("with_tokens").alias("with_tokens"))
    return with_rate(g)


def with_rate(g: DataFrame) -> DataFrame:
    saved = F.col("without_tokens") - F.col("with_tokens")
    return g.withColumn("saved", saved).withColumn("rate", F.when(F.col("without_tokens") != 0, saved / F.col("without_tokens")))


def session_accounting(events: DataFrame, by: list[str]) -> DataFrame:
    """Modeled savings by session without counting one baseline twice.

    Events of one (session, identity, fingerprint) share a baseline: its greatest estimate less all that was
    spent; repeats are the calls beyond the first. Events of scope 'event' stand alone.
    """
    scope = F.when(F.col("scope") == "event", F.col("event_id"))
    state = events.groupBy(*by, "session", "identity", "fingerprint", scope.alias("alone")).agg(F.max("without_tokens").alias("w"), F.sum("with_tokens").alias("s"), F.count(F.lit(1)).alias("n"))
    return state.groupBy(*by).agg(F.sum("w").alias("baseline"), F.sum("s").alias("spent"), F.sum(F.col("w") - F.col("s")).alias("saved"), F.sum(F.col("n") - 1).alias("repeats"), F.sum("n").alias("calls"))


def _runs(events: DataFrame, gap: int) -> DataFrame:
    """(owner, _b, started): the run of events that each piece of time of one owner belongs to.

    Pieces are as long as the gap, so no pause inside one ends a run; only first and last times of pieces are compared, and a busy
    owner is spread over its pieces.
    """
    piece = events.groupBy("owner", F.floor(F.col("at") / gap).alias("_b")).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    w = W.partitionBy("owner").orderBy("_b")
    new = F.coalesce(F.col("_first") - F.lag("_last").over(w) >= gap, F.lit(True))
    return piece.withColumn("started", F.last(F.when(new, F.col("_first")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).select("owner", "_b", "started")


def with_instance(events: DataFrame, gap: int = IDLE) -> DataFrame:
    """Adds ``started``, the first time of the run of events (owner, at) an event belongs to."""
    return events.withColumn("_b", F.floor(F.col("at") / gap)).join(_runs(events, gap), ["owner", "_b"]).drop("_b")


def instances(events: DataFrame, gap: int = IDLE) -> DataFrame:
    """(owner, started, last_seen, events) of each run of events with no pause of ``gap`` seconds or more."""
    piece = events.groupBy("owner", F.floor(F.col("at") / gap).alias("_b")).agg(F.max("at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    return piece.join(_runs(events, gap), ["owner", "_b"]).groupBy("owner", "started").agg(F.max("_last").alias("last_seen"), F.sum("_n").alias("events"))


def exact_median(rows: DataFrame, keys: list[str], value: str, buckets: int = 1024) -> DataFrame:
    """(keys, median): midpoint of the two middle values of each group; nulls don't count, a group of nulls has none.

    Equal values are first counted, then the group is cut into ranges of equal width and only the ranges that hold a middle value
    are put in order, so a group of a third of all rows is no task of its own.
    """
    v = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    span = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))
    cut = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
    v = v.join(span, keys).withColumn("_b", cut)
    per = v.groupBy(*keys, "_b").agg(F.sum("_n").alias("_in"), F.first("_total").alias("_total"))
    upto = F.sum("_in").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1  # ranks of the middle values, from 1
    per = per.withColumn("_end", upto).withColumn("_before", F.col("_end") - F.col("_in")).where((low > F.col("_before")) & (low <= F.col("_end")) | (high > F.col("_before")) & (high <= F.col("_end")))
    inside = F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    mid = v.join(per.select(*keys, "_b", "_before"), [*keys, "_b"]).withColumn("_to", F.col("_before") + inside).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda r: F.max(F.when((r > F.col("_from")) & (r <= F.col("_to")), F.col("_v")))
    return mid.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def prune_plan(rows: DataFrame, now: int, max_age: int, max_rows: int, max_bytes: int) -> DataFrame:
    """Adds ``keep``: raw rows are dropped from the oldest on while they are too old, too many or too large.

    Counts and sizes of newer rows come in two steps, by day and within a day, so that no task holds all rows.
    """
    day = F.floor(F.col("at") / DAY)
    per_day = rows.groupBy(day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b"))
    later = W.orderBy(F.desc("_d")).rowsBetween(W.unboundedPreceding, -1)  # one row per day
    base = per_day.select("_d", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_b").over(later), F.lit(0)).alias("_b0"))
    inside = W.partitionBy("_d").orderBy(F.desc("at"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = rows.withColumn("_d", day).join(base, "_d").withColumn("_rank", F.col("_n0") + F.row_number().over(inside)).withColumn("_size", F.col("_b0") + F.sum("bytes").over(inside))
    return ranked.withColumn("keep", (F.col("at") >= now - max_age) & (F.col("_rank") <= max_rows) & (F.col("_size") <= max_bytes)).select(*rows.columns, "keep")


def bounded_dimensions(events: DataFrame, owner: str, dim: str, kind: str, limit: int) -> DataFrame:
    """Adds ``dimension``: the first ``limit`` dimensions of an owner by first use keep their name, others become '<overflow>' of their kind."""
    first = events.groupBy(owner, dim, kind).agg(F.min(F.struct("at", "event_id")).alias("_f"))
    nth = F.row_number().over(W.partitionBy(owner).orderBy("_f", dim))
    names = first.select(owner, dim, kind, F.when(nth <= limit, F.col(dim)).otherwise(F.concat(F.lit("<overflow>:"), F.col(kind))).alias("dimension"))
    return events.join(names, [owner, dim, kind])


def greatest_before(rows: DataFrame, part: str, order: str, value: str, piece: int = 4096) -> DataFrame:
    """Adds ``before``, the greatest value of the rows of a partition that come before, null for the first.

    Found within pieces of the order and, from one row a piece, over them, so that a large partition is spread.
    """
    b = F.floor(F.col(order) / piece)
    over = W.partitionBy(part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(part, b.alias("_b")).agg(F.max(value).alias("_m")).select(part, "_b", F.max("_m").over(over).alias("_c"))
    inside = W.partitionBy(part, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("_b", b).withColumn("_o", F.max(value).over(inside)).join(carried, [part, "_b"])
    return own.withColumn("before", F.greatest("_o", "_c")).drop("_b", "_o", "_c")


def calibration(texts: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(texts, byte_tokens, tokens, ratio): the estimate of a quarter of the bytes beside the count of a public byte-level tokenizer, over all texts (content).

    vocabulary: file of its ranks; pattern: its regular expression of pieces. The ratio is null without tokens.
    """
    import base64
    from collections.abc import Iterator

    import pandas as pd

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("calibration", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            size = [len(t.encode()) for t in b["content"]]
            yield pd.DataFrame({"b": [(n + 3) // 4 for n in size], "n": [len(enc.encode_ordinary(t)) for t in b["content"]]}, dtype="int64")

    g = texts.where("content IS NOT NULL").select("content").mapInPandas(count, "b bigint, n bigint").agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("b"), F.lit(0)).alias("byte_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return g.withColumn("ratio", F.when(F.col("tokens") != 0, F.col("byte_tokens") / F.col("tokens")))
