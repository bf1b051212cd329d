"""Combining sources to target shares by systematic sampling."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.llm.common import query
from treeline.sources.tables import spread, table, written

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
UNIT = 1 << 24
BUCKETS = 1024
MOST_NAMED = 10_000  # listed sources up to which their names are handed to the scan


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """Adds ``tokens``, the length of ``text`` under a public byte-level BPE; null counts 0. Without ``keep_text`` the text goes no further.

    Words repeat, so each worker keeps the lengths of pre-token pieces it has met.
    """
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield b[names].assign(tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b[text]]).astype({"tokens": "int64"})

    return spread(docs).mapInPandas(count, fields + ", tokens bigint")


def usable_targets(targets: DataFrame) -> DataFrame:
    """(source, share, cap): one row per source with a positive share; a missing cap means no repetition."""
    one = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    return one.where("share > 0 AND NOT isnan(share)").withColumn("cap", F.coalesce("cap", F.lit(1))).where("cap > 0")


def expected_copies(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share, cap, texts, available, rate): ``rate`` copies of each text of a source give its share.

    ``total`` tokens are aimed at, by default all that the used sources hold. A rate never exceeds the cap;
    a source too small for its share therefore falls short. Shares are relative to their sum over the
    listed sources with documents. Rates are in units of 1/UNIT copy, so that sums are exact.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("available"))
    used = have.join(targets, "source").where("available > 0")
    every = W.partitionBy()  # one row per listed source
    goal = F.lit(total) if total is not None else F.sum("available").over(every)
    wanted = goal * F.col("share") / F.sum("share").over(every) / F.col("available")
    return used.withColumn("rate", F.floor(F.least(wanted, F.col("cap").cast("double")) * UNIT).cast("bigint"))


def systematic_copies(units: DataFrame, rates: DataFrame, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``copies`` to units (source, id, ...): how often each is used.

    Within a source the expected copies are summed in a fixed random order; a unit is used once for each
    whole number its sum, shifted by one random offset per source, passes. The sum runs in two steps,
    over buckets of the order and within a bucket, so no source is gathered in one task.
    """
    order = F.xxhash64(F.lit(seed), F.col("id"))
    rows = units.join(rates.select("source", "rate"), "source").withColumn("_o", order).withColumn("_b", F.pmod("_o", F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source", "_b").agg(F.sum("rate").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offset = F.pmod(F.xxhash64(F.lit("offset"), F.lit(seed), F.col("source")), F.lit(UNIT))
    starts = sums.select("source", "_b", (F.coalesce(before, F.lit(0)) + offset).alias("_start"))
    inside = W.partitionBy("source", "_b").orderBy("_o", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.join(starts, ["source", "_b"]).withColumn("_end", F.col("_start") + F.sum("rate").over(inside))
    whole = lambda c: F.shiftright(c, 24)
    return rows.withColumn("copies", whole(F.col("_end")) - whole(F.col("_end") - F.col("rate"))).drop("_o", "_b", "_start", "_end")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Mixture (doc_id, source, tokens, copies) and report (source, target_share, available, tokens, actual_share, ...).

    documents: doc_id, text, source. Equal texts are one unit, held by the first listed source that has it and
    its least doc_id, so that no text is used more than max_repeats times. Documents of sources not listed, with
    null or empty text, or null source are not used; a listed source without documents, or without share, is reported with
    0 tokens. A document with 0 copies is not in the mixture. Empty tables: empty results.
    """
    goals = usable_targets(targets)
    docs = documents.select("doc_id", "text", "source").where("doc_id IS NOT NULL AND length(text) > 0")
    names = [r["source"] for r in goals.select("source").limit(MOST_NAMED + 1).collect()]
    if len(names) <= MOST_NAMED:  # a filter at the scan spares counting what the join below would drop
        docs = docs.where(F.col("source").isin(names))
    # Tokens are counted and texts digested behind the scan; only (source, id, digest, tokens) is moved.
    digest = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    narrow = count_tokens(docs.withColumn("digest", digest), vocabulary=vocabulary, keep_text=False).join(goals.select("source"), "source", "left_semi")
    owner = narrow.groupBy("digest").agg(F.min(F.struct("source", "doc_id", "tokens")).alias("o")).select("o.*")
    # A doc_id may stand for several texts of a source; it is one unit, of its greatest length.
    sized = written(owner.groupBy("source", F.col("doc_id").alias("id")).agg(F.max("tokens").alias("tokens")))
    rates = expected_copies(sized, goals, total)
    used = systematic_copies(sized, rates, seed).select(F.col("id").alias("doc_id"), "source", "tokens", "copies")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most"))
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    none = F.lit(0).cast("bigint")
    report = (
        listed.join(rates.select("source", "texts", "available"), "source", "left").join(got, "source", "left")
        .select("source", "target_share", "max_repeats", F.coalesce("texts", none).alias("texts"), F.coalesce("available", none).alias("available"), F.coalesce("tokens", none).alias("tokens"), F.coalesce("most", none).alias("most_copies"))
        .withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(W.partitionBy()), F.lit(0)))
    )
    return used.where("copies > 0"), report


def _inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, root, "documents", "doc_id", "text", "source"), table(spark, root, "mix_targets", "source", "target_share", "max_repeats")


@query()
def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mixture: each used document with its tokens and copies."""
    return mix(*_inputs(spark, root))[0]


@query()
def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return mix(*_inputs(spark, root))[1]
