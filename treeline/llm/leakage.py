"""Evaluation items whose passages occur in corpus documents.

Each shard of documents gets an FM-index over the words it shares with the items; all 13-word phrases of
the items are searched in it backwards at once, the hits located, and overlapping spans merged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import query
from treeline.llm.fmindex import FMIndex
from treeline.sources.tables import spread, table

PHRASE = 13
SHARD_SYMBOLS = 1_000_000
BLOCK_CHARS = 20_000_000

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏ᅟᅠ឴឵ㅤﾠ]+")
_RUN = regex.compile(r"[\p{L}\p{Nd}]+")
_ASCII_RUN = regex.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits after NFC, lower-casing and dropping invisible characters; null: none."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_RUN.findall(text.lower())
    return _RUN.findall(_INVISIBLE.sub("", unicodedata.normalize("NFC", text).lower()))


class Phrases:
    """All distinct phrases of some items as rows of word numbers, with the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], length: int):
        self.length, self.number = length, {}
        grams: dict[tuple, set[int]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(len(ids) - length + 1):
                grams.setdefault(tuple(ids[i : i + length]), set()).add(item)
        self.matrix = np.array(list(grams), np.int64).reshape(len(grams), length)
        self.items = [np.array(sorted(x), np.int64) for x in grams.values()]


def _fragments(ids: np.ndarray, length: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of known words (number > 0) that can hold a phrase; very long ones cut with a phrase's overlap."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        while b - a >= length:
            end = min(b, a + longest)
            yield int(a), ids[a:end]
            if end == b:
                break
            a = end - length + 1


def _search_shard(frags: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, phrase, word position) of every occurrence in a shard's fragments."""
    sizes = np.array([len(f) + 1 for _, _, f in frags])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    text = np.zeros(int(sizes.sum()), np.int64)
    for s, (_, _, f) in zip(starts, frags, strict=True):
        text[s : s + len(f)] = f
    index = FMIndex(text, len(phrases.number) + 1)
    lo, hi = index.search(phrases.matrix)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = index.locate(rows)
    frag = np.searchsorted(starts, at, side="right") - 1
    docs = np.array([d for d, _, _ in frags], np.int64)[frag]
    offset = np.array([o for _, o, _ in frags], np.int64)[frag]
    return docs, which, offset + at - starts[frag]


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, read one after the other."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_spans(documents: DataFrame, items: DataFrame, length: int = PHRASE) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): merged spans of documents that repeat items.

    documents: doc_id, text; items: item_id, text. A span is a maximal run of words covered by phrases of
    ``length`` words of the item; words count from 0. Null or empty texts hold nothing; items shorter
    than a phrase can't leak; repeated rows give their spans once; empty tables: no rows.
    """
    spark, out = documents.sparkSession, None
    for block in _item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            phrases = Phrases(shared.value, length)
            frags, held = [], 0

            def found() -> pd.DataFrame:
                doc, which, at = _search_shard(frags, phrases)
                times = np.array([len(phrases.items[w]) for w in which], np.int64)
                item = np.concatenate([phrases.items[w] for w in which]) if len(which) else np.zeros(0, np.int64)
                hits = pd.DataFrame({"doc_id": np.repeat(doc, times), "item_id": item, "first_word": np.repeat(at, times)})
                hits = hits.drop_duplicates().sort_values(["doc_id", "item_id", "first_word"], ignore_index=True)
                same = (hits["doc_id"] == hits["doc_id"].shift()) & (hits["item_id"] == hits["item_id"].shift()) & (hits["first_word"] <= hits["first_word"].shift() + length)
                spans = hits.groupby((~same).cumsum()).agg(doc_id=("doc_id", "first"), item_id=("item_id", "first"), first_word=("first_word", "first"), last_word=("first_word", "last"))
                return spans.assign(last_word=spans["last_word"] + length - 1).astype("int64")

            if len(phrases.matrix):
                for b in batches:
                    for doc, text in zip(b["doc_id"], b["text"], strict=True):
                        ids = np.array([phrases.number.get(w, 0) for w in words(text)], np.int64)
                        for offset, f in _fragments(ids, length, SHARD_SYMBOLS):
                            frags.append((doc, offset, f))
                            held += len(f) + 1
                        if held >= SHARD_SYMBOLS:
                            yield found()
                            frags, held = [], 0
                if frags:
                    yield found()

        docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
        part = spread(docs).mapInPandas(search, "doc_id bigint, item_id bigint, first_word bigint, last_word bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, first_word bigint, last_word bigint")
    return out.distinct()


_WORDS_SQL = "regexp_extract_all(regexp_replace(lower(nfc_normalize(text)), '[\\p{Cf}︎️]', '', 'g'), '[\\p{L}\\p{Nd}]+')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} w FROM documents), e AS (SELECT item_id, {_WORDS_SQL} w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM d WHERE len(w) >= 13)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) i FROM e WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""")
def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least 13 consecutive words of an evaluation item, with the item."""
    return leaked_spans(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text")).select("doc_id", "item_id").distinct()


@query(f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} w FROM documents), e AS (SELECT item_id, {_WORDS_SQL} w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, i, array_to_string(w[i:i+12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM d WHERE len(w) >= 13)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) i FROM e WHERE len(w) >= 13)),
hit AS (SELECT DISTINCT doc_id, item_id, i - 1 AS f, i + 11 AS l FROM dg JOIN eg USING (g)), o AS (SELECT *, coalesce(max(l) OVER (PARTITION BY doc_id ORDER BY f, l, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 < f AS fresh FROM hit),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY f, l, item_id ROWS UNBOUNDED PRECEDING) run FROM o) SELECT doc_id, min(f) AS first_word, max(l) AS last_word, count(DISTINCT item_id) AS items FROM r GROUP BY doc_id, run""")
def p7_removals(spark: SparkSession, root: str) -> DataFrame:
    """Per document, the word spans to remove: its spans of all items, merged where they touch."""
    spans = leaked_spans(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text"))
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("first_word", "last_word", "item_id")
    reach = F.max("last_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = spans.withColumn("new", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("first_word")).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc_id", "run").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.count_distinct("item_id").alias("items")).drop("run")
