"""Source files that are not valid in the language their extension stands for.

A text becomes token classes. Pairs of neighbours that no text of the grammar has are found by an
anti-join with the pairs derived from the grammar; brackets that do not match by windows over bracket rows; productions by
reducing the windows between brackets from the inside out. A production that fails in Python, JSON or TOML must also be refused by
the reference parser of the standard library.
"""

from __future__ import annotations

import ast
import json
import sys
import tomllib
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.llm.common import current_nodes, extension, query, texts
from treeline.llm.lexers import BAD, EXTENSIONS, grammar, tokens
from treeline.sources.tables import spread, written

SHIFT = 12  # a pair is one number: left << SHIFT | right
PIECE = 500  # files a worker hands on at once
LANGUAGES = sorted(set(EXTENSIONS.values()))


def _refuse(name: str):
    raise ValueError(name)


def _strictly_valid(language: str, text: str) -> bool:
    """Whether the standard library's own parser accepts the text; False where there is none."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "file", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
        elif language == "json":
            json.loads(text, parse_constant=_refuse)
        elif language == "toml":
            tomllib.loads(text)
        else:
            return False
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


# Brackets that nest in every language that has them: opening and closing token.
BRACKETS = [("(", ")"), ("[", "]"), ("{", "}"), ("${", "}$"), ("INDENT", "DEDENT")]
_CODES: dict[str, dict[int, int]] = {}


def bracket_codes(language: str) -> dict[int, int]:
    """Token class -> 2 * kind of bracket, + 1 for the closing one."""
    if language not in _CODES:
        ids = grammar(language).ids
        _CODES[language] = {ids[t]: 2 * k + side for k, pair in enumerate(BRACKETS) for side, t in enumerate(pair) if t in ids}
    return _CODES[language]


def read(language: str, text: str) -> tuple[str | None, list[int], list[int]]:
    """Reason (see ``judge``), distinct pairs of neighbours, and the brackets in their order, of one text."""
    g = grammar(language)
    seq = tokens(language, text)
    if seq and seq[-1] == BAD:
        reason, pairs, brackets = "lexical", [], []
    else:
        reason = g.check(seq)
        ids = g.ids
        # Token trees of macros hold anything; neighbours in them say nothing.
        trees = "macro_rules" in ids and ids["!"] in seq
        pairs = [] if trees else [a << SHIFT | b for a, b in set(zip((t & 0xFFF for t in seq), seq[1:], strict=False)) if b <= 0xFFF]
        code = bracket_codes(language).get
        brackets = [k for t in seq if (k := code(t & 0xFFF)) is not None]
    if reason and _strictly_valid(language, text):
        reason = None
    return reason, pairs, brackets


def judge(language: str, text: str) -> tuple[str | None, list[int]]:
    """What a text's tokens say: the reason nesting or productions fail (lexical, nesting, production) or None, and its distinct pairs of neighbours.

    Whether the pairs are permissible is left to the join, and nesting, for tables, to the windows. Where there is a reference parser, a reason it does not share is dropped.
    """
    return read(language, text)[:2]


_PERMISSIBLE: dict[str, frozenset[int]] = {}


def permissible(language: str) -> frozenset[int]:
    """All pairs some text of the language has, from its grammar."""
    if language not in _PERMISSIBLE:
        _PERMISSIBLE[language] = frozenset(a << SHIFT | b for a, b in grammar(language).pairs() if a > 0)
    return _PERMISSIBLE[language]


def pair_table(spark: SparkSession) -> DataFrame:
    """(language, check, value): the permissible pairs of all grammars; their number is fixed by the grammars."""
    return spark.createDataFrame(pd.DataFrame([(x, "pair", p) for x in LANGUAGES for p in sorted(permissible(x))], columns=["language", "check", "value"]), "language string, check string, value int")


_LEXED = "fk binary, language string, reason string, pairs array<int>, brackets array<tinyint>"


def lexed(files: DataFrame) -> DataFrame:
    """(fk, path, content) -> (fk, language, reason, pairs, brackets): one row per text of a language that is judged.

    Productions are checked by reducing the windows between brackets from the inside out, in the Arrow batch that lexed the text.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(10_000)
        columns = ["fk", "language", "reason", "pairs", "brackets"]
        for b in batches:
            rows = []
            for fk, path, text in zip(b["fk"], b["path"], b["content"], strict=True):
                language = EXTENSIONS.get(path[path.rfind(".") :].lower())
                if language:
                    reason, pairs, brackets = read(language, text)
                    rows.append((fk, language, reason, np.array(pairs, np.int32), np.array(brackets, np.int8)))
                if len(rows) >= PIECE:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows = []
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spread(files.where(extension().isin(list(EXTENSIONS))), "fk").mapInPandas(scan, _LEXED)


def nesting_faults(brackets: DataFrame) -> DataFrame:
    """(fk, language) of the texts whose brackets do not match. brackets: fk, language, brackets.

    The depth at a bracket is a running sum; it must not fall below zero and must end there. Brackets of one depth alternate, so a closing
    one's partner is the one before it at its depth, and must be of its kind. Equal texts give equal faults, so rows of one key count once.
    """
    code = F.col("code").cast("int")
    opens = code % 2 == 0
    rows = brackets.dropDuplicates(["fk"]).select("fk", "language", F.posexplode("brackets").alias("i", "code"))
    w = W.partitionBy("fk").orderBy("i")
    rows = rows.withColumn("d", F.sum(F.when(opens, 1).otherwise(-1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("before", F.lag(code).over(W.partitionBy("fk", F.when(opens, F.col("d")).otherwise(F.col("d") + 1)).orderBy("i")))
    wrong = (F.col("d") < 0) | (~opens & ~F.col("before").eqNullSafe(code - 1))
    per = rows.groupBy("fk", "language").agg(F.bool_or(wrong).alias("wrong"), F.sum(F.when(opens, 1).otherwise(-1)).alias("left"))
    return per.where("wrong OR left <> 0").select("fk", "language")


def token_facts(read_: DataFrame) -> DataFrame:
    """Rows of ``lexed`` as (fk, language, check, value).

    check 'pair': a pair of neighbouring tokens that occurs in the text; 'lexical' or 'production': this check failed, value null.
    """
    fact = lambda check, value: F.struct(check.alias("check"), value.alias("value"))
    failed = F.when(F.col("reason") != "nesting", F.array(fact(F.col("reason"), F.lit(None).cast("int")))).otherwise(F.array())
    return read_.select("fk", "language", F.explode(F.concat(F.transform("pairs", lambda p: fact(F.lit("pair"), p)), failed)).alias("f")).select("fk", "language", "f.*")


def invalid_texts(files: DataFrame) -> DataFrame:
    """(fk, path, content) -> (fk, language, reason) of the texts that are invalid, reasons: lexical, nesting, production, pair.

    All facts but permissible pairs tell against a file; the anti-join leaves them. Nesting is told by windows over the brackets. Files of
    other languages are left out. An empty text is invalid only where the language demands something (JSON, Go). Null texts give no row;
    very long texts are read whole; repeated rows give repeated rows.
    """
    # Lexing is most of the work: its compact rows are written once and read for each check.
    read_ = written(lexed(files))
    bad = token_facts(read_).join(F.broadcast(pair_table(files.sparkSession)), ["language", "check", "value"], "left_anti")
    bad = bad.select("fk", "language", F.col("check").alias("reason")).distinct()
    return bad.unionByName(nesting_faults(read_).withColumn("reason", F.lit("nesting")))


@query()
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Current files that are not valid in the language of their extension."""
    return current_nodes(spark, root).join(invalid_texts(texts(spark, root)).select("fk").distinct(), "fk", "left_semi").select("node_id").distinct()


@query()
def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    """Per repository and language (by extension): files, invalid files and their share."""
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    nodes = current_nodes(spark, root, "project_instance_id").withColumn("language", known[extension()]).where("language IS NOT NULL")
    nodes = nodes.join(texts(spark, root).select("fk").distinct(), "fk", "left_semi")
    bad = invalid_texts(texts(spark, root)).groupBy("fk").agg(F.lit(1).alias("bad"))
    per = nodes.join(bad, "fk", "left").groupBy(F.lower("project_instance_id").alias("project_instance_id"), "language")
    return per.agg(F.count_distinct("node_id").alias("files"), F.count_distinct(F.when(F.col("bad") == 1, F.col("node_id"))).alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
