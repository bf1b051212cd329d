"""Facts taken out of texts line by line: declarations, imports, headings and links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T

# Declaration patterns of the fallback extractor, tried in order on a trimmed line: (kind, pattern with the name as group 1).
DECLARATIONS = [
    ("class", r"^(?:export\s+|public\s+|abstract\s+|final\s+|default\s+)*class\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"^(?:export\s+|public\s+)*(?:interface|trait|protocol)\s+([A-Za-z_$][\w$]*)"),
    ("enum", r"^(?:export\s+|public\s+|pub(?:\([a-z]+\))?\s+)*enum\s+([A-Za-z_$][\w$]*)"),
    ("struct", r"^(?:pub(?:\([a-z]+\))?\s+)?struct\s+([A-Za-z_]\w*)"),
    ("type", r"^(?:export\s+|pub\s+)*type\s+([A-Za-z_]\w*)"),
    ("function", r"^(?:pub(?:\([a-z]+\))?\s+|export\s+|default\s+|async\s+|const\s+|unsafe\s+)*(?:fn|function|func|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)"),
    ("module", r"^(?:pub\s+)?(?:mod|module|namespace|package)\s+([A-Za-z_][\w.]*)"),
]
# Patterns of texts without a parser, tried in order on a trimmed line: (kind, detail, pattern with the name as group 1).
FALLBACK = [
    ("function", "fallback-python-function", r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("class", "fallback-class", r"^class\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "fallback-powershell-function", r"^function\s+([A-Za-z_][A-Za-z0-9_]*(?:-[A-Za-z_][A-Za-z0-9_]*)+)\b"),
    ("function", "fallback-js-function", r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("value", "fallback-composition-binding", r"^(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:withDefaults\s*\(\s*)?(?:defineProps|defineEmits|defineModel|defineSlots|computed|ref|shallowRef|reactive|toRef|toRefs|watch)\b"),
    ("function", "fallback-rust-function", r"^(?:pub\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("type", "fallback-rust-type", r"^(?:pub\s+)?(?:struct|enum|trait)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "fallback-function", r"^(?:func|fun)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("method", "fallback-c-family-method", r"^(?:public|private|protected|internal|static|\s)+\s*[A-Za-z0-9_<>,\[\]?]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
]
IMPORT = r"^(?:import|from|use|require|include|#include|using)\b"


def declarations(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, kind, name): the first pattern each trimmed line matches."""
    rows = texts.select(*keys, F.posexplode(T.lines(F.col("content"))).alias("_i", "_l")).withColumn("_l", F.btrim("_l", F.lit(" \t")))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, rx in reversed(DECLARATIONS):
        hit = F.col("_l").rlike(rx)
        kind, name = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract("_l", rx, 1)).otherwise(name)
    return rows.select(*keys, (F.col("_i") + 1).alias("line_no"), kind.alias("kind"), name.alias("name")).where("kind IS NOT NULL")


def fallback_symbols(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, kind, detail, name) of the lines that a fallback pattern fits, by the first that does."""
    rows = texts.select(*keys, F.posexplode(T.lines(F.col("content"))).alias("_i", "_l")).withColumn("_l", F.btrim("_l", F.lit(" \t")))
    found = F.lit(None).cast("struct<kind:string,detail:string,name:string>")
    for kind, detail, rx in reversed(FALLBACK):
        found = F.when(F.col("_l").rlike(rx), F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), F.regexp_extract("_l", rx, 1).alias("name"))).otherwise(found)
    return rows.select(*keys, (F.col("_i") + 1).alias("line_no"), found.alias("f")).where("f IS NOT NULL").select(*keys, "line_no", "f.*")


def imports(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, text) of import-like lines."""
    rows = texts.select(*keys, F.posexplode(T.lines(F.col("content"))).alias("_i", "_l"))
    line = F.btrim("_l", F.lit(" \t"))
    return rows.where(line.rlike(IMPORT)).select(*keys, (F.col("_i") + 1).alias("line_no"), line.alias("text"))


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def _atx(text: str) -> list[tuple[int, int, str]]:
    out, fence = [], None
    for i, line in enumerate(text.split("\n"), 1):
        mark = _FENCE.match(line)
        if fence:
            # Only a run of the same mark, at least as long and with nothing after it, ends a block.
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
        elif mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
        elif "#" in line and (h := _ATX.match(line.rstrip("\r"))):
            out.append((i, len(h[1]), h[2]))
    return out


def headings(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, level, title, slug) of ATX headings outside fenced code. Null and empty texts have none.

    Whether a line is code depends on all before it; one pass per text, in Arrow batches behind the scan, tells.
    """

    @F.pandas_udf("array<struct<line_no:int,level:int,title:string>>")
    def found(content: pd.Series) -> pd.Series:
        return content.map(lambda t: _atx(t) if t else [])

    rows = texts.where(F.col("content").contains("#")).select(*keys, F.explode(found("content")).alias("h"))
    return rows.select(*keys, "h.line_no", "h.level", "h.title", T.slug(F.col("h.title")).alias("slug"))


def links(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, target) of inline links, repeated ones once."""
    rx = r"\[([^\[\]]*)\]\(([^()\s]+)\)"
    both = F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(rx), F.lit(1)).alias("label"), F.regexp_extract_all("content", F.lit(rx), F.lit(2)).alias("target"))).alias("l")
    return texts.select(*keys, both).select(*keys, "l.*").distinct()


def link_targets(found: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """Adds ``file`` and ``fragment``, and ``reason`` where a link names no file here: external, outside_root or no_static_target."""
    t = F.col(target)
    fragment = F.regexp_extract(t, r"#(.*)$", 1)
    bare = F.regexp_replace(t, r"[?#].*$", "")
    external = t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//")
    own = F.when(bare == "", F.col(path)).otherwise(P.resolve_relative(P.parent(F.col(path)), bare))
    reason = F.when(external, "external").when(t.contains("${") | t.contains("{{"), "no_static_target").when(own.isNull(), "outside_root")
    return found.withColumn("file", F.when(~external, own)).withColumn("fragment", fragment).withColumn("reason", reason)
