"""A source tree as tables: files and folders with sizes, times and hashes, and the texts among them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T

MAX_TEXT_BYTES = 8 * 1024 * 1024


def ignore_rules(lines: list[str]) -> list[tuple[bool, bool, str]]:
    """Rules of an ignore file, in order: (excludes, folders only, regular expression over paths from its folder)."""
    out = []
    for line in lines:
        rule = line.rstrip("\n\r")
        if not rule.strip() or rule.startswith("#"):
            continue
        rule = rule.rstrip() if not rule.endswith("\\ ") else rule
        negated = rule.startswith("!")
        rule = rule[1:] if negated else rule.removeprefix("\\")
        folder_only, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        rx = "^" + P.glob_regex("/" + rule.lstrip("/"))[2:] if anchored else P.glob_regex("**/" + rule)
        out.append((not negated, folder_only, rx))
    return out


def ignored(c: Column, rules: list[tuple[bool, bool, str]], folder: Column | None = None) -> Column:
    """Whether an ignore file leaves a path out.

    The path and each folder above it are asked in turn, the last rule that matches one decides about it. What lies below
    an excluded folder stays excluded, whatever re-includes it by name. ``folder`` tells whether the path itself is one
    (none is, if not given).
    """
    own = F.lit(False) if folder is None else folder

    def verdict(p: Column, is_folder: Column) -> Column:
        out = F.lit(False)
        for excludes, folder_only, rx in rules:
            hit = p.rlike(rx) & is_folder if folder_only else p.rlike(rx)
            out = F.when(hit, F.lit(excludes)).otherwise(out)
        return out

    above = F.filter(P.ancestors(c), lambda p: (p != c) & (p != "."))
    return verdict(c, own) | F.exists(above, lambda p: verdict(p, F.lit(True)))


def scan_tree(spark: SparkSession, root: str, exclude: list[str] = (), rules: list[tuple[bool, bool, str]] = ()) -> DataFrame:
    """(path, parent_path, kind, extension, size_bytes, mtime_ns, content_hash): files under ``root`` and the folders that hold them.

    Read by Spark's binary source in parallel; excluded paths are dropped before their bytes are hashed. Folders
    without files are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:").lstrip("/"))
    files = files.withColumn("path", F.regexp_replace("path", f"^[a-z]*:?/*{base}/", ""))
    keep = files.where(~P.excluded(F.col("path"), list(exclude))).where(~ignored(F.col("path"), list(rules)))
    mtime = F.unix_micros("modificationTime") * 1000
    none = lambda t: F.lit(None).cast(t)
    f = keep.select("path", P.parent(F.col("path")).alias("parent_path"), F.lit("file").alias("kind"), P.extension(F.col("path")).alias("extension"), F.col("length").alias("size_bytes"), mtime.alias("mtime_ns"), F.sha2("content", 256).alias("content_hash"))
    up = keep.select(F.explode(P.ancestors(P.parent(F.col("path")))).alias("path")).distinct()
    folders = up.select("path", P.parent(F.col("path")).alias("parent_path"), F.lit("folder").alias("kind"), none("string").alias("extension"), none("bigint").alias("size_bytes"), none("bigint").alias("mtime_ns"), none("string").alias("content_hash"))
    return f.unionByName(folders)


def read_texts(spark: SparkSession, root: str, limit: int = MAX_TEXT_BYTES) -> DataFrame:
    """(path, outcome, content, byte_count, line_count): outcome is indexed, too_large or binary_or_non_utf8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:").lstrip("/"))
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    small = F.col("length") <= limit
    t = files.select(F.regexp_replace("path", f"^[a-z]*:?/*{base}/", "").alias("path"), "length", F.when(small, text).alias("content"))
    bad = F.col("content").isNull() | F.col("content").contains("\0")
    outcome = F.when(F.col("length") > limit, "too_large").when(bad, "binary_or_non_utf8").otherwise("indexed")
    kept = F.when(outcome == "indexed", F.col("content"))
    return t.select("path", outcome.alias("outcome"), kept.alias("content"), F.col("length").alias("byte_count"), T.line_count(kept).alias("line_count"))


def git_paths(raw: Column, status: bool) -> Column:
    """Sorted distinct paths of NUL-separated output, three status characters cut where they are given."""
    parts = F.filter(F.split(raw, "\0"), lambda x: x != "")
    cut = F.transform(parts, lambda x: F.substring(x, 4, 1 << 20)) if status else parts
    return F.array_sort(F.array_distinct(F.transform(cut, lambda x: F.translate(x, "\\", "/"))))


def watch(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of files as they appear under ``root``: (path, mtime_ns, size_bytes, content_hash). Changes in place are found by ``exchange.poll``."""
    fields = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(fields).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:").lstrip("/"))
    path = F.regexp_replace("path", f"^[a-z]*:?/*{base}/", "")
    return files.select(path.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))


def read_artifacts(spark: SparkSession, folder: str, schema: str, limit: int = MAX_TEXT_BYTES) -> DataFrame:
    """JSON documents of a folder, one row each: path, outcome (read, too_large or not_json) and their fields."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    body = F.from_json(F.when(F.col("length") <= limit, F.col("content").cast("string")), schema)
    bad = body.isNull() | F.forall(F.array(*(body[f].isNull() for f in (x.split()[0] for x in schema.split(", ")))), lambda x: x)
    outcome = F.when(F.col("length") > limit, "too_large").when(bad, "not_json").otherwise("read")
    return files.select("path", outcome.alias("outcome"), body.alias("b")).select("path", "outcome", "b.*")


def stage(spark: SparkSession, root: str, exclude: list[str] = (), rules: list[tuple[bool, bool, str]] = ()) -> dict[str, DataFrame]:
    """Tables of a full publication of a source tree: nodes with language and class, texts, symbols, relations, imports and summaries.

    ``Generations.publish`` writes them as one version. Texts are read once by each table that needs them, behind its own scan.
    """
    from treeline.functions.languages import content_class, detect_language
    from treeline.operators import symbols as S

    scanned = scan_tree(spark, root, exclude, rules)
    texts = read_texts(spark, root).join(scanned.where("kind = 'file'").select("path"), "path", "left_semi")
    language, reason = detect_language(F.col("path"))
    is_text = F.col("outcome") == "indexed"
    nodes = scanned.join(texts.select("path", "outcome"), "path", "left").withColumn("language", F.when(F.col("kind") == "file", language)).withColumn("detected_by", F.when(F.col("kind") == "file", reason))
    nodes = nodes.withColumn("content_class", F.when(F.col("kind") == "file", content_class(F.col("language"), F.coalesce(is_text, F.lit(False)))))
    kept = texts.where("outcome = 'indexed'").select("path", "content")
    graphs = S.symbol_graphs(kept, ["path"])
    rows = lambda name: graphs.select("path", F.explode(name).alias("x")).select("path", "x.*")
    return {"nodes": nodes, "texts": texts, "symbols": rows("symbols"), "relations": rows("relations"), "imports": rows("imports"), "summaries": S.describe(kept, ["path"])}


def map_lines(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(path, line): each node as one line of JSON, in the order of the columns; null fields are left out."""
    return nodes.select("path", F.to_json(F.struct("path", *(c for c in columns if c != "path"))).alias("line"))
