"""Moving an index between places: exports with digests that imports verify, SQLite tables, row listings, and changed paths of a git work tree."""

from __future__ import annotations

import json
import re
import sqlite3
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import framed
from treeline.operators.changes import set_digest

FORMAT = 1
MAX_GIT_BYTES, GIT_SECONDS = 16 * 1024 * 1024, 30


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order; columns count by name, letter case and null included."""
    whole = framed(*(F.col(c).cast("string") for c in sorted(df.columns)))
    return df.select(whole.alias("_w")).agg(set_digest(F.col("_w")).alias("d")).first()["d"]


def export_tables(tables: dict[str, DataFrame], folder: str, source_state: str) -> dict:
    """Write tables below ``folder`` with a manifest of their schemas, row counts and digests; the manifest comes last, so a broken export has none."""
    spark = next(iter(tables.values())).sparkSession
    entries = {}
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        stored = spark.read.parquet(f"{folder}/{name}")
        entries[name] = {"schema": json.loads(stored.schema.json()), "rows": stored.count(), "digest": table_digest(stored)}
    body = {"format": FORMAT, "source_state": source_state, "tables": entries}
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return body


def import_tables(spark: SparkSession, folder: str, source_state: str | None = None) -> dict[str, DataFrame]:
    """Tables of an export, after their schemas, rows and digests were found as the manifest says; refuses other formats and states."""
    from pyspark.sql.types import StructType

    body = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    if body.get("format") != FORMAT:
        raise ValueError("export of another format")
    if source_state is not None and body["source_state"] != source_state:
        raise ValueError("export of another source state")
    out = {}
    for name, entry in body["tables"].items():
        df = spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{folder}/{name}")
        if df.count() != entry["rows"] or table_digest(df) != entry["digest"]:
            raise ValueError(f"table {name} is not what was exported")
        out[name] = df
    return out


def hydrate(spark: SparkSession, folder: str, root: str, source_state: str) -> int:
    """Make an export the next generation of a work tree's index, if it was made from the same source state; its number."""
    from treeline.operators.changes import Generations

    return Generations(spark, root).publish(import_tables(spark, folder, source_state))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 8) -> DataFrame:
    """Rows of a SQLite table, read in ranges of rowid by as many tasks; the file must be in reach of all of them.

    schema: names and types of the columns wanted. An empty table gives no rows.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", table):
        raise ValueError("not a table name")
    names = [x.split()[0] for x in schema.split(",")]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = max(1, -(-(high - low + 1) // partitions))
    ranges = spark.createDataFrame([(a, a + step) for a in range(low, high + 1, step)], "lo bigint, hi bigint").repartition(partitions)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            for b in batches:
                for lo, hi in zip(b["lo"], b["hi"], strict=True):
                    cursor = con.execute(f"SELECT {', '.join(names)} FROM {table} WHERE rowid >= ? AND rowid < ?", (int(lo), int(hi)))
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names, dtype=object)

    return ranges.mapInPandas(scan, schema)


_HEAD = re.compile(r"^\s*[\w-]+\[(\d+)\]\{([^}]*)\}:\s*$")


def read_listing(lines: list[str], required: list[str]) -> tuple[list[dict[str, str]], list[str]]:
    """Rows of a listing ``name[count]{a,b}:`` with one comma-separated row a line, and what is wrong with it.

    Fields may stand in double quotes. Missing columns, rows of another length, and a count that is not met are reported; such rows are left out.
    """
    rows, wrong, names, want = [], [], None, 0
    for i, line in enumerate(lines, 1):
        head = _HEAD.match(line)
        if head:
            names, want = [x.strip() for x in head[2].split(",")], want + int(head[1])
            wrong += [f"line {i}: no column {x}" for x in required if x not in names]
        elif line.strip():
            parts = [x[1:-1].replace('\\"', '"') if x.startswith('"') else x for x in (y.strip() for y in re.findall(r'"(?:[^"\\]|\\.)*"|[^,]+|(?<=,)(?=,)', line.strip()))]
            if names is None or len(parts) != len(names):
                wrong.append(f"line {i}: not a row")
            else:
                rows.append(dict(zip(names, parts, strict=True)))
    if len(rows) != want:
        wrong.append(f"{want} rows announced, {len(rows)} read")
    return rows, wrong


def write_listing(name: str, rows: list[dict[str, str]], columns: list[str]) -> list[str]:
    """The lines that ``read_listing`` reads; fields with commas, quotes or blanks at their ends are quoted."""
    quote = lambda v: '"' + v.replace('"', '\\"') + '"' if not v or re.search(r'[,"]|^\s|\s$', v) else v
    return [f"{name}[{len(rows)}]{{{','.join(columns)}}}:", *("  " + ",".join(quote(str(r[c])) for c in columns) for r in rows)]


def changed_paths(repository: str, base: str | None = None, head: str | None = None) -> list[str] | None:
    """Paths that differ in the work tree, or between two revisions; null if git can't tell (no repository, bad revision, too slow, too much).

    No shell is used; revisions that could be options or ranges are refused.
    """
    for r in (base, head):
        if r is not None and (not re.fullmatch(r"[A-Za-z0-9_./^~][A-Za-z0-9_./^~-]{0,255}", r) or ".." in r):
            return None
    args = ["diff", "--name-only", "-z", base, head or "HEAD", "--"] if base else ["status", "--porcelain=v1", "-z", "--no-renames"]
    try:
        out = subprocess.run(["git", "-C", repository, *args], capture_output=True, timeout=GIT_SECONDS, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    if len(out) > MAX_GIT_BYTES:
        return None
    parts = [x for x in out.decode("utf-8", "replace").split("\0") if x]
    return sorted({x if base else x[3:] for x in parts})


def poll(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action) between two scans (path, content_hash, ...): what a watcher would have reported, without events of its own."""
    from treeline.operators.changes import delta

    return delta(previous, current, ["path"], ["kind", "size_bytes", "content_hash"]).withColumnRenamed("change", "action")
