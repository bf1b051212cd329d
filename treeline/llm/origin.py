"""Files that nobody wrote by hand for their repository: generated, minified, vendored, or data.

Three kinds of evidence, each of which suffices:

* notices in the file's leading comment, found by one Aho-Corasick automaton over all phrases;
* rules on the path: vendored and build directories, lock files, suffixes of tools;
* the shape of the text: code packed into long lines, and array literals that are the whole file.

Code that merely deals with such things must not match: phrases count only in the comment that opens the
file, outside quotation marks, and directory rules match whole path components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import current_nodes, query, texts
from treeline.sources.tables import spread

# Phrases that notices use, by what they say. "+" joins phrases that must all occur.
GENERATED_NOTICES = [
    "do not edit", "do not modify", "don't edit", "do not change", "not modify by hand", "not edit by hand", "@generated", "auto-generated", "autogenerated", "auto generated",
    "automatically generated", "automatically created", "generated automatically", "generated code", "generated file", "generated by", "generated from", "generated with", "machine made", "machine generated",
    "machine-generated", "changes will be lost", "made here will be lost", "changes will be discarded", "changes will be overwritten", "will be overwritten", "instead of editing", "regenerate with",
    "produced by the+compiler", "created with+discarded", "created by+do not", "compiled from", "created automatically",
]
VENDORED_NOTICES = [
    "vendored from", "vendored copy of", "bundled copy of", "embedded copy of", "local copy of+upstream", "copied from", "copied verbatim", "third-party code", "third party code", "imported from+project", "imported from+revision", "taken from upstream", "upstream+report bugs",
    "contributors | mit", "contributors | bsd", "contributors | apache", "contributors | isc", "local changes: none", "synced from", "mirrored from", "forked from",
]
VENDORED_DIRS = ["vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages", "godeps", "extern", "external", "externals", "site-packages", "pods", "carthage"]
VERSIONED_DIRS = ["deps", "contrib", "lib", "libs", "packages", "ext"]
BUILD_DIRS = ["gen", "generated", "__generated__", "autogen", "build", "dist", "out", "target"]
TOOL_SUFFIXES = [
    r"\.min\.(js|mjs|cjs|css|html)", r"[.-]bundle\.m?js", r"\.chunk\.js", r"\.pb\.(go|cc|h|c|rs|swift|dart)", r"_pb2(_grpc)?\.pyi?", r"_(grpc_)?pb\.(m?[jt]s|rb)", r"[a-z0-9]grpc\.(java|kt|cs)", r"\.d\.pb\.ts", r"\.gen\.[a-z]+", r"\.generated\.[a-z]+",
    r"_generated\.[a-z]+", r"\.g\.(dart|cs|ts)", r"\.designer\.cs", r"_gen\.(go|rs)", r"_string\.go", r"\.map",
]
LOCK_NAMES = [r"[^/]*[-.]lock(file)?\.(json|ya?ml|toml)", r"[^/]*\.lock", r"go\.(sum|work\.sum)", r"npm-shrinkwrap\.json", r"packages\.lock\.json", r"gradle\.lockfile"]


def path_reason(path: Column) -> Column:
    """'vendored', 'generated', 'minified' or 'lockfile' by the path alone, else null. Null path: null."""
    p = F.lower(F.translate(path, "\\", "/"))
    dirs = lambda names: "(^|/)(" + "|".join(map(re.escape, names)) + ")/"
    return (
        F.when(p.rlike(dirs(VENDORED_DIRS)) | p.rlike(dirs(VERSIONED_DIRS) + r"[^/]*[a-z][^/]*-v?\d+(\.\d+)+/"), "vendored")
        .when(p.rlike("(^|/)(" + "|".join(LOCK_NAMES) + ")$"), "lockfile")
        .when(p.rlike(r"\.min\.[a-z]+$"), "minified")
        .when(p.rlike("(" + "|".join(TOOL_SUFFIXES) + ")$") | p.rlike(dirs(BUILD_DIRS)), "generated")
    )


_LEAD = re.compile(r"""\A﻿?(?:\#![^\n]*\n)?(?:\s*(?:
    //[^\n]*(?:\n|\Z) | /\*(?:[^*]|\*(?!/))*(?:\*/|\Z) | \#(?!\[|!\[|include\b|define\b|if|pragma\b)[^\n]*(?:\n|\Z) | <!--(?:[^-]|-(?!->))*(?:-->|\Z) | --[^\n]*(?:\n|\Z) | ;[^\n]*(?:\n|\Z) | %[^\n]*(?:\n|\Z) | <\?[^>]*\?>
    | [rRuU]?\"\"\"(?:[^"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|\Z) | ["']use\ strict["'];? | <!doctype[^>]*>
    ))*""", re.X | re.I)
_JSON_NOTE = re.compile(r'\A\s*\{\s*"(?:_+|\$|//)?(?:comment|notice|note|generated|generator|warning|readme|//)_*"\s*:\s*"((?:[^"\\\n]|\\.)*)"', re.I)
_QUOTED = re.compile(r"""(?<!\w)"[^"\n]*"|(?<!\w)'[^'\n]*'(?!\w)|“[^”\n]*”""")
_SPACES = re.compile(r"[\s*#/]+")


def opening(text: str) -> str:
    """The comment (or a JSON file's comment entry) that opens the text, quotations removed, lower case, on one line."""
    note = _JSON_NOTE.match(text)
    lead = note[1] if note else _LEAD.match(text)[0]
    return _SPACES.sub(" ", _QUOTED.sub(" ", lead.replace('"""', " "))).lower().strip() if lead else ""


def automaton():
    """Aho-Corasick over the parts of all notices: part -> [(notice, parts of that notice, kind)]."""
    import ahocorasick

    found: dict[str, list] = {}
    for kind, notices in (("generated", GENERATED_NOTICES), ("vendored", VENDORED_NOTICES)):
        for n in notices:
            for part in n.split("+"):
                found.setdefault(part, []).append((n, n.count("+") + 1, kind))
    a = ahocorasick.Automaton()
    for part, uses in found.items():
        a.add_word(part, (part, uses))
    a.make_automaton()
    return a


# Words before "generated by" and the like that speak of other things than the file: files, streams, objects ...
_OTHERS = re.compile(r"(?!\b(?:this|is|was|sources)\b)\b[a-z]+s $")


def notice_reason(lead: str, auto) -> str | None:
    """Kind of the first notice all of whose parts occur in an opening comment."""
    parts: dict[str, set] = {}
    for end, (part, uses) in auto.iter(lead):
        before, after = lead[end - len(part) : end - len(part) + 1], lead[end + 1 : end + 2]
        if (part[0].isalnum() and len(lead) > end - len(part) >= 0 and before.isalnum()) or (part[-1].isalnum() and after.isalnum()):
            continue
        if part.startswith("generated ") and _OTHERS.search(lead[: end - len(part) + 1]):
            continue
        for notice, need, kind in uses:
            have = parts.setdefault(notice, set())
            have.add(part)
            if len(have) == need:
                return kind
    return None


_NUMBER_OR_STRING = re.compile(r"""0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
DATA_SHARE, DATA_VALUES, DATA_LETTERS, LONG_LITERAL = 0.6, 24, 200, 60
PACKED_LINE, PACKED_SPACES = 200, 0.08


_ENDING = re.compile(r"[A-Za-z_-](\d+)\b")
_DIGITS = re.compile(r"\d+")
SERIES, TEMPLATES = 10, 8


def numbered(body: str) -> bool:
    """Whether a text is one template written out for 0, 1, 2, ...: few distinct lines once digits are dropped."""
    if len({_DIGITS.sub("", x) for x in map(str.strip, body.split("\n")) if x}) > TEMPLATES:
        return False
    return {str(i) for i in range(SERIES)} <= set(_ENDING.findall(body))


def shape_reason(ext: str, text: str) -> str | None:
    """'data' if array literals make up the file, 'minified' if code is packed into long lines, 'generated' if it is one template numbered through, else None.

    The comment that opens the file is left aside. Data: in a programming language, literals cover DATA_SHARE of the non-blank
    text, few names remain, and there are at least DATA_VALUES of them or DATA_LETTERS characters in them (a list or blob, not
    a constant). Minified: script or style whose lines average PACKED_LINE characters with under PACKED_SPACES white space.
    These are amounts of evidence; files of every size are judged by them alike.
    """
    body = text[_LEAD.match(text).end() :].strip()
    if not body:
        return None
    if ext in _SOURCE:
        solid = len(body) - body.count(" ") - body.count("\n") - body.count("\t")
        n = covered = 0
        for m in _NUMBER_OR_STRING.finditer(body):
            n += 1
            covered += m.end() - m.start() + 1
        long = covered >= DATA_LETTERS and covered / max(n, 1) > LONG_LITERAL
        if (n >= DATA_VALUES or long) and covered >= DATA_SHARE * solid and len(_WORD.findall(_NUMBER_OR_STRING.sub("", body))) <= max(20, n // 8):
            return "data"
    if ext in _PACKABLE and len(body) / (body.count("\n") + 1) >= PACKED_LINE:
        code = _NUMBER_OR_STRING.sub("0", body)
        if sum(code.count(c) for c in " \n\t") <= PACKED_SPACES * max(len(code), 1):
            return "minified"
    if (ext in _SOURCE or ext == ".css") and numbered(body):
        return "generated"
    return None


_SOURCE = {".py", ".pyw", ".js", ".mjs", ".cjs", ".ts", ".mts", ".rs", ".go", ".java", ".c", ".h", ".cc", ".cpp", ".cs", ".rb", ".php", ".kt", ".swift", ".scala"}
_PACKABLE = {".js", ".mjs", ".cjs", ".css", ".ts", ".html"}


def text_reasons(files: DataFrame) -> DataFrame:
    """(fk, path, content) -> (fk, text_reason) of the files whose text tells where it came from."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = automaton()
        for b in batches:
            keys, why = [], []
            for fk, path, text in zip(b["fk"], b["path"], b["content"], strict=True):
                dot = path.rfind(".")
                ext = path[dot:].lower() if dot > path.rfind("/") else ""
                lead = opening(text)
                reason = (notice_reason(lead, auto) if lead else None) or shape_reason(ext, text)
                if reason:
                    keys.append(fk)
                    why.append(reason)
            yield pd.DataFrame({"fk": keys, "text_reason": why}, dtype=object)

    return spread(files, "fk").mapInPandas(scan, "fk binary, text_reason string")


def foreign_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, reason) of the current files not written by hand for their repository.

    nodes: node_id, fk, path; files: fk, path, content. A node without text is no current file and gives no
    row; an empty text has only its path to tell. A node with several reasons gives one row, the path's
    reason first. Null paths or keys: no row. Empty tables: no rows. Repeated rows count once.
    """
    known = files.select("fk").distinct()
    by_path = nodes.withColumn("reason", path_reason(F.col("path")))
    texts_ = text_reasons(files).groupBy("fk").agg(F.min("text_reason").alias("text_reason"))
    hit = by_path.join(known, "fk", "left_semi").join(texts_, "fk", "left")
    return hit.select("node_id", F.coalesce("reason", "text_reason").alias("reason")).where("reason IS NOT NULL").groupBy("node_id").agg(F.min("reason").alias("reason"))


@query()
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Current files that are generated, minified, vendored or mere data."""
    return foreign_files(current_nodes(spark, root), texts(spark, root)).select("node_id")


@query()
def p6_reasons(spark: SparkSession, root: str) -> DataFrame:
    """How many current files of each language are not hand-written, by reason."""
    nodes = current_nodes(spark, root, "language")
    hits = foreign_files(nodes, texts(spark, root))
    return nodes.join(hits, "node_id").groupBy("language", "reason").agg(F.count_distinct("node_id").alias("files"))
