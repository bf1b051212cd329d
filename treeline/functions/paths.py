"""Repository paths as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """Relative path with forward slashes, without ``./`` and a closing slash; the root is '.'."""
    p = F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+|/+$", "")
    return F.when(p == "", ".").otherwise(p)


def valid_key(c: Column) -> Column:
    """Whether a path may name a node: relative, no drive, no '..' component. Null gives null."""
    return ~(c.startswith("/") | c.rlike(r"^[A-Za-z]:") | c.rlike(r"(^|/)\.\.(/|$)")) & (c != "")


def parent(c: Column) -> Column:
    """Parent path, '.' at the top, null for the root."""
    return F.when(c == ".", None).when(c.contains("/"), F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise(".")


def extension(c: Column) -> Column:
    """Lower-case extension with its dot, empty without one; a leading dot alone makes no extension."""
    return F.lower(F.regexp_extract(c, r"(?:^|/)[^/]+(\.[^./]+)$", 1))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def ancestors(c: Column) -> Column:
    """The path, each parent, and '.', nearest first."""
    parts = F.split(c, "/")
    inner = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(c == ".", F.array(F.lit("."))).otherwise(F.concat(inner, F.array(F.lit("."))))


def inside(c: Column, folder: str | None) -> Column:
    """Whether a path is a folder or lies under it; '.', '' and None hold everything."""
    if folder in (None, "", "."):
        return F.lit(True)
    return (c == folder) | c.startswith(folder + "/")


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob in which * and ? never cross a slash and ** does.

    A pattern without a slash matches at any depth.
    """
    p = pattern.replace("\\", "/")
    if "/" not in p:
        p = "**/" + p
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        elif p[i] == "{" and "}" in p[i + 1 :]:
            j = p.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, p[i + 1 : j].split(","))) + ")", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{out}$"


def static_prefix(pattern: str | None) -> str | None:
    """Longest directory prefix before the first wildcard, the whole path without one, None if nothing is fixed."""
    if not pattern or "/" not in pattern.replace("\\", "/"):
        return None
    p = pattern.replace("\\", "/")
    cut = min((p.index(c) for c in "*?[{" if c in p), default=len(p))
    if cut == len(p):
        return p
    return p[:cut].rpartition("/")[0] or None


def matches_glob(c: Column, pattern: str | None) -> Column:
    """Glob filter; its fixed prefix is stated apart, so that it reaches the scan. Empty and '*' hold everything."""
    if not pattern or pattern == "*":
        return F.lit(True)
    prefix, hit = static_prefix(pattern), c.rlike(glob_regex(pattern))
    return c.startswith(prefix) & hit if prefix else hit


def test_path_for_ranking(c: Column) -> Column:
    return c.startswith("tests/") | c.contains("/tests/") | c.contains("_test.") | c.contains(".test.")


def test_path_in_graph(c: Column) -> Column:
    """A test segment, a .test. or .spec. file, or a stem that ends in _test or begins with test_."""
    base = basename(c)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return c.rlike(r"(^|/)(test|tests|__tests__)/") | base.contains(".test.") | base.contains(".spec.") | stem.endswith("_test") | stem.startswith("test_")


def excluded(c: Column, names: list[str], suffixes: list[str] = (), prefixes: list[str] = (), allowed: list[str] = ()) -> Column:
    """Whether a scan leaves a path out: an excluded component or component suffix, or an excluded prefix; allowed paths win."""
    parts = F.split(c, "/")
    hit = F.exists(parts, lambda x: x.isin(list(names)))
    for s in suffixes:
        hit = hit | F.exists(parts, lambda x, s=s: x.endswith(s))
    for p in prefixes:
        hit = hit | inside(c, p)
    return hit & ~c.isin(list(allowed)) if allowed else hit


def resolve_relative(folder: Column, target: Column) -> Column:
    """``target`` seen from ``folder``, '.' and '..' resolved; null for absolute paths, addresses and escapes from the root."""
    whole = F.concat_ws("/", F.when(folder != ".", folder), target)
    # Fold the components into a stack; leaving the root poisons it.
    stack = F.aggregate(
        F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.array_contains(acc, "\0"), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) == 0, F.array(F.lit("\0"))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    outside = target.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)") | target.contains("${") | F.array_contains(stack, "\0")
    return F.when(~outside, F.array_join(stack, "/"))


def source_stems(c: Column) -> Column:
    """Stem of a source path and, for a package's entry file, its folder."""
    stem = F.regexp_replace(c, r"\.[^./]*$", "")
    entry = basename(stem).isin("index", "mod", "__init__", "lib", "main")
    return F.when(entry & stem.contains("/"), F.array(stem, F.regexp_replace(stem, r"/[^/]*$", ""))).otherwise(F.array(stem))


def module_alias(c: Column, joiner: str) -> Column:
    """Module name of a source path: extension and src/ removed, entry files dropped, parts joined."""
    stem = F.regexp_replace(F.regexp_replace(c, r"\.[^./]*$", ""), r"^src/", "")
    core = F.regexp_replace(stem, r"(^|/)(lib|main|mod|index|__init__)$", "")
    return F.replace(core, F.lit("/"), F.lit(joiner))
