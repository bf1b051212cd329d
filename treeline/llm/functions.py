"""Functions and methods with the documentation that stands with them, as code-description pairs."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.automata import BREAK
from treeline.llm.common import current_nodes, extension, query, texts
from treeline.llm.lexers import EXTENSIONS, grammar, traced
from treeline.sources.tables import spread, written, written_counting

LANGUAGES = {"python", "javascript", "typescript", "rust", "go", "java"}
MIN_WORDS, MIN_NEW_WORDS = 5, 3
MERGE = 16  # rounds of the walk up the classes whose findings are brought into one table

# Words that head parameter and similar sections in documentation comments.
SECTIONS = (
    "args arguments parameters params parameter returns return raises yields yield attributes keyword keyword-args throws exceptions warns inputs outputs examples example "
    "other-parameters see-also references panics errors"
).split()
# Openings of to-do notes, and of directives to tools.
NOTES = re.compile(r"\W*(?:todo|fixme|xxx|hack|tbd|wip|placeholder|bug)\b", re.I)
DIRECTIVES = re.compile(
    r"\W*(?:eslint|tslint|jshint|jslint|prettier|pylint|pyright|mypy|flake8|noqa|nolint|nosec|nosonar|noinspection|type:\s*ignore|pragma|istanbul|c8 ignore|v8 ignore|ts-(?:ignore|expect-error|nocheck)|@ts-|go:\w+|\+build|"
    r"clippy|rustfmt|safety:?\s*$|checkstyle|spotless|isort|fmt:|yapf|ruff|black|biome|deno-lint|coverage|webpack\w*:|cspell|spell-?checker|#?(?:end)?region|vim:|-\*-|lint\b)",
    re.I,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SPLIT = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")
_CODE_LINE = re.compile(
    r"(?:[()\[\]{}=<>].*[;{}]\s*$|^\s*[\w.]*\s*[;{}]\s*$|^\s*(?:/\*|\"\"\"|'''|\*/)|^\s*(?:def|class|fn|func|function|async|public|private|protected|static|export|const|let|var|import|from|package|use|pub|impl|struct|type)\b.*[({:=;]\s*.*$(?<=[){:;,\"'])"
    r"|^\s*(?:if|for|while|switch|elif|with)\s*[(\w].*[:{)]\s*$|^\s*(?:return|raise|throw|await|yield|del|assert)\b.*[()\[\];=+*/]|^\s*[\w.]+\s*(?:[-+*/:]?=)\s*\S|^\s*[\w.]+\([^)]*\)\s*;?\s*$|^\s*@\w+(?:\([^)]*\))?\s*$)"
)
_TAG = re.compile(r"^\s*(?:@\w+|:\w+[^:]*:|\\(?:param|return|throws|brief)\b|\{@\w+[^}]*\}\s*$)")
_SECTION = re.compile(r"^\s*(?:#+\s*)?(" + "|".join(x.replace("-", r"[ _-]") for x in SECTIONS) + r")\s*:?\s*$", re.I)


def prose(lines: list[str], name: str) -> list[str]:
    """Words of prose in documentation lines (comment marks removed)."""
    out: list[str] = []
    section: int | None = None
    tag = todo = code = False
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            tag = todo = False
            continue
        indent = len(line) - len(line.lstrip())
        if section is not None:
            if indent > section or set(bare) <= set("-=~"):
                continue
            section = None
        if _SECTION.match(line) and (i + 1 < len(lines) or bare.endswith(":")):
            section = indent if not bare.startswith("#") else 0
            if bare.startswith("#") or (i + 1 < len(lines) and set(lines[i + 1].strip()) <= set("-=~") and lines[i + 1].strip()):
                section = indent - 1
            continue
        if bare.startswith("```") or bare.startswith("~~~"):
            code = not code
            continue
        if code:
            continue
        if _TAG.match(line):
            tag = True
            continue
        if tag and indent > 0 and lines[i - 1].strip() and indent > len(lines[i - 1]) - len(lines[i - 1].lstrip()):
            continue
        if NOTES.match(bare):
            todo = True
        if todo or DIRECTIVES.match(bare):
            continue
        tag = False
        if _CODE_LINE.search(line):
            if re.match(r"\s*(?:/\*|\"\"\"|'''|(?:async\s+)?(?:def|class|fn|func|function)\b|(?:public|private|protected|pub|export)\b)", line):
                break  # what follows belongs to the code that was disabled
            continue
        out += _WORD.findall(bare)
    return out


def documented(lines: list[str], name: str) -> bool:
    """Whether enough prose remains, and enough of it says more than the name."""
    words = prose(lines, name)
    own = {x.lower() for x in _SPLIT.findall(name)}
    return len(words) >= MIN_WORDS and sum(w.lower() not in own for w in words) >= MIN_NEW_WORDS


@dataclass
class Function:
    name: str
    kind: str
    line: int
    signature: str
    doc: list[str]
    owner: str = ""
    parents: list[str] = field(default_factory=list)

    @property
    def inherits(self) -> bool:
        """The comment asks for its parent's documentation, or there is no comment at all."""
        return not any(x.strip() for x in self.doc) or any(re.search(r"\{?@inherit_?doc\}?", x, re.I) for x in self.doc)


class Source:
    """One file's tokens, brackets, lines and comments."""

    def __init__(self, language: str, text: str):
        self.text, self.language = text, language
        seq, trace = traced(language, text)
        g = grammar(language)
        names = {v: k for k, v in g.ids.items()}
        self.tok = [names[t & (BREAK - 1)] for t in seq]
        self.at = trace.at
        self.starts = [0, *(m.end() for m in re.finditer(r"\n", text))]
        self.match: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        pair = {")": "(", "]": "[", "}": "{", "DEDENT": "INDENT", "}$": "${"}
        still = dict.fromkeys(pair.values(), 0)  # open brackets by kind
        for i, t in enumerate(self.tok):
            if t in still:
                stack.append((t, i))
                still[t] += 1
            elif t in pair and still[pair[t]]:
                while stack[-1][0] != pair[t]:
                    still[stack.pop()[0]] -= 1
                j = stack.pop()[1]
                still[pair[t]] -= 1
                self.match[j], self.match[i] = i, j
        # Comment-only lines: line -> (first offset, end offset) of the comment.
        self.comment_lines: dict[int, tuple[int, int]] = {}
        for a, b in trace.notes:
            first, last = self.line(a), self.line(max(a, b - 1))
            before = text[self.starts[first] : a]
            after = text[b : self.starts[last + 1] if last + 1 < len(self.starts) else len(text)]
            if not before.strip() and not after.strip():
                for k in range(first, last + 1):
                    self.comment_lines[k] = (a, b)

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset) - 1

    def word(self, i: int) -> str:
        m = re.compile(r"[#$\w]+").match(self.text, self.at[i]) if self.at[i] >= 0 else None
        return m[0] if m else ""

    def comments_above(self, line: int) -> list[tuple[int, int]]:
        """Comments on the lines that end directly above ``line``, from the top."""
        out: list[tuple[int, int]] = []
        k = line - 1
        while k in self.comment_lines:
            c = self.comment_lines[k]
            out.append(c)
            k = self.line(c[0]) - 1
        return out[::-1]

    def comment_text(self, a: int, b: int) -> list[str]:
        raw = self.text[a:b]
        if raw.startswith("/*"):
            if self.language == "rust" and raw.startswith("/*!"):
                return []
            body = re.sub(r"^/\*+!?|\*+/$", "", raw)
            return [re.sub(r"^\s*\*? ?", "", x) if "*" in x[: len(x) - len(x.lstrip()) + 1] else x.strip() for x in body.split("\n")]
        if self.language == "rust" and raw.startswith("//!"):
            return []
        return [re.sub(r"^(?://+!?|#+)\s?", "", raw).rstrip()]

    def signature(self, start: int, end: int) -> str:
        """Text from token ``start`` to before token ``end`` on one line."""
        b = self.at[end] if end < len(self.at) and self.at[end] >= 0 else len(self.text)
        return re.sub(r"\s+", " ", self.text[self.at[start] : b]).strip()

    # ------------------------------------------------------------- shared walks

    def skip_type(self, i: int, stop: set[str]) -> int:
        """First token at or after ``i`` outside brackets that is in ``stop``."""
        n = len(self.tok)
        while i < n and self.tok[i] not in stop:
            i = self.match[i] + 1 if self.tok[i] in "([{" and i in self.match else i + 1
        return i

    def doc_lines(self, first: int, name_at: int) -> list[str]:
        """Documentation of a declaration whose first token is ``first``: comments above it, or between it and its name."""
        top, below = self.line(self.at[first]), self.line(self.at[name_at])
        seen, out = set(), []
        for a, b in self.comments_above(top):
            seen.add(a)
            out += self.comment_text(a, b)
        for k in range(top, below):
            if k in self.comment_lines and self.comment_lines[k][0] not in seen:
                seen.add(self.comment_lines[k][0])
                out += self.comment_text(*self.comment_lines[k])
        return out


_JS_MODS = {"export", "default", "async", "static", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "accessor", "declare", "*"}


def _ecmascript(s: Source) -> Iterator[Function]:
    tok, n = s.tok, len(s.tok)
    classes: dict[int, tuple[str, list[str]]] = {}

    def first_of(i: int, mods: set[str]) -> int:
        while i > 0:
            if tok[i - 1] in mods:
                i -= 1
                continue
            j = i - 1
            if tok[j] == ")" and j in s.match:
                j = s.match[j] - 1
            k = j
            while k >= 2 and tok[k - 1] == ".":
                k -= 2
            if k >= 1 and tok[k - 1] == "@":
                i = k - 1
                continue
            return i
        return i

    def body_after(close: int, arrow: bool) -> int | None:
        """Index of the body's opening bracket (or of ``=>``), None if there is no body."""
        i = close + 1
        if i < n and tok[i] == ":":
            i += 1
            while i < n:
                if tok[i] == "{" and not arrow and tok[i - 1] not in (":", "|", "&", "<", ",", "=>"):
                    return i
                if tok[i] == "=>" and arrow and (i + 1 >= n or tok[i - 1] != ")" or True):
                    return i
                if tok[i] in (";", "}", ")", "="):
                    return None
                i = s.match[i] + 1 if tok[i] in "([{" and i in s.match else i + 1
            return None
        return i if i < n and tok[i] == ("=>" if arrow else "{") else None

    for i, t in enumerate(tok):
        if t == "class" and (i == 0 or tok[i - 1] not in (".", "?.")):
            j = i + 1
            name = s.word(j) if j < n and tok[j] not in ("{", "extends") else ""
            parents = []
            while j < n and tok[j] != "{" and tok[j] != ";":
                if tok[j] in ("extends", "implements", ","):
                    parents.append(s.word(j + 1)) if j + 1 < n else None
                j += 1
            if j < n and tok[j] == "{":
                classes[j] = (name, parents)
        elif t == "function":
            j = i + 1
            if j < n and tok[j] == "*":
                j += 1
            if j >= n or tok[j] in ("(", "<"):
                continue
            p = s.skip_type(j + 1, {"("})
            if p in s.match and (body := body_after(s.match[p], False)) is not None:
                first = first_of(i, _JS_MODS)
                yield Function(s.word(j), "function", j, s.signature(first, body), s.doc_lines(first, j))
        elif t == "const" and i + 1 < n and tok[i + 1] not in ("[", "{", "enum"):
            e = s.skip_type(i + 2, {"=", ";", "of", "in", ")", "}"}) if i + 2 < n and tok[i + 2] == ":" else i + 2
            if e >= n or tok[e] != "=":
                continue
            j = e + 1
            if j < n and tok[j] == "async":
                j += 1
            if j < n and tok[j] == "<":
                j = s.skip_type(j, {"("})
            arrow = None
            if j < n and tok[j] == "(" and j in s.match:
                arrow = body_after(s.match[j], True)
            elif j + 1 < n and tok[j + 1] == "=>":
                arrow = j + 1
            if arrow is not None:
                first = first_of(i, _JS_MODS)
                yield Function(s.word(i + 1), "function", i + 1, s.signature(first, arrow), s.doc_lines(first, i + 1))
    for open_, (owner, parents) in classes.items():
        i, end = open_ + 1, s.match.get(open_, n)
        while i < end:
            if tok[i] == "(" and i in s.match:
                name_at = i - 1
                if tok[name_at] == ">":  # type parameters
                    depth, name_at = 1, name_at - 1
                    while name_at > open_ and depth:
                        depth += {">": 1, "<": -1}.get(tok[name_at], 0)
                        name_at -= 1
                if tok[name_at] == "OPT":
                    name_at -= 1
                body = body_after(s.match[i], False)
                word = s.word(name_at)
                if body is not None and word and name_at > open_ and tok[name_at - 1] not in ("@", ".", "=", "new"):
                    first = first_of(name_at, _JS_MODS)
                    yield Function(word, "method", name_at, s.signature(first, body), s.doc_lines(first, name_at), owner, parents)
                    i = s.match.get(body, body) + 1
                    continue
            i = s.match[i] + 1 if tok[i] in "([{" and i in s.match else i + 1


def _rust(s: Source) -> Iterator[Function]:
    tok, n = s.tok, len(s.tok)
    owners: list[tuple[int, int, str, list[str]]] = []
    for i, t in enumerate(tok):
        if t in ("impl", "trait"):
            j = s.skip_type(i + 1, {"{", ";"})
            if j < n and tok[j] == "{" and j in s.match:
                text = s.signature(i, j)
                of = re.search(r"\bfor\s+&?\s*(?:mut\s+)?([\w:]+)", text)
                head = re.match(r"(?:impl|trait)\s*(?:<[^{]*?>\s+)?!?([\w:]+)", text)
                base = head[1].split("::")[-1] if head else ""
                owners.append((j, s.match[j], of[1].split("::")[-1] if of else base, [base] if of else []))
    for i, t in enumerate(tok):
        if t == "fn" and i + 1 < n and s.word(i + 1) and tok[i + 1] != "(":
            p = s.skip_type(i + 2, {"(", ";", "{"})
            if p >= n or tok[p] != "(" or p not in s.match:
                continue
            body = s.skip_type(s.match[p] + 1, {"{", ";", "}", "fn"})
            if body >= n or tok[body] != "{":
                continue
            first, attrs = i, []
            while first > 0:
                if tok[first - 1] in ("pub", "const", "async", "unsafe", "extern", "default", "safe", "crate", "STR"):
                    first -= 1
                elif tok[first - 1] == ")" and (k := s.match.get(first - 1)) and tok[k - 1] == "pub":
                    first = k - 1
                elif tok[first - 1] == "]" and (k := s.match.get(first - 1)) and tok[k - 1] == "#":
                    attrs.append((k, first - 1))
                    first = k - 1
                else:
                    break
            doc = s.doc_lines(first, i + 1)
            sig_from = first
            for a, b in reversed(attrs):
                sig_from = max(sig_from, b + 1)
                if s.word(a + 1) == "doc" and tok[a + 2] == "=" and tok[a + 3] == "STR":
                    doc.append(_unquote(s.text[s.at[a + 3] : s.at[b]].strip()))
            own = [(x, y) for o, c, x, y in owners if o < i < c][-1:]
            owner, parents = own[0] if own else ("", [])
            yield Function(s.word(i + 1).removeprefix("r#"), "method" if own else "function", i + 1, s.signature(sig_from, body), doc, owner, parents)


def _unquote(literal: str) -> str:
    body = re.sub(r'^(?:b|c)?r?#*"|"#*$', "", literal)
    return body.replace('\\"', '"').replace("\\n", " ")


def _go(s: Source) -> Iterator[Function]:
    tok, n = s.tok, len(s.tok)
    for i, t in enumerate(tok):
        if t != "func":
            continue
        j, owner = i + 1, ""
        if j < n and tok[j] == "(" and j in s.match and s.match[j] + 1 < n and tok[s.match[j] + 1] == "NAME":
            owner = re.sub(r".*[\s*]|\[.*", "", s.text[s.at[j] + 1 : s.at[s.match[j]]].strip())
            j = s.match[j] + 1
        if j >= n or tok[j] != "NAME":
            continue
        p = j + 1
        if p < n and tok[p] == "[" and p in s.match:
            p = s.match[p] + 1
        if p >= n or tok[p] != "(" or p not in s.match:
            continue
        b = s.match[p] + 1
        while b < n and tok[b] not in (";", "{"):
            b = s.match[b] + 1 if tok[b] in "([" and b in s.match else b + 1
            if b < n and tok[b] == "{" and tok[b - 1] in ("struct", "interface") and b in s.match:
                b = s.match[b] + 1
        if b < n and tok[b] == "{":
            yield Function(s.word(j), "method" if owner else "function", j, s.signature(i, b), s.doc_lines(i, j), owner)


_JAVA_STOP = {";", "{", "}"}


def _java(s: Source) -> Iterator[Function]:
    tok, n = s.tok, len(s.tok)
    bodies: dict[int, tuple[str, list[str]]] = {}
    for i, t in enumerate(tok):
        if t in ("class", "interface", "enum", "record") and i + 1 < n and (i == 0 or tok[i - 1] != ".") and tok[i + 1] == "WORD":
            j = s.skip_type(i + 2, {"{", ";"})
            if j < n and tok[j] == "{":
                head = s.signature(i + 1, j)
                bodies[j] = (s.word(i + 1), [x for part in re.findall(r"\b(?:extends|implements)\s+([^{]*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", head) for x in re.findall(r"([A-Za-z_]\w*)\s*(?:<[^,]*>)?\s*(?:,|$)", part)])
        elif t == "new":
            j = i + 1
            while j < n and tok[j] in ("WORD", ".", "<", ">", ","):
                j += 1
            if j < n and tok[j] == "(" and j in s.match and s.match[j] + 1 < n and tok[s.match[j] + 1] == "{":
                bodies[s.match[j] + 1] = ("", [s.word(i + 1)])
    for open_, (owner, parents) in bodies.items():
        i, end, start = open_ + 1, s.match.get(open_, n), open_ + 1
        while i < end:
            t = tok[i]
            if t == "(" and i in s.match:
                b = s.match[i] + 1
                while b < end and tok[b] not in ("{", ";", "=", "("):
                    b = s.match[b] + 1 if tok[b] == "[" and b in s.match else b + 1
                word = s.word(i - 1)
                # The name follows a type or modifier; an annotation's does not.
                if b < end and tok[b] == "{" and word and tok[i - 1] not in ("@",) and not (i - 2 >= start and tok[i - 2] in ("@", "=", "new")):
                    first = start
                    yield Function(word, "method", i - 1, s.signature(_after_annotations(s, first, i - 1), b), s.doc_lines(first, i - 1), owner, parents)
                    i = start = s.match.get(b, b) + 1
                    continue
                i = s.match[i] + 1
                continue
            if t in _JAVA_STOP:
                i = s.match[i] + 1 if t == "{" and i in s.match else i + 1
                start = i
                continue
            i = s.match[i] + 1 if t == "[" and i in s.match else i + 1


def _after_annotations(s: Source, i: int, end: int) -> int:
    while i < end and s.tok[i] == "@":
        i += 2
        while i < end and s.tok[i] == ".":
            i += 2
        if s.tok[i] == "(" and i in s.match:
            i = s.match[i] + 1
    return min(i, end)


_PY_NAMES = {"WORD", "match", "case", "type"}


def _python(s: Source) -> Iterator[Function]:
    tok, n = s.tok, len(s.tok)
    classes: list[tuple[int, int, str, list[str]]] = []
    suites: dict[int, str] = {}
    for i, t in enumerate(tok):
        if t == "class" and i + 1 < n and tok[i + 1] in _PY_NAMES:
            j = s.skip_type(i + 2, {":", "NL"})
            parents = re.findall(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:,|\)$)", s.signature(i + 2, j)) if j > i + 2 else []
            if j + 2 < n and tok[j + 1] == "NL" and tok[j + 2] == "INDENT":
                classes.append((j + 2, s.match.get(j + 2, n), s.word(i + 1), parents))
                suites[j + 2] = s.word(i + 1)
    opens: list[int] = []
    for i, t in enumerate(tok):
        if t == "INDENT":
            opens.append(i)
        elif t == "DEDENT":
            if opens:
                opens.pop()
        elif t == "def" and i + 1 < n and tok[i + 1] in _PY_NAMES:
            p = s.skip_type(i + 2, {"(", "NL"})
            if p >= n or tok[p] != "(" or p not in s.match:
                continue
            c = s.skip_type(s.match[p] + 1, {":", "NL"})
            if c >= n or tok[c] != ":":
                continue
            first = i - 1 if i and tok[i - 1] == "async" else i
            sig_from = first
            while first >= 2 and tok[first - 1] == "NL":
                k = first - 2
                while k >= 0 and tok[k] not in ("NL", "INDENT", "DEDENT", ":"):
                    k = s.match[k] - 1 if tok[k] in ")]}" and k in s.match else k - 1
                if tok[k + 1] != "@":
                    break
                first = k + 1
            d = c + 1
            if d + 1 < n and tok[d] == "NL" and tok[d + 1] == "INDENT":
                d += 2
            doc = s.doc_lines(first, i + 1)
            if d < n and tok[d] == "STR" and (d + 1 >= n or tok[d + 1] in ("NL", ";", "DEDENT")):
                raw = s.text[s.at[d] : s.at[d + 1] if d + 1 < n and s.at[d + 1] >= 0 else None]
                m = re.match(r"[rRuU]?(\"\"\"|'''|\"|')([\s\S]*?)(?<!\\)\1", raw)
                if m:
                    lines = m[2].split("\n")
                    margin = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
                    doc = [*doc, "", lines[0].strip(), *(x[margin:] for x in lines[1:])] if any(x.strip() for x in doc) else [lines[0].strip(), *(x[margin:] for x in lines[1:])]
            owner = suites.get(opens[-1], "") if opens else ""
            parents = next((x for o, _, _, x in classes if opens and o == opens[-1]), [])
            yield Function(s.word(i + 1), "method" if owner else "function", i + 1, s.signature(sig_from, c), doc, owner, parents)


EXTRACTORS = {"python": _python, "javascript": _ecmascript, "typescript": _ecmascript, "rust": _rust, "go": _go, "java": _java}


def functions(language: str, text: str) -> list[tuple]:
    """(line_no, name, kind, signature, owner, parents, doc, documented, inherits) of a text's functions with a body."""
    s = Source(language, text)
    out = []
    for f in EXTRACTORS[language](s):
        doc = "\n".join(f.doc).strip()
        out.append((s.line(s.at[f.line]) + 1, f.name, f.kind, f.signature, f.owner, [p for p in f.parents if p], doc, documented(f.doc, f.name), f.inherits))
    return out


_SCHEMA = "fk binary, language string, line_no int, symbol_name string, symbol_kind string, symbol_signature string, symbol_parent string, parents array<string>, doc string, documented boolean, inherits boolean"


def extract(files: DataFrame) -> DataFrame:
    """(fk, path, content) -> one row per function or method with a body, documented or not.

    Files of other languages give nothing. What can't be read in a damaged file is skipped, the rest is used.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for fk, path, text in zip(b["fk"], b["path"], b["content"], strict=True):
                language = EXTENSIONS.get(path[path.rfind(".") :].lower())
                if language in LANGUAGES and text:
                    rows += [(fk, language, *f) for f in functions(language, text)]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    known = [x for x, language in EXTENSIONS.items() if language in LANGUAGES]
    return spread(files.where(extension().isin(known)), "fk").mapInPandas(scan, _SCHEMA)


def resolve_bases(found: DataFrame) -> DataFrame:
    """(project, language, file, class, base_file, base): the classes that the parents named by a class stand for.

    A name means a class of the same file, else the only class of that name in the repository's files of the language; a name
    that several files declare is not resolved.
    """
    own = found.where("symbol_parent <> ''")
    owners = own.select("project", "language", "file", F.col("symbol_parent").alias("class")).distinct()
    named = own.select("project", "language", "file", F.col("symbol_parent").alias("class"), F.explode("parents").alias("base")).distinct()
    local = owners.withColumnRenamed("class", "base").withColumn("local", F.lit(True))
    single = owners.groupBy("project", "language", F.col("class").alias("base")).agg(F.count(F.lit(1)).alias("_n"), F.min("file").alias("only")).where("_n = 1").drop("_n")
    met = named.join(local, ["project", "language", "file", "base"], "left").join(single, ["project", "language", "base"], "left")
    met = met.withColumn("base_file", F.when(F.col("local"), F.col("file")).otherwise(F.col("only")))
    return met.where("base_file IS NOT NULL").select("project", "language", "file", "class", "base_file", "base")


def overridden(found: DataFrame) -> DataFrame:
    """(id, origin): for methods that inherit their documentation, the id of the nearest documented method they override.

    Round by round, pending methods look for a documented method of the same name in the classes one level up; those not met move
    on, each to a class only once, until none is left. Of several on one level the least id wins. Only keys are moved, no texts.
    """
    key = ["project", "language", "file", "class"]
    edges = written(resolve_bases(found))
    docs = found.where("documented AND symbol_parent <> ''").groupBy("project", "language", "file", F.col("symbol_parent").alias("class"), "symbol_name").agg(F.min("id").alias("origin"))
    up = edges.select(*key, F.struct(F.col("base_file").alias("file"), F.col("base").alias("class")).alias("b"))

    def climb(df: DataFrame) -> DataFrame:
        return df.join(up, key).select("id", "project", "language", "symbol_name", "b.*").distinct()

    pending, some = written_counting(climb(found.where("inherits AND NOT documented AND symbol_parent <> ''").select("id", "project", "language", "file", F.col("symbol_parent").alias("class"), "symbol_name")), n=F.count(F.lit(1)))
    answers = found.select("id", F.lit(0).alias("level"), F.col("id").alias("origin")).limit(0)
    visited = None
    for level in count(1):
        if not some["n"]:
            break
        met = written(pending.join(docs, [*key, "symbol_name"], "left"))
        hit = met.where("origin IS NOT NULL").select("id", F.lit(level).alias("level"), "origin")
        answers = hit if level == 1 else answers.unionByName(hit)
        here = met.select("id", "file", "class")
        visited = here if visited is None else visited.unionByName(here)
        if level % MERGE == 0:
            answers, visited = written(answers), written(visited)
        left = met.drop("origin").join(hit.select("id"), "id", "left_anti")
        pending, some = written_counting(climb(left).join(visited, ["id", "file", "class"], "left_anti"), n=F.count(F.lit(1)))
    return answers.groupBy("id").agg(F.min(F.struct("level", "origin")).alias("b")).select("id", "b.origin")


def resolve_inherited(found: DataFrame) -> DataFrame:
    """Adds ``inherited_doc`` to methods that inherit: the nearest overridden method's documentation.

    found: project, symbol_name, symbol_parent, parents, doc, documented, inherits, id, and language and file where there are
    several; without them all classes count as one file's. Names are matched within a repository and a language.
    """
    whole = found
    for extra in ("language", "file"):
        if extra not in found.columns:
            whole = whole.withColumn(extra, F.lit(""))
    from_ = overridden(whole)
    docs = found.select(F.col("id").alias("origin"), F.col("doc").alias("inherited_doc"))
    return found.join(from_.join(docs, "origin").drop("origin"), "id", "left")


def _located(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Functions of current files, written once: id (node_id, line_no, symbol_name), project, language, file and the named columns."""
    nodes = current_nodes(spark, root, "project_instance_id").select("fk", "node_id", F.lower("project_instance_id").alias("project"))
    named = extract(texts(spark, root)).select("fk", "line_no", "symbol_name", "language", "symbol_parent", "parents", "documented", "inherits", *columns)
    named = named.join(nodes, "fk").withColumnRenamed("fk", "file").withColumn("id", F.struct("node_id", "line_no", "symbol_name"))
    return written(named.drop("line_no", "node_id").dropDuplicates(["id"]))


def with_documentation(found: DataFrame) -> DataFrame:
    """Adds ``origin``, the id of the function whose documentation counts: its own if it has some, else the one it overrides; functions without any are dropped."""
    own = found.where("documented").withColumn("origin", F.col("id"))
    return own.unionByName(found.where("NOT documented").join(overridden(found), "id").select(*found.columns, "origin"))


@query()
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Functions of current files whose documentation is more than trivial and stands with them, not with one they override."""
    full = with_documentation(_located(spark, root))
    return full.where("origin = id").select("id.node_id", "id.line_no", "id.symbol_name").distinct()


@query()
def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Signature and documentation of every function that has some, its own or inherited."""
    found = _located(spark, root, "symbol_kind", "symbol_signature", "doc")
    full = with_documentation(found.drop("doc", "symbol_signature", "symbol_kind"))
    taken = full.where("origin <> id").select("id", "origin").join(found.select(F.col("id").alias("origin"), "doc"), "origin").select("id", F.col("doc").alias("inherited_doc"))
    every = found.join(taken, "id", "left").withColumn("description", F.when(F.col("documented"), F.col("doc")).otherwise(F.col("inherited_doc"))).where("description IS NOT NULL")
    return every.select("id.*", "symbol_kind", "symbol_parent", "symbol_signature", "description", (~F.col("documented")).alias("inherited"))
