"""Symbols and relations of source texts: declarations with their extents, what they call, and what a file imports.

Python is read by the standard library's parser. Languages with braces are read in two steps: strings and comments are blanked
out, then declarations are matched by pattern and given the extent of the braces that follow; the innermost extent around a place
owns it. Texts that a parser refuses are read line by line. All of it runs in Arrow batches behind the scan, one pass per text.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
import tomllib
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.languages import BY_EXTENSION, BY_NAME

# Words before an opening bracket that are no calls.
NO_CALLS = frozenset("if for while switch catch return function fn func def match elif else and or not in is new await typeof sizeof synchronized super this throw yield lambda with assert del print unless until do loop where impl pub import export package type async enum struct class interface extends let const var static".split())
GO_NO_CALLS = frozenset("go defer select range chan map".split())
BRACES = {"javascript", "typescript", "tsx", "rust", "rust-build-script", "go", "java", "c", "cpp", "h", "hpp", "csharp", "kotlin", "swift", "scala", "php", "dart", "zig", "groovy", "objective-c"}
_BLANK = {
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|b?r(#*)\"[\s\S]*?(?:\"\1|\Z)|b?\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)'"),
    "": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|$)|'(?:[^'\\\n]|\\[\s\S])*(?:'|$)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)", re.M),
}
_NAME = r"([A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|open|override|sealed|data|inline|virtual|extern|unsafe|const|readonly|declare|pub(?:\([^)]*\))?)\s+)*"
_SPLIT = {"rust-build-script": "rust", "tsx": "typescript"}
# Patterns over blanked text: (kind, pattern whose first group is the name). The declaration reaches to its brace's partner.
DECLARED = {
    "javascript": [
        ("class", rf"^[ \t]*{_MODS}class\s+{_NAME}"), ("interface", rf"^[ \t]*{_MODS}interface\s+{_NAME}"), ("enum", rf"^[ \t]*{_MODS}enum\s+{_NAME}"), ("type", rf"^[ \t]*{_MODS}type\s+{_NAME}\s*(?:<[^=\n]*>)?\s*="),
        ("function", rf"^[ \t]*{_MODS}function\s*\*?\s*{_NAME}"), ("function", rf"^[ \t]*{_MODS}(?:const|let|var)\s+{_NAME}\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]*)?=>|{_NAME}\s*=>)"),
        ("method", rf"^[ \t]+{_MODS}(?:get\s+|set\s+|\*\s*)?#?{_NAME}\s*(?:<[^>\n]*>)?\((?:[^()]|\([^()]*\))*\)\s*(?::[^{{;\n]*)?\{{"),
    ],
    "rust": [
        ("struct", rf"^[ \t]*{_MODS}struct\s+{_NAME}"), ("enum", rf"^[ \t]*{_MODS}enum\s+{_NAME}"), ("trait", rf"^[ \t]*{_MODS}trait\s+{_NAME}"), ("impl", r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{;]*?>)?\s*(?:[\w:]+(?:<[^{;]*?>)?\s+for\s+)?&?(?:\w+::)*([A-Za-z_]\w*)"),
        ("module", rf"^[ \t]*{_MODS}mod\s+{_NAME}"), ("type", rf"^[ \t]*{_MODS}type\s+{_NAME}"), ("function", rf"^[ \t]*{_MODS}(?:extern\s+)?fn\s+{_NAME}"),
    ],
    "go": [
        ("struct", rf"^[ \t]*(?:type\s+)?{_NAME}\s*(?:\[[^\]\n]*\]\s*)?struct\s*\{{"), ("interface", rf"^[ \t]*(?:type\s+)?{_NAME}\s*(?:\[[^\]\n]*\]\s*)?interface\s*\{{"), ("type", rf"^type\s+{_NAME}\s+(?!struct\b|interface\b)\S"),
        ("method", rf"^func\s*\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*{_NAME}"), ("function", rf"^func\s+{_NAME}"),
    ],
    "java": [
        ("class", rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:class|record)\s+{_NAME}"), ("interface", rf"^[ \t]*{_MODS}@?interface\s+{_NAME}"), ("enum", rf"^[ \t]*{_MODS}enum\s+{_NAME}"),
        ("method", rf"^[ \t]+(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:<[^>\n]*>\s*)?(?:(?!new\b|return\b|else\b|throw\b)[\w.$]+(?:<[^()\n]*>)?(?:\[\])*\s+)?{_NAME}\s*\((?:[^()]|\([^()]*\))*\)\s*(?:throws\s+[\w.,\s]+)?\{{"),
    ],
}
DECLARED["typescript"] = DECLARED["javascript"]
DECLARED[""] = DECLARED["java"] + [("struct", rf"^[ \t]*{_MODS}(?:struct|union)\s+{_NAME}"), ("trait", rf"^[ \t]*{_MODS}(?:trait|protocol|object)\s+{_NAME}"), ("function", rf"^[ \t]*{_MODS}(?:fun|func|fn|function|def)\s+(?:\w+\.)?{_NAME}")]
_COMPILED = {k: [(kind, re.compile(rx, re.M)) for kind, rx in v] for k, v in DECLARED.items()}
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\?\.|\.|::|->)#?[A-Za-z_$][\w$]*)*!?)(?:::<[^()\n]*>)?\s*\(")
OWNERS = {"class", "interface", "enum", "struct", "trait", "impl"}


@dataclass
class Symbol:
    name: str
    kind: str
    parent: str | None
    first: int
    last: int
    signature: str
    at: int = 0
    end: int = 0


def language_of(path: str) -> str | None:
    base = path.rsplit("/", 1)[-1]
    return BY_NAME.get(base) or BY_EXTENSION.get(base[base.rfind(".") :].lower() if "." in base else "")


def blanked(text: str, language: str) -> str:
    """The text with strings and comments turned into blanks, line ends kept."""
    rx = _BLANK.get(_SPLIT.get(language, language), _BLANK[""])
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _braces(code: str) -> dict[int, int]:
    """Offset of each opening brace's partner; one that is never closed reaches to the end."""
    stack, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | {i: len(code) for i in stack}


def brace_symbols(language: str, text: str, code: str) -> list[Symbol]:
    family = _SPLIT.get(language, language)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect.bisect_right(starts, at)
    partner = _braces(code)
    opens = sorted(partner)
    out: list[Symbol] = []
    seen: set[int] = set()
    for kind, rx in _COMPILED.get(family, _COMPILED[""]):
        for m in rx.finditer(code):
            owner = None
            g = 1
            if family == "go" and kind == "method":
                owner, g = m[1], 2
            at = m.start(g)
            if at in seen or m[g] in NO_CALLS:
                continue
            seen.add(at)
            k = bisect.bisect_left(opens, at)
            stop = code.find(";", m.end() - 1 if m[0].endswith("{") else m.end())
            body = opens[k] if k < len(opens) and (stop < 0 or opens[k] < stop or m[0].endswith("{")) else None
            end = partner[body] if body is not None else (stop if stop >= 0 else len(code))
            head = text[m.start() : body if body is not None else end].split("=>")[0]
            out.append(Symbol(m[g], kind, owner, line(at), line(min(end, len(code) - 1) if code else 0), re.sub(r"\s+", " ", head).strip(), at, end))
    out.sort(key=lambda s: (s.at, -s.end))
    stack: list[Symbol] = []
    for s in out:
        while stack and stack[-1].end < s.at:
            stack.pop()
        holder = next((x for x in reversed(stack) if x.kind in OWNERS and x.end >= s.end), None)
        if s.parent is None and holder is not None:
            s.parent = holder.name
        if s.kind == "function" and s.parent is not None:
            s.kind = "method"
        stack.append(s)
    return [s for s in out if not (s.kind == "method" and s.parent is None and family in ("javascript", "typescript"))]


class _Python(ast.NodeVisitor):
    def __init__(self, text: str):
        self.lines, self.symbols, self.calls, self.imports = text.split("\n"), [], [], []
        self.owner: list[tuple[str, str]] = []

    def _declare(self, node, kind: str) -> None:
        holder = self.owner[-1] if self.owner else None
        inside = holder is not None and holder[1] == "class"
        first = node.lineno
        last = node.body[0].lineno if node.body else node.end_lineno
        head = "\n".join(self.lines[first - 1 : max(first, last - 1)]) if last > first else self.lines[first - 1]
        head = re.sub(r"\s+", " ", head).strip().rstrip(":")
        self.symbols.append(Symbol(node.name, "method" if kind == "function" and inside else kind, holder[0] if inside else None, first, node.end_lineno, head))
        self.owner.append((node.name, kind))
        for x in node.decorator_list:
            self.visit(x)
        self.generic_visit(node)
        self.owner.pop()

    def visit_FunctionDef(self, node):
        self._declare(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self._declare(node, "class")

    def visit_Call(self, node):
        target = ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else None
        if target and re.fullmatch(r"[\w.]+", target):
            self.calls.append((self.owner[-1][0] if self.owner else None, target, node.lineno))
        self.generic_visit(node)

    def visit_Import(self, node):
        self.imports += [(x.name, None, x.asname or x.name.split(".")[0], node.lineno) for x in node.names]

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        self.imports += [(module, x.name, x.asname or x.name, node.lineno) for x in node.names]


def _rust_uses(tree: str, prefix: str = "") -> Iterator[tuple[str, str | None, str]]:
    """(module, imported, local) of a use tree."""
    tree = tree.strip()
    m = re.fullmatch(r"(.*?)(?:::)?\{(.*)\}", tree, re.S)
    if m:
        base = "::".join(x for x in (prefix, m[1].strip().strip(":")) if x)
        depth, part = 0, ""
        for ch in m[2] + ",":
            if ch == "," and not depth:
                if part.strip():
                    yield from _rust_uses(part, base)
                part = ""
                continue
            depth += (ch == "{") - (ch == "}")
            part += ch
        return
    name, _, local = (x.strip() for x in tree.partition(" as "))
    whole = "::".join(x for x in (prefix, name) if x)
    if name == "self":
        yield prefix, None, local or prefix.rpartition("::")[2]
        return
    module, _, last = whole.rpartition("::")
    yield module or whole, last if module else None, local or last


def parse_imports(language: str, text: str, code: str | None = None) -> list[tuple[str, str | None, str, int]]:
    """(module, imported, local, line) of what a text imports; malformed statements give nothing. ``imported`` is null for whole modules."""
    language = _SPLIT.get(language, language)
    out: list[tuple] = []
    line = lambda at: text.count("\n", 0, at) + 1
    if language == "python":
        for m in re.finditer(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n;#]+)|import[ \t]+([^\n;#]+))", text, re.M):
            for part in (m[2] or m[3]).strip().strip("()").split(","):
                x = re.fullmatch(r"\s*([\w.*]+)(?:\s+as\s+(\w+))?\s*", part)
                if x:
                    out.append((m[1], x[1], x[2] or x[1], line(m.start())) if m[1] else (x[1], None, x[2] or x[1].split(".")[0], line(m.start())))
    elif language in ("javascript", "typescript"):
        for m in re.finditer(r"^[ \t]*(?:import|export)[ \t]+(?:type[ \t]+)?([^;'\"]*?)\bfrom[ \t]*['\"]([^'\"\n]+)['\"]|^[ \t]*import[ \t]*['\"]([^'\"\n]+)['\"]|\b(?:const|let|var)[ \t]+(\{[^}]*\}|[\w$]+)[ \t]*=[ \t]*require\(['\"]([^'\"\n]+)['\"]\)", text, re.M):
            module, names = m[2] or m[3] or m[5], m[1] if m[1] is not None else (m[4] or "")
            at = line(m.start())
            braces = re.search(r"\{([^}]*)\}", names)
            for part in braces[1].split(",") if braces else []:
                x = re.fullmatch(r"\s*(?:type\s+)?([\w$]+)(?:\s*(?:as|:)\s*([\w$]+))?\s*", part)
                if x:
                    out.append((module, x[1], x[2] or x[1], at))
            star = re.search(r"\*\s*as\s+([\w$]+)", names)
            if star:
                out.append((module, "*", star[1], at))
            plain = re.match(r"\s*([\w$]+)\s*(?:,|$)", names)
            if plain:
                out.append((module, "default" if m[1] is not None else None, plain[1], at))
            if not names.strip():
                out.append((module, None, module, at))
    elif language == "rust":
        src = code if code is not None else blanked(text, "rust")
        for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", src, re.M):
            out += [(a, b, c, line(m.start())) for a, b, c in _rust_uses(re.sub(r"\s+", " ", m[1]))]
    elif language == "go":
        for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|([^\n]+))", text, re.M):
            for x in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"", m[1] or m[2]):
                out.append((x[2], None, x[1] or x[2].rsplit("/", 1)[-1], line(m.start() + x.start())))
    elif language in ("java", "kotlin", "scala", "groovy"):
        for m in re.finditer(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)\.(\w+|\*)(?:\s+as\s+(\w+))?\s*;?[ \t]*$", text, re.M):
            out.append((m[1], m[2], m[3] or m[2], line(m.start())))
    elif language in ("c", "cpp", "h", "hpp", "objective-c"):
        for m in re.finditer(r"^[ \t]*#[ \t]*(?:include|import)[ \t]*[<\"]([^>\"\n]+)[>\"]", text, re.M):
            out.append((m[1], None, m[1], line(m.start())))
    return out


def manifest(language: str, text: str) -> tuple[list[Symbol], list[tuple[str, str, str, int]]]:
    """Packages and their dependencies (relation 'depends-on') of a package manifest or lock file; nothing if it can't be read."""
    try:
        data = tomllib.loads(text) if language in ("cargo-manifest", "cargo-lock", "toml") else json.loads(text)
    except (ValueError, RecursionError):
        return [], []
    if not isinstance(data, dict):
        return [], []
    packages = data.get("package", [])
    packages = packages if isinstance(packages, list) else [packages]
    if language == "json" or not packages:
        packages = [data.get("project", data)] if isinstance(data.get("project", data), dict) else []
    symbols, uses = [], []
    for p in packages:
        name = p.get("name") if isinstance(p, dict) else None
        if not isinstance(name, str):
            continue
        symbols.append(Symbol(name, "package", None, 1, 1, f"{name} {p.get('version', '')}".strip() if isinstance(p.get("version", ""), str) else name))
        listed = p.get("dependencies", []) if language == "cargo-lock" else []
        for key in ("dependencies", "dev-dependencies", "build-dependencies", "devDependencies", "peerDependencies"):
            more = data.get(key) if language != "cargo-lock" else None
            listed = [*listed, *more] if isinstance(more, (dict, list)) else listed
        uses += [(name, "depends-on", re.split(r"[\s<>=!~;\[]", d, maxsplit=1)[0], 1) for d in listed if isinstance(d, str)]
    return symbols, uses


_SCRIPT = re.compile(r"<script\b([^>]*)>([\s\S]*?)(?:</script\s*>|\Z)|\A---\n([\s\S]*?)\n---", re.I)
HOSTS = {"vue", "svelte", "astro", "html"}


def embedded(language: str, text: str) -> tuple[list[Symbol], list[tuple], list[tuple]]:
    """Symbols, relations and imports of the scripts inside a page or component, with the lines of the whole text."""
    symbols, relations, imports = [], [], []
    for m in _SCRIPT.finditer(text):
        body, at = (m[2], m.start(2)) if m[2] is not None else (m[3], m.start(3))
        if m[3] is not None and language != "astro":
            continue
        inner = "typescript" if m[3] is not None or re.search(r"lang=[\"']?tsx?", m[1] or "") else "javascript"
        _, s, r, i = read_source(inner, body)
        down = text.count("\n", 0, at)
        for x in s:
            x.first, x.last = x.first + down, x.last + down
        symbols += s
        relations += [(a, b, c, n + down) for a, b, c, n in r]
        imports += [(a, b, c, n + down) for a, b, c, n in i]
    return symbols, relations, imports


def read_source(language: str, text: str) -> tuple[str, list[Symbol], list[tuple[str | None, str, str, int]], list[tuple]]:
    """(parser, symbols, relations (source, kind, target, line), imports) of one text; parser is tree, manifest, pattern or none."""
    if language in ("cargo-manifest", "cargo-lock") or (language in ("toml", "json") and '"dependencies"' in text):
        symbols, uses = manifest(language, text)
        return "manifest", symbols, uses, []
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
            v = _Python(text)
            v.visit(tree)
            rel = [(s, "calls", t, n) for s, t, n in v.calls]
            return "tree", v.symbols, rel + [(None, "imports", f"{m}.{i}" if i else m, n) for m, i, _, n in v.imports], v.imports
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            found = [Symbol(m[2], "class" if m[1] == "class" else "function", None, text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.start()) + 1, m[0].strip()) for m in re.finditer(r"^[ \t]*(class|def)[ \t]+(\w+)[^\n:]*", text, re.M)]
            imports = parse_imports("python", text)
            return "pattern", found, [(None, "imports", f"{m}.{i}" if i else m, n) for m, i, _, n in imports], imports
    if language in HOSTS:
        return "embedded", *embedded(language, text)
    if language not in BRACES:
        return "none", [], [], []
    code = blanked(text, language)
    symbols = brace_symbols(language, text, code)
    imports = parse_imports(language, text, code)
    rel = [(None, "imports", f"{m}::{i}" if i and language.startswith("rust") else f"{m}.{i}" if i else m, n) for m, i, _, n in imports]
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    bodies = [s for s in symbols if s.end > s.at and s.kind in ("function", "method")]
    names = {s.at for s in symbols}
    skipped = NO_CALLS | GO_NO_CALLS if language == "go" else NO_CALLS
    stack: list[Symbol] = []
    k = 0
    for m in _CALL.finditer(code):
        while k < len(bodies) and bodies[k].at <= m.start():
            stack.append(bodies[k])
            k += 1
        while stack and stack[-1].end < m.start():
            stack.pop()
        leaf = re.split(r"\?\.|\.|::|->", m[1])[-1]
        if m.start(1) + len(m[1]) - len(leaf) in names or m[1].rstrip("!") in skipped or code[max(0, m.start() - 2) : m.start()].endswith(("@", "#[", "![")):
            continue
        rel.append((stack[-1].name if stack else None, "calls", m[1], bisect.bisect_right(starts, m.start())))
    return "pattern", symbols, rel, imports


_SYMBOL_FIELDS = "name string, kind string, parent string, line_start int, line_end int, signature string"
_RELATION_FIELDS = "source string, kind string, target string, line int"
_IMPORT_FIELDS = "module string, imported string, local string, line int"


def symbol_graphs(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, language, parser, symbols, relations, imports) of files (keys, path, content): one row per file of a language that can be read.

    Null texts and other languages give no row; empty texts a row with nothing in it. Very long texts are read whole.
    """
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", language string, parser string, symbols array<struct<{_struct(_SYMBOL_FIELDS)}>>, relations array<struct<{_struct(_RELATION_FIELDS)}>>, imports array<struct<{_struct(_IMPORT_FIELDS)}>>"
    named = [x.split()[0] for x in _SYMBOL_FIELDS.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, path, text in zip(b[keys].itertuples(index=False, name=None), b["path"], b["content"], strict=True):
                language = language_of(path)
                if language is None or language not in BRACES | HOSTS | {"python", "cargo-manifest", "cargo-lock", "toml", "json"}:
                    continue
                parser, symbols, relations, imports = read_source(language, text)
                rows.append((*key, language, parser, [dict(zip(named, (s.name, s.kind, s.parent, s.first, s.last, s.signature), strict=True)) for s in symbols], [dict(zip(("source", "kind", "target", "line"), r, strict=True)) for r in relations], [dict(zip(("module", "imported", "local", "line"), i, strict=True)) for i in imports]))
            yield pd.DataFrame(rows, columns=[*keys, "language", "parser", "symbols", "relations", "imports"], dtype=object)

    needed = list(dict.fromkeys([*keys, "path", "content"]))
    return files.where("path IS NOT NULL AND content IS NOT NULL").select(*needed).mapInPandas(scan, schema)


def _struct(fields: str) -> str:
    return ", ".join(x.replace(" ", ":", 1) for x in fields.split(", "))


# ---------------------------------------------------------------- summaries


def structural_summary(language: str | None, text: str) -> str | None:
    """One sentence about a document, a configuration or a style sheet from its structure; null for other languages or empty texts."""
    if not text.strip():
        return None
    if language == "markdown":
        heads = re.findall(r"(?m)^#{1,6}[ \t]+(.+?)[ \t#]*$", re.sub(r"(?ms)^(```|~~~).*?^\1", "", text))
        return f"Markdown document with {len(heads)} headings: {', '.join(heads[:3])}" if heads else "Markdown document without headings"
    if language == "json":
        try:
            data = json.loads(text)
        except (ValueError, RecursionError):
            return "JSON that cannot be read"
        return f"JSON object with keys {', '.join(list(data)[:5])}" if isinstance(data, dict) else f"JSON array of {len(data)} items" if isinstance(data, list) else "JSON value"
    if language in ("toml", "cargo-manifest", "cargo-lock"):
        tables = re.findall(r"(?m)^\[+([^\]\n]+)\]+", text)
        return f"TOML with tables {', '.join(dict.fromkeys(t.strip() for t in tables[:20]))}" if tables else f"TOML with {len(re.findall(r'(?m)^[A-Za-z0-9_.-]+[ ]*=', text))} keys"
    if language == "yaml":
        keys = list(dict.fromkeys(re.findall(r"(?m)^([A-Za-z0-9_.-]+):", text)))
        return f"YAML with keys {', '.join(keys[:5])}" if keys else "YAML list or value"
    if language == "css":
        rules = re.findall(r"([^{}]+)\{", re.sub(r"/\*[\s\S]*?\*/", "", text))
        return f"Style sheet with {len(rules)} rules, first {' '.join(rules[0].split())[:60]}" if rules else "Style sheet without rules"
    if language == "html":
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
        return f"HTML page {' '.join(title[1].split())}" if title else f"HTML with {len(re.findall(r'<[a-zA-Z]', text))} elements"
    if language == "xml":
        root = re.search(r"<([A-Za-z_][\w:.-]*)", text)
        return f"XML document {root[1]}" if root else None
    if language == "config":
        keys = re.findall(r"(?m)^\s*([\w.-]+)\s*[=:]", text)
        return f"Settings with {len(keys)} keys" if keys else None
    return None


def leading_documentation(language: str | None, text: str) -> str | None:
    """The module's docstring, or the comment that opens the text without its marks; null without one."""
    if language == "python":
        m = re.match(r"\s*(?:#[^\n]*\n\s*)*[rRuU]?(\"\"\"|''')([\s\S]*?)\1", text)
        return " ".join(m[2].split()) or None if m else None
    m = re.match(r"\s*(?:/\*+!?([\s\S]*?)\*/|((?:\s*//[/!]?[^\n]*(?:\n|\Z))+))", text)
    if not m or language not in BRACES:
        return None
    raw = m[1] if m[1] is not None else m[2]
    return " ".join(re.sub(r"(?m)^\s*(?:\*|//[/!]?)", "", raw).split()) or None


def describe(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, summary, documentation) of files that have either."""
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, path, text in zip(b[keys].itertuples(index=False, name=None), b["path"], b["content"], strict=True):
                language = language_of(path)
                summary, doc = structural_summary(language, text), leading_documentation(language, text)
                if summary or doc:
                    rows.append((*key, summary, doc))
            yield pd.DataFrame(rows, columns=[*keys, "summary", "documentation"], dtype=object)

    needed = list(dict.fromkeys([*keys, "path", "content"]))
    return files.where("path IS NOT NULL AND content IS NOT NULL").select(*needed).mapInPandas(scan, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", summary string, documentation string")


def graph_summary(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, summary): a sentence from a file's first four primary names, with their number, from rows (keys, name, kind, line_start)."""
    w_names = F.array_sort(F.collect_list(F.struct("line_start", "name")))  # the symbols of one file
    g = symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), w_names.alias("s"))
    return g.select(*keys, F.concat(F.lit("Declares "), F.array_join(F.transform(F.slice("s", 1, 4), lambda x: x["name"]), ", "), F.when(F.col("n") > 4, F.concat(F.lit(" and "), (F.col("n") - 4).cast("string"), F.lit(" more"))).otherwise("")).alias("summary"))
