"""Texts of eight languages as token numbers of their grammars; -1 stands where no token can be read.

With a ``Trace``, the programming languages also give where tokens and comments stand, and go on after what
can't be read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from treeline.llm import grammars
from treeline.llm.automata import BREAK, Grammar

BAD = -1


class Trace:
    """Offsets of tokens (beside the token list; -1 for implied ones) and (start, end) of comments."""

    def __init__(self):
        self.at: list[int] = []
        self.notes: list[tuple[int, int]] = []


EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".rs": "rust", ".go": "go", ".java": "java", ".json": "json", ".toml": "toml",
}


def grammar(language: str) -> Grammar:
    return grammars.javascript(True) if language == "typescript" else getattr(grammars, language)()


def _compile(*parts: tuple[str, str], flags: int = 0, blanks: str = "") -> re.Pattern:
    """One pattern of named alternatives; blanks before a token are part of its match, not of its group."""
    return re.compile(f"{blanks}(?:" + "|".join(f"(?P<{n}>{p})" for n, p in parts) + (r"|(?P<end>\Z)" if blanks else "") + ")", flags)


_IDENT = r"[^\W\d]\w*"
_NAME = r"(?:[$]|[^\W\d]|\\u\{?[0-9a-fA-F]+\}?)(?:[\w$]|\\u\{?[0-9a-fA-F]+\}?|[\u200c\u200d])*"


def _marks(*marks: str) -> str:
    return "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))


# ---------------------------------------------------------------- json, toml

_JSON = _compile(("ws", r"[ \t\r\n]+"), ("STR", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'), ("NUM", r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])"), ("word", r"(?:true|false|null)\b"), ("mark", r"[{}\[\]:,]"))


def _simple(rx: re.Pattern, text: str, g: Grammar, emit: Callable[[str, str], int | None]) -> list[int]:
    out, pos = [], 0
    for m in rx.finditer(text):
        if m.start() != pos:
            return [*out, BAD]
        pos = m.end()
        t = emit(m.lastgroup, m[0])
        if t:
            out.append(t)
    return out if pos == len(text) else [*out, BAD]


def lex_json(text: str) -> list[int]:
    g = grammars.json()
    ids = g.ids
    return _simple(_JSON, text.removeprefix("\ufeff"), g, lambda k, v: None if k == "ws" else ids[k] if k in ids else ids[v])


_TOML = _compile(
    ("ws", r"[ \t]+|#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*"), ("nl", r"\r?\n"),
    ("MSTR", r'"""(?:[^"\\]|\\(?:[btnfre"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n)|"(?!""))*"{3,5}|\'\'\'(?:[^\']|\'(?!\'\'))*\'{3,5}'),
    ("STR", r'"(?!"")(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfre"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|\'(?!\'\')[^\'\n]*\'|""|\'\''),
    ("bare", r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[-+]\d\d:\d\d)?|[\w+-][\w+:-]*(?:\.[\w+:-]+)*"), ("DOTTED", r"(?:\.[\w-]+)+"), ("mark", r"[{}\[\],.=]"), flags=re.I,
)
_TOML_VALUE = re.compile(
    r"true|false|[-+]?(?:inf|nan)|[-+]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][-+]?\d(?:_?\d)*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[-+]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?"
)
_TOML_KEY = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")


def lex_toml(text: str) -> list[int]:
    g = grammars.toml()
    ids, arrays = g.ids, []

    def emit(kind: str, v: str) -> int | None:
        if kind == "ws":
            return None
        if kind == "nl":
            return None if arrays and arrays[-1] == "[" and arrays[0] != "head" else ids["NL"]
        if kind == "bare":
            key, value = bool(_TOML_KEY.fullmatch(v)), bool(_TOML_VALUE.fullmatch(v))
            return ids["KV"] if key and value else ids["K"] if key else ids["V"] if value else BAD
        if kind == "mark":
            if v in "[{":
                arrays.append("head" if v == "[" and not arrays and last[0] in (0, ids["NL"]) else v)
            elif v in "]}" and arrays:
                arrays.pop()
            return ids[v]
        return ids[kind]

    last = [0]

    def tracked(kind: str, v: str) -> int | None:
        t = emit(kind, v)
        if t:
            last[0] = t
        return t

    return _simple(_TOML, text.removeprefix("\ufeff"), g, tracked)


# ---------------------------------------------------------------- javascript, typescript

_JS_NUM = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?n?"
_JS_STR = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|\'(?:[^\'\\\n\r]|\\(?:\r\n|[\s\S]))*\''
_JS_BIN = ["**", "**=", "*=", "/=", "%", "%=", "+=", "-=", "<<", "<<=", "<=", ">=", ">>=", ">>>=", "==", "===", "!=", "!==", "&&", "||", "??", "&=", "|=", "^", "^=", "&&=", "||=", "??=", "/"]
_JS_MARKS = ["{", "}", "(", ")", "[", "]", ";", ",", ".", "...", "?.", ":", "=", "=>", "!", "@", "#", "*", "<", ">", "++", "--", "~", "+", "-", "&", "|", "?"]
_JS_MARK_RX = re.compile(r"\?\.(?!\d)|" + _marks(*_JS_BIN, *(m for m in _JS_MARKS if m != "?.")))
_JS = _compile(
    ("nl", r"[\r\n]\s*"), ("name", _NAME), ("com", r"//[^\n\r\u2028\u2029]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"), ("priv", "#" + _NAME), ("mark", _JS_MARK_RX.pattern + "(?!(?<=\\.)\\d)"), ("num", f"(?:{_JS_NUM})(?![\\w$])"), ("str", _JS_STR),
    ("tpl", r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)"), ("ws", r"[\v\f\u00a0\ufeff\u2028\u2029\u2000-\u200a\u3000]+"), blanks="[ \\t]*",
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*(?![\w$])")
_JS_TPL_REST = re.compile(r"\}(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)")
_OPTIONAL = re.compile(r"\?(?=\s*[:,)=;\]}]|\(|<|\s*\n\s*(?:[\w$\[}'\"*/@]))")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "await", "yield", "extends", "default"}


def lex_javascript(text: str, types: bool = False, trace: Trace | None = None) -> list[int]:
    g = grammars.javascript(types)
    ids, words, n = g.ids, g.words, len(text)
    NAME, NUM, STR, BINOP = ids["NAME"], ids["NUM"], ids["STR"], ids["BINOP"]
    table = {m: BINOP for m in _JS_BIN} | {m: ids[m] for m in _JS_MARKS}
    word_ids = {w: ids[w] for w in words}
    out: list[int] = []
    frames: list[str] = []
    pos, flag, last = 0, 0, ""
    match = _JS.match
    if text.startswith("#!"):
        pos = (text + "\n").index("\n")
    while pos < n:
        m = match(text, pos)
        if m is None:
            if trace is None:
                return [*out, BAD]
            pos += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "nl":
            flag, pos = BREAK, end
            continue
        if kind == "ws" or kind == "com" or kind == "end":
            if trace is not None and kind == "com":
                trace.notes.append((m.start(kind), end))
            if not flag and kind != "end" and ("\n" in m[0] or "\u2028" in m[0]):
                flag = BREAK
            pos = max(end, pos + 1) if kind == "end" else end
            continue
        v = m[kind]
        if kind == "name":
            t = NAME if last == "." or last == "?." else word_ids.get(v, NAME)
        elif kind == "mark":
            if v[0] == "/" and (last == "" or not (last[-1].isalnum() or last[-1] in "_$)]}\"'`") or last in _BEFORE_REGEX or (last == "}" and flag)):
                r = _JS_REGEX.match(text, m.start(kind))
                if r:
                    t, v, end = ids["REGEX"], "/x/0", r.end()
                elif last == "}" or trace is not None:
                    t = table[v]
                else:
                    return [*out, BAD]
            elif v == "}" and frames and frames[-1] == "${":
                r = _JS_TPL_REST.match(text, m.start(kind))
                if r is None:
                    if trace is None:
                        return [*out, BAD]
                    frames.pop()
                    pos = end
                    continue
                out.append(ids["}$"] | flag)
                if trace is not None:
                    trace.at += [pos] if r[0][-1] == "`" else [pos, pos, pos]
                flag, end = 0, r.end()
                if r[0][-1] == "`":
                    frames.pop()
                    t, v = ids["TPLEND"], "`"
                else:
                    out += [ids["TPLMID"], ids["${"]]
                    pos, last = end, "${"
                    continue
            else:
                if v in "{(":
                    frames.append(v)
                elif v in "})":
                    if frames:
                        frames.pop()
                t = table[v]
                if types and v == "?" and _OPTIONAL.match(text, end - 1) and not (text[end : end + 1] in "(<" and not (last[-1:].isalnum() or last[-1:] in "_]$\"'")):
                    t = ids["OPT"]
        elif kind == "num":
            t = NUM
        elif kind == "str":
            t = STR
        elif kind == "priv":
            t = ids["PRIV"]
        elif v[-1] == "`":
            t = ids["TPL"]
        else:
            out += [ids["TPLHEAD"] | flag, ids["${"]]
            if trace is not None:
                trace.at += [pos, pos]
            frames.append("${")
            flag, pos, last = 0, end, "${"
            continue
        out.append(t | flag)
        if trace is not None:
            trace.at.append(m.start(kind))
        flag, pos, last = 0, end, v
    return out


# ---------------------------------------------------------------- go

_GO_MARKS = ["{", "}", "(", ")", "[", "]", ";", ",", ".", "...", ":", "=", ":=", "*", "&", "-", "+", "^", "!", "|", "~", "<-", "++", "--"]
_GO_BIN = ["&&", "||", "==", "!=", "<", "<=", ">", ">=", "/", "%", "<<", ">>", "&^"]
_GO_ASSIGN = ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="]
_GO = _compile(
    ("nl", r"\n\s*|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"), ("name", _IDENT),
    ("num", r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][-+]?\d+)?|0[oObB][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][-+]?[\d_]+)?)i?(?!\w)"),
    ("str", r'"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|`[^`]*`|\'(?:[^\'\\\n]|\\(?:[abfnrtv\\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))\''), ("mark", _marks(*_GO_MARKS, *_GO_BIN, *_GO_ASSIGN)), blanks=r"[ \t\r]*",
)


def lex_go(text: str, trace: Trace | None = None) -> list[int]:
    g = grammars.go()
    ids = g.ids
    table = {m: ids["BINOP"] for m in _GO_BIN} | {m: ids["ASSIGNOP"] for m in _GO_ASSIGN} | {m: ids[m] for m in _GO_MARKS} | {w: ids[w] for w in g.words}
    NAME, NUM, STR, SEMI = ids["NAME"], ids["NUM"], ids["STR"], ids[";"]
    closing = {NAME, NUM, STR, ids["break"], ids["continue"], ids["fallthrough"], ids["return"], ids["++"], ids["--"], ids[")"], ids["]"], ids["}"]}
    out: list[int] = []
    pos, last = 0, 0
    pos += text.startswith("\ufeff")
    for m in _GO.finditer(text, pos):
        if m.start() != pos and trace is None:
            return [*out, BAD]
        pos = m.end()
        kind = m.lastgroup
        if kind == "end":
            continue
        v = m[kind]
        if kind == "nl":
            if trace is not None and v[0] == "/":
                trace.notes.append((m.start(kind), pos))
            if last in closing and (v[0] == "\n" or "\n" in v):
                out.append(SEMI)
                last = SEMI
                if trace is not None:
                    trace.at.append(-1)
            continue
        last = table.get(v, NAME) if kind == "name" else NUM if kind == "num" else STR if kind == "str" else table[v]
        out.append(last)
        if trace is not None:
            trace.at.append(m.start(kind))
    if last in closing:
        out.append(SEMI)
        if trace is not None:
            trace.at.append(-1)
    return out if pos == len(text) else [*out, BAD]


# ---------------------------------------------------------------- java

_JAVA_MARKS = ["{", "}", "(", ")", "[", "]", ";", ",", ".", "...", "?", ":", "::", "=", "->", "*", "&", "|", "+", "-", "!", "~", "<", ">", "@", "++", "--"]
_JAVA_BIN = ["/", "%", "==", "!=", "<=", ">=", "&&", "||", "^", "<<"]
_JAVA_AUG = ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="]
_JAVA_ESC = r"\\(?:[btnfrs\"'\\0-7\n]|u+[0-9a-fA-F]{4})"
_JAVA = _compile(
    ("name", r"(?:[$]|[^\W\d])[\w$]*"), ("ws", r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"),
    ("num", r"(?:0[xX](?:[0-9a-fA-F][0-9a-fA-F_]*)?(?:\.[0-9a-fA-F_]*)?(?:[pP][-+]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][-+]?[\d_]+)?)[lLfFdD]?(?![\w$])"),
    ("str", rf'"""[ \t\f]*\r?\n(?:[^"\\]|{_JAVA_ESC}|"(?!""))*"""|"(?!"")(?:[^"\\\n]|{_JAVA_ESC})*"|""(?!")|\'(?:[^\'\\\n]|{_JAVA_ESC}[0-7]{{0,2}})\''), ("mark", _marks(*_JAVA_MARKS, *_JAVA_BIN, *_JAVA_AUG)), blanks=r"[ \t\r\n\f]*",
)
_WILD = re.compile(r"\?\s*(?:>|,|extends\b|super\b)")


def lex_java(text: str, trace: Trace | None = None) -> list[int]:
    g = grammars.java()
    ids = g.ids
    table = {m: ids["BINOP"] for m in _JAVA_BIN} | {m: ids["AUG"] for m in _JAVA_AUG} | {m: ids[m] for m in _JAVA_MARKS} | {w: ids[w] for w in g.words}
    WORD, NUM, STR = ids["WORD"], ids["NUM"], ids["STR"]
    out: list[int] = []
    pos, last = 0, ""
    for m in _JAVA.finditer(text):
        if m.start() != pos and trace is None:
            return [*out, BAD]
        pos = m.end()
        kind = m.lastgroup
        if kind == "ws" or kind == "end":
            if trace is not None and kind == "ws":
                trace.notes.append((m.start(kind), pos))
            continue
        if trace is not None:
            trace.at.append(m.start(kind))
        v = m[kind]
        if kind == "name":
            out.append(table.get(v, WORD))
        elif kind == "mark":
            out.append(ids["WILD"] if v == "?" and last in "<," and _WILD.match(text, m.start(kind)) else table[v])
        else:
            out.append(NUM if kind == "num" else STR)
        last = v
    return out if pos == len(text) else [*out, BAD]


# ---------------------------------------------------------------- rust

_RUST_MARKS = ["{", "}", "(", ")", "[", "]", ";", ",", ".", "..", "...", "..=", ":", "::", "=", "=>", "->", "#", "!", "@", "?", "~", "*", "-", "+", "&", "&&", "|", "||", "<", ">"]
_RUST_BIN = ["/", "%", "^", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="]
_RUST = _compile(
    ("ws", r"//[^\n]*"), ("open", r"/\*"), ("str", r'(?:b|c)?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\(?:[nrt0\\\'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))\''), ("raw", r'(?:b|c)?r(?P<hash>#*)"'), ("life", r"'(?:r#)?[^\W\d]\w*(?!')"),
    ("num", r"(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][-+]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?(?!\w)"), ("name", r"r#[^\W\d]\w*|[^\W\d]\w*"), ("mark", _marks(*_RUST_MARKS, *_RUST_BIN)), ("dollar", r"\$|\\|`|%"), blanks=r"\s*",
)
_RUST_COMMENT = re.compile(r"/\*|\*/")


def lex_rust(text: str, trace: Trace | None = None) -> list[int]:
    g = grammars.rust()
    ids = g.ids
    table = {m: ids["BINOP"] for m in _RUST_BIN} | {m: ids[m] for m in _RUST_MARKS} | {w: ids[w] for w in g.words}
    NAME, NUM, STR, LIFE = ids["NAME"], ids["NUM"], ids["STR"], ids["LIFE"]
    out: list[int] = []
    pos, n, match, last = 0, len(text), _RUST.match, 0
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        pos = (text + "\n").index("\n")
    pos += text.startswith("\ufeff")
    while pos < n:
        m = match(text, pos)
        if m is None:
            if trace is None:
                return [*out, BAD]
            pos += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "open":
            depth = 1
            while depth:
                c = _RUST_COMMENT.search(text, end)
                if c is None:
                    if trace is None:
                        return [*out, BAD]
                    end = n
                    break
                depth += 1 if c[0] == "/*" else -1
                end = c.end()
            if trace is not None:
                trace.notes.append((m.start(kind), end))
        elif kind == "raw" or kind == "hash":
            close = text.find('"' + m["hash"], end)
            if close < 0:
                if trace is None:
                    return [*out, BAD]
                close = n
            end = close + 1 + len(m["hash"])
            out.append(STR)
            if trace is not None:
                trace.at.append(m.start("raw"))
        elif kind == "end":
            break
        elif kind == "ws":
            if trace is not None:
                trace.notes.append((m.start(kind), end))
        else:
            v = m[kind]
            if kind == "num" and last == ids["."] and "." in v:  # tuple fields: x.0.1
                parts = v.split(".")
                for i, _ in enumerate(parts):
                    out += [ids["."], NUM] if i else [NUM]
            else:
                out.append(table.get(v, NAME) if kind == "name" else NUM if kind == "num" else STR if kind == "str" else LIFE if kind == "life" else table[v] if kind == "mark" else ids["#"])
            last = out[-1]
            if trace is not None:
                trace.at += [m.start(kind)] * (len(out) - len(trace.at))
        pos = end
    return out


# ---------------------------------------------------------------- python

_PY_MARKS = ["{", "}", "(", ")", "[", "]", ";", ",", ".", ":", "=", ":=", "->", "@", "*", "**", "-", "+", "/", "~"]
_PY_BIN = ["//", "%", "<<", ">>", "&", "|", "^", "==", "!=", "<", ">", "<=", ">="]
_PY_AUG = ["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="]
_PY_FSTART = r"(?:[fF][rR]?|[rR][fF]|[tT][rR]?|[rR][tT])(?=[\"'])"
_PY = _compile(
    ("ws", r"\\\r?\n|#[^\n]*"), ("nl", r"\r?\n|\r"), ("f", _PY_FSTART + r"(?P<quote>\"\"\"|'''|\"|')"),
    ("str", r"(?:[rR][bB]?|[bB][rR]?|[uU])?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|\"\"(?!\")|''(?!'))"),
    ("num", r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?:\.(?:\d(?:_?\d)*)?)?|0(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|0(?:_?\d)*(?=[eEjJ]))(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?)(?![\w])"),
    ("name", _IDENT), ("dots", r"\.\.\."), ("mark", _marks(*_PY_MARKS, *_PY_BIN, *_PY_AUG)), blanks=r"[ \t\f]*",
)
_PY_STRING = re.compile(r"(?:[rRbBuUfFtT]{0,2})(?:\"\"\"|'''|\"|')")


def _format_string_end(text: str, pos: int, quote: str) -> int:
    """End of a formatted string whose text begins at ``pos``, fields and strings within them skipped; -1 if open."""
    n, depth, one_line = len(text), 0, len(quote) == 1
    while pos < n:
        c = text[pos]
        if depth == 0:
            if text.startswith(quote, pos):
                return pos + len(quote)
            if c == "\n" and one_line:
                return -1
            if c == "\\":
                pos += 1
            elif c == "{":
                if text.startswith("{{", pos):
                    pos += 1
                else:
                    depth = 1
        elif text.startswith(quote, pos) and one_line and c != "'" and False:
            return -1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "\"'":
            q = text[pos : pos + 3] if text[pos : pos + 3] in ('"""', "'''") else c
            if q == quote:  # an older nesting rule: the quote ends the string
                return pos + len(quote)
            close = text.find(q, pos + len(q))
            if close < 0:
                return -1
            pos = close + len(q) - 1
        pos += 1
    return -1


_PY_BLANKS = re.compile(r"[ \t\f]*")
_PY_PLAIN = re.compile(r"[^\\{}\"'\n]+")
_PY_CONVERSION = re.compile(r"[ \t\f]*![rsa](?=\s*[:}])")


def _format_string(text: str, pos: int, quote: str, raw: bool, table: dict[str, int], ids: dict[str, int], out: list[int]) -> int:
    """Lexes a formatted string whose text begins at ``pos``; its fields are groups in ``out``. Its end, or -1."""
    n = len(text)
    while pos < n:
        m = _PY_PLAIN.match(text, pos)
        if m:
            pos = m.end()
            continue
        c = text[pos]
        if text.startswith(quote, pos):
            return pos + len(quote)
        if c == "\n" and len(quote) == 1:
            return -1
        if c == "\\":
            if not raw and text.startswith("N{", pos + 1):
                pos = text.find("}", pos)
                if pos < 0:
                    return -1
            elif text[pos + 1 : pos + 2] not in ("{", "}"):
                pos += 2 if text.startswith("\r\n", pos + 1) else 1
        elif c == "{" or c == "}":
            if text.startswith(c, pos + 1):
                pos += 1
            elif c == "}":
                return -1
            else:
                pos = _format_field(text, pos + 1, quote, raw, table, ids, out, 0)
                if pos < 0:
                    return -1
                continue
        pos += 1
    return -1


def _format_field(text: str, pos: int, quote: str, raw: bool, table: dict[str, int], ids: dict[str, int], out: list[int], level: int) -> int:
    """A field from behind its opening bracket on: expression, conversion, format with fields of its own."""
    out.append(ids["${"])
    depth, n = 0, len(text)
    while True:
        m = _PY.match(text, pos)
        if m is None:
            r = _PY_CONVERSION.match(text, pos)
            if r is None or depth:
                return -1
            out.append(ids["CONV"])
            pos = r.end()
            continue
        kind, pos = m.lastgroup, m.end()
        if kind == "end":
            return -1
        if kind in ("f", "quote"):
            out.append(ids["FSTR"])
            pos = _format_string(text, pos, m["quote"], "r" in m["f"].lower(), table, ids, out)
            if pos < 0:
                return -1
        elif kind == "mark":
            v = m[kind]
            if not depth and v == "}":
                out.append(ids["}$"])
                return pos
            if not depth and v[0] == ":":
                pos = m.start(kind) + 1
                break
            depth += (v in "([{") - (v in ")]}")
            out.append(table[v])
        elif kind != "nl" and kind != "ws":
            out.append(table.get(m[kind], ids["WORD"]) if kind == "name" else ids["NUM"] if kind == "num" else ids["STR"] if kind == "str" else ids["ELLIPSIS"])
    out.append(ids["FSPEC"])
    while pos < n and not text.startswith(quote, pos):
        c = text[pos]
        if c == "}":
            out.append(ids["}$"])
            return pos + 1
        if c == "{":
            pos = -1 if level == 2 else _format_field(text, pos + 1, quote, raw, table, ids, out, level + 1)
            if pos < 0:
                return -1
            continue
        if c == "\n" and len(quote) == 1:
            return -1
        pos += 2 if c == "\\" and text[pos + 1 : pos + 2] not in ("{", "}") else 1
    return -1


def lex_python(text: str, trace: Trace | None = None) -> list[int]:
    g = grammars.python()
    ids = g.ids
    table = {m: ids["BINOP"] for m in _PY_BIN} | {m: ids["AUG"] for m in _PY_AUG} | {m: ids[m] for m in _PY_MARKS} | {w: ids[w] for w in g.words}
    NAME, NUM, STR, FSTR, NL, INDENT, DEDENT = (ids[x] for x in ("WORD", "NUM", "STR", "FSTR", "NL", "INDENT", "DEDENT"))
    out: list[int] = []
    indents, depth, pos, n, match = [0], 0, 0, len(text), _PY.match
    pos += text.startswith("\ufeff")
    line_start = True
    while pos < n:
        if line_start:
            m = _PY_BLANKS.match(text, pos)
            rest = text[m.end() : m.end() + 2]
            if rest[:1] not in ("\n", "#", "\r", "") and rest != "\\\n":
                width = len(m[0].rpartition("\f")[2].expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    out.append(INDENT)
                else:
                    while width < indents[-1]:
                        indents.pop()
                        out.append(DEDENT)
                    if width != indents[-1]:
                        if trace is None:
                            return [*out, BAD]
                        indents.append(width)
                        out.append(INDENT)
            pos, line_start = m.end(), False
            if pos >= n:
                break
        m = match(text, pos)
        if trace is not None:
            trace.at += [-1] * (len(out) - len(trace.at))
        if m is None:
            if trace is None:
                return [*out, BAD]
            pos += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "nl":
            if not depth:
                if out and out[-1] not in (NL, INDENT, DEDENT):
                    out.append(NL)
                line_start = True
        elif kind in ("f", "quote"):
            if trace is None:
                out.append(FSTR)
                end = _format_string(text, end, m["quote"], "r" in m["f"].lower(), table, ids, out)
                if end < 0:
                    return [*out, BAD]
            else:  # one token
                end = _format_string_end(text, end, m["quote"])
                if end < 0:
                    end = m.end()
                out.append(STR)
        elif kind == "end":
            break
        elif kind == "ws":
            if trace is not None and m[kind][0] == "#":
                trace.notes.append((m.start(kind), end))
        else:
            v = m[kind]
            if kind == "mark":
                if v in "([{":
                    depth += 1
                elif v in ")]}":
                    depth = max(0, depth - 1)
                out.append(table[v])
            else:
                out.append(table.get(v, NAME) if kind == "name" else NUM if kind == "num" else STR if kind == "str" else ids["ELLIPSIS"])
        if trace is not None and len(trace.at) < len(out):
            trace.at.append(m.start(kind) if kind != "nl" else -1)
        pos = end
    if out and out[-1] not in (NL, DEDENT):
        out.append(NL)
    return out + [DEDENT] * (len(indents) - 1)


def lex_typescript(text: str, trace: Trace | None = None) -> list[int]:
    return lex_javascript(text, True, trace)


LEXERS: dict[str, Callable[..., list[int]]] = {
    "json": lex_json, "toml": lex_toml, "javascript": lambda t, trace=None: lex_javascript(t, False, trace), "typescript": lex_typescript, "go": lex_go, "java": lex_java, "rust": lex_rust, "python": lex_python,
}


def tokens(language: str, text: str) -> list[int]:
    return LEXERS[language](text)


def traced(language: str, text: str) -> tuple[list[int], Trace]:
    trace = Trace()
    out = LEXERS[language](text, trace=trace)
    trace.at += [-1] * (len(out) - len(trace.at))
    return out, trace
