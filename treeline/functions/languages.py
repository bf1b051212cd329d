"""Languages of files by name and extension, and the class of content a language stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions import paths as P

# Extensions of the languages a scan knows, in the order they are published.
_EXTENSIONS = """
.py=python .pyw=python .js=javascript .jsx=javascript .ts=typescript .tsx=tsx .mjs=javascript .cjs=javascript .d.ts=typescript .java=java .c=c .cpp=cpp .h=h .hpp=hpp .cxx=cpp .cc=cpp .hxx=hpp .hh=hpp .cs=csharp .go=go
.m=objective-c .mm=objective-c .rb=ruby .php=php .swift=swift .kt=kotlin .kts=kotlin .rs=rust .scala=scala .sh=shell .bash=shell .zsh=shell .ps1=powershell .psm1=powershell .psd1=powershell .bat=batch .cmd=batch .r=r
.R=r .pl=perl .pm=perl .lua=lua .dart=dart .hs=haskell .ml=ocaml .mli=ocaml .fs=fsharp .fsx=fsharp .clj=clojure .cljs=clojure .vim=vim .zig=zig .zon=zig .html=html .htm=html .css=css .scss=css .sass=css .less=css
.stylus=css .styl=css .md=markdown .mdx=markdown .json=json .jsonc=json .xml=xml .yml=yaml .yaml=yaml .toml=toml .toon=toon .txt=text .ini=config .cfg=config .conf=config .vue=vue .svelte=svelte .astro=astro .jsp=jsp
.jspx=jsp .jspf=jsp .tag=jsp-tag .tagx=jsp-tag .gsp=gsp .properties=config .gradle=groovy .groovy=groovy .proto=protobuf .hbs=handlebars .handlebars=handlebars .ejs=ejs .pug=pug .ftl=freemarker .mustache=mustache
.liquid=liquid .erb=erb .sql=sql .ddl=sql .dml=sql .mysql=sql .postgresql=sql .psql=sql .sqlite=sql .mssql=sql .oracle=sql .ora=sql .db2=sql .proc=sql .procedure=sql .func=sql .function=sql .view=sql .trigger=sql
.index=sql .migration=sql .seed=sql .fixture=sql .schema=sql .cql=sql .cypher=sql .sparql=sql .gql=graphql .liquibase=sql .flyway=sql
"""
# Whole file names, letter case counts.
_NAMES = "Cargo.toml=cargo-manifest Cargo.lock=cargo-lock build.rs=rust-build-script Dockerfile=dockerfile Makefile=makefile"
# Languages that are not source.
_CLASSES = {"documentation": "markdown", "configuration_data": "cargo-manifest cargo-lock json yaml toon toml xml config", "other_text": "text"}


def _pairs(text: str) -> dict[str, str]:
    return dict(x.split("=") for x in text.split())


BY_NAME = _pairs(_NAMES)
BY_EXTENSION = {k.lower(): v for k, v in _pairs(_EXTENSIONS).items() if k.count(".") == 1}
BY_COMPOUND = {k: v for k, v in _pairs(_EXTENSIONS).items() if k.count(".") > 1}
LANGUAGES = sorted({*BY_NAME.values(), *BY_EXTENSION.values(), *BY_COMPOUND.values()})
CLASS_OF = {language: "source" for language in LANGUAGES} | {x: k for k, names in _CLASSES.items() for x in names.split()}


def lookup(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def detect_language(path: Column, overrides: dict[str, str] | None = None, extra: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(language, reason): an override by whole name, else by longest suffix; then file name, compound extension, extension; null if none.

    ``extra`` adds extensions (with their dot) to the known ones. Names are compared with, extensions without letter case.
    """
    base = P.basename(path)
    low = F.lower(base)
    compound = F.regexp_extract(low, r"(\.[^.]+\.[^.]+)$", 1)
    chosen = F.lit(None).cast("string")
    # The last to be tested is asked first: whole names before suffixes, long ones before short ones.
    for selector, language in sorted((overrides or {}).items(), key=lambda kv: (not kv[0].startswith("."), len(kv[0]))):
        chosen = F.when(low.endswith(selector.lower()) if selector.startswith(".") else base == selector, language).otherwise(chosen)
    known = BY_EXTENSION | {k.lower(): v for k, v in (extra or {}).items()}
    steps = [("override", chosen), ("filename", lookup(base, BY_NAME)), ("compound", lookup(compound, BY_COMPOUND)), ("extension", lookup(P.extension(path), known))]
    reason = F.coalesce(*(F.when(x.isNotNull(), F.lit(n)) for n, x in steps))
    return F.coalesce(*(x for _, x in steps)), reason


def content_class(language: Column, is_text: Column) -> Column:
    """Class of a known language whatever the bytes; else other_text for text and opaque for the rest."""
    return F.coalesce(lookup(language, CLASS_OF), F.when(is_text, "other_text").otherwise("opaque"))


def selected(klass: Column, selection: str | None) -> Column:
    """Whether a content class belongs to a selection: None takes all, else 'source', 'documentation' or 'both'."""
    if selection not in (None, "source", "documentation", "both"):
        raise ValueError(f"no content selection: {selection!r}")
    if selection is None:
        return F.lit(True)
    wanted = ["source", "documentation"] if selection == "both" else [selection]
    return F.coalesce(klass.isin(wanted), F.lit(False))
