"""FM-index, leaked passages, mixtures and languages."""

from __future__ import annotations

import random

import numpy as np
import pytest

from treeline.llm import language as L
from treeline.llm import mixing as M
from treeline.llm.fmindex import FMIndex
from treeline.llm.leakage import leaked_spans, words


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_against_scanning(seed):
    r = random.Random(seed)
    frags = [[r.randrange(1, 4) for _ in range(r.randrange(1, 40))] for _ in range(12)]
    frags += frags[:3]
    text = [x for f in frags for x in (*f, 0)]
    index = FMIndex(np.array(text), 4, sample=5)
    pats = [[r.randrange(1, 4) for _ in range(3)] for _ in range(20)]
    lo, hi = index.search(np.array(pats))
    for p, a, b in zip(pats, lo, hi, strict=True):
        want = [i for i in range(len(text) - 2) if text[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_words():
    assert words("Füße\u200bchen, A1_b ÉTÉ e\u0301!") == ["füßechen", "a1", "b", "été", "é"]
    assert words(None) == [] == words("")


def test_leaks_against_sets_of_phrases(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([5, 13, 30])))) for i in range(20)] + [(50, None), (51, "")]
    docs = []
    for d in range(60):
        body = [r.choice(vocab) for _ in range(40)]
        if d % 3 == 0:
            w = (r.choice(items[:20])[1]).split()
            k = r.randrange(0, max(1, len(w) - 13))
            body[10:10] = w[k : k + r.choice([12, 13, 20])]
        docs.append((d, ", ".join(body).upper() if d % 2 else " ".join(body), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, items[0][1] + " " + "long " * 50_000, "x"), docs[0]]

    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    want = {(d, i) for d, t, _ in docs for i, s in items if t and s and grams(t) & grams(s)}
    got = leaked_spans(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and want
    for x in got:
        text = next(t for d, t, _ in docs if d == x.doc_id)
        assert x.last_word - x.first_word >= 12 and tuple(words(text)[x.first_word : x.first_word + 13]) in grams(dict(items)[x.item_id])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert leaked_spans(empty, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


DOC = "doc_id bigint, text string, source string, tokens string"


def test_mixture(spark):
    docs = [(i, f"text number {i} with some words in it", "big", "x") for i in range(300)] + [(1000 + i, f"small text {i} of a few words", "small", "x") for i in range(10)]
    docs += [(2000, "text number 1 with some words in it", "small", "x"), (2001, "", "small", "x"), (2002, None, "small", "x"), (2003, "unlisted", "other", "x"), (2004, "no source", None, "x"), docs[0]]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.1, 2), ("unused", None, 2), ("zero", 0.0, None), ("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    used, report = M.mix(spark.createDataFrame(docs, DOC), targets, seed=5)
    rows = used.collect()
    assert all(r.copies <= (1 if r.source == "big" else 3) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert {r.doc_id for r in rows}.isdisjoint({2000, 2001, 2002, 2003, 2004})
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "small", "none", "unused", "zero"} and rep["small"].most_copies == 3 and rep["none"].tokens == 0
    assert sum(r.copies for r in rows if r.source == "small") == 30  # capped: falls short of its half
    want = sum(r.tokens for r in M.count_tokens(spark.createDataFrame(docs[:300], DOC).drop("tokens")).collect()) + rep["small"].available
    assert abs(rep["big"].tokens - want / 2) < 0.05 * want
    assert M.mix(spark.createDataFrame([], DOC), targets)[0].count() == 0


def test_systematic_counts_are_exact(spark):
    units = spark.createDataFrame([("s", i) for i in range(1000)], "source string, id bigint")
    rates = spark.createDataFrame([("s", int(2.37 * M.UNIT))], "source string, rate bigint")
    copies = [r.copies for r in M.systematic_copies(units, rates, seed=1, buckets=7).collect()]
    assert set(copies) == {2, 3} and abs(sum(copies) - 2370) <= 1


SENTENCES = {
    "en": "The cache is full and the reader has to wait until another worker gives it back.", "de": "Der Speicher ist voll und der Leser muss warten, bis ein anderer ihn wieder freigibt.", "nl": "Het geheugen is vol en de lezer moet wachten tot een ander het weer vrijgeeft.",
    "fr": "La mémoire est pleine et le lecteur doit attendre qu'un autre la rende.", "es": "La memoria está llena y el lector tiene que esperar hasta que otro la devuelva.", "pt": "A memória está cheia e o leitor tem de esperar até que outro a devolva.",
    "it": "La memoria è piena e il lettore deve aspettare finché un altro non la restituisce.", "pl": "Pamięć jest pełna i czytelnik musi czekać, aż ktoś inny ją zwolni.", "ru": "Память заполнена, и читатель должен ждать, пока другой её не освободит.", "ja": "メモリがいっぱいなので、読み手は他の作業が終わるまで待つ必要があります。",
}


@pytest.fixture(scope="module")
def model():
    return L.Model(L.seed_sample())


def test_labels():
    assert [L.label_code(x) for x in ("EN", "en_GB", "Deutsch", "pt-BR", "und", "python", "", None, " français ")] == ["en", "en", "de", "pt", None, None, None, None, "fr"]


def test_paragraphs_and_prose():
    text = "One two three.\n\n```x\na\n\nb\n```\nFour five six.\n\n\nSeven"
    assert L.paragraphs(text) == ["One two three.", "Four five six.", "Seven"]
    assert L.natural_words("x = f(a, b); y = g(c); return x[0] + y[1];") == [] and L.natural_words("`a` src/b/c.py --x") == []


def test_seeds_alone_tell_languages_apart(model):
    right = sum(L.segment(s, model)[0][0] == lang for lang, s in SENTENCES.items())
    assert right >= 9


def test_segments_and_states(spark, model):
    docs = [
        (1, SENTENCES["en"], "EN"), (2, SENTENCES["de"], "en"), (3, SENTENCES["ru"], None), (4, SENTENCES["en"] + "\n\n```\nx\n```\n\n" + SENTENCES["ru"] + "\n\n" + SENTENCES["ja"], "en"), (5, "```\na = 1\n```", None), (6, "", None), (7, None, "de"),
        (8, (SENTENCES["en"] + " ") * 3000, "eng"),
    ]
    got = {(r.doc_id, r.seg_no): (r.lang, r.label_state) for r in L.label_documents(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), model).collect()}
    assert got == {(1, 1): ("en", "right"), (2, 1): ("de", "wrong"), (3, 1): ("ru", "missing"), (4, 1): ("en", "mixed"), (4, 2): ("ru", "mixed"), (4, 3): ("ja", "mixed"), (8, 1): ("en", "right")}


def test_held_out_accuracy(spark):
    """Train on half of the labelled documents, score every other one that has prose.

    A document counts as right if it is one segment in the language of its label; those that are not are wrong labels and
    mixed texts, about a tenth.
    """
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    m = L.fit(L.training_sample(docs.where("doc_id % 2 = 0")))
    rows = docs.where("doc_id % 2 = 1 AND lang IN ('en','de','fr','es','pt','it','nl','pl','ru','ja')").collect()
    scored = [(r.lang, L.segment(r.text or "", m)) for r in rows]
    assert m.agreement > 0.8
    assert sum(len(s) == 1 and s[0][0] == lang for lang, s in scored) / sum(bool(s) for _, s in scored) > 0.87


def test_order_and_spread_of_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one, two = L.training_sample(docs.coalesce(1).orderBy("doc_id")), L.training_sample(docs.repartition(7).orderBy("text"))
    assert one == two and one
    a, b = L.fit(one), L.fit(two)
    assert (a.weights == b.weights).all() and (a.bias == b.bias).all()
    twice = L.training_sample(docs.unionByName(docs))
    assert {x[:2] for x in twice} <= {x[:2] for x in L.training_sample(docs, 10**6)}


def test_the_optimum_does_not_depend_on_the_sample_order():
    s = [(lang, i, w) for i, (lang, w) in enumerate(L.seed_sample())]
    x, y = L.Model([(lang, w) for lang, _, w in s]), L.Model([(lang, w) for lang, _, w in reversed(s)])
    assert [x.predict(w)[0] for _, _, w in s] == [y.predict(w)[0] for _, _, w in s]


def test_tables_without_labels_use_the_built_in_sentences(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.training_sample(empty) == [] and L.segment(SENTENCES["ru"], L.fit([]))[0][0] == "ru"


def test_unsure_paragraphs_go_with_their_neighbours(model, monkeypatch):
    read = {"# A": ("fr", 0.4), "b": ("en", 0.9), "c": ("de", 0.5), "d": ("pl", 0.9), "# E": ("nl", 0.3), "f": ("it", 0.4)}
    monkeypatch.setattr(model, "read", lambda p: (*read[p], 12 if p == "f" else 2, np.zeros(1)))
    assert [x for x, _, _ in L.segment("b\n\nf\n\nc", model)] == ["en", "it"]
    assert [(x, n) for x, _, n in L.segment("# A\n\nb\n\nc\n\n# E\n\nd\n\nc", model)] == [("en", 6), ("pl", 6)]


def test_labels_of_odd_tables(spark, model):
    cols = "doc_id bigint, text string, lang string, seg_no string, confidence string"
    rows = [(None, SENTENCES["en"], "en", "x", "y"), (1, None, None, None, None), (2, SENTENCES["ru"], None, None, None), (2, SENTENCES["ru"], None, None, None), (3, "\n\n```\n\n", "en", None, None)]
    got = sorted((r.doc_id, r.seg_no, r.lang) for r in L.label_documents(spark.createDataFrame(rows, cols), model).collect())
    assert got == [(2, 1, "ru"), (2, 1, "ru")]
    assert L.label_documents(spark.createDataFrame([], cols), model).count() == 0


def test_mixture_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "some words here", "a", "x", 5), (1, "some words here", "a", "x", 5), (2, "some words here", "b", "x", 5)], "doc_id bigint, text string, source string, digest string, rate int")
    targets = spark.createDataFrame([("a", 0.5, 1, 9), ("b", 0.5, 1, 9)], "source string, target_share double, max_repeats int, tokens int")
    used, report = M.mix(docs, targets)
    assert [(r.doc_id, r.source, r.copies) for r in used.collect()] == [(1, "a", 1)] and {r.source: r.texts for r in report.collect()} == {"a": 1, "b": 0}
    assert M.mix(docs, targets.limit(0))[0].count() == 0
