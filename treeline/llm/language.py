"""Languages of documents and of their segments: families first, then close languages within one.

A paragraph is a bag of character n-grams taken inside its words. A linear model picks the family;
within it, one linear support vector machine per pair of languages votes. All models are linear in the bag,
so a blank-free token's scores under all of them are computed once per worker and added up from then on.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import query
from treeline.sources.tables import spread, table

FAMILIES = {"germanic": ["en", "de", "nl"], "romance": ["fr", "es", "pt", "it"], "slavic": ["pl", "ru"], "japonic": ["ja"]}
LANGUAGES = [x for f in FAMILIES.values() for x in f]
PAIRS = [p for f in FAMILIES.values() for p in itertools.combinations(f, 2)]
FAMILY_OF = {x: f for f, xs in FAMILIES.items() for x in xs}

SAMPLE_PER_LANGUAGE = 150  # documents a language gives to the training sample, about
SAMPLE_PARAGRAPHS = 4  # paragraphs taken of each
DIM = 1 << 16
NGRAMS = (1, 2, 3, 4)
SAMPLE_WORDS = 2_000  # words taken of each paragraph of the sample
DRAWS = 1 << 40
CACHE_TOKENS = 100_000
UNSURE, FEW = 0.6, 12  # confidence and number of words below which a paragraph goes with its neighbours
EPOCHS, COST, TOLERANCE, BIAS = 8, 1.0, 0.02, 0.3

# Names and codes of the languages, besides their two letters.
LABELS = {
    "en": "eng english", "de": "deu ger german deutsch", "nl": "nld dut dutch nederlands", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "pt": "por portuguese português portugues", "it": "ita italian italiano", "pl": "pol polish polski", "ru": "rus russian русский", "ja": "jpn japanese 日本語",
}
# A few sentences per language, so that a model exists before any label is trusted.
SEEDS = {
    "en": "This is the first sentence and it was written for all of you. They have not been here before, but we will see what can be done with these things. When you want to know which of them are new, ask the others.",
    "de": "Das ist der erste Satz und er wurde für alle geschrieben. Sie sind noch nicht hier gewesen, aber wir werden sehen, was man mit diesen Dingen machen kann. Wenn du wissen willst, welche davon neu sind, frag die anderen.",
    "nl": "Dit is de eerste zin en hij werd voor iedereen geschreven. Zij zijn hier nog niet geweest, maar we zullen zien wat er met deze dingen gedaan kan worden. Als je wilt weten welke daarvan nieuw zijn, vraag het dan aan de anderen.",
    "fr": "C'est la première phrase et elle a été écrite pour vous tous. Ils ne sont pas encore venus ici, mais nous verrons ce qu'on peut faire avec ces choses. Quand vous voulez savoir lesquelles sont nouvelles, demandez aux autres.",
    "es": "Esta es la primera frase y fue escrita para todos ustedes. Todavía no han estado aquí, pero veremos qué se puede hacer con estas cosas. Cuando quieras saber cuáles de ellas son nuevas, pregunta a los demás.",
    "pt": "Esta é a primeira frase e foi escrita para todos vocês. Eles ainda não estiveram aqui, mas veremos o que se pode fazer com essas coisas. Quando você quiser saber quais delas são novas, pergunte aos outros, não a mim.",
    "it": "Questa è la prima frase ed è stata scritta per tutti voi. Non sono ancora stati qui, ma vedremo che cosa si può fare con queste cose. Quando vuoi sapere quali di loro sono nuove, chiedi agli altri.",
    "pl": "To jest pierwsze zdanie i zostało napisane dla wszystkich. Jeszcze tu nie byli, ale zobaczymy, co można zrobić z tymi rzeczami. Kiedy chcesz wiedzieć, które z nich są nowe, zapytaj innych, a nie mnie.",
    "ru": "Это первое предложение, и оно было написано для всех. Они здесь ещё не были, но мы увидим, что можно сделать с этими вещами. Когда вы хотите знать, какие из них новые, спросите других, а не меня.",
    "ja": "これは最初の文であり、皆さんのために書かれました。彼らはまだここに来たことがありませんが、これらの物で何ができるか見てみましょう。どれが新しいか知りたいときは、他の人に聞いてください。",
}

_KNOWN = {name: code for code, names in LABELS.items() for name in (code, *names.split())}


def label_code(label: str | None) -> str | None:
    """The language a label names, whatever its spelling, region or letter case; None if none of ours."""
    if label is None:
        return None
    return _KNOWN.get(re.split(r"[-_.@ (]", label.strip().lower())[0])


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
# ASCII only: in scripts without spaces, prose touches such things directly.
_NOISE = re.compile(r"https?://[!-~]+|[!-~]+@[!-~]+|[!-~]*[/\\][!-~]*|(?<!\w)--?[a-z0-9][a-z0-9-]*|[a-zA-Z0-9]*_[a-zA-Z0-9_]+|[a-zA-Z]*[0-9][a-zA-Z0-9]*")
_CAMEL = re.compile(r"\b[a-z]+[A-Z][A-Za-z]*|\b[A-Z][a-z]+[A-Z][A-Za-z]*")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}]+")
_CODE = re.compile(r"[{}();=<>\[\]|&*$#\\+]")
_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")


def paragraphs(text: str) -> list[str]:
    """Paragraphs between empty lines; fenced code, blank lines included, is left out."""
    if "```" not in text and "~~~" not in text:
        return [p for p in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n")) if p.strip()]
    out, now, fence = [], [], None
    for line in text.replace("\r\n", "\n").split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
        elif mark or not line.strip():
            if now:
                out.append("\n".join(now))
                now = []
            fence = mark[1] if mark else None
        else:
            now.append(line)
    if now:
        out.append("\n".join(now))
    return out


_SPAN = re.compile(r"`[^`\n]*`|<[!-;=?-~ ]*>")
_MARK = re.compile(r"^\s*(?:#+|[-*+>|]|\d+[.)])\s", re.M)


def token_words(token: str) -> tuple[list[str], int, int]:
    """Lower-case words of prose in a blank-free token, its marks of code, its Chinese and Japanese characters."""
    plain = token if token.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFC", token))
    prose = _CAMEL.sub(" ", _NOISE.sub(" ", plain))
    return _WORD.findall(prose.lower()), len(_CODE.findall(prose)), 0 if prose.isascii() else len(_CJK.findall(prose))


def prose_tokens(paragraph: str) -> list[str]:
    """Blank-separated tokens without code spans and tags."""
    return (_SPAN.sub(" ", paragraph) if "`" in paragraph or "<" in paragraph else paragraph).split()


def is_prose(paragraph: str, words: int, letters: int, marks: int, cjk: int) -> bool:
    """Whether a paragraph holds natural language to speak of: some words, and not mostly marks of code."""
    if not words or (words < 3 and letters < 12 and cjk < 5):
        return False
    if marks > 0.6 * words and not cjk:
        marks -= sum(len(_CODE.findall(m)) for m in _MARK.findall(paragraph))  # heads of list items and headings
    return marks <= 0.6 * words or cjk > 0


def natural_words(paragraph: str) -> list[str]:
    """Lower-case words of the prose in a paragraph; none if it is code or holds no sentence to speak of."""
    parts = [token_words(t) for t in prose_tokens(paragraph)]
    found = [w for ws, _, _ in parts for w in ws]
    good = is_prose(paragraph, len(found), sum(map(len, found)), sum(m for _, m, _ in parts), sum(k for _, _, k in parts))
    return found if good else []


@functools.lru_cache(CACHE_TOKENS)
def word_features(word: str) -> tuple[int, ...]:
    """Hashed n-grams of a word with its edges, and the word itself."""
    w = f"^{word}$"
    out = [zlib.crc32(("=" + word).encode()) % DIM]
    for n in NGRAMS:
        out += [zlib.crc32(w[i : i + n].encode()) % DIM for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]
    return tuple(out)


def bag(words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their shares."""
    idx, n = np.unique(np.fromiter(itertools.chain.from_iterable(map(word_features, words_)), np.int64), return_counts=True)
    return idx, n / n.sum() * 10.0


def train_svms(bags: list, signs: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, np.ndarray]:
    """Linear SVMs by dual coordinate descent, all columns of ``signs`` (+1, -1, 0 = not in this one) at once.

    The dual has one optimum, so the order of the rows only matters for how fast it is reached. Both sides of a
    machine weigh the same in total.
    """
    rows, columns = signs.shape
    limit = np.zeros(signs.shape)
    for side in (1, -1):
        mine = signs == side
        limit += mine * (cost * (signs != 0).sum(0) / (2 * np.maximum(mine.sum(0), 1)))
    weights, bias, dual = np.zeros((DIM, columns)), np.zeros(columns), np.zeros(signs.shape)
    norms = np.array([(v * v).sum() + BIAS * BIAS for _, v in bags])
    rng, active = np.random.default_rng(7), np.arange(rows)
    for _ in range(epochs):
        moving = []
        for i in rng.permutation(active):
            idx, v = bags[i]
            gap = signs[i] * (v @ weights[idx] + BIAS * bias) - 1
            new = np.minimum(np.maximum(dual[i] - gap / norms[i], 0), limit[i])
            step = (new - dual[i]) * signs[i]
            if np.abs(step).max() * norms[i] > TOLERANCE:
                weights[idx] += v[:, None] * step
                bias += BIAS * step
                dual[i] = new
                moving.append(i)
        # Rows at rest are passed over until those that still move have settled; then all are looked at again.
        if not moving and len(active) == rows:
            break
        active = np.array(moving) if len(moving) > rows // 50 else np.arange(rows)
    return weights, BIAS * bias


class Model:
    """Scores of words under all linear models: one per family, one per pair of languages in a family.

    ``agreement`` is the share of sampled paragraphs given their label by a model that had not seen them.
    """

    def __init__(self, samples: list[tuple[str, list[str]]]):
        bags = [bag(w) for _, w in samples]
        lang = np.array([x for x, _ in samples])
        family = np.array([FAMILY_OF[x] for x in lang])
        signs = [np.where(family == f, 1.0, -1.0) for f in FAMILIES]
        signs += [(lang == a).astype(float) - (lang == b) for a, b in PAIRS]
        weights, bias = train_svms(bags, np.stack(signs, 1))
        self.weights, self.bias = weights.astype(np.float32), bias.astype(np.float32)
        self.agreement: float | None = None
        self._forget()

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "agreement": self.agreement}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.bias) + 5), np.float64)  # scores; n-grams, words, letters, marks of code, CJK characters

    def _number(self, token: str) -> int:
        """Row of the table that holds a token's sums."""
        n = self.number.get(token)
        if n is None:
            if len(self.number) >= CACHE_TOKENS:
                self._forget()
            n = self.number[token] = len(self.number)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            words, marks, cjk = token_words(token)
            features = [f for w in words for f in word_features(w)]
            k = len(self.bias)
            self.table[n, :k] = self.weights[features].sum(0) if features else 0
            self.table[n, k:] = len(features), len(words), sum(map(len, words)), marks, cjk
        return n

    def sums(self, tokens: list[str]) -> np.ndarray:
        """Sums of the table's rows over tokens, in pieces no longer than the table may grow."""
        total = np.zeros(self.table.shape[1])
        for at in range(0, len(tokens), CACHE_TOKENS // 2):
            part = tokens[at : at + CACHE_TOKENS // 2]
            if len(self.number) + len(part) > CACHE_TOKENS and len(self.number) + len(set(part) - self.number.keys()) > CACHE_TOKENS:
                self._forget()
            known = self.number.get
            rows = [n if (n := known(t)) is not None else self._number(t) for t in part]
            total += self.table[rows].sum(0)
        return total

    def read(self, paragraph: str) -> tuple[str, float, int, np.ndarray] | None:
        """Language, confidence (0..1), words and sums of a paragraph; None without prose."""
        tokens = prose_tokens(paragraph)
        if not tokens:
            return None
        sums = self.sums(tokens)
        _, words, letters, marks, cjk = sums[len(self.bias) :]
        return (*self.total(sums), int(words), sums) if is_prose(paragraph, words, letters, marks, cjk) else None

    def total(self, sums: np.ndarray) -> tuple[str, float]:
        """Language and confidence of the text whose sums these are."""
        k = len(self.bias)
        return self.decide(sums[:k] / sums[k] * 10.0 + self.bias)

    def predict(self, words: list[str]) -> tuple[str, float]:
        """Language and confidence (0..1) of a non-empty list of words."""
        idx, v = bag(words)
        return self.decide(v @ self.weights[idx] + self.bias)

    def decide(self, score: np.ndarray) -> tuple[str, float]:
        """The family of the greatest score, then the language that wins most of its pairs (ties: by margin)."""
        s = score.tolist()
        fam = s[: len(FAMILIES)]
        best = max(range(len(fam)), key=fam.__getitem__)
        sure = _squash(fam[best] - max(x for i, x in enumerate(fam) if i != best))
        members = FAMILIES[list(FAMILIES)[best]]
        if len(members) == 1:
            return members[0], sure
        votes, margin, least = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, 99.0)
        for (a, b), x in zip(PAIRS, s[len(FAMILIES) :], strict=True):
            if a in votes:
                votes[a if x > 0 else b] += 1
                margin[a] += x
                margin[b] -= x
                least[a] = min(least[a], x)
                least[b] = min(least[b], -x)
        win = max(members, key=lambda x: (votes[x], margin[x]))
        return win, sure * _squash(least[win])


def _squash(x: float) -> float:
    return 1 / (1 + math.exp(-2.0 * max(min(x, 50.0), -50.0)))


def seed_sample() -> list[tuple[str, list[str]]]:
    """The built-in sentences, whole and one by one."""
    return [(lang, natural_words(s)) for lang, text in SEEDS.items() for s in (text, *re.split(r"(?<=[.。])\s*", text)) if natural_words(s)]


def training_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, int, list[str]]]:
    """(language, doc_id, words) of paragraphs of about ``per_language`` labelled documents of each language.

    Documents are chosen by a hash of doc_id, with a share for each language that comes from label counts over
    all rows. Of each, the first SAMPLE_PARAGRAPHS paragraphs with prose are taken, of each of them at most
    SAMPLE_WORDS words. The list is sorted, so it does not depend on how the rows are spread or ordered.
    """
    rows = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    head = F.split(F.lower(F.trim("lang")), r"[-_.@ (]", 2).getItem(0)
    rows = rows.withColumn("code", F.create_map(*(F.lit(x) for kv in _KNOWN.items() for x in kv))[head]).where("code IS NOT NULL")
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}  # one row a language
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for code, n in sorted(counts.items()) for x in (code, min(DRAWS, int(DRAWS * per_language / n) + 1))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(DRAWS))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for code, doc, text in zip(b["code"], b["doc_id"], b["text"], strict=True):
                found = filter(None, map(natural_words, paragraphs(text)))
                out += [(code, doc, " ".join(w[:SAMPLE_WORDS])) for w in itertools.islice(found, SAMPLE_PARAGRAPHS)]
            yield pd.DataFrame(out, columns=["code", "doc_id", "words"], dtype=object)

    picked = rows.where(draw < share[F.col("code")]).select("code", "doc_id", "text").mapInPandas(cut, "code string, doc_id bigint, words string")
    return [(r["code"], r["doc_id"], r["words"].split(" ")) for r in sorted(picked.distinct().collect())]


def fit(sample: list[tuple[str, int, list[str]]]) -> Model:
    """Train on the seeds and on the part of the sample whose labels stand up to a model that has not seen them.

    The documents are split in two halves by a hash; the model of one half judges the other, and documents whose
    label it contradicts (wrong labels) are left out, as are single paragraphs (foreign passages). A model that gives fewer
    paragraphs their label than the seeds alone would is not used.
    """
    seeds = seed_sample()
    base = Model(seeds)
    if not sample:
        return base
    half = [zlib.crc32(str(doc).encode()) % 2 for _, doc, _ in sample]
    judges = [Model(seeds + [(lang, w) for (lang, _, w), h in zip(sample, half, strict=True) if h != k]) for k in (0, 1)]
    whole: dict[tuple[str, int], list[str]] = {}
    for lang, doc, w in sample:
        whole.setdefault((lang, doc), []).extend(w)
    right = {(lang, doc) for (lang, doc), w in whole.items() if judges[zlib.crc32(str(doc).encode()) % 2].predict(w)[0] == lang}
    said = [judges[h].predict(w)[0] == lang for (lang, _, w), h in zip(sample, half, strict=True)]
    model = Model(seeds + [(lang, w) for (lang, doc, w), ok in zip(sample, said, strict=True) if ok and (lang, doc) in right])
    model.agreement = sum(said) / len(said)
    base.agreement = sum(base.predict(w)[0] == lang for lang, _, w in sample) / len(sample)
    return model if model.agreement >= base.agreement else base


def segment(text: str, model: Model) -> list[tuple[str, float, int]]:
    """(language, confidence, words) of each maximal run of paragraphs in one language.

    Paragraphs without prose belong to the run before. A paragraph of fewer than FEW words and confidence below
    UNSURE (a heading, a few words two languages share) goes with the paragraph before it, or with the next one if none before it is sure or it
    is a heading; where no paragraph is sure, all are judged as one. The confidence is the mean over a run's words.
    """
    read = [(p, *got) for p in paragraphs(text) if (got := model.read(p))]
    langs = [lang if sure >= UNSURE or n >= FEW else None for _, lang, sure, n, _ in read]
    if not any(langs):
        if not read:
            return []
        lang, sure = model.total(sum(x for *_, x in read))
        return [(lang, sure, sum(n for _, _, _, n, _ in read))]
    after = list(itertools.accumulate(reversed(langs), lambda last, x: x or last))[::-1]
    runs: list[list] = []
    before = None
    for (p, _, sure, n, _), lang, later in zip(read, langs, after, strict=True):
        before = lang or (before if before and not (later and p.lstrip().startswith("#")) else later)
        if runs and runs[-1][0] == before:
            runs[-1][1] += sure * n
            runs[-1][2] += n
        else:
            runs.append([before, sure * n, n])
    return [(lang, s / n, n) for lang, s, n in runs]


def label_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, words, label_state): one row per segment of every document with prose.

    documents: doc_id, text, lang. label_state is 'right', 'missing' (null, or names no language of ours), 'wrong'
    (names another), or 'mixed' (several languages). Null, empty and prose-free texts give no row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = []
            for doc, text, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                segs = segment(text, m)
                code = label_code(lang)
                state = "mixed" if len(segs) > 1 else "missing" if code is None else "right" if segs and segs[0][0] == code else "wrong"
                rows += [(doc, i, s, sure, n, state) for i, (s, sure, n) in enumerate(segs, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "lang", "confidence", "words", "label_state"], dtype=object)

    docs = documents.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND length(text) > 0")
    return spread(docs, "doc_id").mapInPandas(label, "doc_id bigint, seg_no int, lang string, confidence double, words bigint, label_state string")


def _segments(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents", "doc_id", "text", "lang")
    return label_documents(docs, fit(training_sample(docs)))


@query()
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Segments of the documents whose label is missing, wrong or not enough."""
    return _segments(spark, root).where("label_state <> 'right'").select("doc_id", "seg_no", "lang").distinct()


@query()
def p9_segments(spark: SparkSession, root: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    return _segments(spark, root)
