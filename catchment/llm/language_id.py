"""Language identification of whole texts, with spans of mixed-language text.

The script of a word narrows the languages it may belong to. A word's score for each of them
is the log likelihood of its character n-grams; a Viterbi path over the words of a text, with
a penalty for every switch, labels its spans.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_SPACE, at_most, with_struct

UNDETERMINED = "und"
TRAIN_DOCS = 1000  # documents a language is learned from, about
MAX_LANGUAGES = 1000
NGRAM = 3
SMOOTHING = 0.5
SWITCH = 8.0  # log penalty of a change of language between two words
LIMIT = 6.0  # a word counts for so much at most against the best language
SCRIPT_SHARE = 0.01  # letters of a script a language needs to be a candidate for it
WORD_CACHE = 200_000
BLOCK_WORDS = 400_000

# First code points of the ranges of scripts; a range lasts to the next one. Fixed values.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
    (0x20000, "Han"), (0x30000, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS])
_LETTERS = re.compile(r"[^\W\d_]+")
_BEGIN, _END = "\1", "\2"  # ends of the letters of a word; no letters themselves
DENSE = 1 << 24


class Letters:
    """The letters of many words in one row, the ends of every stretch of them marked."""

    def __init__(self, words: list[str]):
        # Superscripts, fractions and the like are no letters; Han numerals are.
        parts = [[p for p in _LETTERS.findall(w.lower()) if p.isalpha() or any(map(str.isalpha, p))] for w in words]
        marked = [_BEGIN + (_END + _BEGIN).join(p) + _END if p else "" for p in parts]
        self.sizes = np.array([len(m) for m in marked], dtype=np.int64)
        self.points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.letter = self.points > 2
        self.script = _SCRIPT[np.searchsorted(_STARTS, self.points, side="right") - 1]
        n = len(words)
        counts = np.bincount(self.owner[self.letter] * len(NAMES) + self.script[self.letter],
                             minlength=n * len(NAMES)).reshape(n, len(NAMES))
        self.counts = counts.sum(1)
        self.main = counts.argmax(1)  # the script of most letters, the first by name on a tie

    def grams(self, rank: np.ndarray, size: int):
        """(places, codes) of the n-grams of each length; a code is a number to the base ``size``."""
        code = rank[np.minimum(self.points, len(rank) - 1)].astype(np.int64)
        code[self.points >= len(rank)] = 0
        inner = self.points != 2
        at = np.flatnonzero(self.letter)
        yield at, code[at]
        at = np.flatnonzero(inner[:-1]) if len(code) else np.zeros(0, dtype=int)
        yield at, code[at] * size + code[at + 1]
        at = np.flatnonzero(inner[:-2] & inner[1:-1]) if len(code) > 2 else np.zeros(0, dtype=int)
        yield at, (code[at] * size + code[at + 1]) * size + code[at + 2]


@dataclass
class Model:
    languages: list[str]
    rank: np.ndarray  # number of a code point, 0 for an unknown one
    size: int  # of the alphabet
    codes: list[np.ndarray]  # known n-grams of each length, sorted
    weights: list[np.ndarray]  # their log likelihoods, the last row for an unknown one
    scripts: np.ndarray  # scripts x languages: whether the language is a candidate
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def places(self, n: int, codes: np.ndarray) -> np.ndarray:
        """Rows of the weights of n-grams."""
        known = self.codes[n]
        if self.size ** (n + 1) <= DENSE:
            if ("dense", n) not in self.cache:
                dense = np.full(self.size ** (n + 1), len(known), dtype=np.int32)
                dense[known] = np.arange(len(known))
                self.cache["dense", n] = dense
            return self.cache["dense", n][codes]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, at, len(known))


def train(samples: dict[str, list[str]]) -> Model:
    """A model of the texts of each language; languages are ordered by name."""
    languages = sorted(samples)
    words, letters, count = [], [], []
    for language in languages:
        seen = Counter()
        for text in samples[language]:
            seen.update(text.split())
        words.append(Letters(list(seen)))
        count.append(np.array(list(seen.values()), dtype=float))
        letters.append(words[-1].points)
    alphabet = np.unique(np.concatenate(letters)) if languages else np.zeros(0, dtype=np.uint32)
    rank = np.zeros(int(alphabet.max(initial=2)) + 1, dtype=np.int32)
    rank[alphabet] = np.arange(1, len(alphabet) + 1)
    size = len(alphabet) + 1
    found = [[] for _ in range(NGRAM)]
    scripts = np.zeros((len(NAMES), len(languages)), dtype=bool)
    for j, (own, n) in enumerate(zip(words, count)):
        for length, (at, code) in enumerate(own.grams(rank, size)):
            known, place = np.unique(code, return_inverse=True)
            found[length].append((known, np.bincount(place, weights=n[own.owner[at]], minlength=len(known))))
        share = np.bincount(own.script[own.letter], weights=n[own.owner[own.letter]], minlength=len(NAMES))
        scripts[:, j] = share >= SCRIPT_SHARE * max(share.sum(), 1)
    codes, weights = [], []
    for by_language in found:
        known = np.unique(np.concatenate([c for c, _ in by_language])) if languages else np.zeros(0, dtype=int)
        table = np.full((len(known) + 1, len(languages)), SMOOTHING)
        for j, (own, n) in enumerate(by_language):
            table[np.searchsorted(known, own), j] += n
        # Likelihoods within the n-grams of one length, so that all lengths weigh alike.
        codes.append(known)
        weights.append(np.log(table / table.sum(0)).astype(np.float32))
    return Model(languages, rank, size, codes, weights, scripts)


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Scores of distinct words, (words x languages), then their number of letters.

    Languages outside the word's script are out of reach; a script that no language was seen
    in, or a word without letters, says nothing.
    """
    n_lang = len(model.languages)
    own = Letters(words)
    out = np.zeros((len(words), n_lang + 1), dtype=np.float32)
    out[:, n_lang] = own.counts
    some = own.sizes > 0
    if some.any() and n_lang:
        total = np.zeros((len(own.points), n_lang), dtype=np.float32)
        for n, (at, codes) in enumerate(own.grams(model.rank, model.size)):
            total[at] += model.weights[n][model.places(n, codes)]
        starts = np.cumsum(own.sizes) - own.sizes
        out[some, :n_lang] = np.add.reduceat(total, starts[some], axis=0)
        allowed = model.scripts[own.main]
        nobody = ~allowed.any(1)
        out[:, :n_lang][some[:, None] & ~allowed] = -np.inf
        out[nobody, :n_lang] = 0
        best = out[:, :n_lang].max(1, keepdims=True)
        out[:, :n_lang] = np.maximum(out[:, :n_lang] - best, -LIMIT)
    return out


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best label of every word; texts advance together, one word at a time.

    A tie keeps the current language, then takes the first by name.
    """
    n_lang = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    back = np.zeros((len(scores), n_lang), dtype=np.int16)
    best = np.zeros((len(order), n_lang), dtype=np.float64)
    own = np.arange(n_lang, dtype=np.int16)
    label = np.zeros(len(scores), dtype=np.int16)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts longer than t
    for t in range(longest):
        k = active[t]
        at = begin[:k] + t
        top = best[:k].argmax(1)
        switched = best[:k][np.arange(k), top] - SWITCH
        stay = best[:k] >= switched[:, None]
        back[at] = np.where(stay, own, top[:, None].astype(np.int16))
        best[:k] = np.where(stay, best[:k], switched[:, None]) + scores[at]
    last = best.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        label[at] = last[:k]
        last[:k] = back[at, last[:k]]
    return label


def label_texts(model: Model, texts: list[str]):
    """(language, score, spans) of each text; a span is (first word, last word, language)."""
    cache, n_lang = model.cache, len(model.languages)
    if "row" not in cache or len(cache["row"]) > WORD_CACHE:
        cache["row"], cache["scores"] = {}, np.zeros((0, n_lang + 1), dtype=np.float32)
    known = cache["row"]
    words_of = [t.split() for t in texts]
    new = list({w for words in words_of for w in words if w not in known})
    if new:
        known.update(zip(new, range(len(known), len(known) + len(new))))
        cache["scores"] = np.concatenate([cache["scores"], word_scores(model, new)])
    lengths = np.array([len(w) for w in words_of])
    ids = np.fromiter((known[w] for words in words_of for w in words), dtype=np.int64,
                      count=int(lengths.sum()))
    del words_of
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    letters = cache["scores"][ids, n_lang]
    label = viterbi(cache["scores"][ids, :n_lang], starts, lengths) if n_lang else None
    for s, n in zip(starts, lengths):
        total = letters[s:s + n].sum()
        if not total or not n_lang:
            yield UNDETERMINED, 0.0, []
            continue
        own = label[s:s + n]
        weight = np.bincount(own, weights=letters[s:s + n], minlength=n_lang)
        top = int(weight.argmax())
        cuts = np.flatnonzero(np.diff(own)) + 1
        edges = [0, *cuts.tolist(), int(n)]
        yield (model.languages[top], float(weight[top] / total),
               [(a, b - 1, model.languages[own[a]]) for a, b in zip(edges, edges[1:])])


def blocks(texts: list[str]):
    """Slices of texts with about ``BLOCK_WORDS`` words together."""
    start = total = 0
    for i, t in enumerate(texts):
        total += t.count(" ") + t.count("\n") + 1
        if total >= BLOCK_WORDS:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _labelled(model: Model):
    def run(texts: list[str]) -> pd.DataFrame:
        out = [o for part in blocks(texts) for o in label_texts(model, texts[part])]
        return pd.DataFrame({
            "lang_pred": [o[0] for o in out], "score": [o[1] for o in out],
            "spans": [",".join(f"{name}:{a}:{b}" for a, b, name in o[2]) for o in out]})
    return run


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                  id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Learn every language of ``lang_col`` from about ``train_docs`` of its documents.

    The sample follows the hash of the id; null languages and texts teach nothing.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.col(f"`{lang_col}`").cast("string").alias("lang")).dropna(subset=["text", "lang"])
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
             .limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    if not sizes:
        return train({})
    share = F.create_map(*[F.lit(x) for name, n in sizes.items()
                           for x in (name, int(HASH_SPACE * min(1.0, train_docs / n)))])
    chosen = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(HASH_SPACE)) < share[F.col("lang")]
    samples: dict[str, list[str]] = {name: [] for name in sizes}
    bound = 2 * sum(min(n, train_docs) for n in sizes.values())
    for row in at_most(rows.filter(chosen).select("lang", "text"), bound).collect():
        samples[row.lang].append(row.text)
    return train(samples)


def with_language(docs: DataFrame, model: Model, text_col: str = "text",
                  name: str = "__language") -> DataFrame:
    """``docs`` with a struct of lang_pred, score and spans as its last column.

    ``lang_pred`` has the most letters of the text; ``score`` is its share of all letters.
    Null and empty texts and texts without a letter are ``und`` with score 0 and no spans, as
    is every text when nothing was learned. Spans are ``language:first word:last word``, comma
    joined. Repeated rows get equal results, texts are read whole, an empty table stays empty.
    """
    return with_struct(docs, name, _labelled(model), text_col,
                       "lang_pred string, score double, spans string")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every row, as of ``with_language``; other columns are ignored."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = with_language(rows, model, "text")
    return out.select(F.col("id").alias(id_col), "__language.*")
