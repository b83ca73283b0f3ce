"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two units (words, as written) counts the subsequences of three characters they
share, each weighted by the decay to the power of the stretch it takes up in either: an insult
with characters put between its letters keeps most of its kernel value. Normalised values are
raised to a power, which is a kernel again, and that of two sentences is the sum over pairs of
their distinct units. Landmark units give the Nyström map; a linear machine is trained on its images.

Sentences carry their document's label. In a toxic document most sentences are clean, so only
its most suspicious sentences count as toxic: first by the odds of their units, then, in a
second round, by the machine itself. A document scores as its worst sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain, combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, bounded_sample, map_pandas, pieces, whole_text

TRAIN_TOXIC, TRAIN_CLEAN = 1500, 3000  # documents learned from, about
CLEAN_SENTENCES = 15_000  # about
INSULTS, NEAR, HARD = 80, 16, 48  # landmarks: suspects, clean units like them, clean units mistaken for them
ORDINARY, HARD_UNITS = 50_000, 3000  # clean units searched for, and used as, mistakes
DECAY = 0.75
SPAN = 8  # characters that a subsequence may stretch over
POWER = 5
WINDOW, STRIDE = 24, 12  # units longer than a window are read in windows
MIN_ODDS = 2.0
CHUNK = 400  # units whose subsequences are held at a time
SENTENCES = 1500  # mapped at a time in training
ALPHABET = 80
MARK = "^"
UNIT_CACHE = 400_000
BATCH_CHARS = 2_000_000

_SINGLES = re.compile(r"(?<!\S)[^\W\d_](?:\s[^\W\d_]){2,}(?!\S)")
_ENDS = (".", "!", "?")


def tokens(text: str) -> list[str]:
    """Units as written; a run of three or more single letters is one, a line break ends one."""
    text = text.lower()
    if "\n" in text:
        text = text.replace("\n", " . ")
    if _SINGLES.search(text):
        text = _SINGLES.sub(lambda m: "".join(m[0].split()), text)
    return text.split()


def unit(token: str) -> str:
    """A token without what is neither letter nor digit at its ends."""
    a, b = 0, len(token)
    if token[0].isalnum() and token[-1].isalnum():
        return token
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def windows(u: str) -> list[str]:
    """A unit with its start marked, in windows if it is long."""
    if len(u) <= WINDOW:
        return [MARK + u]
    return [(MARK if i == 0 else "") + u[i:i + WINDOW] for i in range(0, len(u) - WINDOW + STRIDE, STRIDE)]


_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a unit of this length, and their weights."""
    if length not in _triples:
        places = np.array([t for t in combinations(range(length), 3) if t[2] - t[0] < SPAN],
                          dtype=np.int64).reshape(-1, 3)
        _triples[length] = places, (DECAY ** (places[:, 2] - places[:, 0] + 1)).astype(np.float32)
    return _triples[length]


@dataclass
class Kernel:
    """Subsequence kernel of units against landmarks."""
    alphabet: dict[str, int]
    landmarks: list[str] = field(default_factory=list)
    row: np.ndarray = None  # code of a subsequence to its number, or -1
    first: np.ndarray = None  # where the landmarks with a subsequence begin
    count: np.ndarray = None  # how many they are
    holder: np.ndarray = None  # those landmarks
    weight: np.ndarray = None  # and its weight in them, normalised

    def codes(self, units: list[str]):
        """(numbers of the units, codes, weights) of their subsequences, by length of the unit."""
        size = len(self.alphabet) + 2
        number = np.zeros(max(map(ord, self.alphabet), default=0) + 2, dtype=np.int64)
        for c, n in self.alphabet.items():
            number[ord(c)] = n
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = number[np.minimum(points, len(number) - 1)]
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        for length in np.unique(lengths):
            places, weight = triples(int(length))
            if not len(places):
                continue
            which = np.flatnonzero(lengths == length)
            for at in range(0, len(which), CHUNK):
                part = which[at:at + CHUNK]
                letter = letters[starts[part][:, None] + np.arange(length)]
                a, b, c = (letter[:, places[:, i]] for i in range(3))
                code = (a * size + b) * size + c
                # A character outside the alphabet is a gap: nothing shares it.
                code[(a == 0) | (b == 0) | (c == 0)] = -1
                yield part, code, weight

    def image(self, units: list[str]) -> list[dict[int, float]]:
        """Normalised weights of the subsequences of a few units."""
        out = [{} for _ in units]
        for which, code, weight in self.codes(units):
            for i, row in zip(which, code):
                for c, w in zip(row.tolist(), weight.tolist()):
                    if c >= 0:
                        out[i][c] = out[i].get(c, 0.0) + w
        for i, image in enumerate(out):
            size = sum(v * v for v in image.values()) ** 0.5
            out[i] = {c: v / size for c, v in image.items()}
        return out

    def prepare(self, landmarks: list[str]):
        self.landmarks = landmarks
        images = self.image(landmarks)
        entries = sorted((c, j, v) for j, image in enumerate(images) for c, v in image.items())
        codes = np.array([e[0] for e in entries], dtype=np.int64)
        found, self.first = np.unique(codes, return_index=True)
        self.first = np.append(self.first, len(codes))
        self.count = np.diff(self.first)
        self.row = np.full((len(self.alphabet) + 2) ** 3 + 1, -1, dtype=np.int32)  # the last one is for code -1
        self.row[found] = np.arange(len(found))
        self.holder = np.array([e[1] for e in entries], dtype=np.int64)
        self.weight = np.array([e[2] for e in entries])

    def values(self, units: list[str]) -> np.ndarray:
        """Powers of the normalised kernel, (units x landmarks)."""
        out = np.zeros((len(units), len(self.landmarks)), dtype=np.float32)
        for which, code, weight in self.codes(units):
            row = self.row[code]
            hit, place = np.nonzero(row >= 0)
            if not len(hit):
                continue
            number = row[hit, place]
            count = self.count[number]
            entry = np.repeat(self.first[number] - np.cumsum(count) + count, count)
            entry += np.arange(len(entry))
            cell = np.repeat(hit * len(self.landmarks), count)
            cell += self.holder[entry]
            product = np.repeat(weight[place], count) * self.weight[entry]
            total = np.bincount(cell, weights=product,
                                minlength=len(which) * len(self.landmarks)).reshape(len(which), -1)
            own = np.flatnonzero((row >= 0).any(axis=1))
            out[which[own]] = total[own] / self.norms(code[own], weight)[:, None]
        np.minimum(out, 1, out=out)
        out **= POWER
        return out

    @staticmethod
    def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        order = np.argsort(code, axis=1)
        code = np.take_along_axis(code, order, axis=1)
        weight = np.where(code >= 0, weight[order], 0)
        new = np.ones(code.shape, dtype=bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        starts = np.flatnonzero(new.ravel())
        total = np.add.reduceat(weight.ravel(), starts)
        return np.sqrt(np.bincount(starts // code.shape[1], weights=total**2, minlength=len(code)))


class Numbers(dict):
    """Numbers of tokens in the order in which they are first asked for."""

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        return number


@dataclass
class Machine:
    kernel: Kernel | None = None
    weights: np.ndarray = None  # of the landmarks
    bias: float = 0.0
    slope: float = 1.0  # of the logistic curve from margin to score
    offset: float = 0.0
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def unit_values(self, units: list[str]) -> np.ndarray:
        """What each unit adds to its sentence: of long ones, the worst window."""
        out = [np.zeros(0)]
        for at in range(0, len(units), 20_000):
            split = [windows(u) for u in units[at:at + 20_000]]
            value = self.kernel.values([w for ws in split for w in ws]) @ self.weights
            out.append(np.maximum.reduceat(value, np.cumsum([0, *map(len, split)])[:-1]))
        return np.concatenate(out)

    def learn(self, before: int):
        """Values and ends of the tokens numbered from ``before`` on. Tokens that differ only at
        their ends have one unit, which is a token too and evaluated once."""
        known, cache = self.cache["row"], self.cache
        new = list(islice(known, before, None))
        own = np.fromiter(map(known.__getitem__, map(unit, new)), dtype=np.int64, count=len(new))
        names = list(islice(known, before, None))
        need = np.unique(own[own >= before])
        value = np.append(cache["value"], np.zeros(len(names), dtype=np.float32))
        value[need] = self.unit_values([names[i] for i in (need - before).tolist()])
        value[before:before + len(new)] = value[own]
        cache["value"] = value
        cache["end"] = np.append(cache["end"], [t.endswith(_ENDS) for t in names])

    def margins(self, texts: list[str]) -> np.ndarray:
        """The worst sentence's margin for each text; without a token, that of an empty one."""
        cache = self.cache
        if "row" not in cache or len(cache["row"]) > UNIT_CACHE:
            cache["row"], cache["value"] = Numbers(), np.zeros(0, dtype=np.float32)
            cache["end"] = np.zeros(0, dtype=bool)
        known = cache["row"]
        before = len(known)
        split = [tokens(t) for t in texts]
        lengths = np.array([len(ts) for ts in split], dtype=np.int64)
        out = np.full(len(texts), self.bias)
        some = np.flatnonzero(lengths)
        if not len(some):
            return out
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=lengths.sum())
        del split
        if len(known) > before:
            self.learn(before)
        starts = (np.cumsum(lengths) - lengths)[some]
        begins = np.append(True, cache["end"][ids[:-1]])  # a sentence
        begins[starts] = True
        number = np.cumsum(begins) - 1
        pair = np.sort(number << 32 | ids)
        pair = pair[np.append(True, pair[1:] != pair[:-1])]  # each token once in a sentence
        total = np.bincount(pair >> 32, weights=cache["value"][pair & 0xFFFFFFFF])
        out[some] = np.maximum.reduceat(total, number[starts]) + self.bias
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.kernel is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -50, 50)))


def sentences(text: str) -> list[list[str]]:
    out, own = [], []
    for t in tokens(text):
        own.append(t)
        if t.endswith(_ENDS):
            out.append(own)
            own = []
    return [*out, own] if own else out


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 250, strength: float = 1e-4):
    """Squared hinge loss by accelerated gradient steps; toxic examples count twice."""
    weight = (np.where(y > 0, 2.0, 1.0) / len(y)).astype(np.float32)
    x1 = np.append(x, np.ones((len(x), 1)), axis=1).astype(np.float32)
    weighted = x1.T * weight
    limit = 2 * np.linalg.eigvalsh((weighted @ x1).astype(float))[-1] + strength
    w = last = np.zeros(x1.shape[1])
    for t in range(rounds):
        at = w + t / (t + 3) * (w - last)
        slack = np.maximum(0, 1 - y * (x1 @ at.astype(np.float32)))
        gradient = -2 * (weighted @ (y * slack).astype(np.float32)) + strength * np.append(at[:-1], 0)
        last, w = w, at - gradient / limit
    return w[:-1], float(w[-1])


def fit_curve(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic curve through margins and smoothed labels, ``share`` of which are toxic."""
    x = np.clip(margin, -3, 3)
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum())
    slope, offset = 2.0, -2.0
    for _ in range(5000):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        error = weight * (p - np.where(y > 0, 0.99, 0.01))
        slope, offset = max(slope - 3.0 * (error @ x), 0.5), offset - 3.0 * error.sum()
    return float(slope), float(offset)


def stretched(word: str, seed: int) -> str:
    """The word with a character put between two of its letters, or one of them doubled."""
    place = 1 + seed // 2 % max(len(word) - 1, 1)
    return word[:place] + (word[place - 1] if seed % 3 == 0 else ".x-1"[seed % 4]) + word[place:]


def train(toxic: list[str], clean: list[str], share: float = 0.2) -> Machine:
    """A machine from texts of either label, ``share`` of all being toxic; without both, one that scores 0."""
    if not toxic or not clean:
        return Machine()
    count = [Counter(), Counter()]
    for label, texts in enumerate((clean, toxic)):
        for text in texts:
            count[label].update({unit(t) for t in tokens(text)} - {""})
    odds = {u: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((count[0][u] + 0.5) / (len(clean) + 1))
            for u, n in count[1].items() if n >= 3 and len(u) >= 3}
    letters = Counter()
    for side in count:
        for u, n in side.items():
            for c in u:
                if c.isalnum():  # all else is a gap
                    letters[c] += n
    kernel = Kernel({c: i + 1 for i, (c, _) in enumerate(letters.most_common(ALPHABET))})
    kernel.alphabet[MARK] = len(kernel.alphabet) + 1

    # Landmarks: the units with the highest odds, weighted by how much they explain, that are not
    # near copies of earlier ones; then the clean units that look most like them.
    ranked = sorted((u for u in odds if odds[u] >= MIN_ODDS), key=lambda u: (-odds[u] * count[1][u], u))
    chosen: list[str] = []
    images: list[dict] = []
    ranked = [MARK + u for u in ranked[:600]]
    for u, image in zip(ranked, kernel.image(ranked)):
        if len(chosen) == INSULTS:
            break
        if all(sum(v * other.get(c, 0) for c, v in image.items()) < 0.95 for other in images):
            chosen.append(u)
            images.append(image)
    if not chosen:
        return Machine()
    kernel.prepare(chosen)
    ordinary = [MARK + u for u in sorted(
        (u for u, n in count[0].items() if 3 <= len(u) <= WINDOW and odds.get(u, 0) < 0.5),
        key=lambda u: (-count[0][u], u))[:ORDINARY]]
    like = kernel.values(ordinary).max(1) if ordinary else np.zeros(0)
    near = [ordinary[i] for i in np.argsort(-like, kind="stable")[:NEAR]]
    kernel.prepare(chosen + near)

    chance = CLEAN_SENTENCES / max(1, sum(1 + sum(map(text.count, _ENDS)) for text in clean))
    draw = np.random.default_rng(5)
    negative = [marked_units(s) for text in clean for s in sentences(text) if draw.random() < chance]
    positive = []
    for text in toxic:
        for s in sentences(text):
            worst = max(s, key=lambda t: odds.get(unit(t), -9.0))
            if odds.get(unit(worst), -9.0) >= MIN_ODDS:
                positive.append(marked_units(s))
                positive.append(marked_units([stretched(unit(t), len(positive)) if t == worst else t for t in s]))
    if not positive:
        return Machine()
    machine = Machine()
    for last in (False, True):
        root = whitening(kernel)
        x_pos, x_neg = (sentence_images(kernel, root, many) for many in (positive, negative))
        x = np.concatenate([x_pos, x_neg])
        w, bias = fit_linear(x, np.repeat([1.0, -1.0], [len(x_pos), len(x_neg)]))
        machine = Machine(kernel, root @ w, bias)
        if last:
            break
        # The clean units that the machine takes for insults become examples and landmarks, and
        # it keeps only the toxic sentences that it believes in.
        value = kernel.values(ordinary) @ machine.weights if ordinary else np.zeros(0)
        hard = [ordinary[i] for i in np.argsort(-value, kind="stable")[:HARD_UNITS] if value[i] > 0.2]
        negative += [[u] for u in hard]
        believed = x_pos @ w + bias > -0.5
        positive = [s for s, keep in zip(positive, believed) if keep] or positive
        kernel.prepare(list(dict.fromkeys(chosen + near + hard[:HARD])))
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    texts = toxic + clean
    margin = [machine.margins(texts[part]) for part in pieces(texts, BATCH_CHARS // 4)]
    machine.slope, machine.offset = fit_curve(np.concatenate(margin), y, share)
    machine.cache.clear()
    return machine


def marked_units(sentence: list[str]) -> list[str]:
    return [w for u in dict.fromkeys(map(unit, sentence)) for w in windows(u)]


def whitening(kernel: Kernel) -> np.ndarray:
    """The inverse root of the landmarks' own kernel matrix."""
    own = kernel.values(kernel.landmarks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T


def sentence_images(kernel: Kernel, root: np.ndarray, many: list[list[str]]) -> np.ndarray:
    """Nyström images: the sum of the units' images, some sentences at a time."""
    root = root.astype(np.float32)
    out = np.empty((len(many), root.shape[1]), dtype=np.float32)
    for at in range(0, len(many), SENTENCES):
        part = many[at:at + SENTENCES]
        distinct = {u: i for i, u in enumerate(dict.fromkeys(w for s in part for w in s))}
        mapped = kernel.values(list(distinct)) @ root
        place = np.array([distinct[w] for s in part for w in s], dtype=np.int64)
        owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
        for j in range(out.shape[1]):
            out[at:at + len(part), j] = np.bincount(owner, weights=mapped[place, j], minlength=len(part))
    return out


def fit_machine(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "toxic", train_toxic: int = TRAIN_TOXIC,
                train_clean: int = TRAIN_CLEAN) -> Machine:
    """Train on about so many toxic and clean labelled documents, chosen by the hash of the id.

    A document labelled more than once is toxic if any label says so; null labels and labels of
    unknown documents teach nothing.
    """
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
             .dropna().groupBy("id").agg(F.max("label").alias("label")))
    texts, sizes = [], []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for keep, bound in ((F.col("label") > 0, train_toxic), (F.col("label") <= 0, train_clean)):
        # At most twice the bound of ids, hence small enough to broadcast.
        ids = known.filter(keep).select("id")
        sizes.append(ids.count())
        chosen = bounded_sample(ids, F.col("id"), bound)
        found = at_most(rows.join(F.broadcast(chosen), F.col("doc") == F.col("id"), "left_semi")
                        .dropna(subset=["text"]), 2 * bound)
        texts.append(sorted(r.text for r in found.select("text").collect()))
    return train(*texts, share=sizes[0] / max(sum(sizes), 1))


def _apply(machine: Machine):
    def run(batches):
        for batch in batches:
            texts = batch["text"].tolist()
            score = [machine.scores(texts[part]) for part in pieces(texts, BATCH_CHARS)] if texts else []
            yield pd.DataFrame({"id": batch["id"], "score": np.concatenate(score) if score else []})
    return run


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row: how likely the text is toxic, 1 from 0.5 on.

    Null and empty texts score as a text without a sentence. A machine that had nothing to
    learn from scores 0. Repeated rows get equal scores, other columns are ignored, texts are
    read whole, whatever their length.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text"))
    out = map_pandas(rows, _apply(machine), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
