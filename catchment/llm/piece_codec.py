"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (stretches of text that no piece crosses) are concatenated and
indexed by a suffix array, as deep as the longest piece. Every piece is looked up in it by
binary search, which gives all its occurrences; these are the edges of a lattice over the
text, sorted by position and then relaxed from left to right.

The models merge the best-scored pair of neighbours first. A prefix then has just one
encoding, and an edge continues the one before it exactly if the two pieces, merged on their
own, come out as the same two pieces. So a position is reached by the first edge that fits.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, with_struct

SPACE = "▁"
UNIT_CACHE = 150_000  # units of a generation, of eight characters on average at most
PAIR_CACHE = 1_000_000
NONE = -1
BATCH_POINTS = 500_000  # characters of one suffix array, but for a longer unit
BLOCK_CHARS = 2_000_000


class Codec:
    """Encoder and decoder of one model file; one per Python worker."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = model.normalize
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte = {i: int(self.text[i][3:-1], 16) for i in range(size) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.unknown = model.unk_id()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.hidden = special
        plain = [i for i in range(size) if i not in self.byte and i not in special
                 and not model.is_unused(i)]
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        # Pieces that merging makes, then the characters of pieces that are none themselves.
        ids = {self.text[i]: i for i in plain if self.merged(self.text[i]) == [self.text[i]]}
        self.pieces = sorted(ids, key=len)
        self.pieces += sorted({c for p in self.pieces for c in p} - set(self.pieces))
        self.ids = np.array([ids.get(p, -1) for p in self.pieces], dtype=np.int64)
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.depth = int(self.lengths.max(initial=1))
        self.spelt = np.zeros((len(self.pieces), self.depth), dtype=np.uint32)  # code points, then zeros
        for row, p in enumerate(self.pieces):
            self.spelt[row, :len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # Where the characters of a boundary stand together in no piece, nothing crosses it.
        plain_text = [self.text[i] for i in plain]
        inside = {c for p in plain_text if len(p) > 1 for c in p}
        crosses = any(SPACE in p.lstrip(SPACE) for p in plain_text)
        alone = "\n" if "\n" not in inside else ""
        self.units = (re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else ""))
                      if not crosses else re.compile(r"(?s).+"))
        self.shown = ["" if i in special else t for i, t in enumerate(self.text)]
        self.odd = np.zeros(size, dtype=bool)  # numbers of bytes, which only decode together
        self.odd[list(self.byte)] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs = np.zeros(0, dtype=np.int64)  # sorted; of the numbers of two pieces
        self.fits = np.zeros(0, dtype=bool)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first, leftmost on a tie."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces may stand behind others (NONE: the start, or a character alone).

        Pairs seen before are looked up; new ones are merged, each once.
        """
        pair = before * len(self.pieces) + piece
        at = np.searchsorted(self.pairs, pair)
        known = np.zeros(len(pair), dtype=bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == pair[inside]
        new = np.unique(pair[~known & (before != NONE)])
        if len(new):
            fit = np.empty(len(new), dtype=bool)
            for i, (x, y) in enumerate(zip(*(v.tolist() for v in np.divmod(new, len(self.pieces))))):
                x, y = self.pieces[x], self.pieces[y]
                fit[i] = self.merged(x + y) == [x, y]
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, place, new), np.insert(self.fits, place, fit)
            at = np.searchsorted(self.pairs, pair)
        return (before == NONE) | self.fits[np.minimum(at, len(self.fits) - 1)] if len(self.fits) else before == NONE

    def edges(self, points: np.ndarray):
        """(start, end, piece number) of all occurrences of pieces in ``points``, by position.

        ``points`` holds code points, a zero behind each unit. Ranks replace code points, the
        suffixes are sorted by their first ``depth`` ranks in doubling rounds, and two binary
        searches for each piece find its range.
        """
        alphabet, rank = np.unique(points, return_inverse=True)
        rank = rank.astype(np.int64) + (alphabet[0] != 0)  # a zero stays rank 0
        order_of = rank
        reach = 1
        while reach < self.depth:
            shifted = np.zeros_like(order_of)
            shifted[:-reach] = order_of[reach:]
            order_of = np.unique(order_of * (len(points) + 2) + shifted, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        suffixes = np.argsort(order_of, kind="stable")
        kind = ">u4" if len(alphabet) > 65_000 else ">u2"
        top = np.iinfo(np.dtype(kind)).max
        wide = np.zeros(len(points) + self.depth, dtype=kind)
        wide[:len(points)] = rank
        width = self.depth * np.dtype(kind).itemsize
        keys = np.lib.stride_tricks.sliding_window_view(wide, self.depth)[suffixes].view(f"S{width}").ravel()

        # Pieces in ranks; only those whose characters all occur can be found.
        place = np.minimum(np.searchsorted(alphabet, self.spelt), len(alphabet) - 1)
        inside = self.spelt > 0
        known = np.flatnonzero(((alphabet[place] == self.spelt) | ~inside).all(1))
        inside = inside[known]
        low = np.where(inside, place[known] + (alphabet[0] != 0), 0).astype(kind)
        high = np.where(inside, low, top).astype(kind)
        first = np.searchsorted(keys, low.view(f"S{width}").ravel(), "left")
        last = np.searchsorted(keys, high.view(f"S{width}").ravel(), "right")
        count = last - first
        which = np.repeat(known, count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = suffixes[np.repeat(first, count) + offset]
        return start, start + self.lengths[which], which

    def relax(self, units: list[str]) -> list[bytes]:
        """Piece numbers of each unit, as bytes of 32-bit integers.

        All units advance together: the edges are sorted by their end within the unit, then by
        unit, the longest first, and every end takes its first edge that fits.
        """
        points = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0",
                               dtype=np.uint32)
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        origin = np.repeat(begin, sizes + 1)
        start, end, which = self.edges(points)
        within = end - origin[end]
        order = np.argsort((within * (len(points) + 1) + end) * 64 - np.minimum(end - start, 63), kind="stable")
        start, end, which, within = start[order], end[order], which[order], within[order]
        # Default: a character that is no piece.
        last = np.full(len(points) + 1, NONE, dtype=np.int64)
        came = np.arange(len(points) + 1) - 1
        bounds = np.searchsorted(within, np.arange(int(sizes.max(initial=0)) + 2))
        if len(self.pairs) > PAIR_CACHE:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        for lo, hi in zip(bounds[1:], bounds[2:]):
            if lo < hi:
                fit = np.flatnonzero(self.follows(last[start[lo:hi]], which[lo:hi])) + lo
                if len(fit):
                    fit = fit[np.append(True, end[fit][1:] != end[fit][:-1])]
                    last[end[fit]] = which[fit]
                    came[end[fit]] = start[fit]
        used = np.zeros(len(points) + 1, dtype=bool)
        place = begin + sizes
        live = sizes > 0
        while live.any():
            used[place[live]] = True
            place[live] = came[place[live]]
            live &= place > begin
        ends = np.flatnonzero(used)
        numbers = np.where(last[ends] == NONE, -1, self.ids[np.maximum(last[ends], 0)])
        ends, numbers = self._spell(points, ends, numbers)
        cut = np.searchsorted(ends, np.append(begin, len(points) + 1), "right")
        numbers = numbers.astype("<i4").tobytes()
        return [numbers[4 * a:4 * b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def _spell(self, points: np.ndarray, ends: np.ndarray, numbers: np.ndarray):
        """Characters without a piece become their bytes' pieces, or the unknown one."""
        odd = np.flatnonzero(numbers < 0)
        if not len(odd):
            return ends, numbers
        lists = [[self.of_byte[b] for b in chr(points[e - 1]).encode("utf-8", "replace")]
                 if self.of_byte else [self.unknown] for e in ends[odd]]
        repeat = np.ones(len(ends), dtype=np.int64)
        repeat[odd] = [len(x) for x in lists]
        fill = np.repeat(numbers, repeat)
        fill[fill < 0] = np.concatenate(lists)
        return np.repeat(ends, repeat), fill

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece numbers of whole texts; a zero character splits units, since it is no piece.

        Units used lately are kept: when one generation of them is full, the one before it goes.
        """
        split = [self.units.findall(self.normalise(t)) if t else [] for t in texts]
        known, older = self.cache, self.older
        asked = {u for units in split for u in units if u not in known}
        block, total = [], 0
        for unit in [*asked, None]:
            if unit in older:
                known[unit] = older[unit]
                continue
            if unit is None or total > BATCH_POINTS:
                if block:
                    known.update(zip(block, self.encode_units(block)))
                block, total = [], 0
            if unit is not None:
                block.append(unit)
                total += len(unit) + 1
        out = [b"".join(map(known.__getitem__, units)) for units in split]
        if len(known) > UNIT_CACHE or sum(map(len, asked)) > UNIT_CACHE * 8:
            self.older = known if len(known) <= 2 * UNIT_CACHE else {}
            self.cache = {}
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        if not any("\0" in u for u in units):
            return self.relax(units)
        parts = [u.split("\0") for u in units]
        flat = self.relax([p or "\1" for part in parts for p in part])
        zero = np.array([self.of_byte.get(0, self.unknown)], dtype="<i4").tobytes()
        out, at = [], 0
        for part in parts:
            out.append(zero.join(x if p else b"" for p, x in zip(part, flat[at:at + len(part)])))
            at += len(part)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece numbers; bytes that are no UTF-8 become replacement characters."""
        ids = np.asarray(ids, dtype=np.int64)
        shown = self.shown.__getitem__
        at = np.flatnonzero(self.odd[ids])
        # Neighbouring bytes, with hidden pieces between them or not, decode together.
        out, done, plain = [], 0, ids.tolist()
        pending = bytearray()
        for i in at.tolist():
            between = "".join(map(shown, plain[done:i])) if i > done else ""
            if between or any(p not in self.hidden for p in plain[done:i]):
                out += [pending.decode("utf-8", "replace"), between]
                pending.clear()
            pending.append(self.byte[plain[i]])
            done = i + 1
        out += [pending.decode("utf-8", "replace"), *map(shown, plain[done:])]
        whole = "".join(out).replace(SPACE, " ")
        return whole[1:] if whole[:1] == " " else whole


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _blocks(texts: list[str]):
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BLOCK_CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _coded(path: str):
    def run(texts: list[str]) -> pd.DataFrame:
        own = codec(path)
        ids: list[np.ndarray] = []
        for a, b in _blocks(texts):
            ids += [np.frombuffer(r, dtype="<i4") for r in own.encode(texts[a:b])]
        return pd.DataFrame({
            "n_pieces": [len(i) for i in ids], "piece_ids": ids,
            "round_trip": [own.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts)]})
    return run


def _digested(path: str):
    def run(texts: list[str]) -> pd.DataFrame:
        frame = _coded(path)(texts)
        frame["ids_sha256"] = [hashlib.sha256(i.tobytes()).hexdigest() for i in frame.pop("piece_ids")]
        return frame[["n_pieces", "ids_sha256", "round_trip"]]
    return run


def with_pieces(docs: DataFrame, model: str, text_col: str = "text", name: str = "__pieces") -> DataFrame:
    """``docs`` with a struct of n_pieces, piece_ids and round_trip as its last column.

    Pieces are numbered as the model's own library does. ``round_trip`` tells whether decoding
    gives the text again; the model's own space mark reads as a blank. Null and empty texts
    have no pieces; repeated rows give equal rows; an empty table stays empty. Texts are read
    whole: a unit without a boundary costs time linear in its length.
    """
    return with_struct(docs, name, _coded(model), text_col,
                       "n_pieces long, piece_ids array<int>, round_trip boolean")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, piece_ids, round_trip) of every row, as of ``with_pieces``; other columns are ignored."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return with_pieces(rows, model).select(F.col("id").alias(id_col), "__pieces.*")


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with ids_sha256, the digest of the numbers as 32-bit little-endian integers,
    in place of the numbers."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = with_struct(rows, "__pieces", _digested(model), "text",
                      "n_pieces long, ids_sha256 string, round_trip boolean")
    return out.select(F.col("id").alias(id_col), "__pieces.*")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """(id, text) from piece numbers; null and empty lists give empty texts."""
    def run(batches):
        own = codec(model)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [
                "" if ids is None else own.decode(list(ids)) for ids in batch["ids"]]})

    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return map_pandas(rows, run, "id long, text string").withColumnRenamed("id", id_col)
