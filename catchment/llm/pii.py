"""Personal data: fixed patterns, and a skip-chain conditional random field on top of them.

Nodes are the tokens that hold a digit or an at sign. Neighbouring tokens share a transition
potential (the chain); occurrences of one token, or of one long digit sequence, anywhere in
the document share a consistency potential (the skips). Loopy sum-product messages run until
they settle, and tokens labelled with confidence outside the fixed patterns become spans.

The field is trained piecewise on a bounded sample: node weights by multinomial logistic
regression against the labels of the fixed patterns, both kinds of edges by the log ratio of
joint to independent label counts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_pandas, whole_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_DOCS = 3000
SWEEPS = 30
DAMPING = 0.5
CONFIDENCE = 0.9
BATCH_NODES = 200_000
SKIP_PRIOR = 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_OUTER = " \t\n\r.,;:!?\"'()[]{}<>|*$%&#"
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs: linear in the text.

    A local part holds no at sign, so the first match ends its local part at the first at
    sign that has one before it (after the last match) and a domain behind it.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _MARK.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def features(token: str) -> list[int]:
    """Numbers of the active features of a token; the last of ``N_FEATURES`` is the bias."""
    digits = sum("0" <= c <= "9" for c in token)
    core = token.strip(_OUTER)
    return [
        int(np.searchsorted((1, 2, 4, 6, 8, 11, 14, 20), digits, side="right")),  # 0-8
        9 + min(token.count("."), 4),  # 9-13
        14 + min(token.count("-"), 3),  # 14-17
        18 + (2 if "@" in token[1:-1] else int("@" in token)),  # 18-20
        21 + int(token.startswith("+")),  # 21-22
        23 + int(any(c.isalpha() for c in token)),  # 23-24
        25 + int(token.startswith("(") or token.endswith(")")),  # 25-26
        27 + int(digits == len(core)),  # 27-28
        29 + int(bool(_IP.fullmatch(core))),  # 29-30
        31,
    ]


N_FEATURES = 32


@dataclass
class Field:
    nodes: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log potential
    skip: np.ndarray


def graph(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Token spans, chain edges and skip edges of one text.

    Each occurrence of a repeated token is linked with the one before it, so that n copies
    make n - 1 edges and all of them still share one label through the messages.
    """
    spans, chain, skip = [], [], []
    last_end, seen = -2, {}
    for m in _TOKEN.finditer(text):
        if not _MARK.search(m[0]):
            continue
        n = len(spans)
        spans.append(m.span())
        if n and last_end + 1 >= m.start():
            chain.append((n - 1, n))
        last_end = m.end()
        keys = {("t", m[0].strip(_OUTER).lower())}
        digits = "".join(c for c in m[0] if "0" <= c <= "9")
        if len(digits) >= 6:
            keys.add(("d", digits))
        linked = {seen[k] for k in keys if k in seen}
        skip += [(before, n) for before in linked if (before, n) not in chain[-1:]]
        for k in keys:
            seen[k] = n
    return spans, chain, skip


def token_labels(spans, base) -> list[int]:
    """Label of each token: the kind of the first base span that it overlaps."""
    out, at = [], 0
    ends = sorted(base, key=lambda b: b[2])
    for s, e in spans:
        while at < len(ends) and ends[at][2] <= s:
            at += 1
        hit = [b for b in ends[at:at + 8] if b[0] < e and b[2] > s]
        out.append(1 + min(hit)[1] if hit else 0)
    return out


def train(texts: list[str]) -> Field:
    """Piecewise training on the labels of the fixed patterns."""
    rows, labels = [], []
    # Repeats are rare in some corpora: the skips start out believing in one label.
    joint = {"chain": np.ones((5, 5)), "skip": np.ones((5, 5)) + SKIP_PRIOR * np.eye(5)}
    for text in texts:
        spans, chain, skip = graph(text)
        own = token_labels(spans, base_spans(text))
        rows += [features(text[s:e]) for s, e in spans]
        labels += own
        for name, edges in (("chain", chain), ("skip", skip)):
            for a, b in edges:
                joint[name][own[a], own[b]] += 1
    weights = np.zeros((N_FEATURES, 5))
    weights[-1, 0] = 2.0  # without examples, nothing is personal data
    if rows:
        x = np.zeros((len(rows), N_FEATURES))
        x[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)] = 1
        y = np.eye(5)[labels]
        step = 4.0 / x.shape[1]
        speed = np.zeros_like(weights)
        for _ in range(400):
            score = x @ weights
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed + x.T @ (y - p) / len(rows) - 1e-4 * weights
            weights = weights + step * speed
    def ratio(counts):
        p = counts / counts.sum()
        return np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))
    skip = ratio(joint["skip"] + joint["skip"].T)
    return Field(weights, np.clip(ratio(joint["chain"]), -3, 3), np.clip(skip, -3, 3))


def beliefs(field: Field, node_scores: np.ndarray, edges: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product over all documents of a batch at once.

    ``edges`` are (a, b) node numbers, ``kinds`` 0 for chain and 1 for skip. Messages are in
    logs, damped, and stop when none moves by more than 0.001 or after ``SWEEPS`` sweeps.
    """
    total = node_scores.copy()
    if len(edges):
        potential = np.stack([field.chain, field.skip])[kinds]
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), 5))
        for _ in range(SWEEPS):
            total = node_scores.copy()
            np.add.at(total, target, message)
            cavity = total[source] - message[back]
            joint = cavity[:, :, None] + potential
            top = joint.max(1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(joint - top).sum(1))
            new -= new.max(1, keepdims=True)
            new = DAMPING * message + (1 - DAMPING) * new
            moved = np.abs(new - message).max()
            message = new
            if moved < 1e-3:
                break
        total = node_scores.copy()
        np.add.at(total, target, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, spans, base, belief: np.ndarray) -> list[tuple[int, int, int]]:
    """Confidently labelled tokens that overlap no base span, neighbours of one kind merged."""
    out = []
    covered = iter(sorted((b[0], b[2]) for b in base))
    blocks: list[list[int]] = []
    for s, e in covered:
        if blocks and s <= blocks[-1][1]:
            blocks[-1][1] = max(e, blocks[-1][1])
        else:
            blocks.append([s, e])
    at = 0
    for (s, e), p in zip(spans, belief):
        label = int(p.argmax())
        if not label or p[label] < CONFIDENCE:
            continue
        while at < len(blocks) and blocks[at][1] <= s:
            at += 1
        if at < len(blocks) and blocks[at][0] < e:
            continue
        token = text[s:e]
        s, e = s + len(token) - len(token.lstrip(_OUTER)), e - len(token) + len(token.rstrip(_OUTER))
        if s >= e:
            continue
        if out and out[-1][1] == label - 1 and not text[out[-1][2]:s].strip(_OUTER):
            out[-1] = (out[-1][0], label - 1, e)
        else:
            out.append((s, label - 1, e))
    return out


def find(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; the graphs of a block of texts run together."""
    out: list[tuple[list, list]] = [None] * len(texts)
    block, scores, edges, kinds = [], [], [], []
    n = 0

    def flush():
        nonlocal n
        if block:
            p = beliefs(field, np.concatenate(scores), np.array(edges, dtype=int).reshape(-1, 2),
                        np.array(kinds, dtype=int))
            for i, spans, base, at in block:
                out[i] = (base, added_spans(texts[i], spans, base, p[at:at + len(spans)]))
        block.clear(), scores.clear(), edges.clear(), kinds.clear()
        n = 0

    for i, text in enumerate(texts):
        if not _MARK.search(text):
            out[i] = ([], [])
            continue
        base = base_spans(text)
        spans, chain, skip = graph(text)
        active = np.array([features(text[s:e]) for s, e in spans], dtype=int)
        scores.append(field.nodes[active].sum(1))
        edges += [(a + n, b + n) for a, b in chain + skip]
        kinds += [0] * len(chain) + [1] * len(skip)
        block.append((i, spans, base, n))
        n += len(spans)
        if n >= BATCH_NODES:
            flush()
    flush()
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _apply(field: Field):
    def run(batches):
        for batch in batches:
            rows = []
            for i, (base, added) in zip(batch["id"].tolist(), find(field, batch["text"].tolist())):
                counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                rows.append((i, *counts, hashlib.sha256(written(base).encode()).hexdigest(),
                             written(base + added), len(added)))
            yield pd.DataFrame(rows, columns=["id", *[f"n_{k}" for k in KINDS], "base_sha256",
                                              "spans", "n_added"])
    return run


def fit_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              train_docs: int = TRAIN_DOCS) -> Field:
    """Train on about ``train_docs`` texts that hold a digit or an at sign."""
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).alias("text"))
            .filter(F.col("text").rlike("[0-9@]")))
    sample = bounded_sample(rows, F.col("id"), train_docs).select("text").collect()
    return train(sorted(r.text for r in sample))


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per row: the number of base spans by kind, the digest of all base spans, all spans.

    A span is ``kind:start:end`` in code points, end exclusive, ordered by start and then kind.
    Null and empty texts have no spans; repeated rows give equal rows; other columns are
    ignored. Texts are read whole, each in time linear in its length.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text"))
    schema = ("id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
              "spans string, n_added long")
    return map_pandas(rows, _apply(field), schema).withColumnRenamed("id", id_col)
