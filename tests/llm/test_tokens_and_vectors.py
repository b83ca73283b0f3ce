import random

import numpy as np
import pytest
from odd_documents import empty_frame, odd_frame, odd_texts, prose

from catchment.llm import neighbours, piece_codec, token_counts
from catchment.session import scratch_path

P = pytest.importorskip("public_tokenizers")
BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = ["a  b ﬁ", " x", "▁q", "a\x00b", "", "   ", "\n\n", "日本語 テスト😀", "x͸", " ▁▁ ▁", "\x01\x00\x01",
        "<|endoftext|> a<|endoftext|>b", "a　b   c​ d", "it's we'll  'tis\t\tx", "\r\n \r\n", "\x1c x \x1fy"]


def fuzz(n, seed):
    rng = random.Random(seed)
    near = "ab ▁\nthe éß1.!日\x00 '\t  "
    for i in range(n):
        yield "".join(rng.choice(near) if i % 2 else chr(rng.choice(
            (rng.randint(32, 126), rng.randint(32, 0x2ff), rng.randint(0x400, 0x3000)))) for _ in range(rng.randint(1, 60)))


@pytest.fixture(scope="module")
def counted():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(BYTES)
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def test_counts_by_units_equal_the_library(counted):
    texts = [*HARD, *fuzz(4000, 1), prose(1, 3000)]
    assert token_counts.Counter(BYTES).by_unit
    assert token_counts.Counter(BYTES).count(texts) == counted(texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_take_whole_texts(name):
    own = token_counts.Counter(P.path(name))
    assert not own.by_unit
    texts = ["a  b", "", "Hello there"]
    assert own.count(texts) == own.lengths(texts)


def test_cache_encodes_only_misses(spark, frame, counted, monkeypatch):
    cache = scratch_path(spark, "test-cache")
    df = odd_frame(frame)
    want = sorted(zip(map(str, (i for i, *_ in odd_texts())), counted(t or "" for _, t, *_ in odd_texts())))
    first = token_counts.count_tokens(df, cache, BYTES)
    assert sorted((str(r.doc_id), r.n_tokens) for r in first.collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, *_ in odd_texts()}) == stored.select("content").distinct().count()

    more = df.unionByName(frame([(50, "new text", None, None, *[None] * 12)], df.schema))
    second = token_counts.count_tokens(more, cache, BYTES)
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert sorted((str(r.doc_id), r.n_tokens) for r in second.collect()) == sorted([*want, ("50", counted(["new text"])[0])])

    # What is stored is what is used; another version of the tokenizer has counts of its own.
    spark.read.parquet(cache).selectExpr("content", "version", "n_tokens + 1000 AS n_tokens").write.parquet(cache + "-2")
    third = token_counts.count_tokens(df, cache + "-2", BYTES)
    assert sorted((str(r.doc_id), r.n_tokens - 1000) for r in third.collect()) == want
    monkeypatch.setattr(token_counts, "tokenizer_version", lambda path: "other")
    fourth = token_counts.count_tokens(df, cache + "-2", BYTES)
    assert sorted((str(r.doc_id), r.n_tokens) for r in fourth.collect()) == want


def test_bytes_and_empty_tables(spark, frame):
    out = token_counts.count_tokens(odd_frame(frame), scratch_path(spark, "test-cache"), BYTES).collect()
    assert sorted(r.n_bytes for r in out) == sorted(len((t or "").encode()) for _, t, *_ in odd_texts())
    assert token_counts.count_tokens(empty_frame(frame), scratch_path(spark, "test-cache"), BYTES).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(library):
    texts = [*HARD, *fuzz(4000, 2), prose(1, 2000), "x" * 5000, *(" " * k + "y" * j for k in range(20) for j in range(20))]
    own = piece_codec.Codec(PIECES)
    got = [np.frombuffer(r, dtype="<i4").tolist() for r in own.encode(texts)]
    want = library.encode(texts)
    assert got == want
    assert [own.decode(g) for g in got] == [library.decode(w) for w in want]


def test_edges_are_all_occurrences():
    own = piece_codec.Codec(PIECES)
    text = "▁the▁other\0the\0"
    points = np.array([ord(c) for c in text], dtype=np.uint32)
    got = sorted((int(s), own.pieces[w]) for s, _, w in zip(*own.edges(points)))
    pieces = set(own.pieces)
    want = sorted((s, text[s:e]) for s in range(len(text)) for e in range(s + 1, len(text) + 1) if text[s:e] in pieces)
    assert got == want


def test_pieces_round_trip_on_odd_rows(frame):
    rows = piece_codec.encode(odd_frame(frame), PIECES)
    assert rows.count() == len(odd_texts()) and rows.filter("NOT round_trip").count() == 0
    back = piece_codec.decode(rows, PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, *_ in odd_texts())
    assert piece_codec.encode(empty_frame(frame), PIECES).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id long, leaf long, vector string, score double"


def vectors(n, dims=8, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)


def brute(ids, data, k=20):
    data = data.astype(float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (data * data[q]).sum(1)
        order = np.lexsort((ids, -score))
        out[int(ids[q])] = [int(ids[i]) for i in order if i != q][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert len(out[r.query_id]) == r["rank"]
    return out


def table(frame, ids, data):
    return frame([(int(i), [float(x) for x in v], 1, 2, 3, "v", 0.5) for i, v in zip(ids, data)], VECTORS)


def test_one_leaf_is_exact(frame):
    ids, data = np.arange(300), vectors(300)
    assert found(neighbours.nearest(table(frame, ids, data))) == brute(ids, data)


def test_recall_of_the_forest(frame, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 40)
    ids, data = np.arange(2500), vectors(2500, 24) * np.random.default_rng(1).uniform(0.5, 2, (2500, 1)).astype(np.float32)
    want, got = brute(ids, data), found(neighbours.nearest(table(frame, ids, data)))
    hit = sum(len(set(want[q]) & set(got[q])) for q in want)
    assert want.keys() == got.keys() and hit >= 0.9 * 20 * len(want)


def test_blocks_of_large_leaves_lose_nothing(frame, monkeypatch):
    for name, value in (("MEMBER_BLOCK", 16), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(neighbours, name, value)
    ids, data = np.arange(300), vectors(300)
    assert found(neighbours.nearest(table(frame, ids, data))) == brute(ids, data)


def test_equal_vectors_tie_by_id(frame):
    ids = np.arange(100)
    data = np.concatenate([np.tile(vectors(1), (80, 1)), vectors(20, seed=3)])
    assert found(neighbours.nearest(table(frame, ids, data))) == brute(ids, data)


def test_vectors_that_take_no_part(frame):
    ids, data = np.arange(60), vectors(60)
    rows = [(int(i), [float(x) for x in v], 1, 2, 3, "v", 0.5) for i, v in zip(ids, data)]
    odd = [None, [], [None] * 8, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0],
           [float("-inf")] + [1.0] * 7]
    bad = [(1000 + 20 * i, v, *[None] * 5) for i, v in enumerate(odd)] + [(None, rows[0][1], *[None] * 5), rows[20]]
    assert found(neighbours.nearest(frame(rows + bad, VECTORS))) == brute(ids, data)


def test_few_and_no_vectors(frame):
    ids, data = np.arange(3), vectors(3)
    assert found(neighbours.nearest(table(frame, ids, data))) == brute(ids, data)
    assert neighbours.nearest(table(frame, ids[:1], data[:1])).count() == 0
    assert neighbours.nearest(frame([], VECTORS)).count() == 0
