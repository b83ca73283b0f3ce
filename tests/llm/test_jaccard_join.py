import random

import numpy as np
import pytest
from odd_documents import empty_frame, odd_frame, odd_texts, prose
from test_near_and_lines import edited, family, shingle_words

from catchment.llm import jaccard_join
from catchment.llm.jaccard_join import bitmap, folded, jaccard_components, overlap
from catchment.llm.shingles import shingle_set


def brute(rows, percent=80):
    """(id, size, smallest id reached) by comparing all pairs of rows."""
    sets = [shingle_words(t) for _, t in rows]
    reach = [{i} for i in range(len(rows))]
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common) and reach[i] is not reach[j]:
                reach[i] |= reach[j]
                for k in reach[j]:
                    reach[k] = reach[i]
    return sorted((doc, len(s), min(rows[k][0] for k in reach[i]) if s else doc)
                  for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def got(df, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, **options).collect())


def edge_pairs():
    """Texts of which exactly 80, or a little less than 80, in a hundred shingles are shared."""
    words = [f"w{i}" for i in range(400)]
    out = []
    for k, (shared, own) in enumerate([(80, 10), (80, 11), (160, 20), (79, 10), (4, 1), (8, 1), (40, 5)]):
        for side in "ab":
            head = [f"{k}x{w}" for w in words[:shared + 4]]
            out.append((1000 + 2 * k + (side == "b"), " ".join(head + [f"{side}{k}{w}" for w in words[:own]])))
    return out


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_components_equal_brute_force(frame, percent):
    rows = family(180) + edge_pairs()
    assert got(frame(rows, "doc_id long, text string"), percent=percent) == brute(rows, percent)


def test_edges_of_the_rule(frame):
    found = dict((i, c) for i, _, c in got(frame(edge_pairs(), "doc_id long, text string")))
    assert [found[1001 + 2 * k] == found[1000 + 2 * k] for k in range(7)] == [True, False, True, False, False, True, True]


def test_large_tiles_in_blocks(frame, monkeypatch):
    for name, value in (("SMALL", 6), ("BLOCK", 5), ("STARS", 1), ("LOCAL", 2), ("OFTEN", 3), ("NAMED", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    passage = prose(3, 60)
    rows = family(150, seed=9)
    # One passage in many texts that are otherwise their own, and a large family around one text.
    rows += [(500 + i, prose(700 + i, 12) + " " + passage) for i in range(40)]
    rows += [(600 + i, edited(prose(5, 150), 0.016, i)) for i in range(60)]
    want = brute(rows)
    assert got(frame(rows, "doc_id long, text string")) == want
    assert len({c for *_, c in want}) > 40


def test_any_order_of_shingles_gives_the_same(frame, monkeypatch):
    rows = family(90, seed=4)
    df = frame(rows, "doc_id long, text string")
    want = brute(rows)
    for common in (0, 5, 100_000):
        monkeypatch.setattr(jaccard_join, "COMMON", common)
        monkeypatch.setattr(jaccard_join, "LOCAL", 2)
        monkeypatch.setattr(jaccard_join, "OFTEN", 2)
        assert got(df) == want


def test_odd_rows(frame):
    out = jaccard_components(odd_frame(frame)).collect()
    assert len(out) == len(odd_texts())
    known = [(i, t) for i, t, *_ in odd_texts() if i is not None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == brute(known)
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert jaccard_components(empty_frame(frame)).count() == 0


def test_bits_bound_the_overlap():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice((1, 5, 40, 700))
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        a, b = shingle_set(" ".join(words)), shingle_set(edited(" ".join(words), rng.random() * 0.2, n))
        maps = [bitmap(a), bitmap(b)]
        x, y = folded(maps, min(map(len, maps)) // 8)
        common = len(set(a.tolist()) & set(b.tolist()))
        assert overlap(a, b) == common
        assert 2 * common <= len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())
    apart = folded([bitmap(shingle_set(prose(i, 400))) for i in range(2)], 8)
    assert np.bitwise_count(apart[0] ^ apart[1]).sum() > 100
