import collections
import random

import pytest
from odd_documents import empty_frame, odd_frame, odd_texts, prose

from catchment.llm import line_chunks, near_dedup, shingles
from catchment.llm.components import components


def shingle_words(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """component and number of shingles by comparing all pairs; rows of one id and all."""
    sets = [shingle_words(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                label[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        low[find(i)].append(doc)
    return [(doc, len(s), min(low[find(i)]) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def edited(text, rate, seed):
    rng = random.Random(seed)
    return " ".join(w + "x" if rng.random() < rate else w for w in text.split(" "))


def family(n, seed=0):
    """Copies of a few texts with more and more edits, and texts that stand alone."""
    out = []
    for i in range(n):
        base = prose(seed + i % 5, 90 + 40 * (i % 5))
        out.append((i, edited(base, (i % 9) * 0.004, i) if i % 3 else prose(seed + 1000 + i, 70)))
    return out


def test_components_equal_brute_force(frame):
    rows = family(260)
    df = frame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted(brute(rows))
    assert len({c for _, _, c in got}) < len(rows)


def test_large_nodes_branch_and_run_in_blocks(frame, monkeypatch):
    rows = family(200, seed=50)
    for name, value in (("SMALL", 20), ("BLOCK", 8), ("MAX_DEPTH", 5), ("EXACT_BLOCK", 6)):
        monkeypatch.setattr(near_dedup, name, value)
    df = frame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


def test_near_duplicates_of_odd_rows(frame):
    out = near_dedup.near_duplicates(odd_frame(frame)).collect()
    assert len(out) == len(odd_texts())
    known = [(i, t) for i, t, *_ in odd_texts() if i is not None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == sorted(brute(known))
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)


def test_near_duplicates_empty(frame):
    assert near_dedup.near_duplicates(empty_frame(frame)).count() == 0


def test_only_ascii_is_lowered_and_split():
    assert (shingles.shingle_set("A B C D E") == shingles.shingle_set("a\tb\x0bc  d\ne")).all()
    assert len(shingles.shingle_set("É b c d e")) == 1
    assert shingles.shingle_set("É b c d e")[0] != shingles.shingle_set("é b c d e")[0]
    assert len(shingles.shingle_set("a b c d e f")) == 1  # a no-break space is no blank
    assert len(shingles.shingle_set(" ")) == 1 and len(shingles.shingle_set(" \n")) == 0


def test_exact_rule_at_its_edge():
    import numpy as np
    a = np.arange(100, dtype=np.uint64)
    b = a[:85].copy()
    c = a[:84].copy()
    links = set(zip(*(x.tolist() for x in near_dedup.exact_links([a, b, c], 85))))
    assert links == {(0, 1), (1, 2)}


def prefixes(shared, n):
    """Pairs of texts of which one holds the first ``shared`` of the other's 100 shingles."""
    out = []
    for i in range(n):
        words = [f"w{shared}x{i}x{k}" for k in range(104)]
        out += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:shared + 4]))]
    return out


@pytest.mark.parametrize("shared, n", [(80, 1200), (82, 300), (79, 100)])
def test_links_at_the_edge_of_eighty_percent(frame, shared, n):
    rows = prefixes(shared, n)
    out = near_dedup.near_duplicates(frame(rows, "doc_id long, text string"), percent=80).collect()
    apart = sum(r.kept for r in out if r.doc_id % 2)
    assert apart == (0 if shared >= 80 else n)


def test_margin_and_trees_follow_the_similarity():
    assert (near_dedup.margin(85), near_dedup.tree_count(85)) == (92, 3)
    assert (near_dedup.margin(80), near_dedup.tree_count(80)) == (84, 4)


def test_the_pipeline_drops_near_duplicates_from_eighty_percent(spark, frame):
    import corpus_pipeline
    rows = [(i + 10 * s, t) for s in (79, 80, 84) for i, t in prefixes(s, 1)]
    left = corpus_pipeline.dedup_documents(spark, frame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == [790, 791, 800, 840]


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (3, 4), (9, 8)], [(i, i + 1) for i in range(40)],
                                   [(0, i) for i in range(1, 30)] + [(5, 5)]])
def test_components(frame, edges):
    got = {r.node: r.root for r in components(frame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


PASSAGE = [prose(77, 30).replace("\n", " "), prose(78, 31).replace("\n", " ")]


def test_repeated_passage_goes_from_all_but_the_first(frame):
    rows = []
    for i in range(6):
        lines = [prose(100 + i, 20).replace("\n", " ")] * 1
        rows.append((10 - i, "\n".join([*lines, *PASSAGE, prose(200 + i, 25).replace("\n", " ")])))
    out = {r.doc_id: r for r in line_chunks.dedup_lines(frame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        lines = text.split("\n")
        if i == min(out):
            assert out[i].text == text and out[i]["__lines"]["n_removed"] == 0
        else:
            assert out[i].text == "\n".join([lines[0], lines[3]])
            assert out[i]["__lines"]["n_removed"] == 2


@pytest.mark.parametrize("blank", ["", "  \t", "\n"])
def test_a_passage_goes_on_over_blank_lines(frame, blank):
    parts = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(4)]
    rows = [(i, "\n".join([f"own {i}", "", f"\n{blank}\n".join(parts), "", f"end {i}"])) for i in range(4)]
    out = {r.doc_id: r for r in line_chunks.dedup_lines(frame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1]
    for i in (1, 2, 3):
        assert out[i].text == f"own {i}\n\n\nend {i}"
        assert out[i]["__lines"]["n_removed"] == rows[i][1].count("\n") - 3


def sentence(name, words):
    return " ".join(f"{name}{i}" for i in range(words))


def deduped(frame, rows):
    out = line_chunks.dedup_lines(frame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: r.text for r in out}


def test_the_first_copy_keeps_lines_that_stand_earlier_alone(frame):
    passage = "\n".join(["A heading", sentence("a", 30), "And.", sentence("b", 30)])
    rows = [(1, "A heading\nother\nAnd."), (2, f"x\n{passage}\ny"), (3, f"{passage}\nz")]
    assert deduped(frame, rows) == {1: rows[0][1], 2: rows[1][1], 3: "z"}


def test_pairs_that_repeat_in_different_places_are_no_passage(frame):
    a, b, c = (sentence(x, 20) for x in "abc")
    rows = [(1, f"{a}\n{b}\none"), (2, f"{b}\n{c}\ntwo"), (3, f"{a}\n{b}\n{c}\nthree")]
    assert deduped(frame, rows) == dict(rows)


def test_the_first_period_of_a_repeated_line_stays(frame):
    line = sentence("a", 10)
    rows = [(1, "\n".join([line] * 12)), (2, "\n".join([line] * 7))]
    assert deduped(frame, rows) == {1: line, 2: ""}


def lines_of(text):
    """Each line that is not white space as a chunk of its own: (number, next, text)."""
    return [(n, n + 1, x) for n, x in enumerate(text.split("\n")) if x.strip()]


def brute_passages(rows, min_words):
    """Lines in any sequence of enough words that an earlier text, or this one before, holds too.

    Independent of the operator's boundaries: texts whose lines are all cut apart have to agree.
    """
    seen, out = set(), {}
    for i, text in sorted(rows):
        parts = lines_of(text)
        here, drop = set(), set()
        for x in range(len(parts)):
            for y in range(x + 1, len(parts) + 1):
                key = tuple(p[2] for p in parts[x:y])
                if sum(len(k.split()) for k in key) < min_words:
                    continue
                if key in seen or key in here:
                    drop.update(range(x, y))
                here.add(key)
        seen.update(here)
        lines = {j for n in drop for j in range(parts[n][0], parts[n][1])}
        out[i] = "\n".join(s for j, s in enumerate(text.split("\n")) if j not in lines)
    return out


def test_passages_equal_brute_force(frame):
    rng = random.Random(9)
    pool = [sentence(f"p{i}x", rng.choice((1, 3, 9, 20, 60))) for i in range(40)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows = [(i, "\n".join(x for k in range(rng.randint(1, 4)) for x in
                          [*rng.choice(runs), *[sentence(f"d{i}k{k}x", 12)] * rng.randint(0, 1)])) for i in range(100)]
    single = [r for r in rows if all(b == a + 1 for a, b, *_ in line_chunks.chunks(r[1]))]
    assert len(single) > 80
    rows = single
    assert deduped(frame, rows) == brute_passages(rows, line_chunks.MIN_WORDS)


def test_boilerplate_and_short_repeats_stay(frame):
    rows = [(i, "\n".join(["one two three four", prose(300 + i, 30), "five six"])) for i in range(5)]
    out = line_chunks.dedup_lines(frame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == dict(rows)


def test_lines_of_odd_rows(frame):
    df = odd_frame(frame)
    out = line_chunks.dedup_lines(df)
    assert out.columns == [*df.columns, "__lines"]
    rows = out.collect()
    assert len(rows) == len(odd_texts())
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert {r.text for r in by_id[1]} == {odd_texts()[0][1]}  # both repeated rows are the first
    assert by_id[4][0].text is None and by_id[4][0]["__lines"]["n_lines"] == 0
    assert by_id[5][0].text == "" and by_id[9][0].text == odd_texts()[11][1]
    assert all(r["a.b"] == 9 and r.key == "k" for r in rows)


def test_lines_empty(frame):
    assert line_chunks.dedup_lines(empty_frame(frame)).count() == 0
