import hashlib
import math
import re
from collections import defaultdict

import pytest
from odd_documents import empty_frame, odd_frame, odd_texts
from pyspark.sql import functions as F

from catchment.llm import exact_dedup, mixing

STRIP = re.compile("[\x20\x09-\x0D]")


def test_exact_groups_of_odd_rows(frame):
    out = exact_dedup.exact_duplicates(odd_frame(frame)).collect()
    groups = defaultdict(list)
    for i, text, *_ in odd_texts():
        groups[STRIP.sub("", text or "")].append((-len(text or ""), i is None, i or 0))
    want = []
    for norm, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for _, none, i in members:
            own = None if none else i
            want.append((own, keep, len(members), own == keep, hashlib.sha256(norm.encode()).hexdigest()))
    # A single row keeps itself; the rest is compared as it is.
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))


def test_exact_empty(frame):
    assert exact_dedup.exact_duplicates(empty_frame(frame)).count() == 0


def test_longest_then_smallest_id_stays(frame):
    df = frame([(3, "ab"), (9, "a b"), (4, "a\tb"), (5, "AB")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == {3: (4, 3, False), 9: (4, 3, False), 4: (4, 3, True), 5: (5, 1, True)}


@pytest.mark.parametrize("ids", [(-(2**63), 2**63 - 1), (0, -1)])
def test_extreme_ids(frame, ids):
    df = frame([(i, "same") for i in ids], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_duplicates(df).collect()} == {min(ids)}


def test_directory_splits_only_overfull_buckets(spark):
    # Half of the keys share their leading bits: their side of the directory is deeper.
    keys = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(
        F.xxhash64("id")).alias("key"))
    slots, depth = exact_dedup.directory(keys, capacity=300)
    rows = slots.collect()
    sizes = defaultdict(int)
    number = {r.slot: (r.depth, r.bucket) for r in rows}
    for (key,) in keys.collect():
        sizes[number[(key % 2**64) >> (64 - depth)]] += 1
    assert all(n <= 300 or d == depth for (d, _), n in sizes.items())
    assert len({d for d, _ in sizes}) > 1
    for (d, bucket), n in sizes.items():  # a parent would have been overfull
        if d:
            assert sum(m for (e, b), m in sizes.items() if e >= d - 1 and b >> (e - d + 1) == bucket >> 1) > 300


def test_index_is_ordered_by_key_and_compares_bytes(spark, frame, monkeypatch):
    # One key for all texts: chains must tell them apart by their bytes.
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    df = frame([(1, "a"), (2, "b"), (3, " a"), (4, "c")], "doc_id long, text string")
    index, keyed = exact_dedup.build_index(df)
    assert sorted((r.chain, r.group_size) for r in index.collect()) in (
        [(1, 2), (2, 1), (3, 1)], [(1, 1), (2, 2), (3, 1)], [(1, 1), (2, 1), (3, 2)])
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == {1: 3, 3: 3, 2: 2, 4: 4}


def test_owners_hold_whole_buckets(spark, frame):
    df = frame([(i, f"text {i % 300}") for i in range(900)], "doc_id long, text string")
    index, keyed = exact_dedup.build_index(df.repartition(5), capacity=20)
    rows = index.withColumn("file", F.input_file_name()).collect()
    owners, ranges = defaultdict(set), defaultdict(list)
    for r in rows:
        owners[r.depth, r.bucket].add(r.file)
        ranges[r.file].append(r.key % 2**64)
    assert len(rows) == 300 and {r.group_size for r in rows} == {3}
    assert len(owners) > 15 and all(len(files) == 1 for files in owners.values())
    spans = sorted((min(k), max(k)) for k in ranges.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    at = {r.key: (r.depth, r.bucket) for r in rows}
    assert all(at[r.key] == (r.depth, r.bucket) for r in keyed.collect())


def test_nothing_is_found_without_the_directory(spark, frame, monkeypatch):
    df = frame([(i, "same" if i % 2 else f"t{i}") for i in range(40)], "doc_id long, text string")
    assert {r.group_size for r in exact_dedup.exact_duplicates(df).collect()} == {1, 20}
    whole = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: (lambda s, d: (s.limit(0), d))(*whole(*a)))
    assert exact_dedup.build_index(df)[0].count() == 0
    assert exact_dedup.exact_duplicates(df).count() == 0


def test_no_python_on_the_main_path(frame):
    for df in (exact_dedup.exact_duplicates(odd_frame(frame)), mixing.mix(odd_frame(frame))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def water_fill(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not full:
            out |= {s: weight[s] * level for s in free}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_targets_fill_to_the_cap(frame):
    sizes = {"a": 10, "b": 1000, "c": 40, "": 0, None: 500, "z": 5}
    got = {r.source: r.target for r in mixing.targets(
        frame(list(sizes.items()), "source string, source_size long")).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), 1.5 * sum(sizes.values()))


def test_mix_of_odd_rows(frame):
    df = odd_frame(frame)
    rows = mixing.with_copies(df).collect()
    assert len(rows) == len(odd_texts())
    words = re.compile("[^\x20\x09-\x0D]+")
    by_source = defaultdict(list)
    for r in rows:
        assert r["__mix"]["size"] == len(words.findall(r.text or ""))
        assert 0 <= r["__mix"]["copies"] <= 2
        assert r["__mix"]["size"] or not r["__mix"]["copies"]
        by_source[r.source].append(r["__mix"])
    want = water_fill({s: sum(m["size"] for m in ms) for s, ms in by_source.items()})
    for source, ms in by_source.items():
        assert math.isclose(ms[0]["target"], want[source], abs_tol=1e-6)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["__mix"]["copies"] for r in rows)


def test_mix_empty(frame):
    out = mixing.mix(empty_frame(frame))
    assert out.count() == 0


def test_taken_words_come_near_the_target_and_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 300)  # several parts in a size class
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
        F.repeat(F.lit("w "), (1 + F.col("id") % 97).cast("int")).alias("text"))
    def taken(df):
        rows = mixing.with_copies(df).select("doc_id", "source", "__mix.*")
        return rows.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()
    rows = taken(df)
    assert all(abs(r.t - r.target) <= 0.02 * r.target for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, taken(df.repartition(7))))
