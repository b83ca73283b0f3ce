import threading

import pytest

from catchment.session import scratch_path
from catchment.sources.commitlog import BucketLog, Conflict
from catchment.sources.writers import latest_version, read_versioned, replace_buckets, upsert

SCHEMA = "k int, seq int, v string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_one_key_rewrites_one_bucket(spark, frame):
    path = scratch_path(spark, "log")
    log = BucketLog(spark, path)
    assert log.read() is None
    assert upsert(frame([(i, 0, "a") for i in range(200)], SCHEMA), path, ["k"], "seq", 8) == 0
    assert upsert(frame([(7, 1, "b"), (7, 0, "z")], SCHEMA), path, ["k"], "seq", 8) == 1
    old, new = log.manifest(0)["folders"], log.manifest(1)["folders"]
    assert len(new) == 8 and sum(old[b] != new[b] for b in new) == 1
    assert {r.k: r.v for r in log.read().collect()} == {i: "b" if i == 7 else "a" for i in range(200)}
    assert {r.v for r in log.read(0).collect()} == {"a"}
    with pytest.raises(ValueError):
        upsert(frame([(1, 1, "b")], SCHEMA), path, ["k"], "seq", 9)


def test_two_writers_of_one_bucket(spark, frame):
    path = scratch_path(spark, "log")
    log = BucketLog(spark, path)
    upsert(frame([(i, 0, "a") for i in range(50)], SCHEMA), path, ["k"], "seq", 4)
    first = log.prepare_upsert(frame([(3, 1, "first")], SCHEMA), ["k"], "seq", 4)
    second = log.prepare_upsert(frame([(3, 2, "second")], SCHEMA), ["k"], "seq", 4)
    assert first.publish() == 1
    with pytest.raises(Conflict):
        second.publish()
    assert {r.v for r in log.read().where("k = 3").collect()} == {"first"}


def test_writers_of_other_buckets_both_succeed(spark, frame):
    path = scratch_path(spark, "log")
    replace_buckets(frame([(1, "x"), (2, "y"), (3, None)], "v int, b string"), path, ["b"])
    log = BucketLog(spark, path)
    changes = [log.prepare_replace(frame([(10, b)], "v int, b string"), ["b"]) for b in ("x", "y")]
    assert sorted(c.publish() for c in changes) == [1, 2]
    assert rows_of(read_versioned(spark, path)) == [(10, "x"), (10, "y"), (3, None)]
    whole = log.prepare_replace(frame([(4, "z")], "v int, b string"), ["b"], whole=True)
    replace_buckets(frame([(11, "x")], "v int, b string"), path, ["b"], replace_all=False)
    with pytest.raises(Conflict):
        whole.publish()
    replace_buckets(frame([(4, "z")], "v int, b string"), path, ["b"])
    assert rows_of(read_versioned(spark, path)) == [(4, "z")]


def test_a_version_is_taken_once(spark):
    log = BucketLog(spark, scratch_path(spark, "log"))
    won = []
    threads = [threading.Thread(target=lambda n=n: won.append(n) if log.place(0, f'{{"n": {n}}}') else None)
               for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and log.manifest(0) == {"n": won[0]}


def test_first_writers_and_empty_batches(spark, frame):
    path = scratch_path(spark, "log")
    log = BucketLog(spark, path)
    one, two = (log.prepare_upsert(frame([(1, s, "a")], SCHEMA), ["k"], "seq", 2) for s in (1, 2))
    assert two.publish() == 0
    with pytest.raises(Conflict):
        one.publish()
    assert upsert(frame([], SCHEMA), path, ["k"], "seq", 2) == 1
    assert rows_of(read_versioned(spark, path)) == [(1, 2, "a")]
    other = scratch_path(spark, "log")
    upsert(frame([], SCHEMA), other, ["k"], "seq", 2)
    assert read_versioned(spark, other).count() == 0 and latest_version(spark, other) == 0


def test_a_new_column_is_null_in_old_buckets(spark, frame):
    path = scratch_path(spark, "log")
    upsert(frame([(i, 0, "a") for i in range(20)] + [(None, 0, "n")], SCHEMA), path, ["k"], "seq", 4)
    upsert(frame([(3, 1, "b", 2.5), (None, 1, "m", 1.0)], SCHEMA + ", w double"), path, ["k"], "seq", 4)
    got = {r.k: (r.v, r.w) for r in read_versioned(spark, path).collect()}
    assert got == {i: ("a", None) for i in range(20) if i != 3} | {3: ("b", 2.5), None: ("m", 1.0)}
