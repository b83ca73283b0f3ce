import os
from types import SimpleNamespace

import pytest

from catchment import session
from catchment.operators.jobstate import changed_settings, fingerprint, keep_last
from catchment.session import materialize, scratch_path, shared_dir
from catchment.sources.readers import read_by_header, read_named, read_optional, read_probabilities, read_union
from catchment.sources.writers import (latest_version, read_versioned, upsert, write_buckets,
                                       write_csv, write_table, write_tables)


def test_scratch_is_in_the_configured_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "a").startswith(shared_dir(spark))
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_only_a_local_session_may_choose_its_folder():
    """A cluster without the setting is refused; so is one whose executors are processes."""
    for master, allowed in (("local[4]", True), ("local", True), ("yarn", False), ("spark://a:7077", False),
                            ("local-cluster[2,1,1024]", False), ("k8s://https://a", False)):
        conf = {}
        made = SimpleNamespace(
            conf=SimpleNamespace(get=conf.get, set=conf.__setitem__),
            sparkContext=SimpleNamespace(master=master, setCheckpointDir=lambda folder: None))
        if allowed:
            assert shared_dir(made) == conf["spark.checkpoint.dir"]
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                shared_dir(made)


def test_stages_can_be_dropped(spark, frame, monkeypatch):
    monkeypatch.setattr(session, "_stages", {})
    stage = session.materialize(frame([(1,)], "a int"))
    path = stage.inputFiles()[0]
    assert os.path.exists(path.removeprefix("file://"))
    assert len(session.drop_stages(spark)) == 1
    assert not os.path.exists(path.removeprefix("file://"))
    assert session.drop_stages(spark) == []


def test_named_table_error_lists_tables(spark, frame):
    folder = scratch_path(spark, "named")
    write_tables({"one": frame([(1,)], "a int"), "two": frame([(2,)], "a int")}, folder)
    assert read_named(spark, folder, "two").first().a == 2
    with pytest.raises(KeyError, match="one.*two"):
        read_named(spark, folder, "three")


def test_optional_sources(spark, frame):
    folder = scratch_path(spark, "optional")
    write_table(frame([(1, "x")], "a int, b string"), f"{folder}/good")
    write_table(frame([(1,)], "c int"), f"{folder}/bad")
    got = read_optional(spark, [f"{folder}/bad", f"{folder}/none", f"{folder}/good"], ["a", "b"])
    assert [tuple(r) for r in got.collect()] == [(1, "x")]
    with pytest.raises(FileNotFoundError, match="bad.*missing"):
        read_optional(spark, [f"{folder}/bad"], ["a"])


def test_union_skips_unreadable_files(spark, frame):
    folder = scratch_path(spark, "union")
    write_table(frame([(1, 2.0)], "a int, b double"), f"{folder}/x_formatted_1.parquet")
    write_table(frame([(3, "t")], "a int, c string"), f"{folder}/y_formatted_2.parquet")
    write_csv(frame([("junk",)], "j string"), f"{folder}/z_formatted_3.parquet")
    got, skipped = read_union(spark, f"{folder}/*_formatted*.parquet")
    assert [p.rsplit("/", 1)[-1] for p in skipped] == ["z_formatted_3.parquet"]
    assert sorted((r.a, r.b, r.c) for r in got.collect()) == [(1, 2.0, None), (3, None, "t")]
    assert read_union(spark, f"{folder}/nothing*") == (None, [])


def test_union_of_many_files_is_one_scan(spark, frame):
    """400 files of three schemas, one cut short and one empty table."""
    folder = scratch_path(spark, "many")
    for name, rows in (("a", "id"), ("b", "id, id * 0.5 AS x"), ("c", "id, string(id) AS y")):
        spark.range(266).selectExpr(rows.split(", ")[0], *rows.split(", ")[1:]).repartition(133, "id").write.parquet(
            f"{folder}/{name}.parquet")
    write_table(frame([], "id long, z int"), f"{folder}/d.parquet")
    one = next(f for f in os.scandir(f"{folder}/a.parquet") if f.name.endswith(".parquet"))
    lost = spark.read.parquet(one.path).count()
    with open(one.path, "r+b") as f:
        f.truncate(one.stat().st_size - 5)
    os.remove(f"{folder}/a.parquet/.{one.name}.crc")
    got, skipped = read_union(spark, f"{folder}/*.parquet")
    assert [p.rsplit("/", 1)[-1] for p in skipped] == [one.name]
    assert got.columns == ["id", "x", "y", "z"] and got.count() == 3 * 266 - lost
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert got.where("x IS NOT NULL").count() == 266 == got.where("y IS NOT NULL").count()


def test_union_widens_types_and_reports_a_pattern_of_junk(spark, frame):
    folder = scratch_path(spark, "types")
    write_table(frame([(1,)], "a int"), f"{folder}/1.parquet")
    write_table(frame([(2.5,)], "a double"), f"{folder}/2.parquet")
    got, skipped = read_union(spark, f"{folder}/*.parquet")
    assert sorted(r.a for r in got.collect()) == [1.0, 2.5] and skipped == []
    write_csv(frame([("junk",)], "j string"), f"{folder}/junk/a b+c.parquet")
    none, skipped = read_union(spark, f"{folder}/junk/*.parquet")
    assert none is None and [p.rsplit("/", 1)[-1] for p in skipped] == ["a b+c.parquet"]


def test_csv_files_of_one_header_are_one_scan(spark):
    folder = scratch_path(spark, "headers")
    os.makedirs(folder)
    for n in range(60):
        with open(f"{folder}/f {n}+.csv", "w") as f:
            f.write("a,b\n%d,x%d\n" % (n, n) if n % 2 else 'b,"c"\n"y\nz",%d\n' % n)
    open(f"{folder}/empty.csv", "w").close()
    with open(f"{folder}/only.csv", "w") as f:
        f.write("a,b\n")
    got = read_by_header(spark, sorted(e.path for e in os.scandir(folder)))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert sorted(r.a for r in got.collect() if r.a is not None) == list(range(1, 60, 2))
    assert read_by_header(spark, []) is None and read_by_header(spark, [f"{folder}/empty.csv"]) is None


def test_upsert_keeps_last_and_survives_a_dead_writer(spark, frame):
    path = scratch_path(spark, "upsert")
    schema = "k int, seq int, v string"
    upsert(frame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema), path, ["k"], "seq")
    first = latest_version(spark, path)
    # A version without its success marker does not count.
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=00000001/part")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(fs_path).close()
    assert latest_version(spark, path) == first
    upsert(frame([(2, 5, "d"), (3, 1, "e")], schema), path, ["k"], "seq")
    assert sorted(tuple(r) for r in read_versioned(spark, path).collect()) == [
        (1, 2, "b"), (2, 5, "d"), (3, 1, "e")]


def test_bucket_overwrite_modes(spark, frame):
    path = scratch_path(spark, "buckets")
    schema = "v int, b string"
    write_buckets(frame([(1, "x"), (2, "y")], schema), path, ["b"])
    write_buckets(frame([(3, "x")], schema), path, ["b"], replace_all=False)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]
    write_buckets(frame([(4, "z")], schema), path, ["b"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [4]


def test_stored_probabilities(spark, frame):
    folder = scratch_path(spark, "proba")
    write_csv(frame([(1, 0.5, 0.1)], "id int, A_mean double, A_std double"), f"{folder}/Some_Place_proba.csv")
    write_csv(frame([(2, "Other", 50, 0.5, 0.1)], "id int, country string, holdout_pct int, A_mean double, A_std double"),
              f"{folder}/Some_Place_holdout50_proba.csv")
    table, classes = read_probabilities(spark, folder, ["Some Place", "Absent"])
    assert classes == ["A"]
    assert sorted((r.id, r.country, r.holdout_pct) for r in table.collect()) == [
        (1, "Some Place", "LCO"), (2, "Other", "50")]


def test_fingerprint_changes_with_a_setting(frame):
    old = frame([("a", "1"), ("b", None)], "k string, v string")
    new = frame([("b", None), ("a", "2"), ("c", "3")], "k string, v string")
    assert fingerprint(old, "k", "v").first() == fingerprint(old.orderBy("k"), "k", "v").first()
    assert fingerprint(old, "k", "v").first() != fingerprint(new, "k", "v").first()
    got = {r.k: (r.old_value, r.new_value) for r in changed_settings(old, new, ["k"], "v").collect()}
    assert got == {"a": ("1", "2"), "c": (None, "3")}


def test_materialize_keeps_rows(frame):
    df = frame([(1, "a"), (2, None)], "x int, y string")
    assert sorted(materialize(df).collect()) == sorted(df.collect())


def test_last_row_of_ties_is_the_same_in_any_order(frame):
    rows = [(1, 5, "a", 2.0), (1, 5, "b", 1.0), (1, 4, "z", 9.0), (2, None, "c", 1.0)]
    for order in (rows, rows[::-1]):
        df = frame(order, "k int, seq int, v string, w double").repartition(3)
        assert sorted(tuple(r) for r in keep_last(df, ["k"], "seq").collect()) == [
            (1, 5, "b", 1.0), (2, None, "c", 1.0)]
