import math

import pytest
from pyspark.sql import functions as F

from catchment.functions.columns import climate_class, population_bucket, split_key, to_number
from catchment.functions.reference import piped_lines
from catchment.operators.aggregate import (add_global_share, merge_regions, normalised_weight_mean,
                                           pivot_sums, rollup, rollup_levels, weighted_mean)
from catchment.operators.clean import iqr_audit, iqr_clean
from catchment.operators.compare import inventory_comparison, theta_rank, year_column
from catchment.operators.frames import MissingColumns, replace_names, require_columns
from catchment.operators.match import nearest_reference
from catchment.operators.proba import full_matrix, restrict_advanced, stratified_holdout
from catchment.operators.validate import holdout_jobs, joint_score, with_grid


def test_bucket_edges(frame):
    df = frame([(None,), (2000.0,), (2000.1,), (10000.0,), (10000.1,)], "p double")
    got = [r[0].split(":")[0] for r in df.select(population_bucket(F.col("p"))).collect()]
    assert got == ["medium", "small", "medium", "medium", "large"]


def test_climate_last_rule_wins(frame):
    # monthly precipitation; yearly totals are 360, 720, 720, 1800 and 360.
    rows = [(20.0, 30.0), (16.0, 60.0), (9.0, 60.0), (None, 150.0), (12.0, 60.0), (9.0, 30.0)]
    got = [r[0] for r in frame(rows, "t double, p double").select(
        climate_class(F.col("t"), F.col("p"))).collect()]
    assert got == ["Hot semi-arid", "Mediterranean", "Humid continental", "Humid subtropical",
                   "Temperate oceanic", "Humid continental"]


def test_nearest_reference_ties_and_missing(frame):
    refs = [("x", 100.0, "a", 1.0), ("y", 10000.0, "a", 2.0), ("z", 1000.0, "b", 3.0)]
    rows = [(1, 1000.0, "a"), (2, None, "b"), (3, 0.5, "a"), (4, 1000.0, "b"), (5, 1e9, "c")]
    got = {r.id: r.Matched_Network for r in nearest_reference(
        frame(rows, "id int, pop double, c string"), "pop", "c", refs).collect()}
    # 1 lies equally far from x and y; 2 has no size; 3 counts as one person.
    assert got == {1: "x", 2: "x", 3: "x", 4: "z", 5: "y"}


def test_weighted_mean_rules(frame):
    rows = [("a", 1.0, 2.0), ("a", None, 5.0), ("a", 3.0, 0.0), ("a", 4.0, -1.0), ("a", 5.0, 2.0),
            ("b", None, 1.0), ("b", 2.0, 0.0), ("b", 2.0, None)]
    got = {r.g: r.m for r in frame(rows, "g string, v double, w double").groupBy("g").agg(
        weighted_mean(F.col("v"), F.col("w")).alias("m")).collect()}
    assert got == {"a": 3.0, "b": None}


def test_size_weights_fall_back_to_equal(frame):
    rows = [("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 1.0, None), ("b", 4.0, 2.0), ("b", None, 9.0)]
    got = {r.g: r.m for r in frame(rows, "g string, v double, w double").groupBy("g").agg(
        normalised_weight_mean(F.col("v"), F.col("w")).alias("m")).collect()}
    assert got == {"a": 2.0, "b": 3.0}


def test_rollup_drops_missing_keys_and_keeps_first(frame):
    rows = [(1, "a", None, 1.0), (2, "a", "x", None), (0, "a", "y", 2.0), (3, None, "z", 9.0),
            (4, "c", None, None)]
    df = frame(rows, "id int, g string, attr string, v double")
    got = {r.g: (r.v, r.attr) for r in rollup(df, ["g"], ["v"], attributes=["attr"], order="id").collect()}
    assert got == {"a": (3.0, "y"), "c": (0.0, None)}


def test_levels_ignore_rows_without_that_key(frame):
    rows = [("a", "p", 1.0), ("a", None, 2.0), (None, None, 4.0)]
    out = rollup_levels(frame(rows, "k0 string, k1 string, v double"),
                        {"low": ["k0", "k1"], "high": ["k0"], "all": []}, ["v"])
    assert {(r.level, r.k0, r.k1, r.v) for r in out.collect()} == {
        ("low", "a", "p", 1.0), ("high", "a", None, 3.0), ("all", None, None, 7.0)}


def test_share_of_non_positive_total(frame):
    got = add_global_share(frame([(1.0, 0.0), (3.0, 0.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted((r.a_GlobalShare_pct, r.b_GlobalShare_pct) for r in got) == [(25.0, None), (75.0, None)]


def test_pivot_distinguishes_absent_and_missing(frame):
    rows = [("a", "CH4", None), ("a", "N2O", 2.0), ("b", "CO2", 1.0), ("c", "CH4", 1.0)]
    got = {r.k: (r.CH4, r.N2O, r.GHG) for r in pivot_sums(
        frame(rows, "k string, s string, v double"), "k", "s", ["CH4", "N2O"], "v", "GHG").collect()}
    assert got == {"a": (0.0, 2.0, 2.0), "b": (None, None, None), "c": (1.0, None, 1.0)}


def test_theta_rank_of_missing_values(frame):
    ours = frame([("a", None), ("b", 5.0), ("c", 1.0)], "c string, v double")
    sectors = frame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 6.0), ("b", None)], "c string, s double")
    got = {r.c: r.v_rank for r in theta_rank(ours, sectors, ["c"], "s", ["v"]).collect()}
    assert got == {"a": 1, "b": 2, "c": None}


def test_inventory_rank_is_null_without_own_rows(frame):
    ours = frame([("a", 3.0, 1.0)], "Country string, T double, P double")
    inventory = frame([("a", "CH4", "Energy", 2.0), ("a", "CH4", None, 5.0)],
                      "Country string, Substance string, source string, Y_2022 double")
    r = inventory_comparison(ours, inventory, ["CH4"], {"CH4": "T"}, {"CH4": "P"}, "Y_2022").first()
    assert (r.other_sectors, r.inventory_ww, r.inventory_total, r.inventory_rank) == (7.0, None, None, None)
    assert (r.our_rank, r.our_part_rank, r.our_share_pct) == (2, 3, 30.0)


def test_iqr_small_constant_and_missing(frame):
    rows = ([("three", v) for v in (1.0, 2.0, 99.0)] + [("same", 5.0)] * 6 + [("same", 50.0)]
            + [("out", float(v)) for v in range(10)] + [("out", 100.0), ("out", None)] + [(None, 1.0)])
    df = frame(rows, "Type string, v double")
    audit = {r.Type: r for r in iqr_audit(df, "Type", "v").collect()}
    assert audit["three"].method == "insufficient_data" and audit["three"].q1 is None
    assert audit["same"].method == "iqr_zero_skipped" and audit["same"].n_removed == 0
    assert (audit["out"].method, audit["out"].n_eligible, audit["out"].n_removed) == ("IQR", 11, 1)
    assert audit["out"].mean_after == 4.5
    kept = sorted((r.Type, r.v) for r in iqr_clean(df, "Type", "v").collect())
    assert len(kept) == 3 + 7 + 10 and ("out", 100.0) not in kept


def test_advanced_mask(frame):
    rows = [(1, "A", 0.2, "Advanced"), (1, "B", 0.6, "Advanced"), (1, "C", 0.2, "Advanced"),
            (2, "A", 0.0, " Advanced "), (2, "C", 0.0, " Advanced "), (2, "B", 1.0, " Advanced "),
            (3, "A", 0.5, None), (3, "B", 0.5, None), (4, "B", 1.0, "Advanced")]
    got = {(r.id, r["class"]): r.proba for r in restrict_advanced(
        frame(rows, "id int, class string, proba double, lv string"), ["id"], "lv", ["A", "C"]).collect()}
    assert got == {(1, "A"): 0.5, (1, "B"): 0.0, (1, "C"): 0.5, (2, "A"): 0.5, (2, "C"): 0.5,
                   (2, "B"): 0.0, (3, "A"): 0.5, (3, "B"): 0.5, (4, "B"): 1.0}


def test_matrix_treats_foreign_labels_as_unknown(frame):
    rows = frame([(1, "A"), (2, "other"), (3, None), (4, None)], "id int, label string")
    predicted = frame([(2, "A", 0.3, 0.1), (2, "B", 0.7, 0.1), (3, "B", 1.0, 0.0), (1, "B", 0.9, 0.9)],
                      "id int, class string, mean double, std double")
    got = {(r.id, r["class"]): (r["mean"], r.is_known) for r in
           full_matrix(rows, predicted, "id", "label", ["A", "B"]).collect()}
    assert got == {(1, "A"): (1.0, True), (1, "B"): (0.0, True), (2, "A"): (0.3, False),
                   (2, "B"): (0.7, False), (3, "A"): (0.0, False), (3, "B"): (1.0, False),
                   (4, "A"): (0.0, False), (4, "B"): (0.0, False)}


def test_holdout_rounds_half_even(frame):
    rows = [(s * 10 + i, s) for s in (1, 3, 5) for i in range(s)]
    out = stratified_holdout(frame(rows, "id int, s int"), "id", ["s"], 0.5, 1)
    got = {r.s: r.n for r in out.groupBy("s").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()}
    assert got == {1: 0, 3: 2, 5: 2}


def test_joint_score_needs_both_gases(frame):
    rows = [("a", "N2O", 1.0), ("a", "N2O", 3.0), ("a", "CH4", 5.0), ("b", "N2O", 1.0)]
    got = {r.k: r.score for r in joint_score(frame(rows, "k string, gas string, rmse double"), ["k"]).collect()}
    assert got == {"a": 7.0, "b": math.inf}


def test_jobs_by_size(frame):
    rows = frame([("big",)] * 12 + [("mid",)] * 5 + [("low",)], "c string")
    wanted = frame([("big",), ("mid",), ("low",), ("none",)], "c string")
    got = {r.c: (r.n, r.fraction, r.status) for r in holdout_jobs(rows, "c", wanted, 10, 5).collect()}
    assert got == {"big": (12, 0.2, "run"), "mid": (5, 0.5, "run"), "low": (1, None, "too few plants"),
                   "none": (0, None, "name not found")}


def test_holdout_modes(frame):
    rows = frame([("big",)] * 12 + [("mid",)] * 5 + [("low",)], "c string")
    wanted = frame([("big",), ("mid",), ("low",), ("none",)], "c string")

    def jobs(**modes):
        return sorted((r.c, r.fraction, r.status) for r in holdout_jobs(rows, "c", wanted, 10, 5, **modes).collect())

    several = jobs(large_fractions=(0.1, 0.2), small_fractions=(0.3,), below="small")
    assert several == [("big", 0.1, "run"), ("big", 0.2, "run"), ("low", 0.3, "run"), ("mid", 0.3, "run"),
                       ("none", None, "name not found")]
    assert ("low", None, "run") in jobs(below="whole")
    assert {s for c, f, s in jobs(whole=True) if c != "none"} == {"run"}
    assert all(f is None for _, f, _ in jobs(whole=True))


def test_grid_order(frame):
    out = with_grid(frame([("b",)], "bucket string"), {"x": [1, 2], "y": [0.1, 0.2, 0.3]})
    got = [(r.ordinal, r.x, r.y) for r in out.orderBy("ordinal").collect()]
    assert got == [(0, 1, 0.1), (1, 1, 0.2), (2, 1, 0.3), (3, 2, 0.1), (4, 2, 0.2), (5, 2, 0.3)]


def test_small_rules(frame):
    df = frame([("1.5", "a | b | c"), ("x", "a"), ("nan", None)], "n string, k string")
    left, right = split_key(F.col("k"))
    got = [tuple(r) for r in df.select(to_number(F.col("n")), to_number(F.col("n"), 0.0), left, right).collect()]
    assert got == [(1.5, 1.5, "a", "b | c"), (None, 0.0, "a", None), (None, 0.0, None, None)]
    assert year_column(["a", "Y_2010", "Y_2021"]) == "Y_2021"
    assert year_column(["Y_2010", "x_Y_2022_kt"]) == "x_Y_2022_kt"
    assert year_column(["a"], required=False) is None
    with pytest.raises(KeyError):
        year_column(["a"])
    with pytest.raises(MissingColumns, match="zz"):
        require_columns(df, ["n", "zz"])


def test_piped_lines_and_aliases(frame):
    lines = frame([("a|b|c",), ("a|b",), (" x | y | z ",), ("",)], "line string")
    assert sorted(tuple(r) for r in piped_lines(lines, "line", ["p", "q", "r"]).collect()) == [
        ("a", "b", "c"), ("x", "y", "z")]
    names = replace_names(frame([("old",), ("kept",), (None,)], "n string"),
                          frame([("old", "new")], "alias string, name string"), "n")
    assert {r.n for r in names.collect()} == {"new", "kept", None}


def test_merge_takes_larger_population(frame):
    left = frame([("a", 1.0, 5.0), ("b", 2.0, 5.0)], "k string, x double, w double")
    right = frame([("a", 3.0, 9.0), ("c", 4.0, None)], "k string, y double, w double")
    got = {r.k: (r.x, r.y, r.w) for r in merge_regions(left, right, ["k"], "w").collect()}
    assert got == {"a": (1.0, 3.0, 9.0), "b": (2.0, None, 5.0), "c": (None, 4.0, None)}
