import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.functions.uniform import digest, lane, standard_normal
from catchment.operators.draws import (BETA_CELLS, beta_classes, beta_envelopes, beta_probabilities, beta_values, city_table,
                                       class_index, distribution, donor_series, expand_draws,
                                       group_emissions, level_emissions, level_loads, level_table,
                                       redrawn_factor, with_beta_shapes, with_blocks, with_class_cdf, with_shared_draws)
from catchment.operators.validate import interval_summary

CLASSES = ["A", "B", "C"]


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [(i, [0.2, 0.5, 0.3], [0.05, 0.1, 0.05]) for i in range(40)]
    rows += [(100, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]), (101, [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]),
             (102, [0.0, 0.4, 0.6], [0.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "id long, means array<double>, stds array<double>")


def test_uniform_matches_published_value(spark):
    got = spark.range(1).select(lane(F.md5(F.lit("42|7|3|1")))).first()[0]
    assert got == 3372590161 / 2 ** 32


def test_uniform_and_normal_moments(spark):
    key = digest(1, F.col("id"))
    r = spark.range(20000).select(lane(key, 3).alias("u"), standard_normal(lane(key, 0), lane(key, 1)).alias("z")).agg(
        F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] and r[2] < 1
    assert abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03


def test_fast_stream_is_uniform(spark):
    key = digest(1, F.col("id"), fast=True)
    a, b = lane(key, 0, True), lane(key, 1, True)
    r = spark.range(20000).select(a.alias("a"), b.alias("b")).agg(
        F.avg("a"), F.min("a"), F.max("a"), F.stddev("a"), F.corr("a", "b")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] and r[2] < 1
    assert abs(r[3] - 12 ** -0.5) < 0.005 and abs(r[4]) < 0.03


def test_shared_rates_are_bounded_and_shared(spark):
    rows = with_shared_draws(spark.range(3000).select((F.col("id") % 1000).alias("sim")), "sim", 5)
    r = rows.agg(F.min("gen"), F.max("gen"), F.avg("gen"), F.min("leak"), F.max("leak"),
                 F.countDistinct("sim", "gen", "leak")).first()
    assert 0 <= r[0] and r[1] <= 1 and abs(r[2] - 0.55) < 0.02 and 0 <= r[3] and r[4] < 0.1 and r[5] == 1000


def test_beta_draws_do_not_depend_on_partitions(arrays):
    few = {(r.id, r.sim): r.probs for r in beta_probabilities(arrays.coalesce(1), "id", 50, 9).collect()}
    many = {(r.id, r.sim): r.probs for r in beta_probabilities(arrays.repartition(7), "id", 50, 9).collect()}
    assert few == many and len(few) == 43 * 50
    p = np.array([few[(i, s)] for i in range(40) for s in range(50)])
    assert ((p >= 0) & (p <= 1)).all()
    assert np.allclose(p.mean(axis=0), [0.2, 0.5, 0.3], atol=0.02)
    assert np.allclose(p.std(axis=0), [0.05, 0.1, 0.05], atol=0.01)
    assert few[(100, 3)] == [0, 0, 0] and few[(101, 3)] == [0, 1, 0] and few[(102, 3)] == [0, 0.4, 0.6]


def test_beta_draws_are_made_in_arrays_as_the_expression_makes_them(spark):
    """No function of arrays is interpreted for every cell; blocks are cut, ids may be text or missing."""
    rows = [(f"p{i}", [0.2, 0.001, 0.9, 0.0], [0.05, 0.02, 0.3, 0.1]) for i in range(12)]
    rows += [(None, [0.3, 0.3, 0.4, 0.0], [0.1, 0.0, 0.49, 0.0]), ("short", [0.5], [0.2]), ("none", [], [])]
    table = spark.createDataFrame(rows, "id string, means array<double>, stds array<double>")
    drawn = beta_probabilities(table, "id", 1200, 7)
    assert 12 * 1200 * 3 > BETA_CELLS
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5(" not in plan and "aggregate(" not in plan
    assert drawn.schema["sim"].dataType.simpleString() == "int" and drawn.columns == ["id", "sim", "probs"]
    plain = with_beta_shapes(table).select("id", beta_envelopes(F.col("a"), F.col("b"), F.col("fixed")).alias("e"))
    plain = plain.select("*", F.explode(F.sequence(F.lit(0), F.lit(1199))).alias("sim")).select(
        "id", "sim", beta_values(F.col("e"), 7, F.col("sim"), F.col("id")).alias("probs"))
    got, want = ({(r.id, r.sim): r.probs for r in x.collect()} for x in (drawn, plain))
    assert got.keys() == want.keys() and len(got) == 15 * 1200
    assert all(len(got[k]) == len(want[k]) for k in want)
    assert np.allclose(np.concatenate([got[k] for k in want]), np.concatenate([want[k] for k in want]), rtol=1e-12, atol=0)


def test_beta_classes_follow_the_means(arrays):
    rows = beta_classes(with_blocks(arrays, 2400, "id"), "id", 3).collect()
    picked = {}
    for r in sorted(rows, key=lambda r: r.block):
        picked.setdefault(r.id, []).extend(r.picks)
    assert {len(p) for p in picked.values()} == {2400}
    again = beta_classes(with_blocks(arrays.coalesce(1), 2400, "id").coalesce(2), "id", 3).collect()
    assert {(r.id, r.block, tuple(r.picks)) for r in rows} == {(r.id, r.block, tuple(r.picks)) for r in again}
    share = np.bincount(np.concatenate([picked[i] for i in range(40)]), minlength=3) / (40 * 2400)
    assert np.allclose(share, [0.2, 0.5, 0.3], atol=0.02)
    assert set(picked[100]) == {-1} and set(picked[101]) == {1} and set(picked[102]) == {1, 2}


def test_fixed_classes(arrays):
    rows = with_class_cdf(arrays, 3).withColumn("known_idx", F.when(F.col("id") == 5, 2))
    drawn = expand_draws(rows.select("id", "cdf", "known_idx"), "id", 300, 1, 3)
    counts = {(r.id, r.class_idx): r["count"] for r in drawn.groupBy("id", "class_idx").count().collect()}
    assert counts[(5, 2)] == 300 and counts[(100, -1)] == 300 and counts[(101, 1)] == 300
    assert (102, 0) not in counts
    clipped = expand_draws(rows.select("id", "cdf"), "id", 5, 1, 3, None, None)
    assert {r.class_idx for r in clipped.where("id = 100").collect()} == {2}


def test_class_edges(spark):
    cdf = F.array(F.lit(0.5), F.lit(1.0))
    got = spark.createDataFrame([(0.0,), (0.4999,), (0.5,), (0.999,)], "u double").select(
        class_index(F.col("u"), cdf, 2)).collect()
    assert [r[0] for r in got] == [0, 0, 1, 1]


def test_redrawn_factor_is_never_negative(spark):
    base = F.lit(0.1)
    r = spark.range(5000).select(redrawn_factor(base, 1, [F.col("id")], uncertainty=1.5).alias("v")).agg(
        F.min("v"), F.count("v")).first()
    assert r[0] >= 0 and r[1] == 5000


def test_distribution_skips_missing(spark):
    rows = [("a", float(i)) for i in range(11)] + [("a", None), ("b", None)]
    got = {r.k: r for r in distribution(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"]).collect()}
    assert (got["a"].v_Mean, got["a"].v_Median, got["a"].v_Missing) == (5.0, 5.0, 1)
    assert np.isclose(got["a"].v_P2_5, 0.25) and got["b"].v_Mean is None


@pytest.fixture(scope="module")
def run(spark):
    rng = np.random.default_rng(2)
    factors = [(d, s, *rng.uniform(0, 1, 5).tolist()) for d in "xy" for s in range(60)]
    cities = [(i, "N" if i < 4 else "M", f"r{i % 2}", "T", "H", ["x", "y", None][i % 3],
               float(i), float(10 - i), 0.1 * i) for i in range(7)]
    return (spark.createDataFrame(cities, "row_id int, NAME_0 string, Region string, Continent string, Income_Level string, "
                                          "donor_id string, BOD_intoSecondary double, TN_intoSecondary double, ad_ratio double"),
            spark.createDataFrame(factors, "donor_id string, sim int, ch4_ef double, n2o_ef double, sludge double, ch4_red double, n2o_red double"))


def by_hand(spark, loads, factors, seed):
    """Every city and iteration in NumPy."""
    sims = sorted({r.sim for r in factors.collect()})
    rates = {r.sim: (r.gen, r.leak) for r in with_shared_draws(
        spark.createDataFrame([(s,) for s in sims], "sim int"), "sim", seed).collect()}
    f = {(r.donor_id, r.sim): r for r in factors.collect()}
    out = {}
    for c in loads.collect():
        rows = []
        for s in sims:
            x = f.get((c.donor_id, s))
            ch4, n2o, sl = (x.ch4_ef, x.n2o_ef, x.sludge) if x else (0, 0, 0)
            safe = c.BOD_intoSecondary * ch4
            dig = c.BOD_intoSecondary * sl * c.ad_ratio * rates[s][0] * rates[s][1]
            gas = c.TN_intoSecondary * n2o
            rows.append((safe, dig, safe + dig, gas, (safe + dig) * 27 + gas * 273))
        out[c.row_id] = (c, np.array(rows))
    return out


TARGETS = ["CH4_Safetreated", "CH4_AD", "CH4_inPlant", "N2O_Safetreated", "CO2e_total"]


def test_levels_match_city_by_city_sums(spark, run):
    loads, factors = run
    keys = ["NAME_0", "Continent", "Income_Level", "Region"]
    levels = {"country": ["NAME_0"], "region": ["NAME_0", "Region"], "global": []}
    emissions = level_emissions(group_emissions(loads, factors, keys, 7), levels)
    table = {(r.level, r.key): r for r in level_table(emissions, level_loads(loads, levels)).collect()}
    hand = by_hand(spark, loads, factors, 7)
    for (level, key), r in table.items():
        mine = [m for c, m in hand.values() if level == "global" or key == (
            c.NAME_0 if level == "country" else f"{c.NAME_0} | {c.Region}")]
        total = np.sum(mine, axis=0)
        for j, name in enumerate(TARGETS):
            want = [total[:, j].mean(), *np.percentile(total[:, j], [2.5, 50, 97.5])]
            assert np.allclose([r[f"{name}_{s}"] for s in ("Mean", "P2_5", "Median", "P97_5")], want)
        assert r.CH4_Safetreated_P2_5 <= r.CH4_Safetreated_Median <= r.CH4_Safetreated_P97_5
        assert np.isclose(r.CH4_EF_safetreated_Mean * r.BOD_intoSecondary_Total, r.CH4_Safetreated_Mean)
    assert len(table) == 2 + 4 + 1


def test_city_quantiles_match_numpy(spark, run):
    loads, factors = run
    table = {r.row_id: r for r in city_table(loads, donor_series(factors, 7), "row_id").collect()}
    for row_id, (c, m) in by_hand(spark, loads, factors, 7).items():
        r = table[row_id]
        for j, name in enumerate(TARGETS):
            want = [m[:, j].mean(), *np.percentile(m[:, j], [2.5, 50, 97.5])]
            assert np.allclose([r[f"{name}_{s}"] for s in ("Mean", "P2_5", "Median", "P97_5")], want)
    assert table[0].CH4_EF_Defined == 0 and table[0].CH4_EF_inPlant_Median == 0.0
    assert table[2].CO2e_total_P97_5 == 0.0


def test_interval_flags(spark):
    draws = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 0.0)], "g string, v double")
    truth = spark.createDataFrame([("a", 99.0), ("b", 0.0)], "g string, true_value double")
    got = {r.g: r for r in interval_summary(draws, ["g"], "v", truth).collect()}
    assert (got["a"].in_pi, got["a"].pi_width, got["a"].rel_diff_pct) == (0, 95.0, -49.49)
    assert (got["b"].in_pi, got["b"].pi_width_rel_pct, got["b"].rel_diff_pct) == (1, None, None)
