"""The three runs end to end on small invented tables."""

import random

import pytest
from pyspark.sql import functions as F

from catchment.functions.emissions import ACTIVITY_COLUMNS
from catchment.operators.draws import build_pools, index_records
from catchment.operators.jobstate import SettingsChanged
from catchment.operators.models import BoosterSettings, ForestSettings
from catchment.operators.proba import full_matrix
from catchment.plans.analysis import ATTRIBUTES, SUM_COLUMNS, WEIGHTED_COLUMNS, analyse
from catchment.plans.digestion import FEATURES, POP
from catchment.plans.digestion import estimate as estimate_digestion
from catchment.plans import search as search_plan
from catchment.plans.emission import RunSettings, estimate
from catchment.plans.validation import holdout_run
from catchment.session import materialize, scratch_path

CLASSES = ["A", "B", "C"]


def city_rows(spark, rng, extra=()):
    rows = []
    for i in range(30):
        c = "XY"[i % 2]
        p = rng.choice(["p", "q", None])
        rows.append((i, c, p, rng.choice("st"), None, None, p or "none", *[rng.uniform(1, 50) for _ in ACTIVITY_COLUMNS]))
    names = ["row_id", "NAME_0", "NAME_1", "NAME_2", "NAME_3", "NAME_4", "Region", *ACTIVITY_COLUMNS]
    kinds = ["int"] + ["string"] * 6 + ["double"] * len(ACTIVITY_COLUMNS)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def pools_of(spark, size):
    n2o = spark.createDataFrame([(i, "ABC"[i % 3], 0.5 + i, "FB"[i % 2]) for i in range(30)],
                                "rec_id int, class string, N2OEF double, mark string")
    ch4 = spark.createDataFrame([(i, "AB"[i % 2], 0.1 + i / 100) for i in range(20)],
                                "rec_id int, class string, CH4EF double")
    fb = spark.createDataFrame([(i, "A", 0.2 + i / 10) for i in range(8)], "rec_id int, class string, FB double")
    types = spark.createDataFrame([(c,) for c in CLASSES], "class string")
    return materialize(build_pools(types, index_records(n2o, "class", ["rec_id"]), index_records(ch4, "class", ["rec_id"]),
                                   index_records(fb, "class", ["rec_id"]), "class", F.lit(0.5), size))


def test_emission_run(spark):
    rng = random.Random(3)
    plants = spark.createDataFrame(
        [(i, "XY"[i % 2], rng.choice(["p", "q", "s", "X", "Y", "zz"]), rng.uniform(0, 9), rng.choice(["A", None, "?"]))
         for i in range(25)], "plant_id int, NAME_0 string, Region string, served double, label string")
    predicted = spark.createDataFrame([(i, c, m, 0.05) for i in range(20) for c, m in zip(CLASSES, (0.5, 0.3, 0.2))],
                                      "plant_id int, class string, mean double, std double")
    countries = spark.createDataFrame([("X", "Asia", "Low income")], "country string, Continent string, Income_Level string")
    matrix = full_matrix(plants, predicted, "plant_id", "label", CLASSES)
    settings = RunSettings(n_sim=1500, pool_size=50, classes=CLASSES)
    out = estimate(city_rows(spark, rng), plants, matrix, pools_of(spark, 50), countries, "row_id", "plant_id",
                   "served", settings)
    levels = {(r.level, r.key): r for r in out["levels"].collect()}
    assert {k for lv, k in levels if lv == "continent"} == {"Asia", "Unknown"}
    total = levels[("global", "global")]
    for t in ("CH4_Safetreated", "CO2e_total"):
        parts = [r[f"{t}_Mean"] for (lv, _), r in levels.items() if lv == "country"]
        assert abs(sum(parts) - total[f"{t}_Mean"]) < 1e-9 * total[f"{t}_Mean"]
        assert total[f"{t}_P2_5"] < total[f"{t}_Median"] < total[f"{t}_P97_5"]
    cities = out["cities"].collect()
    assert len(cities) == 30
    assert abs(sum(r.CO2e_total_Mean for r in cities) - total.CO2e_total_Mean) < 1e-9 * total.CO2e_total_Mean


def test_digestion_run(spark):
    rng = random.Random(4)
    def plant(i, c):
        pop = rng.uniform(100, 5e5)
        rest = [rng.uniform(0, 30) if rng.random() > 0.05 else None for _ in FEATURES[1:]]
        return (i, c, rng.choice(["p", "q", "nan", None]), rng.uniform(10, 150), float(pop), *rest)
    columns = ("id int, NAME_0 string, Region string, `Decadal Average Precipitation` double, "
               + ", ".join(f"`{f}` double" for f in FEATURES))
    plants = spark.createDataFrame([plant(i, rng.choice(["Austria", "X"])) for i in range(60)], columns)
    observed = spark.createDataFrame([plant(100 + i, "Y") for i in range(120)], columns).withColumn(
        "Anaerobic Digestion", F.when(F.col(POP) > 2e5, "1").otherwise("no"))
    out = estimate_digestion(observed, plants, city_rows(spark, rng), "id", "row_id",
                             settings=BoosterSettings(max_iter=3, max_depth=2))
    predicted = out["predicted"]
    assert {r.NAME_0 for r in predicted.select("NAME_0").distinct().collect()} == {"Austria"}
    right = predicted.where((F.col("Predicted_Anaerobic") == "Anaerobic") == (F.col(POP) > 2e5)).count()
    assert right >= 0.9 * predicted.count()
    assert out["climates"].agg(F.sum("n_plants")).first()[0] == 60
    cities = out["cities"].collect()
    # The districts below p and q have no data of their own and inherit it.
    inside = [r for r in cities if r.NAME_0 == "X" and r.NAME_1]
    assert len(cities) == 30 and inside
    assert {(r.Data_Source, r.Admin_Match_Level) for r in inside} == {("Propagated", "NAME_2")}
    assert all(r.Sewer_CH4_per_capita_kg_d > 0 for r in inside)


def test_analysis_run(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        c = rng.choice(["Kuwait", "X", "Y"])
        rows.append((i, c, rng.choice(["p", "", None]), rng.choice(["s", "", None]), "Asia" if c != "Y" else None, "High",
                     rng.uniform(1, 9), rng.choice([None, 2.0]), *[rng.uniform(0, 10) for _ in SUM_COLUMNS],
                     *[rng.uniform(0, 1) for _ in WEIGHTED_COLUMNS]))
    names = ["row_id", "NAME_0", "NAME_1", "NAME_2", *ATTRIBUTES, "Population", "GDP_PerCapita_PPP", *SUM_COLUMNS, *WEIGHTED_COLUMNS]
    kinds = ["int"] + ["string"] * 5 + ["double"] * (len(names) - 6)
    cities = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    inventory = spark.createDataFrame(
        [("X", "CH4", "Wastewater", 1.0), ("X", "CH4", "Energy", 2.0), ("X", "N2O", "Soils", 3.0), ("Kuwait", "CH4", "WASTEWATER", 4.0)],
        "Country string, Substance string, source string, Y_2022 double")
    out = analyse(cities, inventory, "row_id")
    share = out["country"].agg(F.sum("GHG_WWTP_GlobalShare_pct")).first()[0]
    assert abs(share - 100) < 1e-9
    assert out["country"].columns[:3] == ["NAME_0", "Income_Level", "GHG_WWTP"]
    assert {r.City_Level for r in out["prepared"].where("NAME_0 = 'Kuwait'").collect()} == {"Country_as_City"}
    assert out["continent"].count() == 1
    ranked = {r.Country: (r.CH4, r.CH4_Rank, r.N2O_Rank) for r in out["ranking"].collect()}
    assert ranked == {"Kuwait": (4.0, 1, None), "X": (1.0, 2, None)}
    row = out["comparison"].where("Country = 'X'").first()
    assert row.CH4_inventory_total == 3.0 and row.N2O_inventory_rank is None and row.N2O_our_rank is not None
    no_year = analyse(cities, inventory.drop("Y_2022"), "row_id")
    assert "comparison" in no_year and "ranking" not in no_year


def test_holdout_run(spark):
    rows = spark.range(160).select(
        F.col("id"), F.when(F.col("id") < 40, "J").otherwise("other").alias("country"),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("id") % 3 + 1).cast("int")).alias("label"),
        (F.col("id") % 3 * 100 + 50.0).alias("pop"), (F.col("id") % 3 + F.rand(1)).alias("x"))
    reference = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "class string, reference double")
    settings = {b: ForestSettings(3, 3) for b in ("small: 0-2000",)}
    out = holdout_run(rows, "id", "label", "country", "pop", ["x"], settings, pools_of(spark, 30),
                      {"N2O": reference, "CH4": reference}, CLASSES, 50, 30, 2, 1, ["J", "absent"])
    assert {(r.country, r.status) for r in out["jobs"].collect()} == {("J", "run"), ("absent", "name not found")}
    got = out["intervals"].collect()
    assert {(r.country, r.holdout, r.gas) for r in got} == {("J", "50", "N2O"), ("J", "50", "CH4")}
    assert all(r.pred_p2_5 <= r.pred_median <= r.pred_p97_5 for r in got)
    assert out["few"].first().n_plants == out["probabilities"].select("id").distinct().count() in range(18, 23)
    assert out["summary"].count() == 2


def test_a_search_goes_on_and_stops_on_other_settings(spark, monkeypatch):
    rows = spark.range(90).select(
        F.col("id"), F.lit("small").alias("bucket"),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("id") % 3 + 1).cast("int")).alias("label"),
        (F.col("id") % 7 + 1.0).alias("pop"), (F.col("id") % 3 + F.rand(1)).alias("x"))
    reference = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "class string, reference double")
    sets = {"a": ForestSettings(2, 2), "b": ForestSettings(2, 3)}
    fits = []
    real = search_plan.score_parameters
    monkeypatch.setattr(search_plan, "score_parameters", lambda *a, **k: fits.append(list(a[5])) or real(*a, **k))

    def run(keys, seed=1, progress=None):
        out = search_plan.search(rows, "id", "label", ["x"], "bucket", "pop", {k: sets[k] for k in keys}, 2, 1,
                                 seed, pools_of(spark, 30), {"N2O": reference, "CH4": reference}, CLASSES, 20, 30,
                                 keep=2, progress=progress)
        return sorted(map(str, out.collect()))

    folder = scratch_path(spark, "progress")
    run(["a"], progress=folder)
    resumed = run(["a", "b"], progress=folder)
    assert fits == [["a"], ["b"]]
    assert resumed == run(["a", "b"])
    with pytest.raises(SettingsChanged, match="seed: 1 -> 2"):
        run(["a", "b"], seed=2, progress=folder)


def test_a_search_computes_its_pools_once_for_all_sets(spark, monkeypatch):
    rows = spark.range(90).select(
        F.col("id"), F.lit("small").alias("bucket"),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("id") % 3 + 1).cast("int")).alias("label"),
        (F.col("id") % 7 + 1.0).alias("pop"), (F.col("id") % 3 + F.rand(1)).alias("x"))
    reference = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "class string, reference double")
    computed = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        computed.add(1)
        return value

    pools = pools_of(spark, 30).withColumn("ch4_ef", counted.asNondeterministic()("ch4_ef"))
    read = []
    real = search_plan.fold_scores

    def scores(*given):
        read.append([sorted(t.inputFiles()) for t in (given[5], *given[6].values())])
        return real(*given)

    monkeypatch.setattr(search_plan, "fold_scores", scores)
    sets = {"a": ForestSettings(2, 2), "b": ForestSettings(2, 3)}
    out = search_plan.search(rows, "id", "label", ["x"], "bucket", "pop", sets, 2, 1, 1, pools,
                             {"N2O": reference, "CH4": reference}, CLASSES, 20, 30, keep=2)
    assert {r.param_key for r in out.collect()} == {"a", "b"}
    assert computed.value == pools.count()
    assert len(read) == 2 and read[0] == read[1] and all(read[0])
