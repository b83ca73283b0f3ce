"""Activity, emission targets, inventory comparison and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.emissions import emission_targets, secondary_loads, total_loads
from ..operators.compare import inventory_comparison, inventory_wide, sector_ranking
from ..operators.match import sewer_emissions
from ..plans.analysis import analyse
from ..plans.digestion import region_table
from ..plans.emission import city_loads
from .aggregates import LOADS_SQL
from .helpers import rounded
from .joins import SEWER_MATCH_SQL
from .registry import query

GASES = ["CH4", "N2O"]
TOTALS = {g: f"{g}_Total" for g in GASES}
PARTS = {g: f"{g}_WWTP" for g in GASES}


@query("E1_city_activity", f"""
WITH {LOADS_SQL} SELECT row_id, round(BOD_all, 12) AS BOD_all, round(TN_all, 12) AS TN_all FROM loads /* {{city}} */""")
def e1(t):
    return rounded(t.role("city").select("row_id", *[c.alias(n) for n, c in total_loads().items()]), 12)


@query("E2_secondary_loads", f"""
WITH {LOADS_SQL} SELECT row_id, round(bod, 9) AS BOD_intoSecondary, round(tn, 9) AS TN_intoSecondary
FROM loads /* {{city}} */""")
def e2(t):
    totals = t.role("city").select("*", *[c.alias(n) for n, c in total_loads().items()])
    loads = secondary_loads(F.col("BOD_all"), F.col("TN_all"))
    return rounded(totals.select("row_id", *[c.alias(n) for n, c in loads.items()]), 9)


@query("E3_emission_targets", f"""
WITH {LOADS_SQL},
x AS (SELECT row_id, bod * 0.1 AS safe, bod * ad_ratio * 0.6 * 0.55 * 0.05 AS dig, tn * 0.01 AS n2o FROM loads)
SELECT row_id, round(safe, 9) AS CH4_Safetreated, round(dig, 9) AS CH4_AD, round(safe + dig, 9) AS CH4_inPlant,
  round(n2o, 9) AS N2O_Safetreated, round((safe + dig) * 27 + n2o * 273, 9) AS CO2e_total FROM x /* {{city}} */""")
def e3(t):
    loads = city_loads(t.role("city"))
    bod, tn = F.col("BOD_intoSecondary"), F.col("TN_intoSecondary")
    targets = emission_targets(bod, tn, bod * F.col("ad_ratio"), F.lit(0.1), F.lit(0.01),
                               F.lit(0.6), F.lit(0.55), F.lit(0.05))
    return rounded(loads.select("row_id", *[c.alias(n) for n, c in targets.items()]), 9)


@query("E4_sewer_chain", f"""
WITH {SEWER_MATCH_SQL}
SELECT plant_id, climate AS Sewer_Climate, net AS Matched_Network, round(served * 200 / 1e6, 9) AS Q_ML_d,
  round(e * (served * 200 / 1e6), 9) AS Sewer_CH4_kg_d, round(e * (served * 200 / 1e6) * 365 / 1000, 9) AS Sewer_CH4_t_yr,
  round(e * (served * 200 / 1e6) * 365 / 1000 * 27, 9) AS Sewer_CO2e_t_yr,
  round(e * (served * 200 / 1e6) * 365 / 1000 * 27 / 1000, 9) AS Sewer_CO2e_kt_yr FROM best /* {{sewered}} */""")
def e4(t):
    out = sewer_emissions(t.role("sewered"), "served", "temperature", "precipitation")
    return rounded(out.select("plant_id", "Sewer_Climate", "Matched_Network", "Q_ML_d", "Sewer_CH4_kg_d",
                              "Sewer_CH4_t_yr", "Sewer_CO2e_t_yr", "Sewer_CO2e_kt_yr"), 9)


@query("E4_region_table", f"""
WITH {SEWER_MATCH_SQL},
b AS (SELECT * FROM best),
dig AS (SELECT NAME_0, Region, CASE WHEN coalesce(sum(served), 0) > 0 THEN
    sum(CASE WHEN precipitation < 60 THEN coalesce(served, 0) ELSE 0 END) / sum(served) ELSE 0 END AS r,
    coalesce(sum(served), 0) AS w FROM sewered WHERE NAME_0 <> 'NATION_4' GROUP BY 1, 2),
sew AS (SELECT NAME_0, Region, CASE WHEN coalesce(sum(served), 0) > 0 THEN coalesce(sum(e * (served * 200 / 1e6)), 0) / sum(served) ELSE 0 END AS i,
    coalesce(sum(served), 0) AS w FROM b GROUP BY 1, 2)
SELECT coalesce(dig.NAME_0, sew.NAME_0) AS NAME_0, coalesce(dig.Region, sew.Region) AS Region,
  round(r, 9) AS Anaerobic_digestion_ratio, round(i, 12) AS Sewer_CH4_per_capita_kg_d,
  round(greatest(coalesce(dig.w, sew.w), coalesce(sew.w, dig.w)), 2) AS Total_Served_Population
FROM dig FULL JOIN sew ON dig.NAME_0 = sew.NAME_0 AND dig.Region = sew.Region /* {{sewered}} */""")
def e4_regions(t):
    plants = t.role("sewered")
    sewer = sewer_emissions(plants, "served", "temperature", "precipitation")
    status = plants.where(F.col("NAME_0") != "NATION_4").withColumn(
        "status", F.when(F.col("precipitation") < 60, "Anaerobic").otherwise("Non-Anaerobic"))
    out = region_table(status, sewer, "served", "status")
    out = rounded(rounded(out, 2, ["Total_Served_Population"]), 9, ["Anaerobic_digestion_ratio"])
    return rounded(out, 12, ["Sewer_CH4_per_capita_kg_d"])


def query_inventory(t):
    inventory = t.role("inventory").where(F.col("Country") != "NATION_9")
    gone = (F.col("Country") == "NATION_2") & F.coalesce(
        F.lower("source").contains("wastewater"), F.lit(False))
    return inventory.where(~gone)


@query("E6_inventory_comparison", """
WITH inv AS (SELECT Country, Substance, Y_2022 AS v, coalesce(lower(source) LIKE '%wastewater%', FALSE) AS ww
        FROM {inventory} WHERE Country <> 'NATION_9' AND NOT (Country = 'NATION_2' AND coalesce(lower(source) LIKE '%wastewater%', FALSE))),
agg AS (SELECT Country, Substance,
    CASE WHEN count(*) FILTER (WHERE ww) > 0 THEN coalesce(sum(v) FILTER (WHERE ww), 0) END AS ow,
    CASE WHEN count(*) FILTER (WHERE NOT ww) > 0 THEN coalesce(sum(v) FILTER (WHERE NOT ww), 0) END AS oo
  FROM inv GROUP BY 1, 2),
g AS (SELECT Country, 'CH4' AS Substance, CH4_Total AS tot, CH4_WWTP AS part FROM {ours}
      UNION ALL SELECT Country, 'N2O', N2O_Total, N2O_WWTP FROM {ours}),
rk AS (SELECT g.Country, g.Substance, count(*) FILTER (WHERE v > agg.ow) + 1 AS rw,
    count(*) FILTER (WHERE v > g.tot) + 1 AS rt, count(*) FILTER (WHERE v > g.part) + 1 AS rp
  FROM g JOIN inv ON inv.Country = g.Country AND inv.Substance = g.Substance AND NOT inv.ww
  LEFT JOIN agg ON agg.Country = g.Country AND agg.Substance = g.Substance GROUP BY 1, 2)
SELECT g.Country, g.Substance, round(oo, 2) AS other_sectors, round(ow, 2) AS inventory_ww,
  round(oo + ow, 2) AS inventory_total, CASE WHEN oo + ow > 0 THEN round(ow / (oo + ow) * 100, 9) END AS inventory_share_pct,
  CASE WHEN ow IS NOT NULL THEN rw END AS inventory_rank, round(oo + tot, 2) AS corrected_total,
  CASE WHEN oo + tot > 0 THEN round(tot / (oo + tot) * 100, 9) END AS our_share_pct, rt AS our_rank,
  CASE WHEN oo + tot > 0 THEN round(part / (oo + tot) * 100, 9) END AS our_part_share_pct, rp AS our_part_rank
FROM g LEFT JOIN agg ON agg.Country = g.Country AND agg.Substance = g.Substance
LEFT JOIN rk ON rk.Country = g.Country AND rk.Substance = g.Substance""")
def e6(t):
    out = inventory_comparison(t.role("ours"), query_inventory(t), GASES, TOTALS, PARTS, "Y_2022")
    money = ["other_sectors", "inventory_ww", "inventory_total", "corrected_total"]
    return rounded(rounded(out, 2, money), 9, [c for c in out.columns if c.endswith("_pct")])


@query("E6_inventory_wide", """
WITH x AS (SELECT Country, Substance, coalesce(lower(source) LIKE '%wastewater%', FALSE) AS ww, Y_2022 AS v FROM {inventory}),
y AS (SELECT Country, Substance, CASE WHEN bool_or(ww) AND bool_or(NOT ww) THEN sum(v) END AS total FROM x GROUP BY 1, 2)
SELECT o.Country, round(max(CASE WHEN Substance = 'CH4' THEN total END), 2) AS ch4_total,
  round(max(CASE WHEN Substance = 'N2O' THEN total END), 2) AS n2o_total
FROM {ours} o LEFT JOIN y ON y.Country = o.Country GROUP BY 1""")
def e6_wide(t):
    long = inventory_comparison(t.role("ours"), t.role("inventory"), GASES, TOTALS, PARTS, "Y_2022")
    wide = inventory_wide(long, GASES)
    return rounded(wide.select("Country", F.col("CH4_inventory_total").alias("ch4_total"),
                               F.col("N2O_inventory_total").alias("n2o_total")), 2)


@query("E7_sector_ranking", """
WITH ww AS (SELECT * FROM {inventory} WHERE lower(source) LIKE '%wastewater%' AND Country <> 'NATION_9'),
p AS (SELECT Country,
    CASE WHEN count(*) FILTER (WHERE Substance = 'CH4') > 0 THEN round(sum(Y_2022) FILTER (WHERE Substance = 'CH4'), 2) END AS CH4,
    CASE WHEN count(*) FILTER (WHERE Substance = 'N2O') > 0 THEN round(sum(Y_2022) FILTER (WHERE Substance = 'N2O'), 2) END AS N2O
  FROM ww GROUP BY 1),
k AS (SELECT Country, CH4, N2O, CASE WHEN CH4 IS NOT NULL OR N2O IS NOT NULL THEN round(coalesce(CH4, 0) + coalesce(N2O, 0), 2) END AS GHG
      FROM p WHERE Country IN (SELECT Country FROM {ours}))
SELECT Country, CH4, N2O, GHG, round(CH4 / (SELECT sum(CH4) FROM k) * 100, 9) AS "CH4_GlobalShare_pct",
  round(N2O / (SELECT sum(N2O) FROM k) * 100, 9) AS "N2O_GlobalShare_pct",
  round(GHG / (SELECT sum(GHG) FROM k) * 100, 9) AS "GHG_GlobalShare_pct",
  CASE WHEN CH4 IS NOT NULL THEN rank() OVER (ORDER BY CH4 DESC NULLS LAST) END AS "CH4_Rank",
  CASE WHEN N2O IS NOT NULL THEN rank() OVER (ORDER BY N2O DESC NULLS LAST) END AS "N2O_Rank",
  CASE WHEN GHG IS NOT NULL THEN rank() OVER (ORDER BY GHG DESC NULLS LAST) END AS "GHG_Rank" FROM k""")
def e7(t):
    out = sector_ranking(query_inventory_ranked(t), t.role("ours"), GASES, "Y_2022")
    return rounded(rounded(out, 2, ["CH4", "N2O", "GHG"]), 9,
                   [c for c in out.columns if c.endswith("_pct")]).orderBy(F.col("GHG").desc_nulls_last())


def query_inventory_ranked(t):
    return t.role("inventory").where(F.col("Country") != "NATION_9")


ANALYSIS_COLUMNS = ["CH4_WWTP", "CH4_Sewer", "CH4_unsafelytreated", "CH4_eff", "CH4_Total",
                    "N2O_WWTP", "N2O_unsafelytreated", "N2O_eff", "N2O_Total"]


def accounts(t):
    """Customers with their orders as a city emission table."""
    spent = t.orders.groupBy(F.col("o_custkey").alias("row_id")).agg(
        F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("n"))
    cities = t.role("city").join(spent, "row_id", "left")
    amount = {c: (F.col("spent") * (i + 1) / 1000).alias(c) for i, c in enumerate(ANALYSIS_COLUMNS)}
    return cities.select(
        "row_id", "NAME_0", "NAME_1", "NAME_2", "Continent", "Income_Level", "Population",
        F.col("BOD_PerCapita").alias("GDP_PerCapita_PPP"), *amount.values(),
        (F.col("spent") / F.col("n")).alias("CH4_Intensity"), F.col("n").cast("double").alias("N2O_Intensity"))


@query("E6_country_analysis", """
WITH s AS (SELECT o_custkey AS row_id, sum(o_totalprice) AS spent, count(*) AS n FROM orders GROUP BY 1),
x AS (SELECT c.*, spent, n FROM {city} c LEFT JOIN s ON s.row_id = c.row_id)
SELECT NAME_0, arg_min(Income_Level, row_id) AS Income_Level, round(coalesce(sum(spent * 1 / 1000 + spent * 6 / 1000), 0) / 1000, 6) AS GHG_WWTP,
  round(sum(Population), 2) AS Population, round(sum(Population * BOD_PerCapita), 2) AS GDP_Total,
  round(sum(CASE WHEN n IS NOT NULL AND Population > 0 THEN n * Population END) / sum(CASE WHEN n IS NOT NULL AND Population > 0 THEN Population END), 9) AS N2O_Intensity,
  round(sum(Population) / (SELECT sum(Population) FROM x) * 100, 9) AS "Population_GlobalShare_pct"
FROM x GROUP BY 1""")
def e6_analysis(t):
    table = analyse(accounts(t), None, "row_id")["country"]
    out = table.select("NAME_0", "Income_Level", "GHG_WWTP", "Population", "GDP_Total", "N2O_Intensity",
                       "Population_GlobalShare_pct")
    out = rounded(rounded(out, 2, ["Population", "GDP_Total"]), 6, ["GHG_WWTP"])
    return rounded(out, 9, ["N2O_Intensity", "Population_GlobalShare_pct"])
