"""Uncertainty propagation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.emissions import (CH4_DEFAULTS, CLASS_COEFFICIENTS, EFFECTIVE_FACTORS, N2O_DEFAULTS,
                                   TARGETS)
from ..functions.uniform import digest
from ..operators.aggregate import weighted_rate
from ..operators.draws import (STATS, beta_classes, beta_parameters, beta_probabilities, city_reductions, city_table,
                               distribution, donor_series, draw_ch4, draw_factors, draw_n2o,
                               expand_draws, group_emissions, group_factors, index_records,
                               iterations, level_emissions, level_loads, level_table,
                               mixture_factors, pool_status, pool_table, redrawn_factor, with_blocks, with_class_cdf,
                               with_shared_draws)
from ..operators.proba import full_matrix, to_arrays
from ..plans.emission import (LEVELS, RunSettings, city_loads, draw_donors, informed_plants,
                              map_cities)
from ..session import materialize
from .aggregates import LOADS_SQL, query_pools
from .helpers import rounded
from .hierarchy import (INFORMED_SQL, LOOKUP_SQL, MEMBERS_SQL, SMALL, fill_sql, match_sql, nodes_sql)
from .joins import MATRIX_SQL
from .registry import normal, query, u
from .roles import CLASS_ROWS, CLASSES

N_SIM, POOL, SEED = 20, 100, 42
SETTINGS = RunSettings(n_sim=N_SIM, pool_size=POOL, seed=SEED, classes=CLASSES,
                       probability_uncertainty=False, fast=False, small_country=SMALL)


def rates_sql(sim: str = "sim") -> tuple[str, str]:
    key = f"'{SEED}|' || {sim} || '|rates'"
    gen = f"least(greatest(0.55 + 0.165 * {normal(u(key, 0), u(key, 1))}, 0.0), 1.0)"
    return gen, f"(0.1 * {u(key, 2)})"


GEN, LEAK = rates_sql()


@query("D1_shared_draws", f"""
WITH n AS (SELECT n_name, sum(c_acctbal) AS load FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_name, sim::INT AS sim, round({GEN}, 9) AS gen, round({LEAK}, 9) AS leak, round(load * {GEN} * {LEAK}, 6) AS digestion
FROM n, (SELECT unnest(range({N_SIM})) AS sim)""")
def d1(t):
    loads = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy("n_name").agg(F.sum("c_acctbal").alias("load")))
    drawn = with_shared_draws(loads.select("*", iterations(N_SIM).alias("sim")), "sim", SEED)
    out = drawn.select("n_name", "sim", "gen", "leak",
                       (F.col("load") * F.col("gen") * F.col("leak")).alias("digestion"))
    return rounded(rounded(out, 9, ["gen", "leak"]), 6, ["digestion"])


INDEXED_SQL = """
ni AS (SELECT class, mark, N2OEF, row_number() OVER (PARTITION BY class ORDER BY md5('0|' || rec_id), rec_id) - 1 AS pos,
         count(*) OVER (PARTITION BY class) AS n FROM n2o),
fi AS (SELECT class, FB, row_number() OVER (PARTITION BY class ORDER BY md5('0|' || rec_id), rec_id) - 1 AS pos,
         count(*) OVER (PARTITION BY class) AS n FROM fb WHERE class IS NOT NULL),
ci AS (SELECT class, CH4EF, row_number() OVER (PARTITION BY class ORDER BY md5('0|' || rec_id), rec_id) - 1 AS pos,
         count(*) OVER (PARTITION BY class) AS n FROM ch4 WHERE class IS NOT NULL)"""

CH4_DEFAULT_SQL = "CASE r.class WHEN 'Pond' THEN 0.102 WHEN 'Lagoon' THEN 0.102 WHEN 'Anaerobic' THEN 0.408 END::DOUBLE"


def pools_sql(size: int = POOL) -> str:
    """CTE ``pool`` (class_idx, class, slot, n2o_ef, ch4_ef)."""
    k1 = f"'{SEED}|pool|' || r.class || '|' || r.slot"
    k2 = f"'{SEED}|pool-ch4|' || r.class || '|' || r.slot"
    return f"""{INDEXED_SQL},
req AS (SELECT i AS class_idx, class, slot FROM (VALUES {CLASS_ROWS}) AS c(i, class), (SELECT unnest(range({size})) AS slot)),
pool AS (SELECT r.class_idx, r.class, r.slot,
    CASE WHEN r.class = 'Anaerobic' THEN 0.0 WHEN ni.mark = 'F' THEN ni.N2OEF / 100
      ELSE ni.N2OEF / 100 / coalesce(fi.FB, (SELECT avg(FB) FROM fb WHERE class IS NOT NULL)) END AS n2o_ef,
    coalesce(abs({CH4_DEFAULT_SQL} + {CH4_DEFAULT_SQL} * 0.3 * {normal(u(k2, 2), u(k2, 3))}), ci.CH4EF) AS ch4_ef
  FROM req r
  LEFT JOIN ni ON ni.class = r.class AND ni.pos = floor({u(k1, 0)} * ni.n)
  LEFT JOIN fi ON fi.class = r.class AND fi.pos = floor({u(k1, 1)} * fi.n)
  LEFT JOIN ci ON ci.class = r.class AND ci.pos = floor({u(k2, 0)} * ci.n))"""


@query("D2_factor_pools", f"""
WITH {pools_sql()} SELECT class, slot::INT AS slot, n2o_ef, round(ch4_ef, 9) AS ch4_ef
FROM pool /* {{n2o}} {{fb}} {{ch4}} */""")
def d2(t):
    return rounded(query_pools(t, POOL), 9, ["ch4_ef"])


@query("A28_pool_status", f"""
WITH {pools_sql()} SELECT class, round(avg(ch4_ef), 9) AS ch4_mean, round(avg(n2o_ef), 9) AS n2o_mean,
  CASE WHEN class IN ('Pond', 'Lagoon', 'Anaerobic') THEN 'default value' WHEN avg(ch4_ef) IS NULL THEN 'no record, counted as zero'
    ELSE 'drawn records' END AS ch4_source
FROM pool GROUP BY 1 /* {{n2o}} {{fb}} {{ch4}} */""")
def a28_status(t):
    return rounded(pool_status(query_pools(t, POOL), "class"), 9)


def redrawn_sql(base: str, parts: str) -> str:
    def draw(i):
        key = f"'{SEED}|' || {parts} || '|try{i}'"
        return f"({base} + {base} * 0.3 * {normal(u(key, 0), u(key, 1))})"
    cases = " ".join(f"WHEN {draw(i)} >= 0 THEN {draw(i)}" for i in range(10))
    return f"CASE {cases} ELSE abs({draw(10)}) END"


@query("D3_single_draws", f"""
WITH {INDEXED_SQL},
r AS (SELECT plant_id, class FROM predicted),
k AS (SELECT r.*, '{SEED}|' || plant_id || '|' || class AS key FROM r)
SELECT r.plant_id, r.class, CASE WHEN r.class = 'Anaerobic' THEN 0.0 WHEN ni.mark = 'F' THEN ni.N2OEF
    ELSE ni.N2OEF / coalesce(fi.FB, (SELECT avg(FB) FROM fb WHERE class IS NOT NULL)) END AS n2o_ef,
  round(CASE WHEN r.class IN ('Pond', 'Lagoon', 'Anaerobic') THEN {redrawn_sql(CH4_DEFAULT_SQL, "r.plant_id || '|' || r.class")} ELSE ci.CH4EF END, 9) AS ch4_ef
FROM k r
LEFT JOIN ni ON ni.class = r.class AND ni.pos = floor({u('r.key', 0)} * ni.n)
LEFT JOIN fi ON fi.class = r.class AND fi.pos = floor({u('r.key', 1)} * fi.n)
LEFT JOIN ci ON ci.class = r.class AND ci.pos = floor({u('r.key', 0)} * ci.n) /* {{n2o}} {{fb}} {{ch4}} {{predicted}} */""")
def d3(t):
    ratios = t.role("fb").where(F.col("class").isNotNull())
    n2o = index_records(t.role("n2o"), "class", ["rec_id"])
    fb = index_records(ratios, "class", ["rec_id"])
    ch4 = index_records(t.role("ch4").where(F.col("class").isNotNull()), "class", ["rec_id"])
    overall = ratios.agg(F.avg("FB").alias("m")).scalar()
    parts = [F.col("plant_id"), F.col("class")]
    requests = t.role("predicted").select("plant_id", "class").withColumn(
        "__key", digest(SEED, *parts))
    drawn = draw_n2o(requests, n2o, fb, "class", "__key", "N2OEF", "mark", "FB", overall,
                     defaults=N2O_DEFAULTS)
    drawn = draw_ch4(drawn, ch4, "class", "__key", "CH4EF", CH4_DEFAULTS,
                     default_draw=lambda base: redrawn_factor(base, SEED, parts))
    return rounded(drawn.select("plant_id", "class", "n2o_ef", "ch4_ef"), 9, ["ch4_ef"])


@query("D4_beta_parameters", """
WITH x AS (SELECT plant_id, class, least(greatest(mean, 0.001), 0.999) AS m, std FROM {predicted}),
y AS (SELECT *, least(std * std, m * (1 - m) * 0.99) AS v FROM x),
z AS (SELECT *, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 END AS cf FROM y)
SELECT plant_id, class, round(m, 9) AS m, round(CASE WHEN cf > 0 THEN m * cf ELSE 1 END, 6) AS a,
  round(CASE WHEN cf > 0 THEN (1 - m) * cf ELSE 1 END, 6) AS b, coalesce(cf > 0, FALSE) AS ok FROM z""")
def d4(t):
    cells = beta_parameters(F.col("mean"), F.col("std"))
    out = t.role("predicted").select("plant_id", "class", *[c.alias(n) for n, c in cells.items()])
    return rounded(rounded(out, 9, ["m"]), 6, ["a", "b"])


BETA_KEY = f"'{SEED}|' || sim || '|' || plant_id || '|' || i || '|beta|' || n"


def proposals_sql(cells: str, low: int, high: int) -> str:
    """First accepted proposal of rounds ``low`` to ``high`` for each cell, NULL where all fail."""
    def half(k: int) -> str:
        return (f"SELECT c.*, 2 * n + {k} AS place, {u(BETA_KEY, 2 * k)} + power(2, -33) AS x, "
                f"{u(BETA_KEY, 2 * k + 1)} + power(2, -33) AS y FROM {cells} c, (SELECT unnest(range({low}, {high})) AS n)")
    return f"""SELECT plant_id, i, sim, arg_min(CASE WHEN turned THEN q / (q + w) ELSE w / (q + w) END, place)
        FILTER (WHERE gamma * v - ln(4) + s * ln(s / (q + w)) >= ln(x * x * y)) AS value
      FROM (SELECT *, p * exp(v) AS w FROM (SELECT *, least(scale * ln(x / (1 - x)), 700) AS v FROM ({half(0)} UNION ALL {half(1)})))
      GROUP BY plant_id, i, sim"""


# The draws of a cell, try by try: envelope, proposals, the first that is accepted.
BETA_SQL = f"""
shaped AS (SELECT k.plant_id, c.i, c.class, mean, std, least(greatest(mean, 0.001), 0.999) AS m
  FROM (SELECT DISTINCT plant_id FROM predicted) k CROSS JOIN (VALUES {CLASS_ROWS}) AS c(i, class)
  LEFT JOIN predicted q ON q.plant_id = k.plant_id AND q.class = c.class),
fitted AS (SELECT *, CASE WHEN mean > 0 AND std > 0 THEN m * (1 - m) / least(std * std, m * (1 - m) * 0.99) - 1 END AS cf FROM shaped),
ab AS (SELECT plant_id, i, CASE WHEN cf > 0 THEN m * cf END AS a, CASE WHEN cf > 0 THEN (1 - m) * cf END AS b,
  CASE WHEN coalesce(mean, 0) <= 0 THEN 0.0 WHEN std > 0 THEN m ELSE least(mean, 1.0) END AS fixed FROM fitted),
scaled AS (SELECT *, a + b AS s, least(a, b) > 1 AS peaked,
  CASE WHEN least(a, b) > 1 THEN sqrt((a + b - 2) / (2 * a * b - (a + b))) ELSE 1 / least(a, b) END AS scale FROM ab),
envelope AS (SELECT plant_id, i, s, scale, fixed, CASE WHEN peaked THEN least(a, b) ELSE greatest(a, b) END AS p,
  CASE WHEN peaked THEN greatest(a, b) ELSE least(a, b) END AS q, CASE WHEN peaked THEN least(a, b) + 1 / scale ELSE s END AS gamma,
  a <> CASE WHEN peaked THEN least(a, b) ELSE greatest(a, b) END AS turned FROM scaled),
beta_cells AS (SELECT e.*, sim FROM envelope e, (SELECT unnest(range({N_SIM})) AS sim)),
early AS ({proposals_sql("(SELECT * FROM beta_cells WHERE s IS NOT NULL)", 0, 3)}),
late AS ({proposals_sql("(SELECT b.* FROM beta_cells b JOIN early e USING (plant_id, i, sim) WHERE e.value IS NULL)", 3, 24)}),
betas AS (SELECT b.plant_id, b.i, b.sim, CASE WHEN b.s IS NULL THEN b.fixed
    ELSE coalesce(e.value, l.value, CASE WHEN turned THEN q ELSE p END / s) END AS p
  FROM beta_cells b LEFT JOIN early e USING (plant_id, i, sim) LEFT JOIN late l USING (plant_id, i, sim))"""


@query("D5_beta_draws", f"""
WITH {BETA_SQL}
SELECT plant_id, sim::INT AS sim, c.class, round(p, 9)::DOUBLE AS p FROM betas JOIN (VALUES {CLASS_ROWS}) AS c(i, class) ON c.i = betas.i
/* {{predicted}} */""")
def d5(t):
    arrays = to_arrays(t.role("predicted"), "plant_id", CLASSES)
    drawn = beta_probabilities(arrays, "plant_id", N_SIM, SEED)
    names = F.array(*[F.lit(c) for c in CLASSES])
    return rounded(drawn.select("plant_id", "sim", F.posexplode("probs").alias("i", "p")).select(
        "plant_id", "sim", F.get(names, F.col("i")).alias("class"), "p"), 9, ["p"])


@query("D5_beta_moments", """
WITH x AS (SELECT plant_id, class, mean, std, least(greatest(mean, 0.001), 0.999) AS m FROM {predicted}),
z AS (SELECT *, CASE WHEN std > 0 THEN m * (1 - m) / least(std * std, m * (1 - m) * 0.99) - 1 END AS cf FROM x)
SELECT plant_id, class, 1500::BIGINT AS n, coalesce(mean > 0 AND cf > 0, FALSE) AS drawn, TRUE AS mean_fits FROM z""")
def d5_moments(t):
    """1500 draws, more than one block: which cells vary, and whether each mean is within six
    standard errors of its probability."""
    cells = t.role("predicted")
    drawn = beta_probabilities(to_arrays(cells, "plant_id", CLASSES), "plant_id", 1500, SEED)
    names = F.array(*[F.lit(c) for c in CLASSES])
    stats = (drawn.select("plant_id", F.posexplode("probs").alias("i", "p")).groupBy("plant_id", "i")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("avg"), (F.max("p") > F.min("p")).alias("drawn"))
             .withColumn("class", F.get(names, F.col("i"))).drop("i"))
    m = F.least(F.greatest("mean", F.lit(0.001)), F.lit(0.999))
    goal = F.when(F.col("mean") <= 0, 0.0).when(F.col("std") > 0, m).otherwise(F.least("mean", F.lit(1.0)))
    error = F.when(F.col("drawn"), F.least("std", F.sqrt(m * (1 - m)))).otherwise(0.0) / F.sqrt(F.lit(1500.0))
    return stats.join(cells.select("plant_id", "class", "mean", "std"), ["plant_id", "class"]).select(
        "plant_id", "class", "n", "drawn", (F.abs(F.col("avg") - goal) <= 6 * error + 1e-9).alias("mean_fits"))


ARRAYS_SQL = f"""
cells AS (SELECT plant_id, i, mean, is_known, sum(mean) OVER (PARTITION BY plant_id ORDER BY i) AS cum,
    sum(mean) OVER (PARTITION BY plant_id) AS total FROM matrix),
sims AS (SELECT unnest(range({N_SIM})) AS sim),
picks AS (SELECT plant_id, sim, CASE WHEN bool_or(is_known) THEN min(i) FILTER (WHERE mean = 1 AND is_known)
    WHEN max(total) <= 0 THEN -1
    ELSE coalesce(min(i) FILTER (WHERE {u(f"'{SEED}|' || sim || '|' || plant_id")} < cum / total), 0) END AS ci
  FROM cells, sims GROUP BY 1, 2)"""


def matrix_of(t):
    return full_matrix(t.role("plant"), t.role("predicted"), "plant_id", "label", CLASSES)


@query("D6_class_draws", f"""
WITH {MATRIX_SQL}, {ARRAYS_SQL} SELECT plant_id, sim::INT AS sim, ci::INT AS class_idx FROM picks /* {{plant}} {{predicted}} */""")
def d6(t):
    matrix = matrix_of(t)
    arrays = with_class_cdf(to_arrays(matrix, "plant_id", CLASSES), len(CLASSES))
    known = informed_plants(matrix, "plant_id", CLASSES).select("plant_id", "known_idx")
    rows = arrays.join(known, "plant_id", "left").select("plant_id", "cdf", "known_idx")
    return expand_draws(rows, "plant_id", N_SIM, SEED, len(CLASSES)).select(
        "plant_id", "sim", "class_idx")


BETA_MIX_KEY = f"'{SEED}|' || p.sim || '|' || p.plant_id || '|' || p.i"
MIX_KEY = f"'{SEED}|' || s.sim || '|' || p.plant_id || '|' || c.i"


@query("D7_plant_mixture", f"""
WITH {pools_sql()}, sims AS (SELECT unnest(range({N_SIM})) AS sim),
w AS (SELECT p.plant_id, c.i, p.mean / sum(p.mean) OVER (PARTITION BY p.plant_id) AS share, p.mean FROM predicted p
  JOIN (VALUES {CLASS_ROWS}) AS c(i, class) ON c.class = p.class),
x AS (SELECT p.plant_id, s.sim, sum(p.share * coalesce(a.ch4_ef, 0)) AS ch4_ef, sum(p.share * coalesce(b.n2o_ef, 0)) AS n2o_ef
  FROM w p JOIN (VALUES {CLASS_ROWS}) AS c(i, class) ON c.i = p.i CROSS JOIN sims s
  LEFT JOIN pool a ON a.class_idx = c.i AND a.slot = floor({u(MIX_KEY, 1)} * {POOL})
  LEFT JOIN pool b ON b.class_idx = c.i AND b.slot = floor({u(MIX_KEY, 2)} * {POOL}) GROUP BY 1, 2)
SELECT plant_id, round(avg(ch4_ef), 9) AS ch4_ef_Mean, round(quantile_cont(ch4_ef, 0.025), 9) AS ch4_ef_P2_5,
  round(quantile_cont(ch4_ef, 0.5), 9) AS ch4_ef_Median, round(quantile_cont(ch4_ef, 0.975), 9) AS ch4_ef_P97_5,
  0::BIGINT AS ch4_ef_Missing, round(avg(n2o_ef), 9) AS n2o_ef_Mean, round(quantile_cont(n2o_ef, 0.025), 9) AS n2o_ef_P2_5,
  round(quantile_cont(n2o_ef, 0.5), 9) AS n2o_ef_Median, round(quantile_cont(n2o_ef, 0.975), 9) AS n2o_ef_P97_5,
  0::BIGINT AS n2o_ef_Missing FROM x GROUP BY 1 /* {{n2o}} {{fb}} {{ch4}} {{predicted}} */""")
def d7(t):
    arrays = to_arrays(t.role("predicted"), "plant_id", CLASSES)
    pools = pool_table(materialize(query_pools(t, POOL), "pools"), CLASSES)
    mixed = mixture_factors(arrays.select("plant_id", F.col("means").alias("probs")), pools,
                            "plant_id", N_SIM, POOL, SEED, CLASSES)
    return rounded(distribution(mixed, ["plant_id"], ["ch4_ef", "n2o_ef"], bounded=True), 9)


@query("D7_plant_mixture_beta", f"""
WITH {pools_sql()}, {BETA_SQL},
w AS (SELECT plant_id, i, sim, p / sum(p) OVER (PARTITION BY plant_id, sim) AS share FROM betas),
x AS (SELECT p.plant_id, p.sim, sum(p.share * coalesce(a.ch4_ef, 0)) AS ch4_ef, sum(p.share * coalesce(b.n2o_ef, 0)) AS n2o_ef
  FROM w p
  LEFT JOIN pool a ON a.class_idx = p.i AND a.slot = floor({u(BETA_MIX_KEY, 1)} * {POOL})
  LEFT JOIN pool b ON b.class_idx = p.i AND b.slot = floor({u(BETA_MIX_KEY, 2)} * {POOL}) GROUP BY 1, 2)
SELECT plant_id, round(avg(ch4_ef), 9) AS ch4_ef_Mean, round(quantile_cont(ch4_ef, 0.025), 9) AS ch4_ef_P2_5,
  round(quantile_cont(ch4_ef, 0.5), 9) AS ch4_ef_Median, round(quantile_cont(ch4_ef, 0.975), 9) AS ch4_ef_P97_5,
  0::BIGINT AS ch4_ef_Missing, round(avg(n2o_ef), 9) AS n2o_ef_Mean, round(quantile_cont(n2o_ef, 0.025), 9) AS n2o_ef_P2_5,
  round(quantile_cont(n2o_ef, 0.5), 9) AS n2o_ef_Median, round(quantile_cont(n2o_ef, 0.975), 9) AS n2o_ef_P97_5,
  0::BIGINT AS n2o_ef_Missing FROM x GROUP BY 1 /* {{n2o}} {{fb}} {{ch4}} {{predicted}} */""")
def d7_beta(t):
    arrays = to_arrays(t.role("predicted"), "plant_id", CLASSES)
    pools = pool_table(materialize(query_pools(t, POOL), "pools"), CLASSES)
    mixed = mixture_factors(beta_probabilities(arrays, "plant_id", N_SIM, SEED), pools,
                            "plant_id", N_SIM, POOL, SEED, CLASSES)
    return rounded(distribution(mixed, ["plant_id"], ["ch4_ef", "n2o_ef"], bounded=True), 9)


def grouped_plants(t):
    return to_arrays(t.role("predicted"), "plant_id", CLASSES).join(
        t.role("plant").select("plant_id", "NAME_0", "served"), "plant_id")


FACTORS_SQL = f"""efs AS (SELECT p.plant_id, p.sim, a.ch4_ef, b.n2o_ef FROM picks p
  LEFT JOIN pool a ON a.class_idx = p.ci AND a.slot = floor({u(f"'{SEED}|' || p.sim || '|' || p.plant_id", 1)} * {POOL})
  LEFT JOIN pool b ON b.class_idx = p.ci AND b.slot = floor({u(f"'{SEED}|' || p.sim || '|' || p.plant_id", 2)} * {POOL}))"""

FIXED_SQL = f"""
cells AS (SELECT q.plant_id, c.i, sum(q.mean) FILTER (WHERE k.i <= c.i) AS cum, sum(q.mean) AS total
  FROM predicted q JOIN (VALUES {CLASS_ROWS}) AS k(i, class) ON k.class = q.class, (VALUES {CLASS_ROWS}) AS c(i, class) GROUP BY 1, 2),
sims AS (SELECT unnest(range({N_SIM})) AS sim),
picks AS (SELECT plant_id, sim, coalesce(min(i) FILTER (WHERE {u(f"'{SEED}|' || sim || '|' || plant_id")} < cum / total), {len(CLASSES) - 1}) AS ci
  FROM cells, sims GROUP BY 1, 2),
{FACTORS_SQL}"""


PICKED_SQL = f"""{BETA_SQL},
sums AS (SELECT *, sum(p) OVER (PARTITION BY plant_id, sim ORDER BY i) AS cum, sum(p) OVER (PARTITION BY plant_id, sim) AS total FROM betas),
picks AS (SELECT plant_id, sim, CASE WHEN max(total) > 0 THEN
    coalesce(min(i) FILTER (WHERE {u(f"'{SEED}|' || sim || '|' || plant_id || '|class'")} * total < cum), {len(CLASSES) - 1})
    ELSE {len(CLASSES) - 1} END AS ci FROM sums GROUP BY 1, 2),
{FACTORS_SQL}"""


@query("D8_group_factors", f"""
WITH {pools_sql()}, {PICKED_SQL}
SELECT NAME_0, sim::INT AS sim, round(sum(CASE WHEN n2o_ef IS NOT NULL THEN served * n2o_ef END) / sum(CASE WHEN n2o_ef IS NOT NULL THEN served END), 12) AS n2o_ef,
  round(sum(CASE WHEN ch4_ef IS NOT NULL THEN served * ch4_ef END) / sum(CASE WHEN ch4_ef IS NOT NULL THEN served END), 12) AS ch4_ef
FROM efs JOIN plant ON plant.plant_id = efs.plant_id GROUP BY 1, 2 /* {{n2o}} {{fb}} {{ch4}} {{predicted}} {{plant}} */""")
def d8(t):
    plants = beta_classes(with_blocks(grouped_plants(t), N_SIM, "plant_id"), "plant_id", SEED,
                          len(CLASSES) - 1)
    pools = pool_table(materialize(query_pools(t, POOL), "pools"), CLASSES)
    draws = draw_factors(expand_draws(plants.drop("means", "stds"), "plant_id", N_SIM, SEED,
                                      len(CLASSES), None, None), pools, len(CLASSES), POOL)
    return rounded(group_factors(draws, ["NAME_0"], "served"), 12)


@query("D9_fixed_probability", f"""
WITH {pools_sql()}, {FIXED_SQL}
SELECT NAME_0, sim::INT AS sim, round(sum(CASE WHEN n2o_ef IS NOT NULL THEN served * n2o_ef END) / sum(CASE WHEN n2o_ef IS NOT NULL THEN served END), 12) AS n2o_ef,
  round(sum(CASE WHEN ch4_ef IS NOT NULL THEN served * ch4_ef END) / sum(CASE WHEN ch4_ef IS NOT NULL THEN served END), 12) AS ch4_ef
FROM efs JOIN plant ON plant.plant_id = efs.plant_id GROUP BY 1, 2 /* {{n2o}} {{fb}} {{ch4}} {{predicted}} {{plant}} */""")
def d9(t):
    plants = with_class_cdf(grouped_plants(t), len(CLASSES))
    pools = pool_table(materialize(query_pools(t, POOL), "pools"), CLASSES)
    draws = draw_factors(expand_draws(plants.drop("means", "stds"), "plant_id", N_SIM, SEED,
                                      len(CLASSES), None, None), pools, len(CLASSES), POOL)
    return rounded(group_factors(draws, ["NAME_0"], "served"), 12)


COEF_ROWS = ", ".join(f"({CLASSES.index(n)}, {s}, {c}, {o})" for n, s, c, o in CLASS_COEFFICIENTS
                      if n in CLASSES)

RUN_SQL = f"""{MATRIX_SQL}, {nodes_sql()}, {match_sql()}, {fill_sql()}, {LOOKUP_SQL}, {MEMBERS_SQL}, {INFORMED_SQL},
{pools_sql()}, {ARRAYS_SQL},
factors AS (SELECT k.donor_id, p.sim, sum(k.weight * coalesce(a.ch4_ef, 0)) AS ch4_ef, sum(k.weight * coalesce(b.n2o_ef, 0)) AS n2o_ef,
    sum(k.weight * co.sl::DOUBLE) AS sludge, sum(k.weight * co.c4::DOUBLE) AS ch4_red, sum(k.weight * co.n2::DOUBLE) AS n2o_red
  FROM kept k JOIN picks p ON p.plant_id = k.plant_id
  JOIN (VALUES {COEF_ROWS}) AS co(i, sl, c4, n2) ON co.i = p.ci
  LEFT JOIN pool a ON a.class_idx = p.ci AND a.slot = floor({u(f"'{SEED}|' || p.sim || '|' || p.plant_id", 1)} * {POOL})
  LEFT JOIN pool b ON b.class_idx = p.ci AND b.slot = floor({u(f"'{SEED}|' || p.sim || '|' || p.plant_id", 2)} * {POOL})
  GROUP BY 1, 2),
{LOADS_SQL},
cs AS (SELECT l.row_id, l.NAME_0, l.Continent, l.Income_Level, l.Region, s.sim, l.bod, l.tn, l.ad_ratio,
    coalesce(f.ch4_ef, 0) AS ch4_ef, coalesce(f.n2o_ef, 0) AS n2o_ef, coalesce(f.sludge, 0) AS sludge,
    coalesce(f.ch4_red, 0) AS ch4_red, coalesce(f.n2o_red, 0) AS n2o_red
  FROM loads l CROSS JOIN sims s LEFT JOIN found d ON d.row_id = l.row_id
  LEFT JOIN factors f ON f.donor_id = d.donor_id AND f.sim = s.sim),
ct AS (SELECT *, bod * ch4_ef AS "CH4_Safetreated", bod * sludge * ad_ratio * {GEN} * {LEAK} AS "CH4_AD",
    bod * ch4_ef + bod * sludge * ad_ratio * {GEN} * {LEAK} AS "CH4_inPlant", tn * n2o_ef AS "N2O_Safetreated",
    (bod * ch4_ef + bod * sludge * ad_ratio * {GEN} * {LEAK}) * 27 + tn * n2o_ef * 273 AS "CO2e_total" FROM cs)"""
RUN_ROLES = "/* {city} {plant} {predicted} {n2o} {fb} {ch4} */"

LEVEL_ROWS = [("country", "NAME_0"), ("continent", "Continent"), ("income", "Income_Level"),
              ("region", "NAME_0 || ' | ' || Region"), ("global", "'global'")]
LEVEL_SQL = " UNION ALL ".join(
    f"SELECT '{lv}' AS level, {k} AS key, sim, " + ", ".join(f'sum("{x}") AS "{x}"' for x in TARGETS)
    + " FROM ct GROUP BY ALL" for lv, k in LEVEL_ROWS)
LOAD_LEVEL_SQL = " UNION ALL ".join(
    f"SELECT '{lv}' AS level, {k} AS key, sum(bod) AS bod, sum(tn) AS tn FROM loads GROUP BY ALL"
    for lv, k in LEVEL_ROWS)


def run_inputs(t, settings=SETTINGS):
    """(loads with donors, donor draws) of the fixed-probability run."""
    cities, plants = t.role("city"), t.role("plant")
    found, members = map_cities(cities, plants, "row_id", "plant_id", "served", small_country=SMALL)
    loads = city_loads(cities).join(found.select("row_id", "donor_id"), "row_id")
    pools = materialize(query_pools(t, POOL), "pools")
    factors = draw_donors(members, matrix_of(t), pools, "plant_id", settings)
    return materialize(loads, "loads"), materialize(factors, "donors")


FINEST = ["NAME_0", "Continent", "Income_Level", "Region"]


@query("D10_unified_run", f"""
WITH {RUN_SQL}, lv AS ({LEVEL_SQL})
SELECT level, key, sim::INT AS sim, {', '.join(f'round("{x}", 9) AS "{x}"' for x in TARGETS)} FROM lv {RUN_ROLES}""")
def d10(t):
    loads, factors = run_inputs(t)
    return rounded(level_emissions(group_emissions(loads, factors, FINEST, SEED, N_SIM), LEVELS), 9)


def stats_sql(column: str, factor: str = "", digits: int = 9) -> str:
    wrap = (lambda x: f"round({x}, {digits})") if not factor else (
        lambda x: f"round(CASE WHEN max({factor}) > 0 THEN {x} / max({factor}) ELSE 0 END, {digits})")
    label = column if not factor else dict((t, n) for n, t, d in EFFECTIVE_FACTORS)[column]
    cells = {"Mean": f'avg("{column}")', "P2_5": f'quantile_cont("{column}", 0.025)',
             "Median": f'quantile_cont("{column}", 0.5)', "P97_5": f'quantile_cont("{column}", 0.975)'}
    return ", ".join(f'{wrap(cells[s])} AS "{label}_{s}"' for s in STATS)


@query("D11_level_tables", f"""
WITH {RUN_SQL}, lv AS ({LEVEL_SQL}), ll AS ({LOAD_LEVEL_SQL})
SELECT lv.level, lv.key, {', '.join(stats_sql(x) for x in TARGETS)},
  {', '.join(stats_sql(t, d) for _, t, d in EFFECTIVE_FACTORS)},
  (max(bod) > 0)::INT AS "CH4_EF_Defined", (max(tn) > 0)::INT AS "N2O_EF_Defined",
  round(max(bod), 9) AS "BOD_intoSecondary_Total", round(max(tn), 9) AS "TN_intoSecondary_Total"
FROM lv JOIN ll ON ll.level = lv.level AND ll.key = lv.key GROUP BY 1, 2 {RUN_ROLES}""")
def d11(t):
    loads, factors = run_inputs(t)
    emissions = level_emissions(group_emissions(loads, factors, FINEST, SEED, N_SIM), LEVELS)
    return rounded(level_table(emissions, level_loads(loads, LEVELS)), 9)


# More than one block of iterations, and donors of more than eight plants in parts.
MANY = replace(SETTINGS, n_sim=1500, per_part=8)
MANY_SQL = RUN_SQL.replace(f"range({N_SIM})", f"range({MANY.n_sim})")


@query("D11_split_donors", f"""
WITH {MANY_SQL}, lv AS ({LEVEL_SQL})
SELECT level, key, count(*) AS iterations, {', '.join(stats_sql(x, digits=8) for x in TARGETS)}
FROM lv GROUP BY 1, 2 {RUN_ROLES}""")
def d11_split(t):
    loads, factors = run_inputs(t, MANY)
    emissions = level_emissions(group_emissions(loads, factors, FINEST, SEED, MANY.n_sim), LEVELS)
    seen = emissions.groupBy("level", "key").agg(F.count(F.lit(1)).alias("iterations"))
    table = level_table(emissions, level_loads(loads, LEVELS)).join(seen, ["level", "key"])
    return rounded(table.select("level", "key", "iterations", *[f"{x}_{s}" for x in TARGETS for s in STATS]), 8)


@query("E5_effective_factors", f"""
WITH {RUN_SQL}, lv AS ({LEVEL_SQL}), ll AS ({LOAD_LEVEL_SQL})
SELECT lv.level, lv.key, {', '.join(stats_sql(t, d) for _, t, d in EFFECTIVE_FACTORS)}
FROM lv JOIN ll ON ll.level = lv.level AND ll.key = lv.key GROUP BY 1, 2 {RUN_ROLES}""")
def e5(t):
    loads, factors = run_inputs(t)
    emissions = level_emissions(group_emissions(loads, factors, FINEST, SEED, N_SIM), LEVELS)
    table = level_table(emissions, level_loads(loads, LEVELS))
    return rounded(table.select("level", "key", *[f"{label}_{s}" for label, _, _ in EFFECTIVE_FACTORS
                                                  for s in STATS]), 9)


CITY_FACTORS = """round(avg(ch4_ef), 9) AS "CH4_EF_safetreated_Mean", round(quantile_cont(ch4_ef, 0.025), 9) AS "CH4_EF_safetreated_P2_5",
  round(quantile_cont(ch4_ef, 0.5), 9) AS "CH4_EF_safetreated_Median", round(quantile_cont(ch4_ef, 0.975), 9) AS "CH4_EF_safetreated_P97_5",
  round(avg(n2o_ef), 9) AS "N2O_EF_Mean", round(quantile_cont(n2o_ef, 0.025), 9) AS "N2O_EF_P2_5",
  round(quantile_cont(n2o_ef, 0.5), 9) AS "N2O_EF_Median", round(quantile_cont(n2o_ef, 0.975), 9) AS "N2O_EF_P97_5\""""


@query("D12_city_percentiles", f"""
WITH {RUN_SQL}
SELECT row_id, round(max(bod), 9) AS "BOD_intoSecondary", round(max(tn), 9) AS "TN_intoSecondary",
  {', '.join(stats_sql(x) for x in TARGETS)}, {CITY_FACTORS}, {stats_sql('CH4_inPlant', 'bod')},
  (max(bod) > 0)::INT AS "CH4_EF_Defined", (max(tn) > 0)::INT AS "N2O_EF_Defined" FROM ct GROUP BY 1 {RUN_ROLES}""")
def d12(t):
    loads, factors = run_inputs(t)
    return rounded(city_table(loads, donor_series(factors, SEED, n_sim=N_SIM), "row_id"), 9)


@query("D12_city_subsample", f"""
WITH {RUN_SQL}
SELECT row_id, round(avg("CO2e_total"), 9) AS "CO2e_total_Mean",
  round(quantile_cont(CASE WHEN sim % 3 = 0 THEN "CO2e_total" END, 0.5), 9) AS "CO2e_total_Median" FROM ct GROUP BY 1 {RUN_ROLES}""")
def d12_subsample(t):
    loads, factors = run_inputs(t)
    out = city_table(loads, donor_series(factors, SEED, 3, N_SIM), "row_id")
    return rounded(out.select("row_id", "CO2e_total_Mean", "CO2e_total_Median"), 9)


@query("D13_city_reductions", f"""
WITH {RUN_SQL}
SELECT row_id, NAME_0, round(max(bod), 9) AS "BOD_intoSecondary", round(max(tn), 9) AS "TN_intoSecondary",
  round(avg(ch4_red), 9) AS "CH4_Reduction_rate", round(avg(n2o_red), 9) AS "N2O_Reduction_rate",
  round(avg(sludge), 9) AS "BODintoSludge_Ratio" FROM ct GROUP BY 1, 2 {RUN_ROLES}""")
def d13(t):
    loads, factors = run_inputs(t)
    return rounded(city_reductions(loads, donor_series(factors, SEED, n_sim=N_SIM), "row_id", ["NAME_0"]), 9)


@query("D13_country_reductions", f"""
WITH {RUN_SQL}, c AS (SELECT row_id, NAME_0, max(bod) AS bod, max(tn) AS tn, avg(ch4_red) AS a, avg(n2o_red) AS b, avg(sludge) AS s FROM ct GROUP BY 1, 2)
SELECT NAME_0, CASE WHEN sum(bod) > 0 THEN round(sum(a * bod) / sum(bod), 9) ELSE 0 END AS "CH4_Reduction_rate",
  CASE WHEN sum(tn) > 0 THEN round(sum(b * tn) / sum(tn), 9) ELSE 0 END AS "N2O_Reduction_rate",
  CASE WHEN sum(bod) > 0 THEN round(sum(s * bod) / sum(bod), 9) ELSE 0 END AS "BODintoSludge_Ratio",
  round(sum(bod), 9) AS "BOD_intoSecondary_Total", round(sum(tn), 9) AS "TN_intoSecondary_Total" FROM c GROUP BY 1 {RUN_ROLES}""")
def d13_country(t):
    loads, factors = run_inputs(t)
    cities = city_reductions(loads, donor_series(factors, SEED, n_sim=N_SIM), "row_id", ["NAME_0"])
    return rounded(weighted_rate(cities, ["NAME_0"], {
        "CH4_Reduction_rate": "BOD_intoSecondary", "N2O_Reduction_rate": "TN_intoSecondary",
        "BODintoSludge_Ratio": "BOD_intoSecondary"}), 9)


@query("D14_self_check", f"""
WITH {RUN_SQL}, lv AS ({LEVEL_SQL}), ll AS ({LOAD_LEVEL_SQL})
SELECT lv.level, lv.key, round(avg("CH4_Safetreated"), 9) AS emission,
  round(avg(CASE WHEN bod > 0 THEN "CH4_Safetreated" / bod ELSE 0 END), 12) AS factor, TRUE AS agrees
FROM lv JOIN ll ON ll.level = lv.level AND ll.key = lv.key GROUP BY 1, 2 {RUN_ROLES}""")
def d14(t):
    """The mean of each iteration's own factor, times the load, against the table's emission."""
    loads, factors = run_inputs(t)
    emissions = materialize(level_emissions(group_emissions(loads, factors, FINEST, SEED, N_SIM), LEVELS), "emissions")
    totals = level_loads(loads, LEVELS)
    table = level_table(emissions, totals)
    each = emissions.join(totals, ["level", "key"]).groupBy("level", "key").agg(
        F.avg(F.when(F.col("bod") > 0, F.col("CH4_Safetreated") / F.col("bod")).otherwise(0.0)).alias("factor"))
    emission, factor = F.col("CH4_Safetreated_Mean"), F.coalesce("factor", F.lit(0.0))
    def near(a, b):
        return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(b), F.lit(1e-30))
    agrees = near(factor * F.col("BOD_intoSecondary_Total"), emission) & near(
        factor, F.col("CH4_EF_safetreated_Mean"))
    out = table.join(each, ["level", "key"], "left").select(
        "level", "key", emission.alias("emission"), factor.alias("factor"), agrees.alias("agrees"))
    return rounded(rounded(out, 9, ["emission"]), 12, ["factor"])


