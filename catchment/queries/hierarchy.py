"""Administrative hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hierarchy import (VALUE_LABELS, affected_donors, build_nodes, city_lookup,
                                   donor_members, fill_nodes,
                                   keep_informed, mapping_source, mark_nodes, match_regions,
                                   node_values, region_totals, with_donor_id)
from ..operators.proba import full_matrix
from ..plans.digestion import extend_cities
from ..plans.emission import informed_plants, map_cities
from ..session import materialize, scratch_path
from ..sources.writers import write_table
from .helpers import rounded
from .joins import MATRIX_SQL
from .registry import query
from .roles import CLASSES

SMALL = 9.5e6
TOTAL = "Total_Served_Population"


def nodes_sql(on_gap: str = "skip", city: str = "city") -> str:
    """CTEs ``steps`` and ``nodes``."""
    if on_gap == "skip":
        valid = ["NAME_0 IS NOT NULL"] + [f"NAME_0 IS NOT NULL AND NAME_{i} IS NOT NULL" for i in (1, 2, 3)]
    else:
        valid = [" AND ".join(f"NAME_{j} IS NOT NULL" for j in range(i + 1)) for i in range(4)]
    parts = []
    for i in range(4):
        names = ", ".join(f"NAME_{j}" for j in range(i + 1))
        parts.append(f"SELECT row_id, Population, {i} AS level, "
                     f"[x for x in [{names}] if x IS NOT NULL] AS path FROM {city} WHERE {valid[i]}")
    return f"""
steps AS ({' UNION ALL '.join(parts)}),
nodes AS (SELECT path, arg_min(level, row_id) AS level, min(row_id) AS first_row,
   coalesce(sum(Population), 0) AS population, path[1] AS country, path[len(path)] AS name,
   CASE WHEN len(path) > 1 THEN path[1:len(path) - 1] END AS parent FROM steps GROUP BY path)"""


def match_sql(plant: str = "plant") -> str:
    """CTEs ``regions`` and ``matched``."""
    return f"""
regions AS (SELECT NAME_0, Region, count(*) AS n_plants, coalesce(sum(served), 0) AS served FROM {plant} GROUP BY 1, 2),
cand AS (SELECT r.NAME_0 AS country, r.Region AS region, r.served, n.path,
    CASE WHEN len(n.path) = 3 THEN [-a2.first_row] WHEN len(n.path) = 4 THEN [-a2.first_row, -a3.first_row] ELSE [] END AS walk
  FROM regions r JOIN nodes n ON n.country = r.NAME_0 AND n.name = r.Region
    AND (r.Region = r.NAME_0) = (len(n.path) = 1)
  LEFT JOIN nodes a2 ON len(n.path) > 2 AND a2.path = n.path[1:2]
  LEFT JOIN nodes a3 ON len(n.path) > 3 AND a3.path = n.path[1:3]),
matched AS (SELECT country, region, served, path FROM (SELECT *, row_number() OVER (PARTITION BY country, region ORDER BY walk) AS rn FROM cand) WHERE rn = 1),
marked AS (SELECT n.*, m.path IS NOT NULL AS has_data, coalesce(m.served, 0) AS served
  FROM nodes n LEFT JOIN matched m ON m.path = n.path)"""


def fill_sql(tie: str = ">", small: float = SMALL) -> str:
    """CTE ``filled`` with the rule per node."""
    return f"""
sib AS (SELECT parent, level, count(*) FILTER (WHERE has_data) AS n_with, sum(served) FILTER (WHERE has_data) AS with_pop
  FROM marked WHERE len(path) > 1 AND level BETWEEN 1 AND 3 GROUP BY 1, 2),
r1 AS (SELECT m.*, coalesce(s.n_with, 0) AS n_with, coalesce(s.with_pop, 0) AS with_pop,
    root.has_data AS r_has, root.population < {small} AS r_small,
    CASE WHEN m.has_data THEN 'own'
      WHEN len(m.path) > 1 AND m.level BETWEEN 1 AND 3 AND p.level = m.level - 1 THEN
        CASE WHEN p.has_data AND coalesce(s.n_with, 0) = 0 THEN 'parent'
          WHEN p.has_data AND p.served {tie} coalesce(s.with_pop, 0) THEN 'parent_larger'
          WHEN p.has_data AND s.n_with > 0 AND s.with_pop > 0 THEN 'pool_larger'
          WHEN NOT p.has_data AND s.n_with > 0 AND s.with_pop > 0 THEN 'pool' END END AS rule1
  FROM marked m LEFT JOIN sib s ON s.parent = m.parent AND s.level = m.level
  LEFT JOIN marked p ON p.path = m.parent JOIN marked root ON len(root.path) = 1 AND root.country = m.country),
r2 AS (SELECT *, coalesce(rule1, CASE WHEN len(path) = 2 AND level = 1 AND r_has AND r_small THEN 'small' END) AS rule2 FROM r1),
any_child AS (SELECT country, bool_or(rule2 IS NOT NULL) AS any_child FROM r2 WHERE len(path) > 1 GROUP BY 1),
filled AS (SELECT r2.* EXCLUDE (rule1, rule2),
    coalesce(rule2, CASE WHEN len(path) > 1 AND r_has AND NOT any_child THEN 'country_only' END) AS rule
  FROM r2 LEFT JOIN any_child ON any_child.country = r2.country)"""


DONOR_SQL = """CASE WHEN rule IN ('pool', 'pool_larger') THEN 'pool' || level || chr(31) || array_to_string(parent, chr(31))
  WHEN rule = 'own' THEN 'node' || chr(31) || array_to_string(path, chr(31))
  WHEN rule IN ('parent', 'parent_larger') THEN 'node' || chr(31) || array_to_string(parent, chr(31))
  WHEN rule IS NOT NULL THEN 'node' || chr(31) || country END"""

LOOKUP_SQL = f"""
found AS (SELECT * FROM (SELECT s.row_id, s.level AS matched_level, f.rule, f.path, f.parent, f.n_with, f.level AS node_level,
    {DONOR_SQL.replace('level', 'f.level').replace('parent', 'f.parent').replace("'f.parent", "'parent").replace('rule', 'f.rule').replace('path', 'f.path').replace('country', 'f.country')} AS donor_id,
    row_number() OVER (PARTITION BY s.row_id ORDER BY s.level DESC) AS rn
  FROM steps s JOIN filled f ON f.path = s.path AND f.rule IS NOT NULL
    AND (len(f.path) > 1 OR f.population < {SMALL})) WHERE rn = 1)"""


def show(path):
    return F.array_join(path, "/")


def build(t, on_gap="skip", cities=None, plants=None):
    cities = t.role("city") if cities is None else cities
    plants = t.role("plant") if plants is None else plants
    nodes = materialize(build_nodes(cities, "Population", "row_id", on_gap=on_gap), "nodes")
    regions = materialize(region_totals(plants, "served"), "regions")
    matched = materialize(match_regions(nodes, regions), "matched")
    marked = materialize(mark_nodes(nodes, matched, regions, TOTAL), "marked")
    return cities, plants, nodes, regions, matched, marked


NODE_OUT = """SELECT array_to_string(path, '/') AS path, level::INT AS level, first_row, round(population, 2) AS population FROM nodes"""


@query("H1_admin_nodes", f"WITH {nodes_sql()} {NODE_OUT} /* {{city}} */")
def h1(t):
    nodes = build_nodes(t.role("city"), "Population", "row_id")
    return rounded(nodes.select(show("path").alias("path"), "level", "first_row", "population"), 2)


@query("H1_admin_nodes_stop", f"WITH {nodes_sql('stop')} {NODE_OUT} /* {{city}} */")
def h1_stop(t):
    nodes = build_nodes(t.role("city"), "Population", "row_id", on_gap="stop")
    return rounded(nodes.select(show("path").alias("path"), "level", "first_row", "population"), 2)


@query("J7_region_match", f"""
WITH {nodes_sql()}, {match_sql()} SELECT country, region, array_to_string(path, '/') AS path FROM matched /* {{city}} {{plant}} */""")
def j7(t):
    *_, matched, _ = build(t)
    return matched.select("country", "region", show("path").alias("path"))


@query("J7_region_match_stop", f"""
WITH {nodes_sql('stop')}, {match_sql()} SELECT country, region, array_to_string(path, '/') AS path FROM matched /* {{city}} {{plant}} */""")
def j7_stop(t):
    *_, matched, _ = build(t, "stop")
    return matched.select("country", "region", show("path").alias("path"))


@query("H2_marked_nodes", f"""
WITH {nodes_sql()}, {match_sql()}
SELECT array_to_string(path, '/') AS path, has_data, round(served, 2) AS served FROM marked /* {{city}} {{plant}} */""")
def h2(t):
    *_, marked = build(t)
    return rounded(marked.select(show("path").alias("path"), "has_data", "served"), 2)


SOURCE_SQL = """CASE rule WHEN 'parent' THEN 'inherited from NAME_' || (level - 1)
  WHEN 'pool' THEN 'weighted from ' || n_with || ' sibling regions'
  WHEN 'parent_larger' THEN 'inherited from parent (parent has larger served population)'
  WHEN 'pool_larger' THEN 'weighted from ' || n_with || ' sibling regions (child has larger served population)'
  WHEN 'small' THEN 'inherited from NAME_0' WHEN 'country_only' THEN 'inherited from NAME_0' END"""


@query("H3_fill", f"""
WITH {nodes_sql()}, {match_sql()}, {fill_sql()}
SELECT array_to_string(path, '/') AS path, rule, {SOURCE_SQL} AS source, {DONOR_SQL} AS donor_id
FROM filled /* {{city}} {{plant}} */""")
def h3(t):
    *_, marked = build(t)
    filled = with_donor_id(fill_nodes(marked, False, SMALL))
    return filled.select(show("path").alias("path"), "rule", "source", "donor_id")


@query("H3_fill_values", f"""
WITH {nodes_sql('stop')}, {match_sql()}, {fill_sql('>=')}
SELECT array_to_string(path, '/') AS path, rule FROM filled /* {{city}} {{plant}} */""")
def h3_values(t):
    *_, marked = build(t, "stop")
    filled = fill_nodes(marked, True, SMALL, VALUE_LABELS)
    return filled.select(show("path").alias("path"), "rule")


VALUES_SQL = """
rv AS (SELECT m.path, m.served AS w, v.val FROM matched m JOIN
  (SELECT NAME_0, Region, CASE WHEN count(*) <> 2 THEN avg(plant_id) END AS val FROM plant GROUP BY 1, 2) v
  ON v.NAME_0 = m.country AND v.Region = m.region),
pools AS (SELECT f.parent, f.level, coalesce(sum(CASE WHEN rv.w > 0 THEN rv.val * rv.w END), 0) / sum(CASE WHEN rv.w > 0 THEN rv.w END) AS val
  FROM filled f JOIN rv ON rv.path = f.path GROUP BY 1, 2),
valued AS (SELECT f.*, CASE WHEN f.rule IN ('pool', 'pool_larger') THEN p.val ELSE o.val END AS val
  FROM filled f LEFT JOIN pools p ON p.parent = f.parent AND p.level = f.level
  LEFT JOIN rv o ON o.path = CASE WHEN f.rule = 'own' THEN f.path WHEN f.rule IN ('parent', 'parent_larger') THEN f.parent
     WHEN f.rule IN ('small', 'country_only') THEN f.path[1:1] END)"""


def region_values(t):
    """A value per region, missing for regions with two plants."""
    value = F.when(F.count(F.lit(1)) != 2, F.avg("plant_id")).alias("val")
    return t.role("plant").groupBy("NAME_0", "Region").agg(
        value, F.sum("served").alias(TOTAL))


@query("H4_sibling_mean", f"""
WITH {nodes_sql('stop')}, {match_sql()}, {fill_sql('>=')}, {VALUES_SQL}
SELECT array_to_string(path, '/') AS path, rule, round(val, 9) AS val FROM valued /* {{city}} {{plant}} */""")
def h4(t):
    *_, matched, marked = build(t, "stop")
    filled = materialize(fill_nodes(marked, True, SMALL, VALUE_LABELS), "filled")
    valued = node_values(filled, matched, materialize(region_values(t), "values"), ["val"], TOTAL)
    return rounded(valued.select(show("path").alias("path"), "rule", "val"), 9)


@query("H5_small_country", f"""
WITH plant0 AS (SELECT NAME_0, Region, 0.0::DOUBLE AS served FROM plant),
{nodes_sql()}, {match_sql('plant0')}, {fill_sql()}
SELECT array_to_string(path, '/') AS path, rule FROM filled /* {{city}} {{plant}} */""")
def h5(t):
    plants = t.role("plant").withColumn("served", F.lit(0.0))
    *_, marked = build(t, plants=plants)
    return fill_nodes(marked, False, SMALL).select(show("path").alias("path"), "rule")


@query("H6_country_only", f"""
WITH city0 AS (SELECT * REPLACE (NULL AS NAME_1) FROM city),
plant0 AS (SELECT * FROM plant WHERE Region = NAME_0),
{nodes_sql('skip', 'city0')}, {match_sql('plant0')}, {fill_sql()}
SELECT array_to_string(path, '/') AS path, rule FROM filled /* {{city}} {{plant}} */""")
def h6(t):
    cities = t.role("city").withColumn("NAME_1", F.lit(None).cast("string"))
    plants = t.role("plant").where(F.col("Region") == F.col("NAME_0"))
    *_, marked = build(t, cities=cities, plants=plants)
    return fill_nodes(marked, False, SMALL).select(show("path").alias("path"), "rule")


@query("J8_deepest_ancestor", f"""
WITH {nodes_sql()}, {match_sql()}, {fill_sql()}, {LOOKUP_SQL}
SELECT c.row_id, f.matched_level::INT AS matched_level, f.donor_id FROM city c LEFT JOIN found f ON f.row_id = c.row_id /* {{city}} {{plant}} */""")
def j8(t):
    cities, _, _, _, _, marked = build(t)
    filled = materialize(fill_nodes(marked, False, SMALL), "filled")
    return city_lookup(cities, filled, "row_id", small_country=SMALL).select(
        "row_id", "matched_level", "donor_id")


@query("H7_city_lookup", f"""
WITH {nodes_sql()}, {match_sql()}, {fill_sql()}, {LOOKUP_SQL}
SELECT c.row_id, CASE WHEN f.row_id IS NULL THEN '' WHEN len(f.path) = 1 THEN 'matched at NAME_0 only'
  ELSE coalesce({SOURCE_SQL.replace('level - 1', 'node_level - 1')}, 'direct match at NAME_' || f.matched_level) END AS ef_source
FROM city c LEFT JOIN found f ON f.row_id = c.row_id /* {{city}} {{plant}} */""")
def h7(t):
    cities, _, _, _, _, marked = build(t)
    filled = materialize(fill_nodes(marked, False, SMALL), "filled")
    return mapping_source(city_lookup(cities, filled, "row_id", small_country=SMALL)).select(
        "row_id", "ef_source")


@query("H7_city_values", f"""
WITH {nodes_sql('stop')}, {match_sql()}, {fill_sql('>=')}, {VALUES_SQL},
best AS (SELECT * FROM (SELECT s.row_id, s.level AS lv, v.rule, v.val, row_number() OVER (PARTITION BY s.row_id ORDER BY s.level DESC) AS rn
  FROM steps s JOIN valued v ON v.path = s.path AND v.rule IS NOT NULL AND (len(v.path) > 1 OR v.population < {SMALL})) WHERE rn = 1)
SELECT c.row_id, round(b.val, 9) AS val, CASE WHEN b.row_id IS NULL THEN '' ELSE 'NAME_' || b.lv END AS Admin_Match_Level,
  CASE WHEN b.row_id IS NULL THEN 'None' WHEN b.rule = 'own' THEN 'Original' ELSE 'Propagated' END AS Data_Source
FROM city c LEFT JOIN best b ON b.row_id = c.row_id /* {{city}} {{plant}} */""")
def h7_values(t):
    out = extend_cities(t.role("city"), region_values(t), "row_id", ["val"], small_country=SMALL)
    return rounded(out.select("row_id", "val", "Admin_Match_Level", "Data_Source"), 9)


MEMBERS_SQL = """
placed AS (SELECT p.plant_id, p.served AS pop, f.path, f.parent, f.level FROM plant p
  JOIN matched m ON m.country = p.NAME_0 AND m.region = p.Region JOIN filled f ON f.path = m.path),
mem0 AS (SELECT plant_id, pop, 'node' || chr(31) || array_to_string(path, chr(31)) AS donor_id FROM placed
  UNION ALL SELECT plant_id, pop, 'pool' || level || chr(31) || array_to_string(parent, chr(31)) FROM placed
  WHERE parent IS NOT NULL AND level BETWEEN 1 AND 3),
members AS (SELECT donor_id, plant_id, pop, CASE WHEN sum(pop) OVER (PARTITION BY donor_id) > 0
   THEN pop / sum(pop) OVER (PARTITION BY donor_id) ELSE 1.0 / count(*) OVER (PARTITION BY donor_id) END AS weight
  FROM mem0 WHERE donor_id IN (SELECT """ + DONOR_SQL + """ FROM filled))"""


def query_members(t):
    cities, plants, _, _, matched, marked = build(t)
    filled = materialize(fill_nodes(marked, False, SMALL), "filled")
    return cities, plants, filled, materialize(
        donor_members(plants, matched, filled, "plant_id", "served"), "members")


@query("H8_mapping_weights", f"""
WITH {nodes_sql()}, {match_sql()}, {fill_sql()}, {MEMBERS_SQL}
SELECT donor_id, plant_id, round(weight, 9) AS weight FROM members /* {{city}} {{plant}} */""")
def h8(t):
    *_, members = query_members(t)
    return rounded(members.select("donor_id", "plant_id", "weight"), 9)


@query("S15_mapping_store", f"""
WITH {nodes_sql()}, {match_sql()}, {fill_sql()}, {MEMBERS_SQL}
SELECT donor_id, count(*) AS n, round(sum(weight), 6) AS weight FROM members GROUP BY 1 /* {{city}} {{plant}} */""")
def s15(t):
    _, members = map_cities(t.role("city"), t.role("plant"), "row_id", "plant_id", "served",
                            small_country=SMALL)
    path = write_table(members.select("donor_id", "plant_id", "weight"),
                       scratch_path(t.spark, "mapping"))
    stored = t.spark.read.parquet(path)
    return rounded(stored.groupBy("donor_id").agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum("weight").alias("weight")), 6)


@query("J9_city_bridge", f"""
WITH {nodes_sql()}, {match_sql()}, {fill_sql()}, {LOOKUP_SQL}, {MEMBERS_SQL}
SELECT f.row_id, count(*) AS n_plants, round(sum(m.weight), 6) AS weight, round(sum(m.weight * m.plant_id), 6) AS mean_id
FROM found f JOIN members m ON m.donor_id = f.donor_id GROUP BY 1 /* {{city}} {{plant}} */""")
def j9(t):
    cities, _, filled, members = query_members(t)
    # Plant sums are taken per donor; cities only join the donor's one row.
    per_donor = members.groupBy("donor_id").agg(
        F.count(F.lit(1)).alias("n_plants"), F.sum("weight").alias("weight"),
        F.sum(F.col("weight") * F.col("plant_id")).alias("mean_id"))
    found = city_lookup(cities, filled, "row_id", small_country=SMALL)
    return rounded(found.join(per_donor, "donor_id")
                   .select("row_id", "n_plants", "weight", "mean_id"), 6)


INFORMED_SQL = """
informed AS (SELECT plant_id FROM matrix GROUP BY 1 HAVING sum(mean) > 0),
kept AS (SELECT m.donor_id, m.plant_id, m.weight / CASE WHEN sum(m.weight) OVER (PARTITION BY donor_id) > 0
    THEN sum(m.weight) OVER (PARTITION BY donor_id) ELSE 1 END AS weight
  FROM members m WHERE plant_id IN (SELECT plant_id FROM informed))"""


@query("H9_informed_weights", f"""
WITH {MATRIX_SQL}, {nodes_sql()}, {match_sql()}, {fill_sql()}, {MEMBERS_SQL}, {INFORMED_SQL}
SELECT donor_id, plant_id, round(weight, 9) AS weight FROM kept /* {{city}} {{plant}} {{predicted}} */""")
def h9(t):
    _, plants, _, members = query_members(t)
    matrix = full_matrix(plants, t.role("predicted"), "plant_id", "label", CLASSES)
    kept = keep_informed(members, informed_plants(matrix, "plant_id", CLASSES), "plant_id")
    return rounded(kept.select("donor_id", "plant_id", "weight"), 9)


@query("H9_affected_donors", f"""
WITH {MATRIX_SQL}, {nodes_sql()}, {match_sql()}, {fill_sql()}, {MEMBERS_SQL}, {INFORMED_SQL}
SELECT donor_id, round(sum(CASE WHEN i.plant_id IS NULL THEN weight ELSE 0 END), 9) AS dropped_weight,
  round(sum(CASE WHEN i.plant_id IS NOT NULL THEN weight ELSE 0 END), 9) AS kept_weight
FROM members m LEFT JOIN informed i ON i.plant_id = m.plant_id GROUP BY 1
HAVING sum(CASE WHEN i.plant_id IS NULL THEN weight ELSE 0 END) > 0 /* {{city}} {{plant}} {{predicted}} */""")
def h9_affected(t):
    _, plants, _, members = query_members(t)
    matrix = full_matrix(plants, t.role("predicted"), "plant_id", "label", CLASSES)
    return rounded(affected_donors(members, informed_plants(matrix, "plant_id", CLASSES),
                                   "plant_id"), 9)


@query("H10_city_mapping", f"""
WITH {nodes_sql()}, {match_sql()}, {fill_sql()}, {LOOKUP_SQL}, {MEMBERS_SQL}
SELECT c.NAME_0, count(*) AS n_cities, count(f.donor_id) AS n_mapped, count(DISTINCT f.donor_id) AS n_donors,
  coalesce(sum(x.n), 0)::BIGINT AS n_links
FROM city c LEFT JOIN found f ON f.row_id = c.row_id
LEFT JOIN (SELECT donor_id, count(*) AS n FROM members GROUP BY 1) x ON x.donor_id = f.donor_id
GROUP BY 1 /* {{city}} {{plant}} */""")
def h10(t):
    cities = t.role("city")
    found, members = map_cities(cities, t.role("plant"), "row_id", "plant_id", "served",
                                small_country=SMALL)
    sizes = members.groupBy("donor_id").agg(F.count(F.lit(1)).alias("n"))
    return (cities.select("row_id", "NAME_0").join(found.select("row_id", "donor_id"), "row_id")
            .join(sizes, "donor_id", "left").groupBy("NAME_0").agg(
                F.count(F.lit(1)).alias("n_cities"), F.count("donor_id").alias("n_mapped"),
                F.countDistinct("donor_id").alias("n_donors"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("n_links")))
