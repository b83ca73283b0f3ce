"""Scans, checks and sinks. Sinks are checked by reading back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.reference import (COUNTRY_ALIASES, bucket_settings, literal_table, piped_lines,
                                   sewer_networks)
from ..operators.frames import MissingColumns, duplicate_keys, require_columns
from ..operators.proba import to_wide
from ..operators.aggregate import grouped_sums
from ..session import scratch_path
from ..sources.readers import (read_named, read_optional, read_probabilities, read_table,
                               read_union)
from ..sources.writers import (read_versioned, replace_buckets, upsert, write_buckets, write_csv, write_table,
                               write_tables)
from ..functions.columns import population_bucket, status_label
from .helpers import rounded
from .registry import query
from .roles import CLASSES

LINEITEM = ("l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, "
            "l_shipdate timestamp")


@query("S1_table_scan", """
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 49""")
def s1(t):
    df = read_table(t.spark, t.path("lineitem"), schema=LINEITEM)
    return (df.where(F.col("l_quantity") >= 49)
            .select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"))


@query("S2_named_table", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def s2(t):
    return read_named(t.spark, t.folder, "customer").drop("c_acctbal")


@query("S3_glob_union", """
SELECT p_partkey, p_name, p_type, NULL::INTEGER AS r_regionkey, NULL::VARCHAR AS r_name, 'nation' AS skipped FROM part
UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name, 'nation' FROM region""")
def s3(t):
    """Two good files and one whose content is no parquet."""
    folder = scratch_path(t.spark, "union")
    write_table(t.part, f"{folder}/part.parquet")
    write_table(t.region, f"{folder}/region.parquet")
    write_csv(t.nation, f"{folder}/nation.parquet")
    union, skipped = read_union(t.spark, f"{folder}/*.parquet")
    names = ",".join(p.rsplit("/", 1)[-1].removesuffix(".parquet") for p in skipped)
    return union.select("p_partkey", "p_name", "p_type", "r_regionkey", "r_name", F.lit(names).alias("skipped"))


@query("S4_optional_sources", """
SELECT s_suppkey AS id, s_acctbal AS balance,
       CASE WHEN s_nationkey = 1 THEN 'Anaerobic' ELSE 'Non-Anaerobic' END AS status
FROM supplier""")
def s4(t):
    paths = [t.path("no_such_table"), t.path("customer"), t.path("supplier")]
    df = read_optional(t.spark, paths, ["s_suppkey", "s_acctbal", "s_nationkey"])
    return df.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"),
                     status_label(F.col("s_nationkey")).alias("status"))


@query("S5_stored_probabilities", """
SELECT plant_id, NAME_0 AS country, 'LCO' AS holdout_pct,
       round(coalesce(max(CASE WHEN class = 'CAS' THEN mean END), 0), 9) AS CAS_mean,
       round(coalesce(max(CASE WHEN class = 'CAS' THEN std END), 0), 9) AS CAS_std
FROM {predicted} JOIN (SELECT plant_id AS pid, NAME_0 FROM {plant}) ON plant_id = pid
WHERE NAME_0 IN ('ASIA', 'MIDDLE EAST') GROUP BY ALL""")
def s5(t):
    folder = scratch_path(t.spark, "proba")
    wide = to_wide(t.role("predicted"), "plant_id", CLASSES).join(
        t.role("plant").select("plant_id", F.col("NAME_0").alias("home")), "plant_id")
    for name, stem in (("ASIA", "ASIA"), ("MIDDLE EAST", "MIDDLE_EAST")):
        write_csv(wide.where(F.col("home") == name).drop("home"), f"{folder}/{stem}_proba.csv")
    table, classes = read_probabilities(t.spark, folder, ["ASIA", "MIDDLE EAST"])
    assert classes == sorted(CLASSES)
    return rounded(table.select(
        F.col("plant_id").cast("long"), "country", "holdout_pct",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("CAS_mean", "CAS_std")]), 9)


@query("S6_fold_scan", """
SELECT o_orderkey, o_orderstatus AS fold, o_totalprice FROM orders""")
def s6(t):
    path = scratch_path(t.spark, "folds")
    write_buckets(t.orders.select("o_orderkey", "o_totalprice",
                                  F.col("o_orderstatus").alias("fold")), path, ["fold"])
    return t.spark.read.parquet(path).select("o_orderkey", F.col("fold").cast("string"),
                                             "o_totalprice")


@query("S7_literal_tables", """
SELECT n_name AS country, r_name AS continent, income, count(*) AS n_customers
FROM (SELECT n_nationkey, n_name, r_name,
             CASE WHEN n_nationkey < 9 THEN 'High income' ELSE 'Low income' END AS income
      FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24)
JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def s7(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    income = F.when(F.col("n_nationkey") < 9, "High income").otherwise("Low income")
    line = F.when(F.col("n_nationkey") == 24, F.col("n_name")).otherwise(
        F.concat(F.col("n_name"), F.lit("|"), F.col("r_name"), F.lit(" | "), income))
    lookup = piped_lines(places.select(line.alias("line")), "line",
                         ["country", "continent", "income"])
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (customers.join(lookup, F.col("n_name") == F.col("country"))
            .groupBy("country", "continent", "income").agg(F.count(F.lit(1)).alias("n_customers")))


@query("S8_required_columns", "SELECT p_partkey, p_type, p_size FROM part")
def s8(t):
    try:
        require_columns(t.part, ["p_partkey", "no_such_column"], "part")
    except MissingColumns as e:
        assert "no_such_column" in str(e)
    return require_columns(t.part, ["p_partkey", "p_type", "p_size"]).select(
        "p_partkey", "p_type", "p_size")


@query("S9_unique_key", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def s9(t):
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("S10_table_sink", """
SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1""")
def s10(t):
    path = write_table(t.customer, scratch_path(t.spark, "sink"))
    return rounded(t.spark.read.parquet(path).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance")), 2)


@query("S11_multi_table_sink", """
SELECT 'main' AS sheet, s_nationkey AS k, s_acctbal AS v FROM supplier
UNION ALL SELECT 'summary', s_nationkey, round(sum(s_acctbal), 2) FROM supplier GROUP BY 2""")
def s11(t):
    folder = scratch_path(t.spark, "sheets")
    main = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    summary = rounded(grouped_sums(main, ["k"], ["v"]), 2)
    write_tables({"main": main, "summary": summary}, folder)
    parts = [read_named(t.spark, folder, n).select(F.lit(n).alias("sheet"), "k", "v")
             for n in ("main", "summary")]
    return parts[0].unionByName(parts[1])


@query("S12_csv_sink", "SELECT p_partkey, p_name, p_retailprice FROM part")
def s12(t):
    path = write_csv(t.part.select("p_partkey", "p_name", "p_retailprice"),
                     scratch_path(t.spark, "csv"))
    return t.spark.read.csv(path, header=True,
                            schema="p_partkey bigint, p_name string, p_retailprice double")


@query("S13_bucket_sink", """
SELECT CASE WHEN o_totalprice <= 50000 THEN 'small' WHEN o_totalprice <= 200000 THEN 'medium'
            ELSE 'large' END AS population_bucket, count(*) AS n FROM orders GROUP BY 1""")
def s13(t):
    path = scratch_path(t.spark, "buckets")
    bucket = population_bucket(F.col("o_totalprice"), (50000.0, 200000.0),
                               ("small", "medium", "large")).alias("population_bucket")
    stale = t.orders.select("o_orderkey", F.lit("stale").alias("population_bucket"))
    write_buckets(stale, path, ["population_bucket"])
    write_buckets(t.orders.select("o_orderkey", bucket), path, ["population_bucket"])
    return (t.spark.read.parquet(path).groupBy("population_bucket")
            .agg(F.count(F.lit(1)).alias("n")))


@query("S13_versioned_buckets", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, o_orderpriority AS priority
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW'
UNION ALL SELECT o_orderkey, 'part', o_orderpriority FROM orders WHERE o_orderstatus = 'P'""")
def s13_versions(t):
    path = scratch_path(t.spark, "buckets")
    state = F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END").alias("state")
    rows = t.orders.select("o_orderkey", state, F.col("o_orderpriority").alias("priority"))
    replace_buckets(rows, path, ["state"])
    replace_buckets(rows.where("state <> 'part' AND priority <> '5-LOW'"), path, ["state"], replace_all=False)
    return read_versioned(t.spark, path)


@query("S14_upsert", """
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value
FROM events GROUP BY 1, 2""")
def s14(t):
    path = scratch_path(t.spark, "upsert")
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    first = rows.where(F.col("value") < 50)
    upsert(first, path, ["user_id", "event_type"], "event_id")
    upsert(rows, path, ["user_id", "event_type"], "event_id")
    return read_versioned(t.spark, path)


@query("S7_reference_tables", """
SELECT c_mktsegment AS segment, count(*) AS n, 21 AS networks, 26 AS aliases, 3 AS buckets
FROM customer GROUP BY 1""")
def s7_reference(t):
    networks, settings = sewer_networks(t.spark), bucket_settings(t.spark)
    aliases = literal_table(t.spark, COUNTRY_ALIASES, "alias string, name string")

    def rows(df):
        return df.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    return (t.customer.groupBy(F.col("c_mktsegment").alias("segment"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("*", rows(networks).alias("networks"), rows(aliases).alias("aliases"),
                    rows(settings).alias("buckets")))
