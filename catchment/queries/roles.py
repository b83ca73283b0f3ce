"""The given tables seen as plants, cities, factor records and inventories.

Plain SQL that Spark and the oracle both read; it only renames and classifies.
"""

# p_type as a treatment class, used for plants, ratios and parts.
CLASS_OF_TYPE = """CASE p_type WHEN 'ECONOMY' THEN 'CAS' WHEN 'STANDARD' THEN 'AO'
  WHEN 'PROMO' THEN 'Pond' WHEN 'MEDIUM' THEN 'OD' WHEN 'LARGE' THEN 'Lagoon'
  ELSE 'Anaerobic' END"""

CLASSES = ["AO", "Anaerobic", "CAS", "Lagoon", "OD", "Pond"]
CLASS_ROWS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CLASSES))

ROLES = {
    # Customers as cities: region / nation / segment, some without a middle level.
    "city": """
SELECT c_custkey AS row_id, r_name AS NAME_0,
       CASE WHEN c_acctbal >= 0 THEN n_name END AS NAME_1, c_mktsegment AS NAME_2,
       CASE WHEN c_acctbal > 8000 THEN n_name END AS NAME_3, CAST(NULL AS STRING) AS NAME_4,
       n_name AS Region, r_name AS Continent,
       CASE WHEN n_nationkey < 9 THEN 'High income' ELSE 'Low income' END AS Income_Level,
       CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END * 7 AS Population,
       CAST(40 + c_nationkey AS DOUBLE) AS BOD_PerCapita,
       CAST(60 + c_nationkey AS DOUBLE) AS Protein_PerCapita,
       CAST(1.1 AS DOUBLE) AS F_NONCON, CAST(1.2 AS DOUBLE) AS N_HH,
       CAST(0.9 AS DOUBLE) AS Protein_consumed,
       CAST(50 + c_nationkey AS DOUBLE) AS pct_sewer, CAST(20 AS DOUBLE) AS pct_septic,
       CASE WHEN c_acctbal > 1000 THEN CAST(80 AS DOUBLE) END AS pct_sewer_treated,
       CAST(30 AS DOUBLE) AS pct_septic_treated,
       CASE WHEN c_acctbal > 5000 THEN c_acctbal / 20000 END AS Anaerobic_digestion_ratio
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # Suppliers as plants; their region is the country, a nation, a segment, or unknown.
    "plant": """
SELECT s_suppkey AS plant_id, r_name AS NAME_0,
       CASE WHEN s_acctbal < 300 THEN r_name WHEN s_acctbal < 2500 THEN n_name
            WHEN s_acctbal < 5000 THEN 'MACHINERY' WHEN s_acctbal < 7000 THEN 'HOUSEHOLD'
            WHEN s_acctbal < 8500 THEN n_name ELSE 'elsewhere' END AS Region,
       CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END AS served,
       CASE WHEN s_acctbal > 9000 THEN 'OD' WHEN s_acctbal > 8000 THEN 'Other'
            WHEN s_acctbal > 7000 THEN 'CAS' WHEN s_acctbal > 6000 THEN 'Pond' END AS label,
       CASE WHEN s_acctbal BETWEEN 1000 AND 3000 THEN 'Advanced'
            WHEN s_acctbal < 1000 THEN 'Primary' END AS treatment_level
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # Share of each class in a supplier's deliveries as predicted probability.
    "predicted": f"""
SELECT x.plant_id, x.class, x.n * 1.0E0 / t.n AS mean,
       sqrt(x.n * 1.0E0 / t.n * (1 - x.n * 1.0E0 / t.n) / t.n) AS std
FROM (SELECT l_suppkey AS plant_id, {CLASS_OF_TYPE} AS class, count(*) AS n
      FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2) x
JOIN (SELECT l_suppkey AS plant_id, count(*) AS n FROM {{lineitem}} GROUP BY 1) t
  ON x.plant_id = t.plant_id
JOIN {{supplier}} ON s_suppkey = x.plant_id
WHERE s_acctbal < 4500 OR s_acctbal > 6000""",
    # Orders as N2O records.
    "n2o": """
SELECT o_orderkey AS rec_id, o_totalprice / 1000000 AS N2OEF,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CAS' WHEN '2-HIGH' THEN 'AO'
            WHEN '3-MEDIUM' THEN 'Pond' WHEN '4-NOT SPECIFIED' THEN 'OD' ELSE 'Anaerobic' END AS class,
       CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'B' ELSE 'P' END AS mark
FROM {orders}""",
    # Events as CH4 records; one event type carries no class.
    "ch4": """
SELECT event_id AS rec_id, value / 1000 AS CH4EF,
       CASE event_type WHEN 'click' THEN 'CAS' WHEN 'view' THEN 'AO' WHEN 'purchase' THEN 'OD'
            WHEN 'signup' THEN 'EA' END AS class
FROM {events}""",
    # Parts as normalising ratios; no ratio for one class.
    "fb": f"""
SELECT p_partkey AS rec_id, p_size / 50.0E0 AS FB,
       CASE WHEN p_type <> 'SMALL' THEN {CLASS_OF_TYPE} END AS class
FROM {{part}}""",
    # Orders as an external inventory by nation, gas and source.
    "inventory": """
SELECT n_name AS Country, CASE WHEN o_orderstatus = 'F' THEN 'CH4'
            WHEN o_orderstatus = 'O' THEN 'N2O' ELSE 'CO2' END AS Substance,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Domestic Wastewater'
            WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_orderpriority END AS source,
       o_totalprice AS Y_2022, o_totalprice * 2 AS Y_2021
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # Suppliers as our own country totals.
    "ours": """
SELECT n_name AS Country, sum(s_acctbal) * 10 AS CH4_Total, sum(s_acctbal) AS CH4_WWTP,
       sum(CASE WHEN s_acctbal > 5000 THEN s_acctbal * 20 END) AS N2O_Total,
       sum(s_acctbal) * 2 AS N2O_WWTP
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name""",
    # Orders as plants with climate and size for the sewer match.
    "sewered": """
SELECT o_orderkey AS plant_id, n_name AS NAME_0, c_mktsegment AS Region,
       CASE WHEN o_orderpriority <> '5-LOW' OR o_totalprice > 100000 THEN o_totalprice END AS served,
       CASE WHEN month(o_orderdate) <> 12 THEN month(o_orderdate) * 2.5E0 END AS temperature,
       day(o_orderdate) * 4.0E0 AS precipitation
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # Order lines with their place, for the roll-ups.
    "sales": """
SELECT r_name AS NAME_0, n_name AS NAME_1, c_mktsegment AS NAME_2,
       l_extendedprice, l_quantity, l_tax,
       CASE WHEN l_discount > 0 THEN l_discount END AS l_discount, o_orderkey, c_custkey
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
}
