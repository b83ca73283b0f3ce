"""Administrative hierarchy: nodes, data marks, filling and city lookup.

A node is its path, an array of names from the country down. All steps are
joins and aggregations on paths; nothing walks a tree row by row.

Plants are never paired with cities. A city points to a *donor* — the node, or
the pooled siblings below a node, whose plants it uses — and a plant belongs to
at most two donors: its own region's node and the pool of that node's siblings.
City results then follow from donor results by one equi join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import name_or_null

NAMES = ("NAME_0", "NAME_1", "NAME_2", "NAME_3", "NAME_4")
SEPARATOR = "\u001f"

# Fixed value: countries below this population count as small.
SMALL_COUNTRY = 10_000_000.0


def admin_steps(names: Sequence[str] = NAMES, on_gap: str = "skip") -> Column:
    """Array of (level, path) from the country down to the deepest name of a row.

    ``skip`` attaches the name below a gap to the last known node, ``stop`` ends
    the path at the gap.
    """
    clean = [name_or_null(F.col(n)) for n in names]
    steps = []
    for level in range(len(clean)):
        upper = clean[: level + 1]
        if on_gap == "skip":
            valid = clean[0].isNotNull() & clean[level].isNotNull()
            path = F.array_compact(F.array(*upper))
        elif on_gap == "stop":
            valid = clean[0].isNotNull()
            for name in upper[1:]:
                valid = valid & name.isNotNull()
            path = F.array(*upper)
        else:
            raise ValueError(f"unknown gap rule {on_gap!r}")
        steps.append(F.when(valid, F.struct(F.lit(level).alias("level"), path.alias("path"))))
    return F.array_compact(F.array(*steps))


def _parent(path: Column) -> Column:
    return F.when(F.size(path) > 1, F.slice(path, F.lit(1), F.size(path) - 1))


def build_nodes(cities: DataFrame, population: str, row_id: str,
                names: Sequence[str] = NAMES, on_gap: str = "skip") -> DataFrame:
    """One row per path: level of its first row, first row, population sum."""
    steps = cities.select(F.col(row_id).alias("__row"),
                          F.col(population).try_cast("double").alias("__pop"),
                          F.explode(admin_steps(names, on_gap)).alias("__s"))
    return (steps.groupBy(F.col("__s.path").alias("path")).agg(
                F.min(F.struct("__row", F.col("__s.level").alias("level"))).alias("__first"),
                F.coalesce(F.sum("__pop"), F.lit(0.0)).alias("population"))
            .select("path", F.col("__first.level").alias("level"),
                    F.col("__first.__row").alias("first_row"), "population",
                    F.col("path")[0].alias("country"),
                    F.element_at("path", -1).alias("name"),
                    _parent(F.col("path")).alias("parent")))


def match_regions(nodes: DataFrame, regions: DataFrame, country: str = "NAME_0",
                  region: str = "Region") -> DataFrame:
    """(country, region, path): the node a region name stands for.

    A name equal to the country is the root. Otherwise nodes directly below the
    root come first, and among deeper ones the node whose parent a depth-first
    walk with the youngest sibling on top visits first. That order is the
    lexicographic order of the parent's negated first rows.
    """
    wanted = (regions.select(F.col(country).alias("country"), F.col(region).alias("region"))
              .where((F.col("country") != "nan") & (F.col("region") != "nan")).distinct())
    candidates = (wanted.join(nodes.select("country", F.col("name").alias("region"), "path"),
                              ["country", "region"])
                  .where((F.col("region") == F.col("country")) == (F.size("path") == 1)))

    depth = F.size("path")
    above = F.transform(F.sequence(F.lit(2), depth - 1),
                        lambda d: F.slice(F.col("path"), F.lit(1), d))
    uppers = (candidates.where(depth > 2)
              .select("country", "region", "path", F.explode(above).alias("upper")))
    order = (uppers.join(nodes.select(F.col("path").alias("upper"), "first_row"), "upper")
             .groupBy("country", "region", "path")
             .agg(F.sort_array(F.collect_list(
                 F.struct(F.size("upper").alias("d"), (-F.col("first_row")).alias("r"))))
                 .alias("__walk")))
    walk = F.coalesce(F.transform(F.col("__walk"), lambda s: s["r"]),
                      F.array().cast("array<bigint>"))
    return (candidates.join(order, ["country", "region", "path"], "left")
            .groupBy("country", "region")
            .agg(F.min_by("path", walk).alias("path")))


def mark_nodes(nodes: DataFrame, matched: DataFrame, regions: DataFrame, served: str,
               country: str = "NAME_0", region: str = "Region") -> DataFrame:
    """Nodes with ``has_data`` and the served population of their region."""
    data = (regions.select(F.col(country).alias("country"), F.col(region).alias("region"),
                           F.coalesce(F.col(served).cast("double"), F.lit(0.0)).alias("served"))
            .join(matched, ["country", "region"])
            .select("path", "served", F.lit(True).alias("has_data")))
    return (nodes.join(data, "path", "left")
            .withColumn("has_data", F.coalesce("has_data", F.lit(False)))
            .withColumn("served", F.coalesce("served", F.lit(0.0))))


# Provenance texts, {level} and {n} filled in per node.
PLANT_LABELS = {
    "parent": "inherited from NAME_{level}",
    "pool": "weighted from {n} sibling regions",
    "parent_larger": "inherited from parent (parent has larger served population)",
    "pool_larger": "weighted from {n} sibling regions (child has larger served population)",
    "small": "inherited from NAME_0",
    "country_only": "inherited from NAME_0",
    "own": None,
}
VALUE_LABELS = {
    "parent": "Propagated(from NAME_{level})",
    "pool": "Propagated(sibling avg, n={n})",
    "parent_larger": "Propagated(parent larger pop)",
    "pool_larger": "Propagated(sibling avg, child larger pop)",
    "small": "Propagated(small country)",
    "country_only": "Propagated(country-only)",
    "own": "Original",
}


def _label(text: str | None, level: Column, n: Column) -> Column:
    if text is None:
        return F.lit(None).cast("string")
    for mark, value in (("{level}", level), ("{n}", n)):
        if mark in text:
            before, after = text.split(mark)
            return F.concat(F.lit(before), value.cast("string"), F.lit(after))
    return F.lit(text)


def fill_nodes(marked: DataFrame, parent_wins_ties: bool = False,
               small_country: float = SMALL_COUNTRY,
               labels: Mapping[str, str | None] = PLANT_LABELS) -> DataFrame:
    """Adds ``donor_kind`` (own, parent, pool, root or NULL), ``donor`` and ``source``.

    Every pass of the rule only reads original marks, so one join of nodes with
    their parents and with sibling totals does all levels together. Level 4 is
    never filled from relatives.
    """
    fillable = (F.size("path") > 1) & F.col("level").between(1, 3)
    siblings = (marked.where(fillable).groupBy("parent", "level").agg(
        F.count(F.when(F.col("has_data"), 1)).alias("n_with"),
        F.sum(F.when(F.col("has_data"), F.col("served"))).alias("with_pop")))
    parents = marked.select(F.col("path").alias("parent"), F.col("level").alias("p_level"),
                            F.col("has_data").alias("p_has"), F.col("served").alias("p_pop"))
    joined = (marked.join(siblings, ["parent", "level"], "left")
              .join(parents, "parent", "left"))

    direct = fillable & (F.col("p_level") == F.col("level") - 1)
    n_with = F.coalesce("n_with", F.lit(0))
    with_pop = F.coalesce("with_pop", F.lit(0.0))
    larger = (F.col("p_pop") >= with_pop) if parent_wins_ties else (F.col("p_pop") > with_pop)
    rule = (F.when(F.col("has_data"), "own")
            .when(direct & F.col("p_has") & (n_with == 0), "parent")
            .when(direct & F.col("p_has") & (n_with > 0) & larger, "parent_larger")
            .when(direct & F.col("p_has") & (n_with > 0) & (with_pop > 0), "pool_larger")
            .when(direct & ~F.col("p_has") & (n_with > 0) & (with_pop > 0), "pool"))
    step = joined.withColumn("rule", rule).withColumn("n_with", n_with)

    is_root = F.size("path") == 1
    roots = (marked.where(is_root)
             .select("country", F.col("has_data").alias("r_has"),
                     (F.col("population") < small_country).alias("r_small")))
    small = (F.col("rule").isNull() & (F.size("path") == 2) & (F.col("level") == 1)
             & F.col("r_has") & F.col("r_small"))
    step = (step.join(roots, "country")
            .withColumn("rule", F.when(small, "small").otherwise(F.col("rule"))))

    covered = (step.where(~is_root).groupBy("country")
               .agg(F.max(F.col("rule").isNotNull()).alias("any_child")))
    alone = (F.col("rule").isNull() & ~is_root & F.col("r_has") & ~F.col("any_child"))
    step = (step.join(covered, "country", "left")
            .withColumn("rule", F.when(alone, "country_only").otherwise(F.col("rule"))))

    kind = (F.when(F.col("rule") == "own", "own")
            .when(F.col("rule").isin("parent", "parent_larger"), "parent")
            .when(F.col("rule").isin("pool", "pool_larger"), "pool")
            .when(F.col("rule").isin("small", "country_only"), "root"))
    donor = (F.when(F.col("donor_kind") == "own", F.col("path"))
             .when(F.col("donor_kind").isin("parent", "pool"), F.col("parent"))
             .when(F.col("donor_kind") == "root", F.slice("path", 1, 1)))
    source = F.lit(None).cast("string")
    for name, text in labels.items():
        source = F.when(F.col("rule") == name,
                        _label(text, F.col("level") - 1, F.col("n_with"))).otherwise(source)
    return (step.withColumn("donor_kind", kind)
            .select("path", "level", "country", "name", "parent", "population", "has_data",
                    "served", "rule", "n_with", "donor_kind", donor.alias("donor"),
                    source.alias("source")))


def donor_id(kind: Column, path: Column, level: Column) -> Column:
    """Text key of a donor: a node, or the pooled children of one level below it."""
    joined = F.array_join(path, SEPARATOR)
    pooled = F.concat(F.lit("pool"), level.cast("string"), F.lit(SEPARATOR), joined)
    return F.when(kind == "pool", pooled).when(
        kind.isNotNull(), F.concat(F.lit("node"), F.lit(SEPARATOR), joined))


def with_donor_id(filled: DataFrame) -> DataFrame:
    return filled.withColumn(
        "donor_id", donor_id(F.col("donor_kind"), F.col("donor"), F.col("level")))


def node_values(filled: DataFrame, matched: DataFrame, regions: DataFrame,
                values: Sequence[str], weight: str, country: str = "NAME_0",
                region: str = "Region") -> DataFrame:
    """Filled nodes with their values: own, inherited, or the weighted sibling mean.

    A sibling without a value still counts in the denominator.
    """
    own = (regions.select(F.col(country).alias("country"), F.col(region).alias("region"),
                          F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("__w"),
                          *values)
           .join(matched, ["country", "region"]).drop("country", "region"))
    positive = F.when(F.col("__w") > 0, F.col("__w"))
    pools = (filled.select("path", "parent", "level").join(own, "path")
             .groupBy(F.col("parent").alias("donor"), "level")
             .agg(*[F.try_divide(F.coalesce(F.sum(F.col(v) * positive), F.lit(0.0)),
                                 F.sum(positive)).alias(f"__p_{v}") for v in values]))
    single = own.select(F.col("path").alias("donor"),
                        *[F.col(v).alias(f"__o_{v}") for v in values])
    joined = filled.join(single, "donor", "left").join(pools, ["donor", "level"], "left")
    return joined.select(*filled.columns, *[
        F.when(F.col("donor_kind") == "pool", F.col(f"__p_{v}"))
        .otherwise(F.col(f"__o_{v}")).alias(v) for v in values])


def city_lookup(cities: DataFrame, filled: DataFrame, row_id: str,
                names: Sequence[str] = NAMES, on_gap: str = "skip",
                small_country: float = SMALL_COUNTRY, carry: Sequence[str] = ()) -> DataFrame:
    """(row_id, matched_level, donor_id, source, …) for every city.

    The deepest node with data wins; a small country falls back to its own data.
    Distinct admin paths are resolved once, cities are joined back by path.
    """
    located = cities.select(F.col(row_id), admin_steps(names, on_gap).alias("__steps"))
    paths = located.select("__steps").where(F.size("__steps") > 0).distinct()
    steps = paths.select("__steps", F.explode("__steps").alias("__s"))
    data = (with_donor_id(filled).where(F.col("donor_kind").isNotNull())
            .select("path", "donor_id", "rule", F.col("source").alias("node_source"),
                    (F.size("path") == 1).alias("is_root"), "population", *carry))
    usable = ~F.col("is_root") | (F.col("population") < small_country)
    found = (steps.join(data, F.col("__s.path") == F.col("path")).where(usable)
             .groupBy("__steps").agg(F.max_by(
                 F.struct(F.col("__s.level").alias("matched_level"), "donor_id", "node_source",
                          "rule", "is_root", *carry), F.col("__s.level")).alias("m")))
    return (located.join(found, "__steps", "left")
            .select(F.col(row_id), "m.matched_level", "m.donor_id", "m.node_source", "m.rule",
                    "m.is_root", *[f"m.{c}" for c in carry]))


def mapping_source(lookup: DataFrame) -> DataFrame:
    """Adds the provenance text of the city mapping."""
    text = (F.when(F.col("donor_id").isNull(), F.lit(""))
            .when(F.col("is_root"), F.lit("matched at NAME_0 only"))
            .when(F.col("node_source").isNotNull(), F.col("node_source"))
            .otherwise(F.concat(F.lit("direct match at NAME_"),
                                F.col("matched_level").cast("string"))))
    return lookup.withColumn("ef_source", text)


def data_label(lookup: DataFrame) -> DataFrame:
    """Adds the match level and Original / Propagated / None."""
    return (lookup
            .withColumn("Admin_Match_Level", F.when(
                F.col("donor_id").isNotNull(),
                F.concat(F.lit("NAME_"), F.col("matched_level").cast("string")))
                .otherwise(F.lit("")))
            .withColumn("Data_Source", F.when(F.col("donor_id").isNull(), "None")
                        .when(F.col("rule") == "own", "Original").otherwise("Propagated")))


def region_totals(plants: DataFrame, population: str, country: str = "NAME_0",
                  region: str = "Region") -> DataFrame:
    """Plants and served population per named region."""
    return (plants.where((F.col(country) != "nan") & (F.col(region) != "nan"))
            .groupBy(country, region).agg(
                F.count(F.lit(1)).alias("n_plants"),
                F.coalesce(F.sum(F.col(population).cast("double")), F.lit(0.0))
                .alias("Total_Served_Population")))


def donor_members(plants: DataFrame, matched: DataFrame, filled: DataFrame, plant_id: str,
                  population: str, country: str = "NAME_0", region: str = "Region") -> DataFrame:
    """(donor_id, plant_id, pop, weight): at most two rows per plant.

    Weights are population shares, or equal where a donor serves nobody.
    """
    placed = (plants.select(F.col(plant_id), F.col(country).alias("country"),
                            F.col(region).alias("region"),
                            F.coalesce(F.col(population).cast("double"), F.lit(0.0)).alias("pop"))
              .join(matched, ["country", "region"])
              .join(filled.select("path", "parent", "level"), "path"))
    poolable = F.col("parent").isNotNull() & F.col("level").between(1, 3)
    keys = F.array_compact(F.array(
        donor_id(F.lit("own"), F.col("path"), F.col("level")),
        F.when(poolable, donor_id(F.lit("pool"), F.col("parent"), F.col("level")))))
    members = placed.select(F.explode(keys).alias("donor_id"), plant_id, "pop")
    used = (with_donor_id(filled).where(F.col("donor_id").isNotNull())
            .select("donor_id").distinct())
    members = members.join(used, "donor_id", "left_semi")
    totals = members.groupBy("donor_id").agg(F.sum("pop").alias("donor_pop"),
                                             F.count(F.lit(1)).alias("donor_n"))
    return (members.join(totals, "donor_id")
            .withColumn("weight", F.when(F.col("donor_pop") > 0, F.col("pop") / F.col("donor_pop"))
                        .otherwise(1.0 / F.col("donor_n"))))


def keep_informed(members: DataFrame, informed: DataFrame, plant_id: str,
                  counted: str | None = None) -> DataFrame:
    """Drop plants without class information and renormalise the weights per donor.

    ``counted`` names a column for the number of plants that the donor keeps.
    """
    kept = members.join(informed.select(plant_id), plant_id, "left_semi")
    count = [F.count(F.lit(1)).alias(counted)] if counted else []
    totals = kept.groupBy("donor_id").agg(F.sum("weight").alias("__kept"), *count)
    return (kept.join(totals, "donor_id")
            .withColumn("weight", F.col("weight") / F.when(F.col("__kept") > 0, F.col("__kept"))
                        .otherwise(F.lit(1.0)))
            .drop("__kept"))


def affected_donors(members: DataFrame, informed: DataFrame, plant_id: str) -> DataFrame:
    """Donors that lost weight, and whether any weight is left."""
    flagged = members.join(informed.select(plant_id, F.lit(True).alias("__i")), plant_id, "left")
    kept = F.col("__i").isNotNull()
    return (flagged.groupBy("donor_id").agg(
                F.sum(F.when(~kept, F.col("weight")).otherwise(0.0)).alias("dropped_weight"),
                F.sum(F.when(kept, F.col("weight")).otherwise(0.0)).alias("kept_weight"))
            .where(F.col("dropped_weight") > 0))
