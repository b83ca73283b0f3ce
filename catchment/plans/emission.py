"""Emission estimate with 95 % intervals at every level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.emissions import ACTIVITY_COLUMNS, TREATMENT_CLASSES, secondary_loads, total_loads
from ..operators.aggregate import weighted_rate
from ..operators.draws import (MEMBERS_PER_PART, POOL_SIZE, city_reductions, city_table, donor_factors,
                               donor_series, group_emissions, level_emissions, level_loads,
                               level_table, pool_table)
from ..operators.frames import lookup, require_columns
from ..operators.hierarchy import (NAMES, SMALL_COUNTRY, build_nodes, city_lookup, donor_members,
                                   fill_nodes, keep_informed, mapping_source, mark_nodes,
                                   match_regions, region_totals)
from ..operators.proba import to_arrays
from ..session import materialize

LEVELS: dict[str, list[str]] = {
    "country": ["NAME_0"], "continent": ["Continent"], "income": ["Income_Level"],
    "region": ["NAME_0", "Region"], "global": []}


@dataclass(frozen=True)
class RunSettings:
    n_sim: int = 10_000
    pool_size: int = POOL_SIZE
    seed: int = 42
    classes: Sequence[str] = field(default_factory=lambda: list(TREATMENT_CLASSES))
    probability_uncertainty: bool = True
    fast: bool = True
    city_every: int = 1
    small_country: float = SMALL_COUNTRY
    per_part: int = MEMBERS_PER_PART


def map_cities(cities: DataFrame, plants: DataFrame, row_id: str, plant_id: str, served: str,
               population: str = "Population", names: Sequence[str] = NAMES,
               small_country: float = SMALL_COUNTRY) -> tuple[DataFrame, DataFrame]:
    """(city → donor, donor → plants with weights).

    The node tables are much smaller than the city table and are read by several
    later steps, so each is written once.
    """
    nodes = materialize(build_nodes(cities, population, row_id, names, "skip"), "nodes")
    regions = materialize(region_totals(plants, served), "regions")
    matched = materialize(match_regions(nodes, regions), "matched")
    marked = materialize(mark_nodes(nodes, matched, regions, "Total_Served_Population"), "marked")
    filled = materialize(fill_nodes(marked, False, small_country), "filled")
    found = mapping_source(city_lookup(cities, filled, row_id, names, "skip", small_country))
    return found, donor_members(plants, matched, filled, plant_id, served)


def city_loads(cities: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """City rows with total and secondary loads; continent and income from the lookup."""
    require_columns(cities, [*ACTIVITY_COLUMNS, "NAME_0", "Region"], "city table")
    totals = cities.select("*", *[c.alias(n) for n, c in total_loads().items()])
    loads = totals.select("*", *[c.alias(n) for n, c in secondary_loads(
        F.col("BOD_all"), F.col("TN_all")).items()],
        F.coalesce("Anaerobic_digestion_ratio", F.lit(0.0)).alias("ad_ratio"))
    if countries is None:
        return loads
    return lookup(loads, countries, "NAME_0", "country", ["Continent", "Income_Level"], "Unknown")


def informed_plants(matrix: DataFrame, plant_id: str, classes: Sequence[str]) -> DataFrame:
    """Plants with class information: probability arrays and the known class."""
    known = F.when(F.max("is_known"), F.min_by(
        F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")) - 1,
        -F.col("mean")))
    arrays = to_arrays(matrix, plant_id, classes)
    flags = matrix.groupBy(plant_id).agg(known.cast("int").alias("known_idx"),
                                         F.sum("mean").alias("__mass"))
    return (arrays.join(flags, plant_id)
            .where(F.col("known_idx").isNotNull() | (F.col("__mass") > 0)).drop("__mass"))


def draw_donors(members: DataFrame, matrix: DataFrame, pools: DataFrame, plant_id: str,
                settings: RunSettings) -> DataFrame:
    """(donor_id, parts, part, sim, weighted quantities): see :func:`donor_factors`."""
    plants = informed_plants(matrix, plant_id, settings.classes)
    kept = keep_informed(members, plants, plant_id, "n_members")
    return donor_factors(kept, plants, pool_table(pools, settings.classes), plant_id,
                         settings.classes, settings.n_sim, settings.pool_size, settings.seed,
                         settings.probability_uncertainty, settings.fast, per_part=settings.per_part)


def summarise(loads: DataFrame, factors: DataFrame, row_id: str, settings: RunSettings,
              levels: Mapping[str, Sequence[str]] = LEVELS) -> dict[str, DataFrame]:
    """Level, city and reduction tables from city loads (with ``donor_id``) and donor draws."""
    finest = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    emissions = level_emissions(group_emissions(
        loads, factors, finest, settings.seed, settings.n_sim), levels)
    series = donor_series(factors, settings.seed, settings.city_every, settings.n_sim)
    reductions = city_reductions(loads, series, row_id, ["NAME_0"])
    return {
        "levels": level_table(emissions, level_loads(loads, levels)),
        "cities": city_table(loads, series, row_id),
        "reductions": reductions,
        "country_reductions": weighted_rate(
            reductions, ["NAME_0"],
            {"CH4_Reduction_rate": "BOD_intoSecondary", "N2O_Reduction_rate": "TN_intoSecondary",
             "BODintoSludge_Ratio": "BOD_intoSecondary"}),
    }


def estimate(cities: DataFrame, plants: DataFrame, matrix: DataFrame, pools: DataFrame,
             countries: DataFrame, row_id: str, plant_id: str, served: str,
             settings: RunSettings = RunSettings()) -> dict[str, DataFrame]:
    """The whole estimate; the donor draws are written once and read by every table."""
    found, members = map_cities(cities, plants, row_id, plant_id, served,
                                small_country=settings.small_country)
    loads = materialize(city_loads(cities, countries).join(
        found.select(row_id, "donor_id", "ef_source"), row_id), "loads")
    factors = materialize(draw_donors(members, matrix, pools, plant_id, settings), "donors")
    return {"mapping": found, "members": members, **summarise(loads, factors, row_id, settings)}
