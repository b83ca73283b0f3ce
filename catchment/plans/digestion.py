"""Digestion status, sewer CH4, and their extension to the city table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NEGATIVE_LABEL, POSITIVE_LABEL, status_label
from ..functions.reference import DIGESTION_COUNTRIES
from ..operators.aggregate import class_summary, intensity, merge_regions, positive_share
from ..operators.frames import require_columns
from ..operators.hierarchy import (NAMES, SMALL_COUNTRY, VALUE_LABELS, build_nodes, city_lookup,
                                   data_label, fill_nodes, mark_nodes, match_regions, node_values)
from ..operators.match import by_climate, sewer_emissions
from ..operators.models import BoosterSettings, predict_binary, train_binary
from ..session import materialize

POP = "Current Served Population (estimate)"
# Features of the digestion model.
FEATURES = [
    "Current Served Population (estimate)", "Population_Density", "Urban_cluster_share",
    "GDP_PerCapita_PPP", "Extreme Monthly Average Temperature (High)", "Building_Area",
    "Water_Area", "Aridity_Index", "HDI", "Region_Area", "Rural_share",
    "Decadal Average Temperature", "Extreme Monthly Average Precipitation (High)",
    "Extreme Monthly Average Precipitation (Low)", "Average Atmospheric Pressure",
]
VALUES = ["Anaerobic_digestion_ratio", "Sewer_CH4_per_capita_kg_d"]
SERVED = "Total_Served_Population"


def label_observed(observed: DataFrame, flag: str = "Anaerobic Digestion") -> DataFrame:
    return observed.select("*", status_label(F.col(flag)).alias("Predicted_Anaerobic"),
                           F.lit("Observed").alias("Digestion_Source"))


def region_table(digestion: DataFrame, sewer: DataFrame, population: str = POP,
                 label: str = "Predicted_Anaerobic", keys: Sequence[str] = ("NAME_0", "Region"),
                 positive: str = POSITIVE_LABEL) -> DataFrame:
    """Digestion share and sewer intensity per region."""
    left = positive_share(digestion, keys, label, positive, population, VALUES[0], SERVED)
    right = intensity(sewer, keys, "Sewer_CH4_kg_d", population, VALUES[1], SERVED)
    return merge_regions(left, right, keys, SERVED)


def extend_cities(cities: DataFrame, regions: DataFrame, row_id: str,
                  values: Sequence[str] = VALUES, served: str = SERVED,
                  names: Sequence[str] = NAMES, population: str = "Population",
                  small_country: float = SMALL_COUNTRY) -> DataFrame:
    """City rows with the regional values, the match level and their provenance."""
    nodes = materialize(build_nodes(cities, population, row_id, names, "stop"), "nodes")
    regions = materialize(regions, "regions")
    matched = materialize(match_regions(nodes, regions), "matched")
    marked = materialize(mark_nodes(nodes, matched, regions, served), "marked")
    filled = materialize(fill_nodes(marked, True, small_country, VALUE_LABELS), "filled")
    valued = node_values(filled, matched, regions, values, served)
    found = data_label(city_lookup(cities, valued, row_id, names, "stop", small_country, values))
    kept = [c for c in cities.columns if c not in values]
    return cities.select(*kept).join(
        found.select(row_id, *values, "Admin_Match_Level", "Data_Source"), row_id)


def estimate(observed: DataFrame, plants: DataFrame, cities: DataFrame, plant_id: str, row_id: str,
             temperature: str = "Decadal Average Temperature",
             precipitation: str = "Decadal Average Precipitation",
             features: Sequence[str] = FEATURES, countries: Sequence[str] = DIGESTION_COUNTRIES,
             settings: BoosterSettings = BoosterSettings(), seed: int = 42) -> dict[str, DataFrame]:
    """Status of the plants of the listed countries, sewer CH4 of all, and the city table.

    ``observed`` has an id column of the same name as the plants'.
    """
    labelled = label_observed(require_columns(observed, ["NAME_0", "Region", POP, *features]))
    target = F.when(F.col("Predicted_Anaerobic") == POSITIVE_LABEL, 1).otherwise(0)
    model, medians, scored = train_binary(labelled.withColumn("target", target), plant_id, "target",
                                          features, settings, seed)
    predicted = predict_binary(model, medians, plants.where(F.col("NAME_0").isin(list(countries))),
                               features, POSITIVE_LABEL, NEGATIVE_LABEL)
    sewer = materialize(sewer_emissions(require_columns(plants, [POP, temperature, precipitation]),
                                        POP, temperature, precipitation), "sewer")
    keep = ["NAME_0", "Region", POP, "Predicted_Anaerobic", "Digestion_Source"]
    status = materialize(predicted.select(*keep).unionByName(labelled.select(*keep)), "status")
    regions = region_table(status, sewer)
    return {
        "predicted": predicted, "test_scores": scored,
        "countries": class_summary(predicted, "NAME_0", "Predicted_Anaerobic", POSITIVE_LABEL, POP),
        "sewer": sewer, "climates": by_climate(sewer, POP),
        "cities": extend_cities(cities, regions, row_id),
    }
