"""Match of every row to its nearest reference under a class penalty."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import climate_class
from ..functions.emissions import sewer_chain
from ..functions.reference import SEWER_NETWORKS
from .aggregate import sum_or_zero

# Fixed value: distance added when the climate differs.
CLASS_PENALTY = 3.0
MAX_REFERENCES = 256


def nearest_reference(df: DataFrame, size: str, klass: str,
                      references: Sequence[tuple[str, float, str, float]],
                      penalty: float = CLASS_PENALTY) -> DataFrame:
    """Adds network, climate, factor and distance of the best reference.

    ``references`` are (name, size, class, factor) literals. Every row is compared
    with all of them inside one generated expression: no join and no shuffle.
    The first reference wins ties, and a row without a size takes the first one.
    """
    if not 0 < len(references) <= MAX_REFERENCES:
        raise ValueError(f"between 1 and {MAX_REFERENCES} references, got {len(references)}")
    log_size = F.when(F.col(size).isNotNull(),
                      F.log10(F.greatest(F.col(size).cast("double"), F.lit(1.0))))
    keyed = df.withColumn("__log", log_size)

    def candidate(position: int, name: str, ref_size: float, ref_class: str, factor: float):
        other = F.coalesce(F.col(klass) != ref_class, F.lit(True))
        away = F.abs(F.col("__log") - F.lit(math.log10(ref_size)))
        return F.struct(
            (F.when(other, F.lit(penalty)).otherwise(F.lit(0.0)) + away).alias("distance"),
            F.lit(position).alias("ord"), F.lit(name).alias("network"),
            F.lit(ref_class).alias("climate"), F.lit(float(factor)).alias("factor"))

    options = [candidate(i, *ref) for i, ref in enumerate(references)]
    best = F.least(*options) if len(options) > 1 else options[0]
    return (keyed.withColumn("__best", best)
            .select(*df.columns, F.col("__best.network").alias("Matched_Network"),
                    F.col("__best.climate").alias("Matched_Climate"),
                    F.col("__best.factor").alias("E_ML_kg_per_ML"),
                    F.col("__best.distance").alias("Match_Distance")))


def sewer_emissions(plants: DataFrame, population: str, temperature: str,
                    precipitation: str) -> DataFrame:
    """Climate class, matched network and the sewer CH4 chain of every plant."""
    classed = plants.withColumn("Sewer_Climate",
                                climate_class(F.col(temperature), F.col(precipitation)))
    matched = nearest_reference(classed, population, "Sewer_Climate", SEWER_NETWORKS)
    chain = sewer_chain(F.col(population).cast("double"), F.col("E_ML_kg_per_ML"))
    return matched.select(*matched.columns, *[c.alias(n) for n, c in chain.items()])


def by_climate(sewer: DataFrame, population: str) -> DataFrame:
    """Plants and yearly totals per matched climate."""
    return sewer.groupBy("Matched_Climate").agg(
        F.count(population).alias("n_plants"),
        F.bround(sum_or_zero(F.col("Sewer_CH4_t_yr")) / 1e6, 4).alias("CH4_Tg_yr"),
        F.bround(sum_or_zero(F.col("Sewer_CO2e_t_yr")) / 1e6, 4).alias("CO2e_Mt_yr"))
