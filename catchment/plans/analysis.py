"""Roll-up of city emissions, shares, inventory comparison and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reference import COUNTRIES_WITHOUT_PROVINCES
from ..operators.aggregate import add_global_share, lead_columns, rollup, scale_columns
from ..operators.compare import (admin_fallback, inventory_comparison, inventory_wide,
                                 sector_ranking, year_column)
from ..operators.frames import require_columns

SUM_COLUMNS = ["CH4_WWTP", "CH4_Sewer", "CH4_unsafelytreated", "CH4_eff", "CH4_Total",
               "N2O_WWTP", "N2O_unsafelytreated", "N2O_eff", "N2O_Total"]
WEIGHTED_COLUMNS = ["CH4_Intensity", "N2O_Intensity"]
HEADLINE = ["GHG_WWTP", "CH4_WWTP", "N2O_WWTP"]
ATTRIBUTES = ["Continent", "Income_Level"]
KT_PER_MT = 1000.0

LEVELS = {
    "city": ["NAME_0", "NAME_1", "NAME_2"],
    "province": ["NAME_0", "NAME_1"],
    "country": ["NAME_0"],
    "continent": ["Continent"],
}


def prepare(cities: DataFrame, without_provinces: Sequence[str] = COUNTRIES_WITHOUT_PROVINCES
            ) -> DataFrame:
    """Derived totals and the administrative fallback on the checked input."""
    require_columns(cities, ["NAME_0", "NAME_1", "NAME_2", *ATTRIBUTES, "Population",
                             "GDP_PerCapita_PPP", *SUM_COLUMNS, *WEIGHTED_COLUMNS], "city table")
    derived = (cities.withColumn("GHG_WWTP", F.col("CH4_WWTP") + F.col("N2O_WWTP"))
               .withColumn("GDP_Total", F.col("GDP_PerCapita_PPP") * F.col("Population")))
    return admin_fallback(derived, without_provinces)


def level_table(prepared: DataFrame, level: str, row_id: str) -> DataFrame:
    """One level in Mt with global shares and its column order."""
    sums = [*SUM_COLUMNS, "GHG_WWTP", "Population", "GDP_Total"]
    rolled = rollup(prepared, LEVELS[level], sums, WEIGHTED_COLUMNS, "Population",
                    ATTRIBUTES, row_id)
    scaled = scale_columns(rolled, [*SUM_COLUMNS, "GHG_WWTP"], KT_PER_MT)
    shared = ["GHG_WWTP", "Population", "GDP_Total"] if level == "city" else [*HEADLINE, "Population"]
    out = add_global_share(scaled, shared)
    if level == "country":
        lead = ["NAME_0", "Income_Level", *HEADLINE, *[f"{c}_GlobalShare_pct" for c in HEADLINE],
                "Population", "Population_GlobalShare_pct"]
        out = lead_columns(out, lead)
    return out


def analyse(cities: DataFrame, inventory: DataFrame | None, row_id: str) -> dict[str, DataFrame]:
    """All tables of the analysis; the comparison is left out without an inventory."""
    prepared = prepare(cities)
    tables = {"prepared": prepared,
              **{level: level_table(prepared, level, row_id) for level in LEVELS}}
    if inventory is None:
        return tables
    country = tables["country"].withColumnRenamed("NAME_0", "Country")
    year = year_column(inventory.columns, required=False)
    if year is None:
        return {**tables, "comparison": country}
    gases = ["CH4", "N2O"]
    long = inventory_comparison(country, inventory, gases,
                                {g: f"{g}_Total" for g in gases},
                                {g: f"{g}_WWTP" for g in gases}, year)
    tables["comparison"] = country.join(inventory_wide(long, gases), "Country", "left")
    tables["ranking"] = sector_ranking(inventory, country, gases, year)
    return tables
