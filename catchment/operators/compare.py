"""Comparison of own totals with external inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_ci, ratio
from ..session import materialize
from .aggregate import add_global_share, pivot_sums
from .frames import small_side
from .ranking import with_rank, with_row_number


def admin_fallback(df: DataFrame, without_provinces: Sequence[str],
                   country: str = "NAME_0", province: str = "NAME_1",
                   city: str = "NAME_2", out: str = "City_Level") -> DataFrame:
    """Fill missing lower levels from the level above and say which case applied."""
    whole = F.coalesce(F.col(country).isin(list(without_provinces)), F.lit(False))
    no_province = F.col(province).isNull() | (F.col(province) == "")
    no_city = F.col(city).isNull() | (F.col(city) == "")
    filled = {
        province: F.when(whole | no_province, F.col(country)).otherwise(F.col(province)),
        city: (F.when(whole | no_province, F.col(country))
               .when(no_city, F.col(province)).otherwise(F.col(city))),
    }
    label = (F.when(whole, "Country_as_City")
             .when(no_province, "Country_as_Province_as_City")
             .when(no_city, "Province_as_City").otherwise("City"))
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns],
                     label.alias(out))


def year_column(columns: Sequence[str], preferred: str = "Y_2022", required: bool = True) -> str | None:
    """The preferred reporting year if present, else the latest ``Y_`` column."""
    for name in columns:
        if preferred in name:
            return name
    years = sorted(c for c in columns if c.startswith("Y_"))
    if years:
        return years[-1]
    if required:
        raise KeyError("no year column")
    return None


def sector_split(inventory: DataFrame, source: str = "source",
                 needle: str = "wastewater") -> tuple[DataFrame, DataFrame]:
    """(rows of the sector, all other rows)."""
    inside = contains_ci(F.col(source), needle)
    return inventory.where(inside), inventory.where(~inside)


def theta_rank(ours: DataFrame, sectors: DataFrame, keys: Sequence[str], value: str,
               measures: Sequence[str], suffix: str = "_rank") -> DataFrame:
    """1 + number of sector rows above our value, per key; NULL without sector rows.

    ``ours`` has one row per key and is broadcast once counted to be small, so the sector
    rows are counted where they are read. A missing own value compares false
    everywhere and therefore ranks first.
    """
    own = small_side(ours.select(*keys, *measures))
    counted = (sectors.select(*keys, F.col(value).alias("__v"))
               .join(own, list(keys))
               .groupBy(*keys).agg(*[
                   (F.sum(F.when(F.col("__v") > F.col(m), 1).otherwise(0)) + 1)
                   .cast("long").alias(f"{m}{suffix}") for m in measures]))
    return ours.join(counted, list(keys), "left")


def inventory_comparison(ours: DataFrame, inventory: DataFrame, gases: Sequence[str],
                         own_total: dict[str, str], own_part: dict[str, str],
                         year: str, country: str = "Country", gas: str = "Substance",
                         source: str = "source", needle: str = "wastewater") -> DataFrame:
    """Shares, corrected totals and sector ranks of each country and gas, in long form."""
    inside = contains_ci(F.col(source), needle)
    present = F.col(country).isNotNull() & F.col(gas).isNotNull()
    reported = (inventory.where(present).groupBy(country, gas).agg(
        F.when(F.count(F.when(inside, 1)) > 0,
               F.coalesce(F.sum(F.when(inside, F.col(year))), F.lit(0.0))).alias("inventory_ww"),
        F.when(F.count(F.when(~inside, 1)) > 0,
               F.coalesce(F.sum(F.when(~inside, F.col(year))), F.lit(0.0))).alias("other_sectors")))

    per_gas = F.array(*[F.struct(F.lit(g).alias(gas),
                                 F.col(own_total[g]).cast("double").alias("our_ww"),
                                 F.col(own_part[g]).cast("double").alias("our_part"))
                        for g in gases])
    long = (ours.select(country, F.explode(per_gas).alias("__g"))
            .select(country, "__g.*")
            .join(reported, [country, gas], "left"))
    ranked = theta_rank(long, inventory.where(~inside), [country, gas], year,
                        ["inventory_ww", "our_ww", "our_part"])
    total = F.col("other_sectors") + F.col("inventory_ww")
    corrected = F.col("other_sectors") + F.col("our_ww")
    return ranked.select(
        country, gas, "other_sectors", "inventory_ww",
        total.alias("inventory_total"),
        ratio(F.col("inventory_ww") * 100, total).alias("inventory_share_pct"),
        F.when(F.col("inventory_ww").isNotNull(), F.col("inventory_ww_rank"))
        .alias("inventory_rank"),
        corrected.alias("corrected_total"),
        ratio(F.col("our_ww") * 100, corrected).alias("our_share_pct"),
        F.col("our_ww_rank").alias("our_rank"),
        ratio(F.col("our_part") * 100, corrected).alias("our_part_share_pct"),
        F.col("our_part_rank").alias("our_part_rank"))


def inventory_wide(long: DataFrame, gases: Sequence[str], country: str = "Country",
                   gas: str = "Substance") -> DataFrame:
    """The comparison with one row per country and gas-prefixed columns."""
    measures = [c for c in long.columns if c not in (country, gas)]
    return long.groupBy(country).agg(*[
        F.max(F.when(F.col(gas) == g, F.col(m))).alias(f"{g}_{m}")
        for g in gases for m in measures])


def sector_ranking(inventory: DataFrame, countries: DataFrame, gases: Sequence[str], year: str,
                   combined: str = "GHG", country: str = "Country", gas: str = "Substance",
                   source: str = "source", needle: str = "wastewater") -> DataFrame:
    """Reported sector totals with share and rank per gas and combined."""
    inside, _ = sector_split(inventory, source, needle)
    table = pivot_sums(inside, country, gas, gases, year, combined)
    kept = materialize(table.join(countries.select(country).distinct(), country, "left_semi"),
                       "sector")
    labels = [*gases, combined]
    out = add_global_share(kept, labels, stored=True)
    for label in labels:
        out = with_rank(out, label, f"{label}_Rank", source=kept)
    return out


def absent_countries(inventory: DataFrame, countries: DataFrame, country: str = "Country",
                     source: str = "source", needle: str = "wastewater") -> DataFrame:
    """Own countries without a row in the sector."""
    inside, _ = sector_split(inventory, source, needle)
    return (countries.select(country).where(F.col(country).isNotNull()).distinct()
            .join(inside, country, "left_anti"))


def order_rows(df: DataFrame, emission: str, wealth: str, tie: str, out: str = "position") -> DataFrame:
    """Largest wealth first, rows without emissions last; adds the position in that order."""
    idle = F.when(F.coalesce(F.col(emission), F.lit(0.0)) <= 0, 1).otherwise(0)
    order = [idle.asc(), F.col(wealth).desc_nulls_last(), F.col(tie).asc()]
    return with_row_number(df, [], order, None, out).drop(f"{out}_total").orderBy(out)
