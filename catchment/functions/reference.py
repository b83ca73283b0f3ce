"""Small fixed tables and how they become DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sewer networks (name, population equivalents, climate, kg CH4 per ML).
SEWER_NETWORKS = [
    ("A", 13000, "Humid subtropical", 9.2),
    ("B", 7200, "Humid subtropical", 6.8),
    ("C", 7300, "Humid subtropical", 7.0),
    ("D", 4800, "Mediterranean", 2.6),
    ("E", 24600, "Humid subtropical", 5.5),
    ("F", 18900, "Humid subtropical", 10.8),
    ("G", 7400, "Humid subtropical", 7.4),
    ("H", 9600, "Humid subtropical", 7.3),
    ("I", 13900, "Hot semi-arid", 4.9),
    ("J", 33500, "Humid subtropical", 6.8),
    ("K", 2200000, "Humid continental", 11.4),
    ("L", 49500, "Humid subtropical", 0.6),
    ("M", 60400, "Humid subtropical", 3.5),
    ("N", 58900, "Mediterranean", 5.2),
    ("O", 46800, "Mediterranean", 8.3),
    ("P", 100200, "Mediterranean", 3.5),
    ("Q", 99000, "Mediterranean", 8.2),
    ("R", 18600, "Mediterranean", 14.9),
    ("S", 26000, "Humid subtropical", 1.2),
    ("T", 186500, "Humid subtropical", 0.8),
    ("U", 6000, "Temperate oceanic", 18.9),
]

# Inventory spellings of country names.
COUNTRY_ALIASES = [
    ("Bolivia (Plurinational State of)", "Bolivia"),
    ("Brunei Darussalam", "Brunei"),
    ("Cabo Verde", "Cape Verde"),
    ("Congo", "Republic of Congo"),
    ("Congo_the Democratic Republic of the", "Democratic Republic of the Congo"),
    ("Cote d'Ivoire", "Côte d'Ivoire"),
    ("Czechia", "Czech Republic"),
    ("Democratic People's Republic of Korea", "North Korea"),
    ("Eswatini", "Swaziland"),
    ("Iran (Islamic Republic of)", "Iran"),
    ("Lao PDR", "Laos"),
    ("Lao People's Democratic Republic", "Laos"),
    ("Micronesia (Federated States of)", "Micronesia"),
    ("North Macedonia", "Macedonia"),
    ("Republic of Korea", "South Korea"),
    ("Republic of Moldova", "Moldova"),
    ("Russian Federation", "Russia"),
    ("Sao Tome and Principe", "São Tomé and Príncipe"),
    ("State of Palestine", "Palestina"),
    ("Syrian Arab Republic", "Syria"),
    ("Timor Leste", "Timor-Leste"),
    ("United Kingdom of Great Britain and Northern Ireland", "United Kingdom"),
    ("United Republic of Tanzania", "Tanzania"),
    ("United States of America", "United States"),
    ("Venezuela (Bolivarian Republic of)", "Venezuela"),
    ("Viet Nam", "Vietnam"),
]

# Countries without provinces.
COUNTRIES_WITHOUT_PROVINCES = [
    "Aruba", "Anguilla", "Bahrain", "Saint-Barthélemy", "Cocos Islands", "Cook Islands",
    "Curaçao", "Christmas Island", "Falkland Islands", "Guernsey", "Gibraltar", "Hong Kong",
    "Kiribati", "Kuwait", "Macao", "Saint-Martin", "Monaco", "Maldives", "Marshall Islands",
    "Montserrat", "Norfolk Island", "Niue", "Pitcairn Islands", "Singapore",
    "Svalbard and Jan Mayen", "Saint Pierre and Miquelon", "Sint Maarten", "Seychelles",
    "Vatican City", "Wallis and Futuna", "Paracel Islands",
]

# Countries whose digestion status is predicted.
DIGESTION_COUNTRIES = [
    "Austria", "Belgium", "Denmark", "Finland", "France", "Germany", "Greece", "Ireland",
    "Italy", "Luxembourg", "Netherlands", "Portugal", "Spain", "Sweden", "United Kingdom",
    "Bulgaria", "Cyprus", "Czech Republic", "Estonia", "Hungary", "Latvia", "Poland",
    "Slovakia", "Slovenia", "South Korea", "Brazil",
]

# Countries held out in the country-level validation.
HOLDOUT_COUNTRIES = [
    "South Korea", "China", "Mexico", "Canada", "Japan", "India", "Thailand", "Tunisia",
    "Jamaica", "Jordan", "Vietnam", "Bolivia", "Singapore", "Nepal", "Bahrain", "Kuwait",
    "Morocco", "Botswana", "Yemen", "Bhutan", "Virgin Islands, U.S.", "Saint-Martin",
    "Reunion", "Puerto Rico", "Northern Mariana Islands", "Mayotte", "Martinique", "Guam",
    "Guadeloupe", "French Guiana", "American Samoa", "France", "United States",
]

# Booster settings per bucket.
BUCKET_SETTINGS = [
    ("small: 0-2000", 8, 100, 0.10, 5, 5),
    ("medium: 2000-10000", 5, 100, 0.10, 1, 1),
    ("large: 10000+", 6, 100, 0.10, 1, 1),
]

LITERAL_LIMIT = 10_000


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Broadcast-hinted DataFrame of driver-side literals; the row count is the proof of size."""
    if len(rows) > LITERAL_LIMIT:
        raise ValueError(f"{len(rows)} literal rows; write them as a table instead")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def sewer_networks(spark: SparkSession) -> DataFrame:
    rows = [(i, n, float(pe), c, e, math.log10(pe))
            for i, (n, pe, c, e) in enumerate(SEWER_NETWORKS)]
    return literal_table(
        spark, rows, "ord int, Network string, Total_PE double, Climate string, "
                     "E_ML double, log_PE double")


def bucket_settings(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, BUCKET_SETTINGS, "population_bucket string, max_depth int, n_estimators int, "
                                "learning_rate double, min_child_weight int, reg_lambda int")


def piped_lines(lines: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Parse ``a|b|c`` lines into columns; lines with another number of parts are dropped.

    The 246-row country table is an input of this kind, not a literal in code.
    """
    parts = F.split(F.trim(F.col(column)), r"\|")
    return (lines.select(parts.alias("__parts"))
            .where(F.size("__parts") == len(names))
            .select(*[F.trim(F.col("__parts")[i]).alias(n) for i, n in enumerate(names)]))
