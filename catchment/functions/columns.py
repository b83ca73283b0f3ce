"""Predicates, cleaning rules and classifications on single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Served-population buckets.
BUCKET_EDGES = (2000.0, 10000.0)
BUCKET_LABELS = ("small: 0-2000", "medium: 2000-10000", "large: 10000+")

# Labels of the digestion status.
POSITIVE_LABEL = "Anaerobic"
NEGATIVE_LABEL = "Non-Anaerobic"


def population_bucket(pop: Column, edges: Sequence[float] = BUCKET_EDGES,
                      labels: Sequence[str] = BUCKET_LABELS) -> Column:
    """Three size buckets with closed upper edges; a missing size counts as the middle one."""
    small, medium, large = labels
    return (F.when(pop.isNull(), F.lit(medium))
            .when(pop <= edges[0], F.lit(small))
            .when(pop <= edges[1], F.lit(medium))
            .otherwise(F.lit(large)))


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive substring test; missing text is false."""
    return F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))


def name_or_null(text: Column) -> Column:
    """Administrative name with the textual missing marker turned into NULL."""
    return F.when(text != "nan", text)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_number(value: Column, default: float | None = None) -> Column:
    """Number or NULL (or a default) for text that does not parse."""
    number = nan_to_null(value.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def status_label(flag: Column, positive: str = POSITIVE_LABEL,
                 negative: str = NEGATIVE_LABEL) -> Column:
    """Positive only when the flag reads as exactly 1."""
    return F.when(to_number(flag, 0.0) == 1.0, F.lit(positive)).otherwise(F.lit(negative))


def ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """num / den where den > 0, else the given value."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise).cast("double"))


def climate_class(temperature: Column, monthly_precipitation: Column) -> Column:
    """Climate class for the sewer match; the most specific rule is tested first."""
    yearly = monthly_precipitation * 12
    moderate = (yearly >= 500) & (yearly <= 1200)
    return (F.when((yearly < 500) & (temperature > 18), "Hot semi-arid")
            .when(temperature < 10, "Humid continental")
            .when((temperature < 15) & moderate, "Temperate oceanic")
            .when((temperature >= 15) & moderate, "Mediterranean")
            .otherwise("Humid subtropical"))


def safe_name(text: Column) -> Column:
    """Text reduced to word characters and dashes, joined by single underscores."""
    return F.btrim(F.regexp_replace(text, r"(?U)[^\w\-]+", "_"), F.lit("_"))


def first_integer(label: Column, default: int = 10 ** 12) -> Column:
    return F.coalesce(F.regexp_extract(label, r"(\d+)", 1).try_cast("long"), F.lit(default))


def is_f_scale(mark: Column, trim: bool = True) -> Column:
    """True when a record already is on the F scale; a missing mark is not."""
    return F.coalesce((F.trim(mark) if trim else mark) == "F", F.lit(False))


def off_scale(mark: Column, rule: str = "!=F") -> Column:
    """Whether a record has to be rescaled: everything but F, or only B."""
    if rule == "!=F":
        return ~is_f_scale(mark, trim=False)
    return F.coalesce(mark == "B", F.lit(False))


def join_key(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


def split_key(key: Column) -> tuple[Column, Column]:
    """Split on the first separator only."""
    parts = F.split(key, r" \| ", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))
