"""Activity and emission formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Global warming potentials and litres per person and day.
GWP_CH4 = 27
GWP_N2O = 273
LITRES_PER_CAPITA_DAY = 200

# Leak rate U(min, max) and generation rate N(mean, mean * uncertainty).
CH4_LEAK_MIN, CH4_LEAK_MAX = 0.0, 0.1
CH4_GEN_MEAN, CH4_GEN_UNCERTAINTY = 0.55, 0.30

# Default emission factors and their relative uncertainty.
CH4_DEFAULTS = {"Pond": 0.102, "Lagoon": 0.102, "Anaerobic": 0.408}
CH4_DEFAULT_UNCERTAINTY = 0.30
N2O_DEFAULTS = {"Anaerobic": 0.0}

# Treatment classes, and those allowed for advanced plants.
TREATMENT_CLASSES = ["A2O", "AO", "Anaerobic", "BAF", "BNR", "CAS", "EA", "Lagoon",
                     "MBR", "MLE", "OD", "Pond", "RBC", "SBR", "TF", "Wetland"]
ADVANCED_CLASSES = ["A2O", "AO", "BAF", "BNR", "EA", "MBR", "MLE", "OD", "SBR"]

# Fixed values: (class, sludge ratio, CH4 reduction, N2O reduction).
CLASS_COEFFICIENTS = [
    ("A2O", 0.6219171728, 0.9, 0.8),
    ("AO", 0.6219171728, 0.9, 0.8),
    ("Anaerobic", 0.12141, 0.85, 0.4),
    ("BAF", 0.6219171728, 0.9, 0.8),
    ("BNR", 0.6219171728, 0.9, 0.8),
    ("CAS", 0.6219171728, 0.85, 0.4),
    ("EA", 0.499485, 0.9, 0.8),
    ("Lagoon", 0.14058, 0.85, 0.4),
    ("MBR", 0.6219171728, 0.9, 0.8),
    ("MLE", 0.6219171728, 0.9, 0.8),
    ("OD", 0.6219171728, 0.9, 0.8),
    ("Pond", 0.14058, 0.85, 0.4),
    ("RBC", 0.591157644, 0.85, 0.4),
    ("SBR", 0.6219171728, 0.9, 0.8),
    ("TF", 0.591157644, 0.85, 0.4),
    ("Wetland", 0.14058, 0.85, 0.4),
]

# Names of the five emission targets and of the effective factors with their load.
TARGETS = ["CH4_Safetreated", "CH4_AD", "CH4_inPlant", "N2O_Safetreated", "CO2e_total"]
EFFECTIVE_FACTORS = [("CH4_EF_safetreated", "CH4_Safetreated", "bod"),
                     ("CH4_EF_inPlant", "CH4_inPlant", "bod"),
                     ("N2O_EF", "N2O_Safetreated", "tn")]

ACTIVITY_COLUMNS = ["Population", "BOD_PerCapita", "Protein_PerCapita", "F_NONCON", "N_HH",
                    "Protein_consumed", "pct_sewer", "pct_septic", "pct_sewer_treated",
                    "pct_septic_treated", "Anaerobic_digestion_ratio"]


def _c(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def total_loads() -> dict[str, Column]:
    """Total BOD and TN of a city; missing activity counts as zero."""
    bod = _c("Population") * _c("BOD_PerCapita") * 365 * 1e-9
    tn = (_c("Population") * _c("Protein_PerCapita") * 0.16 * _c("F_NONCON") * _c("N_HH")
          * 44 / 28 * 365 * 1e-9 * _c("Protein_consumed"))
    return {"BOD_all": bod, "TN_all": tn}


def secondary_loads(bod_all: Column, tn_all: Column) -> dict[str, Column]:
    """Part of the loads that reaches secondary treatment."""
    sewer, septic = _c("pct_sewer") / 100, _c("pct_septic") / 100
    sewer_ok, septic_ok = _c("pct_sewer_treated") / 100, _c("pct_septic_treated") / 100
    return {
        "BOD_intoSecondary": bod_all * (sewer * sewer_ok * 1.25 * 0.811333
                                        + septic * septic_ok * 0.375),
        "TN_intoSecondary": tn_all * (sewer * sewer_ok * 1.25 + septic * septic_ok * 0.85),
    }


def emission_targets(bod: Column, tn: Column, bod_ad: Column, ch4_ef: Column, n2o_ef: Column,
                     sludge: Column, gen: Column, leak: Column) -> dict[str, Column]:
    """The five targets; ``bod_ad`` is the BOD load times the digestion ratio."""
    safe = bod * ch4_ef
    digestion = bod_ad * sludge * gen * leak
    n2o = tn * n2o_ef
    return {
        "CH4_Safetreated": safe,
        "CH4_AD": digestion,
        "CH4_inPlant": safe + digestion,
        "N2O_Safetreated": n2o,
        "CO2e_total": (safe + digestion) * GWP_CH4 + n2o * GWP_N2O,
    }


def sewer_chain(population: Column, kg_per_ml: Column) -> dict[str, Column]:
    """Flow, daily and yearly CH4, and CO2 equivalents of one sewer network."""
    flow = population * LITRES_PER_CAPITA_DAY / 1e6
    kg_day = kg_per_ml * flow
    t_year = kg_day * 365 / 1000
    return {
        "Q_ML_d": flow,
        "Sewer_CH4_kg_d": kg_day,
        "Sewer_CH4_t_yr": t_year,
        "Sewer_CO2e_t_yr": t_year * GWP_CH4,
        "Sewer_CO2e_kt_yr": t_year * GWP_CH4 / 1000,
    }
