"""Risk scoring from indicator codes, as Column expressions over an array of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Indicator codes and the categories that they imply. A code's letter is its severity.
CATEGORIES = {
    "C1": ("Scam",), "C2": ("Scam",), "C3": ("Scam",), "C4": ("Scam",),
    "H1": ("Scam",), "H2": ("Suspicious",), "H3": ("Suspicious",), "H4": ("Scam", "Suspicious"), "H5": ("Ghost/Stale", "Suspicious"),
    "M1": ("Suspicious", "Ghost/Stale"), "M2": ("Suspicious",), "M3": ("Suspicious",), "M4": ("Suspicious", "Ghost/Stale"),
    "L1": ("Suspicious",), "L2": (), "L3": ("Ghost/Stale",),
}
# What each indicator says.
LABELS = {
    "C1": "advance/registration fee or payment requested",
    "C2": "sensitive personal data demanded before a formal offer",
    "C3": "guaranteed income with pressure tactics",
    "C4": "confirmed scam pattern (phishing, fake checks, impersonation)",
    "H1": "recruiter uses a free-email domain while claiming to represent a real company",
    "H2": "strong urgency language",
    "H3": "missing or vague company identity",
    "H4": "email/domain does not match the claimed company",
    "H5": "strong ghost/stale signals (evergreen reposting, no concrete team detail)",
    "M1": "vague JD (no responsibilities, team, or deliverables)",
    "M2": "no salary range where the market normally shows one",
    "M3": "unprofessional language",
    "M4": "minimal company online presence",
    "L1": "minor title/responsibilities mismatch",
    "L2": "benefits not mentioned",
    "L3": "single repost",
}
LEVELS = ("Low", "Medium", "High", "Critical")
SEVERITIES = {"C": "Critical", "H": "High", "M": "Medium", "L": "Low"}


def codes(text: Column) -> Column:
    """Distinct upper-case codes of a text, in the order of their first use."""
    parts = F.filter(F.split(F.upper(text), r"[,;\s]+"), lambda x: x != "")
    return F.array_distinct(parts)


def count(found: Column, severity: str) -> Column:
    known = F.array(*(F.lit(c) for c in CATEGORIES if c[0] == severity))
    return F.size(F.filter(found, lambda x: F.array_contains(known, x)))


def level(found: Column) -> Column:
    c, h, m = (count(found, s) for s in "CHM")
    return F.when(c >= 1, "Critical").when((h >= 2) | (h >= 1) & (m >= 2), "High").when((h >= 1) | (m >= 2), "Medium").otherwise("Low")


def categories(found: Column) -> Column:
    """Sorted; ``Suspicious`` gives way to ``Scam``; nothing implied is ``Likely Genuine``."""
    implied = F.create_map(*(x for c, v in CATEGORIES.items() for x in (F.lit(c), F.array(*map(F.lit, v)).cast("array<string>"))))
    known = F.array_distinct(F.flatten(F.transform(found, lambda x: F.coalesce(F.try_element_at(implied, x), F.array().cast("array<string>")))))
    kept = F.when(F.array_contains(known, "Scam"), F.array_remove(known, "Suspicious")).otherwise(known)
    return F.when(F.size(kept) == 0, F.array(F.lit("Likely Genuine"))).otherwise(F.sort_array(kept))


def confidence(found: Column, risk: Column) -> Column:
    n, low = F.size(found), F.size(F.filter(found, lambda x: x.isin("L1", "L2", "L3")))
    severe = count(found, "C") + count(found, "H")
    return F.when((n >= 4) | (severe >= 2), "High").when((n >= 1) & (risk != "Low"), "Medium").when(n >= 2, "Medium").when((n == 1) & (low == 1), "Low").otherwise("Medium")


def tier(risk: Column) -> Column:
    return F.when(risk.isin("Critical", "High"), "Suspicious").when(risk == "Medium", "Proceed with Caution").otherwise("High Confidence")


def severity(code: Column) -> Column:
    """The severity that a known code's letter stands for; ``Unknown`` for others."""
    known = F.create_map(*(F.lit(x) for c in CATEGORIES for x in (c, SEVERITIES[c[0]])))
    return F.coalesce(F.try_element_at(known, code), F.lit("Unknown"))


def label(code: Column) -> Column:
    """What a code says; empty for an unknown one."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), code), F.lit(""))


def assessed(found: Column) -> Column:
    """The whole assessment of an array of codes: level, tier, categories, confidence and the indicators with severity and label."""
    risk = level(found)
    one = lambda x: F.struct(x.alias("code"), severity(x).alias("severity"), label(x).alias("label"))
    return F.struct(risk.alias("level"), tier(risk).alias("tier"), categories(found).alias("categories"), confidence(found, risk).alias("confidence"), F.transform(found, one).alias("indicators"))


def dimension(spark) -> DataFrame:
    """code, severity, label, categories of every indicator."""
    rows = [(c, SEVERITIES[c[0]], LABELS[c], list(v)) for c, v in CATEGORIES.items()]
    return spark.createDataFrame(rows, "code string, severity string, label string, categories array<string>")
