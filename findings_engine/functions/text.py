"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming removes, the words that stand for no value.
WHITE_SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SENTINELS = ("", "—", "-", "n/a")
DASH = "—"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends (SQL's trim knows the space only)."""
    return F.regexp_replace(c, f"^{WHITE_SPACE}+|{WHITE_SPACE}+\\z", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-\\z", "")


def clean_cell(c: Column) -> Column:
    """Runs of tabs and line ends become a space."""
    return trimmed(F.regexp_replace(c, r"[\t\r\n]+", " "))


def escape_cell(c: Column) -> Column:
    return trimmed(F.replace(F.regexp_replace(c, r"\r?\n|\r", " "), F.lit("|"), F.lit("\\|")))


def unescape_cell(c: Column) -> Column:
    return trimmed(F.replace(c, F.lit("\\|"), F.lit("|")))


def shown(c: Column) -> Column:
    """The cell, or the dash that stands for no value."""
    return F.when(is_sentinel(c), DASH).otherwise(trimmed(c))


def is_sentinel(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin(*SENTINELS), F.lit(True))


def resolved(c: Column, values: tuple[str, ...]) -> Column:
    """The listed value that equals the cell in any case; null if there is none."""
    out = F.lit(None).cast("string")
    for v in values:
        out = F.when(F.lower(trimmed(c)) == v.lower(), v).otherwise(out)
    return out


def bold(c: Column) -> Column:
    return F.rlike(c, F.lit(r"\*\*[^*]+\*\*"))


def control_bytes(c: Column) -> Column:
    return F.rlike(c, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"))


def padded(number: Column, width: int = 3) -> Column:
    """Zeros in front up to the width; longer numbers stay whole (lpad alone would cut them)."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def messages(*rules: tuple[Column, Column | str]) -> Column:
    """The messages of the broken rules, in order."""
    return F.array_compact(F.array(*(F.when(bad, text if isinstance(text, Column) else F.lit(text)) for bad, text in rules)))
