"""The catalogue of states: names, aliases and the closed lists of cells, as Column expressions and as a dimension table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DASH, SENTINELS, resolved, trimmed


class CatalogError(ValueError):
    """The catalogue itself is wrong; nothing can be checked against it."""


@dataclass(frozen=True)
class State:
    name: str
    terminal: bool
    requires_report: bool
    group: str
    aliases: tuple[str, ...]


# The states, the levels and the sentinels that come with the library.
STATES = (
    State("Queued", False, False, "queued", ("pending", "enqueued")),
    State("Analyzed", False, True, "analyzed", ("analizado", "reviewed")),
    State("Followup", False, True, "followup", ("follow-up", "investigate")),
    State("Confirmed", True, True, "confirmed", ("confirmado", "confirmed-fraud")),
    State("Cleared", True, True, "cleared", ("legit", "false-positive")),
    State("Discarded", True, False, "discarded", ("descartado", "ignored")),
    State("Archived", True, False, "archived", ("stale", "dead")),
)
RISK_LEVELS = ("Low", "Medium", "High", "Critical")
CONFIDENCE_LEVELS = ("High", "Medium", "Low")


@dataclass(frozen=True)
class Catalog:
    states: tuple[State, ...] = STATES
    risk_levels: tuple[str, ...] = RISK_LEVELS
    confidence_levels: tuple[str, ...] = CONFIDENCE_LEVELS
    sentinels: tuple[str, ...] = SENTINELS

    def by_key(self) -> dict[str, str]:
        """Each name and alias, in lower case, and the state that it stands for."""
        return {key.lower(): s.name for s in self.states for key in (s.name, *s.aliases)}

    def names(self) -> tuple[str, ...]:
        return tuple(s.name for s in self.states)

    def requiring_report(self) -> tuple[str, ...]:
        return tuple(s.name for s in self.states if s.requires_report)

    def resolve(self, value: str | None) -> str | None:
        return self.by_key().get(value.strip().lower()) if isinstance(value, str) else None

    # -- the same as columns: the catalogue is a handful of literals, so no join is needed ------------
    def state(self, c: Column) -> Column:
        """The state that a cell names, by its name or an alias in any case; null if it is none."""
        pairs = F.create_map(*(F.lit(x) for kv in self.by_key().items() for x in kv))
        return F.try_element_at(pairs, F.lower(trimmed(c)))

    def is_sentinel(self, c: Column) -> Column:
        return F.coalesce(F.lower(trimmed(c)).isin("", *(s.lower() for s in self.sentinels)), F.lit(True))

    def risk(self, c: Column) -> Column:
        return resolved(c, self.risk_levels)

    def confidence(self, c: Column) -> Column:
        return resolved(c, self.confidence_levels)

    def needs_report(self, state: Column) -> Column:
        return F.coalesce(state.isin(*self.requiring_report()), F.lit(False))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each name and alias: key (lower case), name, terminal, requires_report, dashboard_group, canonical."""
        rows = [(key.lower(), s.name, s.terminal, s.requires_report, s.group, key == s.name) for s in self.states for key in (s.name, *s.aliases)]
        return spark.createDataFrame(rows, "key string, name string, terminal boolean, requires_report boolean, dashboard_group string, canonical boolean")


def _texts(value: Any) -> tuple[str, ...]:
    return tuple(map(str, value)) if isinstance(value, list) else ()


def catalog_of(document: Any) -> Catalog:
    """A catalogue from the parsed YAML document; raises CatalogError where names clash or a list is missing."""
    if not isinstance(document, dict):
        raise CatalogError("the catalogue is empty")
    groups, risks, confidences = (_texts(document.get(k)) for k in ("dashboard_groups", "risk_levels", "confidence_levels"))
    given = document.get("states")
    if not isinstance(given, list) or not given:
        raise CatalogError("there are no states")
    for name, found in (("risk_levels", risks), ("confidence_levels", confidences)):
        if not found:
            raise CatalogError(f"{name} is empty")
    states, seen = [], set()
    for entry in given:
        if not isinstance(entry, dict):
            raise CatalogError("a state is no map")
        name = str(entry.get("name") or "").strip()
        if not name:
            raise CatalogError("a state has no name")
        if (group := str(entry.get("dashboard_group") or "")) not in groups:
            raise CatalogError(f"{name}: unknown dashboard group {group!r}")
        aliases = _texts(entry.get("aliases"))
        for key in (name, *aliases):
            if key.lower() in seen:
                raise CatalogError(f"{key} is named twice")
            seen.add(key.lower())
        states.append(State(name, entry.get("terminal") is True, entry.get("requires_report") is True, group, aliases))
    sentinels = _texts(document.get("cell_sentinels"))
    return Catalog(tuple(states), risks, confidences, tuple(s.lower() for s in sentinels))


def load(path: str) -> Catalog:
    from ..sources.documents import load_yaml

    return catalog_of(load_yaml(path))


__all__ = ["CONFIDENCE_LEVELS", "DASH", "RISK_LEVELS", "STATES", "Catalog", "CatalogError", "State", "catalog_of", "load"]
