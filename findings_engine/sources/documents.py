"""Small documents that the driver reads: YAML files and where a workspace keeps its files."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ModuleNotFoundError:  # only these documents need it
    yaml = None


def _library():
    if yaml is None:
        raise ModuleNotFoundError("YAML documents need the yaml package")
    return yaml


def parse_yaml(text: str) -> Any:
    """The document; ValueError if the text is none."""
    library = _library()
    try:
        return library.safe_load(text)
    except library.YAMLError as error:
        raise ValueError(str(error)) from error


def dump_yaml(document: Any) -> str:
    return _library().safe_dump(document, sort_keys=False, allow_unicode=True, width=10**6)


def load_yaml(path: str | Path) -> Any:
    return parse_yaml(Path(path).read_text(encoding="utf-8"))


# The paths of a user's own files, and where the tracker may lie, under a workspace.
USER_PATHS = ("config/profile.yml", "modes/_profile.md", "modes/_custom.md", "portals.yml", "data", "reports")
TRACKER, OLD_TRACKER = "data/findings.md", "findings.md"


# The files that a user is to make their own, and whether a new workspace gets them at once.
OWN = (("config/profile.yml", False), ("modes/_profile.md", True), ("modes/_custom.md", True))
#: What each of them begins as; a text that still is this one says nothing of the user.
TEMPLATES = {
    "config/profile.yml": "# Who is looking, and for what.\nname: \nlocation: \nroles: []\n",
    "modes/_profile.md": "# Profile\n\nWhat a posting has to offer, and what rules one out.\n",
    "modes/_custom.md": "# Own rules\n\nRules of yours that go before the usual ones.\n",
}


def is_user_path(relative: str) -> bool:
    """Whether a path under the workspace is the user's own, which no update may touch."""
    posix = relative.replace(os.sep, "/")
    return any(posix == p or posix.startswith(p + "/") for p in USER_PATHS)


@dataclass(frozen=True)
class Workspace:
    """The paths of a workspace; ``tracker_file`` and ``portals_file`` name other files than the usual ones."""

    root: str
    tracker_file: str | None = None
    portals_file: str | None = None

    def path(self, *parts: str) -> str:
        return str(Path(self.root).resolve().joinpath(*parts))

    @property
    def tracker(self) -> str:
        """Where to read the tracker: the named file, the usual one, or one at the old place."""
        if self.tracker_file:
            return self.path(self.tracker_file)
        return next((p for p in (self.path(TRACKER), self.path(OLD_TRACKER)) if os.path.exists(p)), self.path(TRACKER))

    @property
    def tracker_to_write(self) -> str:
        return self.path(self.tracker_file or TRACKER)

    @property
    def portals(self) -> str:
        return self.path(self.portals_file or "portals.yml")

    additions = property(lambda self: self.path("data", "additions"))
    reports = property(lambda self: self.path("reports"))
    captures = property(lambda self: self.path("jds"))
    history = property(lambda self: self.path("data", "scan-history.tsv"))
    runs = property(lambda self: self.path("data", "scan-runs.tsv"))
    status_log = property(lambda self: self.path("data", "status-log.tsv"))
    reservations = property(lambda self: self.path("data", "report-nums.reserved.tsv"))
    lock = property(lambda self: self.path("data", ".tracker.lock"))


# -- entries of job boards ------------------------------------------------------------------------------
# The members that an entry may have.
ENTRY_MEMBERS = ("name", "enabled", "integration", "url", "company", "board", "key", "endpoint", "search", "tag", "limit", "source", "filters", "notes")
ENTRY = "entry_pos int, name string, enabled boolean, integration string, url string, company string, board string, key string, endpoint string, search string, tag string, limit string, page string, source string, title_terms array<string>, location_terms array<string>"


def portal_entries(document: Any) -> list[dict]:
    """The document's entries; none where it has no list of them."""
    found = document.get("entries") if isinstance(document, dict) else None
    return [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []


def _terms(entry: dict, name: str) -> list[str]:
    filters = entry.get("filters")
    found = filters.get(name) if isinstance(filters, dict) else None
    return [str(t).lower() for t in found] if isinstance(found, list) else []


def entries_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """One row for each entry, in order; ``enabled`` is false only where the entry says so, terms are in lower case."""
    text = lambda e, k: None if e.get(k) is None else str(e[k])
    rows = []
    for n, e in enumerate(entries):
        name = next((str(e[k]) for k in ("name", "integration", "url") if e.get(k) is not None), "anonymous")
        texts = [text(e, k) for k in ("integration", "url", "company", "board", "key", "endpoint", "search", "tag", "limit", "page", "source")]
        rows.append((n, name, e.get("enabled") is not False, *texts, _terms(e, "title_blacklist"), _terms(e, "location_blacklist")))
    return spark.createDataFrame(rows, ENTRY)


def entry_problems(document: Any, resolves) -> list[str]:
    """What is wrong with a portals document; ``resolves`` tells whether an entry has a board."""
    if not isinstance(document, dict):
        return ["the document is empty"]
    if not isinstance(document.get("entries"), list):
        return ["there is no list of entries"]
    out = []
    for n, e in enumerate(document["entries"]):
        if not isinstance(e, dict):
            out.append(f"entry {n}: no map")
            continue
        name = str(e.get("name") or "").strip()
        label = name or f"entry {n}"
        out += [f"{label}: no name"] * (not name)
        out += [f"{label}: unknown member {k!r}" for k in e if k not in ENTRY_MEMBERS]
        out += [f"{label}: filters have to be a map"] * ("filters" in e and not isinstance(e["filters"], (dict, list)))
        out += [f"{label}: no board, neither by integration nor by url"] * (not resolves(e))
    return out
