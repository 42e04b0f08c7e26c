"""Reports: documents with header fields, an embedded summary in YAML and sections in a fixed order.

Everything but the YAML itself is a Column expression; the summary's block is cut out in SQL, and only that block goes
through a vectorised function, which gives a struct with each member as JSON text, so that its type can still be told.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import risk
from ..functions.text import DASH, messages, padded, slug, trimmed

# The sections in their order, the closed lists of a summary, and its members.
SECTIONS = (
    "## A) Posting Facts", "## G) Posting Legitimacy", "## Risk Assessment", "## Employer Verification",
    "## Recommended Actions", "## Risk Summary", "## Score Evidence", "## Job Description (archived verbatim)",
)
TIERS = ("High Confidence", "Proceed with Caution", "Suspicious")
RISK_CATEGORIES = ("Scam", "Ghost/Stale", "Suspicious", "Likely Genuine")
DECISIONS = ("Apply", "Consider", "Research first", "Skip")
CONFIDENCES = ("High", "Medium", "Low")
MEMBERS = ("company", "role", "legitimacy_tier", "risk_level", "confidence", "categories", "indicators", "final_decision", "next_action", "hard_stops", "soft_gaps", "risk_summary")
# Fixed value: the pattern of forbidden verdicts.
VERDICT = r"(?i)\b(?:definitely|certainly)\s+(?:a\s+)?(?:fake|scam)\b|\bthis\s+is\s+(?:a\s+)?(?:fake|scam)\b"
_SUMMARY = StructType([StructField(m, StringType()) for m in MEMBERS])


def summary_block(text: Column) -> Column:
    """The YAML between the marks of the summary; null without one."""
    marked = F.nullif(F.regexp_extract(text, r"(?s)<!--\s*machine-summary\s*-->(.*?)<!--\s*/machine-summary\s*-->", 1), F.lit(""))
    return F.when(F.rlike(marked, F.lit(r"(?s)```yaml\n.*?\n```")), F.regexp_extract(marked, r"(?s)```yaml\n(.*?)\n```", 1))


def members_of(block: str | None) -> dict[str, str | None] | None:
    """Each member of the summary as JSON text, null where it is absent; None where the block is no map."""
    from ..sources.documents import parse_yaml

    try:
        document = parse_yaml(block) if block is not None else None
    except ValueError:
        return None
    if not isinstance(document, (dict, list)) or not document and document != {}:
        return None
    held = document if isinstance(document, dict) else {}
    return {m: json.dumps(held[m], default=str, ensure_ascii=False) if m in held else None for m in MEMBERS}


@F.pandas_udf(_SUMMARY)
def _parsed(block: pd.Series) -> pd.DataFrame:
    found = [members_of(b if isinstance(b, str) else None) for b in block]
    return pd.DataFrame([f or dict.fromkeys(MEMBERS) for f in found], columns=list(MEMBERS), dtype=object)


@F.pandas_udf(BooleanType())
def _is_summary(block: pd.Series) -> pd.Series:
    return block.map(lambda b: isinstance(b, str) and members_of(b) is not None)


def parsed(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``summary`` (members as JSON text) and ``has_summary``. Blocks are parsed where documents are read."""
    block = summary_block(F.col(text))
    rows = documents.withColumn("_block", block)
    return rows.withColumns({"summary": _parsed("_block"), "has_summary": F.coalesce(_is_summary("_block"), F.lit(False))}).drop("_block")


@dataclass(frozen=True)
class Member:
    """A member of the summary by what its JSON text shows."""

    json: Column

    @property
    def text(self) -> Column:
        """As text: empty where absent or null."""
        quoted = F.startswith(self.json, F.lit('"'))
        plain = F.when(quoted, F.get_json_object(F.concat(F.lit('{"v":'), self.json, F.lit("}")), "$.v")).otherwise(self.json)
        return F.when(self.json.isNull() | (self.json == "null"), "").otherwise(plain)

    @property
    def given(self) -> Column:
        """Present and neither null, empty, false nor zero."""
        return F.coalesce(~self.json.isin("null", '""', "false", "0", "0.0"), F.lit(False))

    @property
    def is_list(self) -> Column:
        return F.coalesce(F.startswith(self.json, F.lit("[")), F.lit(False))

    @property
    def is_text(self) -> Column:
        return F.coalesce(F.startswith(self.json, F.lit('"')), F.lit(False))

    @property
    def items(self) -> Column:
        """A list's items as text; no list has none."""
        return F.when(self.is_list, F.coalesce(F.from_json(self.json, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def member(name: str, summary: str = "summary") -> Member:
    return Member(F.col(f"{summary}.{name}"))


def summary_problems(summary: str = "summary") -> Column:
    """The messages of the rules that a summary breaks, in the order of the rules."""
    m = lambda name: member(name, summary)
    listed = lambda name, values: (m(name).given & ~F.coalesce(m(name).is_text & m(name).text.isin(*values), F.lit(False)), F.lit(f"{name} has to be one of {'/'.join(values)}"))
    present = lambda name: m(name).json.isNotNull()

    def items(name: str, known: tuple[str, ...], upper: bool) -> Column:
        shown = (lambda x: F.upper(trimmed(x))) if upper else (lambda x: x)
        unknown = F.filter(m(name).items, lambda x: ~F.coalesce(shown(x).isin(*known), F.lit(False)))
        wrong = F.array(F.lit(f"{name} has to be a list"))
        return F.when(present(name) & ~m(name).is_list, wrong).otherwise(F.transform(unknown, lambda x: F.concat(F.lit(f"unknown {name}: "), F.coalesce(x, F.lit("null")))))

    empty = [(trimmed(m(name).text) == "", F.lit(f"{name} is empty")) for name in ("role", "company")]
    closed = [listed("legitimacy_tier", TIERS), listed("risk_level", risk.LEVELS), listed("confidence", CONFIDENCES)]
    last = [listed("final_decision", DECISIONS), (present("next_action") & ~m("next_action").is_text, F.lit("next_action has to be a text"))]
    return F.concat(messages(*empty, *closed), items("categories", RISK_CATEGORIES, False), items("indicators", tuple(risk.CATEGORIES), True), messages(*last))


def section_places(text: Column) -> Column:
    """The place in SECTIONS of each heading of the document, in its order."""
    lines = F.transform(F.split(text, r"\r?\n", -1), trimmed)
    place = F.lit(None).cast("int")
    at = lambda x: _place_of(x, place)
    return F.filter(F.transform(lines, at), lambda k: k.isNotNull())


def _place_of(line: Column, none: Column) -> Column:
    out = none
    for k, name in reversed(list(enumerate(SECTIONS))):
        out = F.when((line == name) | F.startswith(line, F.lit(f"{name} ")), k).otherwise(out)
    return out


def first_disorder(places: Column) -> Column:
    """The index of the first heading that doesn't come after the one before it; null if all do."""
    bad = F.filter(F.sequence(F.lit(1), F.greatest(F.size(places) - 1, F.lit(1))), lambda i: F.coalesce(F.get(places, i) <= F.get(places, i - 1), F.lit(False)))
    return F.get(bad, F.lit(0))


def verdict(text: Column) -> Column:
    return F.rlike(text, F.lit(VERDICT))


def checked(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``hard`` and ``warnings``: what a report's summary, sections and language show to be wrong.

    A report without a summary has that one finding alone.
    """
    rows = parsed(documents, text)
    raw = member("indicators").items
    codes = F.array_distinct(F.filter(F.transform(raw, lambda x: F.upper(trimmed(F.coalesce(x, F.lit("null"))))), lambda x: x != ""))
    rows = rows.withColumns({"_raw": F.size(raw), "_codes": codes, "_places": section_places(F.coalesce(text, F.lit("")))})
    level, tier, found = member("risk_level"), member("legitimacy_tier"), F.col("_codes")
    expected, implied = risk.tier(level.text), risk.level(found)
    categories = member("categories")
    missing = F.size(F.array_except(risk.categories(found), categories.items)) > 0
    bad = first_disorder(F.col("_places"))
    names = F.array(*map(F.lit, SECTIONS))
    rules = messages(
        (level.given & tier.given & (tier.text != expected), F.concat(F.lit('tier "'), tier.text, F.lit('" does not follow from level "'), level.text, F.lit('", which gives "'), expected, F.lit('"'))),
        (member("indicators").json.isNotNull() & (F.size("_codes") != F.col("_raw")), F.lit("indicators hold an empty or repeated code")),
        (level.given & (F.size(found) > 0) & (implied != level.text), F.concat(F.lit('level "'), level.text, F.lit('" contradicts the indicators, which give "'), implied, F.lit('"'))),
        (categories.given & (F.size(found) > 0) & missing, F.lit("categories do not follow from the indicators")),
        (bad.isNotNull(), F.concat(F.lit('out of order: "'), F.get(names, F.get(F.col("_places"), bad)), F.lit('"'))),
        (F.coalesce(verdict(F.col(text)), F.lit(False)), F.lit("states a verdict instead of signals")),
    )
    none = F.array().cast("array<string>")
    problems = F.transform(summary_problems(), lambda x: F.concat(F.lit("summary: "), x))
    hard = F.when(F.col("has_summary"), F.concat(problems, rules)).otherwise(F.array(F.lit("there is no machine summary")))
    warnings = F.when(F.col("has_summary") & (F.size("_places") == 0), F.array(F.lit("no section of a report found"))).otherwise(none)
    return rows.withColumns({"hard": hard, "warnings": warnings}).drop("_raw", "_codes", "_places")


def totals(reports: DataFrame) -> DataFrame:
    """One row: reports, hard findings, warnings, ok."""
    return reports.agg(F.count("*").alias("reports"), F.coalesce(F.sum(F.size("hard")), F.lit(0)).cast("long").alias("hard"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warnings"), F.coalesce(F.bool_and(F.size("hard") == 0), F.lit(True)).alias("ok"))


# -- header fields and the archive ----------------------------------------------------------------------
def header_field(text: Column, name: str) -> Column:
    """The first word behind ``**name:**``; null without one."""
    return F.nullif(F.regexp_extract(text, rf"\*\*{name}:\*\*\s*(\S+)", 1), F.lit(""))


def source_url(text: Column) -> Column:
    """The posting's URL: the header field if it is http(s), or else a line ``url: …``."""
    starred = header_field(text, "URL")
    return F.coalesce(F.when(F.rlike(starred, F.lit("(?i)^https?://")), starred), F.nullif(F.regexp_extract(text, r"""(?m)^url:\s*["']?(https?://[^\s"']+)""", 1), F.lit("")))


def archived(text: Column) -> Column:
    """Whether the document holds the section of the verbatim description."""
    return F.contains(text, F.lit(SECTIONS[-1]))


def capture(text: Column) -> Column:
    """The first file name that may be a captured description; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?i)(?:jds/)?[\w.-]+\.(?:md|txt|pdf)", 0), F.lit(""))


def archive_checked(documents: DataFrame, captures: DataFrame | None, text: str = "text") -> DataFrame:
    """The rows with ``verbatim``, ``capture`` and ``problem`` (null if fine). ``captures``: name; None if there is no folder."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.withColumn("verbatim", archived(body)).withColumn("capture", F.when(~F.col("verbatim"), capture(body)))
    neither = F.when(~F.col("verbatim") & F.col("capture").isNull(), "there is neither the description itself nor a captured file")
    if captures is None:
        return rows.withColumn("problem", neither)
    name = F.when(F.startswith("capture", F.lit("jds/")), F.substring(F.col("capture"), F.lit(5), F.length("capture"))).otherwise(F.col("capture"))
    known = captures.select(F.col("name").alias("_name")).distinct().withColumn("_there", F.lit(True))
    rows = rows.withColumn("_wanted", name).join(known, F.col("_wanted") == F.col("_name"), "left")
    gone = F.when(F.col("capture").isNotNull() & F.col("_there").isNull(), F.concat(F.lit("the captured file is missing: "), F.col("capture")))
    return rows.withColumn("problem", F.coalesce(neither, gone)).drop("_wanted", "_name", "_there")


# -- rendering ------------------------------------------------------------------------------------------
def file_name(number: Column, company: Column, title: Column) -> Column:
    """``NNN-company-role.md``; longer numbers stay whole."""
    said = lambda c, other: slug(F.coalesce(F.nullif(c, F.lit("")), F.lit(other)))
    return F.concat(padded(number), F.lit("-"), said(company, "company"), F.lit("-"), said(title, "role"), F.lit(".md"))


@F.pandas_udf(StringType())
def _dumped(document: pd.Series) -> pd.Series:
    from ..sources.documents import dump_yaml

    return document.map(lambda d: dump_yaml(json.loads(d)).rstrip("\n"), na_action="ignore")


def summary_text(summary: Column) -> Column:
    """A struct as the marked YAML block of a report; only the dump itself is no SQL."""
    return F.concat(F.lit("<!-- machine-summary -->\n```yaml\n"), _dumped(F.to_json(summary, {"ignoreNullFields": "false"})), F.lit("\n```\n<!-- /machine-summary -->"))


def rendered(row: dict[str, Column], codes: Column, decision: Column | None = None, next_action: Column | None = None, hard_stops: Column | None = None) -> Column:
    """A report's document for the row (columns by name) and its indicator codes."""
    none = F.array().cast("array<string>")
    cell = lambda name: F.coalesce(row[name], F.lit("")) if name in row else F.lit("")
    assessed, stops = risk.assessed(codes), hard_stops if hard_stops is not None else none
    checks = F.struct(*(F.lit("pass").alias(k) for k in ("legitimacy", "classification", "culture", "interview_redflags")))
    summary = F.struct(
        trimmed(cell("company")).alias("company"), cell("title").alias("role"), assessed["tier"].alias("legitimacy_tier"), assessed["level"].alias("risk_level"),
        assessed["confidence"].alias("confidence"), assessed["categories"].alias("categories"), codes.alias("indicators"),
        (decision if decision is not None else F.lit("")).alias("final_decision"), (next_action if next_action is not None else F.lit("")).alias("next_action"),
        stops.alias("hard_stops"), none.alias("soft_gaps"), checks.alias("risk_summary"),
    )
    line = lambda label, value: F.concat(F.lit(f"**{label}:** "), value)
    table = lambda *heads: "| " + " | ".join(heads) + " |\n|" + "---|" * len(heads)
    field = lambda label, value: F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))
    indicator = lambda x: F.concat_ws(" | ", F.concat(F.lit("| "), x["code"]), x["severity"], F.concat(x["label"], F.lit(" |")))
    shown = F.when(F.size(codes) > 0, F.array_join(F.transform(assessed["indicators"], indicator), "\n")).otherwise(f"| {DASH} | {DASH} | _no indicators recorded_ |")
    steps = F.when(F.size(stops) > 0, F.array_join(F.transform(stops, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". **Stop:** "), x)), "\n")).otherwise("1.")
    open_points = lambda *names: F.lit("\n".join(f"- {n}:" for n in names))
    bodies = (
        F.concat_ws("\n", F.lit(table("Field", "Value")), *(field(label, cell(name)) for label, name in (("Title", "title"), ("Company", "company"), ("Location", "location"), ("Posted", "date"), ("URL", "url")))),
        F.concat(F.lit("Signals are evidence, each with its ordinary explanations; a person decides.\n\n"), open_points("Posting age", "Apply button state", "Tech specificity", "Requirements realism", "Salary transparency", "Role-company fit", "Repost pattern", "Anomaly notes")),
        F.concat_ws("\n", line("Level", assessed["level"]), line("Categories", F.array_join(assessed["categories"], ", ")), line("Confidence", assessed["confidence"]), F.lit("\n" + table("Code", "Severity", "Detail")), shown),
        open_points("Website reachable", "Domain match", "Contact channel", "Notes"),
        steps,
        F.lit("\n".join([table("Signal", "Value"), *(f"| {s} | pass |" for s in ("Legitimacy", "Classification", "Culture", "Interview red flags"))])),
        F.lit("\n".join([table("Dimension", "Status", "Observation", "Open question"), "| Legitimacy | supported | see Risk Assessment | |", "| Compensation signals | | | |"])),
        F.lit("> The whole description goes here, word by word, or a file under `jds/` that is named here."),
    )
    head = F.concat(F.lit("# Analysis: "), F.coalesce(row.get("company", F.lit(None).cast("string")), F.lit("Unknown")), F.lit(f" {DASH} "), cell("title"))
    tracker = F.concat(F.lit("[#"), cell("num"), F.lit("](../data/findings.md)"))
    fields = F.concat_ws("\n", line("Date", cell("date")), line("Legitimacy", assessed["tier"]), line("Risk", assessed["level"]), line("Confidence", assessed["confidence"]), line("Tracker", tracker), line("URL", cell("url")), line("Source", cell("source")))
    sections = [F.concat(F.lit(f"{name}\n\n"), body) for name, body in zip(SECTIONS, bodies, strict=True)]
    return F.concat(F.concat_ws("\n\n", head, fields, summary_text(summary), *sections), F.lit("\n"))
