"""Postings of the public job boards, from the JSON documents that their interfaces return.

A board is a row of a table: where its records are and, for each field of a posting, a rule. A rule is a chain:

- ``a??b``: b if a is missing or null
- ``a//b``: b if a is missing, null or empty
- ``a|b``: b if a is missing, null or blank; binds loosest, and the result is trimmed

Paths are dotted, ``[0]`` takes the first of an array, ``ctx`` is the entry's company or else its name,
``epoch(path)`` a count of (milli)seconds as a time, ``join(path)`` an array's items, and ``https://…{path}`` a URL
built from a member that isn't blank. An object is no text; an array's texts are joined by commas.

All rules become one expression over a VARIANT column; documents are parsed, exploded and mapped where they are read, without a shuffle.
A document that is no JSON, or has no records at the board's place, gives no postings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..functions.url import has_suffix, host

FIELDS = ("title", "url", "company", "location", "description", "posted_at", "external_id")


@dataclass(frozen=True)
class Board:
    """``records``: members, the first that isn't null holds the array; ``bare``: the document itself may be the array."""

    name: str
    hosts: tuple[str, ...]
    match: str  # of a host: exact, ending (unanchored) or suffix (at a dot)
    records: tuple[str, ...]
    bare: bool
    fields: dict[str, str]
    needs: tuple[str, ...] = field(default=())  # a record counts only if one of these isn't empty


def _board(name, hosts, match, records, bare, title, url, company, location, posted_at, external_id, description="description", needs=()):
    rules = (title, url, company, location, description, posted_at, external_id)
    return Board(name, tuple(hosts.split()), match, tuple(records.split()), bare, dict(zip(FIELDS, rules, strict=True)), needs)


# The boards, their hosts and the members of their documents.
BOARDS = (
    _board("arbeitnow", "arbeitnow.com", "ending", "data jobs", True, "title|position", "url", "company_name|ctx", "location", "created_at", "slug??id"),
    _board("ashby", "api.ashbyhq.com", "exact", "jobs", False, "title", "jobUrl|url", "company.name??companyName|ctx", "location|secondaryLocation", "publishedAt??lastUpdatedAt", "jobUrl??id", "descriptionHtml"),
    _board("beehired", "beehired.com", "ending", "jobs data results", True, "title|name", "url|apply_url", "company_name|company.name|company|ctx", "location_name??location", "created_at??published_at", "id??url"),
    _board("freehire", "freehire.me", "ending", "jobs data", True, "title|jobTitle", "url|apply_url", "company|company_name|ctx", "location", "posted_at??published_at", "external_id??public_slug??id"),
    _board("greenhouse", "boards-api.greenhouse.io", "exact", "jobs", False, "title", "absolute_url", "company_name|ctx", "location.name", "updated_at", "id", "content"),
    _board("himalayas", "himalayas.app", "ending", "jobs data", True, "title|role_title", "applicationLink|url|https://himalayas.app/jobs/{slug}", "companyName|company_name|company.name|ctx", "join(locationRestrictions)//location//locations[0].text", "epoch(pubDate)|published_date|published_at|posted_at", "guid??id??slug"),
    _board("icims", "icims.com", "suffix", "searchedJobs jobs value data", True, "title??jobTitle??name", "url??jobUri", "company??organizationName|ctx", "location??jobLocation", "updatedOn??postedOn", "jobId??id??uri"),
    _board("jobicy", "jobicy.com", "ending", "jobs data", True, "jobTitle|title", "url|https://jobicy.com/jobs/{jobSlug}", "companyName|ctx", "jobGeo", "pubDate", "id??jobSlug", "jobDescription??jobExcerpt"),
    _board("jobspresso", "jobspresso.co", "exact", "jobs data", True, "title|position", "url|posting_url|apply_url", "company|ctx", "location", "date|created_at", "id??url"),
    _board("jobvite", "jobvite.com", "suffix", "jobs requisitions value data", True, "title??name??position", "url??requisitionUrl", "company??companyName|ctx", "location??city", "created_at??posted_at??date", "id??reqId??url"),
    _board("lever", "api.lever.co", "exact", "", True, "text|title|headline", "hostedUrl|url", "company|ctx", "categories.location??location", "createdAt??firstPublishedDate", "id", "descriptionPlain??description"),
    _board("nomado24", "nomado24.de", "ending", "jobs data", True, "title|jobTitle", "url", "companyName|company|ctx", "location", "publishedAt??posted_at", "slug??id"),
    _board("recruitcrm", "api.recruitcrm.io", "exact", "results items data", True, "title|name", "url|apply_url|public_url", "company_name|ctx", "location??city", "created_at??updated_at", "id??url"),
    _board("remotejobs", "remotejobs.org", "ending", "jobs data", True, "title|name", "url|apply_url", "company.name|company_name|ctx", "location??city", "posted_at??pub_date", "id??slug"),
    _board("remoteok", "remoteok.com", "exact", "", True, "position|title", "url|apply_url", "company|ctx", "location", "date|epoch", "id??url", needs=("url",)),
    _board("remotive", "remotive.com", "exact", "jobs", False, "title", "url|application_url", "company_name|ctx", "candidate_required_location??city", "publication_date", "id"),
    _board("smartrecruiters", "api.smartrecruiters.com", "exact", "content", False, "name??title", "ref??url|applyUrl", "company.name|company|ctx", "location.city|location.country", "releasedDate??postedOn??postedDate", "id??identifier", "jobDescription??description"),
    _board("themuse", "themuse.com", "ending", "results data", True, "name??title", "refs.landing_page|url", "company.name??company|ctx", "locations[0].name??location", "published_at??posted_at??first_published_at", "id??short_id", "contents??description"),
    _board("weworkremotely", "weworkremotely.com", "exact", "", True, "title??name", "url|link", "company.name|company_name|ctx", "location.city??location.name??location", "published_date|published_at|updated", "id??external_feed_id??url", "description??contents", ("url",)),
    _board("workable", "workable.com", "ending", "results jobs data", True, "title", "url|https://apply.workable.com/j/{shortcode}|apply_url", "company.name??company|ctx", "location.city|location.country|city", "created_at??published", "id??shortcode"),
    _board("workatastartup", "workatastartup.com", "ending", "", True, "title|role_title|name", "url|job_url", "company_name|company.name|ctx", "location??locations[0]??location_name", "created_at??published_at", "id??url", needs=("title", "role_title")),
    _board("workday", "myworkdayjobs.com", "suffix", "jobPostings jobs value data", True, "title??name??text", "url??externalPath", "company??organization|ctx", "location??cities??country", "postedOn|dateCreated", "externalPath??url", "description??externalFieldText"),
    _board("workingnomads", "workingnomads.com", "ending", "jobs data", True, "title|name", "url|link", "company_name|company|ctx", "location??category", "pub_date??created_at", "id??url"),
)


def _is(kind: str, v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def scalar(v: Column, path: str) -> Column:
    """A member as text; null where it is missing, null or an object."""
    m = _member(v, path)
    return F.when(_is("OBJECT", m), F.lit(None)).when(_is("ARRAY", m), joined(v, path, ",")).otherwise(F.try_variant_get(v, f"$.{path}", "string"))


def joined(v: Column, path: str, between: str = ", ") -> Column:
    return F.array_join(F.try_variant_get(v, f"$.{path}", "array<string>"), between)


def iso_time(n: Column) -> Column:
    """Seconds, or with 13 digits or more milliseconds, since 1970 as a time in UTC; null unless positive."""
    value = n.try_cast("double")
    millis = F.when(F.length(n) >= 13, value).otherwise(value * 1000).cast("long")
    return F.when(value > 0, F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def _atom(v: Column, context: Column, atom: str) -> Column:
    if atom == "ctx":
        return context
    if call := re.fullmatch(r"(epoch|join)\((.+)\)", atom):
        return iso_time(scalar(v, call[2])) if call[1] == "epoch" else joined(v, call[2])
    if built := re.fullmatch(r"(https://[^{]+)\{(.+)\}", atom):
        member = trimmed(scalar(v, built[2]))
        return F.when(member != "", F.concat(F.lit(built[1]), member))
    return scalar(v, atom)


def rule(v: Column, context: Column, text: str, trim: bool = True) -> Column:
    """The rule's text; empty if nothing fits."""
    out = []
    for alternative in text.split("|"):
        falsy = re.split(r"(?<!:)//", alternative)
        steps = [F.coalesce(*(_atom(v, context, a) for a in part.split("??"))) for part in falsy]
        chosen = F.coalesce(*(F.nullif(s, F.lit("")) for s in steps)) if len(steps) > 1 else steps[0]
        out.append(F.nullif(trimmed(chosen), F.lit("")) if trim else chosen)
    return F.coalesce(*out, F.lit(""))


def _records(doc: Column, board: Board) -> Column:
    """The board's records as an array of VARIANT; null where there are none."""
    first = F.coalesce(*(F.when(~_is("VOID", m := _member(doc, name)), m) for name in board.records)) if board.records else F.lit(None).cast("variant")
    held = F.when(_is("ARRAY", first), F.try_variant_get(first, "$", "array<variant>"))
    return F.when(_is("ARRAY", doc), F.try_variant_get(doc, "$", "array<variant>")).otherwise(held) if board.bare else held


def postings(documents: DataFrame, board_col: str = "board", payload: str = "payload", company: str = "company", name: str = "name", boards: tuple[Board, ...] = BOARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """board, pos and FIELDS of each posting in the documents (board, JSON text, the entry's company and name), and columns to ``keep``.

    An unknown board has no postings. Each document is parsed once; a record costs its own board's rules only.
    """
    context = F.coalesce(F.nullif(trimmed(F.col(company)), F.lit("")), trimmed(F.col(name)), F.lit(""))
    others = [F.col(c).alias(f"_keep_{c}") for c in keep]
    rows = documents.select(*others, F.lower(trimmed(F.col(board_col))).alias("board"), context.alias("_ctx"), F.try_parse_json(F.col(payload)).alias("_doc"))

    def by_board(make) -> Column:
        out = None
        for b in boards:
            out = F.when(F.col("board") == b.name, make(b)) if out is None else out.when(F.col("board") == b.name, make(b))
        return out

    rows = rows.withColumn("_records", by_board(lambda b: _records(F.col("_doc"), b)))
    kept = [f"_keep_{c}" for c in keep]
    rows = rows.select(*kept, "board", "_ctx", F.posexplode("_records").alias("pos", "_job"))
    job, ctx = F.col("_job"), F.col("_ctx")
    needed = by_board(lambda b: F.coalesce(*(F.nullif(scalar(job, n), F.lit("")) for n in b.needs)).isNotNull() if b.needs else F.lit(True))
    posting = by_board(lambda b: F.struct(*(rule(job, ctx, b.fields[f], trim=f != "description").alias(f) for f in FIELDS)))
    named = [F.col(f"_keep_{c}").alias(c) for c in keep]
    return rows.filter(needed).select(*kept, "board", "pos", posting.alias("p")).select("board", "pos", *(F.col(f"p.{f}").alias(f) for f in FIELDS), *named)


def routed(url: Column, boards: tuple[Board, ...] = BOARDS) -> Column:
    """The first board, in order of names, whose host the URL has; null if none."""
    h = host(trimmed(url))
    out = F.lit(None).cast("string")
    for b in sorted(boards, key=lambda b: b.name, reverse=True):
        fits = F.lit(False)
        for known in b.hosts:
            fits |= {"exact": h == known, "ending": F.endswith(h, F.lit(known)), "suffix": has_suffix(h, known)}[b.match]
        out = F.when(fits, b.name).otherwise(out)
    return out
