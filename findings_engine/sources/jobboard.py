"""The data source ``jobboard``: one partition for each entry of a portals document, one row for its board's document.

The reader runs on executors, one entry a task, and never fails for an entry: what goes wrong becomes that row's ``status``
(``no_provider`` or ``error``), so that a retried task asks a board again only if the executor itself was lost. The documents are
mapped to postings by ``sources.boards``, in SQL. Transport, lookup and guard can be replaced.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import weburl
from ..functions.net import Guard, GuardError
from ..functions.url import host_text
from ..sinks.committed import keep_first, store_of
from . import boards

# Where each board's interface is, which members of an entry build its URL, and limits of the transport.
#: Board: ("fixed", URL), ("endpoint", URL, beginning of a bare endpoint), ("company", beginning, end, members), ("entry",).
SEEDS = {
    "arbeitnow": ("endpoint", "https://www.arbeitnow.com/api/jobboard-api", "https://"),
    "ashby": ("company", "https://api.ashbyhq.com/posting-api/job-board/", "", ("company", "board", "key")),
    "beehired": ("company", "https://beehired.com/api/v1/jobs?company=", "", ("company", "board", "key")),
    "freehire": ("endpoint", "https://freehire.me/api/v1/jobs", "https://"),
    "greenhouse": ("company", "https://boards-api.greenhouse.io/v1/boards/", "/jobs", ("board", "company", "key")),
    "himalayas": ("endpoint", "https://himalayas.app/jobs/api", "https://"),
    "icims": ("entry",),
    "jobicy": ("endpoint", "https://jobicy.com/api/v2/remote-jobs", "https://"),
    "jobspresso": ("endpoint", "https://jobspresso.co/api/v1/postings", "https://jobspresso.co/"),
    "jobvite": ("entry",),
    "lever": ("company", "https://api.lever.co/v0/postings/", "?mode=json", ("company", "board", "key")),
    "nomado24": ("endpoint", "https://api.nomado24.de/api/public/v1/jobs", "https://"),
    "recruitcrm": ("company", "https://api.recruitcrm.io/v1/jobs?company=", "", ("company", "key", "board")),
    "remotejobs": ("endpoint", "https://remotejobs.org/api/v1/jobs", "https://"),
    "remoteok": ("path", "https://remoteok.com/api", "https://remoteok.com/"),
    "remotive": ("remotive", "https://remotive.com/api/remote-jobs"),
    "smartrecruiters": ("company", "https://api.smartrecruiters.com/v1/companies/", "/postings", ("company", "board", "key")),
    "themuse": ("path", "https://www.themuse.com/api/public/jobs", "https://www.themuse.com/"),
    "weworkremotely": ("fixed", "https://weworkremotely.com/remote-jobs.json"),
    "workable": ("company", "https://apply.workable.com/api/v1/widget/accounts/", "/jobs", ("company", "board", "key")),
    "workatastartup": ("endpoint", "https://www.workatastartup.com/jobs.json?raw=true", "https://"),
    "workday": ("entry",),
    "workingnomads": ("endpoint", "https://www.workingnomads.com/api/external_jobs", "https://"),
}
#: Parameters that members of the entry set in a board's URL.
PARAMETERS = {"jobicy": (("count", "limit"),), "nomado24": (("page", "page"), ("perPage", "limit"))}
#: Boards whose entries name their own host, which has to be under this one; their failures give no postings.
OWN_HOSTS = {"icims": "icims.com", "jobvite": "jobvite.com", "workday": "myworkdayjobs.com"}
TIMEOUT, TIMEOUTS = 10.0, {"jobspresso": 15.0}
RETRIES, RETRIED = 2, ("jobspresso",)
BACKOFF, LONGEST = 0.5, 8.0
AGENT = "Mozilla/5.0 (compatible; findings-engine)"
SCHEMA = "entry_pos int, entry string, board string, company string, name string, source string, title_terms array<string>, location_terms array<string>, payload string, status string, error string"


def present(*values: object) -> str:
    """The first value that isn't blank, trimmed."""
    return next((t for v in values if (t := str(v if v is not None else "").strip())), "")


def seed(board: str, entry: dict, seeds: dict | None = None) -> str | None:
    """The URL that an entry's board is asked at; None if the entry doesn't say enough. A seed may be a function of the entry."""
    how = (SEEDS if seeds is None else seeds)[board]
    if callable(how):
        return how(entry)
    kind, *rest = how
    if kind == "fixed":
        return rest[0]
    if kind == "entry":
        url = present(entry.get("url"), entry.get("board"))
        return (url if re.match("(?i)https?://", url) else f"https://{url}") if url else None
    if kind == "company":
        start, end, members = rest
        company = present(*(entry.get(m) for m in members))
        if not company:
            return None
        search = present(entry.get("search")) if board == "recruitcrm" else ""
        return f"{start}{_component(company)}{end}" + (f"&search={_component(search)}" if search else "")
    if kind == "remotive":
        search, tag, limit = present(entry.get("search"), entry.get("key")), present(entry.get("tag"), entry.get("board")), str(entry.get("limit") or 50)
        return f"{rest[0]}?" + (urlencode({"search": search, "limit": limit}) if search else f"tag={_component(tag)}&limit={limit}" if tag else f"limit={limit}")
    usual, start = rest
    endpoint = present(entry.get("endpoint"), entry.get("key"))
    if kind == "path":
        return start + endpoint if endpoint else usual
    url = endpoint if endpoint.startswith("http") else start + endpoint if endpoint else usual
    given = [(name, str(entry[m])) for name, m in PARAMETERS.get(board, ()) if entry.get(m)]
    if not given:
        return url
    parts = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in dict(given)]
    return urlunsplit(parts._replace(path=parts.path or "/", query=urlencode(kept + given)))


def _component(text: str) -> str:
    return quote(text, safe="!'()*-._~")


def host_of(url: str) -> str:
    """The host that the URL's identity has, as text."""
    return host_text(url or "") or ""


def under(host: str, suffix: str) -> bool:
    return host == suffix or host.endswith(f".{suffix}")


def board_of(entry: dict, among: tuple[boards.Board, ...] = boards.BOARDS, seeds: dict | None = None) -> str | None:
    """The board that an entry names, or else the first whose host its URL has; None if none."""
    named = str(entry.get("integration") or "").lower()
    if named in (SEEDS if seeds is None else seeds):
        return named
    host = host_of(str(entry.get("url") or ""))
    fits = {"exact": lambda k: host == k, "ending": lambda k: host.endswith(k), "suffix": lambda k: under(host, k)}
    return next((b.name for b in sorted(among, key=lambda b: b.name) if host and any(fits[b.match](k) for k in b.hosts)), None)


def check_allowed(board: str, entry: dict) -> None:
    """Raises GuardError for an entry whose own host isn't its board's."""
    if (suffix := OWN_HOSTS.get(board)) and not under(host := host_of(str(entry.get("url") or "")), suffix):
        raise GuardError(f"{board}: the URL's host has to be under {suffix}, not {host!r}")


# -- transport ------------------------------------------------------------------------------------------
@dataclass
class Response:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


class Redirected(ConnectionError):
    """A redirect, which is never followed: it could lead past the guard."""


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        raise Redirected(f"{req.full_url} redirects to {newurl}")


def request(url: str, timeout: float, headers: dict[str, str], method: str = "GET") -> Response:
    opener = urllib.request.build_opener(_NoRedirect)
    try:
        with opener.open(urllib.request.Request(url, headers=headers, method=method), timeout=timeout) as r:
            return Response(r.status, r.read(), {k.lower(): v for k, v in r.headers.items()})
    except urllib.error.HTTPError as error:
        return Response(error.code, error.read(), {k.lower(): v for k, v in error.headers.items()})


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for, by a number or a date; None if it says nothing."""
    text = (value or "").strip()
    try:
        return max(0.0, float(text))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(text).timestamp() - now)
    except (ValueError, TypeError):
        return None


def backoff(attempt: int, base: float = BACKOFF, longest: float = LONGEST, chance: Callable[[], float] = random.random) -> float:
    return min(longest, base * 2**attempt) * (0.5 + chance() / 2)


def retryable(error: BaseException) -> bool:
    """Timeouts and failures to find or reach a host; never a redirect or what the guard refused."""
    if isinstance(error, (Redirected, GuardError)):
        return False
    reason = getattr(error, "reason", error)
    return isinstance(reason, (TimeoutError, OSError)) and not isinstance(reason, urllib.error.HTTPError) and bool(isinstance(reason, TimeoutError) or re.search("(?i)timed? ?out|getaddrinfo|name resolution|unreachable|not known", str(reason)))


def asked_at(url: str) -> str:
    """The URL as it is asked for: with the very host that the guard looks up."""
    u = weburl.parsed(url)
    return u.written(query=weburl.encoded(u.query, weburl.QUERY)) if u else url


@dataclass
class Transport:
    """Asks for a URL behind the guard; retries on 429 and passing failures if told to."""

    guard: Guard = field(default_factory=Guard)
    request: Callable[..., Response] = request
    wait: Callable[[float], None] = time.sleep
    now: Callable[[], float] = time.time
    agent: str = AGENT

    def fetch(self, url: str, timeout: float = TIMEOUT, retries: int = 0, method: str = "GET") -> Response:
        attempt = 0
        while True:
            try:
                self.guard.check_url(url)
                response = self.request(asked_at(url), timeout, {"user-agent": self.agent}, method)
            except Exception as error:
                if attempt >= retries or not retryable(error):
                    raise
                self.wait(backoff(attempt))
            else:
                if response.status != 429 or attempt >= retries:
                    return response
                asked = retry_after(response.headers.get("retry-after"), self.now())
                self.wait(backoff(attempt) if asked is None else asked)
            attempt += 1

    def json_text(self, url: str, timeout: float = TIMEOUT, retries: int = 0) -> str:
        response = self.fetch(url, timeout, retries)
        if not 200 <= response.status < 300:
            raise ConnectionError(f"http {response.status} for {url}")
        text = response.body.decode("utf-8", "replace")
        json.loads(text)
        return text

    def probe(self, url: str | None) -> str:
        """What asking for the head of a URL shows: ok, http_N, blocked, redirect, unreachable or no-target."""
        if not url:
            return "no-target"
        try:
            status = self.fetch(url, method="HEAD").status
        except GuardError:
            return "blocked"
        except Redirected:
            return "redirect"
        except Exception:  # noqa: BLE001  whatever else goes wrong, nothing was reached
            return "unreachable"
        return "ok" if 200 <= status < 300 else f"http_{status}"


def asked(entry: dict, transport: Transport, among: tuple[boards.Board, ...] = boards.BOARDS, seeds: dict | None = None) -> tuple[str | None, str | None, str, str | None]:
    """(board, document, status, error) of an entry; status is fetched, no_provider or error."""
    board = board_of(entry, among, seeds)
    if board is None:
        return None, None, "no_provider", None
    try:
        check_allowed(board, entry)
        url = seed(board, entry, seeds)
        if url is None:
            return board, None, "fetched", None
        try:
            return board, transport.json_text(url, TIMEOUTS.get(board, TIMEOUT), RETRIES if board in RETRIED else 0), "fetched", None
        except Exception:
            if board not in OWN_HOSTS:
                raise
            return board, None, "fetched", None
    except Exception as error:  # noqa: BLE001  one entry's failure is that entry's result
        return board, None, "error", str(error)


@dataclass
class _Seed:
    """A seed that is a function of a module: sent to executors by the module's place, and loaded there."""

    folder: str
    board: str

    def __call__(self, entry: dict) -> str | None:
        from . import plugins

        return plugins.discover(self.folder).seeds[self.board](entry)


@dataclass
class Entry(InputPartition):
    place: int
    entry: dict


class Reader(DataSourceReader):
    def __init__(self, entries: list[dict], transport: Transport, among: tuple[boards.Board, ...] = boards.BOARDS, seeds: dict | None = None):
        self.entries, self.transport, self.among, self.seeds = entries, transport, among, seeds

    def partitions(self) -> list[Entry]:
        return [Entry(n, e) for n, e in enumerate(self.entries) if e.get("enabled") is not False]

    def read(self, partition: Entry) -> Iterator[tuple]:
        if partition is None:  # no entry is enabled
            return
        e = partition.entry
        name = next((str(e[k]) for k in ("name", "integration", "url") if e.get(k) is not None), "anonymous")
        board, payload, status, error = asked(e, self.transport, self.among, self.seeds)
        filters = e.get("filters") if isinstance(e.get("filters"), dict) else {}
        terms = [[str(t).lower() for t in filters[k]] if isinstance(filters.get(k), list) else [] for k in ("title_blacklist", "location_blacklist")]
        yield (partition.place, name, board, e.get("company"), e.get("name"), str(e.get("source") or board or ""), *terms, payload, status, error)


@dataclass
class Asked(InputPartition):
    """An entry in a round of fetching."""

    place: int
    entry: dict
    round: int


class StreamReader(DataSourceStreamReader):
    """Rounds of fetching as a stream: an offset is a round's number, the whole intervals of ``every`` seconds since the epoch.

    A batch asks every board once, for its last round; rounds that passed while no query ran are not made up for. What an entry's board answers, errors too, is kept
    below ``kept`` under the round and the entry's place, before the batch sees it. The first answer that is kept counts, so a batch that is run again, by
    a retry or after a restart, has the same rows and asks nobody. Rounds that a query has committed are deleted.
    """

    def __init__(self, reader: Reader, kept: str, every: float, now: Callable[[], float] = time.time):
        self.reader, self.kept, self.every, self.now = reader, kept, every, now

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"round": int(self.now() / self.every)}

    def partitions(self, start: dict, end: dict) -> list[Asked]:
        return [Asked(p.place, p.entry, end["round"]) for p in self.reader.partitions()] if end["round"] > start["round"] else []

    def read(self, partition: Asked) -> Iterator[tuple]:
        fs, base = store_of(self.kept)
        place = f"{base}/{partition.round}/{partition.place}.json"
        if fs.get_file_info(place).type != FileType.File:
            rows = json.dumps([list(r) for r in self.reader.read(Entry(partition.place, partition.entry))])
            keep_first(fs, place, rows.encode())
        with fs.open_input_stream(place) as body:
            yield from map(tuple, json.loads(body.read()))

    def commit(self, end: dict) -> None:
        fs, base = store_of(self.kept)
        for info in fs.get_file_info(FileSelector(base, allow_not_found=True)):
            if info.type == FileType.Directory and info.base_name.isdigit() and int(info.base_name) <= end["round"]:
                fs.delete_dir(info.path)


class JobBoards(DataSource):
    """Option ``entries``: the entries as JSON text; ``plugins``: a folder of further boards that every executor sees. A subclass may give another transport.

    As a stream also ``kept``, a folder that all executors share, and ``every``, the seconds of a round (60).
    """

    @classmethod
    def name(cls) -> str:
        return "jobboard"

    def schema(self) -> str:
        return SCHEMA

    def transport(self) -> Transport:
        return Transport()

    def reader(self, schema) -> Reader:
        from . import plugins

        found = plugins.discover(self.options.get("plugins"))
        return Reader(json.loads(self.options.get("entries", "[]")), self.transport(), found.boards, {n: s for n, s in found.seeds.items() if not callable(s)} | {n: _Seed(self.options["plugins"], n) for n, s in found.seeds.items() if callable(s)})


    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.reader(schema), self.options["kept"], float(self.options.get("every", "60")))


def stream(spark: SparkSession, entries: list[dict], kept: str, every: float = 60, source: type[JobBoards] = JobBoards, plugins: str | None = None) -> DataFrame:
    """A stream of rows of SCHEMA: one for each enabled entry and round. One query reads one folder ``kept``."""
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).option("entries", json.dumps(entries)).option("kept", kept).option("every", str(every))
    return (reader.option("plugins", plugins) if plugins else reader).load()


def fetched(spark: SparkSession, entries: list[dict], source: type[JobBoards] = JobBoards, plugins: str | None = None) -> DataFrame:
    """A row of SCHEMA for each enabled entry. Entries beyond the reader's one are fetched in tasks of their own."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("entries", json.dumps(entries))
    return (reader.option("plugins", plugins) if plugins else reader).load()


def postings(documents: DataFrame, among: set[str | None] | None = None, known: tuple[boards.Board, ...] = boards.BOARDS) -> DataFrame:
    """The documents' postings with their entry's place, name, source and terms; only the rules of the boards ``among`` are compiled."""
    held = ("entry_pos", "entry", "source", "title_terms", "location_terms")
    chosen = tuple(b for b in known if among is None or b.name in among) or known[:1]
    return boards.postings(documents.filter("payload is not null"), keep=held, boards=chosen)
