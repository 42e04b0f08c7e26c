import json

import pytest

from findings_engine.sources import boards

COLUMNS = "board string, payload string, company string, name string"


def found(spark, *rows, among=None):
    """Only the named boards' rules are compiled, but for tests of all."""
    among = among or tuple(b for b in boards.BOARDS if b.name in {r[0].lower() for r in rows})
    return boards.postings(spark.createDataFrame([(b, p if isinstance(p, str) else json.dumps(p), c, n) for b, p, c, n in rows], COLUMNS), boards=among).collect()


def by_hand(job, ctx, text, trim):
    """The rules, read from the documents' Python values."""

    def member(path):
        at = job
        for step in path.replace("[0]", ".0").split("."):
            at = (at[0] if at else None) if step == "0" and isinstance(at, list) else at.get(step) if isinstance(at, dict) else None
        return None if isinstance(at, dict) or at is None else ",".join(at) if isinstance(at, list) else str(at)

    for alternative in text.split("|"):
        got = None
        if alternative == "ctx":
            got = ctx
        elif alternative.startswith("https://"):
            base, slug = alternative.rstrip("}").split("{")
            got = base + member(slug) if member(slug) else None
        elif "(" not in alternative:
            got = next((m for a in alternative.split("??") if (m := member(a)) is not None), None)
        if got is not None and (not trim or got.strip()):
            return got.strip() if trim else got
    return ""


@pytest.mark.parametrize("board", boards.BOARDS, ids=lambda b: b.name)
def test_every_board(spark, board):
    """Each member that a rule names, filled in turn; the rules evaluated by hand give the same postings."""
    paths = sorted({p for rule in board.fields.values() for alternative in rule.split("|") if "(" not in alternative and "://" not in alternative for p in alternative.split("??")} - {"ctx"})
    jobs = []
    for n in range(len(paths) + 1):
        job: dict = {}
        for k, path in enumerate(paths[n:]):
            top, _, rest = path.partition(".")
            value = f" {path} {k} "
            if top.endswith("[0]"):
                job[top[:-3]] = [{rest: value}] if rest else [value]
            elif rest:
                job[top] = {**(job[top] if isinstance(job.get(top), dict) else {}), rest: value}
            else:
                job.setdefault(top, value)
        for need in board.needs[:1]:
            job[need] = f"{need} {n}"
        jobs.append(job)
    document = jobs if board.bare and not board.records else {board.records[0]: jobs}
    rows = found(spark, (board.name, document, " ACME ", "Name"))
    want = [tuple(by_hand(j, "ACME", board.fields[f], f != "description") for f in boards.FIELDS) for j in jobs]
    skip = [k for k, f in enumerate(boards.FIELDS) if "(" in board.fields[f]]
    cut = lambda row: tuple(x for k, x in enumerate(row) if k not in skip)
    assert [cut(tuple(r)[2:]) for r in sorted(rows, key=lambda r: r.pos)] == list(map(cut, want))
    assert len(found(spark, (board.name, jobs, "", ""))) == (len(jobs) if board.bare else 0)


def test_special_rules(spark):
    job = {"slug": "x-1", "locationRestrictions": ["A", "B"], "pubDate": 1700000000, "title": " ", "role_title": "R"}
    rows = found(spark, ("Himalayas", {"jobs": [job, job | {"pubDate": 1700000000123, "locationRestrictions": [], "location": "", "locations": [{"text": "L"}]}, {"pubDate": "soon", "posted_at": "p"}]}, None, " N "))
    assert [(r.title, r.url, r.company, r.location, r.posted_at) for r in sorted(rows, key=lambda r: r.pos)] == [
        ("R", "https://himalayas.app/jobs/x-1", "N", "A, B", "2023-11-14T22:13:20.000Z"),
        ("R", "https://himalayas.app/jobs/x-1", "N", "L", "2023-11-14T22:13:20.123Z"),
        ("", "", "N", "", "p"),
    ]


def test_records(spark):
    bad = [("lever", "not json", "", ""), ("lever", None, "", ""), ("nobody", [{"title": "x"}], "", ""), ("ashby", [{"title": "x"}], "", ""), ("ashby", {"jobs": {"title": "x"}}, "", ""), (None, [], "", "")]
    assert boards.postings(spark.createDataFrame([(b, p if p is None or isinstance(p, str) else json.dumps(p), c, n) for b, p, c, n in bad], COLUMNS)).count() == 0
    assert [r.title for r in found(spark, ("arbeitnow", {"data": None, "jobs": [{"title": "x"}]}, "", ""))] == ["x"]
    assert [r.external_id for r in found(spark, ("remoteok", [{"legal": "text"}, {"id": 7, "url": "u"}, {"id": 8, "url": ""}], "", ""))] == ["7"]
    assert [r.title for r in found(spark, ("workatastartup", [{"name": "n"}, {"role_title": "r"}, {"title": "t"}], "", ""))] == ["r", "t"]


def test_routes(spark):
    urls = ["https://API.lever.co/v0", "https://x.icims.com/a", "https://noticims.com/a", "https://myarbeitnow.com/", "https://lever.co", "api.ashbyhq.com/x", "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(boards.routed(df.u)).collect()] == ["lever", "icims", None, "arbeitnow", None, "ashby", None, None]


# A document of each board as its interface returns it, and the posting it stands for: title, url, company, location, posted_at, external_id.
LITERAL = {
    "arbeitnow": ({"data": [{"slug": "s-1", "company_name": "Co", "title": "Dev", "url": "u", "location": "Berlin", "created_at": 1700000000}]}, ("Dev", "u", "Co", "Berlin", "1700000000", "s-1")),
    "ashby": ({"jobs": [{"id": "i", "title": "Dev", "jobUrl": "u", "location": "", "secondaryLocation": "Rome", "publishedAt": "p"}]}, ("Dev", "u", "Ctx", "Rome", "p", "u")),
    "beehired": ({"results": [{"id": 3, "name": "Dev", "apply_url": "u", "company": {"name": "Co"}, "location_name": "L", "published_at": "p"}]}, ("Dev", "u", "Co", "L", "p", "3")),
    "freehire": ({"jobs": [{"jobTitle": "Dev", "url": "u", "company": "Co", "location": "L", "posted_at": "p", "public_slug": "s"}]}, ("Dev", "u", "Co", "L", "p", "s")),
    "greenhouse": ({"jobs": [{"id": 7, "title": "Dev", "absolute_url": "u", "location": {"name": "L"}, "updated_at": "p"}]}, ("Dev", "u", "Ctx", "L", "p", "7")),
    "himalayas": ({"jobs": [{"title": "Dev", "applicationLink": "u", "companyName": "Co", "locationRestrictions": ["A", "B"], "pubDate": 1700000000, "guid": "g"}]}, ("Dev", "u", "Co", "A, B", "2023-11-14T22:13:20.000Z", "g")),
    "icims": ({"searchedJobs": [{"jobTitle": "Dev", "jobUri": "u", "organizationName": "Co", "jobLocation": "L", "updatedOn": "p", "jobId": 5}]}, ("Dev", "u", "Co", "L", "p", "5")),
    "jobicy": ({"jobs": [{"id": 9, "jobTitle": "Dev", "jobSlug": "dev-1", "companyName": "Co", "jobGeo": "L", "pubDate": "p"}]}, ("Dev", "https://jobicy.com/jobs/dev-1", "Co", "L", "p", "9")),
    "jobspresso": ([{"id": 1, "position": "Dev", "posting_url": "u", "company": "Co", "location": "L", "date": "p"}], ("Dev", "u", "Co", "L", "p", "1")),
    "jobvite": ({"requisitions": [{"name": "Dev", "requisitionUrl": "u", "companyName": "Co", "city": "L", "posted_at": "p", "reqId": "r"}]}, ("Dev", "u", "Co", "L", "p", "r")),
    "lever": ([{"id": "i", "text": "Dev", "hostedUrl": "u", "categories": {"location": "L"}, "createdAt": 1700000000123}], ("Dev", "u", "Ctx", "L", "1700000000123", "i")),
    "nomado24": ({"data": [{"jobTitle": "Dev", "url": "u", "companyName": "Co", "location": "L", "publishedAt": "p", "id": 4}]}, ("Dev", "u", "Co", "L", "p", "4")),
    "recruitcrm": ({"items": [{"name": "Dev", "public_url": "u", "company_name": "Co", "city": "L", "updated_at": "p", "url": "", "id": 2}]}, ("Dev", "u", "Co", "L", "p", "2")),
    "remotejobs": ({"jobs": [{"name": "Dev", "apply_url": "u", "company": {"name": "Co"}, "city": "L", "pub_date": "p", "slug": "s"}]}, ("Dev", "u", "Co", "L", "p", "s")),
    "remoteok": ([{"legal": "x"}, {"id": "1", "position": "Dev", "url": "u", "company": "Co", "location": "L", "date": "p"}], ("Dev", "u", "Co", "L", "p", "1")),
    "remotive": ({"jobs": [{"id": 1, "title": "Dev", "url": "u", "company_name": "Co", "candidate_required_location": "L", "publication_date": "p"}]}, ("Dev", "u", "Co", "L", "p", "1")),
    "smartrecruiters": ({"content": [{"id": "1", "name": "Dev", "ref": "u", "company": {"name": "Co"}, "location": {"country": "de"}, "releasedDate": "p"}]}, ("Dev", "u", "Co", "de", "p", "1")),
    "themuse": ({"results": [{"id": 1, "name": "Dev", "refs": {"landing_page": "u"}, "company": {"name": "Co"}, "locations": [{"name": "L"}], "publication_date": "x", "posted_at": "p"}]}, ("Dev", "u", "Co", "L", "p", "1")),
    "weworkremotely": ([{"id": 1, "title": "Dev", "url": "u", "company": {"name": "Co"}, "location": {"city": "L"}, "updated": "p"}], ("Dev", "u", "Co", "L", "p", "1")),
    "workable": ({"results": [{"title": "Dev", "shortcode": "AB1", "location": {"city": "L"}, "created_at": "p"}]}, ("Dev", "https://apply.workable.com/j/AB1", "Ctx", "L", "p", "AB1")),
    "workatastartup": ([{"id": 1, "role_title": "Dev", "job_url": "u", "company_name": "Co", "locations": ["L", "M"], "created_at": "p"}], ("Dev", "u", "Co", "L", "p", "1")),
    "workday": ({"jobPostings": [{"text": "Dev", "externalPath": "/u", "organization": "Co", "cities": "L", "dateCreated": "p"}]}, ("Dev", "/u", "Co", "L", "p", "/u")),
    "workingnomads": ({"jobs": [{"id": 1, "name": "Dev", "link": "u", "company": "Co", "category": "L", "pub_date": "p"}]}, ("Dev", "u", "Co", "L", "p", "1")),
}


@pytest.mark.parametrize("name", sorted(LITERAL))
def test_literal_documents(spark, name):
    document, want = LITERAL[name]
    (got,) = found(spark, (name, document, "Ctx", "Name"))
    assert (got.title, got.url, got.company, got.location, got.posted_at, got.external_id) == want


def test_every_board_has_a_literal_document():
    assert set(LITERAL) == {b.name for b in boards.BOARDS}
