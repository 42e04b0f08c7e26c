from findings_engine.sources import markdown, tsv

HEADER = "| # | date | title | source | company | location | url | risk | confidence | status | report | notes |"


def test_markdown_table(spark, tmp_path):
    rows = ["prose", HEADER, "|---|" + "---|" * 11, r"| 1 | 2026-10-08 | A \| B | s | ACME | | http://x | — | — | Queued | — | |", "", "| 2 | short | row |"]
    (tmp_path / "t.md").write_text("\n".join(rows))
    found = sorted(markdown.read(spark, str(tmp_path / "t.md")).collect(), key=lambda r: r.pos)
    assert [(r.num, r.title, r.company, r.malformed) for r in found] == [("1", "A | B", "ACME", False), (None, None, None, True)]
    line = markdown.read(spark, str(tmp_path / "t.md")).filter("not malformed").select(markdown.rendered()).first()[0]
    assert r"| A \| B |" in line


def test_additions(spark, tmp_path):
    labels = "url num date title source risk confidence status report".split()
    (tmp_path / "1.tsv").write_text("\t".join(labels) + "\n" + "\t".join(["http://x", "1", "2026-01-01", "T", "s", "Low", "High", "Queued", "-"]) + "\n")
    (tmp_path / "2.tsv").write_text("num\tnum\nx\n")
    (tmp_path / "3.txt").write_text("ignored")
    good, bad = sorted(tsv.read(spark, str(tmp_path)).collect(), key=lambda r: r.path)
    assert (good.url, good.num, good.company, good.errors) == ("http://x", "1", None, [])
    assert bad.num is None and "repeated label num" in bad.errors and "missing label url" in bad.errors
