"""The secret scan against a version that goes through the text character by character."""

import collections
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from findings_engine.llm import secrets_scan

SCHEMA = "doc_id long, text string"


def slow_base(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def fits(c):
    return re.search("[0-9]", c) and re.search("[A-Za-z]", c)


def slow_runs(c):
    least = secrets_scan.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", c) else secrets_scan.TOKEN_BITS
    held, runs = collections.Counter(c[:20]), []
    for i in range(len(c) - 19):
        if i:
            held[c[i + 19]] += 1
            held[c[i - 1]] -= 1
        if -sum(n / 20 * math.log2(n / 20) for n in held.values() if n) >= least:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + 20
            else:
                runs.append([i, i + 20])
    return runs


def slow_scan(t):
    base, added, covered = slow_base(t), [], bytearray(len(t))
    for s, _, e in base:
        covered[s:e] = b"\1" * (e - s)
    for m in re.finditer(secrets_scan.CANDIDATE, t):
        pieces, now = [], []
        for i in range(m.start(), m.end() + 1):
            if i < m.end() and not covered[i]:
                now.append(i)
                continue
            pieces += [now] * (len(now) >= 20)
            now = []
        for kept in pieces:
            for p in secrets_scan.ALLOWED:
                if not p.startswith("^"):
                    out = {i for h in re.finditer(p, "".join(t[i] for i in kept)) for i in range(*h.span())}
                    kept = [x for j, x in enumerate(kept) if j not in out]
            c = "".join(t[i] for i in kept)
            if fits(c) and not any(re.search(p, c) for p in secrets_scan.ALLOWED if p.startswith("^")):
                added += [(kept[a], 3, kept[b - 1] + 1) for a, b in slow_runs(c)]
    return base, sorted(base + added)


def slow_redacted(t, found):
    out, at = "", 0
    for s, _, e in found:
        out += "" if s < at else t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + t[at:]


def same(spark, texts, partitions=4):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(partitions)
    clean = secrets_scan.redacted(F.coalesce("text", F.lit("")), F.col("found")).alias("clean")
    rows = {r.doc_id: r for r in secrets_scan.scan(df).select("doc_id", "base", "found", clean).collect()}
    for i, t in enumerate(x or "" for x in texts):
        base, found = slow_scan(t)
        assert [tuple(s) for s in rows[i].base] == base, t[:200]
        assert [tuple(s) for s in rows[i].found] == found, t[:200]
        assert rows[i].clean == slow_redacted(t, found), t[:200]
    return rows


def test_random_texts(spark):
    r = random.Random(3)
    some = lambda low, high, signs=secrets_scan.ALPHABET: "".join(r.choice(signs) for _ in range(r.randint(low, high)))
    makers = [lambda: "password: " + some(3, 20), lambda: "AKIA" + some(5, 20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), lambda: some(20, 60, "0123456789abcdef"), lambda: some(10, 80), lambda: "x" * r.randint(1, 40)]
    makers += [lambda: "12345678", lambda: "2024-01-02", lambda: "example", lambda: " ", lambda: "\n", lambda: "é𝒳", lambda: "/", lambda: "aB1-" * r.randint(1, 12), lambda: some(30, 30, "ab1"), lambda: "token='"]
    texts = ["".join(r.choice(makers)() for _ in range(r.randint(0, 14))) for _ in range(500)]
    rows = same(spark, [*texts, "", None, some(4200, 4200) + "é" + "x" * 5000 + "1" + some(9000, 9000) + " " + "a1b2" * 3000])
    assert sum(len(x.found) for x in rows.values()) > 500


def test_long_texts(spark):
    """Linear but for a logarithm: each ends within seconds."""
    r = random.Random(4)
    some = lambda n, signs=secrets_scan.ALPHABET: "".join(r.choice(signs) for _ in range(n))
    texts = [" ".join(f"password=hunter2x{i}" for i in range(50_000)), some(200_000), "".join(some(22) + "a" * 22 for _ in range(5000)), "x" * 2_000_000 + "1", "/".join(f"AKIA{some(16, 'ABCDEFGH1')}/{some(25)}" for _ in range(5000)), "a-" * 100_000 + "1"]
    began = time.perf_counter()
    same(spark, texts)
    assert time.perf_counter() - began < 90


@pytest.mark.parametrize("signs", ["0123456789abcdef", "abcdefgh12", secrets_scan.ALPHABET])
def test_windows_over_chunks(spark, monkeypatch, signs):
    """Runs of windows are the same however a candidate is cut into chunks."""
    r = random.Random(signs)
    c = "".join(r.choice(signs if i // 30 % 2 else signs[:6]) for i in range(400))
    for chunk in (3, 20, 64, 4096):
        monkeypatch.setattr(secrets_scan, "CHUNK", chunk)
        got = spark.range(1).select(secrets_scan.entropy_runs(F.lit(c)), secrets_scan.entropy_runs(F.lit("short1"))).first()
        assert [list(x) for x in got[0]] == slow_runs(c) and got[1] == []


def test_clashing_names(spark):
    """Columns named like the results go unless others are named; no other column is touched."""
    df = spark.createDataFrame([(1, "password=hunter2hunter2", "mine", 5)], "doc_id long, text string, base string, runs int")
    assert secrets_scan.scan(df).columns == ["doc_id", "text", "base", "runs", "found"]
    r = secrets_scan.scan(df, base="a", found="b").first()
    assert (r.base, r.runs, [tuple(x) for x in r.b]) == ("mine", 5, [(0, 0, 23)])
    assert secrets_scan.scan(df.limit(0)).count() == 0
