"""Lines of long files, many terms and tables of ranges against plain versions."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from findings_engine.operators import identity, ranges, scan, terms
from findings_engine.sources import listings
from findings_engine.sources.numbered import numbered


@pytest.mark.parametrize("size", ["1k", "7k", "64m"])
def test_lines_are_numbered_through_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    lines = ["".join(rng.choice("ab é\t日") for _ in range(rng.choice([0, 0, 3, 40, 900]))) + rng.choice(["", "\r", " "]) for _ in range(1500)] + ["end"]
    for name, body in (("a.txt", "\n".join(lines)), ("b.txt", "\n".join(lines[:7]) + "\n"), ("empty.txt", ""), ("blank.txt", "\n \n\t\n")):
        (tmp_path / name).write_bytes(body.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for blank in (False, True):
            found = numbered(spark, str(tmp_path), blank)
            got = {}
            for r in found.collect():
                got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.pos, r.line))
            for name, own in (("a.txt", lines), ("b.txt", lines[:7])):
                want = [x[:-1] if x.endswith("\r") else x for x in own]
                want = [x for x in want if blank or x.strip(" \t\n\x0b\f\r")]
                assert sorted(got[name]) == list(enumerate(want))
            assert "empty.txt" not in got and len(got.get("blank.txt", [])) == (3 if blank else 0)
        if size == "1k":
            assert found.rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.read.text(str(tmp_path / "a.txt"), wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n", -1), lambda x: F.rlike(x, F.lit(r"\S")))).alias("pos", "line"))
    assert sorted(map(tuple, listings.lines(spark, str(tmp_path / "a.txt")).collect())) == sorted(map(tuple, whole.collect()))
    assert listings.lines(spark, str(tmp_path / "none.txt")) is None


def test_terms_equal_contains(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAB éÉ日") for _ in range(rng.randint(1, 4)))
    given = sorted({word() for _ in range(80)})
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(500, None), (501, ""), (502, "ab" * 20_000), (503, "same"), (503, "same")]
    df = spark.createDataFrame(texts, "id long, title string").repartition(3)
    table = spark.createDataFrame([(t,) for t in [*given, given[0], None]], "term string")
    for size in (terms.PART, 20):
        found = terms.found_terms(df, F.col("title"), table, size=size).collect()
        assert len(found) == len(texts)
        for r in found:
            assert r.found == sorted({t.lower() for t in given if r.title is not None and t.lower() in r.title.lower()})
    assert all(r.found == [""] for r in terms.found_terms(df.filter("id > 502"), F.col("title"), spark.createDataFrame([("",), ("nowhere",)], "term string")).collect())
    assert terms.found_terms(df.limit(0), F.col("title"), table).count() == 0
    own = df.withColumn("own", F.array(*(F.lit(t) for t in given[:3])).cast("array<string>")).withColumn("own", F.when(F.col("id") % 5 == 0, F.array(F.lit(""))).when(F.col("id") % 5 == 1, F.array().cast("array<string>")).otherwise(F.col("own")))
    rows = terms.held_by_own(own, F.col("title"), "own").withColumn("plain", scan.contains_any(F.col("title"), F.col("own"))).filter("title is not null and title not like '% '").collect()
    assert [r for r in rows if r.holds != r.plain and "  " not in r.title and r.title == r.title.strip()] == [] and {r.holds for r in rows} == {True, False}


def test_many_terms_cost_little(spark):
    """50,000 terms take about as long as 500."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(50_000)]
    df = spark.range(0, 400, 1, 4).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: F.hex(F.xxhash64("id", k)))).alias("title")).cache()
    seconds = []
    for n in (500, 50_000):
        table = spark.createDataFrame([(t,) for t in names[:n]], "term string")
        terms.found_terms(df, F.col("title"), table).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        terms.found_terms(df, F.col("title"), table).write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    df.unpersist()
    assert seconds[1] < 10 * seconds[0] + 5


def test_addresses_in_ranges(spark):
    rng = random.Random(5)
    v4 = lambda: str(ipaddress.IPv4Address(rng.choice([rng.getrandbits(32), 0x0A000000 + rng.getrandbits(9)])))
    v6 = lambda: str(ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), (0x20010DB8 << 96) + rng.getrandbits(10), rng.getrandbits(9)])))
    given = []
    for k in range(150):
        one, two = (v4(), v4()) if k % 2 else (v6(), v6())
        given.append((k, one, two))
    given += [(900, "0.0.0.0", "255.255.255.255"), (901, "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), (902, "10.0.0.7", "10.0.0.7"), (903, "x", "10.0.0.1"), (904, None, None), (905, "10.0.0.1", "::5"), (906, "10.0.0.9", "10.0.0.1"), (907, "::ffff:10.0.0.0", "10.0.0.63")]
    asked = [v4() for _ in range(150)] + [v6() for _ in range(150)] + ["::ffff:10.0.0.7", " 10.0.0.7 ", "FE80::1%eth0", "no", "", None, "1.2.3", "::1", "::1", "255.255.255.255", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    want = set()
    for a in set(asked):
        for k, one, two in given:
            x, y, z = ranges.parsed(a), ranges.parsed(one), ranges.parsed(two)
            if x and y and z and x[0] == y[0] == z[0] and y[1] <= x[1] <= z[1]:
                want.add((a, k))
    df, table = spark.createDataFrame([(a,) for a in asked], "a string"), spark.createDataFrame(given, "k long, one string, two string")
    found = ranges.lying_in(df, "a", table, "k", "one", "two")
    assert len(rows := found.collect()) == len({(r.address, r.id) for r in rows}) and {(r.address, r.id) for r in rows} == want
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "Cartesian" not in plan
    best = {}
    for r in rows:
        best[r.address] = min(best.get(r.address, (99, 0)), (-r.bits, r.id))
    assert {r.address: r.id for r in ranges.most_specific(df, "a", table, "k", "one", "two").collect()} == {a: x[1] for a, x in best.items()}
    assert ranges.lying_in(df, "a", table.limit(0), "k", "one", "two").count() == 0


def test_ranges_that_hold_all_addresses_are_summed_up_first(spark):
    """20,000 ranges around 20,000 addresses: 400 million pairs, which are never made."""
    df = spark.range(20_000).select(F.format_string("10.0.%d.%d", F.floor(F.col("id") / 256), F.col("id") % 256).alias("a"))
    table = spark.range(20_000).select("id", F.lit("10.0.0.0").alias("one"), F.format_string("10.0.255.%d", F.col("id") % 256).alias("two")).union(spark.createDataFrame([(-1, "10.0.0.3", "10.0.0.4"), (None, "10.0.0.3", "10.0.0.3")], "id long, one string, two string"))
    began = time.perf_counter()
    got = {r.address: (r.n, r.first, r.last) for r in ranges.summed_up(df, "a", table, "id", "one", "two").collect()}
    assert time.perf_counter() - began < 60 and len(got) == 20_000
    assert (got["10.0.0.3"], got["10.0.0.4"], got["10.0.0.5"]) == ((20_002, -1, 19_999), (20_001, -1, 19_999), (20_000, 0, 19_999))
    assert ranges.summed_up(df, "a", table.limit(0), "id", "one", "two").count() == 0


def test_a_range_is_cut_into_the_fewest_prefixes():
    for width, first, last in ((32, 0, 2**32 - 1), (32, 1, 2**32 - 2), (128, 1, 2**128 - 2), (32, 5, 5), (32, 6, 3), (4, 3, 12)):
        parts = list(ranges.cut(first, last, width))
        at = first
        for bits, number in parts:
            assert number == at and number % (1 << (width - bits)) == 0
            at += 1 << (width - bits)
        assert at == max(first, last + 1) and len(parts) <= 2 * width - 2 + (width == 4)


def test_a_hundred_thousand_ranges(spark):
    table = spark.range(100_000).select("id", F.format_string("10.%d.%d.0", F.floor(F.col("id") / 256) % 256, F.col("id") % 256).alias("one"), F.format_string("10.%d.%d.99", F.floor(F.col("id") / 256) % 256, F.col("id") % 256).alias("two"))
    df = spark.range(20_000).select(F.format_string("10.%d.%d.%d", F.col("id") % 200, F.col("id") % 256, F.col("id") % 200).alias("a"))
    own = df.distinct().filter(F.split("a", r"\.")[3].cast("int") < 100)
    want = own.select("a", F.split("a", r"\.").alias("x")).select("a", (F.col("x")[1].cast("long") * 256 + F.col("x")[2].cast("long")).alias("n"))
    found = ranges.lying_in(df, "a", table, "id", "one", "two")
    both = found.join(want, found["address"] == want["a"], "full_outer")
    assert both.filter(F.pmod(F.col("id"), F.lit(65_536)) != F.col("n")).count() == 0 and both.filter("a is null or address is null").count() == 0


@pytest.mark.parametrize("order", [["a"], ["name", "a"], ["both", "name"], ["same"], ["maybe", "a"]])
def test_numbers_in_any_order(spark, order):
    """Dense numbers over texts, structs, nulls and equal keys, in many ranges."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 50), rng.choice(["x", "y", "é", "Z", None]), (rng.randint(0, 3), rng.choice("pq")), 1, rng.choice([None, 2.5, -1.0]), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "a int, name string, both struct<k: int, t: string>, same int, maybe double, id long").repartition(4)
    got = sorted(identity.numbered(df, order, 5, ranges=16).collect(), key=lambda r: r.num)
    assert [r.num for r in got] == list(range(5, 3005)) and sorted(r.id for r in got) == list(range(3000))

    def place(r):
        cells = [r[c] for c in order]
        return [(0, 0) if c is None else (1, tuple(c) if isinstance(c, tuple) else c.encode() if isinstance(c, str) else c) for c in cells]

    assert [place(r) for r in got] == sorted(place(r) for r in got)
    assert identity.numbered(df.limit(0), order, 5).count() == 0
    # one key of all rows is many ranges too
    if order == ["same"]:
        plan = identity.numbered(df, order, 5, ranges=16)
        assert len({r.num // 100 for r in plan.collect()}) > 20
