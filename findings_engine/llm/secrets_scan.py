"""Operator 6: secrets in whole texts, by patterns and by the entropy of character windows. DataFrame operations only.

Base kinds are patterns. A pattern's matches and the pieces between them, from two passes of one regular
expression, give the matches' places in code points. The method adds spans of kind ``entropy``: candidates are
long runs of token characters with a letter and a digit. The base kinds' spans are cut out of the candidates first, and
each piece that is left of WINDOW characters or more stands for itself. A pattern of the allow list that begins with ^
rules out a whole piece; what the others match, one after the other, is passed over as if the characters around it were
adjacent. A window of WINDOW characters slides over the rest: one character comes in and one goes out, its two counts
(five bits each, twelve to a long) change by one, and with them the sum of n log n (in whole numbers of 2**-40) that the
Shannon entropy follows from. The windows at or above the threshold of the piece's character class (hexadecimal digits,
or all) give a span for each run of them that overlap or touch.

The cost of a text grows with its length times a logarithm, however many matches or however long a candidate it has:
places are running sums in log n passes, spans are cut by one sort of their ends, windows run in chunks, and strings are
cut out of blocks.

Null texts are empty and have no spans. Repeated rows give repeated rows, an empty table none. Only the named
column is read; columns of a table that bear the names of the results are replaced, unless other names are given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = "AKIA[A-Z0-9]{12,}"  # of 16 characters or more
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy, in bits, of a window over 16 and over 64 characters.
HEX_BITS, TOKEN_BITS = 3.0, 3.7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that are no secrets: UUIDs, placeholders, runs of one character or of the alphabet, plain counters, dates.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|lorem",
    r"(.)\1{7}",
    r"(?i)abcdefgh|12345678|01234567|qwertyui",
    r"^[A-Za-z][A-Za-z+/_=-]*[0-9]{1,4}$",
    r"(?:19|20)[0-9]{2}[-/_][0-9]{2}[-/_][0-9]{2}",
)
#: Windows of a chunk, and code points of a block of text.
CHUNK, BLOCK = 4096, 4096
#: Counts of five bits in a long; a whole in units of the sum of n log2 n.
IN_A_LONG, UNIT = 12, 2**40
_SPANS = "array<struct<s:int,k:int,e:int>>"
_RUNS = "array<struct<first:int,last:int>>"
_DISTANCES = [1 << j for j in range(31)]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often and however deep in functions it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def running(values: Column, merge=lambda earlier, later: earlier + later) -> Column:
    """Running sums of an array that is worked out already, in log n passes (appending would copy it for each item)."""
    passes = F.filter(F.array(*map(F.lit, _DISTANCES)), lambda d: d < F.size(values))
    step = lambda acc, d: F.transform(acc, lambda v, i: F.when(i >= d, merge(F.get(acc, i - d), v)).otherwise(v))
    return F.aggregate(passes, values, step)


def _ends(found: Column, between: Column) -> Column:
    """Where each match ends."""
    return let(F.transform(found, lambda f, i: F.length(F.get(between, i)) + F.length(f)), lambda lengths: running(lengths))


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """The pattern's matches as (start, kind, end), those whose text ``keep`` is true for."""

    def placed(found: Column, ends: Column) -> Column:
        every = F.transform(found, lambda f, i: F.struct((F.get(ends, i) - F.length(f)).alias("s"), F.lit(kind).alias("k"), F.get(ends, i).alias("e")))
        return (F.filter(every, lambda x, i: keep(F.get(found, i))) if keep else every).cast(_SPANS)

    def places(found: Column) -> Column:
        walked = let(F.split(text, pattern, -1), lambda between: let(_ends(found, between), lambda ends: placed(found, ends)))
        return F.when(F.size(found) == 0, _none(_SPANS)).otherwise(walked)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def base_spans(text: Column) -> Column:
    """Sorted (start, kind, end) of the three base kinds."""
    secret = lambda f: F.length(F.regexp_extract(f, ASSIGN, 2)) >= ASSIGN_LEAST
    return F.sort_array(F.concat(spans(text, ASSIGN, 0, secret), spans(text, ACCESS, 1), spans(text, HEX, 2)))


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, s: Column, e: Column) -> Column:
    """The code points from s to e of the text that the blocks make up, without walking the text from its start."""
    first, last = F.floor(s / BLOCK).cast("int"), F.floor((e - 1) / BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), s % BLOCK + 1, e - s)
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.when(last > first, F.concat(middle, F.substring(F.get(blocks, last), F.lit(1), (e - 1) % BLOCK + 1))).otherwise("")
    return F.when(e > s, F.concat(head, tail)).otherwise("")


def outside(runs: Column, base: Column, least: int = WINDOW) -> Column:
    """The pieces (s, e) of at least so many characters of the disjoint spans ``runs`` that no span of ``base`` covers."""
    inside = 16  # more than the base kinds, whose spans can overlap
    end = lambda at, by: F.struct(at.alias("at"), F.lit(by).alias("by"))
    events = F.concat(F.transform(runs, lambda x: end(x["s"], inside)), F.transform(runs, lambda x: end(x["e"], -inside)), F.transform(base, lambda x: end(x["s"], 1)), F.transform(base, lambda x: end(x["e"], -1)))

    def pieces(events: Column) -> Column:
        level = let(F.transform(events, lambda x: x["by"]), lambda by: running(by))
        piece = lambda depth: F.transform(events, lambda x, i: F.struct(x["at"].alias("s"), F.get(events, i + 1)["at"].alias("e"), F.get(depth, i).alias("depth")))
        return F.filter(let(level, piece), lambda x: (x["depth"] == inside) & (x["e"] - x["s"] >= least))

    return let(F.sort_array(events), pieces)


def squeezed(pattern: str):
    """Of (c, kept) the string without what the pattern matches, and the places that are left of ``kept``."""
    return lambda x: _squeezed(x, pattern)


def _squeezed(x: Column, pattern: str) -> Column:
    def without(found: Column) -> Column:
        kept = lambda gaps, ends: F.flatten(F.transform(gaps, lambda g, i: F.slice(x["kept"], F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, F.length(g))))
        rest = let(F.split(x["c"], pattern, -1), lambda gaps: let(_ends(found, gaps), lambda ends: F.struct(F.array_join(gaps, "").alias("c"), kept(gaps, ends).alias("kept"))))
        return F.when(F.size(found) == 0, F.struct(x["c"].alias("c"), x["kept"].alias("kept"))).otherwise(rest)

    return let(F.regexp_extract_all(x["c"], F.lit(pattern), F.lit(0)), without)


def _chunk_runs(codes: Column, most: Column) -> Column:
    """Runs of windows whose sum of n log n is ``most`` or less, by incremental counts."""
    size = math.ceil((len(ALPHABET) + 1) / IN_A_LONG)
    unit = [round(n * math.log2(n) * UNIT) if n else 0 for n in range(WINDOW + 2)]
    gain = F.array(*(F.lit(unit[n + 1] - unit[n]).cast("long") for n in range(WINDOW + 1)))
    state = f"struct<counts:array<bigint>,sum:bigint,at:int,first:int,last:int,runs:{_RUNS}>"
    start = F.struct(F.array(*(F.lit(0) for _ in range(size))).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), _none(_RUNS).alias("runs")).cast(state)
    place = lambda code, name: (F.floor(code / IN_A_LONG).cast("int").alias(f"{name}_at"), (code % IN_A_LONG * 5).cast("int").alias(f"{name}_bit"))
    moves = F.transform(codes, lambda x, i: F.struct(x.alias("new"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(0).alias("old")))
    moves = F.transform(moves, lambda m: F.struct(m["new"].alias("new"), m["old"].alias("old"), *place(m["new"], "new"), *place(m["old"], "old")))
    shifted = lambda by, n=1: F.call_function("shiftleft", F.lit(n).cast("long"), by)
    count = lambda counts, at, bit: F.call_function("shiftright", F.get(counts, at), bit).bitwiseAND(31).cast("int")
    one = lambda first, last: F.array(F.struct(first.alias("first"), last.alias("last"))).cast(_RUNS)

    def step(acc: Column, m: Column) -> Column:
        same, leaves = m["new"] == m["old"], m["old"] > 0  # place 0 counts nothing
        change = F.get(gain, count(acc["counts"], m["new_at"], m["new_bit"])) - F.when(leaves, F.get(gain, count(acc["counts"], m["old_at"], m["old_bit"]) - 1)).otherwise(0)
        total = acc["sum"] + F.when(same, 0).otherwise(change)
        moved = F.transform(acc["counts"], lambda v, k: v + F.when(k == m["new_at"], shifted(m["new_bit"])).otherwise(0) - F.when(leaves & (k == m["old_at"]), shifted(m["old_bit"])).otherwise(0))
        counted = F.struct(F.when(same, acc["counts"]).otherwise(moved).alias("counts"), total.alias("sum"))
        return let(counted, lambda c: told(acc, c))

    def told(acc: Column, c: Column) -> Column:
        begins = acc["at"] - (WINDOW - 1)
        hit = (begins >= 0) & (c["sum"] <= most)
        joins = (acc["first"] >= 0) & (begins <= acc["last"])
        closed = F.when(hit & ~joins & (acc["first"] >= 0), F.concat(acc["runs"], one(acc["first"], acc["last"]))).otherwise(acc["runs"])
        first = F.when(hit & ~joins, begins).otherwise(acc["first"])
        last = F.when(hit, acc["at"] + 1).otherwise(acc["last"])
        return F.struct(c["counts"].alias("counts"), c["sum"].alias("sum"), (acc["at"] + 1).alias("at"), first.alias("first"), last.alias("last"), closed.alias("runs")).cast(state)

    return F.aggregate(moves, start, step, lambda acc: F.when(acc["first"] >= 0, F.concat(acc["runs"], one(acc["first"], acc["last"]))).otherwise(acc["runs"]))


def entropy_runs(c: Column) -> Column:
    """(first, last) of each run of overlapping or touching windows of the candidate that reach its threshold."""
    bound = lambda least: F.lit(math.floor((math.log2(WINDOW) - least) * WINDOW * UNIT)).cast("long")

    def joined(runs: Column) -> Column:
        """Runs of neighbouring chunks that touch are one."""
        firsts = F.filter(runs, lambda r, i: (i == 0) | (r["first"] > F.get(runs, i - 1)["last"]))
        lasts = F.filter(runs, lambda r, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["first"] > r["last"]))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last"))).cast(_RUNS)

    def chunked(x: Column) -> Column:
        windows = F.size(x["codes"]) - (WINDOW - 1)
        chunk = lambda at: let(F.slice(x["codes"], at + 1, F.least(F.lit(CHUNK), windows - at) + (WINDOW - 1)), lambda codes: _chunk_runs(codes, x["most"]))
        shifted = lambda at: F.transform(chunk(at), lambda r: F.struct((r["first"] + at).alias("first"), (r["last"] + at).alias("last")))
        return let(F.flatten(F.transform(F.sequence(F.lit(0), windows - 1, F.lit(CHUNK)), shifted)), joined)

    codes = F.transform(F.split(c, ""), lambda x: F.instr(F.lit(ALPHABET), x))
    most = F.when(F.rlike(c, F.lit("^[0-9a-fA-F]+$")), bound(HEX_BITS)).otherwise(bound(TOKEN_BITS))
    return F.when(F.length(c) >= WINDOW, let(F.struct(codes.alias("codes"), most.alias("most")), chunked)).otherwise(_none(_RUNS))


def fits(c: Column) -> Column:
    return F.rlike(c, F.lit("[0-9]")) & F.rlike(c, F.lit("[A-Za-z]"))


def added_spans(text: Column, base: Column, allowed=ALLOWED) -> Column:
    """Spans of kind ``entropy`` outside the base spans, sorted."""
    whole = [p for p in allowed if p.startswith("^")]

    def judged(s: Column, c: Column) -> Column:
        x = F.struct(c.alias("c"), F.sequence(F.lit(0), F.length(c) - 1).alias("kept"))
        for pattern in allowed:
            if not pattern.startswith("^"):
                x = let(x, squeezed(pattern))

        def found(x: Column) -> Column:
            ok = fits(x["c"])
            for pattern in whole:
                ok &= ~F.rlike(x["c"], F.lit(pattern))
            place = lambda w: F.struct((s + F.get(x["kept"], w["first"])).alias("s"), F.lit(3).alias("k"), (s + F.get(x["kept"], w["last"] - 1) + 1).alias("e"))
            return F.when(ok, F.transform(entropy_runs(x["c"]), place).cast(_SPANS)).otherwise(_none(_SPANS))

        return let(x, found)

    def of_runs(runs: Column) -> Column:
        piece = lambda blocks: F.flatten(F.transform(outside(runs, base), lambda p: let(cut(blocks, p["s"], p["e"]), lambda c: judged(p["s"], c))))
        return F.when(F.size(runs) == 0, _none(_SPANS)).otherwise(let(blocks_of(text), piece))

    return let(spans(text, CANDIDATE, 3, fits), of_runs)


def scan(df: DataFrame, text_col: str = "text", allowed=ALLOWED, base: str = "base", found: str = "found") -> DataFrame:
    """The rows with ``base`` and ``found``: sorted arrays of (start, kind, end), the base kinds and all."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn(base, base_spans(text))
    return df.withColumn(found, F.sort_array(F.concat(F.col(base), added_spans(text, F.col(base), allowed))))


def as_text(found: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"], x["e"])), ",")


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each of the sorted spans, overlapping ones together, replaced by the mask."""

    def masked(spans: Column, ends: Column, blocks: Column) -> Column:
        begins = F.filter(spans, lambda x, i: (i == 0) | (x["s"] >= F.get(ends, i - 1)))
        stops = F.filter(ends, lambda e, i: (i == F.size(ends) - 1) | (F.get(spans, i + 1)["s"] >= e))
        gap = lambda stops: lambda x, i: F.concat(cut(blocks, F.coalesce(F.get(stops, i - 1), F.lit(0)), x["s"]), F.lit(mask))
        rest = lambda stops: cut(blocks, F.get(stops, F.size(stops) - 1), F.length(text))
        return let(stops, lambda stops: F.concat(F.array_join(F.transform(begins, gap(stops)), ""), rest(stops)))

    def of_spans(spans: Column) -> Column:
        ends = let(F.transform(spans, lambda x: x["e"]), lambda e: running(e, F.greatest))
        return let(ends, lambda ends: let(blocks_of(text), lambda blocks: masked(spans, ends, blocks)))

    return F.when(F.size(found) > 0, let(found, of_spans)).otherwise(text)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return rows.select("doc_id", *map(count, range(3)), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))
