"""Addresses against a table of ranges, of both families, without a nested loop.

An address is its family and 128 bits in two longs (an IPv4 one the last 32). A range is cut into the fewest prefixes that make it up, so a range of IPv4 gives 62 at most, of
IPv6 254. An address lies in a range if one of its prefixes, of the lengths that occur in the table, is one of the range's: an equi-join by (family,
length, prefix) of each distinct address with the table, whose cost doesn't grow with how many ranges there are beside those that fit.

IPv4 in IPv6 (``::ffff:1.2.3.4``) is IPv4. What is no address lies in no range. A range whose ends are no addresses, or of two families, or in the
wrong order holds nothing.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PREFIXES = "id {kind}, family long, bits long, hi long, lo long"
_SIGN = 1 << 63


def parsed(text: str | None) -> tuple[int, int] | None:
    """(family, number) of an address as written, zones and blanks around it aside; None for what is none."""
    try:
        ip = ipaddress.ip_address((text or "").strip().split("%")[0])
    except ValueError:
        return None
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return ip.version, int(ip)


def longs(number: int) -> tuple[int, int]:
    """128 bits as two signed longs."""
    hi, lo = number >> 64, number & (2**64 - 1)
    return hi - ((hi >= _SIGN) << 64), lo - ((lo >= _SIGN) << 64)


def cut(first: int, last: int, width: int) -> Iterator[tuple[int, int]]:
    """(bits, first number) of the fewest prefixes that make up the range."""
    while first <= last:
        size = min(first & -first or 1 << width, 1 << (last - first + 1).bit_length() - 1)
        yield width - size.bit_length() + 1, first
        first += size


_ADDRESS = StructType([StructField(n, LongType()) for n in ("family", "hi", "lo")])


def address(text: Column) -> Column:
    """family, hi, lo of an address; null for what is none."""

    def run(texts: pa.Array) -> pa.Array:
        found = [parsed(t) for t in texts.to_pylist()]
        return pa.array([None if x is None else dict(zip(("family", "hi", "lo"), (x[0], *longs(x[1])), strict=True)) for x in found], pa.struct([(n, pa.int64()) for n in ("family", "hi", "lo")]))

    return F.arrow_udf(run, _ADDRESS)(text.cast("string"))


def prefixes(ranges: DataFrame, id_col: str, first: str, last: str) -> DataFrame:
    """id, family, bits, hi, lo: the prefixes of each range; ``first`` and ``last`` are addresses as written."""
    kind = dict(ranges.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                x, y = parsed(a), parsed(b)
                if x and y and x[0] == y[0]:
                    rows += [(n, x[0], bits, *longs(number)) for bits, number in cut(x[1], y[1], 32 if x[0] == 4 else 128)]
            ids = batch.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5))], names=["id", "family", "bits", "hi", "lo"])

    return ranges.select(F.col(id_col).alias("id"), F.col(first).cast("string").alias("a"), F.col(last).cast("string").alias("b")).mapInArrow(run, PREFIXES.format(kind=kind))


def masked(hi: Column, lo: Column, family: int, bits: int) -> tuple[Column, Column]:
    """The first ``bits`` bits of an address, the others 0."""
    ones = ((1 << bits) - 1) << ((32 if family == 4 else 128) - bits)
    h, low = longs(ones)
    return hi.bitwiseAND(F.lit(h).cast("long")), lo.bitwiseAND(F.lit(low).cast("long"))


_PREFIX = ["family", "bits", "hi", "lo"]


def _met(addresses: DataFrame, column: str, table: DataFrame, cut: DataFrame) -> DataFrame:
    """Each distinct address of the column beside the table's rows of prefixes that it has; ``cut``: all those prefixes."""
    lengths = cut.select("family", "bits").distinct().collect()  # 33 + 129 rows at most
    given = addresses.select(F.col(column).alias("address")).distinct().withColumn("at", address(F.col("address"))).filter("at is not null").select("address", "at.*")
    if not lengths:
        return given.select("address", *(F.lit(None).cast(kind).alias(name) for name, kind in table.dtypes)).limit(0)
    tries = [F.struct(F.lit(r.family).alias("family"), F.lit(r.bits).alias("bits"), *(c.alias(n) for c, n in zip(masked(F.col("hi"), F.col("lo"), r.family, r.bits), ("hi", "lo"), strict=True))) for r in sorted(lengths)]
    own = F.filter(F.array(*tries), lambda x: x["family"] == F.col("family"))
    each = given.select("address", F.explode(own).alias("x")).select("address", "x.*")
    return each.join(table, _PREFIX)


def lying_in(addresses: DataFrame, column: str, ranges: DataFrame, id_col: str, first: str, last: str) -> DataFrame:
    """(address, id, bits): each distinct address of the column with every range that holds it, and how long the range's prefix is that does."""
    table = prefixes(ranges, id_col, first, last)
    return _met(addresses, column, table, table).select("address", "id", "bits")


def summed_up(addresses: DataFrame, column: str, ranges: DataFrame, id_col: str, first: str, last: str) -> DataFrame:
    """(address, n, first, last): how many ranges hold each distinct address that lies in one, the least and the largest id among them.

    Ranges are summed up by prefix before they meet the addresses, so that an address meets a row for each length of prefix at most, however
    many ranges hold it. A range's prefixes share no address, so none is counted twice.
    """
    cut = prefixes(ranges, id_col, first, last)
    table = cut.groupBy(*_PREFIX).agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))
    return _met(addresses, column, table, cut).groupBy("address").agg(F.sum("n").alias("n"), F.min("least").alias("first"), F.max("most").alias("last"))


def most_specific(addresses: DataFrame, column: str, ranges: DataFrame, id_col: str, first: str, last: str) -> DataFrame:
    """(address, id): the range with the longest fitting prefix for each distinct address that lies in one; the least id of equally long ones."""
    cut = prefixes(ranges, id_col, first, last)
    return _met(addresses, column, cut.groupBy(*_PREFIX).agg(F.min("id").alias("id")), cut).groupBy("address").agg(F.min(F.struct(-F.col("bits"), "id"))["id"].alias("id"))
