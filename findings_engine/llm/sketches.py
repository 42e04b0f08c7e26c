"""Operator 5: fingerprints that hold every shingle hash below a fixed fraction of the hash space. DataFrame operations only.

A sketch of a union is the union of the sketches, and a sketch's size estimates the document's number of
distinct shingles, so that containment between documents of very unequal length can be told from sketches
alone. All that is compared is two sketches, whatever the texts' lengths; no other hash is looked at. Of a hash below the fraction
the MARK_BITS bits after the leading zeros are kept. A text of n shingles has none below the fraction with a chance of (1 - 2**-FRACTION_BITS)**n;
its sketch is empty like that of a text without words. Two empty sketches have likeness 1, one has 0; an empty one's containment is null, as it tells none.

The next document in ascending id (a whole number) comes from one shuffle of the texts into ranges of ids, whose partitions follow
from the table's size: each range also gets the head of the next one, as a guest. Rows of one id are ordered by text. A null id has no place in this
order: its next text is empty. Null texts are empty.
An empty table gives no rows. Texts of any length are cut into words once and hashed in one pass. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions_for, table

SHINGLE_WORDS = 5
#: The fraction is 2**-FRACTION_BITS; bits that are kept of a hash below it.
FRACTION_BITS, MARK_BITS = 2, 32
#: Rows of a range of ids, if ids between two sampled quantiles are spread evenly; ranges of a range of ranges; quantiles.
RANGE_ROWS, RANGES, COARSE = 256, 4096, 256


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def shingle_hashes(w: Column, k: int = SHINGLE_WORDS) -> Column:
    """A hash for each k words in a row of the array column ``w``; of fewer words, one of them all."""
    n = F.size(w)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(w[i + j] for j in range(k))))
    return F.when(n >= k, each).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def sketch(hashes: Column, bits: int = FRACTION_BITS) -> Column:
    """Sorted distinct marks of the hashes below the fraction."""
    low = F.filter(hashes, lambda x: F.shiftrightunsigned(x, 64 - bits) == 0)
    return F.array_sort(F.array_distinct(F.transform(low, lambda x: F.shiftrightunsigned(x, 64 - bits - MARK_BITS))))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ",")


def with_next(df: DataFrame, id_col: str, text_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """id, text, next_text: the text of the row that follows in (id, text), after the last row that of the first."""
    rows = df.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    quantiles = ", ".join(str(k / COARSE) for k in range(1, COARSE))
    low, high, n, size, cuts = rows.agg(F.min(id_col), F.max(id_col), F.count(id_col), F.sum(F.octet_length("text")), F.expr(f"approx_percentile(`{id_col}`, array({quantiles}))")).first()
    unplaced = rows.filter(F.col(id_col).isNull()).withColumn("next_text", F.lit(""))
    if not n:
        return unplaced
    # ranges of ids between sampled quantiles, each cut evenly, so that an id far from all others thins out one of them only
    bounds = sorted({c for c in cuts if low <= c < high})
    starts, ends = [low, *(c + 1 for c in bounds)], [*bounds, high]
    fine = max(1, n // (range_rows * len(starts)))
    number = F.col(id_col).cast("long" if high - low < 2**52 else "decimal(38,0)")
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda c: F.col(id_col) > c))
    at = lambda values: F.get(F.array(*map(F.lit, values)).cast("array<long>"), coarse).cast("long" if high - low < 2**52 else "decimal(38,0)")
    part = coarse.cast("long") * fine + F.floor((number - at(starts)).cast("double") * fine / (at(ends) - at(starts) + 1).cast("double")).cast("long")
    placed = rows.filter(F.col(id_col).isNotNull()).withColumn("part", part)
    # heads: the first row of each range; each goes to the range before it that has rows
    heads = placed.groupBy("part").agg(F.min_by("text", F.struct(id_col, "text")).alias("text"), F.min(id_col).alias(id_col)).withColumn("group", F.floor(F.col("part") / RANGES))
    groups = placed.select("part").distinct().groupBy(F.floor(F.col("part") / RANGES).alias("group")).agg(F.max("part").alias("last"))
    order = W.orderBy("group")  # one row for RANGES ranges
    groups = groups.select("group", F.lag("last").over(order).alias("before"), F.max("last").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("end"))
    before = F.lag("part").over(W.partitionBy("group").orderBy("part"))
    guests = heads.withColumn("lag", before).join(groups, "group")
    first = F.col("lag").isNull() & F.col("before").isNull()
    guests = guests.select(F.coalesce("lag", "before", "end").alias("part"), F.when(first, 1).otherwise(0).alias("wrap"), F.col(id_col), "text", F.lit(True).alias("guest"))
    all_rows = placed.select("part", F.lit(0).alias("wrap"), F.col(id_col), "text", F.lit(False).alias("guest")).unionByName(guests)
    all_rows = all_rows.repartition(partitions_for(df.sparkSession, size), "part")
    # of rows of one id and text a guest comes last
    following = F.lead("text").over(W.partitionBy("part").orderBy("wrap", id_col, "text", "guest"))
    return all_rows.withColumn("next_text", following).filter(~F.col("guest")).select(id_col, "text", "next_text").unionByName(unplaced)


def op5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next document's fingerprint is made again where it is needed, which costs no shuffle."""
    rows = with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    three = ("text", "edited", "next_text")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(words(F.col(c)).alias(c) for c in three))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *(sketch(shingle_hashes(F.col(c))).alias(c) for c in three))
    a, b, c = map(F.col, three)
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
