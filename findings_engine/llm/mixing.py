"""Operator 12: a mix of sources by target weights, of fixed-length blocks of words.

- Each source's documents follow each other in a hashed order as one stream of words, cut into blocks of BLOCK words (the last is shorter).
  Rows equal in source, id, size and text are counted as one before that, and lie side by side. A stream is an epoch; a source gives its whole
  epochs and of one more as many blocks as its target needs, the last of them cut, so that it gives its target to the word.
- The mix has shards of SLOTS slots, a slot holds a block. A shard draws the number of slots of each source from a multinomial distribution of its
  own seed. Slots of a source are numbered through all shards by sums over groups of shards (a group draws its shards again where it needs them).
  Chance gives some sources more slots than their targets ask for; the last of those go, in order, to the sources that are short of as many.
- Slot j of a source is slot j mod n of epoch j div n, and a pseudorandom permutation of the n indices, a Feistel network keyed by seed,
  source and epoch, says which block it holds. So slots are made anywhere, without state, and meet the blocks in one join by (source, block),
  in which no key has more rows than a block has documents and uses.

Targets: sources in the order of code points, null last, weigh WEIGHTS in turn and share PERCENT % of all words; none gets more than MOST times its words, and
what is over is shared again by weight among the others. Only (source, words) reaches the driver; a source is what a mix has a weight for.

A null or empty text has 0 words and none of it is taken. Null ids and repeated rows are rows like others. Texts of any length are only counted and cut. An empty
table gives no rows. The same rows give the same mix whatever their partitions. Of other columns none is read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, PERCENT, MOST, SEED = (3, 1, 2), 150, 2, 12
#: Words of a block, slots of a shard, shards of a group, rows of a bucket of a source's stream, copies of a row made at once.
BLOCK, SLOTS, GROUP, BUCKET, COPIES = 256, 1024, 64, 4_000, 1024
#: Sources up to which their table is broadcast.
FEW = 10_000


# -- targets -------------------------------------------------------------------------------------------------
def shares(sizes: list[int], weights: list[int], percent: int = PERCENT, most: int = MOST) -> list[Fraction]:
    """Each source's target in words."""
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(percent * sum(sizes), 100), list(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > most * sizes[i] * whole]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


# -- permutations --------------------------------------------------------------------------------------------
def _mixed(h: np.ndarray, key: int) -> np.ndarray:
    h = h + np.uint64(key % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A pseudorandom permutation of 0 .. n - 1: a Feistel network over the next even number of bits, walked on until it falls below n."""

    n: int
    key: tuple[int, ...]
    rounds: int = 6

    def _steps(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(max(1, ((self.n - 1).bit_length() + 1) // 2))
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & mask
        seeds = round_seeds(self.key, self.rounds)
        for seed in reversed(seeds) if back else seeds:
            if back:
                left, right = right ^ (_mixed(left, seed) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, seed) & mask)
        return (left << half) | right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._steps(np.asarray(x, np.uint64), back)
        while (out := np.flatnonzero(x >= self.n)).size:
            x[out] = self._steps(x[out], back)
        return x.astype(np.int64)

    def place_of(self, x: int) -> int:
        """What ``x`` is the image of."""
        return int(self(np.array([x], np.uint64), back=True)[0])


@lru_cache(100_000)
def round_seeds(key: tuple[int, ...], rounds: int) -> tuple[int, ...]:
    digests = (hashlib.blake2b(repr((key, r)).encode(), digest_size=8).digest() for r in range(rounds))
    return tuple(int.from_bytes(d, "little") for d in digests)


# -- what each source gives ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Source:
    """A source's stream: ``size`` words, of which the mix takes ``words`` in ``slots`` slots, the last cut to ``last`` words."""

    number: int
    size: int
    words: int
    slots: int
    last: int
    blocks: int
    block: int
    seed: int

    @classmethod
    def of(cls, number: int, size: int, target: Fraction, block: int = BLOCK, seed: int = SEED) -> Source:
        words = int(target + Fraction(1, 2))
        if not size or not words:
            return cls(number, size, 0, 0, 0, -(-size // block), block, seed)
        blocks, (epochs, rest) = -(-size // block), divmod(words, size)
        short = blocks * block - size
        if not rest:
            order = Permutation(blocks, (seed, number, epochs - 1))
            whole = block - short if order.place_of(blocks - 1) == blocks - 1 else block
            return cls(number, size, words, epochs * blocks, whole, blocks, block, seed)
        place = Permutation(blocks, (seed, number, epochs)).place_of(blocks - 1)
        before = lambda slots: slots * block - (short if place < slots else 0)  # noqa: E731  words of the first slots of the last epoch
        slots = -(-rest // block)
        slots += before(slots) < rest
        return cls(number, size, words, epochs * blocks + slots, rest - before(slots - 1), blocks, block, seed)

    def held(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that each of the source's slots holds, and how many of its words."""
        epoch, place = slots // self.blocks, slots % self.blocks
        block = np.empty(len(slots), np.int64)
        for e in np.unique(epoch):
            block[epoch == e] = Permutation(self.blocks, (self.seed, self.number, int(e)))(place[epoch == e])
        words = np.where(block == self.blocks - 1, self.size - (self.blocks - 1) * self.block, self.block)
        return block, np.where(slots == self.slots - 1, self.last, words)


@dataclass(frozen=True)
class Draws:
    """The shards' draws. ``sources`` may be of many slots; a group of shards is drawn at once."""

    sources: tuple[Source, ...]
    slots: int = SLOTS
    group: int = GROUP
    seed: int = SEED

    @property
    def total(self) -> int:
        return sum(s.slots for s in self.sources)

    @property
    def groups(self) -> int:
        return -(-self.total // (self.slots * self.group))

    def of(self, group: int) -> tuple[int, np.ndarray]:
        """The group's first shard, and a row of counts by source for each of its shards."""
        chance = np.array([s.slots / self.total for s in self.sources])
        first = group * self.group
        last = min(first + self.group, -(-self.total // self.slots))
        sizes = [min(self.slots, self.total - n * self.slots) for n in range(first, last)]
        return first, np.array([np.random.Generator(np.random.Philox(key=[self.seed, n])).multinomial(size, chance / chance.sum()) for n, size in zip(range(first, last), sizes, strict=True)], np.int64)


def slot_table(spark: SparkSession, draws: Draws) -> DataFrame:
    """shard, slot, number (of the source), block, take: what each slot of the mix holds."""
    kind = "shard long, slot int, number int, block long, take int"
    if not draws.total:
        return spark.createDataFrame([], kind)
    tasks = int(min(draws.groups, max(spark.sparkContext.defaultParallelism, draws.groups // 64)))
    groups = spark.range(0, draws.groups, 1, tasks).withColumnRenamed("id", "group")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("group").to_pylist():
                counts = draws.of(g)[1].sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(counts)), pa.array(range(len(counts)), pa.int32()), pa.array(counts)], names=["group", "number", "n"])

    each = written(groups.mapInArrow(sums, "group long, number int, n long"), "draws")
    drawn = {r["number"]: r.n for r in each.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    over = np.array([max(0, drawn[k] - s.slots) for k, s in enumerate(draws.sources)])
    short = np.array([max(0, s.slots - drawn[k]) for k, s in enumerate(draws.sources)])
    over_before, short_until = np.cumsum(over) - over, np.cumsum(short)
    before = F.coalesce(F.sum("n").over(W.partitionBy("number").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = each.withColumn("start", before).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("number", "start"))).alias("starts"))

    limits, all_drawn = np.array([s.slots for s in draws.sources]), np.array([drawn[k] for k in range(len(draws.sources))])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, start in zip(batch.column("group").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                first, counts = draws.of(g)
                sizes = counts.sum(axis=1)
                number = np.repeat(np.tile(np.arange(len(limits)), len(counts)), counts.ravel())
                # the group's slots of a source are numbered in the order of its shards
                order = np.argsort(number, kind="stable")
                many = counts.sum(axis=0)
                index = np.empty(len(number), np.int64)
                index[order] = np.arange(len(number)) - np.repeat(np.cumsum(many) - many, many) + np.repeat([x["start"] for x in start], many)
                # beyond a source's own slots: those of a source that is short of some
                if (beyond := np.flatnonzero(index >= limits[number])).size:
                    nth = over_before[number[beyond]] + index[beyond] - limits[number[beyond]]
                    to = np.searchsorted(short_until, nth, "right")
                    index[beyond] = all_drawn[to] + nth - (short_until - short)[to]
                    number[beyond] = to
                block, take = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
                for k in np.unique(number):
                    own = np.flatnonzero(number == k)
                    block[own], take[own] = draws.sources[k].held(index[own])
                shard = np.repeat(first + np.arange(len(counts)), sizes)
                slot = np.concatenate([Permutation(int(size), (draws.seed, first + n, len(limits)))(np.arange(size)) for n, size in enumerate(sizes)])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot, pa.int32()), pa.array(number, pa.int32()), pa.array(block), pa.array(take, pa.int32())], names=["shard", "slot", "number", "block", "take"])

    return starts.repartition(tasks, "group").mapInArrow(slots, kind)


# -- documents as blocks -------------------------------------------------------------------------------------
def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Mix:
    """``sources``: number, source, source_size, target. ``rows``: id, source, number, size, digest, copies, at (its place in the stream)."""

    sources: DataFrame
    rows: DataFrame
    slots: DataFrame
    block: int = BLOCK

    def documents(self) -> DataFrame:
        """A row for each row of the table: id, source, number, size, digest, at."""
        some = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
        rows = self.rows.withColumn("from", some)
        copy = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, "copies") - 1))
        return rows.withColumn("copy", copy).withColumn("at", F.col("at") + F.col("copy") * F.col("size")).drop("copies", "copy", "from")

    def pieces(self) -> DataFrame:
        """Where the documents' words lie: number, block, offset there, id, size, digest, at, start and length in the document."""
        first, last = F.floor(F.col("at") / self.block), F.floor((F.col("at") + F.col("size") - 1) / self.block)
        rows = self.documents().filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        start = F.greatest(F.lit(0), F.col("block") * self.block - F.col("at"))
        offset = F.col("at") + start - F.col("block") * self.block
        rows = rows.withColumns({"start": start, "offset": offset.cast("int")})
        return rows.withColumn("length", F.least(F.col("size") - F.col("start"), F.lit(self.block) - F.col("offset")).cast("int"))

    def spans(self) -> DataFrame:
        """The mix: shard, slot, offset, and the span of words (start, length) of the document id that lies there; with number, size, digest and at."""
        # the planner can't know how many slots there are, and would broadcast them
        both = self.pieces().join(self.slots.hint("merge"), ["number", "block"]).filter("offset < take")
        return both.withColumn("length", F.least("length", F.col("take") - F.col("offset"))).select("shard", "slot", "offset", "id", "number", "size", "digest", "at", "start", "length")

    def taken(self) -> DataFrame:
        """id, size, source_size, target, taken: a row for each row of the table."""
        keys = ("number", "at", "id", "size")
        none = self.documents().select(*keys, F.lit(0).alias("length"))
        # documents without words share their place with the next one
        sums = self.spans().select(*keys, "length").unionByName(none.filter("size > 0")).groupBy(*keys).agg(F.sum("length").alias("taken"))
        rows = sums.unionByName(none.filter("size = 0").withColumnRenamed("length", "taken"))
        few = F.broadcast if self.sources.count() <= FEW else lambda x: x
        return rows.join(few(self.sources.drop("source")), "number").select("id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """The mix with its words: shard, slot, offset, id, words. Each document's text travels once, to all its spans."""
        keyed = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("_size"), F.xxhash64(text_col).alias("_digest"), F.col(text_col).alias("_text"))
        keyed = keyed.dropDuplicates(["_id", "_source", "_size", "_digest"])
        own = self.spans().join(self.sources.select("number", "source"), "number").groupBy("id", "source", "size", "digest", "at")
        spans = own.agg(F.collect_list(F.struct("shard", "slot", "offset", "start", "length")).alias("spans"))
        same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("digest") == F.col("_digest"))
        words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
        rows = spans.join(keyed, same).select("id", words.alias("all"), F.explode("spans").alias("x"))
        return rows.select("x.shard", "x.slot", "x.offset", "id", F.slice("all", (F.col("x.start") + 1).cast("int"), F.col("x.length")).alias("words"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> Mix:
    spark = docs.sparkSession
    one = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("digest"))
    rows = written(one.groupBy("id", "source", "size", "digest").agg(F.count("*").alias("copies")), "rows")
    words = F.sum(F.col("copies") * F.col("size"))
    found = rows.groupBy("source").agg(words.alias("words"), F.count("*").alias("n")).collect()
    found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode()))
    targets = shares([r["words"] for r in found], [weights[k % len(weights)] for k in range(len(found))], percent, most)
    given = tuple(Source.of(k, r["words"], t, block, seed) for k, (r, t) in enumerate(zip(found, targets, strict=True)))
    kind = f"number int, source {dict(one.dtypes)['source']}, source_size long, target double"
    sources = spark.createDataFrame([(k, r.source, r["words"], float(t)) for k, (r, t) in enumerate(zip(found, targets, strict=True))], kind)
    # places in the streams: sums over buckets, then inside them
    buckets = max(1, sum(r.n for r in found) // BUCKET)
    order = F.xxhash64("id", "size", "digest", F.lit(seed))
    few = F.broadcast if len(found) <= FEW else lambda x: x
    known = few(sources.select("number", F.col("source").alias("_source")))
    dealt = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumns({"order": order, "words": F.col("copies") * F.col("size")})
    dealt = dealt.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    before = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("number", "bucket").agg(F.sum("words").alias("words"))
    sums = sums.select("number", "bucket", before(W.partitionBy("number").orderBy("bucket")).alias("first"))
    inside = dealt.withColumn("inside", before(W.partitionBy("number", "bucket").orderBy("order", "id", "size", "digest")))
    placed = inside.join(sums, ["number", "bucket"]).withColumn("at", F.col("first") + F.col("inside")).drop("order", "words", "bucket", "first", "inside")
    return Mix(sources, written(placed, "placed"), slot_table(spark, Draws(given, slots, seed=seed)), block)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).taken().withColumnRenamed("id", "doc_id")
