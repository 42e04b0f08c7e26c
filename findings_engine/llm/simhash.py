"""Operator 8: SimHash fingerprints linked within a Hamming budget by a self-join of their binary trie.

Fingerprints: bit b of a document is 1 if over half of its shingle hashes have it. Equal fingerprints form a
class first, by an aggregation; only distinct ones enter the join. Node pairs of the trie are traversed
together from (root, root): a pair's children are the four pairs of its nodes' children, those under unlike
bits with one more differing bit, and a pair over the budget is pruned with all below it.

- On the driver the traversal runs over counts alone: of each prefix of TOP_BITS bits, and of longer ones only under
  and beside prefixes that hold more than ``limit`` fingerprints. A pair of nodes that hold at most ``limit`` each becomes
  a task; heavier ones split further. The list of nodes and their tasks is broadcast only up to BROADCAST rows.
- In a task the traversal goes on over sorted arrays, whose ranges are the nodes, WIDTH pairs at a time. The links
  found are at once reduced to a forest, and a pair of nodes whose fingerprints are all connected already is passed over,
  so that a dense ball of fingerprints gives no more edges than nodes and is not compared pair by pair.

Connected components over the tasks' forests give the classes' components, and a join on the fingerprint gives
each document's.

A text without words (null, empty, blank) has the fingerprint zero and links like any other. Null ids keep
their row and count for no component's least id. Repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, written
from .components import roots

SHINGLE_WORDS, SEED, BUDGET = 3, 42, 3
#: Prefix bits that the driver has counts for at first and how many more it takes under heavy ones; most fingerprints of a node in a task.
TOP_BITS, MORE_BITS, MOST = 12, 4, 4_000_000
#: Node pairs that a task expands at a time, and the leaf pairs below which it compares all.
WIDTH, LEAF = 8_192, 64
#: Rows of the list of nodes and tasks (24 bytes each) up to which it is broadcast.
BROADCAST = 200_000


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The text's SimHash, unsigned. ``bytes`` lower-cases A-Z only and splits at ASCII white space only."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]  # noqa: B905
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = [fingerprint(t.as_py() or b"", shingle_words) for t in batch.column(text_col).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.array(prints, np.uint64).view(np.int64))], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, fp long")


# -- the trie ---------------------------------------------------------------------------------------
Levels = dict[int, dict[int, int]]


def upwards(counts: dict[int, int], bits: int, stop: int = 0) -> Levels:
    """Counts of the nodes of each depth from ``bits`` to ``stop``, from those at ``bits``."""
    levels = {bits: counts}
    for depth in range(bits - 1, stop - 1, -1):
        up: dict[int, int] = {}
        for p, n in levels[depth + 1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        levels[depth] = up
    return levels


def plan(levels: Levels, limit: int, budget: int = BUDGET) -> list[tuple[int, int, int]]:
    """Tasks (depth, prefix, prefix) that cover every pair within the budget."""
    tasks, stack = [], [(0, 0, 0)] if levels[0] else []
    while stack:
        depth, a, b = stack.pop()
        below = levels.get(depth + 1, {})
        left, right = ([c for c in (2 * p, 2 * p + 1) if c in below] for p in (a, b))
        if max(levels[depth][a], levels[depth][b]) <= limit or not left or not right:
            tasks.append((depth, a, b))
            continue
        for p in left:
            for q in right:
                if (a != b or p <= q) and (p ^ q).bit_count() <= budget:
                    stack.append((depth + 1, p, q))
    return tasks


def _key(family: int, depth: int, number: int) -> int:
    return (family << 56) | (depth << 48) | number


class Joined:
    """Which of n sorted values are connected so far."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.held = n, [], [], 0
        self.label = np.arange(n)
        self.until = self.label + 1  # where the run of equal labels that each value lies in ends

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.a.append(i)
        self.b.append(j)
        self.held += len(i)
        if self.held > self.n // 2 + WIDTH:
            self.merge()

    def merge(self) -> np.ndarray:
        """The least value that each is connected with."""
        if self.held:
            at = np.flatnonzero(self.label != np.arange(self.n))
            self.label = forest(self.n, np.concatenate([at, *self.a]), np.concatenate([self.label[at], *self.b]))
            self.a, self.b, self.held = [], [], 0
            ends = np.append(np.flatnonzero(np.diff(self.label)) + 1, self.n)
            self.until = np.repeat(ends, np.diff(ends, prepend=0))
        return self.label

    def settled(self, pairs: np.ndarray) -> np.ndarray:
        """Pairs of ranges whose values are all connected."""
        la, ha, lb, hb, _ = pairs
        return (self.until[la] >= ha) & (self.until[lb] >= hb) & (self.label[la] == self.label[lb])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected with."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if not (apart := low != high).any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(label, nearer := label[label]):
            label = nearer


def trie_links(values: np.ndarray, a: tuple[int, int], b: tuple[int, int], depth: int, budget: int = BUDGET) -> Joined:
    """What links of at most ``budget`` differing bits between one value of range a and one of range b connect.

    ``values`` are sorted and distinct. Both ranges are nodes at ``depth``. If they are the same node, each pair is met once.
    """
    joined = Joined(len(values))
    if a[0] == a[1] or b[0] == b[1]:
        return joined
    before = int(values[a[0]] ^ values[b[0]]) >> (64 - depth) if depth else 0
    stack = [(depth, np.array([[a[0]], [a[1]], [b[0]], [b[1]], [before.bit_count()]], np.int64))]  # bounds of both ranges, differing bits
    while stack:
        d, pairs = stack.pop()
        if (width := pairs.shape[1]) > WIDTH:
            stack += [(d, pairs[:, : width // 2]), (d, pairs[:, width // 2 :])]
            continue
        pairs = pairs[:, ~joined.settled(pairs)]
        la, ha, lb, hb, diff = pairs
        size = (ha - la) * (hb - lb)
        small = size <= LEAF if d < 64 else np.ones(len(size), bool)
        if small.any():
            first, second, wide, size, own = la[small], lb[small], (hb - lb)[small], size[small], (la == lb)[small]
            of = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            down = k // wide[of]
            i, j = first[of] + down, second[of] + k - down * wide[of]
            near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & ((i < j) | ~own[of])
            if near.any():
                joined.add(i[near], j[near])
        if small.all():
            continue
        la, ha, lb, hb, diff = pairs[:, ~small]
        bit, above = np.uint64(1 << (63 - d)), np.uint64(2**64 - 2 ** (64 - d))
        ma, mb = (np.searchsorted(values, (values[low] & above) | bit) for low in (la, lb))  # where the ones of each range begin
        more, other = diff + 1, la != lb
        below = np.concatenate([np.stack(c) for c in ((la, ma, lb, mb, diff), (ma, ha, mb, hb, diff), (la, ma, mb, hb, more))] + [np.stack((ma, ha, lb, mb, more))[:, other]], axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)]
        if below.shape[1]:
            stack.append((d + 1, below))
    return joined


def task_forest(values: np.ndarray, depth: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over the values, all of one node or of two at ``depth``, that connects what the budget links there."""
    values = np.sort(values)
    n = len(values)
    prefixes = values >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    middle = int(np.searchsorted(prefixes, prefixes[0], "right")) if n else 0
    one, two = ((0, n), (0, n)) if middle == n else ((0, middle), (middle, n))
    label = trie_links(values, one, two, depth, budget).merge()
    member = np.flatnonzero(label != np.arange(n))
    return values[member], values[label[member]]


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")


def _counted(distinct: DataFrame, bits: int) -> dict[int, dict[int, int]]:
    """Of each family the number of fingerprints under each prefix."""
    found = distinct.groupBy("family", _prefix(bits).alias("p")).count().toArrow()
    out: dict[int, dict[int, int]] = {}
    for family, p, n in zip(*(found.column(k).to_pylist() for k in range(3)), strict=True):
        out.setdefault(family, {})[p] = n
    return out


def trie_levels(distinct: DataFrame, limit: int | None, budget: int) -> tuple[dict[int, Levels], int]:
    """Of each family the counts that the plan needs, and the limit of a node."""
    found = _counted(distinct, TOP_BITS)
    limit = limit or min(MOST, max(4096, sum(n for counts in found.values() for n in counts.values()) // 16))
    levels = {family: upwards(counts, TOP_BITS) for family, counts in found.items()}
    bits = TOP_BITS
    while bits < 64:
        heavy = [(family, p) for family, held in levels.items() for p, n in held.get(bits, {}).items() if n > limit]
        beside = [(family, p) for family, h in heavy for p in levels[family][bits] if (p ^ h).bit_count() <= budget]
        if not beside:
            break
        known = distinct.sparkSession.createDataFrame(sorted(set(beside)), "family int, q long")
        under = distinct.join(known, (distinct["family"] == known["family"]) & (_prefix(bits) == known["q"]), "left_semi")
        for family, counts in _counted(under, bits + MORE_BITS).items():
            levels[family].update((d, c) for d, c in upwards(counts, bits + MORE_BITS, bits + 1).items())
        bits += MORE_BITS
    return levels, limit


def links(distinct: DataFrame, budget: int = BUDGET, limit: int | None = None) -> DataFrame:
    """(family, a, b): edges between the distinct (family, fp) that connect, in each family, whatever the budget links."""
    spark = distinct.sparkSession
    levels, limit = trie_levels(distinct, limit, budget)
    rows = [(family, depth, node, _key(family, depth, k)) for family, held in sorted(levels.items()) for k, (depth, a, b) in enumerate(plan(held, limit, budget)) for node in {a, b}]
    depths = sorted({r[1] for r in rows}) or [0]
    kinds = (("family", pa.int32()), ("depth", pa.int32()), ("node", pa.int64()), ("task", pa.int64()))
    nodes = spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)}))
    under = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("node")) for d in depths)))
    at = distinct.select("family", "fp", under.alias("at")).select("family", "at.depth", "at.node", "fp")
    dealt = at.join(F.broadcast(nodes) if len(rows) <= BROADCAST else nodes, ["family", "depth", "node"]).select("task", "fp")

    def run(group: pa.Table) -> pa.Table:
        task = group.column("task")[0].as_py()
        a, b = task_forest(group.column("fp").to_numpy().view(np.uint64).copy(), (task >> 48) & 255, budget)
        return pa.table({"family": pa.array([task >> 56] * len(a), pa.int32()), "a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("task").applyInArrow(run, "family int, a long, b long")


def components(prints: DataFrame, id_col: str = "doc_id", budget: int = BUDGET, limit: int | None = None) -> DataFrame:
    """id, fp, component_id: the least id of those that chains of links reach. ``prints``: id and fp, cheap to read again."""
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    root = roots(links(classes.select(F.lit(0).alias("family"), "fp"), budget, limit), "a", "b")
    linked = written(root.join(classes, root["node"] == classes["fp"]).select("fp", "root", "least"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of = linked.join(least, "root").select(F.col("fp").alias("f"), "component")
    component = classes.join(of, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "least").alias("component_id"))
    return prints.join(component, F.col("fp") == F.col("f")).select(id_col, "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return components(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
