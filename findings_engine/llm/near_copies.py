"""Near copies by SimHash: the pipeline's use of operator 8.

Of two texts with a Jaccard similarity of 0.8 over shingles of five words, SimHashes of those shingles differ
in every seventh bit, far over a budget of three. The words themselves change far less: here a fingerprint
sums the hashes of a text's words, each by the square root of its count, and texts of that similarity differ
in two or three bits of 64 on average. FAMILIES fingerprints with hashes of their own make up for chance, and a
link in any of them is a link. Different texts of one language mostly differ in twenty bits and more.

These links only propose. Rows of equal words form a class first, and its least id stands for it. In each family a class
links to the least class of its fingerprint, and the binary trie links the distinct fingerprints within the budget. Within
each group that such links connect, every pair of texts with an exact Jaccard similarity of LEAST_SIMILARITY or more over
their distinct shingles of SHINGLE_WORDS words is an edge, except pairs that edges join already; no other pair is one. A
large group is dealt in blocks of pairs of its parts, so that a task holds about 2 * PART_BYTES of text whatever the size.

A text of fewer words is one shingle; a text without words is a copy of any other such text. A null id belongs to no group and its row stays. Rows of one id
and other words are rows like any others: each is judged by its own words. Of rows of one id and the same words the first by text and by a hash of
the cells stays (such rows meet in the task that picks one). An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import forget, free_name, pieces, written
from .components import roots
from .simhash import BUDGET, SEED, links

FAMILIES = 12
#: Families whose fingerprints are linked together; what the driver and a task hold grows with it.
FAMILIES_AT_ONCE = 3
SHINGLE_WORDS = 5
#: Least exact Jaccard similarity of an edge, as a fraction of whole numbers.
LEAST_SIMILARITY = (4, 5)
#: Bytes of text in a part of a group that are compared in one task with those of another part.
PART_BYTES = 500_000


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Family k's hash of each hash (the finaliser of splitmix64)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_fingerprints(text: bytes) -> list[int]:
    """FAMILIES fingerprints, as signed longs, of the text's words; zeros without words."""
    import xxhash

    counts = Counter(text.lower().split())
    if not counts:
        return [0] * FAMILIES
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in counts], np.uint64)
    weights = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    out = []
    for k in range(FAMILIES):
        sums = np.zeros(64, np.float32)
        for at in range(0, len(hashes), 4096):
            bits = np.unpackbits(_mixed(hashes[at : at + 4096], k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums += weights[at : at + 4096] @ bits.astype(np.float32)
        out.append(int(np.packbits(2 * sums > weights.sum(), bitorder="little").view("<i8")[0]))
    return out


def word_key(text: bytes) -> bytes:
    """Equal for texts of the same words in the same order."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def shingles(text: bytes, number: dict[bytes, int] | None = None) -> set:
    """The text's distinct shingles, or with ``number`` their numbers there, which texts share."""
    words = text.lower().split()
    found = (b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))) if words else ()
    return set(found) if number is None else {number.setdefault(s, len(number)) for s in found}


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return both * LEAST_SIMILARITY[1] >= LEAST_SIMILARITY[0] * (len(a) + len(b) - both)


def similar_pairs(sets: list[set]) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all similar ones, by the rarest of their members (prefix filter)."""
    over, under = LEAST_SIMILARITY[1], LEAST_SIMILARITY[0]
    count = Counter(x for s in sets for x in s)
    label, out = list(range(len(sets))), []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    under_member: dict[bytes | None, list[int]] = defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n = len(sets[i])
        # of two similar sets each has one of its first members among the first of the other
        first = sorted(sets[i], key=lambda x: (count[x], x))[: n - -(-under * n // over) + 1] or [None]
        found: set[int] = set()
        for x in first:
            found.update(under_member[x])
            under_member[x].append(i)
        for j in sorted(found):
            if len(sets[j]) * over >= under * n and root(i) != root(j) and similar(sets[i], sets[j]):
                label[root(i)] = root(j)
                out.append((j, i))
    return out


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key of the words, n_bytes, and the fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches):
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            prints = [word_fingerprints(t) for t in texts]
            columns = [pa.array([word_key(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
            columns += [pa.array([p[k] for p in prints], pa.int64()) for k in range(FAMILIES)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "key", "n_bytes", *(f"fp{k}" for k in range(FAMILIES))])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, key binary, n_bytes long, " + ", ".join(f"fp{k} long" for k in range(FAMILIES)))


@F.arrow_udf(BinaryType())
def _key(text: pa.Array) -> pa.Array:
    return pa.array([word_key(t.as_py() or b"") for t in text.cast(pa.binary())], pa.binary())


def verified(docs: DataFrame, classes: DataFrame, linked: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(a, b): edges between similar texts of each group of ``linked`` (node, root), that connect all of them."""
    members = linked.join(classes.select("node", "id", "key", "n_bytes"), "node")
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n_bytes") / part_bytes).cast("int").alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1)))
    members = members.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(members.drop("n_bytes"), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("root", "node", "key", "text", "part", other.alias("other")).select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "key", "text")

    def run(group: pa.Table) -> pa.Table:
        # an id's rows of other words belong to other classes, its further rows of the same words are copies
        nodes, sets, number, met = [], [], {}, set()
        for node, key, text in zip(group.column("node"), group.column("key"), group.column("text").cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            if word_key(text) == key.as_py() and key.as_py() not in met:
                met.add(key.as_py())
                nodes.append(node)
                sets.append(shingles(text, number))
        pairs = similar_pairs(sets)
        kind = group.schema.field("node").type
        return pa.table({"a": pa.array([nodes[i].as_py() for i, _ in pairs], kind), "b": pa.array([nodes[j].as_py() for _, j in pairs], kind)})

    kind = dict(linked.dtypes)["node"]
    return rows.groupBy("root", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """The classes of equal words (node: a number, id: the least, key), and (node, root) of those that have edges."""
    each = [f"fp{k}" for k in range(FAMILIES)]
    docs = docs.filter(F.col(id_col).isNotNull())
    prints = fingerprints(docs, id_col, text_col)
    classes = prints.groupBy("key", *each).agg(F.min("id").alias("id"), F.max("n_bytes").alias("n_bytes"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", F.posexplode(F.array(*each)).alias("family", "fp"))
    least = written(members.groupBy("family", "fp").agg(F.min("node").alias("least")), "families")
    inside = members.join(least, ["family", "fp"]).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    one = least.select("family", F.col("fp").alias("a"), F.col("least").alias("x"))
    two = least.select("family", F.col("fp").alias("b"), F.col("least").alias("y"))
    batches = [least.filter(F.col("family").between(k, k + FAMILIES_AT_ONCE - 1)).select("family", "fp") for k in range(0, FAMILIES, FAMILIES_AT_ONCE)]
    found = reduce(DataFrame.union, [written(links(batch, budget), "links") for batch in batches])
    across = found.join(one, ["family", "a"]).join(two, ["family", "b"])
    linked = written(roots(inside.union(across.select(F.col("x").alias("a"), F.col("y").alias("b"))), "a", "b"), "candidates")
    return classes.select("node", "id", "key"), roots(verified(docs, classes, linked, id_col, text_col), "a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the least id of each group; the columns are those of ``docs``."""
    classes, linked = groups(docs, id_col, text_col)
    of = classes.join(linked, "node", "left")
    first = of.filter("root is not null").groupBy("root").agg(F.min(F.struct("id", "key")).alias("first")).select("first.*")
    least = of.filter("root is null").select("id", "key").unionByName(first)
    key, nth = (free_name(c, docs.columns) for c in ("_key", "_nth"))
    rows = docs.filter(F.col(id_col).isNotNull()).withColumn(key, _key(text_col))
    kept = rows.join(least.select(F.col("id").alias(id_col), F.col("key").alias(key)), [id_col, key], "left_semi")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = W.partitionBy(id_col, key).orderBy(text_col, F.xxhash64(*plain))
    kept = kept.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
