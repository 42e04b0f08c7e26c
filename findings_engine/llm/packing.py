"""Operator 2: pack documents into sequences along a space-filling curve.

A document's vector counts its distinct tokens, hashed; a random projection of signs takes it to DIMENSIONS
coordinates, which the normal distribution maps to even cells; the cell's place on the Hilbert curve is the
document's key. Documents are range-sorted by (key, id, a hash of the ids), so equal keys (copies) split over partitions, their number follows
from the table's size, a retried task sees them in the same order, and
each partition lays its documents end to end and cuts every ``size`` tokens. What is left at its end is cut
into sequences whose lengths are powers of two, which need no padding.

The tokenised table is written to the shared folder once: the range sort reads it twice (to sample, to sort). Tasks that lay documents out drop
the vocabulary that tokenising left in their worker.

Null texts are empty texts; every document has at least the closing id. Repeated rows are documents of their
own. An empty table gives no pieces. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_vocab import load
from .common import bytes_of, forget, frugal, give_back, partitions_for, pieces, table, texts, written

SIZE, END_ID = 2048, 1
DIMENSIONS, BITS = 4, 8


def projection(vocab_size: int, dimensions: int = DIMENSIONS, seed: int = 17) -> np.ndarray:
    """A sign for each hashed token and dimension."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (vocab_size, dimensions))


def packed_signs(signs: np.ndarray) -> np.ndarray:
    """A long for each token: 16 bits for each of four dimensions, 1 where its sign is positive. Sums over up to 65,535 tokens don't overflow."""
    return sum((signs[:, d] > 0).astype(np.uint64) << np.uint64(16 * d) for d in range(4))


def cells(ids: np.ndarray, signs: np.ndarray, packed: np.ndarray | None = None, bits: int = BITS) -> np.ndarray:
    """The document's cell on the grid; without tokens the middle one. ``packed``: the signs as ``packed_signs``, where there are four dimensions."""
    held = np.zeros(len(signs), bool)
    held[ids] = True
    distinct = np.flatnonzero(held)
    n = len(distinct)
    if packed is None or n > 65_535:
        sums = signs[distinct].sum(axis=0, dtype=np.int64).tolist()
    else:
        total = int(packed[distinct].sum())
        sums = [2 * (total >> 16 * d & 65_535) - n for d in range(4)]
    root = math.sqrt(2 * max(n, 1))
    side = 1 << bits
    return np.array([min(int(0.5 * math.erfc(-x / root) * side), side - 1) for x in sums], np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(df: DataFrame, vocab: str, id_col: str, text_col: str, end_id: int = END_ID) -> DataFrame:
    """id, key, ids (little-endian, two or four bytes each, the closing id included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        v = load(vocab)
        signs = projection(v.size)
        packed, end = packed_signs(signs), np.array([end_id], v.kind).tobytes()
        for batch in pieces(batches):
            encoded = v.encoded(list(texts(batch, text_col)))
            keys = hilbert(np.array([cells(np.frombuffer(x, v.kind), signs, packed) for x in encoded]).reshape(-1, DIMENSIONS))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(keys, pa.int64()), pa.array([x + end for x in encoded], pa.binary())], names=[id_col, "key", "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, key long, ids binary")


class Packer:
    """Lays documents end to end. ``pieces`` of full sequences come out as they fill; ``finish`` gives the rest."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence, self.used = size, first_sequence, 0
        self.open: list[tuple] = []  # (document, start, ids, its tokens) in the open sequence

    def _emit(self) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, tokens in self.open:
            yield doc, start, ids, tokens, self.sequence, offset
            offset += len(ids)
        self.sequence, self.open, self.used = self.sequence + 1, [], 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.size - self.used]
            self.open.append((doc, start, part, len(ids)))
            self.used += len(part)
            start += len(part)
            if self.used == self.size:
                yield from self._emit()

    def finish(self) -> Iterator[tuple]:
        rest, left = self.open, self.used
        self.open, self.used = [], 0
        room = 1 << left.bit_length() >> 1
        for doc, start, ids, tokens in rest:
            while len(ids):
                part = ids[: room - self.used]
                self.open.append((doc, start, part, tokens))
                self.used += len(part)
                start, ids = start + len(part), ids[len(part) :]
                if self.used == room:
                    left -= room
                    room = 1 << left.bit_length() >> 1
                    yield from self._emit()


def laid(batches: Iterator[pa.RecordBatch], packer: Packer, kind: type, id_col: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """A partition's documents as pieces, in batches of those that PIECE_ROWS documents complete."""

    def out(done: list[tuple]) -> pa.RecordBatch:
        docs, starts, ids, tokens, sequences, offsets = zip(*done, strict=True)
        wide = [x.astype("<u4").tobytes() for x in ids]
        arrays = [pa.array(docs, id_type), *(pa.array(x, pa.int64()) for x in (starts, [len(x) for x in ids], [zlib.crc32(x) for x in wide], tokens, sequences, offsets))]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            ends = np.cumsum([0, *map(len, ids)])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    id_type = pa.int64()
    for batch in pieces(batches):
        id_type = batch.schema.field(id_col).type
        done = []
        for doc, ids in zip(batch.column(id_col), batch.column("ids"), strict=True):
            done += packer.add(doc.as_py(), np.frombuffer(ids.as_py(), kind))
        if done:
            yield out(done)
    if done := list(packer.finish()):
        yield out(done)


def pack(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with ``with_ids`` also ids."""
    kind = load(vocab).kind
    with frugal(df.sparkSession):
        tokens = written(tokenised(df, vocab, id_col, text_col, end_id), "tokens")
    order = ("key", id_col, F.xxhash64("ids"))  # the ids themselves are far too wide to sort by
    along = tokens.repartitionByRange(partitions_for(tokens.sparkSession, bytes_of(tokens)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        yield from laid(batches, Packer(size, TaskContext.get().partitionId() << 40), kind, id_col, with_ids)

    schema = f"{id_col} {dict(df.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return along.mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
