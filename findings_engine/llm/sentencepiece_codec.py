"""Operator 1: SentencePiece encoding and decoding of whole texts in Arrow batches.

Nulls and empty texts encode to no ids and decode to the empty text; repeated rows give repeated rows;
an empty table gives none. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table, texts
from .merge_vocab import load


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256; with ``full`` also ids (array<int>) and decoded.

    ``model`` is the path of a merge-type model on every executor. No shuffle: each row is worked on where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(model)
        for batch in pieces(batches):
            rows = vocab.encode_decode(list(texts(batch, text_col)))
            columns = [
                batch.column(id_col),
                pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in rows], pa.int64()),
                pa.array([_sha256(ids) for ids, _ in rows], pa.string()),
                pa.array([_sha256(decoded) for _, decoded in rows], pa.string()),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array([[int(i) for i in ids.split(",")] if ids else [] for ids, _ in rows], pa.list_(pa.int32())), pa.array([d for _, d in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(df.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return df.select(id_col, text_col).mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), full=False)
