"""Operator 3: token counts of a document's sections, from one encoding of the whole document.

The whole text is encoded once. Each token's character span follows from its bytes (a token that holds a part
of a character spans that character), and an interval join of the sorted spans with the sorted sections, by
binary search within the row, attributes each token. A token that crosses a boundary is allocated by ``rule``:

- ``first``: to the section of its first character (the default: prefix sums of the counts are then token offsets)
- ``last``: to the section of its last character
- ``majority``: to the section with most of its characters, the earlier of equals

``share`` splits it instead, in proportion to its characters in each section. Null texts are empty; an empty
text has one empty section. Repeated rows give repeated rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .byte_vocab import load
from .common import pieces, table, texts

RULES = ("first", "last", "majority")
#: Rows of an output batch, about.
ROWS = 20_000


def line_sections(text: str) -> np.ndarray:
    """Bounds of the text's lines, each with its line feed: n sections have n + 1 bounds."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return np.array(cuts, np.int64)


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, of ``lengths`` bytes."""
    ends = np.cumsum(lengths)
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return ends - lengths, ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte is in
    return char[ends - lengths], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each section: tokens by the rule, tokens that cross one of its bounds, tokens split by characters."""
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, ends - 1, "right") - 1, 0, n - 1)
    owner = last.copy() if rule == "last" else first.copy()
    inside = first == last
    share = np.bincount(first[inside], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for k in np.flatnonzero(~inside):
        sections = np.arange(first[k], last[k] + 1)
        held = np.minimum(ends[k], bounds[sections + 1]) - np.maximum(starts[k], bounds[sections])
        crossing[sections] += 1
        share[sections] += held / (ends[k] - starts[k])
        if rule == "majority":
            owner[k] = sections[held.argmax()]
    return np.bincount(owner, minlength=n), crossing, share


def count_tokens(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", bounds_col: str | None = None) -> DataFrame:
    """A row for each section: id, section, start, end, n_tokens, n_crossing, share, doc_tokens.

    Sections are the text's lines, or lie between the ascending character bounds in ``bounds_col``
    (array<long>, from 0 to the text's length; null or fewer than two: the whole text).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocab)
        names = [id_col, "section", "start", "end", "n_tokens", "n_crossing", "share", "doc_tokens"]

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            docs = pa.array([r[0] for r in rows for _ in range(len(r[1]) - 1)], kind)
            join = lambda k: np.concatenate([r[k] for r in rows])
            arrays = [docs, np.concatenate([np.arange(len(r[1]) - 1) for r in rows]), np.concatenate([r[1][:-1] for r in rows]), np.concatenate([r[1][1:] for r in rows]), join(2), join(3), join(4), np.concatenate([np.full(len(r[1]) - 1, r[5]) for r in rows])]
            return pa.RecordBatch.from_arrays([docs, *(pa.array(a, pa.float64() if n == "share" else pa.int64()) for a, n in zip(arrays[1:], names[1:], strict=True))], names=names)

        for batch in pieces(batches):
            all_texts = list(texts(batch, text_col))
            given = batch.column(bounds_col).to_pylist() if bounds_col else [None] * len(all_texts)
            rows, held = [], 0
            for doc, text, ids, own in zip(batch.column(id_col), all_texts, v.ids(all_texts), given, strict=True):
                bounds = line_sections(text) if not bounds_col else np.array(own, np.int64) if own and len(own) > 1 else np.array([0, len(text)])
                spans = token_spans(text, v.lengths[ids])
                rows.append((doc.as_py(), bounds, *attribute(*spans, bounds, rule), len(ids)))
                held += len(bounds)
                if held > ROWS:
                    yield out(rows, batch.schema.field(id_col).type)
                    rows, held = [], 0
            if rows:
                yield out(rows, batch.schema.field(id_col).type)

    schema = f"{id_col} {dict(df.dtypes)[id_col]}, section long, start long, end long, n_tokens long, n_crossing long, share double, doc_tokens long"
    return df.select(id_col, text_col, *([bounds_col] if bounds_col else [])).mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
