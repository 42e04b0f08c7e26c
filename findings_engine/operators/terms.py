"""Which of many terms a text holds: one automaton over all terms (Aho and Corasick) and one pass over the text, however many there are.

Each text is read once for each part of the terms, at a cost of its length and of what is found. A part has at most PART characters of terms, so what a
task holds is bounded; it is broadcast. Terms and texts are compared in lower case, terms as they stand elsewhere. An empty term is in every text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters of a part's terms; the automaton takes some 30 bytes for each.
PART = 4_000_000


def automaton(terms: list[str]):
    """None without terms."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for t in terms:
        made.add_word(t, t)
    if not terms:
        return None
    made.make_automaton()
    return made


def parts_of(terms: DataFrame, term: str, size: int = PART) -> list[list[str]]:
    """The distinct terms in lower case, in parts. They reach the driver, a part at a time being sent on from it."""
    out, held = [[]], 0
    for r in terms.select(F.lower(F.col(term)).alias("t")).filter("t <> ''").distinct().orderBy("t").toLocalIterator():
        if held + len(r.t) > size and out[-1]:
            out.append([])
            held = 0
        out[-1].append(r.t)
        held += len(r.t)
    return out


def found_terms(df: DataFrame, cell: Column, terms: DataFrame, term: str = "term", out: str = "found", size: int = PART) -> DataFrame:
    """``df`` with ``out``: the sorted distinct terms (in lower case) that the cell holds, the empty one too if it is among the terms; null holds none but it."""
    spark = df.sparkSession
    empty = bool(terms.filter(F.col(term) == "").limit(1).count())
    columns = []
    for k, part in enumerate(parts_of(terms, term, size)):
        sent = spark.sparkContext.broadcast(part)

        columns.append(F.arrow_udf(_search(sent), ArrayType(StringType()))(F.lower(cell)).alias(f"_{out}{k}"))
    names = [f"_{out}{k}" for k in range(len(columns))]
    rows = df.select("*", *columns)
    found = F.array_sort(F.array_distinct(F.concat(F.array(*([F.lit("")] if empty else [])).cast("array<string>"), *names)))
    return rows.withColumn(out, found).drop(*names)


def _search(sent: Broadcast):
    kept = {}  # a worker makes the automaton once

    def search(texts: pa.Array) -> pa.Array:
        if "made" not in kept:
            kept["made"] = automaton(sent.value)
        made = kept["made"]
        return pa.array([sorted({t for _, t in made.iter(x)}) if made and x else [] for x in texts.to_pylist()], pa.list_(pa.string()))

    return search


def held_by_own(df: DataFrame, cell: Column, own: str, out: str = "holds") -> DataFrame:
    """``df`` with ``out``: whether the cell holds one of the row's own terms (the array ``own``), as ``scan.contains_any`` says, by the automaton of all rows' terms."""
    terms = df.select(F.explode(own).alias("term")).distinct()
    rows = found_terms(df, F.coalesce(cell, F.lit("")), terms, "term", "_found")
    return rows.withColumn(out, F.coalesce(F.arrays_overlap("_found", F.transform(own, F.lower)), F.lit(False))).drop("_found")
