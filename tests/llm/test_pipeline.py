"""The corpus pipeline as a whole and each stage's wrapper, on odd rows, an empty table and clashing names."""

import numpy as np
import pytest

import corpus_pipeline
from findings_engine.llm import near_copies, secrets_scan

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", base string, found int, runs int, added int, score string, key string, node int, hits int, label int, quality int, toxic int, root int, text_view int"


def rows():
    rng = np.random.default_rng(9)
    words = ["plain", "words", "make", "a", "text", "of", "lines", "and", "more", "still", "other", "things", "to", "say"]
    good = [" ".join(rng.choice(words, 60)) for _ in range(160)]
    bad = [" ".join(f"{w}%%%" for w in rng.choice(words, 60)) for _ in range(80)]
    toxic = [" ".join(rng.choice(words, 40)) + " you worthless idiot" for _ in range(60)]
    odd = [None, "", "   ", "token = abcdefgh1234567 and more words", good[0], good[0], good[1] + " end", "x" * 30_000, "\n" * 5000]
    texts = good + bad + toxic + odd
    labels = [(i, int(i < 160 or i >= 240), int(240 <= i < 300)) for i in range(0, 300, 2)]
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)] + [(3, good[3], "en", "s0", 5), (None, "no id at all", None, None, None)], labels


def write(spark, tmp_path, docs, labels, more="", values=()):
    spark.createDataFrame([(*r, *values) for r in docs], SCHEMA + more).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_and_its_stages(spark, tmp_path):
    docs, labels = rows()
    sf = write(spark, tmp_path, docs, labels, CLASHING, ("mine", 1, 2, 3, "s", "k", 4, 5, 6, 7, 8, 9, 10))
    df, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, sf).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = after.collect()
        if name != "packing":
            assert after.columns == df.columns and all((r.base, r.found, r.hits) == ("mine", 1, 5) for r in kept[name])
            df = after
    ids = {name: {r.doc_id for r in found} for name, found in kept.items()}
    assert not ids["quality"] & set(range(160, 240)) and set(range(160)) <= ids["quality"]
    assert not ids["toxicity"] & set(range(240, 300)) and set(range(160)) <= ids["toxicity"]
    assert ids["near_copies"] >= set(range(1, 160)) | {0} and not ids["near_copies"] & {304, 305, 306}
    assert ids["secrets"] == ids["near_copies"] == ids["packing"]
    before, after = ({r.doc_id: r for r in kept[name]} for name in ("near_copies", "secrets"))
    assert after[303].text == "[SECRET] and more words" and after[303].n_chars == 23
    assert all(after[i].text == before[i].text for i in after if i != 303)
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id: r.doc_tokens for r in kept["packing"]}


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_near_copies_by_all_pairs(spark):
    """What goes are rows of which a chain of pairs of 0.8 and more leads to a kept one; every such pair within the links is found."""
    docs, _ = rows()
    df = spark.createDataFrame(docs, SCHEMA)
    left = {r.doc_id for r in near_copies.keep_one(df).collect()}
    sets = {i: near_copies.shingles((t or "").encode()) for i, t, *_ in docs if i is not None}
    alike = lambda a, b: a == b or near_copies.similar(a, b)
    for i in set(sets) - left:
        assert any(j < i and alike(sets[i], sets[j]) for j in sets)
    for i in left - {None}:
        assert not any(j < i and sets[i] == sets[j] for j in left - {None})


def test_secrets_stage_masks_what_the_scan_finds(spark):
    df = spark.createDataFrame([(1, "password=hunter2hunter2 x", None, None, 25), (2, None, None, None, None)], SCHEMA)
    out = {r.doc_id: r for r in corpus_pipeline.secrets_stage(spark, df, "").collect()}
    assert (out[1].text, out[1].n_chars, out[2].text, out[2].n_chars) == ("[SECRET] x", 10, None, None)
    assert secrets_scan.scan(df).filter("size(found) > 0").count() == 1
