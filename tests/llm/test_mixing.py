"""Operator 12: targets by hand, exact permutations and draws, and a mix that is followed word by word."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from findings_engine.llm import mixing


def test_shares():
    # the first is capped, what it leaves is shared 1 : 2, which caps the last too
    assert mixing.shares([10, 100, 20], [3, 1, 2]) == [20, 135, 40]
    assert mixing.shares([100, 100, 100], [3, 1, 2]) == [200, Fraction(250, 3), Fraction(500, 3)]
    assert mixing.shares([0, 0], [3, 1]) == [0, 0] and mixing.shares([], []) == []
    assert mixing.shares([7], [3]) == [Fraction(21, 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutations(n):
    one, other = mixing.Permutation(n, (1, 2)), mixing.Permutation(n, (1, 3))
    image = one(np.arange(n))
    assert sorted(image.tolist()) == list(range(n))
    assert [one.place_of(int(x)) for x in image[:20]] == list(range(min(n, 20)))
    assert n < 16 or image.tolist() != other(np.arange(n)).tolist()


@pytest.mark.parametrize("size,target", [(1, 2), (3, Fraction(9, 2)), (100, 33), (100, 150), (257, 300), (256, 512), (1000, Fraction(2001, 2)), (5, 0), (0, 0)])
def test_a_source_gives_its_target(size, target):
    s = mixing.Source.of(4, size, Fraction(target), block=16)
    if not s.slots:
        assert s.words == 0
        return
    block, take = s.held(np.arange(s.slots))
    assert take.sum() == int(target + Fraction(1, 2)) and (take > 0).all()
    uses = Counter(block.tolist())
    assert max(uses.values()) - min([uses[b] for b in range(s.blocks)]) <= 1


def test_draws_are_multinomial(spark):
    """Shards of their own draws, no slot twice, none left out, whatever chance gives a source."""
    given = tuple(mixing.Source.of(k, size, Fraction(size * 3, 2), block=4) for k, size in enumerate((4000, 40, 400, 0)))
    draws = mixing.Draws(given, slots=32, group=3)
    first, counts = draws.of(1)
    assert first == 3 and (counts.sum(axis=1) == 32).all() and len({tuple(r) for r in counts}) > 1
    rows = mixing.slot_table(spark, draws).collect()
    assert len(rows) == draws.total == len({(r.shard, r.slot) for r in rows})
    for s in given:
        own = Counter((r.block, r["take"]) for r in rows if r["number"] == s.number)
        block, take = s.held(np.arange(s.slots)) if s.slots else ((), ())
        assert own == Counter(zip(map(int, block), map(int, take), strict=True))
    drawn = sum(draws.of(g)[1].sum(axis=0) for g in range(draws.groups))
    assert drawn.sum() == draws.total and drawn.tolist() != [s.slots for s in given]


def tables(spark):
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(i % 37)), ["a", "b", None, "ü", "z"][i % 5 if i % 3 else 0]) for i in range(300)]
    rows += [(500, " \t\n", "a"), (501, None, "b"), (None, "no id at all", "a"), (None, "no id at all", "a"), (600, "long " * 5000, "z")]
    rows += [(700, "same row each time", "b")] * 1500 + [(701, "tie", "b"), (701, "eit", "b"), (800, "", "empty")]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, source string, size int, at int, id string, block int")
    return rows, df


def test_mix_word_by_word(spark):
    rows, df = tables(spark)
    mix = mixing.mixed(df.repartition(5), block=16, slots=8)
    spans, texts = mix.spans().collect(), mix.texts(df).collect()
    # slots are filled without gaps, all but a source's last and short blocks wholly
    slots = defaultdict(list)
    for r in spans:
        slots[r.shard, r.slot].append((r.offset, r.length))
    for held in slots.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 16
    # the words are those of the documents, each at most twice a document
    of = {(r.shard, r.slot, r.offset): list(r.words) for r in texts}
    by_id = defaultdict(list)
    for i, t, _ in rows:
        by_id[i].append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in spans:
        assert of[r.shard, r.slot, r.offset] in [w[r.start : r.start + r.length] for w in by_id[r.id]]
    uses = Counter((r.number, r.at, r.start + k) for r in spans for k in range(r.length))
    assert max(uses.values()) <= 2
    taken = mix.taken().collect()
    assert Counter(r.id for r in taken) == Counter(i for i, _, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in taken)
    source = {"a": 0, "b": 0, None: 0, "ü": 0, "z": 0, "empty": 0}
    for _, t, s in rows:
        source[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(source, key=lambda s: (s is None, (s or "").encode()))
    targets = mixing.shares([source[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])
    of_source = defaultdict(int)
    for r in spans:
        of_source[r.number] += r.length
    for k, target in enumerate(targets):
        assert abs(of_source[k] - target) <= 0.5
    assert {(r.source_size, r.target) for r in taken} == {(source[s], float(t)) for s, t in zip(order, targets, strict=True)}


def test_reruns_agree(spark):
    _, df = tables(spark)
    one, two = (sorted(map(tuple, mixing.mixed(df.repartition(n, "text"), block=16, slots=8).taken().collect()), key=repr) for n in (2, 7))
    assert one == two


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    mix = mixing.mixed(df)
    assert mix.taken().count() == mix.spans().count() == mix.texts(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mixed(blank).taken().collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
