"""What operators 4, 7 and 10 learn, against plain versions over the same rows."""

import itertools
import random
import time

import numpy as np
from pyspark.sql import functions as F

from findings_engine.llm import logistic, quality, toxicity, url_rules


def slow_rules(rows, least, confidence):
    """Every set of representative tokens, and the surest rule that fits a set of tokens."""
    held = {}
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            held.setdefault(t, set()).add(k)
    stands = {}
    for t in sorted(held, key=lambda t: (len(t), t)):
        stands[frozenset(held[t])] = t
    names = sorted(t for s, t in stands.items() if len(s) >= least)
    rules = []
    for size in range(1, len(names) + 1):
        for combo in itertools.combinations(names, size):
            inside = set.intersection(*(held[t] for t in combo))
            if len(inside) >= least:
                for verdict in (True, False):
                    n = sum(rows[k][1] == verdict for k in inside)
                    if n / len(inside) >= confidence:
                        rules.append((n / len(inside), n / len(rows), len(combo), "block" if verdict else "allow", set(combo)))
    return lambda tokens: max((r[:4] for r in rules if r[4] <= set(tokens)), default=(0, 0, 0, "allow"))[3]


def test_mined_rules_by_all_token_sets(spark):
    r = random.Random(11)
    for trial in range(3):
        names = [f"t{k}" for k in range(7)]
        rows = []
        for _ in range(160):
            tokens = sorted(t for t in names if r.random() < 0.45) + (["twin-of-t0"] if trial else [])
            tokens = sorted(set(tokens) | ({"long-twin-t1"} if "t1" in tokens else set()))
            rows.append((tokens, (("t0" in tokens) ^ ("t2" in tokens)) if r.random() < 0.9 else r.random() < 0.5))
        df = spark.createDataFrame(rows, "tokens array<string>, block boolean")
        rules = url_rules.mine(df, min_confidence=0.8, min_support=0.0, min_rows=6)
        slow = slow_rules(rows, 6, 0.8)
        sets = spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(rows)], "shape string, tokens array<string>")
        got = {x.shape: x.mined for x in url_rules.match(sets, rules).collect()}
        assert [got.get(str(k), "allow") for k in range(len(rows))] == [slow(t) for t, _ in rows]
        assert rules.count() < 400


def test_shared_segments_cost_nothing(spark):
    deep = "/".join(f"s{chr(97 + k)}x" for k in range(24))
    pages = spark.createDataFrame([(i, f"http://a{i}.example.net/{deep}/{i}" if i < 60 else f"http://b.example.net/{i}") for i in range(160)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 60 and i % 10 != 0) for i in range(120)], "page_id long, block boolean")
    url_rules.judge(pages.limit(1), labels.limit(0)).collect()
    began = time.perf_counter()
    got = {x.page_id: x.verdict for x in url_rules.judge(pages, labels).collect()}
    assert got == {i: "block" if i < 60 else "allow" for i in range(160)} and time.perf_counter() - began < 40


def test_near_equal_tokens_are_bounded(spark):
    rows = [([f"t{k}" for k in range(40) if k != i % 40], i % 2 == 0) for i in range(200)]
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, block boolean"), items=8)
    assert rules.count() == 0


def test_no_number_of_tokens_is_a_cap(spark):
    """Fourteen tokens rarer than the two that decide together stand beside them."""
    r = random.Random(13)
    rows = []
    for i in range(300):
        a, b = i % 5 != 0, i % 7 > 1
        rare = r.sample(range(28), 14)
        rows.append((["a"] * a + ["b"] * b + [f"t{k:02}" for k in sorted(rare)], a and b))
    df = spark.createDataFrame(rows, "tokens array<string>, block boolean")
    mine = lambda **how: {tuple(x.antecedent): (x.verdict, x.confidence) for x in url_rules.mine(df, min_rows=60, min_confidence=0.95, **how).collect()}
    assert mine()[("a", "b")] == ("block", 1.0) and ("a", "b") not in mine(items=12)


def test_url_odd_rows(spark):
    urls = [None, "", "://", "x://", "http://" + "a." * 3000 + "com/" + "b/" * 3000, "http://q.net/?" + "&".join(f"k{i}=v" for i in range(500))] + ["http://hot.net/casino777"] * 300
    pages = spark.createDataFrame([(i, u, "t", 1) for i, u in enumerate(urls)], "page_id long, url string, shape string, n int").repartition(3)
    labels = spark.createDataFrame([(i, True) for i in range(100, 200)], "page_id long, block boolean")
    got = {x.page_id: x for x in url_rules.judge(pages, labels).collect()}
    assert len(got) == len(urls) and all(got[i].verdict == "block" for i in range(6, 306)) and all(got[i].verdict == "allow" for i in range(4))
    assert (got[0].host, got[0].path, got[2].host, got[3].host) == ("", "", "", "")


def test_pool_sums_are_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(rng.choice(["a", "bb", "ccc%", "D"], rng.integers(0, 30))), "en", f"s{i % 3}", int(i)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    numbers = quality.features(df)
    x = quality._split(quality._views([t.encode() for _, t, *_ in docs], [tuple(m) for _, _, *m in docs]))
    models = [logistic.fit(v, np.arange(len(v)) % 2) for v in x]
    least = [{1: 0.5, 0: 0.55}, {1: 0.52, 0: 0.5}]
    got = quality.pool_sums(numbers)(models, least)
    p = [m.probability(v) for m, v in zip(models, x, strict=True)]
    for k in (0, 1):
        for label in (1, 0):
            of = lambda q: q if label else 1 - q  # noqa: B023, E731
            rows = x[k][(of(p[1 - k]) >= least[1 - k][label]) & (of(p[k]) > 1 - quality.CONFIDENT)]
            n, (gradient, hessian) = got[k][label]
            want = logistic.sums(models[k], rows, np.full(len(rows), label))
            assert n == len(rows) and np.allclose(gradient, want[0]) and np.allclose(hessian, want[1])


def test_newton_steps_reach_the_fit():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    m = logistic.fit(x, y)
    w = np.zeros(4)
    for _ in range(12):
        w = logistic.newton_step(w, logistic.sums(logistic.Logistic(m.mean, m.scale, w), x, y))
    assert np.allclose(w, m.weights, atol=1e-4)


def test_quality_odd_rows(spark):
    docs = [(i, t, None, None, None, b"x") for i, t in enumerate(["", None, "x" * 300_000, "\n" * 100_000, "same", "same"])] + [(4, "same id, another text", "en", "s", -5, b"x"), (None, "no id", "en", "s", 1, b"x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, views binary")
    for labels in ([], [(0, 1, 0)], [(i, i % 2, 0) for i in range(6)], [(0, None, 0), (None, 1, 0)]):
        model = quality.train_on(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        out = quality.score(df, model).collect()
        assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)


def test_toxicity_in_tasks_equals_the_driver(spark):
    r = random.Random(5)
    clean, bad = ["the", "cat", "sat", "on", "mats"], ["idiot", "idiots", "worthless", "scum", "1diot", "loser"]
    rows = []
    for i in range(400):
        words = [r.choice(clean) for _ in range(r.randint(0, 40))] + ([r.choice(bad)] * (i % 5 == 0))
        r.shuffle(words)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, "zzz another text of an id")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train_on(df, labels)
    plain = toxicity.train([(t, y) for i, t, y in rows if spark is not None and not _held_out(i)])
    assert model.terms == plain.terms and model.common == plain.common and np.allclose(model.regression.weights, plain.regression.weights, atol=1e-8)


def _held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_no_number_of_terms_is_a_cap():
    """Three hundred words of toxic texts alone are all terms."""
    words = ["".join(c) for c in itertools.product("bcdfg", "aeiou", "klmnp", "aeiou")][:300]
    rows = [(f"{w} is said here {k}", 1) for w in words for k in range(14)] + [(f"the weather of day {k} was fine", 0) for k in range(9000)]
    toxicity_share = toxicity.LEAST_SHARE
    try:
        toxicity.LEAST_SHARE = 0.001
        terms = {t.text for t in toxicity.train(rows).terms if not t.prefix}
    finally:
        toxicity.LEAST_SHARE = toxicity_share
    assert set(words) <= terms


def test_few_labelled_rows_rank_too():
    """Six toxic rows of 56 are too few for a term; words that two of them share still tell others like them."""
    r = random.Random(8)
    bad = ["idiot", "worthless", "scum", "loser", "moron", "trash"]
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdfghklmnprst") for _ in range(r.randint(1, 4)))
    text = lambda own: " ".join(sorted([word() for _ in range(60)] + own, key=lambda w: r.random()))
    model = toxicity.train([(text([bad[k], bad[k - 1]]), 1) for k in range(6)] + [(text([]), 0) for _ in range(50)])
    assert model.terms == []
    x = lambda own, n: model.regression.probability(np.array([model.scanner().features(text(own())) for _ in range(n)]))
    toxic, clean = x(lambda: r.sample(bad, 3), 40), x(list, 40)
    assert (toxic[:, None] > clean[None, :]).mean() + (toxic[:, None] == clean[None, :]).mean() / 2 > 0.9


def test_hints_leave_a_training_row_out():
    hints = toxicity.Hints({"scum": (3, 0), "rare": (2, 0)}, 10, 400)
    assert hints.weight({"rare", "x"}) > 0 == hints.weight({"rare", "x"}, 1) and hints.weight({"scum"}) > hints.weight({"scum"}, 1) > 0


def test_quotations():
    t = 'he "said so and\nso" and “x y” it\'s "open\n\n and "closed" «a» 5" by 6" b'
    assert [t[a : b + 1] for a, b in toxicity.quotations(t)] == ['"said so and\nso"', "“x y”", '"closed"', "«a»"]
    scanner = toxicity.Scanner([toxicity.Term("idiot", False, 1, 1.0)])
    long = '"' + "word " * 30 + "idiot " + "word " * 30 + '"'
    assert [h[4] for h in scanner.hits(long)[0]] == [True] and [h[4] for h in scanner.hits(long[:-1])[0]] == [False]
    began = time.perf_counter()
    scanner.hits(('"idiot ' * 100_000) + " “" * 100_000)
    assert time.perf_counter() - began < 10


def test_url_tokens(spark):
    p = url_rules.parts(F.lit("http://A.cheap-pills.net/Casino777/mp3-download/24/x.html?ID=5&q=Free-9"))
    got = spark.range(1).select(url_rules.tokens(p)).first()[0]
    assert got == sorted({"host=a.cheap-pills.net", "host=cheap-pills.net", "host=net", "word=cheap", "word=pills", "word=net", "path=casino0", "path=mp0-download", "path=x.html", "part=casino", "part=download", "part=html", "ending=html", "query=id", "query=q", "query=q=free-0"})
