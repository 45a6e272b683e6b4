import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark import scale
from linkspark.operators import graph, ledger, lexical, stats, variants, vector, votes
from linkspark.sources import versioned


def neighbours(n, links):
    near = {i: set() for i in range(n)}
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def distances(near, s):
    found, queue = {s: 0}, [s]
    for x in queue:
        for y in near[x]:
            if y not in found:
                found[y] = found[x] + 1
                queue.append(y)
    return found


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    n = 60
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(50)] + [(59, x) for x in range(40, 55)]  # a hub
    return n, neighbours(n, links), spark.createDataFrame(links, "a bigint, b bigint").cache(), rng


@pytest.mark.parametrize("hot", [1000, 3])
def test_frontier_and_components(spark, world, monkeypatch, hot):
    monkeypatch.setattr(scale, "HOT_ROWS", hot)
    n, near, links, _ = world
    got = graph.frontier(links, spark.createDataFrame([(s, s) for s in range(0, n, 7)], "s bigint, node bigint"))
    rows = got.collect()
    for s in range(0, n, 7):
        far = distances(near, s)
        assert {r.node: r.dist for r in rows if r.s == s} == far
        assert all(r.parent == (min(x for x in near[r.node] if far.get(x) == r.dist - 1) if r.dist else None) for r in rows if r.s == s)
    paths = graph.walks(got, got.select("s", "node")).collect()
    assert len(paths) == len(rows) and all(p.path[0] == p.s and p.path[-1] == p.node and all(b in near[a] for a, b in itertools.pairwise(p.path)) for p in paths)
    least = {i: min(distances(near, i)) for i in range(n)}
    assert {r.node: r.component for r in graph.components(spark.range(n).toDF("node"), links).collect()} == least


def test_a_chain_is_one_component(spark):
    links = spark.range(1, 700).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.component for r in graph.components(spark.range(700).toDF("node"), links).collect()} == {0}


def test_steiner_trees(spark, world):
    n, near, links, rng = world
    inside = [x for x in range(n) if len(distances(near, x)) > 10]
    wanted = {q: rng.sample(inside, 4) for q in range(3)} | {9: [inside[0], next(x for x in range(n) if x not in distances(near, inside[0]))], 10: [inside[1]]}
    rows = [(q, k, x) for q, xs in wanted.items() for k, x in enumerate(xs)]
    got = {}
    for r in graph.steiner_trees(links, spark.createDataFrame(rows, "question_id bigint, ord int, node bigint")).collect():
        got.setdefault(r.question_id, set()).add(r.node)
    for q, xs in wanted.items():
        tree = {xs[0]}
        for x in xs[1:]:
            far = distances(near, x)
            ways = sorted((far[y], y) for y in tree if y in far)
            at = ways[0][1] if ways else x
            while at != x:
                tree.add(at)
                at = min(y for y in near[at] if far[y] == far[at] - 1)
            tree.add(x)
        assert got[q] == tree


def test_running_sums_and_ranks(spark):
    rng = random.Random(2)
    values = [(i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(random.Random(3).sample(values, 500), "i bigint, v bigint").repartition(7)
    want = dict(zip([i for i, _ in values], itertools.accumulate([0, *(v for _, v in values)]), strict=False))
    assert {r.i: r.s for r in scale.running_sum(df, F.col("v"), F.col("i"), name="s").collect()} == want
    assert {r.i: r["__rank"] for r in scale.numbered(df, F.col("i")).collect()} == {i: i for i in range(500)}
    calls = df.select("i", (F.col("v") / 10).alias("cost_usd"))
    got = {r.i: (round(r.prior_usd, 6), r.cap_state) for r in ledger.running(calls, 100.0, "i").collect()}
    assert got == {i: (round(want[i] / 10, 6), "blocked" if want[i] >= 1000 else "exceeded" if want[i] + v > 1000 else "ok") for i, v in values}
    assert scale.numbered(df.limit(0), F.col("i")).count() == 0


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(scale, "CUTS", 4)
    rng = random.Random(4)
    draw = {"double": lambda: rng.choice([rng.gauss(0, 1), 5.0, None, 1e9 * rng.random(), -7.25]), "bigint": lambda: rng.choice([rng.randint(-5, 5), None, rng.randint(0, 10**12)])}[kind]
    rows = [(rng.choice("ab"), draw()) for _ in range(600)] + [("c", None), ("d", draw() or type(draw() or 1)(1))]
    shares = (0.0, 0.013, 0.5, 0.75, 1.0)
    got = {r.g: r.quantiles for r in scale.quantiles(spark.createDataFrame(rows, f"g string, v {kind}"), "v", shares, ["g"]).collect()}
    assert set(got) == {"a", "b", "d"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for x, v in rows if x == g and v is not None], shares), rtol=1e-12)


def test_p_values(spark):
    pairs = [(5, 1), (17, 0), (0, 0), (12, 12), (2, 20), (600, 500), (3000, 2900), (40, 900)]
    for r in spark.createDataFrame(pairs, "b bigint, c bigint").select("b", "c", stats.exact_p(F.col("b"), F.col("c")).alias("p")).collect():
        n, k = r.b + r.c, min(r.b, r.c)
        assert r.p == pytest.approx(min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n))), rel=1e-9)
    z = [0.0, 0.001, 0.5, 1.9, 1.999, 2.0, 2.5, 5.0, 10.0, 25.0]
    for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.erfc(F.col("z")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.z), rel=1e-10)


def test_products_in_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(90, 8)), 1).astype(np.float32)
    vectors[40:60] = vectors[20:40]  # ties
    labels = rng.integers(0, 3, 90)
    rows = [(i, int(labels[i]), vectors[i].tolist()) for i in range(90)]
    e = spark.createDataFrame(rows, "ord bigint, label int, vec array<float>")
    q = e.where("ord % 20 = 0").withColumnRenamed("ord", "question_id")
    scores = vectors.astype(float) @ vectors.astype(float).T
    for size in (7, 1000):
        got = {}
        for r in vector.best_products(q, e, 5, rows=size).orderBy("question_id", "rank").collect():
            got.setdefault(r.question_id, []).append(r.ord)
        assert got == {i: sorted((j for j in range(90) if j != i), key=lambda j: (-scores[i, j], j))[:5] for i in range(0, 90, 20)}  # noqa: B023
        sums = vector.product_sums(q, e, 0.0, 1.0, 4, rows=size).collect()
        every = [(bool(labels[i] == labels[j]), scores[i, j]) for i in range(0, 90, 20) for j in range(90) if i != j]
        assert sum(r.n for r in sums) == len(every) and sum(r.total for r in sums if r.is_gold) == pytest.approx(sum(s for g, s in every if g))
        assert sum(r.n for r in sums if r.bin == 0) == sum(s < 0 for _, s in every) and {r.bin for r in sums} <= set(range(6))


def test_votes_beyond_one_word(spark):
    rng = random.Random(6)
    rows = [(q, rng.randrange(200), pos, rng.choice("abc")) for q in range(3) for pos in range(150)]
    got = {(r.question_id, r.t): (r.votes, tuple(r.first)) for r in votes.tally(spark.createDataFrame(rows, "question_id bigint, sample_idx int, pos int, t string"), "t").collect()}
    want = {}
    for q, s, pos, t in rows:
        want.setdefault((q, t), []).append((s, pos))
    assert got == {k: (len({s for s, _ in v}), min(v)) for k, v in want.items()}


def test_walk_of_json(spark):
    rows = [('{"a": [1, {"b": null}, "x"], "c": {"d": true}}',), ("[]",), ("7",), ('{"a": {"a": {"a": {}}}}',), (None,), ("no json",)]
    v = spark.createDataFrame(rows, "j string").select(F.try_parse_json("j").alias("v"))
    got = {(r.depth, r.key, r.kind): r.n for r in variants.shape(v).collect()}
    assert got == {
        (0, None, "object"): 2, (0, None, "array"): 1, (0, None, "number"): 1, (1, "a", "array"): 1, (1, "c", "object"): 1, (1, "a", "object"): 1, (2, None, "number"): 1, (2, None, "object"): 1,
        (2, None, "string"): 1, (2, "d", "boolean"): 1, (2, "a", "object"): 1, (3, "b", "null"): 1, (3, "a", "object"): 1,
    }
    with pytest.raises(ValueError, match="deeper"):
        variants.walk(v, most=2)


def test_versioned_tables(spark, tmp_path):
    path, row = str(tmp_path / "t"), "k bigint, name string, v int"
    versioned.create(spark.createDataFrame([(i, "x", i) for i in range(50)], row), path, ["k"], 4)
    versioned.upsert(spark.createDataFrame([(3, "y", 0), (3, "z", 1), (99, "n", 2)], row), path)
    now = versioned.read(spark, path)
    assert now.count() == 52 and sorted(r.name for r in now.where("k = 3").collect()) == ["y", "z"] and versioned.read(spark, path, 1).count() == 50
    assert versioned.versions(spark, path) == [1, 2] and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("v1") and not any(p.iterdir())]
    new = spark.createDataFrame([(5, "q", 0)], row).repartition(4, "k")
    plan = versioned.kept(now, new, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the new rows', not the table's
    # a second writer that began with version 1
    with pytest.raises(versioned.Conflict):
        versioned.commit(new, path, ["k"], 4, 2)
    assert versioned.read(spark, path).count() == 52
    with pytest.raises(Exception, match="a key is null"):
        versioned.upsert(spark.createDataFrame([(None, "q", 0)], row), path)
    with pytest.raises(versioned.Conflict):
        versioned.create(new, path, ["k"], 4)


@pytest.mark.parametrize("fuzzy, least", [("levenshtein", 80), ("partial_ratio", 80), ("partial_ratio", 60)])
def test_indexes_of_names_lose_nothing(spark, fuzzy, least):
    rng = random.Random(3)
    parts = ["red", "blue", "green", "ring", "bolt", "plate", "a", "ab", "xy_z", "large", "small", "gear", "order_key", "name"]
    questions = []
    for i in range(150):
        text = " ".join(rng.choice(parts).replace("_", " ") for _ in range(rng.randint(0, 5)))
        questions.append((i, rng.choice("de"), "".join(c if rng.random() > 0.08 else rng.choice(["", c + "q", "z"]) for c in text)))
    names = [(rng.choice("de"), "table", k, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) if k else "") for k in range(60)]
    q = spark.createDataFrame(questions, "question_id bigint, db_id string, question string")
    n = spark.createDataFrame([(d, level, o, x, None, x) for d, level, o, x in names], "db_id string, level string, ord int, t string, c string, name string")
    every = lexical.scores(q, n, fuzzy, 0.0).where((F.col("strategy") != "fuzzy") | (F.col("score") >= least))
    assert sorted(map(str, lexical.scores(q, n, fuzzy, least).collect())) == sorted(map(str, every.collect()))
    counted = lexical.selectivity(q, n, fuzzy, least).first()
    assert counted.candidates < counted.pairs
