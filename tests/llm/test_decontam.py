import random
from collections import Counter

import numpy as np
import pytest

from linkspark.llm import decontam as D


def words(text):
    return [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if w]


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def brute(docs, items, threshold=0.8):
    """Best similarity over all windows of the item's size, and the first window that has it."""
    out = {}
    for d, t in docs:
        h = shingles(words(t))
        for i, x in items:
            g = shingles(words(x))
            best = None
            for s in range(max(1, len(h) - len(g) + 1)) if g and h else ():
                a, b = Counter(h[s : s + len(g)]), Counter(g)
                j = sum((a & b).values()) / sum((a | b).values())
                if j >= threshold and (best is None or j > best[0]):
                    best = j, s
            if best:
                out[(d, i)] = best
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(3, 60))) for i in range(15)] + [(90, ""), (91, None), (92, "one two")]
    docs = [(d, text(rng.randint(0, 120))) for d in range(20)]
    for d in range(20, 50):
        i, x = items[d % 15]
        w = x.split()
        if d % 3 == 1 and len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
        if d % 3 == 2 and len(w) > 30:
            w = w[1:]
        docs.append((d, f"{text(rng.randint(0, 40))}, {' '.join(w).upper()}. {text(rng.randint(0, 40))}"))
    docs += [(60, None), (61, ""), (62, "one two"), (63, f"{items[0][1]} {items[1][1]}"), (None, items[3][1])]
    return docs, items


def test_against_brute_force(spark, documents, cases):
    docs, items = cases
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, h int")
    want = brute(docs, items)
    assert len(want) > 20
    found = D.contaminated(documents(docs), table)
    got = {(r.doc_id, r.item_id): (r.similarity, r.window_start) for r in found.collect()}
    assert got.keys() == want.keys()
    for k, (j, s) in want.items():
        assert got[k][0] == pytest.approx(j) and got[k][1] == s
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    left = {r.doc_id for r in D.clean(documents(docs), table).collect()}
    assert left == {d for d, _ in docs if d not in {k[0] for k in want}} and None not in left


def test_many_copies_and_shuffled_joins(spark, documents, cases, monkeypatch):
    _, items = cases
    monkeypatch.setattr("linkspark.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr("linkspark.llm.common.HOT_ROWS", 3)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, f"start {items[2][1]} end") for i in range(200)] + [(0, f"start {items[2][1]} end")]
    got = D.contaminated(documents(rows), table).collect()
    assert {r.doc_id for r in got} == set(range(200))


def test_empty(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(documents([]), none).count() == 0 and D.contaminated(documents([(1, "a b c d e")]), none).count() == 0
    assert D.clean(documents([(1, "a")]), none).count() == 1


def test_reordered_items_against_brute_force(spark, documents):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, text(60 + 20 * i)) for i in range(4)] + [(9, text(40) + ["again"] * 40)]
    docs = [(0, text(50))]
    for i, w in items:
        for k, cut in enumerate((len(w) // 2, len(w) // 4, len(w) // 3)):
            docs.append((100 * i + k + 1, text(30) + w[cut:] + w[:cut] + text(30)))
        docs.append((100 * i + 50, w[cut:] + w[:cut]))
    join = lambda rows: [(i, " ".join(w)) for i, w in rows]
    want = brute(join(docs), join(items))
    assert len(want) >= 15
    found = D.contaminated(documents(join(docs)), spark.createDataFrame(join(items), "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.window_start) for r in found.collect()}
    assert got.keys() == want.keys()
    for k, (j, s) in want.items():
        assert got[k][0] == pytest.approx(j) and got[k][1] == s


def test_clean_marks_rows_not_ids(spark, documents):
    item = "one two three four five six seven eight"
    table = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(1, item), (1, "clean text under the same id"), (None, f"so {item} on"), (None, "clean too"), (None, None), (2, item), (2, item)]
    assert sorted(str(r.text) for r in D.clean(documents(rows), table).collect()) == ["None", "clean text under the same id", "clean too"]


def test_radius_holds_pairs_at_the_similarity():
    """100,000 pairs of windows at similarity 0.8 or little more: all within the radius."""
    rng = np.random.default_rng(7)
    most = 0
    for m, n, shared in ((5, 4, 4), (9, 9, 8), (18, 18, 16), (27, 27, 24), (45, 36, 36), (60, 48, 48), (90, 90, 80), (200, 160, 160)):
        for _ in range(7):
            both = rng.binomial(shared, 0.5, (2000, 64))
            a, b = (both + rng.binomial(size - shared, 0.5, (2000, 64)) for size in (m, n))
            most = max(most, ((2 * a > m) != (2 * b > n)).sum(1).max())
    assert 15 < most <= D.RADIUS


def test_blocks_meet_all_pairs_within_the_radius(spark):
    rng = random.Random(2)
    own = [rng.getrandbits(64) for _ in range(40)]
    theirs = [(k, x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 13, 25, 26, 27, 30])))) for k, x in enumerate(own) for _ in range(5)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = spark.createDataFrame([(k, 9, [1, k % 3], signed(x)) for k, x in enumerate(own)], "item bigint, m int, rare array<bigint>, print bigint")
    windows = spark.createDataFrame([(i, 9, [k % 3, 7], signed(x)) for i, (k, x) in enumerate(theirs)], "w bigint, m int, rare array<bigint>, print bigint")
    got = {(r.w, r.item) for r in D.candidates(windows, items, "m", "w").collect()}
    met = lambda i, k: bool({theirs[i][0] % 3, 7} & {1, k % 3})
    assert got == {(i, k) for i, (_, x) in enumerate(theirs) for k, y in enumerate(own) if (x ^ y).bit_count() <= D.RADIUS and met(i, k)}
    assert D.RADIUS == 26 and sum(width for _, width in D.BLOCKS) == 64


def test_candidates_are_few(spark):
    """A thousand random items and ten thousand random windows of one size, with rare shingles of few items: under 1 % of pairs."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rng = random.Random(9)
    row = lambda k: (k, 45, [rng.randrange(500) for _ in range(2)], signed(rng.getrandbits(64)))
    schema = "{} bigint, m int, rare array<bigint>, print bigint"
    items, windows = (spark.createDataFrame([row(k) for k in range(n)], schema.format(name)) for n, name in ((1000, "item"), (10_000, "w")))
    assert 0 < D.candidates(windows, items, "m", "w").count() < 100_000


def test_every_window_at_the_similarity_has_a_rare_shingle(spark):
    rng = random.Random(3)
    for m in (5, 9, 10, 27, 45):
        h = [rng.randrange(m) for _ in range(m)]  # with repeats
        items = spark.createDataFrame([(1, m, h)], "item bigint, m int, h array<bigint>")
        hits = spark.createDataFrame([(x,) for x in h for _ in range(rng.randint(0, 5))] or [(0,)], "spot bigint")
        rare = set(D.rare_shingles(items, hits, 0.8).first().rare)
        for _ in range(300):
            window = list(h)
            for _ in range(rng.randint(0, m)):
                if rng.random() < 0.5 and len(window) > 1:
                    window.pop(rng.randrange(len(window)))
                else:
                    window[rng.randrange(len(window))] = -rng.randrange(9)
            a, b = Counter(h), Counter(window)
            if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                assert rare & set(window)


def test_repeated_shingles_are_elements_of_their_own(spark):
    rows = spark.createDataFrame([(1, [5, 3, 5, 5, 3, 9]), (2, [1, 2, 3])], "k int, window array<bigint>")
    got = {r.k: r.e for r in rows.select("k", D.elements(rows["window"]).alias("e")).collect()}
    assert got[2] == [1, 2, 3] and len(set(got[1])) == 6 and {3, 5, 9} < set(got[1])


def test_a_shingle_of_many_items_and_documents(spark, documents):
    """Documents that share no more than one frequent shingle with a thousand items give no window."""
    rng = random.Random(6)
    common = "may also be used to"
    items = [(i, f"{common} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(1000)]
    docs = [(d, f"{' '.join(f'v{rng.randrange(10**6)}' for _ in range(10))} {common} end {d}") for d in range(10_000)] + [(20_000, items[7][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    hashed = D.hashed(table.withColumn("item", D.F.xxhash64("item_id")), "item_id", "item").withColumn("m", D.F.size("h"))
    assert D.item_sized_windows(documents(docs), hashed, D.known_places(documents(docs), hashed), 0.8).select("doc_id").distinct().count() == 1
    assert [(r.doc_id, r.item_id) for r in D.contaminated(documents(docs), table).collect()] == [(20_000, 7)]
