import random

import numpy as np
import pytest
import xxhash

from linkspark.llm import neardup as N


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    s = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n ", "One", "A b C", "é É Ä a\tb c d e", "a a a a a a", "x " * 3000, "\x0bA\x0cb\rc d e f"])
def test_simhash(text):
    assert N.simhash(text.encode()) == plain(text)


def test_golay_lists_are_complete():
    half, patterns, count = N.golay()
    assert len(count) == 2048 and count.sum() == 1 + 23 + 253 + 1771 + 8855 and set(count.tolist()) == {1, 6}
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(1 << 23))
        b = a
        for bit in rng.choice(23, rng.integers(0, 3), replace=False):
            b ^= 1 << int(bit)
        lists = [set(N.near_codewords(np.array([x]))[0][0][N.near_codewords(np.array([x]))[1][0]].tolist()) for x in (a, b)]
        assert lists[0] & lists[1]


def test_every_close_pair_shares_a_key():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        keys = [set(N.keys_of(np.array([N.signed(x)], np.int64))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def classes(values):
    """Component numbers by brute force."""
    names = list(range(len(values)))

    def root(x):
        while names[x] != x:
            x = names[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                names[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_large_buckets_are_searched_by_blocks(monkeypatch):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    values |= {v ^ (1 << rng.randrange(64)) ^ (1 << 63) for v in values}
    values = sorted(values)
    for most in (10, 10_000):
        monkeypatch.setattr(N, "LARGE_BUCKET", most)
        out = []
        N.bucket_edges(np.array(values, np.uint64), np.arange(len(values)), out)
        names = list(range(len(values)))
        for a, b in out:
            for x, y in zip(a.tolist(), b.tolist()):
                old, new = names[x], names[y]
                names = [min(old, new) if n in (old, new) else n for n in names]
        assert names == classes(values)


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    values = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6])):
            values.append(x)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
    values += [0, 1, 3, (1 << 64) - 1] + [values[0] ^ (1 << b) for b in range(60)]
    values = sorted(set(values), key=lambda v: N.signed(v))
    reps = spark.createDataFrame([(N.signed(v), N.signed(v)) for v in values], "fp long, rep long")
    roots = {r.node: r.root for r in N.components(N.edges(reps)).collect()}
    want = classes(values)
    for v, c in zip(values, want):
        assert roots.get(N.signed(v), N.signed(v)) == N.signed(values[c])


def test_long_chain_and_star(spark):
    chain = [(i + 1, i) for i in range(200)] + [(1000 + i, 999) for i in range(1, 300)]
    rng = random.Random(1)
    rng.shuffle(chain)
    roots = {r.node: r.root for r in N.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and all(roots[1000 + i] == 999 for i in range(1, 300))


def test_documents(spark, documents):
    base = " ".join(f"word{i * 37 % 101}" for i in range(400))
    near = base.replace("word5 ", "other ", 1)
    other = " ".join(f"else{i * 7 % 89}" for i in range(300))
    rows = [(5, base), (3, base.upper()), (9, near), (7, other), (20, None), (21, ""), (22, " \n"), (None, "solo one"), (7, other), (30, "x"), (8, "long " + "é b c d " * 20_000)]
    want_fp = {d: plain(t or "") for d, t in rows}
    got = N.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows) and all(r.fp == N.signed(want_fp[r.doc_id]) for r in got)
    values = [plain(t or "") for _, t in rows]
    groups = classes(values)
    for r, in [(r,) for r in got]:
        members = [d for (d, _), g in zip(rows, groups) if g == groups[[d for d, _ in rows].index(r.doc_id)] and d is not None]
        assert r.component_id == (min(members) if members else None)
    kept = N.survivors(documents(rows))
    assert kept.columns == documents(rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({r.component_id for r in got if r.component_id is not None}) and ids.count(None) == 1
    # a row without a doc_id stays only if no other row is like it, and of equal rows one stays
    again = documents([*rows, (None, base), (None, "solo one"), (None, "alone of its kind"), (3, base.upper())])
    left = [(r.doc_id, r.text) for r in N.survivors(again).collect()]
    assert left.count((None, "solo one")) == 1 and (None, "alone of its kind") in left and (None, base) not in left and left.count((3, base.upper())) == 1
    assert N.near_duplicates(documents([])).count() == 0 and N.survivors(documents([])).count() == 0


def test_large_group_of_near_copies_gives_few_edges(spark):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    values = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    reps = spark.createDataFrame([(N.signed(v), N.signed(v)) for v in values], "fp long, rep long")
    found = N.edges(reps).cache()
    assert found.count() < 40 * len(values)
    assert len({r.root for r in N.components(found).collect()}) == 1
