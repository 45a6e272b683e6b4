import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkspark.llm import manifest as M

ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint, g int, n int, i int, leaf string, level int, root string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text, lang, source, n):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def fold(levels, at, state):
    siblings = []
    for level in levels[:-1]:
        run = at // 2 * 2
        others = [(x, run + k < at) for k, x in enumerate(level[run : run + 2]) if run + k != at]
        siblings += [x for x, _ in others]
        state = H(*[x for x, left in others if left], state, *[x for x, left in others if not left])
        at //= 2
    return siblings, state


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for k in langs:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {k: tree([leaf(*r) for r in by[k]]) for k in langs}
    over = tree([trees[k][-1][0] for k in langs])
    out = Counter()
    for g, k in enumerate(langs):
        for at, r in enumerate(by[k]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            claimed = leaf(*r[:4], r[4] if r[4] is None else r[4] + hit)
            own, state = fold(trees[k], at, claimed)
            above, state = fold(over, g, state)
            out[r[0], leaf(*r), trees[k][-1][0], over[-1][0], H(*own, *above), state, state == over[-1][0]] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4, "y") for r in rows], ROW)


@pytest.mark.parametrize("levels", [2, 10])
def test_against_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    rng = random.Random(2)
    rows = [(d, rng.choice(["", None, f"text {d}", "ü" * 9]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s", None]), rng.choice([None, d])) for d in range(90)]
    rows += [(7, "other text", "en", "s", 1), (None, "no id", "en", None, None), (1000, "alone", "zz", "s", 5), (1001, "z" * 100_000, "en", "s", 100_000)] + [(1002, "same", "de", "s", 4)] * 20
    rng.shuffle(rows)
    got = Counter(tuple(r) for r in M.verified(table(spark, rows), changed=M.tampered()).collect())
    want = brute(rows)
    assert got == want and {k[-1] for k in want} == {True, False}


def test_one_row_one_group_and_none(spark):
    for rows in ([], [(7, "x", None, None, 1)], [(d, "x", "en", "s", 1) for d in range(5)]):
        assert Counter(tuple(r) for r in M.verified(table(spark, rows), changed=M.tampered()).collect()) == brute(rows)


def test_nodes_and_untampered_proofs(spark):
    rows = [(d, f"t{d}", "en" if d % 3 else "de", "s", d) for d in range(40)]
    docs = table(spark, rows)
    nodes, proofs = M.manifest(docs)
    assert {(r.tree, r.g, r.level): r["count"] for r in nodes.groupBy("tree", "g", "level").count().collect()}["rows", 1, 1] == 13
    assert nodes.where("tree = 'groups'").count() == 3 and proofs.where(F.size("steps") == 0).count() == 0
    assert M.verified(docs).where("verified").count() == 40
