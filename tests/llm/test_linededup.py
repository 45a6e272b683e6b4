import random

import pytest

from linkspark.llm import linededup as L

LEAST = 24
A, B, C, D = ("a line that is long enough %s" % x for x in "abcd")


def brute(rows, least=LEAST):
    """All pairs of documents, all common runs of lines; nothing of the module is used.  rows: distinct (doc_id, text)."""
    read = [(d, [x.strip() for x in (t or "").split("\n") if x.strip()]) for d, t in rows]
    out = {}
    for d, own in read:
        gone = set()
        for other in (x for o, x in read if o < d):
            run = {}
            for i in range(len(own)):
                for j in range(len(other)):
                    if own[i] == other[j]:
                        start = run.get((i - 1, j - 1), i)
                        run[i, j] = start
                        if sum(map(len, own[start : i + 1])) >= least:
                            gone |= set(range(start, i + 1))
        out[d] = sorted(gone)
    return out


def got(spark_docs):
    return {r.doc_id: list(r.removed) for r in L.dedup_lines(spark_docs).collect()}


def unique_lines(rng, n, pool):
    """Documents none of which repeats a line: there a longest rising run keeps common runs whole, and every one is found."""
    rows = []
    for d in range(n):
        lines = rng.sample(pool, rng.randint(0, min(9, len(pool)))) + ([f" own {d}"] if d % 3 == 0 else [])
        if d % 4 == 0:
            at = rng.randrange(len(pool) - 3)
            run = pool[at : at + 4]
            lines = [x for x in lines if x not in run]
            lines[1:1] = run
        rows.append((d, "\n".join(lines)))
    return rows


POOL = [f"shared line number {i} with some words" for i in range(6)] + ["short", "tiny", "ten chars.", "eleven char", "twelve chars", "x", "yz", "abc"]


@pytest.mark.parametrize("seed", [3, 5])
def test_against_all_pairs(spark, documents, seed):
    rows = unique_lines(random.Random(seed), 90, POOL)
    want = brute(rows)
    assert got(documents(rows)) == want and any(want.values()) and not all(want.values())


def test_repeated_lines_go_only_in_common_runs(spark, documents):
    """Where lines repeat, what goes is part of what any common run has; the alignment decides which part."""
    rng = random.Random(12)
    rows = [(d, "\n".join(rng.choice(POOL[4:]) for _ in range(rng.randint(0, 12)))) for d in range(80)]
    want, found = brute(rows), got(documents(rows))
    assert all(set(found[d]) <= set(want[d]) for d in want)
    assert sum(map(len, want.values())) > sum(map(len, found.values())) > 0.7 * sum(map(len, want.values()))


def test_the_alignment_decides(spark, documents, monkeypatch):
    rows = unique_lines(random.Random(3), 40, POOL)
    assert any(got(documents(rows)).values())
    monkeypatch.setattr(L, "patience", lambda a, b: [])
    assert L.blocks(["a"], ["a"], [30]) == []
    # a common run whose lines the diff aligns with other places stays, one that it keeps together goes
    monkeypatch.undo()
    home, own = ["x", "a", "y", "b", "x", "y"], ["x", "y"]
    assert L.blocks(home, own, [20, 20]) == [] and L.blocks(["b", "x", "y"], own, [20, 20]) == [(1, 0, 2)]
    # moved blocks are aligned again
    assert L.blocks(list("abcd"), list("cdab"), [15] * 4) == [(2, 0, 2), (0, 2, 2)] or L.blocks(list("abcd"), list("cdab"), [15] * 4) == [(0, 2, 2), (2, 0, 2)]


def test_hot_windows_and_homes_take_the_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr("linkspark.llm.common.HOT_ROWS", 3)
    rows = unique_lines(random.Random(8), 60, POOL)
    assert got(documents(rows)) == brute(rows)


def test_a_document_with_very_many_homes(spark, documents):
    """Ten times the limits that there were: 700 places of a line in its home, and 700 homes of one document."""
    lines = [f"a line of its own with the number {i}" for i in range(700)]
    rows = [(0, f"{A}\nmark\n" * 700), (1, f"{A}\nmark\n" * 700 + "end")] + [(10 + i, f"{x}\nrest {i}") for i, x in enumerate(lines)] + [(2000, "\n".join(lines))]
    found = {r.doc_id: r for r in L.dedup_lines(documents(rows)).collect()}
    assert found[1].text == "end" + "" and found[2000].text == "" and len(found[2000].blocks) == 700


def test_later_exact_copies_lose_all_lines(spark, documents):
    passage = f"{A}\n{B}"
    rows = [(1, f"{passage}\n{passage}"), (2, f"{passage}\n{passage}"), (3, f"own\n{passage}\nmore\n{passage}"), (4, "la\n" * 12), (5, "x\n" + "la\n" * 13), (6, "la\n" * 12)]
    rows += [(11, f"{C}\n{D}\n{A}"), (12, f"{A}\n{D}\n{C}"), (13, f"{A}\n{D}\n{C}")]
    found = {r.doc_id: r for r in L.dedup_lines(documents(rows)).collect()}
    assert found[1].n_removed == 0 and found[2].text == "" and found[3].text == "own\nmore"
    assert found[4].n_removed == 0 and found[5].removed == list(range(2, 14)) and found[6].n_removed == 12
    assert found[13].n_removed == 3 and found[12].n_removed == 3 and found[11].removed == [2]
    # of one more repeat than the home has, one stays
    assert {d: list(r.removed) for d, r in found.items()} == {**brute(rows), 5: list(range(2, 14))}


def test_copies_whose_lines_have_other_homes(spark, documents):
    short = [f"line {i}" for i in range(10)]
    rows = [(1, f"{C}\n{B}\n{A}"), (2, f"{A}\n{B}\n{C}"), *((10 + i, f"own {i}\n{x}") for i, x in enumerate(short)), (30, "\n".join(short)), (31, "x\n" + "\n".join(short))]
    found = {r.doc_id: r for r in L.dedup_lines(documents(rows)).collect()}
    assert found[2].text == "" and found[31].text == "x" and found[30].n_removed == 0
    assert [b.asDict() for b in found[31].blocks] == [{"home": 30, "home_first": 0, "first": 1, "lines": 10}]


def test_nulls_ties_and_empty(spark, documents):
    rows = [(1, f"{A}\n{B}"), (2, f"x\n {A} \n{B}\n\ny"), (2, D), (2, f"{D}\nz"), (4, "short\nshort"), (5, None), (6, ""), (None, A), (None, f"{C}\nq"), (None, C), (7, "x" * 100_000), (8, "x" * 100_000), (1, f"{A}\n{B}")]
    found = [(r.doc_id, r.text, r.n_removed) for r in L.dedup_lines(documents(rows)).collect()]
    assert len(found) == len(rows)
    assert found.count((1, f"{A}\n{B}", 0)) == 2 and (2, "x\n\ny", 2) in found and (None, "", 1) in found
    assert sum(n for d, _, n in found if d == 2) == 3  # one of the two holders of D under one id
    assert sum(n for d, _, n in found if d is None) == 2 and (5, "", 0) in found and (8, "", 1) in found
    assert L.dedup_lines(documents([])).count() == 0


def test_many_copies_stay_linear(spark, documents):
    rows = [(i, f"{A}\n{B}") for i in range(300)]
    met = L.pairs(L.sequences(documents(rows))).collect()
    assert len(met) == 299 and {(r.home.doc, r.rarity) for r in met} == {(0, 300)}


def test_patience_diff():
    pairs = L.patience
    assert pairs("abcdef", "abXdef") == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]
    assert pairs("qaaXbbYr", "saXabYbt") == [(2, 1), (3, 2), (5, 4), (6, 5)]  # anchors X and Y, then the gaps between them
    assert pairs("aaa", "aa") == [(0, 0), (1, 1)]
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(2))
        found = pairs(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
        assert bool(found) == bool(set(a) & set(b))
