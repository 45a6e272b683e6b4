import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from linkspark.llm import fingerprints as P


@settings(max_examples=80, deadline=None)
@given(st.text("abé😀", max_size=40), st.text("abé😀", max_size=40), st.data())
def test_spans_and_extensions(x, y, data):
    a, b = P.Prefix(P.codes(x)), P.Prefix(P.codes(y))
    i, j = data.draw(st.integers(0, len(x))), data.draw(st.integers(0, len(y)))
    n = 0
    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
        n += 1
    assert a.extension(i, b, j) == n
    k = data.draw(st.integers(0, 8))
    assert a.same(i, b, j, k) == (i + k <= len(x) and j + k <= len(y) and x[i : i + k] == y[j : j + k])


@settings(max_examples=80, deadline=None)
@given(st.text("ab é", max_size=60), st.text("xyz ", max_size=60))
def test_composed_fingerprint_is_the_edited_texts_own(x, y):
    kept = len(x) - len(x) // 3
    text = x[:kept] + y[: len(x) // 3]
    assert P.Sketch(x).edited(text, kept) == P.fingerprint(text)


def test_likeness():
    base = " ".join(f"word{i * i % 97} of{i}" for i in range(300))
    assert P.likeness(P.fingerprint(base), P.fingerprint(base)) == 1
    near, far = P.fingerprint(base[: len(base) * 2 // 3] + "q" * 40), P.fingerprint("".join(chr(200 + i * 7 % 300) for i in range(2000)))
    assert P.likeness(P.fingerprint(base), near) > 0.4 > 0.1 > P.likeness(P.fingerprint(base), far)
    assert P.likeness(P.fingerprint(""), P.fingerprint("")) == 1 and P.likeness(P.fingerprint(""), P.fingerprint("abc def ghi")) == 0


def test_operator_against_brute_force(spark, documents):
    rows = [(i, None if i % 11 == 0 else f"text é {i} " * (i % 7) + "x" * (i % 5)) for i in range(40)] + [(7, "twin"), (None, "last of all"), (100, "long " * 30_000)]
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        f, e, n = P.fingerprint(t), P.fingerprint(edited), P.fingerprint(nxt)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, P.likeness(f, e), P.likeness(f, n)))
    for parts in (1, 5):
        got = [tuple(r)[:7] for r in P.fingerprint_edits(documents(rows).repartition(parts)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    one = P.fingerprint_edits(documents([(3, "alone")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert P.fingerprint_edits(documents([])).count() == 0
