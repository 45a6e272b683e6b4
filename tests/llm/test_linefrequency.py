import random
import re
from collections import Counter, defaultdict

from linkspark.llm import linefrequency as L

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def normal(line):
    return re.sub(r"[ \t-\r]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def brute(rows, least, share):
    """rows: (doc_id, text, source)."""
    held, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if normal(line):
                held[host, normal(line)].add(text)
    common = {k for k, v in held.items() if len(v) > max(least, int(len(hosts[k[0]]) * share))}
    out = Counter()
    for d, text, host in rows:
        text = text or ""
        w, lines = re.findall(r"[^ \t-\r]+", text), [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        gone = sum(len(normal(x).split(" ")) for x in lines if (host, normal(x)) in common)
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        kept = not failed and len(w) - gone >= 20 and len(w) - gone >= 0.3 * len(w)
        out[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed, gone, kept] += 1
    return out


def got(docs, **options):
    return Counter(tuple(r) for r in L.quality(docs, **options).select("doc_id", *MEASURES).collect())


def corpus(n=120):
    rng = random.Random(6)
    pool = [f"Common line {i} of\tthe host, see page {i}" for i in range(4)]
    rows = []
    for d in range(n):
        own = [" ".join(f"w{rng.randint(0, 400)}{rng.choice(['', '#', 'é', '$&'])}" for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 4))]
        lines = own + rng.sample(pool, rng.randint(0, 3)) + ([own[0]] * 2 if own and d % 9 == 0 else [])
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += [(500, None, "a"), (501, "", None), (502, " \n\t\n", "a"), (None, rows[3][1], "a"), (503, "x " * 50_000, "b"), (504, "COMMON LINE 0 of the  host, see page 7\n" * 12, "a")]
    return rows + [(505, rows[5][1], rows[5][2])] * 30


def test_against_brute_force(spark, documents):
    rows = corpus()
    for least, share in ((5, 0.0), (1, 0.2)):
        want = brute(rows, least, share)
        assert got(documents(rows), least=least, share=share) == want
        assert len({k[-1] for k in want}) == 2 and any(k[-2] for k in want)


def test_hot_lines_and_hosts_by_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr("linkspark.llm.common.HOT_ROWS", 3)
    monkeypatch.setattr("linkspark.llm.common.BROADCAST_ROWS", 2)
    rows = corpus(60)
    assert got(documents(rows), least=3, share=0.01) == brute(rows, 3, 0.01)


def test_filtered_rows(spark, documents):
    marks = [a + b for a in "abcdefgh" for b in "abcde"]
    own = "a text of its own with more than twenty words " * 4
    words = lambda d: " ".join(f"{w}{marks[d]}{marks[k]}" for k, w in enumerate(own.split()))
    rows = [(d, f"Home | About\n{words(d)}\n\nAll rights reserved {d}", "h") for d in range(30)] + [(99, "Home | About\nAll rights reserved 5", "h")]
    kept = {r.doc_id: r for r in L.filtered(documents(rows)).collect()}
    assert sorted(kept) == list(range(30)) and kept[4].text == f"{words(4)}\n" and kept[4].key == 1.5
    copies = [(d, rows[0][1], "h") for d in range(40)]
    assert L.filtered(documents(copies)).count() == 40  # exact copies are one document
    assert L.filtered(documents([])).count() == 0 and L.quality(documents([])).count() == 0
