import hashlib
import math
import random
import re
import zlib
from collections import Counter

from linkspark.llm import resampling as R

ITEM = "item_id bigint, text string, doc_id int, w string, gain int, bucket int"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def found(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) of all rows, in order of rank, undrawn ones last."""
    s, t = Counter(b for _, x in docs for b in found(x)), Counter(b for x in target for b in found(x))
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000)))) for b in s}
    rows = []
    for d, x in docs:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found(x))
        rows.append((d, len(found(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = 5 * len(able) // 100
    ranked = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return Counter(ranked + [(*r[:4], None) for r in rows if r[4] < 20])


def got(docs, target):
    return Counter(tuple(r) for r in R.resample(docs, target).collect())


def test_against_brute_force(spark, documents):
    rng = random.Random(4)
    pool = ["Übung", "ÉCOLE", "two2", "Word", "x_y", "a-b", "İz", "plain", "the", "of", "日本", "Ⅷ"]
    text = lambda n: " ".join(rng.choice(pool) + rng.choice(["", "", ",", "\x7f"]) for _ in range(n))
    rows = [(d, text(rng.choice([0, 1, 2, 3, 19, 25, 60]))) for d in range(150)]
    rows += [(200, None), (201, ""), (202, "..."), (None, text(30)), (None, None), (203, text(40_000))] + [(204, rows[7][1])] * 3 + [(205, text(25))] * 40
    target = [text(30) for _ in range(6)] + [None, ""]
    items = spark.createDataFrame([(i, x, 1, "w", 2, 3) for i, x in enumerate(target)], ITEM)
    assert got(documents(rows), items) == brute(rows, target)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "some words", 1, "w", 2, 3)], ITEM)
    assert R.resample(documents([]), items).count() == 0
    rows = [(d, "one two three " * 10) for d in range(40)]
    assert got(documents(rows), items.limit(0)) == brute(rows, [])


def test_words_in_either_case(spark):
    texts = ["ABC[DEF\\x^Y_z`q{r|s}t~u@V", "Äbc ÖX", "A\x00B\x1fc/9:;", "a b", "KK", "ſs"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    assert [r.w for r in rows.select(R.words(rows["text"]).alias("w")).collect()] == [words(x) for x in texts]
