import hashlib
import math
import zlib
from collections import Counter

import pytest

from linkspark.llm import sharding as S


def bid(key, s, w=1.0):
    u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return w / -math.log(u)


def test_rendezvous(spark, documents):
    rows = [(i, f"t{i % 7}") for i in range(400)] + [(None, None), (3, "t3"), (5, "")]
    got = S.shard(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        best = max(range(40), key=lambda s: (bid(key, s), -s))
        grown = max(range(41), key=lambda s: (bid(key, s), -s))
        assert (r.shard, r.grown_shard, r.law) == (best, grown, "key") and grown in (best, 40)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert S.shard(documents([])).count() == 0


def test_weights(spark, documents):
    weights = (1.0, 3.0)
    n = Counter(r.shard for r in S.shard(documents([(i, "x") for i in range(2000)]), weights, parts=4).collect())
    assert 0.7 < n[1] / 2000 < 0.8
    with pytest.raises(ValueError):
        S.shard(documents([(1, "x")]), (1.0, 0.0))
