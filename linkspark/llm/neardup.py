"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  A segment, padded to 23 bits, is decoded to every
word of the perfect [23, 12, 7] Golay code within distance 4 (one word or six, 5.3 on average); a code word is named by its
12-bit index.  The code's covering radius is 3, so if two segments differ in at most 2 bits, the code word nearest to a
point midway between them is within 4 of both: they share an index.

At most 4 errors over three segments leave one of these cases:

* segments 1 and 2 have at most 2 errors each: the pair of their indices meets in a composite key of 24 bits;
* segment 1 (or 2) has 3 or more: the other two have one error between them, so one of these is equal and the other shares an
  index: they meet in a composite key of the equal segment and the other's index, 33 or 34 bits.

Hence these composite keys find every pair within 4 bits.  In a bucket, links are found by
breadth-first search over fingerprints that are not yet reached, so a dense group of m yields m - 1 edges and not m^2.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import arrow_map, checkpoint, id_text, join_hot

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (equal segment, segment of which an index is shared), if segment 1 has the errors or segment 2 has.
EXACT = ((1, 2), (2, 1), (0, 2), (2, 0))
RADIUS = 4
#: Fixed value: a generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
SHINGLE = 4
SEED = 42
#: Buckets of up to so many members are compared by shifted arrays, larger ones by search.
SMALL_BUCKET = 24
#: Above this, a bucket is searched by five exact 13-bit blocks, one of which any two fingerprints within 4 bits share.
LARGE_BUCKET = 20_000


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the UTF-8 text: A-Z lower-cased, word shingles with repeats; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long): one row per input row, whole texts."""

    def rows(batches):
        for b in batches:
            yield {"doc_id": b.column(0), "fp": [signed(simhash(t)) for t in b.column(1).to_pylist()]}

    return arrow_map(id_text(docs, binary=True), rows, "doc_id long, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 23-bit words' halves; by syndrome, the error patterns of weight 4 or less (padded), and how many."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = np.array([remainder(1 << b) for b in range(23)])
    half = np.zeros((2, 1 << 12), np.int64)
    for part in range(2):
        for bit in range(12 if part == 0 else 11):
            has = (np.arange(1 << 12) >> bit & 1).astype(bool)
            half[part, has] ^= single[12 * part + bit]
    by: dict[int, list[int]] = {}
    for weight in range(RADIUS + 1):
        for bits in itertools.combinations(range(23), weight):
            by.setdefault(int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0, []).append(sum(1 << b for b in bits))
    count = np.array([len(by[s]) for s in range(1 << 11)])
    patterns = np.zeros((1 << 11, count.max()), np.int64)
    for s, errors in by.items():
        patterns[s, : len(errors)] = errors
    return half, patterns, count


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the code words within 4 of each 23-bit word, padded, and the mask of real entries."""
    half, patterns, count = golay()
    syndrome = half[0][words & 0xFFF] ^ half[1][words >> 12]
    near = (words[:, None] ^ patterns[syndrome]) >> 11
    return near, np.arange(patterns.shape[1])[None, :] < count[syndrome][:, None]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) of all keys; a key's highest bits name its kind."""
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [near_codewords(part) for part in parts]
    (one, has_one), (two, has_two) = near[:2]
    both = (has_one[:, :, None] & has_two[:, None, :]).reshape(len(fps), -1)
    pair = ((one[:, :, None] << 12) | two[:, None, :]).reshape(len(fps), -1)
    at, column = np.nonzero(both)
    places, keys = [at], [pair[at, column]]
    for kind, (equal, other) in enumerate(EXACT, 1):
        index, has = near[other]
        at, column = np.nonzero(has)
        places.append(at)
        keys.append(kind << 40 | parts[equal][at] << 12 | index[at, column])
    return np.concatenate(places), np.concatenate(keys)


def _search(fps: np.ndarray, ids: np.ndarray, out: list) -> None:
    """Edges of a spanning forest of the links among distinct fingerprints, unsigned (bits of a negative number would not be counted)."""
    left = np.arange(len(fps))
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= RADIUS
            found = left[near]
            if len(found):
                out.append((np.full(len(found), ids[at]), ids[found]))
                stack.extend(found.tolist())
                left = left[~near]


def bucket_edges(fps: np.ndarray, ids: np.ndarray, out: list) -> None:
    if len(fps) <= LARGE_BUCKET:
        return _search(fps, ids, out)
    for block in range(5):
        value = (fps >> np.uint64(13 * block)) & np.uint64(0x1FFF)
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                _search(fps[part], ids[part], out)
    return None


def _edges(batches):
    """Rows come sorted by key.  A key's rows may span batches; the last key of a batch waits for the next."""

    def links(key, fp, rep):
        out: list = []
        if len(key) < 2:
            return out
        fp = fp.view(np.uint64)
        cut = np.flatnonzero(np.diff(key)) + 1
        start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = stop - start
        large = size > SMALL_BUCKET
        for a, b in zip(start[large], stop[large], strict=True):
            bucket_edges(fp[a:b], rep[a:b], out)
        small = np.repeat(~large & (size > 1), size)
        key, fp, rep = key[small], fp[small], rep[small]
        for shift in range(1, SMALL_BUCKET):
            same = key[shift:] == key[:-shift]
            if not same.any():
                break
            hit = same & (np.bitwise_count(fp[shift:] ^ fp[:-shift]) <= RADIUS)
            if hit.any():
                out.append((rep[:-shift][hit], rep[shift:][hit]))
        return out

    def columns(out):
        a, b = (np.concatenate([x[i] for x in out]) for i in (0, 1))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        return {"a": pairs[:, 0], "b": pairs[:, 1]}

    kept: list[list[np.ndarray]] = []
    for batch in batches:
        got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(got[0]):
            continue
        if kept and kept[0][0][-1] == got[0][0] and got[0][0] == got[0][-1]:
            kept.append(got)
            continue
        got = [np.concatenate([k[i] for k in [*kept, got]]) for i in range(3)]
        last = np.searchsorted(got[0], got[0][-1])
        out = links(*(g[:last] for g in got))
        kept = [[g[last:] for g in got]]
        if out:
            yield columns(out)
    if kept:
        out = links(*(np.concatenate([k[i] for k in kept]) for i in range(3)))
        if out:
            yield columns(out)


def edges(reps: DataFrame) -> DataFrame:
    """reps: fp, rep, one row per distinct fingerprint.  Gives a > b, representatives whose links connect what is within 4 bits."""

    def keyed(batches):
        for b in batches:
            fps, rep = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a in range(0, len(fps), 4096):
                at, key = keys_of(fps[a : a + 4096])
                yield {"key": key, "fp": fps[a : a + 4096][at], "rep": rep[a : a + 4096][at]}

    keys = arrow_map(reps.select("fp", "rep"), keyed, "key long, fp long, rep long")
    dealt = keys.repartition("key").sortWithinPartitions("key", "fp")
    return arrow_map(dealt, _edges, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """node, root: connected components by alternating large-star and small-star; root is the smallest node.

    Each round at least halves the longest way to a root, so ``rounds`` suffice for any table; more are an error.  Neighbours of
    a node that many have (a root) are joined with it by a broadcast.
    """
    links = checkpoint(links)
    seen = None
    for _ in range(rounds):
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        # the star is reached when rows and sums no longer change: each round only lowers right ends
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("holders")))
        large = join_hot(both, least, ["a"], 2 * state["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # each node's neighbours are smaller ones now, few of them: no key is hot
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct()
        links = checkpoint(small)
    raise RuntimeError(f"components are not complete after {rounds} rounds")


def classes(fps: DataFrame) -> DataFrame:
    """fp, root, holders: the different fingerprints of ``fps``, the least one reachable from each (by value), and the rows it has."""
    reps = checkpoint(fps.groupBy("fp").agg(F.count("*").alias("holders")))
    # representatives must be distinct even if ids are null or repeated: name a fingerprint by itself
    roots = components(edges(reps.select("fp", F.col("fp").alias("rep"))))
    return reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "holders")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long), component_id.

    One row per input row; fingerprints within 4 bits are linked and component_id is the smallest doc_id reachable.
    A null or empty text has fingerprint 0 and links like any other.  A null doc_id counts as greater than all others for the
    choice of the smallest; a component of null ids only has a null component_id.  Rows that share a doc_id are documents of
    their own.  An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    fps = checkpoint(fingerprints(docs))
    named = checkpoint(classes(fps))
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    per = named.join(low, "fp")
    least = checkpoint(per.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("fps")))
    found = join_hot(named.select("fp", "root", "holders"), least, ["root"], named.count(), holders="fps")
    return join_hot(fps, found.select("fp", "component_id", "holders"), ["fp"], fps.count()).select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the smallest doc_id.  All columns stay.

    Rows without a doc_id come after all others, texts of one doc_id are in the order of their hashes, and of rows that agree in both
    one stays, by a hash of all columns.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = {"__id": F.col("doc_id").cast("long"), "__t1": F.xxhash64(text), "__t2": F.xxhash64(text, F.lit(1))}
    rows = docs.select("*", *(c.alias(n) for n, c in own.items()))

    def prints(batches):
        for b in batches:
            yield {"id": b.column(0), "t1": b.column(1), "t2": b.column(2), "fp": [signed(simhash(t)) for t in b.column(3).to_pylist()]}

    texts = rows.select("__id", "__t1", "__t2", text.cast("binary").alias("text"))
    fps = checkpoint(arrow_map(texts, prints, "id long, t1 long, t2 long, fp long"))
    per = fps.groupBy("fp", "id", "t1", "t2").agg(F.count("*").alias("n"))
    first = per.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2", "n")).alias("first"))
    keep = checkpoint(classes(fps).join(first, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__kept"), F.col("first.t1").alias("__k1"), F.col("first.t2").alias("__k2"), F.col("first.n").alias("__n")))
    same = lambda side: rows["__id"].eqNullSafe(side["__kept"]) & (rows["__t1"] == side["__k1"]) & (rows["__t2"] == side["__k2"])
    once, more = keep.where("__n = 1"), keep.where("__n > 1")
    kept = rows.join(once, same(once), "left_semi").select(*docs.columns)
    if more.limit(1).count():
        every = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])
        ranked = rows.join(more, same(more), "left_semi").withColumn("__rank", F.row_number().over(Window.partitionBy("__id", "__t1", "__t2").orderBy(every)))
        kept = kept.unionByName(ranked.where("__rank = 1").select(*docs.columns))
    return kept
