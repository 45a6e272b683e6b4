"""Document fingerprints from prefix polynomial hashes.

``Prefix`` keeps, for two bases modulo 2^31 - 1, the sums of code * base^i over all prefixes.  The hash of a span is the
difference of two entries times base^-start, so any two spans, of one text or of two, are compared in constant time, and
the longest common extension of two places is found by binary search.

A fingerprint is the whole text's hash and, from the hashes of all spans of 10 and of 3 code points, the least hash in each
of 112 and 16 slots.  Likeness is the share of equal slots among those that either text fills, an estimate of the Jaccard
similarity of their spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import arrow_map, id_text, sha

P = (1 << 31) - 1
#: Two bases.
BASES = (1_000_003_349, 1_500_450_271)
#: Length of spans, and slots for them.
SCALES = ((10, 112), (3, 16))
EMPTY = 0xFFFF


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P for 0 <= x < 2^62."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


class _Powers:
    """Powers of a number modulo P, doubled as longer texts come."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.int64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            self.known = np.concatenate([self.known, _mod(self.known * pow(self.base, len(self.known), P))])
        return self.known[:n]


_UP = tuple(_Powers(b) for b in BASES)
_DOWN = tuple(_Powers(pow(b, P - 2, P)) for b in BASES)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


class Prefix:
    """Prefix hashes of code points."""

    def __init__(self, values: np.ndarray):
        self.n = n = len(values)
        self.sums = tuple(np.concatenate([np.zeros(1, np.int64), _mod(np.cumsum(_mod(values * up(n))))]) for up in _UP)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of the span, the same wherever it stands."""
        return tuple(int((s[end] - s[start]) % P * int(down(start + 1)[start]) % P) for s, down in zip(self.sums, _DOWN, strict=True))

    def same(self, start: int, other: Prefix, at: int, length: int) -> bool:
        return start + length <= self.n and at + length <= other.n and self.span(start, start + length) == other.span(at, at + length)

    def extension(self, start: int, other: Prefix, at: int) -> int:
        """Length of the longest common extension to the right, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width``; of a shorter text, none."""
        count = self.n - width + 1
        if count <= 0:
            return np.zeros(0, np.int64)
        one = self.sums[0]
        return _mod(_mod(one[width:] - one[:count] + P) * _DOWN[0](count))

    def whole(self) -> str:
        return "".join(f"{x:08x}" for x in self.span(0, self.n)) if self.n else "0" * 16


def slots(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value in each slot; all ones where there is none."""
    mixed = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    least = np.full(count, (EMPTY << 16) | 0xFFFF, np.uint64)
    value = np.minimum((mixed >> np.uint64(8)) & np.uint64(0xFFFFFFFF), np.uint64((EMPTY << 16) - 1))
    np.minimum.at(least, ((mixed >> np.uint64(40)) % np.uint64(count)).astype(np.intp), value)
    return least


def _name(least: np.ndarray) -> np.ndarray:
    """A minimum's low bits: its high bits are small for any long text."""
    return np.where(least >= np.uint64(EMPTY << 16), EMPTY, np.minimum(least & np.uint64(0xFFFF), EMPTY - 1)).astype(np.int64)


class Sketch:
    """A text's prefix hashes and the minima by slot."""

    def __init__(self, text: str):
        self.text = text
        self.values = codes(text)
        self.prefix = Prefix(self.values)
        self.hashes = [self.prefix.spans(width) for width, _ in SCALES]
        self.least = [slots(h, count) for h, (_, count) in zip(self.hashes, SCALES, strict=True)]
        self.hex = self._hex(self.prefix.whole(), self.least)

    @staticmethod
    def _hex(whole: str, least: list[np.ndarray]) -> str:
        return whole + "".join(f"{x:04x}" for part in least for x in _name(part).tolist())

    def edited(self, text: str, kept: int) -> str:
        """The fingerprint of ``text``, which begins with this text's first ``kept`` code points: only spans beyond are hashed."""
        least = []
        tail = codes(text[max(0, kept - max(w for w, _ in SCALES) + 1) :])
        lost = max(0, kept - max(w for w, _ in SCALES) + 1)
        rest = Prefix(tail)
        for (width, count), own in zip(SCALES, self.hashes, strict=True):
            shared = max(0, kept - width + 1)
            new = rest.spans(width)[max(0, shared - lost) :]
            least.append(np.minimum(slots(own[:shared], count), slots(new, count)))
        values = codes(text[kept:])
        whole = []
        for i, up in enumerate(_UP):
            total = int(self.prefix.sums[i][kept]) + int(_mod(np.cumsum(_mod(values * up(kept + len(values))[kept:])))[-1] if len(values) else 0)
            whole.append(f"{total % P:08x}")
        return self._hex("".join(whole) if text else "0" * 16, least)


def fingerprint(text: str) -> str:
    return Sketch(text).hex


def likeness(a: str, b: str) -> float:
    """Share of equal slots among those filled in either; of two texts without spans, whether the whole hashes agree."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), ">u2") for s in (a, b))
    filled = (x != EMPTY) | (y != EMPTY)
    return float((x == y)[filled].sum() / filled.sum()) if filled.any() else 0.0


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_prefix")
_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_prefix long"


def _row(doc_id, own: Sketch, following: Sketch) -> tuple:
    n = len(own.text)
    cut = n // 3
    text = own.text[: n - cut] + following.text[:cut]
    edited = own.edited(text, n - cut)
    return doc_id, n, sha(text), own.hex, edited, likeness(own.hex, edited), likeness(own.hex, following.hex), own.prefix.extension(0, following.prefix, 0)


def _bucket(cuts: list[float], block: int = 64) -> Column:
    """How many of the falling ``cuts`` are above doc_id; null ids come after all.  Two levels, so many cuts take few comparisons."""
    if not cuts:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    above = lambda items: F.size(F.filter(items, lambda c: F.col("doc_id") < c))
    blocks = [cuts[i : i + block] for i in range(0, len(cuts), block)]
    k = above(F.array(*[F.lit(b[0]) for b in blocks]))
    inside = above(F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), F.greatest(k, F.lit(1))))
    return F.when(F.col("doc_id").isNull(), len(cuts) + 1).when(k == 0, 0).otherwise((k - 1) * block + inside)


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document its fingerprint, that of the edited text, and their likeness; see FIELDS.

    The edited text replaces the last third of the code points by the first as many of the next document, by descending
    doc_id, null ids last, ties by text; after the last document comes the first.  same_prefix is the longest common
    extension of both documents' starts.  A null text is empty; a single document is its own next; other columns are not read;
    an empty table gives an empty result.

    Ids are cut at quantiles into ``parts`` ranges (by default the session's shuffle partitions).  The first document of a
    range is added to the range before it as its end, one text a range; then texts are dealt out by range, once, and each
    partition is read as a stream, one document ahead.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_text(docs)
    cuts = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bucket = _bucket(sorted(set(cuts), reverse=True)).alias("bucket")
    # one row a range: its greatest id
    firsts = sorted((r["bucket"], r["first"]) for r in rows.select("doc_id", bucket).groupBy("bucket").agg(F.max("doc_id").alias("first")).collect())
    ends = [(b, first, firsts[i - 1][0]) for i, (b, first) in enumerate(firsts)]
    heads = spark.createDataFrame(ends, "bucket int, first long, before int")
    placed = rows.select(bucket, "doc_id", "text")
    held = placed.join(F.broadcast(heads), "bucket").where(F.col("doc_id").eqNullSafe(F.col("first")))
    held = held.groupBy("before", "doc_id").agg(F.min("text").alias("text"))
    every = placed.withColumn("end", F.lit(0)).unionByName(held.select(F.col("before").alias("bucket"), "doc_id", "text", F.lit(1).alias("end")))
    dealt = every.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "end", F.col("doc_id").desc_nulls_last(), "text")

    def stream(batches):
        last = None
        for b in batches:
            columns = [b.column(dealt_names.index(n)).to_pylist() for n in ("doc_id", "text", "end")]
            for a in range(0, b.num_rows, 500):
                done = []
                for doc_id, text, end in zip(*(c[a : a + 500] for c in columns), strict=True):
                    own = Sketch(text)
                    if last is not None:
                        done.append(_row(*last, own))
                    last = None if end else (doc_id, own)
                if done:
                    yield dict(zip(FIELDS, map(list, zip(*done, strict=True)), strict=True))

    dealt_names = dealt.columns
    return arrow_map(dealt, stream, _TYPES)
