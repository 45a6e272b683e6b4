"""Line dedup by pairwise alignment of documents that share rare runs of lines.

A document is read as the sequence of its trimmed non-empty lines.  Lines alone are poor evidence (a short line occurs by
chance), so a document is listed under its least windows: runs of neighbouring lines that reach ``least`` code points, but not
without their last, or not without their first line; a line that is long enough is a window by itself.  Every common run of
two documents that reaches the bound is covered by such windows.

The home of a window is the first document that has it.  Each later holder is paired with the home alone, so a window that n
documents hold gives n - 1 pairs: whatever a document shares with any earlier one, it shares with homes.  Of a pair only the
rarity is kept, the number of holders of its rarest window.  Windows that many documents hold find their home by a broadcast,
as their rows would meet in one task otherwise.

A document then meets the line sequences of its homes, the home of its rarest window first.  Both sequences are aligned by a
patience diff over whole lines: lines unique in both are the anchors, the longest rising run of anchors is kept, and the gaps
between are aligned in turn.  Aligned runs of neighbouring lines that reach the bound are blocks and go from the later document.
What is left over has moved, and is aligned with the home again, until nothing aligns.  A line that was aligned in a run too
short for a block stays, and so does a common run that no alignment keeps together (lines that repeat in another arrangement).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import arrow_map, checkpoint, id_text, join_hot, pieces

#: Blocks with fewer code points (of trimmed lines) than this stay: a short line is no copied passage.
LEAST_BLOCK = 24
KEY = ("last", "doc", "t1", "t2")


def rising(values: list[int]) -> list[int]:
    """Positions of the longest strictly rising run of ``values``: patience sorting with back links."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            at.append(i)
        else:
            tops[pile], at[pile] = value, i
        before.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal values in two sequences, rising in both.

    Equal ends are aligned outright; of the rest, values unique in both are anchors, and the gaps between them are aligned in the
    same way.  In a gap without anchors the k-th occurrences of a value in both are its pairs.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        left, right = Counter(a[i:m]), Counter(b[j:n])
        places = {a[k]: k for k in range(i, m) if left[a[k]] == 1}
        anchors = [(places[b[k]], k) for k in range(j, n) if right[b[k]] == 1 and b[k] in places]
        if anchors:
            kept = [anchors[k] for k in rising([x for x, _ in anchors])]
            ends = [(i - 1, j - 1), *kept, (m, n)]
            out += kept
            gaps += [(p + 1, q, s + 1, t) for (p, s), (q, t) in zip(ends, ends[1:], strict=False)]
            continue
        seen: Counter = Counter()
        numbered = {}
        for k in range(i, m):
            numbered[a[k], seen[a[k]]] = k
            seen[a[k]] += 1
        seen.clear()
        pairs = []
        for k in range(j, n):
            at = numbered.get((b[k], seen[b[k]]))
            seen[b[k]] += 1
            if at is not None:
                pairs.append((at, k))
        out += [pairs[k] for k in rising([x for x, _ in pairs])]
    return sorted(out)


def blocks(home: Sequence, own: Sequence, lengths: Sequence[int], least: int = LEAST_BLOCK) -> list[tuple[int, int, int]]:
    """(first line in home, first line in own, number of lines) of all aligned blocks; ``lengths``: code points of own lines.

    The first alignment is of the whole sequences, each further one of the lines of ``own`` that none before has aligned.
    """
    out: list[tuple[int, int, int]] = []
    known = set(home)
    left = list(range(len(own)))
    while left:
        pairs = [(i, left[j]) for i, j in patience(home, [own[j] for j in left])]
        if not pairs:
            break
        start = 0
        for k in range(1, len(pairs) + 1):
            if k == len(pairs) or (pairs[k][0] - pairs[k - 1][0], pairs[k][1] - pairs[k - 1][1]) != (1, 1):
                (at, first), n = pairs[start], k - start
                if sum(lengths[first : first + n]) >= least:
                    out.append((at, first, n))
                start = k
        aligned = {j for _, j in pairs}
        left = [j for j in left if j not in aligned and own[j] in known]
    return out


def lines_of(text: str) -> list[str]:
    """The trimmed non-empty lines, by whose numbers lines are deleted."""
    return [x for x in (y.strip() for y in text.split("\n")) if x]


def least_windows(lengths: list[int], least: int) -> list[tuple[int, int]]:
    """(first, end) of all runs that reach ``least`` but not without their last, or not without their first line."""
    found, sums = set(), [0]
    for n in lengths:
        sums.append(sums[-1] + n)
    for a in range(len(lengths)):
        b = bisect_left(sums, sums[a] + least, a + 1)
        if b < len(sums):
            found.add((a, b))
    for b in range(1, len(sums)):
        a = bisect_right(sums, sums[b] - least, 0, b) - 1
        if a >= 0:
            found.add((a, b))
    return sorted(found)


def _half(x: int) -> int:
    """64 bits as a signed long."""
    return x - (1 << 64) if x >> 63 else x


def sequences(docs: DataFrame) -> DataFrame:
    """KEY, hashes and lengths of the lines: one row for each different document with lines."""

    def rows(batches):
        import xxhash

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(5)]
            read = [lines_of(t) for t in columns[4]]
            yield dict(zip((*KEY, "hashes", "lengths"), [*columns[:4], [[_half(xxhash.xxh3_64_intdigest(x)) for x in y] for y in read], [[len(x) for x in y] for y in read]], strict=True))

    found = arrow_map(keyed(docs).select(*KEY, "text"), rows, "last int, doc long, t1 long, t2 long, hashes array<long>, lengths array<int>")
    return checkpoint(found.where(F.size("hashes") > 0).dropDuplicates(list(KEY)))


def windows(read: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """KEY, h1, h2 (128 bits of hash): one row for each different window of a sequence."""

    def rows(batches):
        import numpy as np
        import xxhash

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(6)]
            out = {k: [] for k in (*KEY, "h1", "h2")}
            for *key, hashes, lengths in zip(*columns, strict=True):
                raw = np.array(hashes, np.int64).tobytes()
                for h in {xxhash.xxh3_128_intdigest(raw[8 * first : 8 * end]) for first, end in least_windows(lengths, least)}:
                    for name, value in zip(out, (*key, _half(h >> 64), _half(h & (1 << 64) - 1)), strict=True):
                        out[name].append(value)
            for part in pieces(list(out.values()), 20_000):
                yield dict(zip(out, part, strict=True))

    return arrow_map(read, rows, "last int, doc long, t1 long, t2 long, h1 long, h2 long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and KEY, the order of documents: by doc_id, those without one last, and by a hash of the text where ids agree."""
    own = id_text(docs)
    return own.select(
        "doc_id", "text", F.col("doc_id").isNull().cast("int").alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc"),
        F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"),
    )


def pairs(read: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """KEY, home struct<KEY>, rarity: each document with the homes of its windows, and the holders of the rarest of these."""
    held = checkpoint(windows(read, least))
    homes = checkpoint(held.groupBy("h1", "h2").agg(F.min(F.struct(*KEY)).alias("home"), F.count("*").alias("holders")).where("holders > 1"))
    found = join_hot(held, homes, ["h1", "h2"], held.count()).where(F.struct(*KEY) > F.col("home"))
    return found.groupBy(*KEY, "home").agg(F.min("holders").alias("rarity"))


def deletions(docs: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """KEY, removed array<int>, blocks array<struct<home, home_first, first, lines>>: documents that lose lines.

    ``removed`` numbers the non-empty lines to delete.  ``blocks``: aligned blocks that delete a line which no block before them
    does, homes in the order of rarity.  A home whose lines are all gone by then is passed over.
    """
    read = sequences(docs)
    met = checkpoint(pairs(read, least))
    homes = checkpoint(met.groupBy("home").agg(F.count("*").alias("holders")))
    lines = read.select(F.struct(*KEY).alias("home"), F.col("hashes").alias("home_hashes")).join(homes, "home")
    theirs = join_hot(met, checkpoint(lines), ["home"], met.count()).select(*KEY, "rarity", "home", "home_hashes")
    # a document's own sequence comes first
    own = read.join(met.select(*KEY).distinct(), list(KEY), "left_semi").withColumn("rarity", F.lit(0).cast("long"))
    dealt = own.unionByName(theirs, allowMissingColumns=True).repartition(*KEY).sortWithinPartitions(*KEY, "rarity", "home")
    dealt = dealt.select(*KEY, "hashes", "lengths", F.col("home.last").alias("home_last"), F.col("home.doc").alias("home_doc"), "home_hashes")

    def align(batches) -> Iterator[dict]:
        key, own, lengths, removed, kept, out = None, [], [], set(), [], []
        for b in batches:
            for *k, hashes, sizes, last, home, theirs in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if hashes is not None:
                    if removed:
                        out.append((*key, sorted(removed), kept))
                    key, own, lengths, removed, kept = k, hashes, sizes, set(), []
                    continue
                known = set(theirs)
                if all(h not in known or j in removed for j, h in enumerate(own)):
                    continue
                for at, first, n in blocks(theirs, own, lengths, least):
                    found = set(range(first, first + n))
                    if not found <= removed:
                        removed |= found
                        kept.append({"home": None if last else home, "home_first": at, "first": first, "lines": n})
            if len(out) >= 500:
                yield dict(zip((*KEY, "removed", "blocks"), zip(*out, strict=True), strict=True))
                out = []
        if removed:
            out.append((*key, sorted(removed), kept))
        if out:
            yield dict(zip((*KEY, "removed", "blocks"), zip(*out, strict=True), strict=True))

    return arrow_map(dealt, align, "last int, doc long, t1 long, t2 long, removed array<int>, blocks array<struct<home:long,home_first:int,first:int,lines:int>>")


def strip(text: str, removed: list[int]) -> str:
    """``text`` without the given non-empty lines; blank lines stay."""
    gone, pos, out = set(removed), -1, []
    for line in text.split("\n"):
        if line.strip():
            pos += 1
            if pos in gone:
                continue
        out.append(line)
    return "\n".join(out)


def dedup_lines(docs: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """doc_id, text, n_removed, removed, blocks: every row, without the blocks of lines that earlier documents have.

    A line goes if it lies in an aligned block (see the module) whose trimmed lines have ``least`` code points together; shorter
    common runs stay.  An exact copy of an earlier document loses all of its lines.  Documents are ordered by doc_id; those without one come
    last, and where ids agree the hash of the text decides.  Rows that agree in doc_id and text are one document and are treated
    alike.  A null text is empty and stays so.  Other columns are not read; an empty table gives an empty result.
    """
    gone = deletions(docs, least).select(*(F.col(k).alias(f"gone_{k}") for k in KEY), "removed", "blocks")
    rows = keyed(docs)
    same = [rows[k] == gone[f"gone_{k}"] for k in KEY]
    joined = rows.join(gone, same, "left").select("doc_id", "text", "removed", "blocks")

    def apply(batches):
        for b in batches:
            ids, texts, removed = (b.column(i).to_pylist() for i in range(3))
            removed = [x or [] for x in removed]
            blocks_ = [x or [] for x in b.column(3).to_pylist()]
            stripped = [strip(t, x) if x else t for t, x in zip(texts, removed, strict=True)]
            for part in pieces([ids, stripped, [len(x) for x in removed], removed, blocks_], 1000):
                yield dict(zip(("doc_id", "text", "n_removed", "removed", "blocks"), part, strict=True))

    return arrow_map(joined, apply, "doc_id long, text string, n_removed long, removed array<int>, blocks array<struct<home:long,home_first:int,first:int,lines:int>>")


def digest(deduped: DataFrame) -> DataFrame:
    """The lists of ``dedup_lines`` as strings, and the text as a digest."""
    homes = F.array_sort(F.array_distinct("blocks.home"))
    return deduped.select("doc_id", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.array_join(homes.cast("array<string>"), ",").alias("homes"), F.sha2("text", 256).alias("text_sha256"))
