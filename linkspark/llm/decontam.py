"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Texts become lower-case words of letters and digits, and those become shingles of five words (a text of fewer words is one
shingle).  Similarity is weighted: shared counts of shingles over all counts (the k-th occurrence of a shingle is an element of
its own).

Windows.  A window of an item's size m can be similar to an item only if it has a least number of places (8/9 of its places,
for 0.8) with shingles that items of this size have.  All starts with so many such places are windows, in whatever order the
places stand, whichever items they belong to; equal windows are looked up once.

Candidates.  A window at similarity 0.8 has four fifths of an item's elements, so it has one of the item's rarest m / 5 + 1, by
their places in the corpus.  A window's SimHash is cut into nine blocks of seven or eight bits.  Two fingerprints within 26 bits
agree in some block but for two bits at most, so the items' blocks are listed with all neighbours within two bits, and windows
are joined to the items of their size by (size, rare shingle, block, value): all pairs within the radius that share a rare
shingle meet, and a key has the few items with one rare shingle and like fingerprints.  At similarity 0.8 the bits differ with
a probability of 0.15 each; beyond 26 of 64 bits lie fewer than one of a million such pairs, at any size (the tests draw them).

What the radius lets through is verified by its exact similarity.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import checkpoint, join_hot, short

SHINGLE = 5
#: First bit and width of each block.
BLOCKS = (*((7 * b, 7) for b in range(8)), (56, 8))
NEAR = 2
#: Beyond this, each of the nine blocks could differ in three bits.
RADIUS = (NEAR + 1) * len(BLOCKS) - 1


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of all runs of five words; of fewer words, of all; of none, no hash."""
    run = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))
    return F.when(F.size(w) >= SHINGLE, run).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def hashed(rows: DataFrame, *names: str) -> DataFrame:
    """``names`` and h, the shingles of column text.  Words are a column of their own, so no expression computes them twice."""
    return rows.withColumn("w", words(F.col("text"))).select(*names, shingles(F.col("w")).alias("h"))


def elements(window: Column) -> Column:
    """The hashes of ``window``, in any order; the k-th occurrence of a shingle has a hash of its own, so that none outweighs others."""
    row = F.sort_array(window)
    # in sorted order the occurrences of x follow its first place
    numbered = F.transform(row, lambda x, i: F.struct(x.alias("x"), (i + 2 - F.array_position(row, x)).cast("int").alias("k")))
    return F.when(F.size(F.array_distinct(window)) == F.size(window), window).otherwise(F.transform(numbered, lambda e: F.when(e["k"] == 1, e["x"]).otherwise(F.xxhash64(e["x"], e["k"]))))


def simhash(rows: DataFrame, *names: str) -> DataFrame:
    """``names`` and print, 64 bits: a bit is set where over half of the elements of column window have it.

    A window's elements follow each other, so they are summed before the shuffle.  ``names`` tell windows apart.
    """
    each = rows.select(*names, F.explode(elements(F.col("window"))).alias("element"))
    # lane k counts bit k in its low half and bit k + 32 in its high half
    lanes = [F.sum(F.shiftrightunsigned("element", k).bitwiseAND(F.lit((1 << 32) + 1))) for k in range(32)]
    sums = each.groupBy(*names).agg(F.array(*lanes).alias("lanes"), F.count("*").alias("n"))
    low, high = "2 * (lanes[k] & 4294967295L) > n", "2 * shiftrightunsigned(lanes[k], 32) > n"
    fingerprint = F.expr(f"aggregate(sequence(0, 31), 0L, (bits, k) -> bits | if({low}, shiftleft(1L, k), 0L) | if({high}, shiftleft(1L, k + 32), 0L))")
    return sums.select(*names, fingerprint.alias("print"))


def block_values(fingerprint: Column) -> Column:
    """array<struct<block, value>> of all blocks."""
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("value")) for k, (first, width) in enumerate(BLOCKS)]
    return F.array(*parts)


def neighbours(width: int) -> list[int]:
    """Masks of NEAR bits at most."""
    return [x for x in range(1 << width) if x.bit_count() <= NEAR]


def listed(prints: DataFrame, *names: str) -> DataFrame:
    """``names``, print, block and value: all values within NEAR bits of each block."""
    masks = F.array(*[F.array(*[F.lit(x) for x in neighbours(width)]) for _, width in BLOCKS])
    rows = prints.select(*names, "print", F.explode(block_values(F.col("print"))).alias("k"))
    return rows.select(*names, "print", F.col("k.block").alias("block"), F.explode(F.transform(masks[F.col("k.block")], lambda x: x.bitwiseXOR(F.col("k.value")))).alias("value"))


def candidates(theirs: DataFrame, ours: DataFrame, *names: str) -> DataFrame:
    """``names`` of theirs and item: pairs of one size m and a common rare shingle whose prints differ in RADIUS bits at most.

    theirs: ``names`` (with m), rare, print; ours: item, m, rare, print; rare: an array of shingles.
    """
    key = ["m", "rare", "block", "value"]
    rows = theirs.select(*names, F.col("print").alias("their_print"), "rare", F.explode(block_values(F.col("print"))).alias("k"))
    rows = rows.select(*names, "their_print", F.explode("rare").alias("rare"), F.col("k.block").alias("block"), F.col("k.value").alias("value"))
    own = listed(ours, "item", "m", "rare").withColumn("rare", F.explode("rare"))
    met = rows.join(short(checkpoint(own)), key)
    return met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("their_print"))) <= RADIUS).select(*names, "item").distinct()


def known_places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, doc, n, at, spot: the places of all shingles that some item has."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc"), "text")
    # outer: for an inner generator the optimizer would filter by size(h) below it, with the words computed anew for each shingle
    spots = hashed(texts, "doc_id", "doc").select("doc_id", "doc", F.size("h").alias("n"), F.posexplode_outer("h").alias("at", "spot"))
    known = items.select(F.explode("h").alias("known")).distinct()
    return checkpoint(spots.join(short(known), F.col("spot") == F.col("known")).select("doc_id", "doc", "n", "at", "spot").distinct())


def rare_shingles(items: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """``items`` and rare, an array of shingles one of which every window at the threshold has: the fewest places in the corpus first."""
    places = hits.groupBy(F.col("spot").alias("x")).agg(F.count("*").alias("places"))
    each = items.select("item", F.explode("h").alias("x")).join(places, "x", "left")
    # a window of any size shares threshold * m elements, so all but so many hold one of them
    enough = F.size("row") - F.ceil(threshold * F.size("row") - 1e-9).cast("int") + 1
    row = F.sort_array(F.collect_list(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "x"))).alias("row")
    rare = each.groupBy("item").agg(row).select("item", F.array_distinct(F.slice(F.col("row.x"), F.lit(1), enough)).alias("rare"))
    return checkpoint(items.join(rare, "item"))


def item_sized_windows(docs: DataFrame, items: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """doc_id, doc, m, start, window: all that may reach the similarity with an item of size m."""
    sizes = items.select("m", F.explode("h").alias("known")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc"), "text")
    found = hits.join(short(sizes), F.col("spot") == F.col("known")).groupBy("doc_id", "doc", "n", "m").agg(F.array_sort(F.collect_set("at")).alias("spots"))
    # similarity = shared / (m + size - shared), so shared is at least threshold (m + size) / (1 + threshold)
    size = F.least("m", "n")
    least = F.greatest(F.lit(1), F.ceil(threshold * (F.col("m") + size) / (1 + threshold) - 1e-9).cast("int"))
    found = checkpoint(found.withColumn("size", size).withColumn("least", least).where(F.size("spots") >= F.col("least")))

    # the shingles of documents with windows, without a shuffle of all texts while the list of them is short
    hit = short(found.select(F.col("doc_id").alias("hit_id"), F.col("doc").alias("hit_doc")).distinct())
    held = texts.join(hit, (F.col("doc") == F.col("hit_doc")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    held = hashed(held.dropDuplicates(["doc_id", "doc"]), F.col("doc_id").alias("held_id"), F.col("doc").alias("held_doc"))
    found = found.join(held, (F.col("doc") == F.col("held_doc")) & F.col("doc_id").eqNullSafe(F.col("held_id")))
    # a window whose first such place is the i-th holds enough of them if it reaches the one that is least - 1 further
    low = lambda i: F.greatest(F.lit(0), F.get("spots", i + F.col("least") - 1) - F.col("size") + 1)
    high = lambda i: F.least(F.get("spots", i), F.col("n") - F.col("size"))
    ranges = F.transform(F.sequence(F.lit(0), F.size("spots") - F.col("least")), lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<int>")))
    windows = found.withColumn("start", F.explode(F.array_distinct(F.flatten(ranges))))
    return windows.select("doc_id", "doc", "m", "start", F.slice("h", F.col("start") + 1, F.col("m")).alias("window"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, doc (hash of the text), item_id, similarity, window_start (in shingles): the best window of each row and item.

    benchmark: item_id, text.  Texts without words match nothing.  Of equally similar windows the first counts.  Null ids, of
    documents or items, are ids like any other; rows that agree in doc_id and text are one row.  Other columns are not read; an
    empty table on either side gives an empty result.
    """
    items = hashed(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("item_id", "text").alias("item"), "text"), "item_id", "item")
    items = checkpoint(items.dropDuplicates(["item"]).withColumn("m", F.size("h"))).where("m > 0")
    hits = known_places(docs, items)
    items = rare_shingles(items, hits, threshold)
    windows = item_sized_windows(docs, items, hits, threshold).withColumn("c1", F.xxhash64("window")).withColumn("c2", F.xxhash64("window", F.lit(1)))
    windows = checkpoint(windows)
    name = ["m", "c1", "c2"]
    contents = checkpoint(windows.groupBy(*name).agg(F.first("window").alias("window"), F.count("*").alias("holders")))
    # those that have a rare shingle of an item of their size
    rare = short(items.select("m", F.explode("rare").alias("x")).distinct())
    marked = contents.select(*name, F.explode(F.array_distinct("window")).alias("x")).join(rare, ["m", "x"]).groupBy(*name).agg(F.collect_set("x").alias("rare"))
    marked = checkpoint(contents.join(marked, name))
    theirs = simhash(marked, *name).join(marked.select(*name, "rare"), name)
    ours = simhash(items.select("item", "m", F.col("h").alias("window")), "item", "m").join(items.select("item", "rare"), "item")
    close = candidates(theirs, ours, *name)

    pairs = close.join(contents, name).join(short(items.select("item", "item_id", "h")), "item")
    count = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    shared = F.aggregate(F.array_distinct("h"), F.lit(0), lambda s, x: s + F.least(count(F.col("h"), x), count(F.col("window"), x)))
    scored = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("h") + F.size("window") - F.col("shared")))
    known = scored.where(F.col("similarity") >= threshold).groupBy(*name, "holders").agg(F.collect_list(F.struct("item_id", "similarity")).alias("items"))
    found = join_hot(windows.select("doc_id", "doc", "start", *name), checkpoint(known), name, windows.count())
    found = found.select("doc_id", "doc", "start", F.explode("items").alias("x"))
    best = found.groupBy("doc_id", "doc", F.col("x.item_id").alias("item_id")).agg(F.max(F.struct("x.similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "doc", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("int").alias("window_start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, window_start: pairs with a window of at least ``threshold``, at its best window.

    As ``matches``; rows that share a doc_id give one row an item.
    """
    best = matches(docs, benchmark, threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("window_start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("int").alias("window_start"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay.

    The text decides, so a row goes or stays whatever its doc_id is: null, or that of a contaminated row.
    """
    bad = checkpoint(matches(docs, benchmark, threshold).select(F.col("doc").alias("__bad_text")).distinct())
    return docs.join(short(bad), F.xxhash64(docs["text"]) == bad["__bad_text"], "left_anti")
