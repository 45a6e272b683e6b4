"""Merkle manifest of a dataset: a hash tree for each group of rows, a tree over the groups, and proofs looked up by coordinates.

Every row is a leaf, named by its group and its index among the group's leaves in order.  The node above the nodes 2i and 2i+1 is
node i of the next level; so the coordinates of all siblings that a leaf's proof needs follow from its index and the group's
size alone.  Proofs come from a join of these coordinates with the materialised table of nodes, and are folded in order.

A tree is climbed in rounds of LEVELS levels: a round deals nodes in runs of 2^LEVELS, builds the levels within each run and
proves each node up to the run's top, which is a node of the next round.  A leaf's whole proof is its own part, then its run's,
and so on, so no node is looked up more often than by the 2^LEVELS nodes of its run, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import checkpoint, join_hot, numbered

LEVELS = 10
#: Fixed value: the fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def height(n: Column) -> Column:
    """Levels above the leaves of a group of ``n``: the least h with 2^h >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def parents(nodes: Column) -> Column:
    """The next level of a run of nodes; a last one without a partner goes up alone."""
    pair = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))).cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def climbed(nodes: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """One round.  nodes: g, n (leaves of the group), i, digest, all at level ``base``.

    Gives the table of nodes (g, n, level, i, digest) from this level up, ``base`` + LEVELS or the group's root the last, and the
    parts of proofs (g, i, steps): an array of struct(level, sibling, left), sibling null where a node has no partner.
    """
    steps = F.least(F.lit(LEVELS), F.greatest(F.lit(0), height(F.col("n")) - base))
    runs = nodes.groupBy("g", "n", F.shiftright("i", LEVELS).alias("run")).agg(F.sort_array(F.collect_list(F.struct("i", "digest")))["digest"].alias("row"))
    ups = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(ups, F.array("row"), lambda rows, _: F.concat(rows, F.array(parents(F.element_at(rows, -1)))))
    each = runs.select("g", "n", "run", F.posexplode(levels).alias("up", "row"))
    first = F.expr(f"shiftleft(run, {LEVELS} - up)")
    table = each.select("g", "n", (F.lit(base) + F.col("up")).alias("level"), first.alias("first"), F.posexplode("row").alias("k", "digest"))
    table = checkpoint(table.select("g", "n", "level", (F.col("first") + F.col("k")).alias("i"), "digest"))

    # what stands at level base + up beside node i >> up, if that level is so long
    wanted = nodes.where(steps > 0).select("g", "n", "i", F.explode(F.sequence(F.lit(0), steps - 1)).alias("up"))
    place = F.expr("shiftright(i, up)")
    length = F.expr(f"shiftright(n - 1, {base} + up) + 1")
    wanted = wanted.select("g", "i", (F.lit(base) + F.col("up")).alias("level"), place.bitwiseXOR(F.lit(1).cast("long")).alias("at"), (place % 2 == 1).alias("left"), length.alias("length"))
    held = table.select("g", "level", F.col("i").alias("at"), "digest")
    found = wanted.where("at < length").join(held, ["g", "level", "at"]).select("g", "i", "level", "digest", "left")
    alone = wanted.where("at >= length").select("g", "i", "level", F.lit(None).cast("string").alias("digest"), "left")
    proofs = found.unionByName(alone).groupBy("g", "i").agg(F.sort_array(F.collect_list(F.struct("level", F.col("digest").alias("sibling"), "left"))).alias("steps"))
    return table, proofs


def trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """leaves: g, n, i, digest.  Gives all nodes (g, level, i, digest), the roots (g, root) and whole proofs (g, i, steps).

    Leaves of a group with one leaf only have no proof row: they are the root.
    """
    most = leaves.agg(F.coalesce(F.max(height(F.col("n"))), F.lit(0)).alias("h")).first().h
    level, tables, parts = leaves, [], []
    for base in range(0, max(1, most), LEVELS):
        table, proofs = climbed(level, base)
        parts.append(proofs)
        tables.append(table if not tables else table.where(F.col("level") > base))
        level = checkpoint(table.where((F.col("level") == base + LEVELS) & (height(F.col("n")) > base + LEVELS)).select("g", "n", "i", "digest"))
    nodes = tables[0]
    for table in tables[1:]:
        nodes = nodes.unionByName(table)
    # from the top: a run's proof continues those of its nodes
    whole = parts[-1]
    for proofs in reversed(parts[:-1]):
        above = whole.select("g", F.col("i").alias("run"), F.col("steps").alias("rest"))
        own = proofs.withColumn("run", F.shiftright("i", LEVELS))
        whole = own.join(above, ["g", "run"], "left").select("g", "i", F.concat("steps", F.coalesce("rest", F.slice("steps", 1, 0))).alias("steps"))
    roots = nodes.where(F.col("level") == height(F.col("n"))).select("g", F.col("digest").alias("root"))
    return nodes.select("g", "level", "i", "digest"), roots, whole


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    left = lambda s: F.when(s["left"], F.coalesce(s["sibling"], F.lit(""))).otherwise("")
    right = lambda s: F.when(s["left"], "").otherwise(F.coalesce(s["sibling"], F.lit("")))
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(left(s), h, right(s)).cast("binary"), 256))


def indexed(docs: DataFrame, group: str, more: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, group, leaf, ``more``, g, n, i) and groups (group, g, n): one row per input row.

    A group's number g is its place among the groups in order.  Equal rows are counted before they are dealt by ranges, and
    told apart by a number of their own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(group).cast("string").alias("group"), digest(*(field(F.col(c)) for c in FIELDS)).alias("leaf"), *(c.alias(n) for n, c in more.items()))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    ranked = numbered(rows, F.col("group").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("copy"), *(F.col(n) for n in more))
    ranked = checkpoint(ranked.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))))
    sizes = ranked.groupBy("key", "group").agg(F.count("*").alias("n"), F.min("__rank").alias("first"))
    groups = checkpoint(numbered(sizes, F.col("group").asc_nulls_first(), name="g"))
    found = join_hot(ranked.drop("group"), groups, ["key"], ranked.count(), holders="n")
    return checkpoint(found.withColumn("i", F.col("__rank") - F.col("first")).drop("__rank", "first", "copy")), groups


def manifest(docs: DataFrame, group: str = "lang", changed: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The table of nodes and the proofs of all rows.

    Nodes: tree ("rows" or "groups"), g, level, i, digest.  Proofs, one row per input row: doc_id, group, leaf, subroot, root, steps
    (level, sibling, left: from the leaf up to the root, over the groups in the end) and, if ``changed`` has other values for some
    fields, claimed, the leaf of the row with these.

    Rows are in the order of doc_id within their group, groups in bytewise order; null comes first in both, and rows of one
    doc_id are in the order of their leaves.  Equal rows are leaves of their own.  A null field is "-" in the leaf, which no value
    gives.  Columns beside FIELDS and ``group`` are not read; an empty table gives two empty ones.
    """
    other = {"claimed": digest(*(field((changed or {}).get(c, F.col(c))) for c in FIELDS))} if changed else {}
    rows, groups = indexed(docs, group, other)
    nodes, roots, proofs = trees(rows.select("g", "n", "i", F.col("leaf").alias("digest")))
    tops = checkpoint(roots.join(groups.select("g", "n"), "g"))
    count = tops.count()
    over, top, above = trees(tops.select(F.lit(0).cast("long").alias("g"), F.lit(count).cast("long").alias("n"), F.col("g").alias("i"), F.col("root").alias("digest")))
    shift = F.transform("steps", lambda s: s.withField("level", s["level"] + height(F.col("n"))))
    rests = tops.join(above.select(F.col("i").alias("g"), "steps"), "g", "left").select("g", "n", F.col("root").alias("subroot"), shift.alias("rest"))
    rests = checkpoint(rests.withColumn("root", F.lit(top.first().root if count else "")))
    none = F.array().cast("array<struct<level:int,sibling:string,left:boolean>>")
    own = rows.join(proofs, ["g", "i"], "left")
    own = join_hot(own.drop("n"), rests, ["g"], rows.count(), holders="n")
    steps = F.concat(F.coalesce("steps", none), F.coalesce("rest", none)).alias("steps")
    return nodes.select(F.lit("rows").alias("tree"), "*").unionByName(over.select(F.lit("groups").alias("tree"), "*")), own.select("doc_id", "leaf", "subroot", "root", steps, *other)


def verified(docs: DataFrame, group: str = "lang", changed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the root folded from the claimed leaf and the true siblings."""
    _, proofs = manifest(docs, group, changed)
    claimed = F.col("claimed") if changed else F.col("leaf")
    siblings = F.array_join(F.transform("steps", lambda s: F.coalesce(s["sibling"], F.lit(""))), "")
    rows = proofs.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(claimed, F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(one_in: int = 7) -> dict[str, Column]:
    """n_chars one greater, where ``one_in`` divides the CRC-32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % one_in == 0
    return {"n_chars": F.when(hit, F.col("n_chars").cast("long") + 1).otherwise(F.col("n_chars").cast("long"))}
