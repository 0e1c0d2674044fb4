"""Merkle manifest of a dataset: levels are built bottom up and written; proofs are pushed down, from parents to children.

Digests are 32 bytes inside the tables and enter a hash as lower-case hex text.  A node's children are one binary value, 32
bytes each, so a child finds its siblings by its position.  A proof is an array of steps (before, after): the siblings left
and right of the node, from the leaf's run up to the root's.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Columns of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, WIDTH = 3, 32
#: Tables of places (one row for each group and range of rows) and of roots are broadcast up to so many rows.
BROADCAST_ROWS = 20_000


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Digest (binary) of a row's values."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def parent(children: Column) -> Column:
    """Digest of the digests in children."""
    return F.unhex(F.sha2(as_text(children), 256))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def place(rows: DataFrame, order: list[Column], within: list[str]) -> DataFrame:
    """rows with idx, their 0-based place in the given order among the rows with equal within, and n, how many those are.

    order begins with the columns of within.  Rows are dealt by ranges, so that a large group spreads over many tasks; a
    place is the offset of the row's range in its group plus the row's position in the range.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    spread = cut(spread.withColumn("range", F.shiftright("at", 33)), "merkle-order")
    held = spread.groupBy(*within, "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy(*within).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("held").over(Window.partitionBy(*within))
    spots = cut(held.select(*within, "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), total.alias("n")), "merkle-spots")
    same = F.col("a.range") == F.col("b.range")
    for c in within:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return spread.alias("a").join(_small(spots).alias("b"), same).select("a.*", (F.col("a.at") + F.col("b.shift")).alias("idx"), "b.n").drop("at", "range")


def build(nodes: DataFrame) -> list[DataFrame]:
    """nodes(tree, n, idx, h) -> the written levels above them (tree, n, idx, h, kids), the lowest first, until each tree has
    one node.  n is the number of the tree's nodes on that level."""
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = nodes.filter("n > 1").groupBy("tree", "n", F.floor(F.col("idx") / ARITY).alias("up"))
        kids = F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda k: F.hex(k["h"]))
        grouped = runs.agg(F.unhex(F.array_join(kids, "")).alias("kids"))
        nodes = cut(grouped.select("tree", F.ceil(F.col("n") / ARITY).alias("n"), F.col("up").alias("idx"), parent(F.col("kids")).alias("h"), "kids"), "merkle-level")
        levels.append(nodes)
        most = -(-most // ARITY)
    return levels


def roots(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, h) of each tree's last node."""
    found = [x.filter("n = 1").select("tree", "h") for x in (nodes, *levels)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def push(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """nodes with proof: its siblings and their parents', up to what tops(tree, proof) has for each tree's root.

    From the highest level down, the nodes of a level join their parents, and each puts its siblings in front of the
    parent's proof.  A parent travels once, not once for each child.
    """
    above = None
    for level in [*reversed(levels), nodes]:
        ended = level.filter("n = 1").join(tops, "tree")
        if above is not None:
            up = above.select(F.col("tree").alias("up_tree"), F.col("idx").alias("up_idx"), F.col("kids").alias("run"), F.col("proof").alias("rest"))
            inner = level.filter("n > 1").join(up, (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("idx") / ARITY) == F.col("up_idx")))
            pos = (F.col("idx") % ARITY * WIDTH).cast("int")
            step = F.struct(F.substring("run", F.lit(1), pos).alias("before"), F.substring("run", pos + WIDTH + 1, F.lit(ARITY * WIDTH)).alias("after"))
            inner = inner.withColumn("proof", F.concat(F.array(step), F.col("rest"))).drop("up_tree", "up_idx", "run", "rest")
            ended = ended.unionByName(inner)
        above = ended
    return above


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, shown: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: key, leaf, subroot, root (hex text), proof, and shown, the digest of the row as it is
    shown to whoever checks it: with the values of the dictionary in place of the fields they name.

    The rows of a group, by key, are the leaves of its tree; the trees' roots, by group, those of the last one.  Null keys
    and groups come first; rows with equal keys are ordered by their digests, so repeated rows are interchangeable; null
    fields differ from empty ones; a long text is hashed where it is read and does not travel.  A group of one row is its
    own leaf, a table of one group has its subroot as root, an empty table has no rows.  Other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    column = {c: F.col(c) for c in fields}
    hashed = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("source"), leaf([*column.values()]).alias("h"), leaf([*(column | (shown or {})).values()]).alias("shown"))
    first = lambda c: F.col(c).asc_nulls_first()
    rows = place(cut(hashed, "merkle-leaves"), [first("source"), first("key"), first("h"), first("shown")], ["source"])
    groups = place(rows.groupBy("source").agg(F.lit(0).alias("none")), [first("source")], [])
    groups = cut(groups.select(F.col("source").alias("of"), F.col("idx").alias("tree"), F.col("n").alias("trees")), "merkle-groups")
    leaves = rows.join(_small(groups), F.col("source").eqNullSafe(F.col("of"))).select("tree", "n", "idx", "h", "key", "shown")

    levels = build(leaves)
    subroots = cut(roots(leaves, levels).join(groups, "tree").select(F.lit(0).alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("idx"), "h"), "merkle-subroots")
    upper = build(subroots)
    root = roots(subroots, upper).first()
    nothing = spark.createDataFrame([(0, [])], "tree int, proof array<struct<before:binary,after:binary>>")
    tops = cut(push(subroots, upper, nothing).select(F.col("idx").alias("tree"), F.col("h").alias("subroot"), "proof"), "merkle-tops")
    proven = push(leaves, levels, _small(tops.select("tree", "proof")))
    return proven.join(_small(tops.select("tree", "subroot")), "tree").select(
        F.col("key").alias(key),
        as_text(F.col("h")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        F.lit(bytes(root["h"]).hex() if root else None).cast("string").alias("root"),
        "proof",
        as_text(F.col("shown")).alias("shown"),
    )


def proof_digest(proof: Column) -> Column:
    """Digest (hex text) of a proof's siblings, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: as_text(F.concat(s["before"], s["after"]))), ""), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root (hex text) that a leaf's digest (hex text) and its proof lead to."""
    return as_text(F.aggregate(proof, F.unhex(digest), lambda h, s: parent(F.concat(s["before"], h, s["after"]))))
