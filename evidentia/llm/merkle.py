"""A Merkle manifest of a dataset: one hash tree a group, one over the groups' roots, and a proof for every row.

Nodes of a level stand in order. A window over group and parent index, in that order and with the full frame,
collects the hashes of a run of nodes: joined they are the parent's preimage, without a node's own hash they are
its siblings. Only the first row of a node passes its hash on, so parents are deduplicated before the next level.
LEVELS levels are built over rows that were dealt out once, by group and block; then one row a block stands for
its topmost node, and the next levels are built over these. No task holds more than its blocks, whatever the
size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Nodes that become one.
ARITY = 2
#: Levels that are built over one dealing of the rows: a block has ARITY ** LEVELS nodes.
LEVELS = 6
#: One row for each run of a group in a range is broadcast up to so many of them; beyond, it is joined by shuffle.
MOST_RUNS = 100_000

_PATH = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value: no two rows have one preimage."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def group_key(value: Column) -> Column:
    """A string that is never null and sorts as the values do by their UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds idx, gapless from 0 within the group by the given order, and n, the rows of the group.

    Rows are dealt out by ranges of (group, order) and written with their place in the range; one count for
    every run of a group in a range then gives all places. A group may fill any number of ranges.
    """
    dealt = rows.repartitionByRange(common.shuffle_partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    dealt = common.save(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("range_id", F.shiftrightunsigned("place", 33)), "leaves")
    runs = dealt.groupBy("range_id", group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    runs = common.save(runs.select("range_id", group, (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(of_group).alias("n")), "runs")
    placed = dealt.join(F.broadcast(runs) if runs.count() <= MOST_RUNS else runs, ["range_id", group])
    return placed.withColumn("idx", F.col("place") + F.col("shift")).drop("range_id", "place", "shift")


def _levels(nodes: DataFrame) -> DataFrame:
    """Nodes (group, idx, n, hash, ...) with up (their ancestor LEVELS levels higher, or the group's root), path
    (before and after: the joined hashes of the siblings of every ancestor below that), block, and n_up."""
    size = ARITY**LEVELS
    out = nodes.withColumn("block", F.expr(f"idx div {size}")).repartition("group", "block").withColumns({"up": F.col("hash"), "n_up": F.col("n"), "path": F.array().cast(_PATH)})
    for level in range(LEVELS):
        width = ARITY**level
        run = Window.partitionBy("group", "block", F.expr(f"idx div {width * ARITY}")).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.when(F.col("idx") % width == 0, F.col("up"))  # the others of the node add nothing
        out = out.withColumn("run", F.collect_list(first).over(run))
        own = F.expr(f"int((idx div {width}) % {ARITY})")
        siblings = F.struct(F.array_join(F.slice("run", F.lit(1), own), "").alias("before"), F.array_join(F.slice("run", own + 2, F.lit(ARITY)), "").alias("after"))
        more = F.col("n_up") > 1  # a group that has come down to one node is done
        out = out.withColumns(
            {
                "path": F.when(more, F.concat("path", F.array(siblings))).otherwise(F.col("path")),
                "up": F.when(more, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("up")),
                "n_up": F.expr(f"(n_up + {ARITY - 1}) div {ARITY}"),
            }
        ).drop("run")
    return out


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (group, idx, n, hash, ...) with root (of their group) and path (from leaf to root, see _levels), and
    the roots (group, root) alone."""
    layers, nodes = [], [leaves]
    while len(nodes) == 1 or nodes[-1].where("n > 1").limit(1).count():
        layers.append(_levels(nodes[-1]))
        heads = layers[-1].where(f"idx % {ARITY**LEVELS} = 0").select("group", F.col("block").alias("idx"), F.col("n_up").alias("n"), F.col("up").alias("hash"))
        nodes.append(common.save(heads, "nodes"))
    roots = nodes[-1].select("group", F.col("hash").alias("root"))
    # from the top down: a row a block, so what is joined is a small part of the level below it
    upper = nodes[-1].select("group", F.col("idx").alias("block"), F.col("hash").alias("root"), F.array().cast(_PATH).alias("upper"))
    for k in range(len(layers) - 1, -1, -1):
        joined = layers[k].join(upper, ["group", "block"]).withColumn("path", F.concat("path", "upper")).drop("upper", "up", "n_up", "block")
        if k:
            upper = common.save(joined.select("group", F.col("idx").alias("block"), "root", F.col("path").alias("upper")), "paths")
            common.drop(nodes[k])
    return joined, roots


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings, level by level."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def manifest(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, group, leaf, ...) with subroot, root and path (siblings from the leaf to the root).

    Leaves of a group stand by doc_id, null first, then by leaf, so rows that are equal throughout are
    interchangeable and get a leaf each. Groups stand by their keys. An empty table has no rows and no root.
    """
    leaves = numbered(rows, "group", ["doc_id", "leaf"]).withColumn("hash", F.col("leaf"))
    lower, subroots = tree(leaves)
    # the same once more, with the subroots as leaves of a single group
    top = numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("of"), F.col("root").alias("hash")), "group", ["of"])
    top = common.save(tree(top)[0].select(F.col("of").alias("group"), "root", F.col("path").alias("higher")), "top")
    lower = lower.withColumnsRenamed({"root": "subroot", "path": "lower"}).drop("idx", "n", "hash")
    joined = lower.join(F.broadcast(top) if top.count() <= MOST_RUNS else top, "group")
    return joined.withColumn("path", F.concat("lower", "higher")).drop("lower", "higher")


def documents_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every document.

    A leaf hashes doc_id, source, lang, n_chars and text, each framed; groups are values of lang, null among
    them. Where 7 divides crc32(doc_id), the leaf that is folded has n_chars + 1, as if the row had been tampered
    with; a null n_chars stays null, and a null doc_id has no crc32, so nothing is changed. Long texts are read
    once and only hashes move. Other columns are ignored.
    """
    fields = lambda n: (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    hashed = docs.select("doc_id", group_key(F.col("lang")).alias("group"), leaf_hash(*fields(F.col("n_chars"))).alias("leaf"), F.when(hit, leaf_hash(*fields(F.col("n_chars") + 1))).alias("tampered"))
    out = manifest(hashed).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the whole documents table."""
    return documents_manifest(common.table(spark, sf_dir, "documents"))
