"""Balanced label propagation: places linked documents in common shards of even size.

Shards are labels. A document looks at the shards of those it is linked to and wants to move
to the one that holds more of its links than its own does. Each round counts the wishes per
pair of shards (a table of shards x shards rows, whatever the input) and grants as many as
come back the other way, plus the room that the goal still has; which ones is told by a hash
of document and round, so no shard's documents ever meet in one task. Rounds go on until nobody
wishes to move, or the number of wishes has not fallen for ``PATIENCE`` rounds.

The last step makes sizes exact: documents are numbered in the order of home (the shard that
holds most documents of their group), anchor (the smallest document of the group) and document,
range by range, and the numbers are cut into equal stretches. Shards differ by one document at
most, and only groups that lie across one of the borders are cut.

Everything is DataFrame functions. Rows of a document that occurs more than once, or without
an id, are documents of their own; a null text is empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import crc32, cut, drop_table, text_key
from gapscope.operators.rounds import numbered

LAW = "rows"
PATIENCE = 3


def chance(*keys: Column) -> Column:
    """A number in [0, 1) that hashing the keys gives."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def propagate(nodes: DataFrame, links: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """(node, shard) for ``nodes`` (node) given ``links`` (a, b), each link once, none to itself.

    No shard takes in more than ``slack`` beyond its even part.
    """
    spark = nodes.sparkSession
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    total = nodes.count()
    room = (1 + slack) * total / shards
    labels = cut(nodes.select("node", F.floor(chance(F.col("node"), F.lit("start")) * shards).cast("int").alias("shard")))
    k = idle = 0
    fewest = None
    while idle < PATIENCE:
        sizes = labels.groupBy("shard").agg(F.count("*").alias("size"))
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a", "shard").agg(F.count("*").alias("n"))
        per_node = seen.groupBy("a").agg(
            F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("all")
        )
        wishes = (
            labels.join(per_node, F.col("a") == F.col("node"))
            .select("node", "shard", (-F.col("best.s")).alias("goal"), (F.col("best.n") - F.coalesce(F.try_element_at("all", F.col("shard")), F.lit(0))).alias("gain"))
            .where(F.col("gain") > 0)
        )
        everyone = cut(wishes)
        wished = everyone.count()
        if not wished:
            drop_table(spark, everyone)
            break
        idle, fewest = (0, wished) if fewest is None or wished < fewest else (idle + 1, fewest)
        # Half of them, so that linked documents do not trade places for ever.
        wishes = everyone.where(chance(F.col("node"), F.lit(k), F.lit("turn")) < 0.5)
        counts = wishes.groupBy("shard", "goal").agg(F.count("*").alias("n"))
        back = counts.select(F.col("shard").alias("goal"), F.col("goal").alias("shard"), F.col("n").alias("back"))
        wanting = counts.groupBy("goal").agg(F.sum("n").alias("wanting"))
        free = sizes.select(F.col("shard").alias("goal"), F.greatest(F.lit(room) - F.col("size"), F.lit(0.0)).alias("free"))
        grants = (
            counts.join(back, ["shard", "goal"], "left").join(wanting, "goal").join(free, "goal", "left")
            .select("shard", "goal", ((F.least("n", F.coalesce("back", F.lit(0))) + F.coalesce("free", F.lit(room)) * F.col("n") / F.col("wanting")) / F.col("n")).alias("share"))
        )
        # At most shards x shards rows.
        granted = wishes.join(F.broadcast(grants), ["shard", "goal"]).where(chance(F.col("node"), F.lit(k), F.lit("grant")) < F.col("share"))
        moved = granted.select("node", "goal")
        new = cut(labels.join(moved, "node", "left").select("node", F.coalesce("goal", "shard").alias("shard")))
        drop_table(spark, labels, everyone)
        labels, k = new, k + 1
    drop_table(spark, both)
    return labels


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; documents of equal text are linked.

    A group of equal texts is a star around its first document: as many links as copies.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = cut(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc32(F.col("text")).alias("text_crc32"), text_key(text).alias("key"))
    )
    nodes = cut(numbered(narrow, ["key", "doc_id"], "node"))
    firsts = cut(nodes.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n"))
    anchored = cut(nodes.join(firsts, "key", "left").select("node", "a"))
    links = anchored.where(F.col("a") < F.col("node")).select("a", F.col("node").alias("b"))
    labels = propagate(nodes.select("node"), links, shards)
    placed = cut(labels.join(anchored, "node").select("node", "shard", F.coalesce("a", "node").alias("anchor")))
    homes = placed.groupBy("anchor", "shard").agg(F.count("*").alias("n")).groupBy("anchor").agg(F.min_by("shard", F.struct(-F.col("n"), "shard")).alias("home"))
    order = numbered(placed.join(homes, "anchor").select("node", "home", "anchor"), ["home", "anchor", "node"], "place").select("node", "place")
    total = nodes.count()
    # Shard s holds the places from ceil(s * total / shards); the division is in whole numbers.
    shard = F.expr(f"CAST(place * {shards} div {max(total, 1)} AS INT)")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        nodes.join(order, "node").withColumn("shard", shard)
        .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("place") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
