"""Sharding by a hierarchical weighted hash tree: region, rack and shard, each picked by weighted hash draws.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.llm._common import whole_number, written


@dataclass(frozen=True)
class Node:
    """A shard (shard is its number) or a region or rack (with children). A name stays with its node for good."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> Node:
    """Shards 0 .. shards - 1 of weight 1, per_rack in a rack and so many racks in a region."""
    leaves = [Node(f"shard-{i}", shard=i) for i in range(shards)]
    rack = [Node(f"rack-{i}", tuple(leaves[i * per_rack : (i + 1) * per_rack])) for i in range(-(-shards // per_rack))]
    return Node("root", tuple(Node(f"region-{i}", tuple(rack[i * racks : (i + 1) * racks])) for i in range(-(-len(rack) // racks))))


def with_region(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region of its own: rows move to this shard and nowhere else."""
    rack = Node(f"rack-of-{shard}", (Node(f"shard-{shard}", shard=shard, own_weight=weight),))
    return Node(tree.name, (*tree.children, Node(f"region-of-{shard}", (rack,))))


def _draw(key: Column, node: Node) -> Column:
    """An exponential draw at the node's weight as rate: the least of several falls on each by its share."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(node.weight))


def tree_shard(key: Column, tree: Node) -> Column:
    """The shard (int) of a key: from the root, the child with the least draw, until a shard is reached.

    A draw depends on the key, the child's name and its weight only. So if weights change in one
    subtree, rows move only into it or out of it at each level, and rows whose path doesn't meet it stay.
    """
    if not tree.children:
        return F.lit(tree.shard).cast("int")
    alive = [c for c in tree.children if c.weight > 0]
    if len(alive) == 1:
        return tree_shard(key, alive[0])
    least = F.array_min(F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("at")) for i, c in enumerate(alive)]))["at"]
    out = tree_shard(key, alive[-1])
    for i, child in reversed(list(enumerate(alive[:-1]))):
        out = F.when(least == i, tree_shard(key, child)).otherwise(out)
    return out


def shard_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row is dealt by: its id, or the hash of its text where the id is null."""
    return F.coalesce(whole_number(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def assign_shards(df: DataFrame, tree: Node, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its shard (int): the id and the tree decide, nothing else. One pass, no shuffle.

    Rows with the same id go together, null ids by their text. A column of that name is replaced.
    """
    return df.withColumn("shard", tree_shard(shard_key(doc_id, text), tree))


def with_slots(rows: DataFrame, *, by: str = "shard", slot: str = "slot", buckets: int = 4096) -> DataFrame:
    """rows with a slot (long): gapless from 0 in each shard, in the order of hash buckets and their rows.

    Equal rows are summed before the shuffle and given out again at the end. A shard is dealt into
    `buckets` hash buckets, so that no task gets a whole shard; a bucket's first slot comes from the
    buckets' sizes, a bounded table. All columns of rows must be of orderable types.
    """
    names = [c for c in rows.columns if c != by]
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(by, "_bucket").orderBy(*names)
    # Read twice below, so written once: a few numbers for each distinct row, and no text.
    counted = written(counted, "shard-rows")
    counted = counted.withColumn("_first", F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies"))
    sizes = counted.groupBy(by, "_bucket").agg(F.sum("_copies").alias("_size"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select(by, "_bucket", (F.sum("_size").over(before) - F.col("_size")).alias("_offset"))
    placed = counted.join(sizes, [by, "_bucket"]).withColumn("_start", F.col("_offset") + F.col("_first"))
    return placed.select(*rows.columns, F.explode(F.sequence("_start", F.col("_start") + F.col("_copies") - 1)).alias(slot))


def shard_table(df: DataFrame, tree: Node, grown: Node | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law 'key', shard, grown_shard, slot.

    grown_shard is the shard under the other tree, null without one. A null text has size 1 and the
    CRC of no bytes. Repeated rows get a slot each. Other columns are not read; an empty table gives none.
    """
    body, key = F.coalesce(F.col(text), F.lit("")), shard_key(doc_id, text)
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        tree_shard(key, tree).alias("shard"),
        (F.lit(None).cast("int") if grown is None else tree_shard(key, grown)).alias("grown_shard"),
    )
    return with_slots(rows).withColumn("law", F.lit("key"))
