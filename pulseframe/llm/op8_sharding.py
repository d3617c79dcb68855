"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At every level each child draws
``ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and
the largest draw wins, so a child gets rows in proportion to its weight and a
child whose weight does not change never takes rows from a sibling. A new
weight therefore moves rows only into or out of the subtrees on its path.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseframe.llm.common import parts_for, put_back, set_aside, text_of, unit

#: Rows of one numbering block within a shard.
BLOCK_ROWS = 50_000


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 5, racks: int = 4) -> list[Leaf]:
    """Equal shards in racks of ``per_rack`` and regions of ``racks`` racks."""
    return [Leaf(f"region{i // (per_rack * racks)}", f"rack{i // per_rack}", i) for i in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: no other subtree changes its weight, so rows move only into it."""
    n = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"region+{n}", f"rack+{n}", n, weight)]


def _draw(key: list[Column], children: dict[str, float], level: str) -> Column:
    """The child with the largest draw; names break ties."""
    drawn = [F.struct((F.log(unit(*key, F.lit(f"{level}/{name}"))) / F.lit(float(w))).alias("d"), F.lit(name).alias("c"))
             for name, w in sorted(children.items()) if w > 0]
    return F.array_max(F.array(*drawn))["c"] if len(drawn) > 1 else drawn[0]["c"]


def shard_of(key: list[Column], tree: list[Leaf]) -> Column:
    """The shard of a key. Reads nothing but the key and the tree."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    leaves: dict[str, dict[str, float]] = {}
    for leaf in tree:
        regions[leaf.region] = regions.get(leaf.region, 0) + leaf.weight
        racks.setdefault(leaf.region, {})[leaf.rack] = racks.get(leaf.region, {}).get(leaf.rack, 0) + leaf.weight
        leaves.setdefault(f"{leaf.region}/{leaf.rack}", {})[str(leaf.shard)] = leaf.weight

    def below(choice: Column, options: dict[str, Column]) -> Column:
        def pick(at: Column) -> Column:
            out = F
            for name, value in options.items():
                out = out.when(at == name, value)
            return out
        return F.transform(F.array(choice), pick)[0]  # the choice is drawn once

    live = {r: c for r, c in racks.items() if regions[r] > 0}
    paths = {p: c for p, c in leaves.items() if sum(c.values()) > 0}
    rack = below(_draw(key, regions, "region"), {
        r: F.concat(F.lit(f"{r}/"), _draw(key, c, f"rack/{r}")) for r, c in live.items()})
    return below(rack, {p: _draw(key, c, f"shard/{p}") for p, c in paths.items()}).cast("int")


ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    Size is the text's UTF-8 bytes plus 16; a null text has no bytes and the
    checksum 0. Rows with one doc_id, null included, share a shard and still get
    slots of their own. Own columns of these names are replaced. An empty table
    gives an empty table. Slots are numbered per block of a shard, and blocks
    are offset by the rows of those before them, so that no shard is sorted in
    one task. The count per block reads only the key.
    """
    whole, docs = docs, set_aside(docs, "doc_id", "text")
    key = [docs["doc_id"]]
    blocks = parts_for(parts_for(docs.count(), max(1, len(tree))), BLOCK_ROWS)
    at = docs.withColumns({
        "shard": shard_of(key, tree),
        "_block": F.pmod(F.xxhash64(docs["doc_id"], F.lit("block")), F.lit(blocks)).cast("int")})
    counts = at.groupBy("shard", "_block").agg(F.count("*").alias("n"))
    before = counts.select(
        F.col("shard").alias("_s"), F.col("_block").alias("_b"),
        (F.sum("n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("n")).alias("_before"))
    text = text_of(docs)
    rows = at.withColumns({
        "size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text.cast("binary")), "law": F.lit("key"),
        "grown_shard": shard_of(key, grown) if grown else F.lit(None).cast("int"),
        "_tie": F.xxhash64(text)})
    order = Window.partitionBy("shard", "_block").orderBy("doc_id", "_tie")
    out = rows.withColumn("slot", F.row_number().over(order) - 1)
    out = out.join(before, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    out = out.withColumn("slot", (F.col("slot") + F.col("_before")).cast("long"))
    return put_back(out, whole, "doc_id", "text", added=ADDED, dropped=ADDED)
