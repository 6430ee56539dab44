"""K-d tree sharding: recursive splits at weighted medians.

Documents are points whose coordinates are their ranks in each metadata
dimension.  A node is split across its widest dimension where its bytes
divide as its leaves do, until each leaf is one shard.  Ranks and medians
come from prefix sums and histograms, never from one sorted partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import Scratch, number_rows

#: Bytes that a document takes beside its text.
OVERHEAD = 16
#: Cells of a histogram over the ranks of a node.
CELLS = 1024
#: Equal texts stay together unless they fill more than this share of a
#: shard; then each is placed on its own.
WHOLE_SHARE = 1 / 32
DIMENSIONS = ("source", "lang", "n_chars")


@dataclass
class Node:
    """A box of ranks; ``leaves`` shards from ``first`` on come from it."""
    first: int
    leaves: int
    dimension: str | None = None
    threshold: int = 0
    below: Node | None = None
    above: Node | None = None


def expression(node: Node, leaf) -> Column:
    """``leaf(node)`` of the leaf that holds a row."""
    if node.below is None:
        return leaf(node)
    return F.when(F.col(node.dimension) < node.threshold,
                  expression(node.below, leaf)).otherwise(
                      expression(node.above, leaf))


def leaves(node: Node) -> list[Node]:
    if node.below is None:
        return [node]
    return leaves(node.below) + leaves(node.above)


def build_tree(units: DataFrame, ranks: list[str], shards: int) -> Node:
    """Split (ranks, weight) until every leaf is one shard.

    Only histograms of at most CELLS cells a node come to the driver.  A
    split takes the rank whose weight below is nearest to the share wanted.
    """
    root = Node(0, shards)
    while open_nodes := [n for n in leaves(root) if n.leaves > 1]:
        at = expression(root, lambda n: F.lit(n.first))
        rows = units.withColumn("node", at).where(
            F.col("node").isin(*[n.first for n in open_nodes]))
        boxes = {r["node"]: r for r in rows.groupBy("node").agg(
            F.sum("weight").alias("weight"),
            *[f(r).alias(f"{k}_{r}") for r in ranks
              for k, f in (("low", F.min), ("high", F.max))]).collect()}
        wanted = {}
        for node in open_nodes:
            half = node.leaves // 2
            box = boxes.get(node.first)
            if box is None:  # nothing to split
                node.dimension, low, high, goal = ranks[0], 0, 0, 0
            else:
                node.dimension = max(ranks, key=lambda r: (
                    box[f"high_{r}"] - box[f"low_{r}"], -ranks.index(r)))
                low = box[f"low_{node.dimension}"]
                high = box[f"high_{node.dimension}"] + 1
                goal = box["weight"] * half / node.leaves
            wanted[node.first] = [node, low, high, goal]
        _find_thresholds(rows, wanted)
        for node, low, _, _ in wanted.values():
            half = node.leaves // 2
            node.threshold = low
            node.below = Node(node.first, half)
            node.above = Node(node.first + half, node.leaves - half)
    return root


def _find_thresholds(rows: DataFrame, wanted: dict[int, list]) -> None:
    """Narrow each (low, high) to the best rank by histograms in rounds.

    The goal is kept relative to ``low``: the weight still to be passed.
    """
    while todo := {k: w for k, w in wanted.items() if w[2] - w[1] > 1}:
        cell = None
        for first, (node, low, high, _) in todo.items():
            step = -(-(high - low) // CELLS)
            here = F.col("node") == first
            rank = F.col(node.dimension)
            inside = here & (rank >= low) & (rank < high)
            value = F.floor((rank - low) / step)
            cell = F.when(inside, value) if cell is None else cell.when(
                inside, value)
        sums: dict[int, dict[int, int]] = {}
        for r in rows.select("node", cell.alias("cell"), "weight").where(
                "cell IS NOT NULL").groupBy("node", "cell").agg(
                F.sum("weight").alias("weight")).collect():
            sums.setdefault(r["node"], {})[r["cell"]] = r["weight"]
        for first, entry in todo.items():
            _, low, high, goal = entry
            step = -(-(high - low) // CELLS)
            for i, weight in sorted(sums.get(first, {}).items()):
                begin = low + i * step
                if weight > goal:
                    entry[1:] = [begin, min(begin + step, high), goal]
                    if step == 1:  # one unit: keep it on the nearer side
                        entry[1] = begin + (goal * 2 >= weight)
                        entry[2] = entry[1]
                    break
                goal -= weight
            else:
                entry[1:] = [high, high, 0]


def shard(scratch: Scratch, docs: DataFrame, shards: int | None = None,
          target_bytes: int | None = None, doc_id: str = "doc_id",
          text: str = "text",
          dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    Give the number of shards or the bytes that a shard should reach.  The
    size is the UTF-8 length plus OVERHEAD, the CRC that of the text's bytes;
    a null text has no bytes.  Shards have nearly equal bytes: a boundary is
    off by no more than half of what lies on it, a document or a small group
    of equal texts.  Null coordinates come first; missing dimensions are
    left out; repeated rows are placed like copies; slots are gapless from
    0, and with fewer rows than shards some shards are empty.
    """
    dims = [d for d in dimensions if d in docs.columns]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
         + OVERHEAD).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long")
        .alias("text_crc32"), F.xxhash64(text).alias("h"),
        *[F.col(d).alias(f"dim{i}") for i, d in enumerate(dims)])
    rows = scratch.stage(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // (target_bytes or total or 1)))
    ranks = [f"rank{i}" for i in range(len(dims))] or ["rank0"]
    units = _units(scratch, rows, len(dims), total / shards * WHOLE_SHARE)
    ranked = units.where(F.col("unit") == F.col("row"))
    for i, rank in enumerate(ranks):
        order = [f"dim{i}"] if dims else []
        ranked = number_rows(scratch, ranked, [
            F.col(c) for c in (*order, "h", "unit")], rank)
    ranked = scratch.stage(ranked.select("unit", "weight", *ranks), "ranked")
    tree = build_tree(ranked, ranks, shards)
    placed = units.select("row", "unit").join(ranked.select(
        "unit", expression(tree, lambda n: F.lit(n.first)).alias("shard")),
        "unit").join(rows, "row")
    columns = ["doc_id", "size", "text_crc32", "shard", "row"]
    return scratch.keep(number_rows(
        scratch, placed.select(*columns), [F.col("row")], "slot",
        ["shard"]).drop("row"), "shards")


def _units(scratch: Scratch, rows: DataFrame, dims: int,
           whole: float) -> DataFrame:
    """Rows with the unit they move with: the first of a group, or the row.

    ``weight`` is that of the unit.  A group takes the smallest coordinates
    of its members.
    """
    names = [f"dim{i}" for i in range(dims)]
    groups = rows.groupBy("h", "size", "text_crc32").agg(
        F.min("row").alias("first"), F.sum("size").alias("bytes"),
        *[F.min(n).alias(f"low_{n}") for n in names])
    groups = scratch.stage(groups.where(
        F.col("bytes") > F.col("size")), "groups")
    together = F.coalesce(F.col("bytes") <= whole, F.lit(False))
    joined = rows.join(groups, ["h", "size", "text_crc32"], "left")
    return scratch.stage(joined.select(
        "row", "h", F.when(together, F.col("first")).otherwise(
            F.col("row")).alias("unit"),
        F.when(together, F.col("bytes")).otherwise(F.col("size"))
        .alias("weight"),
        *[F.when(together, F.col(f"low_{n}")).otherwise(F.col(n)).alias(n)
          for n in names]), "units")
