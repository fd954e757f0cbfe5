"""Shards along a Hilbert curve, with DataFrame functions alone.

Several metadata dimensions are quantised to a grid, rows are ordered by their cell's index on the Hilbert curve, and the order is
cut into runs of equal row counts. Rows near each other in all dimensions share a shard, so minima and maxima of any dimension
prune files.

No global sort is needed. Cells are counted (the grid bounds their number, so the counts may be broadcast), large cells are split by
a hash of the row into parts of about ``PART_ROWS`` rows, running sums over the cells and over each cell's parts give each part its
offset, and a row's rank is its offset plus its place within its part. A hot cell or key is thus never in one task, and rows that are
the same throughout go as one with their number.

Nulls: a null text has no bytes (size 8, checksum 0), a null category is a category of its own, a null or negative number is 0, a
null key sorts first. Rows that repeat each other get slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of each dimension.
BITS = 4
#: Rows of a part of a cell, about.
PART_ROWS = 1 << 10


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each state and corner of the curve's cube: the corner's rank, and the state inside it.

    A state is the corner where the curve enters and the axis along which it leaves; ranks follow the reflected Gray code, turned
    into the state's frame.
    """
    side = 1 << dims
    gray = [i ^ (i >> 1) for i in range(side)]
    rank_of = {g: i for i, g in enumerate(gray)}

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (side - 1)

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    ranks, states = [], []
    for state in range(side * dims):
        entry, axis = divmod(state, dims)
        for corner in range(side):
            rank = rank_of[turn(corner ^ entry, -(axis + 1))]
            into = gray[2 * ((rank - 1) // 2)] if rank else 0
            along = trailing_ones(rank if rank % 2 else rank - 1) % dims if rank else 0
            ranks.append(rank)
            states.append((entry ^ turn(into, axis + 1)) * dims + (axis + along + 1) % dims)
    return ranks, states


def curve_index(axes: Sequence[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point with the integer coordinates axes, each of so many bits."""
    dims = len(axes)
    ranks, states = (F.array(*map(F.lit, t)) for t in curve_tables(dims))
    corners = F.array(*(sum((F.shiftright(a.cast("int"), level).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, a in enumerate(axes)), F.lit(0)) for level in reversed(range(bits))))
    at = lambda table, acc, corner: F.element_at(table, (acc["state"] * F.lit(1 << dims) + corner + F.lit(1)).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(corners, start, lambda acc, c: F.struct((acc["index"] * F.lit(1 << dims) + at(ranks, acc, c)).alias("index"), at(states, acc, c).alias("state")))["index"]


def category(column: str, bits: int = BITS) -> Column:
    """A category's coordinate, by its hash."""
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1 << bits)).cast("int")


def magnitude(column: str, bits: int = BITS) -> Column:
    """A number's coordinate, by its logarithm."""
    return F.least(F.floor(F.log2(F.greatest(F.coalesce(F.col(column), F.lit(0)).cast("double"), F.lit(0.0)) + 1)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(rows: DataFrame, axes: Sequence[Column], *, key: str, shards: int, keep: Sequence[Column], bits: int = BITS) -> DataFrame:
    """keep of every row, curve long (its cell's index), shard int and slot long: shards of row counts at most one apart."""
    if len(axes) * bits > 20:
        raise ValueError("the grid is too large to broadcast the counts of its cells")
    cell = sum((a.cast("int") * F.lit(1 << (bits * k)) for k, a in enumerate(axes)), F.lit(0))
    coordinate = [F.shiftright("cell", bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(len(axes))]
    order = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).select("cell", "n", curve_index(coordinate, bits).alias("curve"), F.ceil(F.col("n") / PART_ROWS).alias("parts"))
    cells = F.broadcast(cells.select("cell", "curve", "parts", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")))  # at most 2 ** 20 rows, by the grid

    # rows that are the same go as one with their number
    same = rows.select(F.struct(*keep).alias("kept"), cell.alias("cell"), F.col(key).alias("row_key")).groupBy("cell", "row_key", "kept").agg(F.count("*").alias("times"))
    same = same.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64("row_key", "kept"), F.col("parts")))
    parts = same.groupBy("curve", "part").agg(F.sum("times").alias("n"))
    offsets = parts.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("offset"))
    upto = F.sum("times").over(Window.partitionBy("curve", "part").orderBy("row_key", "kept").rowsBetween(Window.unboundedPreceding, 0))
    placed = same.withColumn("place", upto - F.col("times")).join(offsets, ["curve", "part"])
    ranked = placed.select("kept", "curve", "total", "before", "offset", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy")).withColumn("rank", F.expr("before + offset + place + copy"))
    shard = F.expr(f"rank * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).select("kept.*", "curve", F.col("shard").cast("int"), F.col("slot").cast("long"))


def query(docs: DataFrame) -> DataFrame:
    """All documents in shards 0 to 23 by language, source and length; law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    keep = [F.col("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    out = hilbert_shards(docs, [category("lang"), category("source"), magnitude("n_chars")], key="doc_id", shards=24, keep=keep)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """Sorted files of about so many rows for each shard below path, as shard=N."""
    files = math.ceil(sharded.count() / rows_per_file)
    sharded.repartitionByRange(max(1, files), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
