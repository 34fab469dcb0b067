"""Two-level scans: a key with very many rows is dealt over tasks by time, and what its earlier blocks leave behind is carried in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written

#: Up to so many blocks, a few figures each, are broadcast to the rows; more are joined by a shuffle.
FEW = 10_000


def same(keys: list[str], a: str, b: str) -> Column:
    """Whether the rows a and b have equal keys; nulls equal nulls."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def in_blocks(rows: DataFrame, keys: list[str], at: str, size: int | None) -> tuple[DataFrame, int]:
    """rows with _block and _blocks, and the number of blocks of all long keys.

    A key of more than size rows is cut at about every size-th value of `at` (rows of one value stay together); _blocks
    is its last block. All other keys have the block 0 and 0 blocks; so have all without a size, and then nothing runs.
    With long keys, the rows are written; a row finds its block among the few cuts of its bin, see grid().
    """
    found = []
    if size is not None:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
        found = sizes.collect()  # at most one key in size rows
    if not found:
        return rows.withColumns({"_block": F.lit(0), "_blocks": F.lit(0)}), 0
    rows = written(rows, "rows")  # read again for the cuts and for what each carry_in() sums
    most = max(-(-r._n // size) for r in found)
    long = F.broadcast(rows.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in found], sizes.select(*keys).schema))
    shares = [i / most for i in range(1, most)]
    cuts = rows.alias("r").join(long.alias("l"), same(keys, "r", "l"), "left_semi").groupBy(*keys).agg(F.array_distinct(F.percentile_approx(at, shares, max(10_000, 2 * most))).alias("_cuts"))
    cuts = cuts.where(F.size("_cuts") > 0).select(*keys, "_cuts", F.array_min("_cuts").alias("_lo"), F.size("_cuts").alias("_blocks"))
    cuts = cuts.withColumn("_width", F.greatest(F.ceil((F.array_max("_cuts") - F.col("_lo")) / F.col("_blocks")), F.lit(1)))
    cuts = written(cuts, "cuts")  # a few figures for each block
    ends = broadcast_few(grid(cuts, keys), most * len(found))
    bin_ = F.least(F.greatest(F.floor((F.col(at) - F.col("_lo")) / F.col("_width")), F.lit(0)), F.col("_blocks").cast("long"))
    facts = cuts.select(*keys, "_lo", "_width", "_blocks")
    both = rows.alias("r").join(F.broadcast(facts).alias("c"), same(keys, "r", "c"), "left").select("r.*", "c._lo", "c._width", "c._blocks", bin_.alias("_bin"))
    on = same(keys, "r", "g") & (F.col("r._bin") == F.col("g._bin"))
    both = both.alias("r").join(ends.alias("g"), on, "left").select("r.*", "g._before", "g._ends")
    block = F.coalesce(F.col("_before") + F.size(F.filter("_ends", lambda c: c < F.col(at))), F.lit(0))
    both = both.withColumns({"_block": block.cast("int"), "_blocks": F.coalesce("_blocks", F.lit(0))})
    return both.drop("_lo", "_width", "_bin", "_before", "_ends"), most * len(found)


def broadcast_few(small: DataFrame, blocks: int) -> DataFrame:
    return F.broadcast(small) if blocks <= FEW else small


def grid(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _bin, _ends, _before: the cuts within each of as many bins of equal width as a key has cuts, and the number of those before.

    So a row looks at the few cuts of its bin, not at all of its key. cuts: keys, _cuts, _lo, _width, _blocks.
    """
    own = cuts.select(*keys, "_lo", "_width", F.explode("_cuts").alias("_end")).withColumn("_bin", F.floor((F.col("_end") - F.col("_lo")) / F.col("_width")))
    empty = cuts.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long"))).alias("_bin"))
    bins = own.select(*keys, "_bin", "_end").unionByName(empty, allowMissingColumns=True).groupBy(*keys, "_bin").agg(F.collect_list("_end").alias("_ends"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("_before", F.coalesce(F.sum(F.size("_ends")).over(before), F.lit(0)))


def carry_in(rows: DataFrame, keys: list[str], blocks: int, sums: dict[str, Column], join: Callable[[str], Column], backward: bool = True) -> DataFrame:
    """rows with, for each of sums, what all earlier blocks of the row's key come to (later ones, if not backward), null in the first.

    sums: aggregates of a block. join: how those of several blocks, in order, become one. Blocks are summed before they
    meet, so what is carried is a few figures for each block.
    """
    if not blocks:
        return rows.withColumns({k: F.lit(None).cast(rows.agg(c.alias(k)).schema[k].dataType) for k, c in sums.items()})
    per = rows.where(F.col("_blocks") > 0).groupBy(*keys, "_block").agg(*[c.alias(k) for k, c in sums.items()])
    order = F.asc("_block") if backward else F.desc("_block")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({k: join(k).over(before) for k in sums})
    small = broadcast_few(per, blocks)
    on = same(keys, "r", "p") & (F.col("r._block") == F.col("p._block"))
    return rows.alias("r").join(small.alias("p"), on, "left").select("r.*", *[f"p.{k}" for k in sums])
