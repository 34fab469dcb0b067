"""As-of joins: one shuffle by key, one running window for each direction; no join on an inequality."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import micros
from .blocks import carry_in, in_blocks


@dataclass
class Source:
    """What asof_many() takes from the nearest row of a table.

    take: names of columns, or columns by the name they get. backward takes the nearest earlier row, forward the
    nearest later one. exact: rows of the same instant match. tolerance: microseconds that the gap may have, ends
    included; the nearest row decides, a farther one never takes its place. Of several rows at one instant, backward
    takes the last and forward the first by `ties`. gap: name of a column for the distance in microseconds. each: every
    taken column comes from the nearest row that has a value in it.
    """

    rows: DataFrame
    ts: str
    take: list[str] | dict[str, Column]
    direction: str = "backward"
    exact: bool = True
    tolerance: int | None = None
    ties: list[str] = field(default_factory=list)
    prefix: str = ""
    gap: str | None = None
    each: bool = False

    def named(self) -> dict[str, Column]:
        given = self.take if isinstance(self.take, dict) else {c: F.col(c) for c in self.take}
        return {self.prefix + name: c for name, c in given.items()}


def asof_many(left: DataFrame, *, by: str, left_ts: str, sources: list[Source], keyed: bool = False, block: int | None = None) -> DataFrame:
    """left with what each of the sources has at the row's instant, by one shuffle of all of them.

    block: keys of more rows than this, of all tables together, are dealt over tasks by time, and what earlier (or, for
    forward sources, later) blocks end with is carried in; the result is the same. It takes a count of the keys first.

    Left rows without key or instant stay, unmatched, dealt over the tasks by a hash; with keyed they are dropped, and
    the result stays partitioned by the key: each table is dealt by it before it gets the others' columns (not at all if
    it is so already), and the union of tables dealt alike is shuffled no more. Source rows without key or instant never
    match.
    """
    dealt = (lambda df: df.where(F.col(by).isNotNull()).repartition(by)) if keyed else (lambda df: df)
    own = dealt(left).select(F.struct(*left.columns).alias("_l"), F.col(by).alias("_k"), micros(left_ts).alias("_t"), F.lit(1).alias("_side"))
    if keyed:
        own = own.where(F.col("_k").isNotNull() & F.col("_t").isNotNull())
    parts, payloads = [own], []
    for i, s in enumerate(sources):
        instant = F.col(s.ts).alias("at")
        if s.each:
            held = [F.when(c.isNotNull(), F.struct(instant, c.alias("v0"))).alias(f"_p{i}_{j}") for j, c in enumerate(s.named().values())]
        else:
            held = [F.struct(instant, *[c.alias(f"v{j}") for j, c in enumerate(s.named().values())]).alias(f"_p{i}_0")]
        tie = [F.struct(*s.ties).alias(f"_tie{i}")] if s.ties else []
        # At one instant, a source's rows come first in the reading direction if equal instants match, else last.
        side = F.lit(0 if s.exact else 2).alias("_side")
        r = s.rows.where(F.col(by).isNotNull() & F.col(s.ts).isNotNull())
        parts.append(dealt(r).select(F.col(by).alias("_k"), micros(s.ts).alias("_t"), side, *held, *tie))
        payloads.append([f"_p{i}_{j}" for j in range(len(held))])
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    group = "_k"
    if not keyed and isinstance(left.schema[by].dataType, (T.IntegralType, T.StringType)):
        # No payload comes from a left row, so those without a key may be dealt among the others.
        group = F.coalesce("_k", F.xxhash64("_l").cast(left.schema[by].dataType) if isinstance(left.schema[by].dataType, T.StringType) else F.pmod(F.xxhash64("_l"), F.lit(32_768)).cast(left.schema[by].dataType))
    rows, blocks = in_blocks(rows, ["_k"], "_t", block)
    for back in (True, False):
        mine = [i for i, s in enumerate(sources) if (s.direction == "backward") == back]
        if not mine:
            continue
        way = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
        order = [way("_t"), F.col("_side"), *[way(f"_tie{i}") for i in mine if sources[i].ties]]
        w = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow) if blocks else Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        mine = [p for i in mine for p in payloads[i]]
        if blocks:
            rows = rows.withColumn("_at", F.row_number().over(w))
            ends = {f"_c{p}": F.max_by(p, F.when(F.col(p).isNotNull(), F.col("_at"))) for p in mine}
            rows = carry_in(rows, ["_k"], blocks, ends, lambda c: F.last(c, ignorenulls=True), back)
        local = {p: F.last(p, ignorenulls=True).over(w) for p in mine}
        rows = rows.withColumns({p: F.coalesce(c, F.col(f"_c{p}")) if blocks else c for p, c in local.items()})
    rows = rows.where(F.col("_l").isNotNull())
    out = [F.col("_k").alias(by) if c == by else F.col(f"_l.`{c}`").alias(c) for c in left.columns]
    for i, s in enumerate(sources):
        for j, name in enumerate(s.named()):
            p = payloads[i][j if s.each else 0]
            away = (F.col("_t") - micros(f"{p}.at")) * (1 if s.direction == "backward" else -1)
            ok = F.col("_t").isNotNull() & F.col("_k").isNotNull() & F.col(p).isNotNull()
            if s.tolerance is not None:
                ok &= away <= s.tolerance
            out.append(F.when(ok, F.col(f"{p}.v{0 if s.each else j}")).alias(name))
        if s.gap:
            out.append(F.when(ok, away).alias(s.gap))
    return rows.select(*out)


def asof(left: DataFrame, right: DataFrame, *, by: str, left_ts: str, right_ts: str, take: list[str], direction: str = "backward", exact: bool = True, tolerance: int | None = None, ties: list[str] | None = None, prefix: str = "", gap: str | None = None, keyed: bool = False, block: int | None = None) -> DataFrame:
    """left with the columns `take` of the nearest earlier (backward) or later (forward) row of right with its key; see Source."""
    source = Source(right, right_ts, take, direction, exact, tolerance, ties or [], prefix, gap)
    return asof_many(left, by=by, left_ts=left_ts, sources=[source], keyed=keyed, block=block)
