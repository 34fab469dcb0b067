"""Rank correlations of many columns: each column is ranked once, and outer products of a row's ranks are summed once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks, student
from ..sources.io import drop, written

#: Bits of a long that say which columns of a row are null.
BITS = 62
#: Doubles that a task holds at once: rows x columns x patterns.
HELD = 2_000_000


def null_patterns(df: DataFrame, columns: list[str]) -> list[int]:
    """The pattern of each column, from 0: columns that are null in the same rows share one. One pass, bits only."""
    words = [columns[i : i + BITS] for i in range(0, len(columns), BITS)]
    bit = lambda c, i: F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    packed = []
    for word in words:
        w = F.lit(0).cast("long")
        for i, c in enumerate(word):
            w = w.bitwiseOR(bit(c, i))
        packed.append(w)
    nulls = df.select(*[w.alias(f"w{j}") for j, w in enumerate(packed)]).distinct()  # combined within tasks
    aggs = []
    for i in range(len(columns)):
        own = F.col(f"w{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS))) != 0
        for j, word in enumerate(words):
            w = F.col(f"w{j}")
            aggs.append(F.bit_or(F.when(own, w.bitwiseXOR(F.lit((1 << len(word)) - 1).cast("long"))).otherwise(w)).alias(f"d{i}_{j}"))
    differs = nulls.agg(*aggs).collect()[0]
    found: dict[tuple, int] = {}
    return [found.setdefault(tuple(differs[f"d{i}_{j}"] or 0 for j in range(len(words))), len(found)) for i in range(len(columns))]


def _products(left: list[int], right: list[int], pattern: list[int], firsts: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums of products of ranks: a, b and s for each pair of left and right that a row of it has."""
    p, k = len(pattern), len(firsts)
    of = np.array(pattern)
    step = max(1, HELD // (p * k))
    sides = [(a, b, [i for i in left if of[i] == a], [i for i in right if of[i] == b]) for a in range(k) for b in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                cells = batch.column(0).slice(at, step)
                flat = cells.flatten()
                row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
                column = flat.field("c").to_numpy()
                dense = np.zeros((len(cells), p, k))
                there = np.zeros((len(cells), p), dtype=bool)
                dense[row, column] = flat.field("r").flatten().to_numpy().reshape(-1, k)
                there[row, column] = True
                dense *= there[:, firsts][:, None, :]
                for a, b, i, j in sides:
                    if i and j:
                        total[np.ix_(i, j)] += dense[:, i, b].T @ dense[:, j, a]
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["a", "b", "s"])

    return run


def correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """a, b, rho, n: the correlation of the ranks of a (of left) and b (of right) over the rows that have both, ties sharing their mean rank.

    One row for each pair of two columns (once, where both are in left and in right); rho is null without spread or
    rows, and n then is what it is. Repeated rows count each.

    A column's rank depends on the other column only by which rows that one leaves out, so it is computed once for each
    null pattern: value counts with a count for each pattern, summed from below. Ranks are taken from their mean, which
    is known, so sums of products are covariances, exact to a double's digits at any size, and spreads come from the
    value counts. What is shuffled: a row for each value of each column (no row for a pair), ranks beside it, and
    at the end a number for each pair and task. A row with q columns and k patterns has q * k ranks.
    """
    names = list(dict.fromkeys([*left, *right]))
    place = {c: i for i, c in enumerate(names)}
    pairs = [(a, b) for i, a in enumerate(left) for b in right if a != b and not (b in left[:i] and a in right)]
    rows = written(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)]).withColumn("id", F.monotonically_increasing_id()), "correlations")
    own = [f"c{i}" for i in range(len(names))]
    pattern = null_patterns(rows, own)
    firsts = [pattern.index(k) for k in range(max(pattern) + 1)]
    sums = [f"s{k}" for k in range(len(firsts))]

    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(own)])
    has = [F.col(f"c{i}").isNotNull().cast("long").alias(f"h{k}") for k, i in enumerate(firsts)]
    long = rows.select("id", *has, F.explode(cells).alias("e")).select("id", *[f"h{k}" for k in range(len(firsts))], "e.c", "e.v").where("v IS NOT NULL")
    counted = ranks.value_counts(long, "v", ("c",), {s: F.sum(f"h{k}") for k, s in enumerate(sums)}, few=True)
    r = F.array(*[F.col(f"{s}_below") + (F.col(s) - F.col(f"{s}_total")) / 2 for s in sums])
    ranked = written(counted.select("c", "v", r.alias("r"), F.array(*sums).alias("s"), F.array(*[f"{s}_total" for s in sums]).alias("n")), "correlations")

    spread = ranked.select("c", F.posexplode(F.arrays_zip("r", "s", "n")).alias("k", "e")).groupBy("c", "k").agg(F.sum(F.col("e.s") * F.col("e.r") * F.col("e.r")).alias("q"), F.max("e.n").alias("n"))
    per_row = long.select("id", "c", "v").join(ranked.select("c", "v", "r"), ["c", "v"]).groupBy("id").agg(F.collect_list(F.struct("c", "r")).alias("cells"))
    took = _products([place[c] for c in left], [place[c] for c in right], pattern, firsts)
    products = per_row.select("cells").mapInArrow(took, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))

    spark = df.sparkSession
    wanted = spark.createDataFrame([(place[a], place[b], pattern[place[a]], pattern[place[b]], a, b) for a, b in pairs], "i int, j int, ki int, kj int, a string, b string")
    one = spread.select(F.col("c").alias("i"), F.col("k").alias("kj"), F.col("q").alias("qi"), "n")
    two = spread.select(F.col("c").alias("j"), F.col("k").alias("ki"), F.col("q").alias("qj"))
    out = wanted.join(products.select(F.col("a").alias("i"), F.col("b").alias("j"), "s"), ["i", "j"], "left").join(one, ["i", "kj"], "left").join(two, ["j", "ki"], "left")
    rho = F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt(F.col("qi")) * F.sqrt(F.col("qj")))
    # A number for each pair is all that is left, so what was written for it can go.
    done = written(out.select("a", "b", rho.alias("rho"), F.coalesce("n", F.lit(0)).cast("long").alias("n")), "correlations")
    drop(rows, ranked)
    return done


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, rho, n: rank correlation of each column with target over the rows that have both."""
    return correlations(df, columns, [target]).select(F.col("a").alias("feature"), "rho", "n")


def spearman_pairs(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """a, b, rho, n, p of every pair of columns over the rows that have both; rho and p are null below least rows."""
    out = correlations(df, columns, columns).withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))
    t = F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))).when(F.col("rho").isNotNull(), F.lit(float("inf")))
    return out.select("a", "b", "rho", "n", student.p_value(t, F.col("n") - 2).alias("p"))
