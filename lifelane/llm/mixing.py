"""Mixing sources to target weights: exact budgets by a bounded knapsack over document lengths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)


def sized(documents: DataFrame) -> DataFrame:
    """documents with size, their number of words (null text: 0)."""
    return documents.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: list[int], weights: list[float], total: float | None = None, most: float = MAX_REPEATS) -> list[float]:
    """Shares total (default: the sum of sizes) by weight; no share passes most times its size, the excess is reshared."""
    left = float(sum(sizes) if total is None else total)
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in full or free:
            out[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        free -= set(full)
        left -= sum(out[i] for i in full)
    return out


def fit_counts(counts: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many documents of each length to take, for a total as near to budget as the lengths allow without passing it.

    counts: (length, documents). First every length gives the same share of its documents; what is left of the budget
    is filled from the longest length down, until it is small; a bounded knapsack, as a bit set of reachable sums for
    each length in turn, then fits the rest exactly where a subset does.
    """
    counts = [(n, c) for n, c in counts if n > 0 and c > 0]
    whole = sum(n * c for n, c in counts)
    if budget >= whole:
        return dict(counts)
    if budget <= 0:
        return {}
    taken = {n: c * budget // whole for n, c in counts}
    left = budget - sum(n * taken[n] for n in taken)
    small = 2 * counts_median(counts)
    for n, c in sorted(counts, reverse=True):
        if left > small and n <= left - small // 2:
            more = min(c - taken[n], (left - small // 2) // n)
            taken[n] += more
            left -= more * n
    for n, k in knapsack([(n, c - taken[n]) for n, c in counts], left).items():
        taken[n] += k
    return {n: k for n, k in taken.items() if k}


def knapsack(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each length, at most as many as there are, for the largest total up to budget.

    A bit set holds the sums that are reachable with the lengths so far, shortest first; counts are taken in powers of
    two. It ends once the budget itself is reached, and the lengths are read off backwards.
    """
    items = sorted((n, c) for n, c in items if c > 0 and n <= budget)
    mask = (1 << budget + 1) - 1
    reach, before = 1, []
    for n, c in items:
        before.append(reach)
        size = 1
        while c:
            k = min(size, c)
            reach |= reach << n * k & mask
            c, size = c - k, size * 2
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for (n, _), old in zip(reversed(items[: len(before)]), reversed(before), strict=True):
        while not old >> at & 1:
            out[n] = out.get(n, 0) + 1
            at -= n
    return out


def counts_median(counts: list[tuple[int, int]]) -> int:
    half, seen = sum(c for _, c in counts) / 2, 0
    for n, c in sorted(counts):
        seen += c
        if seen >= half:
            return max(n, 64)
    return 64


def pick(rows: DataFrame, keys: list[str], want: DataFrame, seed: int, buckets: int = 256) -> DataFrame:
    """The rows of each key group with the lowest seeded hashes of doc_id and _key, as many as want (keys, n) says: exactly that many.

    Groups are split into buckets of the hash: buckets below the cut are taken whole, those above not at all, and only
    the one that holds the cut is ranked, so that no task sorts a whole hot group.
    """
    names = rows.columns
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "_key")).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    sums = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_in"))
        .withColumn("_below", F.sum("_in").over(order) - F.col("_in"))
        .join(want, keys)
        .where(F.col("_below") < F.col("n"))
        .select(*keys, "_bucket", F.least(F.col("n") - F.col("_below"), "_in").alias("_take"), (F.col("n") - F.col("_below") >= F.col("_in")).alias("_all"))
    )
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_bucket"]]
    found = rows.alias("r").join(sums.alias("s"), _all(same)).select("r.*", "s._take", "s._all")
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_hash", "doc_id"))
    cut = found.where(~F.col("_all")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_take"))
    return found.where("_all").select(*names).unionByName(cut.select(*names))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


NO_SOURCE = "\x00null"


def plan(rows: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """rows (doc_id, source, size, any other columns) with source_size, target, times (the copies the mix takes) and _key.

    Sources in order of their code points, null last, take the weights in turn. Each takes whole rounds of all its
    documents, at most MAX_REPEATS, then a seeded choice by length for the rest of its target. Documents without words
    (null and empty texts) are never taken: times is 0. Ties are broken by a hash of the whole row (_key), so that
    reruns agree; of rows that are equal throughout it doesn't matter which is taken. rows is written once, so what
    it computes is computed once. One row for each source passes through the driver; lengths are fitted by one task
    for each source, documents are chosen on the executors.
    """
    from .common import let_go, stored

    rows = stored(rows.withColumn("_source", F.coalesce("source", F.lit(NO_SOURCE))).withColumn("_key", F.xxhash64(*rows.columns)), "sized")
    lengths = stored(rows.where("size > 0").groupBy("_source", "size").agg(F.count("*").alias("n")), "lengths")
    sums = rows.groupBy("_source").agg(F.sum("size").alias("total")).collect()
    totals = sorted(((r._source == NO_SOURCE, r._source.encode(), r.total), r._source) for r in sums)
    found = targets([k[2] for k, _ in totals], [weights[i % len(weights)] for i in range(len(totals))])
    goal = {name: (k[2], t) for (k, name), t in zip(totals, found, strict=True)}

    def fitted(lengths: pa.Table) -> pa.Table:
        let_go()
        name = lengths.column("_source")[0].as_py()
        total, target = goal[name]
        rest = int(round(target)) - rounds(total, target) * total
        chosen = fit_counts(list(zip(lengths.column("size").to_pylist(), lengths.column("n").to_pylist(), strict=True)), rest)
        columns = [pa.array([name] * len(chosen), pa.string()), pa.array(list(chosen), pa.int64()), pa.array(list(chosen.values()), pa.int64())]
        return pa.Table.from_arrays(columns, ["_source", "size", "n"])

    want = stored(lengths.groupBy("_source").applyInArrow(fitted, "_source string, size long, n long"), "chosen")
    row = ["doc_id", "_source", "size", "_key"]
    extra = pick(rows.select(*row).where("size > 0"), ["_source", "size"], want, seed)
    extra = extra.groupBy(*row).agg(F.count("*").alias("_n"))
    facts = rows.sparkSession.createDataFrame([(s, t, float(g), rounds(t, g)) for s, (t, g) in goal.items()], "_source string, source_size long, target double, _rounds int")
    # Of equal rows the first ones take what was chosen.
    again = F.row_number().over(Window.partitionBy(*row).orderBy("_key"))
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in row]
    out = rows.withColumn("_again", again).alias("a").join(extra.alias("b"), _all(keys), "left").select("a.*", F.coalesce("b._n", F.lit(0)).alias("_n"))
    times = F.when(F.col("size") > 0, F.col("_rounds") + (F.col("_again") <= F.col("_n")).cast("int")).otherwise(0)
    return out.join(F.broadcast(facts), "_source").withColumn("times", times).drop("_source", "_again", "_n", "_rounds")


def rounds(total: int, target: float) -> int:
    return min(MAX_REPEATS, int(math.floor(round(target) / total))) if total else 0


def op9_subset_sum_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each row of documents; null ids and repeated rows keep a row each, other columns are ignored."""
    from .common import table

    rows = sized(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size")
    return plan(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mix(documents: DataFrame) -> DataFrame:
    """The mixed corpus: each row of documents as often as the plan takes it, with the columns of documents.

    The plan is made of narrow rows; the texts are shuffled once, to meet it. See plan() for empty texts, ties and
    repeated rows.
    """
    row = F.xxhash64(*documents.columns)
    taken = plan(sized(documents.select("doc_id", "source", "text", row.alias("_row"))).drop("text")).where("times > 0")
    taken = taken.groupBy("doc_id", "_row").agg(F.sum("times").alias("_times"), F.count("*").alias("_rows"))
    # The window and the join have the same keys without nulls, so the texts are shuffled and sorted once for both.
    keys = {"_null": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}
    same = ["_row", *keys]
    # Equal rows share what they take: each the same, and the first ones one more each.
    again = F.row_number().over(Window.partitionBy(*same).orderBy(*same)) - 1
    rows = documents.withColumns({**keys, "_row": row}).withColumn("_again", again)
    both = rows.join(taken.withColumns(keys).drop("doc_id"), same)
    times = F.floor(F.col("_times") / F.col("_rows")) + (F.col("_again") < F.col("_times") % F.col("_rows")).cast("int")
    both = both.withColumn("_copies", times.cast("int")).where("_copies > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*documents.columns)
