"""What was known at each instant: active and past codes, counts of what came before."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import floor_days, micros
from ..sources.io import written
from .blocks import in_blocks


#: Stands for the end of an interval without one.
OPEN = (1 << 63) - 1
#: A key of more rows is swept in blocks of about so many, each by its own task.
BLOCK = 1_000_000


class Sweep:
    """What is known of a key as its intervals start and end: its active codes, in order, and those that began before.

    Starts come in order of time. An end is an entry of a heap, looked at once time has passed it, so an instant costs
    what changes at it; the state is a few figures for each code, however many instants there are. inclusive: an
    interval that ends at an instant is active at it. starting: what starts at an instant is active at it whatever its
    end.
    """

    def __init__(self, inclusive: bool, starting: bool, prefixes: dict[str, tuple[str, ...]], texts: bool = True):
        self.inclusive, self.starting, self.prefixes, self.texts = inclusive, starting, prefixes, texts
        self.first, self.last, self.until, self.rows = {}, {}, {}, {}
        self.active, self.past, self.began, self.ends, self.short = [], [], "", [], []
        self.flagged = dict.fromkeys(prefixes, 0)

    def carry(self, code: str, first: int, last: int, until: int, rows: int) -> None:
        """A code's figures from before the first instant."""
        self.first[code], self.last[code], self.until[code], self.rows[code] = first, last, until, rows
        insort(self.past, code)
        self._open(code, until)

    def _open(self, code: str, until: int) -> None:
        at = bisect_left(self.active, code)
        if at == len(self.active) or self.active[at] != code:
            self.active.insert(at, code)
            for name, own in self.prefixes.items():
                self.flagged[name] += code.startswith(own)
        if until < OPEN:
            heappush(self.ends, (until, code))

    def _close(self, code: str) -> None:
        del self.active[bisect_left(self.active, code)]
        for name, own in self.prefixes.items():
            self.flagged[name] -= code.startswith(own)

    def at(self, t: int, starts: list[tuple[str, int]], past_inclusive: bool) -> tuple[list[str], str, int, dict[str, int]]:
        """Active codes, those begun before (joined, and their number), and how often each of starts began before t.

        starts: (code, end) of the intervals that start at t. The list of active codes is the sweep's own.
        """
        times = {code: self.rows.get(code, 0) for code, _ in starts}
        if not past_inclusive:
            before = self._joined(), len(self.past)
        for entry in self.short:
            heappush(self.ends, entry)
        self.short = []
        for code, end in starts:
            if code not in self.first:
                self.first[code] = t
                insort(self.past, code)
                self.began = ""
            self.last[code] = t
            self.rows[code] = self.rows.get(code, 0) + 1
            self.until[code] = max(end, self.until.get(code, end))
            self._open(code, self.until[code])
        while self.ends and (self.ends[0][0] < t or (self.ends[0][0] == t and not self.inclusive)):
            end, code = heappop(self.ends)
            if self.until[code] != end or self._absent(code):
                continue  # a longer interval has taken its place
            if self.starting and self.last[code] == t:
                self.short.append((end, code))
            else:
                self._close(code)
        if past_inclusive:
            before = self._joined(), len(self.past)
        return self.active, *before, times

    def _absent(self, code: str) -> bool:
        at = bisect_left(self.active, code)
        return at == len(self.active) or self.active[at] != code

    def _joined(self) -> str:
        if self.texts and not self.began:
            self.began = ",".join(self.past)
        return self.began


def carried(rows: DataFrame, key: str, code: str) -> DataFrame:
    """For each block of a key and each code that began in an earlier one, its figures up to there.

    Rows of a block are summed first, so what is joined is a few figures for each block and code, never rows.
    """
    end = F.coalesce("_e", F.lit(OPEN))
    per = rows.groupBy(key, "_block", code).agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"), F.max(end).alias("_until"), F.count("*").alias("_rows"), F.max("_blocks").alias("_blocks"))
    later = per.where(F.col("_block") < F.col("_blocks")).withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, F.col("_blocks"))))
    return later.groupBy(key, "_block", code).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_until").alias("_until"), F.sum("_rows").alias("_rows"))


SWEPT = "_active string, _n_active long, _past string, _n_past long, _times long"


def swept(df: DataFrame, key: str, code: str, start: str, end: str, *, end_inclusive: bool, past_inclusive: bool, exclude_own: bool, starting: bool = True, prefixes: dict[str, tuple[str, ...]] | None = None, block: int | None = None, texts: bool = True) -> DataFrame:
    """df with SWEPT and a truth value for each of prefixes: one shuffle by key, one sweep through each key's starts.

    A task holds a Sweep and the rows of one instant. A key of more than `block` rows is dealt over tasks by time; what
    its earlier blocks leave behind is sent ahead of each block's rows. The rows are written before their keys are counted,
    so what makes them is done once. texts: where only flags and numbers are wanted, False leaves both texts empty.
    """
    flags = prefixes or {}
    rows = df.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(code).isNotNull())
    rows = written(rows, "swept").withColumns({"_s": micros(start), "_e": micros(end)})
    rows, _ = in_blocks(rows, [key], "_s", BLOCK if block is None else block)
    stream = rows.drop("_blocks").withColumns({"_kind": F.lit(1), "_first": F.lit(None).cast("long"), "_last": F.lit(None).cast("long"), "_until": F.lit(None).cast("long"), "_rows": F.lit(None).cast("long")})
    stream = stream.unionByName(carried(rows.where(F.col("_blocks") > 0), key, code).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    stream = stream.repartition(key, "_block").sortWithinPartitions(key, "_block", "_kind", "_s")
    names = df.columns
    own = names.index(code)
    places = {c: stream.columns.index(c) for c in (key, "_block", "_kind", "_s", "_e", "_first", "_last", "_until", "_rows")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sweep, rest = None, None, None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal now, sweep
            keys, blocks, kinds, at = (table.column(places[c]).to_pylist() for c in (key, "_block", "_kind", "_s"))
            ends = pc.fill_null(table.column(places["_e"]), OPEN).to_pylist()
            codes, n, i, keep = table.column(own).to_pylist(), table.num_rows, 0, []
            ahead = [table.column(places[c]).to_pylist() for c in ("_first", "_last", "_until", "_rows")] if 0 in kinds else []
            lists, counts, pasts, past_counts, before, flagged = [], [], [], [], [], {f: [] for f in flags}
            while i < n:
                here = (keys[i], blocks[i])
                if here != now:
                    now, sweep = here, Sweep(end_inclusive, starting, flags, texts)
                if kinds[i] == 0:
                    sweep.carry(codes[i], *[c[i] for c in ahead])
                    i += 1
                    continue
                t, j = at[i], i + 1
                while j < n and at[j] == t and (keys[j], blocks[j]) == here:
                    j += 1
                active, past, n_past, times = sweep.at(t, list(zip(codes[i:j], ends[i:j])), past_inclusive)
                known = set(active) if exclude_own else ()
                joined = ",".join(active) if texts else ""
                for r in range(i, j):
                    c = codes[r]
                    mine = c in known
                    lists.append(",".join(a for a in active if a != c) if mine and texts else joined)
                    counts.append(len(active) - mine)
                    before.append(times[c])
                    for f, p in flags.items():
                        flagged[f].append(sweep.flagged[f] - (mine and c.startswith(p)) > 0)
                pasts.extend([past] * (j - i))
                past_counts.extend([n_past] * (j - i))
                keep.extend(range(i, j))
                i = j
            if keep:
                kept = (table if len(keep) == n else table.take(pa.array(keep))).select(range(len(names)))
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.bool_() for _ in flags]]
                new = [pa.array(c, t) for c, t in zip([lists, counts, pasts, past_counts, before, *flagged.values()], types, strict=True)]
                fields = [*kept.schema, *[pa.field(f.split()[0], t) for f, t in zip([*SWEPT.split(", "), *flags], types, strict=True)]]
                yield from pa.Table.from_arrays([*kept.columns, *new], schema=pa.schema(fields)).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            # The last instant may go on in the next batch.
            last, cut = table.slice(table.num_rows - 1, 1), table.num_rows - 1
            same = [last.column(places[c])[0].as_py() for c in (key, "_block", "_kind", "_s")]
            while cut > 0 and [table.column(places[c])[cut - 1].as_py() for c in (key, "_block", "_kind", "_s")] == same:
                cut -= 1
            rest = table.slice(cut)
            if cut:
                yield from done(table.slice(0, cut))
        if rest is not None:
            yield from done(rest)

    schema = T.StructType([*df.schema, *T.StructType.fromDDL(SWEPT), *[T.StructField(f, T.BooleanType()) for f in flags]])
    return stream.mapInArrow(run, schema)


def code_history(df: DataFrame, key: str, code: str, start: str, end: str, *, end_inclusive: bool, past_inclusive: bool, exclude_own: bool, prefixes: dict[str, tuple[str, ...]] | None = None, texts: bool = True) -> DataFrame:
    """df with active_codes and past_codes (sorted, joined by commas), n_active, n_past, times_before and a flag for each of prefixes.

    At a row's start t: active are codes that start at t, or started before and have no end or end after t (at t too,
    if end_inclusive), without the row's own code if exclude_own; past are codes that started before t (or at t, if
    past_inclusive); times_before counts rows of the row's own code that started before t. A flag tells whether an
    active code begins with one of its prefixes. Rows without key, start or code are dropped. See swept() for long keys and texts.
    """
    rows = swept(df, key, code, start, end, end_inclusive=end_inclusive, past_inclusive=past_inclusive, exclude_own=exclude_own, prefixes=prefixes, texts=texts)
    out = {"active_codes": F.col("_active"), "n_active": F.col("_n_active"), "past_codes": F.col("_past"), "n_past": F.col("_n_past")}
    return rows.select(*df.columns, F.col("_times").alias("times_before"), *[c.alias(n) for n, c in out.items()], *(prefixes or {}))


def count_before(df: DataFrame, key: str, ts: str, conditions: dict[str, Column]) -> DataFrame:
    """df with, for each name, how many rows of the key strictly before the row's instant meet the condition."""
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_t", micros(ts))
    return rows.withColumns({k: F.coalesce(F.sum(c.cast("long")).over(w), F.lit(0)) for k, c in conditions.items()}).drop("_t")


def test_history(df: DataFrame, key: str, ts: str, abnormal: str) -> DataFrame:
    """Per (key, instant): tests_before, abnormal_before, days_since_previous and the share of abnormal tests before."""
    per = df.groupBy(key, ts).agg(F.count("*").alias("_n"), F.sum(F.col(abnormal).cast("long")).alias("_a"))
    w = Window.partitionBy(key).orderBy(ts)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = per.withColumns(
        {
            "tests_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "abnormal_before": F.coalesce(F.sum("_a").over(before), F.lit(0)),
            "days_since_previous": floor_days(F.col(ts), F.lag(ts).over(w)),
        }
    )
    return out.withColumn("abnormal_share", F.try_divide(F.col("abnormal_before"), F.col("tests_before"))).drop("_n", "_a")


def stay_history(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """df with stay_days (floored), stays_before and stay_days_before."""
    w = Window.partitionBy(key).orderBy(start, tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("stay_days", floor_days(end, start))
    return out.withColumns({"stays_before": (F.row_number().over(w) - 1).cast("long"), "stay_days_before": F.coalesce(F.sum("stay_days").over(before), F.lit(0))})


def event_number(df: DataFrame, key: str, ts: str, tie: str, out: str = "event_number") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(ts, tie)).cast("long"))
