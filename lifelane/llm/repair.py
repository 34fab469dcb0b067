"""Conversation structure repair: the cheapest edits that make the roles alternate, as lightest derivations of an agenda."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, stored

SPACE = " \t\n\x0b\x0c\r"
DELETE, RETRUNCATE, INSERT = 2, 5, 5
NEVER = 1 << 60
#: What the roles so far amount to: nothing, a system turn, ended by a user turn, ended by an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (0, NEVER, NEVER, 0)
#: For each state the (state before, initial) that lead to it: the roles are (s?(ua)+)?.
BEFORE = ((), ((START, "s"),), ((START, "u"), (SYSTEM, "u"), (ASSISTANT, "u")), ((USER, "a"),))
INITIALS = "sua-"
FINE, FORCED, TRUNCATED = range(3)
BLOCK = 4096  # rows of a conversation that are one block
LONG = 16  # a conversation of more blocks is repaired block by block


def lightest(classes: bytes, after: tuple[int, ...] = ACCEPTED, starts: tuple[int, ...] = (START,)) -> dict[int, tuple[int, str, int]]:
    """For each start state, (cost, audit, state at the end) of the cheapest edits of rows, by ties the least audit.

    classes: a byte for each row, 3 * its role's place in INITIALS + its fault. after: what it costs to go on from each
    state once the rows are used up.

    An item (i, q) says: rows i and on are repaired from state q. Its deductions (Keep, Rerole and Delete of row i,
    Insert before it) each have one antecedent, and cost nothing or more on top of it. The agenda pops by (cost, rows
    used, letter): every deduction's result lies above its antecedent, and for the deductions of one item, which use as
    many rows and begin with different letters, this is the order of (cost, audit). So what is popped first is final.
    """
    n = len(classes)
    agenda = [(cost, 0, "", n * 4 + q, -1) for q, cost in enumerate(after) if cost < NEVER]
    heapq.heapify(agenda)
    final, goals = {}, set(starts)
    while agenda and goals:
        cost, used, letter, item, antecedent = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, letter, antecedent)
        i, q = divmod(item, 4)
        if i == 0:
            goals.discard(q)
        for p, initial in BEFORE[q]:
            if initial != "s":
                heapq.heappush(agenda, (cost + INSERT, used, "I", i * 4 + p, item))
        if i == 0:
            continue
        role, fault = divmod(classes[i - 1], 3)
        heapq.heappush(agenda, (cost + DELETE, used + 1, "D", item - 4, item))
        if fault != FORCED:
            more = cost + RETRUNCATE * (fault == TRUNCATED)
            for p, initial in BEFORE[q]:
                if initial == INITIALS[role]:
                    heapq.heappush(agenda, (more, used + 1, "K", (i - 1) * 4 + p, item))
                elif initial != "s":
                    heapq.heappush(agenda, (more + 1, used + 1, "R", (i - 1) * 4 + p, item))
    out = {}
    for q in starts:
        if q in final:
            letters, item = [], q
            while final[item][2] >= 0:
                letters.append(final[item][1])
                item = final[item][2]
            out[q] = (final[q][0], "".join(letters), item % 4)
    return out


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn of the repaired conversation; rows: (role, text) in order, read as far as needed."""
    state = START
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        yield letter, role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a hash of conversation and turn: dropped, emptied, cut, repeated, or all user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault")
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("again")).drop("again")


KEYED = ("k", "turn", "role", "h")
BLOCKS = "k string, at long, classes binary, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, lo long, hi long, turns long"


def keyed(rows: DataFrame) -> DataFrame:
    """rows with the key k of their conversation (empty for a null one) and h, by which rows of one turn and role are ordered and compared."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("h"), text.alias("text"))


def blocks(rows: DataFrame) -> DataFrame:
    """A row for each block of at most BLOCK rows of a conversation: the classes of its rows, and what adds up over blocks.

    The rows, without their texts, are dealt by ranges of (conversation, turn), so a long conversation lies on many tasks.
    """
    end = F.rtrim("text", F.lit(SPACE))
    initial = F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("-")
    narrow = rows.select(*KEYED, initial.alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(*".!?")).alias("truncated"))
    # A text that its role has said at an earlier turn; what is repeated at one turn is seen in the sorted stream.
    said = rows.groupBy("k", "role", "h").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.bool_or(F.col("turn").isNull()).alias("null_turn"))
    said = said.where((F.col("lo") < F.col("hi")) | (F.col("null_turn") & F.col("lo").isNotNull())).select("k", "role", "h", "lo", "null_turn")
    repeated = (F.col("turn") > F.col("lo")) | (F.col("null_turn") & F.col("turn").isNotNull())
    narrow = narrow.join(said, ["k", "role", "h"], "left").select(*narrow.columns, F.coalesce(repeated, F.lit(False)).alias("repeated"))
    dealt = narrow.repartitionByRange("k", F.asc_nulls_first("turn"), "role", "h").sortWithinPartitions("k", F.asc_nulls_first("turn"), "role", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, before, held, out = TaskContext.get().partitionId() << 32, None, None, []
        for batch in slices(batches, 4096):
            for k, turn, role, h, initial, blank, truncated, repeated in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if held is None or held["k"] != k or held["n"] == BLOCK:
                    if held is not None:
                        out.append(held)
                    held = {"k": k, "at": place, "classes": bytearray(), "n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": initial, "last": None, "lo": None, "hi": None, "turns": 0}
                    place += 1
                fault = FINE
                if blank:
                    held["blank"] += 1
                    fault = FORCED
                elif repeated or (k, turn, role, h) == before:
                    held["duplicate"] += 1
                    fault = FORCED
                elif truncated:
                    held["truncated"] += 1
                    fault = TRUNCATED
                before = (k, turn, role, h)
                held["classes"].append(3 * INITIALS.index(initial) + fault)
                held["illegal"] += held["n"] > 0 and held["last"] + initial not in ("su", "ua", "au")
                held["last"] = initial
                held["n"] += 1
                if turn is not None:
                    held["turns"] += turn != held["hi"]
                    held["lo"] = turn if held["lo"] is None else held["lo"]
                    held["hi"] = turn
            if out:
                yield _block_batch(out)
                out = []
        if held is not None:
            yield _block_batch([held])

    return dealt.mapInArrow(run, BLOCKS)


def _block_batch(rows: list[dict]) -> pa.RecordBatch:
    for r in rows:
        r["classes"] = bytes(r["classes"])
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in fields], names=[n for n, _ in fields])


def long_audits(parts: DataFrame) -> DataFrame:
    """k, at, cost, audit for each block of conversations of many blocks.

    Spans are items too: a block's table holds the lightest derivation from each state to each. Tables are joined from
    the last block to the first (what the rest costs from each state), then each block is solved against what comes
    after it, and the states between blocks are read off from the first to the last. A task holds a block's classes, or
    a few numbers for each block of a conversation, never its rows.
    """

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cells = []
            for classes in f["classes"]:
                cell = [NEVER] * 16
                for end in range(4):
                    unit = tuple(0 if q == end else NEVER for q in range(4))
                    for q, (cost, _, _) in lightest(bytes(classes), unit, (0, 1, 2, 3)).items():
                        cell[4 * q + end] = cost
                cells.append(cell)
            yield f[["k", "at"]].assign(cells=cells)

    def later(f: pd.DataFrame) -> pd.DataFrame:
        f, after, out = f.sort_values("at", ascending=False), list(ACCEPTED), []
        for cell in f["cells"]:
            out.append(after)
            after = [min(int(cell[4 * q + r]) + after[r] for r in range(4)) for q in range(4)]
            after = [min(c, NEVER) for c in after]
        return f[["k", "at"]].assign(after=out)

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [lightest(bytes(c), tuple(map(int, a)), (0, 1, 2, 3)) for c, a in zip(f["classes"], f["after"], strict=True)]
            pick = lambda i, none: [[s[q][i] if q in s else none for q in range(4)] for s in found]
            yield f[["k", "at"]].assign(costs=pick(0, NEVER), audits=pick(1, ""), ends=pick(2, 0))

    def entered(f: pd.DataFrame) -> pd.DataFrame:
        f, state, out = f.sort_values("at"), START, []
        for ends in f["ends"]:
            out.append(state)
            state = int(ends[state])
        return f[["k", "at"]].assign(state=out)

    cells = stored(parts.select("k", "at", "classes").mapInPandas(tables, "k string, at long, cells array<long>"), "cells")
    after = cells.groupBy("k").applyInPandas(later, "k string, at long, after array<long>")
    done = stored(parts.select("k", "at", "classes").join(after, ["k", "at"]).mapInPandas(solved, "k string, at long, costs array<long>, audits array<string>, ends array<int>"), "solved")
    states = done.select("k", "at", "ends").groupBy("k").applyInPandas(entered, "k string, at long, state int")
    out = stored(done.join(states, ["k", "at"]).select("k", "at", F.get("costs", "state").alias("cost"), F.get("audits", "state").alias("audit")), "audits")
    drop(cells, done)
    return out


def merged(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The blocks of each conversation, then its rows in order, in one sorted stream; conversations without rows have one mark."""
    texts = keyed(rows)
    parts = stored(blocks(texts), "blocks")
    many = parts.groupBy("k").agg(F.count("*").alias("blocks")).where(F.col("blocks") > LONG).select("k")
    if many.isEmpty():
        parts = parts.withColumns({"cost": F.lit(None).cast("long"), "audit": F.lit(None).cast("string")})
    else:
        parts = parts.join(long_audits(parts.join(many, "k", "left_semi")), ["k", "at"], "left")
    block = F.struct(*[c for c in parts.columns if c != "k"])
    none = lambda kind: F.lit(None).cast(kind)
    marks = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k")).distinct()
    stream = marks.select("k", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("h"), none("string").alias("text"), none(parts.select(block.alias("b")).schema["b"].dataType).alias("b"))
    stream = stream.unionByName(parts.select("k", F.lit(1).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("h"), none("string").alias("text"), block.alias("b")))
    stream = stream.unionByName(texts.select("k", F.lit(2).alias("kind"), "turn", "role", "h", "text", none(stream.schema["b"].dataType).alias("b")))
    return stream.repartition("k").sortWithinPartitions("k", "kind", "b.at", F.asc_nulls_first("turn"), "role", "h").select("k", "kind", "role", "text", "b")


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict, Iterator[tuple[str, str]]]]:
    """(k, figures with cost and audit, rows as they come) of each conversation of a merged() stream."""

    def lines() -> Iterator[tuple]:
        for batch in slices(batches, 1024):
            yield from zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)

    ahead = lines()
    head = next(ahead, None)
    while head is not None:
        k, parts = head[0], []
        head = next(ahead, None)
        while head is not None and head[0] == k and head[1] == 1:
            parts.append(head[4])
            head = next(ahead, None)

        def rows(k=k) -> Iterator[tuple[str, str]]:
            nonlocal head
            while head is not None and head[0] == k:
                row = head[2], head[3]
                head = next(ahead, None)
                yield row

        rest = rows()
        yield k, summed(parts), rest
        for _ in rest:  # what the caller left
            pass


def summed(parts: list[dict]) -> dict:
    """The figures of a conversation from its blocks, in order."""
    out = {c: sum(b[c] for b in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    turns, last, lo, hi = 0, None, None, None
    for a, b in zip([None, *parts], parts):
        if a is not None:
            out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
        if b["lo"] is not None:
            turns += b["turns"] - (b["lo"] == last)
            lo, hi, last = b["lo"] if lo is None else lo, b["hi"], b["hi"]
    out["gaps"] = 0 if lo is None else hi - lo + 1 - turns
    if parts and parts[0]["audit"] is not None:
        out |= {"cost": parts[0]["cost"], "audit": "".join(b["audit"] for b in parts)}
    else:
        cost, audit, _ = lightest(b"".join(b["classes"] for b in parts))[START]
        out |= {"cost": cost, "audit": audit}
    return out


FIGURES = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repairs(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """FIGURES for each conversation of conversations (conv_id); rows (conv_id, turn, role, text) are what is left of them.

    Rows go by turn, nulls first, rows of one turn by role and then by the SHA-256 of their text. Null roles and texts
    are one space; an empty role has no initial and is never kept. A null conv_id is a conversation of its own, one
    without rows has zeros, an empty audit and the digest of the empty string. The digest reads a conversation's rows
    one after the other, in one task, as SHA-256 demands; they are streamed, never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for k, found, turns in conversations_of(batches):
            digest, first = hashlib.sha256(), True
            for _, role, text in edited(found["audit"], turns):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            out.append({**found, "conv_id": int(k) if k else None, "repaired_sha256": digest.hexdigest()})
            if len(out) == 1000:
                yield figures(out)
                out = []
        yield figures(out)

    def figures(rows: list[dict]) -> pa.RecordBatch:
        fields = [f.split() for f in FIGURES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64() if t == "long" else pa.string()) for n, t in fields], names=[n for n, _ in fields])

    return merged(conversations, rows).mapInArrow(run, FIGURES)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (0, 1, 2, ...), role, text, edit (K, R or I)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, found, turns in conversations_of(batches):
            rows, at = [], 0
            for edit, role, text in edited(found["audit"], turns):
                rows.append((int(k) if k else None, at, role, text, edit))
                at += 1
                if len(rows) == 500:
                    yield turns_batch(rows)
                    rows = []
            if rows:
                yield turns_batch(rows)

    def turns_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "turn", "role", "text", "edit"])

    return merged(conversations, conversations).mapInArrow(run, "conv_id long, turn long, role string, text string, edit string")


def op11_agenda_repair(spark, sf_dir: str) -> DataFrame:
    """Damages all conversations and repairs them; see repairs() for nulls, ties, repeated rows and conversations left empty."""
    from .common import table

    conversations = table(spark, sf_dir, "conversations")
    return repairs(conversations, damaged(conversations))
