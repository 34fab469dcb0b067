"""Exact dedup: partitions exchange Golomb-coded fingerprints with their owners, and only suspects' texts are shuffled."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import drop, stored

PER_OWNER = 1 << 22  # fingerprints that one owner holds at most, about
SPARE_BITS = 16  # a fingerprint has so many bits more than their number needs: one in 65,536 is a suspect by chance


def golomb(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct numbers of [0, span) as Golomb codes of their gaps, the divisor a power of two near ln 2 of the mean gap.

    The quotients (unary) and the remainders (fixed width) are two streams, so both are read without a loop over codes.
    """
    n = len(values)
    if not n:
        return struct.pack("<QBQ", 0, 0, 0)
    k = max(0, int(math.log2(max(1.0, math.log(2) * span / n))))
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    gaps[1:] -= np.uint64(1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = np.empty((n, k), np.uint8)
    for j in range(k):
        rest[:, j] = gaps >> np.uint64(k - 1 - j) & np.uint64(1)
    head = np.packbits(unary).tobytes()
    return struct.pack("<QBQ", n, k, len(head)) + head + np.packbits(rest).tobytes()


def golomb_read(code: bytes) -> np.ndarray:
    """The numbers that golomb() coded."""
    n, k, size = struct.unpack_from("<QBQ", code)
    at = struct.calcsize("<QBQ")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, at)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=at + size), count=n * k).reshape(n, k)
    for j in range(k):
        gaps = gaps << np.uint64(1) | rest[:, j]
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps)


def suspected(rows: RDD, total: int, owners: int) -> RDD:
    """For each row of rows, in order and partition by partition, whether its fingerprint fp may be another row's too.

    Owners hold ranges of the fingerprints. A partition sends each owner its own distinct fingerprints of that range,
    sorted and coded; the owner marks those that several partitions sent and answers with a bit for each. A note of the
    partition (which fingerprint each row has, and which it has twice itself) travels along, so that no row is hashed
    again. Empty messages are not sent: there are never more messages than rows, and a text that a third of all rows
    share is one fingerprint a partition.
    """
    width = min(63, max(1, max(1, total).bit_length() + SPARE_BITS))
    span = 1 << width
    bounds = [-(-span * j // owners) for j in range(owners + 1)]

    def send(i: int, part: Iterable[Row]) -> Iterator:
        fps = np.fromiter((r.fp for r in part), np.int64).view(np.uint64) >> np.uint64(64 - width)
        if not len(fps):
            return
        distinct, which, times = np.unique(fps, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(distinct, np.array(bounds, np.uint64))
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            mine = distinct[cuts[j] : cuts[j + 1]] - np.uint64(bounds[j])
            yield j, (i, golomb(mine, bounds[j + 1] - bounds[j]), None)
        yield i % owners, (i, which.astype(np.uint32).tobytes(), np.packbits(times > 1).tobytes())

    def answer(messages: Iterable) -> Iterator:
        asked = []
        for j, (i, code, twice) in messages:
            if twice is None:
                asked.append((i, j, golomb_read(code)))
            else:
                yield i, (-1, code, twice)  # a note, on its way home
        for owner in sorted({j for _, j, _ in asked}):
            values, times = np.unique(np.concatenate([v for _, j, v in asked if j == owner]), return_counts=True)
            several = values[times > 1]
            for i, j, v in asked:
                if j == owner:
                    yield i, (j, struct.pack("<Q", len(v)), np.packbits(np.isin(v, several, assume_unique=True)).tobytes())

    def flags(answers: Iterable) -> Iterator[bool]:
        got = sorted((a for _, a in answers), key=lambda a: a[0])
        if not got:
            return
        (_, which, twice), rest = got[0], got[1:]
        found = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=struct.unpack("<Q", n)[0]) for _, n, bits in rest])
        found |= np.unpackbits(np.frombuffer(twice, np.uint8), count=len(found))
        which = np.frombuffer(which, np.uint32)
        for lo in range(0, len(which), 10_000):
            yield from map(bool, found[which[lo : lo + 10_000]].tolist())

    sent = rows.mapPartitionsWithIndex(send).partitionBy(owners, int)
    return sent.mapPartitions(answer).partitionBy(rows.getNumPartitions(), int).mapPartitions(flags)


def zipped(rows: RDD, flags: RDD) -> RDD:
    """rows with their flags. A session may hold partition counts up; then the flags' further partitions are empty, as the padding is."""
    more = flags.getNumPartitions() - rows.getNumPartitions()
    return (rows.union(rows.context.parallelize([], more)) if more else rows).zip(flags)


MARK = "row long, doc_id long, text_sha256 string, text string"


def marked(documents: DataFrame, rows: RDD | None = None) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 for each row of documents (doc_id, text).

    Of rows with equal texts that with the largest doc_id stays; a null id is smaller than any. Of several such rows one
    stays. A null text is the empty one. Other columns are ignored. row numbers the rows by partition and place.
    """
    spark = documents.sparkSession
    rows = hashed(documents) if rows is None else rows
    total = documents.count()
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_OWNER))

    def tell(i: int, part: Iterable) -> Iterator[tuple]:
        for at, (r, suspect) in enumerate(part):
            yield i << 40 | at, r.doc_id, r.text_sha256, r.text if suspect else None

    told = stored(spark.createDataFrame(zipped(rows, suspected(rows, total, owners)).mapPartitionsWithIndex(tell), MARK, verifySchema=False), "suspects")
    # Suspects are compared by their bytes: the text itself is the key, and a common one is merged before the shuffle.
    suspects = told.where(F.col("text").isNotNull())
    groups = suspects.groupBy("text", "text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    groups = stored(groups.where("group_size > 1").select("text_sha256", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"), "groups")
    # At most a thousand groups can hold a thousandth of all rows each: these are broadcast, the others shuffled.
    common = F.broadcast(groups.where(F.col("group_size") * 1000 >= total))
    rare = groups.where(F.col("group_size") * 1000 < total)
    narrow = suspects.drop("text")
    parts = [
        told.where(F.col("text").isNull()).drop("text").select("*", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size")),
        narrow.join(common, "text_sha256"),
        narrow.join(common, "text_sha256", "left_anti").join(rare, "text_sha256", "left"),
    ]
    columns = ["row", "doc_id", "text_sha256", "keep_id", "keep_row", "group_size"]
    out = parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))
    alone = F.col("group_size").isNull()  # a suspect by chance
    return out.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def hashed(documents: DataFrame, *columns: str) -> RDD:
    """doc_id, text, its fingerprint and SHA-256, and columns. One RDD, whose partitions stay as they are, is read for both passes."""
    text = F.coalesce("text", F.lit(""))
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(columns)]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("text_sha256"), *own).rdd


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without the copies: of equal texts the row with the largest doc_id, whole; texts of dropped rows are not shuffled again."""
    rows = hashed(documents, *documents.columns)
    marks = stored(marked(documents, rows).select("row", "kept"), "marks")

    def flags(found: Iterable) -> Iterator[bool]:
        yield from (kept for _, kept in sorted(at for _, at in found))

    kept = marks.rdd.map(lambda r: (r.row >> 40, (r.row, r.kept))).partitionBy(rows.getNumPartitions(), int).mapPartitions(flags)
    n = len(documents.columns)
    stay = zipped(rows, kept).filter(lambda pair: pair[1]).map(lambda pair: tuple(pair[0][f"own_{i}"] for i in range(n)))
    out = stored(documents.sparkSession.createDataFrame(stay, documents.schema, verifySchema=False), "kept")
    drop(marks)
    return out


def op13_golomb_exchange(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays of its equal texts.

    Null and empty texts are equal; repeated rows get a row each, one of them kept; an empty table gives no rows.
    """
    from .common import table

    return marked(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


OP13_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place FROM d)
SELECT doc_id, keep_id, group_size, (place = 1) AS kept, text_sha256 FROM n
"""
