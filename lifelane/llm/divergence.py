"""Source divergence audit: how far the term frequencies of sources lie apart, from bit sets of terms by count."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, stored

MIN_DOCUMENTS = 30
TOP = 50
#: What is no letter of ASCII and no byte of another code point ends a term; only A-Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(documents: DataFrame, most: int = 200_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) of documents (text, lang, source), as partial sums of tasks."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                found = Counter(text.as_py().translate(FOLD).split())
                size -= len(n)
                n.update(found)
                docs.update(found.keys())
                size += len(n)
                if size > most:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    rows = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def share(count, total, terms):
    """1 + floor(1,000,000,000 * (count + 5) / (total + 5 * terms)), exactly."""
    whole = F.lit(1_000_000_000).cast("decimal(38,0)") * (F.col(count) + 5 if isinstance(count, str) else count + 5)
    return F.when(F.col(terms) > 0, F.lit(1).cast("long") + F.call_function("div", whole, (F.col(total) + 5 * F.col(terms)).cast("decimal(38,0)")))


class Audit:
    """The written tables of an audit: kept (lang, source, term, n, lang_n), groups (lang, source, total, terms, p0), langs."""

    def __init__(self, documents: DataFrame, min_documents: int = MIN_DOCUMENTS):
        # Dealt by (lang, term), the counts of a group and the documents of a language both need no further shuffle.
        one = term_counts(documents).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        term = Window.partitionBy("lang", "term")
        both = one.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
        self.kept = stored(both.where(F.col("lang_docs") >= min_documents).select("lang", "source", "term", "n", "lang_n"), "terms")
        known = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sizes = self.kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
        groups = known.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")])
        at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = stored(groups.withColumn("p0", share(F.lit(0), "total", "terms")).withColumn("at", at), "groups")

    def drop(self) -> None:
        drop(self.kept, self.groups)


def chunks(audit: Audit, most: int = 8192) -> DataFrame:
    """lang, term, band, bucket, id: terms of about one frequency share a chunk, where a source has few distinct counts.

    A chunk's ids are 0, 1, 2, ...; rare terms come in chunks of about 8192, the more frequent in smaller ones, as their
    counts differ more.
    """
    terms = audit.kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).withColumn("band", F.floor(F.log2("n")).cast("int"))
    size = F.greatest(F.lit(64), F.call_function("shiftright", F.lit(most), F.greatest(F.lit(0), F.least(F.lit(20), F.col("band") - 5))))
    buckets = terms.groupBy("lang", "band").agg(F.ceil(F.count("*") / F.max(size)).alias("buckets"))
    # A row for each language and power of two: broadcast where that is few, so that terms aren't dealt by it.
    buckets = stored(buckets, "buckets")
    small = F.broadcast(buckets) if buckets.count() <= 100_000 else buckets
    dealt = terms.join(small, ["lang", "band"]).withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    dealt = dealt.repartition("lang", "band", "bucket")
    place = F.row_number().over(Window.partitionBy("lang", "band", "bucket").orderBy("term")) - 1
    return dealt.select("lang", "term", "band", "bucket", place.alias("id"))


def levels(audit: Audit, ids: DataFrame) -> DataFrame:
    """lang, band, bucket, source, n, p, words, bits: the bit set, in words of 64, of the terms that a source has n times."""
    rows = audit.kept.join(ids, ["lang", "term"]).join(audit.groups.select("lang", "source", "total", "terms"), ["lang", "source"])
    keys = ["lang", "band", "bucket", "source", "n"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))
    words = rows.groupBy(*keys, F.floor(F.col("id") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"), F.max(share("n", "total", "terms")).alias("p"))
    sets = words.groupBy(*keys).agg(F.max("p").alias("p"), F.collect_list(F.struct("word", "bits")).alias("set"))
    return sets.select(*keys, "p", F.col("set.word").alias("words"), F.col("set.bits").alias("bits"))


def joint(a: tuple, b: tuple, terms: int, room: int = 1 << 21) -> int:
    """The sum over terms of |p - q| for two sources of a chunk.

    Each is (p of a term it lacks, p of each count, bit sets by count, their sizes). ANDs and popcounts give the joint
    cells; terms that one or both lack are what the cells leave of the sets' sizes and of all terms.
    """
    (p0, p, x, nx), (q0, q, y, ny) = a, b
    total, in_x, in_y, both = 0, nx.copy(), ny.copy(), 0
    if len(p) and len(q):
        step = max(1, room // (len(q) * x.shape[1]))
        for lo in range(0, len(p), step):
            cells = np.bitwise_count(x[lo : lo + step, None, :] & y[None, :, :]).sum(2, dtype=np.int64)
            total += int((cells * np.abs(p[lo : lo + step, None] - q[None, :])).sum())
            in_x[lo : lo + step] -= cells.sum(1)
            in_y -= cells.sum(0)
            both += int(cells.sum())
    total += int((in_x * np.abs(p - q0)).sum()) + int((in_y * np.abs(q - p0)).sum())
    return total + (terms - int(nx.sum()) - int(ny.sum()) + both) * abs(p0 - q0)


def pair_sums(audit: Audit, tile: int = 64) -> DataFrame:
    """lang, source, item, value: the sum of |p - q| over all kept terms, for both orders of each pair of sources of a language.

    A task has one chunk of terms and two tiles of sources, so its memory is bounded however many sources there are.
    Every chunk names all sources of its language, also those without its terms; a language without terms has one
    empty chunk, so that its pairs are there with 0.
    """
    ids = stored(chunks(audit), "chunks")
    sets = stored(levels(audit, ids), "levels")
    sizes = ids.groupBy("lang", "band", "bucket").agg(F.count("*").alias("size"))
    empty = audit.groups.select("lang", F.lit(-1).alias("band"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("size")).distinct()
    names = audit.groups.select("lang", "source", F.floor(F.col("at") / tile).alias("tile"), F.coalesce("p0", F.lit(0)).alias("p0"))
    heads = sizes.unionByName(empty).join(names, "lang").select("lang", "band", "bucket", "source", "tile", F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"), "size", F.lit(None).cast("array<int>").alias("words"), F.lit(None).cast("array<long>").alias("bits"))
    body = sets.join(names.drop("p0"), ["lang", "source"]).select("lang", "band", "bucket", "source", "tile", "n", "p", F.lit(None).cast("long").alias("size"), "words", "bits")
    tiles = audit.groups.groupBy("lang").agg(F.floor(F.max("at") / tile).alias("last"))
    dealt = heads.unionByName(body).join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    dealt = dealt.withColumn("left", F.least("tile", "other")).withColumn("right", F.greatest("tile", "other")).drop("other", "last")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["n"] == 0]
        terms = int(head["size"].iloc[0])
        wide, known, out = -(-terms // 64) or 1, {}, []
        of = dict(tuple(pdf[pdf["n"] > 0].groupby("source", sort=False)))
        for source, p0 in zip(head["source"], head["p"], strict=True):
            mine = of.get(source)
            x = np.zeros((0 if mine is None else len(mine), wide), np.uint64)
            for i, (words, bits) in enumerate(() if mine is None else zip(mine["words"], mine["bits"], strict=True)):
                x[i, np.asarray(words)] = np.asarray(bits, np.int64).view(np.uint64)
            p = np.zeros(0, np.int64) if mine is None else mine["p"].to_numpy(np.int64)
            known[source] = (int(p0), p, x, np.bitwise_count(x).sum(1, dtype=np.int64))
        tile_of, (left, right) = dict(zip(head["source"], head["tile"], strict=True)), (pdf["left"].iloc[0], pdf["right"].iloc[0])
        names = sorted(known)
        for a in names:
            for b in names:
                if a < b if left == right else (tile_of[a], tile_of[b]) == (left, right):
                    out.append((a, b, joint(known[a], known[b], terms)))
        frame = pd.DataFrame(out, columns=["a", "b", "value"]).astype({"value": "int64"})
        frame.insert(0, "lang", pdf["lang"].iloc[0])
        return frame

    found = dealt.groupBy("lang", "band", "bucket", "left", "right").applyInPandas(sums, "lang string, a string, b string, value long")
    found = stored(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    drop(ids, sets)
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    return both.unionByName(found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def overused(audit: Audit) -> DataFrame:
    """lang, source, item, value: the terms whose p in a source passes the language's, and by how much."""
    rows = audit.kept.join(audit.groups, ["lang", "source"])
    p, q = share("n", "total", "terms"), share("lang_n", "lang_total", "terms")
    return rows.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return (out if most is None else out.where(F.col("rank") <= most)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audited(documents: DataFrame, *, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """For each (lang, source): every other source by the distance of its term shares, and the terms that it overuses most.

    Null text, lang and source count as empty; repeated rows count each; equal values go by the item's bytes; a group
    without terms has pairs only, an empty table no rows. Other columns are ignored.
    """
    audit = Audit(documents, min_documents)
    return ranked(pair_sums(audit), "pair").unionByName(ranked(overused(audit), "term", top))


def op12_count_bitmaps(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents; see audited() for nulls, ties, repeated rows and empty tables."""
    from .common import table

    return audited(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL),
k AS (SELECT lang, count(*) AS terms, sum(ln) AS lt FROM v GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * terms) AS p,
        1 + (1000000000::HUGEINT * (ln + 5)) // (lt + 5 * terms) AS q
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
