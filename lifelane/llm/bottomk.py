"""MinHash near-dedup: bottom-k sketches of one hash function, overlaps from inverted lists, exact Jaccard at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, let_go, slices, stored

K = 48  # retained values of a sketch
HOT = 32  # members that an inverted list may have for all its open pairs to be made; longer ones are settled around centers
MARGIN = 0.30  # how far below the threshold an estimate may lie: over five standard errors of K values
LONG = 128  # members that a list of differences may have for its open pairs to be made; longer ones are groups of their own
BLOCK = 256  # members of a group that share a copy of what they are compared with
MARKS = 1 << 24  # bits that tell texts that nobody wants from others before these are shuffled: 2 MB, however many ids


class _Words(dict):
    """Word -> its hash; a task has its own, emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+. Fewer words than width make one shingle; no words make none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.array([known[w] for w in words], dtype=np.uint64)
    n = max(1, len(ids) - width + 1)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(ids))):
            h = (h ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h + np.uint64(min(width, len(ids)))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def sketches(documents: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits, as text) and sketch (the k smallest hashes) of every row.

    A sketch's values are moved by 2**63, so that their order as signed numbers is that of the hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        let_go()
        for batch in slices(batches):
            sets = [shingles(t, width, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_hash": pa.array([xxhash.xxh128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                    "sketch": pa.array([(s[:k] ^ np.uint64(1 << 63)).view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash string, sketch array<long>")


def _sets(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, elements (the whole set) of the wanted documents, read again from their texts; each text of a repeated id.

    A bit set of the wanted ids' hashes, of fixed size and so broadcast, keeps most other texts out of the shuffle that
    finds the wanted ones; where very many are wanted it lets more pass, and the join decides all the same. Wanted ids
    are distinct: an inner join keeps its place behind the bit set, while a semi join would be moved before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        let_go()
        for batch in slices(batches):
            sets = [shingles(t, width, known).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "elements": pa.array(sets, pa.list_(pa.int64()))})

    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    words = wanted.select(F.shiftright(mark, 6).alias("_word"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(id), 64) AS INT))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("_word", F.shiftright(mark, 6))
    rows = rows.join(F.broadcast(words), "_word").where(F.getbit("_bits", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")) == 1).select("id", "text").join(wanted, "id")
    return stored(rows.mapInArrow(run, "id long, elements array<long>"), "sets")


def _beside(sets: DataFrame, members: DataFrame, group: str, shown: DataFrame) -> DataFrame:
    """members (group, id, any more columns) with their elements and the array `shown` of their group.

    A group's array is copied once for each BLOCK of its members; their sets are shuffled to it, in blocks too.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    left = sizes.join(shown, group).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    right = members.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).drop("_blocks")
    return right.join(sets, "id").join(left, [group, "_block"]).drop("_block")


def _confirm(documents: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), a stored table, whose whole sets link: den * intersection >= num * union.

    a may occur in very many pairs. The table of pairs is dropped.
    """
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets(documents, wanted, width)
    both = _beside(sets, pairs.select("a", F.col("b").alias("id")), "a", sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a")))
    common = F.size(F.array_intersect("elements", "of_a"))
    total = F.size("elements") + F.size("of_a")
    linked = both.withColumn("common", common).where((F.col("common") > 0) & ((den + num) * F.col("common") >= num * total))
    linked = stored(linked.select("a", F.col("id").alias("b")), "links")
    drop(sets, pairs)
    return linked


def _estimate(pairs: DataFrame, reps: DataFrame, least: float, k: int) -> DataFrame:
    """Pairs whose union sketch, the k smallest of both, holds at least the share `least` of common values."""
    left = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.col("union"), F.array_intersect("sa", "sb")))
    return stored(pairs.join(left, "a").join(right, "b").withColumn("union", union).where(shared >= least * F.size("union")).select("a", "b"), "pairs")


def _stars(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b) reaches, by large-star and small-star rounds.

    known: components of some of the edges, which then need not be found again.
    """
    start = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    if known is not None:
        start = start.unionByName(known.select(F.col("id").alias("x"), F.col("component").alias("y")))
    pairs, seen = stored(start.distinct(), "star"), None
    while True:
        both = pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.where(F.col("y") > F.col("x")).join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y")).distinct()
        new = stored(small, "star")
        drop(pairs)
        pairs = new
        # The rounds end when the pairs stay the same: as many, with the same sum of hashes.
        now = new.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).collect()[0]
        if now == seen:
            return pairs.select(F.col("x").alias("id"), F.col("y").alias("component"))
        seen = now


def _alike(x: str, y: str, num: int, den: int):
    """Whether two sizes are near enough for their sets to link."""
    return den * F.least(x, y) >= num * F.greatest(x, y)


def _lists(reps: DataFrame, least: float) -> DataFrame:
    """v, id, n_shingles, n, pivot, n_pivot: the inverted lists of retained values, with their length and most central member.

    Of s values two sketches that pass the estimate share least * s, so all but so many of the rarest of each, and one
    more, hold a common one: passages that very many documents share drop out.
    """
    values = reps.select("id", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    per_rep = values.join(often, "v").groupBy("id").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # Values without a partner come first in the order, and take their places of the prefix.
    left = F.greatest(F.col("s") - F.greatest(F.ceil(least * F.col("s")), F.lit(1)) + 1 - (F.col("s") - F.size("vs")), F.lit(0)).cast("int")
    central = F.aggregate("vs", F.lit(0).cast("long"), lambda acc, x: acc + x["df"])
    lists = (
        per_rep.select("id", central.alias("weight"), F.explode(F.slice("vs", F.lit(1), left)).alias("x"))
        .select("id", "weight", F.col("x.v").alias("v"))
        .join(reps.select("id", "n_shingles"), "id")
    )
    lists = stored(lists, "lists")
    sizes = lists.groupBy("v").agg(F.count("*").alias("n"), F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n_shingles")).alias("top")).where("n > 1")
    out = stored(lists.drop("weight").join(sizes.select("v", "n", (-F.col("top.minus")).alias("pivot"), F.col("top.n_shingles").alias("n_pivot")), "v"), "lists")
    drop(lists)
    return out


def links(documents: DataFrame, found: DataFrame, *, width: int, num: int, den: int, k: int = K, hot: int = HOT, most: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(representatives, components) of the distinct sets in found, the rows of sketches(); an id in no component is its own.

    Each list's members meet its most central one first. Only lists whose members are of several components then are
    open: short ones (up to hot) make their pairs of different components, long ones go to _around_centers(), as often as
    that leaves lists of more than most. All candidates pass the estimate and are confirmed on whole sets.
    """
    least = num / den - MARGIN
    reps = stored(found.where("n_shingles > 0").groupBy("n_shingles", "set_hash").agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch")).where("id IS NOT NULL").select("id", "n_shingles", "set_hash", "sketch"), "reps")
    lists = _lists(reps, least)
    star = lists.where((F.col("id") != F.col("pivot")) & _alike("n_shingles", "n_pivot", num, den)).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    edges = _confirm(documents, _estimate(star, reps, least, k), width, num, den)
    parts = _stars(edges)

    def open_(rows: DataFrame, key: list[str]) -> DataFrame:
        """Rows, with their component c, of the keys that have several."""
        rows = rows.join(parts, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        return rows.join(rows.groupBy(*key).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(*key), key)

    closed, lists = lists, stored(open_(lists, ["v"]), "open")
    drop(closed)
    short = lists.where(F.col("n") <= hot)
    x = short.select("v", F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("c").alias("ca"))
    y = short.select("v", F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("c").alias("cb"))
    pairs = x.join(y, "v").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _alike("na", "nb", num, den)).select("a", "b")
    pairs = stored(pairs.distinct(), "candidates")
    groups = stored(lists.where(F.col("n") > hot).select(F.col("pivot").alias("g"), "id", "c").distinct(), "groups")
    drop(lists)
    turn = 0
    while not groups.isEmpty():
        sure, more, rest = _around_centers(documents, groups, width, num, den, most, turn)
        drop(groups)
        pairs, turn = pairs.unionByName(more), turn + 1
        parts = _stars(sure, parts)
        if rest.isEmpty():
            break
        groups = stored(open_(rest, ["g"]).select("g", "id", "c"), "groups")
        drop(rest)
    of = lambda side: parts.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    pairs = pairs.distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    return reps, _stars(_confirm(documents, _estimate(pairs, reps, least, k), width, num, den), parts)


def _around_centers(documents: DataFrame, groups: DataFrame, width: int, num: int, den: int, most: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sure links, candidate pairs, groups still to be settled) of groups (g, id, its component c), without meeting all their pairs.

    Pairs of one component are not made.

    A group's center is what most of a sample of its members hold; any center gives right results. D(x) is what x and
    the center do not share. With q = den + num and r = den - num, x and y link when q * |x ^ y| <= r * (|x| + |y|), and
    x ^ y = D(x) ^ D(y). Let E(x) = q * |D(x)| - r * |x|, and z the member of the least E. Where E(x) + E(z) <= 0, x
    links to z for sure: these are the core, whose E are below all others. Any other pair is met by its member of the
    larger E, y, which is outside the core: x and y link when |D(x) & D(y)| is at least (E(x) + E(y)) / 2q. That can't
    be more than |D(x)|, so E(y) <= E(x) + 2r|x|. For x, E(y) is at least E(x) and the least E outside the core; for y,
    E(x) is at least E(z) and E(y) - 2r|x|, where |x| <= |y| * den / num. As many of the rarest elements of each D as
    these bounds leave out, and one more, hold a common one: their lists give the candidates, each of which must have
    room for the elements that it needs behind the first common one. No element of D is held by most of the group, so
    lists of more than `most` members are smaller groups, to be settled around centers of their own; of lists with the
    same members one is.
    """
    q, r = den + num, den - num
    sets = _sets(documents, groups.select("id").distinct(), width)
    sizes = groups.groupBy("g").agg(F.count("*").alias("members"))
    sample = stored(groups.join(sizes, "g").where(F.pmod(F.xxhash64("g", "id", F.lit(turn)), F.col("members")) < 48).select("g", "id"), "sample")
    held = sample.join(sets, "id").select("g", F.explode("elements").alias("v")).groupBy("g", "v").agg(F.count("*").alias("n"))
    center = held.join(sample.groupBy("g").agg(F.count("*").alias("of")), "g").where("2 * n > of").groupBy("g").agg(F.collect_list("v").alias("center"))
    center = stored(sizes.join(center, "g", "left").select("g", F.coalesce("center", F.array().cast("array<long>")).alias("center")), "centers")

    both = _beside(sets, groups, "g", center)
    # What a member lacks is told from what it has besides by a complement.
    apart = F.concat(F.array_except("elements", "center"), F.transform(F.array_except("center", "elements"), lambda v: F.bitwise_not(v)))
    found = both.select("g", "id", "c", F.size("elements").cast("long").alias("n"), apart.alias("apart")).withColumn("d", F.size("apart").cast("long"))
    found = stored(found.withColumn("e", q * F.col("d") - r * F.col("n")), "apart")
    least = found.groupBy("g").agg(F.min(F.struct("e", "id")).alias("z"))
    rows = found.join(least.select("g", F.col("z.e").alias("ez"), F.col("z.id").alias("z")), "g").withColumn("core", F.col("e") + F.col("ez") <= 0)
    sure = stored(rows.where(F.col("core") & (F.col("id") != F.col("z"))).select(F.col("z").alias("a"), F.col("id").alias("b")), "sure")

    rows = rows.join(rows.where("NOT core").groupBy("g").agg(F.min("e").alias("outer")), "g")  # groups with members outside the core
    # The longest prefixes in which a row meets those of a larger E (low) and, outside the core, those of a smaller E (high).
    prefix = lambda other: F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((F.col("e") + other) / (2 * q)))
    above = F.greatest("e", "outer")
    below = F.greatest(F.col("ez"), F.col("e") - 2 * r * F.floor(F.col("n") * den / num))
    rows = rows.withColumn("low", F.when(above <= F.col("e") + 2 * r * F.col("n"), prefix(above)).otherwise(0))
    rows = rows.withColumn("high", F.when(~F.col("core"), prefix(below)).otherwise(0)).where(F.greatest("low", "high") > 0).drop("ez", "z", "outer")
    elements = stored(rows.select("g", "id", "core", F.explode("apart").alias("v")), "elements")
    often = elements.groupBy("g", "v").agg(F.count("*").alias("df"), F.count_if(~F.col("core")).alias("outside")).where("df > 1 AND outside > 0").drop("outside")
    per = elements.join(often, ["g", "v"]).groupBy("g", "id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # Elements that nobody shares come first in the order and take their places.
    per = rows.drop("apart", "core").join(per, ["g", "id"]).withColumn("alone", F.col("d") - F.size("vs"))
    own = F.greatest(F.greatest("low", "high") - F.col("alone"), F.lit(0)).cast("int")
    lists = per.select("*", F.posexplode(F.slice("vs", F.lit(1), own)).alias("pos", "x")).withColumn("place", F.col("alone") + F.col("pos") + 1)
    lists = stored(lists.select("g", F.col("x.v").alias("v"), "id", "c", "n", "d", "e", (F.col("d") - F.col("place")).alias("behind"), (F.col("place") <= F.col("low")).alias("low"), (F.col("place") <= F.col("high")).alias("high")), "lists")
    counts = lists.groupBy("g", "v").agg(F.count("*").alias("members"), F.count_if("low").alias("lows"), F.count_if("high").alias("highs"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("_sum")).where("members > 1 AND lows > 0 AND highs > 0")
    # Of long lists with the same members one is enough.
    one = F.when(F.col("members") <= most, F.col("v")).otherwise(F.lit(0))
    counts = counts.groupBy("g", "members", "_sum", one.alias("_one")).agg(F.min("v").alias("v")).select("g", "v", "members")
    every, lists = lists, stored(lists.join(counts, ["g", "v"]), "lists")
    drop(every, elements)
    short = lists.where(F.col("members") <= most)
    of = lambda side: [F.col("id").alias(side), *(F.col(k).alias(f"{k}{side}") for k in ("n", "d", "c", "e", "behind"))]
    x, y = short.where("low").select("g", "v", *of("x")), short.where("high").select("g", "v", *of("y"))
    # What two sets don't share is at least the difference of what each does not share with the center.
    reach = q * F.abs(F.col("dx") - F.col("dy")) <= r * (F.col("nx") + F.col("ny"))
    room = 2 * q * (1 + F.least("behindx", "behindy")) >= F.col("ex") + F.col("ey")
    once = (F.col("cx") != F.col("cy")) & ((F.col("ex") < F.col("ey")) | ((F.col("ex") == F.col("ey")) & (F.col("x") < F.col("y"))))
    pairs = stored(x.join(y, ["g", "v"]).where(once & reach & room & _alike("nx", "ny", num, den)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")
    rest = stored(lists.where(F.col("members") > most).select(F.xxhash64("g", "v").alias("g"), "id").distinct(), "groups")
    drop(sets, sample, center, found, lists)
    return sure, pairs, rest


def components(documents: DataFrame, *, width: int = 3, num: int = 85, den: int = 100, k: int = K, hot: int = HOT, most: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents.

    Documents are linked when den * |intersection| >= num * |union| of their sets of width-word shingles. Equal sets
    collapse into their smallest id first; sketches find candidates between the others, whole sets confirm them. Texts
    without words, and null texts, are linked with nothing. Rows with equal ids count as one document, which links by
    any of its texts; a null id keeps its row, with its own null, or the id of an equal set, as component. Extra
    columns are ignored.
    """
    found = stored(sketches(documents, width, k), "sketches")
    reps, parts = links(documents, found, width=width, num=num, den=den, k=k, hot=hot, most=most)
    # Stars join representatives, which are the smallest ids of their sets, so the smallest of them is the component's.
    of_set = reps.join(parts, "id", "left").select("n_shingles", "set_hash", F.coalesce("component", "id").alias("component"))
    rows = found.select("doc_id", "n_shingles", "set_hash").join(of_set, ["n_shingles", "set_hash"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_bottomk_dedup(spark, sf_dir: str) -> DataFrame:
    """components() of documents at three words and 85 %: one row for each of its rows, null texts and repeated ids too."""
    from .common import table

    return components(table(spark, sf_dir, "documents"))


def keep_one(documents: DataFrame, *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents without the near copies: of each component the row with the smallest id stays.

    Of rows that share that id one stays, chosen by a hash of the text. Rows without an id, and texts without words, all stay.
    """
    found = components(documents, width=width, num=num, den=den).where("kept").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    single = documents.join(found, "doc_id", "left_semi").withColumn("_first", first).where("_first = 1").drop("_first")
    return single.unionByName(documents.where("doc_id IS NULL")).select(*documents.columns)


#: All pairs by shared shingles; exact, for small tables.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS v FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT doc_id, n AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept FROM r JOIN n ON n.doc_id = r.id GROUP BY doc_id, n
"""
