"""Document fingerprints: SpotSigs, chains of content words that follow common-word anchors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ANCHORS = 100  # words that most documents hold, the anchors
CHAIN = 3


def _let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def _words(text: Column) -> Column:
    """The lower-cased words (letters and digits) of a text in turn; null text: none."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def common_words(documents: DataFrame, n: int = ANCHORS) -> list[str]:
    """The n words that the most documents hold, counted over all of them; ties go by the word. The driver gets n words."""
    held = documents.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("w"))
    return [r.w for r in held.groupBy("w").count().orderBy(F.desc("count"), "w").limit(n).collect()]


def signatures(text: Column, anchors: list[str]) -> Column:
    """The sorted distinct signatures of a text, 16 hex digits each; null text: none.

    The text's words are read in turn. Each content word (any but the anchors) after an anchor, and one that begins the
    text, begins a chain of it and the next content words, over further anchors; the chain with its anchor is a signature.
    """

    def chains(w):
        pairs = F.zip_with(w, F.concat(F.array(F.lit("")), w), lambda word, before: F.struct(word.alias("w"), before.alias("b")))
        content = F.filter(pairs, lambda p: p["w"].isNotNull() & ~p["w"].isin(anchors))
        return _let(content, of_content)

    def of_content(c):
        rest = [F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1))) for k in range(1, CHAIN)]
        out = F.zip_with(c, rest[0], lambda p, q: F.when(p["b"].isin(["", *anchors]), F.concat_ws(" ", p["b"], p["w"], q["w"])))
        for r in rest[1:]:
            out = F.zip_with(out, r, lambda s, q: F.when(s.isNotNull(), F.concat_ws(" ", s, q["w"])))
        hashed = F.transform(F.filter(out, lambda s: s.isNotNull()), lambda s: F.substring(F.md5(s), 1, 16))
        return F.array_sort(F.array_distinct(hashed))

    return _let(_words(text), chains)


def length_part(n: Column, least: float) -> Column:
    """The partition of set lengths that n is in: i holds lengths from least**-i up to least**-(i+1)."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(1 / least) + 1e-9).cast("int")


def jaccard(a: Column, b: Column, least: float | None = None) -> Column:
    """Likeness of two signature sets; two empty ones are alike (1), one empty and one not are unlike (0).

    Exact unless a threshold is asked for. With least, only sets of one partition of lengths, or of two that touch, are
    compared, and only if the smaller length over the larger, which bounds the likeness, is at least least; others count as 0.
    """
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    full = F.when(n + m == 0, F.lit(1.0)).when(F.least(n, m) == 0, F.lit(0.0)).otherwise(_let(common, lambda c: c.cast("double") / (n + m - c)))
    if least is None:
        return full
    apart = (F.abs(length_part(n, least) - length_part(m, least)) > 1) | (F.least(n, m) < least * F.greatest(n, m))
    return F.when(apart, F.lit(0.0)).otherwise(full)


def near_pairs(documents: DataFrame, least: float = 0.8, anchors: list[str] | None = None) -> DataFrame:
    """a, b, likeness of representatives of equal signature sets whose likeness is at least `least`; see classes().

    Sets are partitioned by length: partition i holds sizes from least**-i up to least**-(i+1), so a pair lies in one
    partition or in two that touch. In each, the rarest signatures of a set, as many as least lets two sets differ in
    and one more, go to inverted lists; lists meet within a partition and with the next one. Null ids, and texts without
    signatures, have no pairs.
    """
    sets = classes(documents.where("doc_id IS NOT NULL"), anchors).where("n_signatures > 0 AND doc_id = class_id").dropDuplicates(["class_id"])
    sets = stored(sets.select("class_id", F.col("signatures").alias("s"), length_part(F.size("signatures"), least).alias("part")), "signatures")
    rows = sets.select("class_id", "part", F.size("s").alias("n"), F.explode("s").alias("v"))
    often = rows.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(often, "v", "left").withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy(F.coalesce("df", F.lit(1)), "v")))
    head = ranked.where((F.col("r") <= F.col("n") - F.ceil(least * F.col("n")) + 1) & F.col("df").isNotNull()).select("v", "class_id", "part", "n")
    head = stored(head, "heads")
    left = head.select("v", F.col("class_id").alias("a"), "part", F.col("n").alias("na"))
    right = head.select("v", F.col("class_id").alias("b"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("own"), F.col("n").alias("nb"))
    apart = (F.col("a") < F.col("b")) | (F.col("own") != F.col("part"))
    sized = F.least("na", "nb") >= least * F.greatest("na", "nb")
    pairs = left.join(right, ["v", "part"]).where((F.col("a") != F.col("b")) & apart & sized).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = sets.select("class_id", "s")
    both = pairs.join(of.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), "a").join(of.select(F.col("class_id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", jaccard(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)


def classes(documents: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """doc_id, n_signatures, signatures, class_id: the smallest id of the documents with the same signatures.

    One row per row of documents. A class of null ids only has a null class_id. The anchors are the words that most
    documents hold, unless given.
    """
    anchors = common_words(documents) if anchors is None else anchors
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text"), anchors).alias("signatures"))
    rows = rows.withColumn("n_signatures", F.size("signatures")).withColumn("key", F.md5(F.array_join("signatures", "")))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, "key").select("doc_id", "n_signatures", "signatures", "class_id")


def with_next(documents: DataFrame, cuts: int = 256) -> tuple[DataFrame, Window]:
    """doc_id, text, next_text (of the next row by descending doc_id; after the last, the first), and the window that gave it.

    Ids are dealt over about sqrt(rows) ranges: quantiles of the ids, each cut into equal parts, so that ids in clumps or
    far off don't fill a range. Null ids come last, dealt by a hash of their texts; equal ids go by that hash too. Each
    range also gets a copy of the row that follows its last one, the head of the next lower range; so one shuffle of the
    texts serves, and no task sees more than a range. Rows with copy = 1 are such guests, to be dropped by the caller.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    span = ids.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 10_000).alias("q")).collect()[0]
    many = max(1.0, math.sqrt(span.n))
    lo, hi = span.lo or 0, span.hi or 0
    bounds = sorted({float(lo), *map(float, span.q or [])})
    bounds.append(math.nextafter(max(float(hi), bounds[-1]) + 1, math.inf))
    own = math.ceil(many / (len(bounds) - 1))
    marks = F.array(*map(F.lit, bounds))
    part = _let(F.col("doc_id").cast("double"), lambda x: _let(F.greatest(F.size(F.filter(F.array(*map(F.lit, bounds[:-1])), lambda b: b <= x)), F.lit(1)), lambda i: (i - 1) * own + F.least(F.floor((x - F.element_at(marks, i)) / (F.element_at(marks, i + 1) - F.element_at(marks, i)) * own), F.lit(own - 1))))
    # The ranges of null ids lie below all others.
    nulls = F.least(F.floor((F.col("h").cast("double") / float(1 << 64) + 0.5) * many), F.lit(math.ceil(many) - 1)) - math.ceil(many)
    docs = docs.withColumn("part", F.coalesce(F.when(F.col("doc_id").isNotNull(), part), nulls).cast("long"))
    heads = docs.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("head"))
    down = Window.orderBy(F.desc("part"))  # about sqrt(rows) ranges
    ends = heads.agg(F.min("part").alias("lowest"))
    heads = heads.withColumn("to", F.lag("part").over(down)).crossJoin(F.broadcast(ends)).select(F.col("part").alias("of"), "head", F.coalesce("to", "lowest").alias("to"))
    first = (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h"))
    docs = docs.join(F.broadcast(heads), first, "left")
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("copy")), F.struct(F.col("to").alias("part"), F.lit(1).alias("copy")))
    docs = docs.select("doc_id", "text", "h", F.explode(places).alias("at")).select("doc_id", "text", "h", "at.part", "at.copy").where("part IS NOT NULL")
    order = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("h"))
    return docs.withColumn("next_text", F.lead("text").over(order)), order


def op2_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of each whole text and its edited text, and their likenesses. A fingerprint is its signatures in a row.

    One row per row of documents, for null and repeated ids too (see with_next() for their order); null texts count as
    empty, extra columns are ignored. The anchors are the words that most documents hold. Likenesses are exact, however far
    the lengths of two fingerprints lie apart.
    """
    from .common import table

    documents = table(spark, sf_dir, "documents")
    anchors = common_words(documents)
    docs, order = with_next(documents)
    n = F.char_length("text").cast("long")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    docs = docs.withColumn("n_chars", n)
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))).drop("next_text")
    docs = docs.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("own", signatures(F.col("text"), anchors)).withColumn("changed", signatures(F.col("edited"), anchors)).drop("edited")
    docs = docs.withColumn("after", F.lead("own").over(order)).where("copy = 0")
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("changed", "").alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("changed")).alias("near_edited"),
        jaccard(F.col("own"), F.col("after")).alias("near_next"),
        F.size("own").cast("long").alias("n_signatures"),
    )


OP2_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nx AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first(text) OVER (ORDER BY doc_id DESC)) AS nt FROM base),
ed AS (SELECT doc_id, 0 AS k, text AS t, text, nt FROM nx UNION ALL SELECT doc_id, 1, substr(text, 1, length(text) - length(text) // 3) || substr(nt, 1, length(text) // 3), text, nt FROM nx),
w AS (SELECT doc_id, k, t, list_filter(string_split(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM ed),
held AS (SELECT x FROM (SELECT unnest(list_distinct(w)) AS x FROM w WHERE k = 0) GROUP BY x ORDER BY count(*) DESC, x LIMIT {ANCHORS}),
anchors AS (SELECT list(x) AS a FROM held),
p AS (SELECT doc_id, k, t, a, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'w': w[i], 'b': CASE WHEN i = 1 THEN '' ELSE w[i - 1] END}}), lambda x: NOT list_contains(a, x.w)) AS c FROM w, anchors),
s AS (SELECT doc_id, k, t, list_sort(list_distinct(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].b = '' OR list_contains(a, c[i].b)),
        lambda i: substr(md5(concat_ws(' ', c[i].b, c[i].w, c[i + 1].w, c[i + 2].w)), 1, 16)))) AS s FROM p),
o AS (SELECT a.doc_id, length(a.t) AS n, sha256(b.t) AS h, a.s AS own, b.s AS changed FROM s a JOIN s b USING (doc_id) WHERE a.k = 0 AND b.k = 1),
z AS (SELECT *, coalesce(lead(own) OVER (ORDER BY doc_id DESC), first(own) OVER (ORDER BY doc_id DESC)) AS nxt FROM o),
j AS (SELECT *, len(list_intersect(own, changed)) AS ce, len(list_intersect(own, nxt)) AS cn FROM z)
SELECT doc_id, n::BIGINT AS n_chars, h AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(changed, '') AS edited_fingerprint,
  CASE WHEN len(own) + len(changed) = 0 THEN 1.0::DOUBLE ELSE ce::DOUBLE / (len(own) + len(changed) - ce) END AS near_edited,
  CASE WHEN len(own) + len(nxt) = 0 THEN 1.0::DOUBLE ELSE cn::DOUBLE / (len(own) + len(nxt) - cn) END AS near_next,
  len(own)::BIGINT AS n_signatures FROM j
"""
