"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import os
import re
import random
import struct
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifelane.llm import bottomk, licences, matroska, mixing, ngram_lm, quality, sentencepiece_codec, spotsigs, toxicity, warc

WORDS = "the cat sat on a mat with of and dog ran over hill green blue river stone bird song light idiot".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, block string, ids string, v string, label string, p string"


def text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


ROWS = [
    (1, text(1, 60), "en", "a"),
    (2, text(1, 60), "en", "b"),  # an exact copy
    (3, text(1, 60) + " end", "en", None),  # a near copy
    (4, None, None, "a"),
    (5, "", "en", "b"),
    (6, "  \t\n ", "en", "a"),
    (7, "one", "en", "c"),
    (8, text(8, 4000), "en", "a"),  # long
    (9, "TWO words", None, None),
    (9, "TWO words", None, None),  # a repeated row
    (10, "Ünïcode 日本語 \U0001f600 ▁ <s>", "xx", "é"),
    (None, text(11, 30), "en", "a"),
    (12, "you are an idi0t and a mooron, \"idiot\" he said", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), 0.5, "s", "b", "x", "v", "l", "p") for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, None, 0), (None, 1, 1), (12, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


def held_out(i, mod):
    return zlib.crc32(str(i).encode() if i is not None else b"") % mod == 0


def words(t):
    return (t or "").encode().lower().split()


# 1


def test_pieces_equal_the_library(docs, none):
    import sentencepiece

    path = sentencepiece_codec.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r.ids == (None if r.text is None else library.encode(r.text))
        if r.text is None or "▁" not in r.text:
            assert r.decoded == r.text
    assert sentencepiece_codec.encode(none).count() == 0


def test_stream_takes_chunks_of_any_size():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    rng = random.Random(3)
    for n in (1, 5, 200, 3000):
        t = "".join(rng.choice("abcdetheion é日\n") for _ in range(n))
        whole = "▁" + t.replace(" ", "▁")
        for size in (1, 3, 17, 1000):
            chunks = [whole[i : i + size] for i in range(0, len(whole), size)]
            assert list(codec.stream(chunks)) == codec.encode(t)


# 2


def test_signatures_and_likeness(docs, none, spark):
    anchors = "the on a with of and over".split()
    got = {r.doc_id: r for r in spotsigs.classes(docs.where("doc_id IS NOT NULL"), anchors).collect()}
    assert got[1].signatures == got[2].signatures and got[2].class_id == 1
    assert got[4].signatures == [] and got[6].n_signatures == 0
    pairs = [(r.a, r.b) for r in spotsigs.near_pairs(docs, 0.8, anchors).collect()]
    sets = {i: set(r.signatures) for i, r in got.items() if r.class_id == i and r.signatures}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sorted(pairs) == want and (1, 3) in want
    rows, _ = spotsigs.with_next(docs)
    by = {r.doc_id: r.next_text for r in rows.where("copy = 0").collect()}
    assert by[12] == ROWS[10][1] and by[3] == ROWS[1][1] and by[5] == "" and by[None] == ROWS[12][1]
    assert spotsigs.with_next(none)[0].count() == 0


@pytest.mark.parametrize("ids", [[i * i for i in range(300)], [*range(200), 1 << 62, (1 << 62) + 1], [-(1 << 62), *range(50)], [7]])
def test_next_over_many_ranges(spark, ids):
    rows, _ = spotsigs.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"))
    got = {r.doc_id: r.next_text for r in rows.where("copy = 0").collect()}
    assert got == {i: str(ids[k - 1]) for k, i in enumerate(ids)}


def test_next_among_null_ids(spark):
    rows, _ = spotsigs.with_next(spark.createDataFrame([(None, str(i)) for i in range(100)] + [(1, "one")], "doc_id long, text string"))
    got = {r.text: r.next_text for r in rows.where("copy = 0").collect()}
    at, seen = "one", []
    for _ in range(101):
        seen.append(at)
        at = got[at]
    assert at == "one" and len(set(seen)) == 101


def test_fingerprints_by_hand(spark):
    rows = [(1, "The cat of Rome sat on the red mat"), (2, "the cat of Rome sat on the red mat!"), (3, None), (4, ""), (4, ""), (None, "the of on"), (5, "the of on cat")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, signatures string")
    assert spotsigs.common_words(docs, 3) == ["of", "on", "the"] and spotsigs.common_words(docs.where("false")) == []
    chains = ["the cat rome sat", "of rome sat red", "the red mat"]
    want = sorted(hashlib.md5(c.encode()).hexdigest()[:16] for c in chains)
    got = [r.s for r in docs.select(spotsigs.signatures(F.col("text"), ["of", "on", "the"]).alias("s")).collect()]
    assert got == [want, want, [], [], [], [], [hashlib.md5(b"on cat").hexdigest()[:16]]]
    sets = spark.createDataFrame([(["a"], ["a"] + [f"{i}" for i in range(10)], 0.0), (["a"], ["a"] + [f"{i}" for i in range(9)], 0.1), ([], [], 1.0), ([], ["a"], 0.0)], "a array<string>, b array<string>, want double")
    for r in sets.select("a", "b", "want", spotsigs.jaccard(F.col("a"), F.col("b"), 0.1).alias("got"), spotsigs.jaccard(F.col("b"), F.col("a"), 0.1).alias("back"), spotsigs.jaccard(F.col("b"), F.col("a")).alias("exact")).collect():
        assert r.got == r.back and abs(r.got - r.want) < 1e-12
        a, b = set(r.a), set(r.b)
        assert abs(r.exact - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


# 3


def brute_components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_copies_on_edge_rows(docs, none):
    out = bottomk.components(docs).collect()
    assert len(out) == len(ROWS)
    want = brute_components([(r[0], r[1]) for r in ROWS if r[0] is not None], 3, 85, 100)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert bottomk.components(none).count() == 0
    kept = bottomk.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 8, 9, 10, 12]


@pytest.mark.parametrize("hot", [3, 8, 32])
def test_large_groups_of_near_copies(spark, hot):
    rng = random.Random(5)
    rows, base = [], [f"w{i}" for i in range(80)]
    for i in range(40):  # copies with 0 to 6 words replaced, dropped or added
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(w))
            how = rng.random()
            if how < 0.5:
                w[k] = rng.choice(["x", "y", f"z{i}"])
            elif how < 0.75:
                del w[k]
            else:
                w.insert(k, "q")
        rows.append((i, " ".join(w)))
    shared = " ".join(f"p{i}" for i in range(30))
    rows += [(100 + i, f"{shared} " + " ".join(f"u{i}_{k}" for k in range(25 + i % 7))) for i in range(25)]  # a common passage
    rows += [(200 + i, " ".join(base[:70]) + " " + " ".join(f"t{i}_{k}" for k in range(9 + i % 5))) for i in range(20)]  # a passage that is nearly all of the text
    for g in range(6):  # groups of near copies that share that passage, far from each other
        rows += [(300 + 10 * g + i, " ".join(base[:66]) + " " + " ".join(f"s{g}_{k}" for k in range(12)) + f" e{i}" * (i % 3)) for i in range(8)]
    out = bottomk.components(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, most=hot).collect()
    want = brute_components(rows, 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_a_cloud_of_far_members_makes_few_candidates(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:95] + [f"n{i}"])) for i in range(10)]  # the core
    for i in range(10, 210):  # each a tenth or more from the others, at most a few linked by chance
        w = list(base)
        for k in rng.sample(range(100), rng.randint(5, 12)):
            w[k] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    candidates, around = [], bottomk._around_centers

    def counted(*args):
        sure, more, rest = around(*args)
        candidates.append(more.count())
        return sure, more, rest

    monkeypatch.setattr(bottomk, "_around_centers", counted)
    out = bottomk.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 3, 85, 100)
    assert candidates and sum(candidates) < len(rows)  # of 21,945 pairs


def test_texts_that_nobody_wants_are_not_shuffled(spark, monkeypatch):
    """The bit set stands below the join with the wanted ids, also where these are too many to be broadcast."""
    plans, stored = [], bottomk.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(bottomk, "stored", seen)
    docs = spark.createDataFrame([(i, f"a b c {i}") for i in range(50)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sets = bottomk._sets(docs, docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id")).distinct(), 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.id for r in sets.collect()) == [0, 10, 20, 30, 40]
    assert 0 <= plans[0].index("SortMergeJoin") < plans[0].index("BroadcastHashJoin")


def test_near_copies_of_repeated_ids(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = [(5, a), (5, b), (7, a + " end"), (3, b + " end"), (9, b), (None, a), (None, "alone here now"), (11, None), (11, "")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in bottomk.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", "3", False), ("5", "3", False), ("7", "3", False), ("3", "3", True), ("9", "3", False), ("None", "3", False), ("None", "None", True), ("11", "11", True), ("11", "11", True)])
    kept = bottomk.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["11", "3", "None", "None"]


# 4 and 7


def test_lexicon_automaton_equals_edit_distance():
    terms = sorted(set(toxicity.SEED_TERMS))
    trie = toxicity.Trie(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "e", "o", "r"])
        w = "".join(w)
        near = sorted((distance(w[1:], t[1:]), t) for t in terms if w and t[0] == w[0] and distance(w[1:], t[1:]) <= trie.allowed(t))
        assert trie.search(w) == ((near[0][1], near[0][0]) if near else None)


def test_misspellings_anywhere_in_a_word():
    terms = sorted(set(toxicity.SEED_TERMS))
    trie = toxicity.Trie(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1) if rng.random() < 0.6 else 0
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "e", "o", "x"])
        w = "".join(w)
        near = sorted((d, t) for t in terms if (d := distance(w, t)) <= trie.allowed(t))
        assert trie.nearest(w) == ((near[0][1], near[0][0]) if near else None)
    hits = toxicity.ToxicityModel(frozenset(terms), frozenset(terms), frozenset({"lown"})).hits()
    assert all(hits[w] == 2 for w in "xdiot *diot tupid sasshole idot moro idiooooot stuuuupid id10t".split())
    assert all(hits[w] == 0 for w in "lown nice day tree".split()) and hits["idiot!"] == 1


def test_quotation_counts_apart_from_abuse():
    model = toxicity.ToxicityModel(frozenset(toxicity.SEED_TERMS), frozenset(toxicity.SEED_TERMS), frozenset())
    hits = model.hits()
    plain, quoted, clean = (toxicity.evidence(t, hits) for t in ("go away you idiot", 'he wrote the word "idiot" there', "a nice day"))
    assert plain[0] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0 and not clean.any()
    assert toxicity.evidence("you id10t", hits)[1] > 0 and toxicity.evidence(None, hits).sum() == 0
    scores = model.score(np.array([plain, quoted, clean]))
    assert scores[0] > 0.5 > scores[1] >= scores[2]


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_take_any_rows(docs, none, labels, module, label):
    for rows, marks in ((docs, labels), (docs, labels.where("false")), (none, labels)):
        model = module.fit(rows, marks)
        out = module.score(rows, model).collect()
        assert len(out) == rows.count()
        for r in out:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.3)) and r.held_out == held_out(r.doc_id, 5)
    keep = toxicity.keep_clean if label == "toxic" else quality.keep_good
    assert keep(docs, module.fit(docs, labels)).columns == docs.columns


@pytest.mark.parametrize("name, column, least", [("op4_toxicity_lexicon", "toxic", 0.93), ("op7_quality_discriminant", "quality", 0.93)])
def test_held_out_accuracy(spark, name, column, least):
    from lifelane.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    out = queries()[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = out.agg(F.avg((F.col("predicted") == F.col(column)).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 40 and r.a >= least


def test_toxic_scores_by_hand(docs, labels):
    """Each text's evidence with every misspelling found by plain edit distance, without the trie."""
    model = toxicity.fit(docs, labels)
    allowed = lambda t: 0 if len(t) < 5 else 1 if len(t) < 8 else 2

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, old[j] + 1, old[j - 1] + (x != b[j - 1])), initial=i)) if (old := row) else row
        return row[-1]

    class Plain(dict):
        def __missing__(self, raw):
            word = raw.strip(toxicity._EDGE)
            plain = word if word.isalpha() else "".join(c for c in word.translate(toxicity._LEET) if c.isalnum())
            forms = {word} | {f for f in (plain, toxicity._RUN.sub(r"\1\1", plain), toxicity._RUN.sub(r"\1", plain))}
            near = lambda w: w.isalpha() and w not in model.harmless and any(distance(w, t) <= allowed(t) for t in model.spelled)
            self[raw] = 1 if word in model.terms else 0 if word in model.harmless else 2 if any((f != word and f in model.terms) or near(f) for f in forms if f) else 0
            return self[raw]

    want = {i: float(model.score(toxicity.evidence(t, Plain())[None, :])[0]) for i, t, *_ in ROWS}
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-12 and r.predicted == (r.score >= 0.5) and r.held_out == held_out(r.doc_id, 5)


def test_discriminant_by_hand(spark):
    """Log-densities of the two shrunk normal distributions, by solving instead of by factors."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) + ("!!! $$ |" * (i % 4)), i % 2) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    x = {i: quality.statistics(t) for i, t, _ in rows}
    sets = [np.array([x[i] for i, _, y in rows if y == k and not held_out(i, 5)]) for k in (0, 1)]
    pooled = np.cov(np.concatenate(sets).T, bias=True)
    logs = {}
    for k in (0, 1):
        cov = 0.9 * np.cov(sets[k].T, bias=True) + 0.1 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(quality.NAMES))
        mean = sets[k].mean(axis=0)
        prior = math.log((len(sets[k]) + 1) / (len(sets[0]) + len(sets[1]) + 2))
        logs[k] = {i: prior - np.linalg.slogdet(cov)[1] / 2 - (v - mean) @ np.linalg.solve(cov, v - mean) / 2 for i, v in x.items()}
    for r in quality.score(docs, model).collect():
        odds = logs[1][r.doc_id] - logs[0][r.doc_id]
        assert abs(r.score - 1 / (1 + math.exp(-min(max(odds, -700), 700)))) < 1e-6


# 5


def test_licences(spark, docs, none):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    rows = [(1, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ,")), (2, mit + " more"), (3, "x\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0."), (4, None), (5, "")]
    got = {r.doc_id: (r.licence, r.notices, r.n_notices) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == "MIT" and got[2][0] is None and got[3] == (None, "CC-BY-NC-4.0,MIT", 2)
    assert got[4] == got[5] == (None, "", 0)
    known = {r.digest for r in licences.known_digests(spark).collect()}
    assert known == {licences.digest_of(t) for _, t in licences.KNOWN} | licences.DIGESTS.keys() and licences.digest_of("") not in known
    assert licences.scan(docs).count() == len(ROWS) and licences.scan(none).count() == 0


def test_licences_as_people_publish_them(spark):
    named = dict(reversed([(n, t) for n, t in licences.TEXTS]))
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n) for p in t.split("\n\n"))
    rows = [
        ("BSD-3-Clause", "Copyright (c) 2019, The Authors\nAll rights reserved.\n\n" + wrap(named["BSD-3-Clause"], 72)),
        ("BSD-3-Clause", "/* Copyright 1999-2020 A B.\n * Copyright (C) 2021 C D. All rights reserved. */\n" + wrap(named["BSD-3-Clause"], 60).lower()),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright <YEAR> <COPYRIGHT HOLDER>\n\n" + wrap(named["BSD-2-Clause"], 50)),
        ("MIT", "MIT License\n\nCopyright © 2021 X\nAll rights reserved.\n\n" + wrap(named["MIT"], 66)),
        ("MIT", "Copyright (c) 2020 John Q. Public. Licensed under the MIT License."),
        ("Unlicense", wrap(named["Unlicense"], 70)),
        ("BSL-1.0", wrap(named["BSL-1.0"], 70)),
        ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
        ("AGPL-3.0", "This project is licensed under the GNU Affero General Public Licence, version 3."),
        (None, "Copyright holders may not be liable."),
        ("MIT", "Copyright (c) 2020 A. Person " + " ".join(named["MIT"].split())),
        ("MIT", "# Copyright 2019 A\n# Copyright 2020 B\n#\n" + "\n".join("# " + line for line in wrap(named["MIT"], 40).split("\n"))),
        (None, "(c) You must not use this.\n\n" + named["MIT"]),
        (None, "Copyright 2020 A. Person\n\nYou must not use this.\n\n" + named["MIT"]),
    ]
    for root, dirs, files in os.walk("/usr/share/common-licenses"):  # where the system has them
        names = {"BSD": "BSD-3-Clause", "Artistic": "Artistic-1.0"} | {f"{k}-{v}": f"{k}-{v}" if "." in v else f"{k}-{v}.0" for k, vs in (("GPL", "1 2 3"), ("LGPL", "2 2.1 3"), ("GFDL", "1.2 1.3"), ("MPL", "1.1 2.0"), ("Apache", "2.0"), ("CC0", "1.0")) for v in vs.split()}
        for f in set(files) & names.keys():
            text = open(os.path.join(root, f)).read()
            parts = re.split(r"\n[ \t\r]*\n", text)
            rows += [(names[f], text)] + [(names[f], "\n\n".join(textwrap.fill(p, n, break_on_hyphens=False, break_long_words=False) for p in parts)) for n in (10**9, 60, 100)]
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(texts).collect()}
    assert got == {i: n for i, (n, _) in enumerate(rows)}


# 6


def test_language_model(docs, none):
    out = ngram_lm.score(docs, min_share=0.001, word_share=0.001).collect()
    assert len(out) == len(ROWS)
    train = Counter(w for i, t, *_ in ROWS if not held_out(i, 10) for w in [*words(t), None])
    n, v = sum(train.values()), len(train)
    base = {i: math.fsum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]) for i, t, *_ in ROWS}
    tokens = {i: [*words(t), None] for i, t, *_ in ROWS}
    for r in out:
        assert (r.n_tokens, r.n_known) == (len(tokens[r.doc_id]), sum(train[w] > 0 for w in tokens[r.doc_id]))
        assert r.train_tokens == n and abs(r.base_score - base[r.doc_id]) < 1e-9 and r.held_out == held_out(r.doc_id, 10)
    empty = {r.doc_id: r for r in out}
    assert empty[4].n_tokens == empty[5].n_tokens == 1 and empty[4].score == empty[5].score
    assert ngram_lm.score(none).count() == 0


def test_language_model_keeps_all_repeated_ngrams(spark):
    import pandas as pd

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(200)] + ["rare phrase of few"] * 3
    texts += [t[: len(t) // 2] for t in texts[:60]]
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    known = ngram_lm._Words()
    ids = {i: ngram_lm.tokens(t, known) for i, t in rows}
    train = [x for i, x in ids.items() if not held_out(i, 10)]
    uni = Counter(w for x in train for w in x)
    grams = [Counter(g for x in train for g in zip(*[x[k:] for k in range(n)])) for n in (2, 3)]
    kept = [(n, *g, *[0] * (3 - n), c) for n, counted in zip((2, 3), grams) for g, c in counted.items() if c >= 2]
    signed = np.array([[x - (1 << 64) if x >= 1 << 63 else x for x in r] for r in kept], dtype=np.int64)
    counts = ngram_lm.Counts(np.array(list(uni), np.uint64), np.array(list(uni.values())))
    model = ngram_lm.Automaton(pd.DataFrame(signed, columns=["ord", "a", "b", "c", "n"]), counts, sum(uni.values()), len(uni))
    scale = sum(uni.values()) + 0.1 * (len(uni) + 1)
    out = {r.doc_id: r.score for r in ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, x in ids.items():
        assert abs(out[i] - model.log10(x, [math.log10((uni[w] + 0.1) / scale) for w in x])) < 1e-6


def test_automaton_states_sum_to_one():
    import pandas as pd

    rng = random.Random(1)
    ids = [rng.choice([3, 4, 5, 6]) for _ in range(400)]
    uni, bi, tri = Counter(ids), Counter(zip(ids, ids[1:])), Counter(zip(ids, ids[1:], ids[2:]))
    counts = ngram_lm.Counts(np.array(list(uni), np.uint64), np.array(list(uni.values())))
    rows = [(2, a, b, 0, n) for (a, b), n in bi.items() if n > 8] + [(3, *k, n) for k, n in tri.items() if n > 5]
    model = ngram_lm.Automaton(pd.DataFrame(rows, columns=["ord", "a", "b", "c", "n"]).astype("int64"), counts, 400, len(uni))
    low = {w: math.log10((c + 0.1) / (400 + 0.1 * 5)) for w, c in uni.items()} | {99: math.log10(0.1 / (400 + 0.1 * 5))}
    assert len(model.state) > 5
    for lead in ([], [3], [3, 4], [5, 6], [4, 4]):
        start = model.log10(lead, [low[w] for w in lead])
        total = sum(10 ** (model.log10([*lead, w], [low[x] for x in [*lead, w]]) - start) for w in low)
        assert abs(total - 1) < 1e-6


# 8


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://x/3", "same"), (1, None, "same"), (2, "http://x/2", None), (5, "u\r\nv", ""), (6, "http://x/6", "é" * 5000), (7, "http://x/7", "same"), (None, "http://x/n", "only"), (3, "http://x/3", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages, archive_bytes=2000).cache()
    got = warc.read_archives(archives, payloads=True).collect()
    assert len(got) == len(rows)
    first = {"same": 1, "": 2, "é" * 5000: 6, "only": None}
    for r in got:
        html = next((h or "") for p, _, h in rows if p == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == warc.sha1_base32(html.encode())
        assert r.record_type == ("response" if first[html] == r.page_id else "revisit")
        assert r.refers_to == (None if first[html] == r.page_id else first[html])
        assert r.payload == (html.encode() if r.record_type == "response" else None)
    sizes = warc.save(archives, f"file://{tmp_path}/out").collect()
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/out")
    assert files.count() == len(sizes) and warc.read_archives(files).count() == len(rows)
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
    assert warc.read_archives(warc.write_archives(pages, least_bytes=5)).where("record_type = 'revisit'").count() == 0


def test_no_payload_is_lost_where_ids_repeat(spark):
    rows = [(1, "u", "A", 0), (3, "u", "A", 1), (3, "u", "BBB", 2), (3, "u", "BBB", 2), (4, "u", "BBB", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = [(r.page_id, r.record_type, r.refers_to, r.payload) for r in warc.read_archives(warc.write_archives(pages), payloads=True).collect()]
    assert sorted(got, key=str) == sorted([(1, "response", None, b"A"), (3, "revisit", 1, None), (3, "response", None, b"BBB"), (3, "response", None, b"BBB"), (4, "revisit", 3, None)], key=str)


def test_payloads_of_many_pages_are_joined_apart(spark):
    rows = [(i, "u", "common" if i % 2 else f"{i % 10}") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.refers_to) for r in warc.revisits(pages).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert got == {(i, first[h]) for i, _, h in rows if i != first[h]}


def test_broken_archives_raise():
    good = warc.record(1, "u", b"abc", None)
    assert warc.parse(good)[0]["WARC-Type"] == "response"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"X-Date"), b"nonsense", good + b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(struct.pack("<II", warc.DICTIONARY_MAGIC, 100) + b"short"))


def test_dictionary_leads_each_archive(spark):
    pages = spark.createDataFrame([(i, "u", f"<html><body>{text(i, 80)}</body></html>" * 3) for i in range(120)], "page_id long, url string, html string")
    for r in warc.write_archives(pages).collect():
        assert struct.unpack_from("<I", r.content)[0] == warc.DICTIONARY_MAGIC
        assert len(list(warc.frames(r.content))) > 0


# 9


def test_targets_stop_at_three_times():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 100, 100], [5, 2, 1])
    assert got[0] == 30.0 and abs(sum(got) - 210) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [5, 2]) == [0.0, 5.0]


def test_knapsack_reaches_what_subsets_reach():
    rng = random.Random(4)
    for _ in range(200):
        counts = [(n, rng.randint(1, 4)) for n in rng.sample(range(1, 30), rng.randint(1, 5))]
        whole = sum(n * c for n, c in counts)
        budget = rng.randint(0, whole)
        taken = mixing.fit_counts(counts, budget)
        assert all(0 < k <= dict(counts)[n] for n, k in taken.items())
        got = sum(n * k for n, k in taken.items())
        assert got <= budget and budget - got <= max(n for n, _ in counts)


def test_knapsack_finds_the_best_subset():
    rng = random.Random(6)
    for _ in range(300):
        items = [(n, rng.randint(1, 3)) for n in rng.sample(range(1, 40), rng.randint(1, 5))]
        budget = rng.randint(0, 90)
        taken = mixing.knapsack(items, budget)
        assert all(0 < k <= dict(items)[n] for n, k in taken.items())
        every = {sum(n * k for (n, _), k in zip(items, ks)) for ks in itertools.product(*[range(c + 1) for _, c in items])}
        assert sum(n * k for n, k in taken.items()) == max(t for t in every if t <= budget)


def test_mixture(docs, none):
    rows = mixing.sized(docs).select("doc_id", "source", "size")
    out = mixing.plan(rows).collect()
    assert len(out) == len(ROWS)
    again = mixing.plan(rows.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.times)
    assert sorted(map(key, out)) == sorted(map(key, again))
    names = sorted({r[3] for r in ROWS if r[3]}) + [None]
    sizes = [sum(len(words(t)) for _, t, _, s in ROWS if s == n) for n in names]
    want = dict(zip(names, mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    for n in names:
        own = [r for r in out if r.source == n]
        assert all(abs(r.target - want[n]) < 1e-9 for r in own)
        longest = max(r.size for r in own)
        assert abs(sum(r.size * r.times for r in own) - want[n]) <= longest + 1
    assert all(r.times <= 3 for r in out)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.times for r in out if r.size) and mixing.mix(none).count() == 0


def test_mixture_shuffles_and_sorts_the_texts_once(spark, capsys):
    rows = [(i % 7 or None, f"w{i % 3} x", "ab"[i % 2]) for i in range(60)]
    mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).explain("formatted")
    nodes = [n.splitlines() for n in capsys.readouterr().out.split("\n\n")]
    for kind in ("Exchange", "Sort"):
        wide = [n for n in nodes if re.match(rf"\(\d+\) {kind}\b", n[0]) and any(line.startswith("Input") and " text#" in line for line in n)]
        assert len(wide) == 1, wide


def test_mixture_takes_the_same_of_tied_rows(spark):
    rows = [(1, f"{w} {w}", "a") for w in "pqrstu"] + [(None, "x y", "a")] * 3 + [(2, "z z z z z z z", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) > 5
    taken = Counter(eval(r.replace("Row", "dict"))["text"] for r in one)
    assert sum(len(t.split()) * n for t, n in taken.items()) <= 25 and max(taken.values()) <= 9


# 10


def test_lacing_by_hand():
    head = b"\x81\x00\x05"
    xiph = head + b"\x82\x02" + b"\xff\x01" + b"\x02" + b"a" * 256 + b"bb" + b"ccc"
    ebml = head + b"\x06\x02" + b"\x83" + bytes([0x80 | 63 + 2]) + b"aaa" + b"bbbbb" + b"c"
    fixed = head + b"\x04\x01" + b"aabb"
    plain = head + b"\x80" + b"xyz"
    for data, sizes in ((xiph, [256, 2, 3]), (ebml, [3, 5, 1]), (fixed, [2, 2]), (plain, [3])):
        found = matroska.block_packets(data, 0, len(data), 10, durations={1: 7_000_000})
        assert [p.size for p in found] == sizes and [p.timestamp_ns for p in found] == [15_000_000 + 7_000_000 * i for i in range(len(sizes))]
        shared = matroska.block_packets(data, 0, len(data), 10, duration=len(sizes))
        assert [p.timestamp_ns for p in shared] == [15_000_000 + 1_000_000 * i for i in range(len(sizes))]
        assert [p.timestamp_ns for p in matroska.block_packets(data, 0, len(data), 10)] == [15_000_000] + [None] * (len(sizes) - 1)
        assert b"".join(data[p.offset : p.offset + p.size] for p in found) == data[-sum(sizes) :]
    with pytest.raises(ValueError):
        matroska.block_packets(head + b"\x04\x01" + b"aab", 0, 8, 0)
    with pytest.raises(ValueError):
        matroska.vint(b"\x40", 0)


def test_block_groups_have_durations_and_references():
    block = matroska._element(matroska.BLOCK, b"\x81\x00\x00\x04\x01aabb")
    one = matroska._element(matroska.BLOCK_GROUP, block + matroska._uint(matroska.BLOCK_DURATION, 8))
    two = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.REFERENCE_BLOCK, b"\xf8") + block)
    data = matroska._element(matroska.SEGMENT, matroska._element(matroska.CLUSTER, matroska._uint(matroska.TIMESTAMP, 3) + one + two))
    found, _, facts = matroska.parse(data)
    assert [p.timestamp_ns for p in found] == [3_000_000, 7_000_000, 3_000_000, None] and [p.keyframe for p in found] == [True, True, False, False]
    assert facts["clusters"] == 1 and facts["tracks"] == 0


def test_media_round_trip(docs, none):
    out = matroska.digest(matroska.store_texts(docs)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        t = next(x for i, x, *_ in ROWS if i == r.doc_id)
        data = matroska.payload(t)
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(data)) and len(data) % 576 == 0 and data
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-32:])
        # The feature by hand: packets, mean, root mean square, crossings of the middle.
        crossings = sum((a >= 128) != (b >= 128) for a, b in itertools.pairwise(data))
        assert r.feature == f"{len(data) // 576}:{sum(data) / len(data):.4f}:{math.sqrt(sum(b * b for b in data) / len(data)):.4f}:{crossings}"
    packets = matroska.packet_table(matroska.store_texts(docs)).where("doc_id = 8").orderBy("packet").collect()
    assert [p.timestamp_ns for p in packets] == [72_000_000 * i for i in range(len(packets))] and len(packets) > 8 and all(p.keyframe for p in packets)
    assert sum(p.byte_size for p in packets) == len(matroska.payload(text(8, 4000)))
    _, cues, facts = matroska.parse(matroska.mux(matroska.payload("x" * 400_000)))
    assert len(cues) == facts["clusters"] > 1 and facts["tracks"] == 1
    assert matroska.digest(matroska.store_texts(none)).count() == 0


def test_packed_keys_take_few_bits():
    """Sorted random keys need 64 bits less those of their number, and 1.44 more: here 51.3."""
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 16384, dtype=np.uint64))
    for k in (keys, keys[:300], keys[:1], keys[:0], np.array([(1 << 64) - 1], np.uint64), np.arange(-3, 90, dtype=np.int8), np.array([1.5, -2.0])):
        back = ngram_lm._unpack(ngram_lm._pack(k))
        assert back.dtype == k.dtype and (back == k).all()
    assert len(ngram_lm._pack(keys)) * 8 / len(keys) < 52.2


def test_pieces_and_their_text_come_from_one_worker(spark):
    rows = spark.createDataFrame([(1, "Zebras  graze\n\nquietly é世"), (2, ""), (3, None)], "doc_id long, text string")
    out = sentencepiece_codec.encode(rows, decoded="back")
    assert out.columns == ["doc_id", "text", "ids", "back"] and out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, out.collect())) == sorted(map(str, sentencepiece_codec.decode(sentencepiece_codec.encode(rows), out="back").collect()))


def test_a_reached_position_is_not_tried_again():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    words = ["international", "responsibilities", "unquestionable", "straightforwardness", "xqzzyvorpal"]
    ids = [codec.encode(w) for w in words]
    assert codec.pairs < 150 and [codec.decode(i) for i in ids] == words


def test_plain_rules_need_no_pattern(spark):
    texts = ["Non commercial non infringing, non  non-Commercial; copyright owners, Copyright proprietor. licenc licencc", "All rights reserved all all rights reserved rights reserved", "whilst https://a HTTPS x acknowledgements sub-licence sub licensed nonnon infring", "", None, "organised colour\n\nlicencing © 2020 x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = F.lower(F.coalesce("t", F.lit("")))
    for pattern, to in licences.RULES:
        out = F.regexp_replace(out, pattern, to)
    assert rows.where(licences.canonical(F.col("t")) != F.trim(out)).count() == 0
    plan = rows.select(licences.canonical(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == sum(not licences.literals(*r) for r in licences.RULES) == 8
