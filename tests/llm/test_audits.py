"""Repair, divergence and exact dedup against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifelane.llm import divergence, exact_exchange, repair

SF = "/root/testdata/sf0.001"

# 11


def cheapest(rows):
    """(cost, audit) of (initial, fault) rows by plain recursion over all edits, with at most two inserts in a row."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    known = {}

    def best(i, q, inserts):
        if (i, q, inserts) in known:
            return known[i, q, inserts]
        found = [(0, "")] if i == len(rows) and q in ("", "a") else []
        step = lambda more, letter, rest: found.append((more + rest[0], letter + rest[1])) if rest else None
        if inserts < 2:
            for x in "ua":
                if (q, x) in follows:
                    step(5, "I", best(i, follows[q, x], inserts + 1))
        if i < len(rows):
            initial, fault = rows[i]
            step(2, "D", best(i + 1, q, 0))
            if fault != "forced":
                more = 5 * (fault == "truncated")
                if (q, initial) in follows:
                    step(more, "K", best(i + 1, follows[q, initial], 0))
                for x in "ua":
                    if (q, x) in follows:
                        step(more + 1, "R", best(i + 1, follows[q, x], 0))
        known[i, q, inserts] = min(found) if found else None
        return known[i, q, inserts]

    return best(0, "", 0)


def brute_repair(rows):
    """The figures of a conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = cheapest([(r[1][:1], "forced" if f in ("blank", "duplicate") else f) for r, f in zip(rows, faults, strict=True)])
    out, at, state = [], iter(rows), ""
    for letter in audit:
        _, role, text = next(at) if letter != "I" else (0, "", "")
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == "u" else "user"
        state = role[0]
        out.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text, k = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        kept = out[conv]
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        if k:
            kept.extend([(turn, role, text)] * (2 if k == 3 else 1))
    return out


def talk(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "uncle", None, "", "User", " "]
    texts = ["Yes.", "No!", "what?", "cut", "", " \t", None, "end. \n", "ö.", "mid. dle", "Yes."]
    turn = lambda i: rng.choice([i, i, i, i, i + 3, None])
    return [(conv, turn(i), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"say {rng.random()}.") for i in range(n)]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randrange(1, 9))]
    rows += talk(rng, None, 5) + talk(rng, 1000, 150) + [(7, 1, "user", "Hi.")] * 3
    rows += [(2000 + i, i, "user", "a") for i in range(40)]  # some conversations lose all their rows
    rows += [(3000, i, ("user", "assistant")[i % 2], "word " * 20_000 + str(i) + ".") for i in range(6)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, k string, at int, b int").repartition(3)


@pytest.mark.parametrize("block, long", [(4096, 16), (8, 2)])
def test_repairs_are_cheapest(spark, talks, monkeypatch, block, long):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "LONG", long)
    conversations = frame(spark, talks)
    got = {r[0]: tuple(r)[1:] for r in repair.repairs(conversations, repair.damaged(conversations)).collect()}
    damaged = brute_damage(talks)
    want = {conv: brute_repair(damaged[conv]) for conv in {r[0] for r in talks}}
    assert got == want
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert sum(v == empty for v in want.values()) > 0 and {c for v in want.values() for c in v[6]} >= set("DKR")


def test_agenda_equals_recursion():
    rng = random.Random(8)
    for n in [*range(7)] * 60:
        rows = [(rng.choice("suax"), rng.choice(["", "", "forced", "truncated"])) for _ in range(n)]
        classes = bytes(3 * "suax".index(r) + ["", "forced", "truncated"].index(f) for r, f in rows)
        assert repair.lightest(classes)[repair.START][:2] == cheapest(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Hello."), (1, 4, "user", "And"), (2, 0, "tool", "x."), (2, 1, "assistant", "y."), (3, 0, "user", "")]
    out = sorted(tuple(r) for r in repair.repaired(frame(spark, rows)).collect())
    assert out == [(1, 0, "system", "Be kind.", "K"), (1, 1, "user", "Hi.", "K"), (1, 2, "assistant", "Hello.", "K"), (2, 0, "user", "x.", "R"), (2, 1, "assistant", "y.", "K")]


def test_repair_of_nothing(spark, talks):
    none = frame(spark, talks).where("false")
    assert repair.repairs(none, none).collect() == [] and repair.repaired(none).collect() == []


def test_op11_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = brute_damage(rows)
    assert {r[0]: tuple(r)[1:] for r in repair.op11_agenda_repair(spark, SF).collect()} == {c: brute_repair(damaged[c]) for c in {r[0] for r in rows}}


# 12


def brute_audit(rows, least, top):
    """rows: (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), {r[:2] for r in rows}
    for lang, source, text in rows:
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        whole = Counter({t: sum(n[g][t] for g in groups if g[0] == lang) for t in kept})

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {g: share(n[g]) for g in groups if g[0] == lang}
        q = share(whole)
        for g in p:
            pairs = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h[1]) for h in p if h != g]
            terms = [(p[g][t] - q[t], t) for t in kept if n[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out |= {(*g, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top}
    return out


@pytest.mark.parametrize("tile", [64, 2])
def test_audit_equals_counting(spark, monkeypatch, tile):
    rng = random.Random(3)
    words = ["the", "The", "cat", "Ünï", "ß", "a1b", "日本", "x", "dog's", "und", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))]
    rows = [(rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["s1", "s2", "s3", "s4", None, "", "é", "z"]), " ".join(rng.choice(words[: rng.choice([5, 30, 100])]) for _ in range(rng.randrange(0, 60)))) for _ in range(400)]
    rows += [("en", "silent", "123 ..."), ("en", None, None), ("lone", "one", "word " * 20_000), ("few", "a", "rare"), ("few", "b", None)] + [rows[0]] * 5
    docs = spark.createDataFrame([(t, a, s, 1, "k", 3) for a, s, t in rows], "text string, lang string, source string, n int, term string, band int").repartition(3)
    if tile != 64:
        monkeypatch.setattr(divergence.pair_sums, "__defaults__", (tile,))
        monkeypatch.setattr(divergence.chunks, "__defaults__", (64,))
    got = divergence.audited(docs, min_documents=7, top=5).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, 7, 5) and len(got) == len({tuple(r) for r in got})
    assert divergence.audited(docs.where("false")).collect() == []


def test_joint_cells_in_steps():
    rng = np.random.default_rng(2)
    terms = 200
    for room in (1, 1 << 20):
        x, y = rng.integers(0, 6, terms), rng.integers(0, 4, terms)

        def sets(counts):
            found = [c for c in np.unique(counts) if c]
            bits = np.zeros((len(found), 4), np.uint64)
            for i, c in enumerate(found):
                for t in np.flatnonzero(counts == c):
                    bits[i, t // 64] |= np.uint64(1) << np.uint64(t % 64)
            return 7, np.array([10 * c + 7 for c in found], np.int64), bits, np.array([(counts == c).sum() for c in found])

        assert divergence.joint(sets(x), sets(y), terms, room) == int(np.abs(10 * x - 10 * y).sum())


# 13


def test_golomb_codes_round_trip():
    rng = np.random.default_rng(4)
    for n, span in [(0, 10), (1, 1), (1, 1 << 62), (5, 5), (1000, 1 << 40), (3000, 4000), (50_000, 1 << 45)]:
        values = np.unique(rng.integers(0, span, n, dtype=np.uint64)) if span > n else np.arange(n, dtype=np.uint64)
        code = exact_exchange.golomb(values, span)
        assert (exact_exchange.golomb_read(code) == values).all()
        if n == 50_000:  # log2(span / n) + 1.5 bits each, about
            assert len(code) * 8 / len(values) < np.log2(span / n) + 2


COPIES = [(1, "a b"), (2, "a b"), (3, "a b "), (4, None), (5, ""), (6, "A b"), (7, "x " * 100_000), (8, "x " * 100_000), (8, "x " * 100_000), (None, "a b"), (None, "lone"), (9, "ünï"), (10, "üni")]
COPIES += [(100 + i, "hot") for i in range(300)] + [(1000 + i, f"text {i % 400}") for i in range(500)]


@pytest.mark.parametrize("spare", [16, -7])
def test_copies_are_found(spark, monkeypatch, spare):
    """With few bits, most fingerprints collide by chance, and the bytes decide."""
    monkeypatch.setattr(exact_exchange, "SPARE_BITS", spare)
    docs = spark.createDataFrame([(t, i, "s", 1, "f") for i, t in COPIES], "text string, doc_id long, row string, fp int, text_sha256 string").repartition(5).cache()
    got = exact_exchange.marked(docs).collect()
    groups = defaultdict(list)
    for i, t in COPIES:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        for place, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            want[i, keep, len(ids), place == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    stay = exact_exchange.keep_one(docs)
    assert stay.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in stay.collect()) == Counter((k[1], t) for t in groups for k in want if k[3] and k[4] == hashlib.sha256(t.encode()).hexdigest())
    assert exact_exchange.marked(docs.where("false")).collect() == [] and exact_exchange.keep_one(docs.where("false")).collect() == []


def test_only_suspects_are_told(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2 if i < 20 else i}") for i in range(2000)], "doc_id long, text string").repartition(4)
    rows = exact_exchange.hashed(docs)
    flags = exact_exchange.suspected(rows, 2000, 3).collect()
    assert sum(flags) == 20 and len(flags) == 2000
    assert all(f == (r.doc_id < 20) for r, f in zip(rows.collect(), flags, strict=True))
    assert rows.zip(exact_exchange.suspected(rows, 2000, 3)).filter(lambda p: p[1]).map(lambda p: p[0].doc_id).sum() == sum(range(20))
    assert docs.select(F.count("*")).first()[0] == 2000
