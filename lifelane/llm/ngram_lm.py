"""Language-model scoring: a weighted backoff automaton of smoothed n-grams over exact counts of words, pairs and triples."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, let_go, remainder, slices, stored

END = 1  # the id of the end token; a word's id is its 64-bit hash
BLOCK_BYTES = 4_000_000  # text of a block, about
SLICE_BYTES = 8_000_000  # text whose keys make up a slice of the key space, about
LEAST = 2  # n-grams (n > 1) seen less often in all training texts fall back to shorter ones
DISCOUNT = 0.75


class _Words(dict):
    """Word -> its id; a block has its own, emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def tokens(text: str | None, known: _Words) -> list[int]:
    """Ids of the words [^\\x20\\x09-\\x0D]+ of a whole text with A-Z lower-cased, then the end; null text: the end."""
    return [*map(known.__getitem__, (text or "").encode("utf-8", "replace").lower().split()), END]


def _held(documents: DataFrame, mod: int) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", mod) == 0).alias("held_out"), "text")


def in_blocks(documents: DataFrame, mod: int) -> DataFrame:
    """block, bytes, rows: documents as they come, in blocks of about BLOCK_BYTES of text.

    rows holds a block's (doc_id, held_out, text) as compressed Arrow. Written once, so that every step sees the same blocks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
        task, made = TaskContext.get().partitionId(), 0

        def block(parts: list, size: int) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=options) as writer:
                for part in parts:
                    writer.write_batch(part)
            return pa.RecordBatch.from_pydict({"block": pa.array([(task << 32) + made], pa.int64()), "bytes": pa.array([size], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        parts, held = [], 0
        for batch in slices(batches, 256):
            parts.append(batch)
            held += sum(len(t.as_buffer()) for t in batch.column("text") if t.is_valid)
            if held >= BLOCK_BYTES:
                yield block(parts, held)
                parts, held, made = [], 0, made + 1
        if parts:
            yield block(parts, held)

    return stored(_held(documents, mod).mapInArrow(pack, "block long, bytes long, rows binary"), "blocks")


def _unpacked(rows: bytes) -> tuple[list, list, list]:
    table = pa.ipc.open_stream(rows).read_all()
    return tuple(table.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))


def _pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, like bytes of all values together; sorted keys as their differences.

    The bytes below a key's differences are noise: they stay as they are, so that one code needn't fit them and the rest.
    """
    kind, low = values.dtype.str[1:].encode(), 0
    if kind == b"u8" and len(values):
        values = np.diff(values, prepend=np.uint64(0))
        low = min(max(0, int(np.median(values)).bit_length() - 1) // 8, 7)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    high = planes[low:].tobytes()
    return kind + bytes([low]) + len(values).to_bytes(4, "little") + planes[:low].tobytes() + (pa.compress(high, codec="zstd", asbytes=True) if high else b"")


def _unpack(data: bytes) -> np.ndarray:
    kind, low, n = np.dtype(data[:2].decode()), data[2], int.from_bytes(data[3:7], "little")
    if not n:
        return np.zeros(0, kind)
    noise = 7 + low * n
    planes = data[7:noise] + pa.decompress(data[noise:], n * (kind.itemsize - low), codec="zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()
    return np.cumsum(values, dtype=np.uint64) if kind == np.uint64 else values


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the least signed type that holds them."""
    return values.astype(np.min_scalar_type(-int(values.max(initial=0)) - 1))


def _joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = (a ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return k ^ (k >> np.uint64(29))


class Grams:
    """The words, pairs and triples of a block's texts: keys are their sorted distinct 64-bit hashes, the lowest two bits
    of which are the length; of[n - 1] has the place in keys of the n-gram that ends at each token, or -1."""

    def __init__(self, rows: list[bytes]) -> None:
        let_go()
        parts = [_unpacked(r) for r in rows]
        self.docs, self.held = [i for p in parts for i in p[0]], [h for p in parts for h in p[1]]
        known = _Words()
        ids = [tokens(t, known) for p in parts for t in p[2]]
        self.sizes = np.array([len(i) for i in ids], dtype=np.int64)
        x = np.array([w for i in ids for w in i], dtype=np.uint64)
        del parts, ids
        at = np.arange(len(x)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        two, three = np.nonzero(at >= 1)[0], np.nonzero(at >= 2)[0]
        pair = np.zeros(len(x), np.uint64)
        pair[two] = _joined(x[two - 1], x[two], 2)
        triple = _joined(pair[three - 1], x[three], 3)
        tag = lambda k, n: (k & ~np.uint64(3)) | np.uint64(n)
        self.keys, place = np.unique(np.concatenate([tag(x, 1), tag(pair[two], 2), tag(triple, 3)]), return_inverse=True)
        train = np.repeat(~np.array(self.held, dtype=bool), self.sizes)
        self.n = np.bincount(place, weights=np.concatenate([train, train[two], train[three]]), minlength=len(self.keys)).astype(np.int64)
        self.of = [place[: len(x)], np.full(len(x), -1), np.full(len(x), -1)]
        self.of[1][two] = place[len(x) : len(x) + len(two)]
        self.of[2][three] = place[len(x) + len(two) :]


def _slice_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The slice, one of parts (under 2**31) equal ranges of the key space, of each key, by its upper 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sliced(parts: int, keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """(slice, packed keys, packed values ...) of each slice that some of the sorted keys lie in, in their order."""
    if not len(keys):
        return
    of = _slice_of(keys, parts)
    first = np.nonzero(np.diff(of, prepend=of[0] - 1))[0]
    for lo, hi in zip(first, [*first[1:], len(keys)], strict=True):
        yield (int(of[lo]), _pack(keys[lo:hi]), *[_pack(m[lo:hi]) for m in more])


def totals(blocks: DataFrame, parts: int, least: float) -> DataFrame:
    """block, slice, answer, tokens, words: for each block, what its keys of a slice amount to over all training texts.

    An answer has twice the count for each key, and one more in the one block that owns the key; 0 for pairs and triples
    seen less than least times, which are no arcs. tokens and words are the training tokens and distinct words of a
    slice, once. A block names a key once, so no key makes a slice large.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                g = Grams([rows])
                s, k, n = zip(*_sliced(parts, g.keys, _small(g.n)), strict=True)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(s), pa.int64()), "slice": pa.array(s, pa.int32()), "keys": pa.array(k, pa.binary()), "n": pa.array(n, pa.binary())})

    def answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [_unpack(k) for k in pdf["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        found, first, place = np.unique(keys, return_index=True, return_inverse=True)
        del keys
        total = np.bincount(place, weights=np.concatenate([_unpack(n).astype(np.int64) for n in pdf["n"]]), minlength=len(found)).astype(np.int64)
        single = (found & np.uint64(3)) == 1
        said = np.where(single | (total >= least), 2 * total, 0)
        out = said[place]
        out[first] += single | (total >= least)
        words = total[single]
        once = lambda v: [int(v)] + [0] * (len(ends) - 1)
        packed = [_pack(_small(a)) for a in np.split(out, ends[:-1])]
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "slice": np.int32(key[0]), "answer": packed, "tokens": once(words.sum()), "words": once((words > 0).sum())})

    asked = blocks.mapInArrow(ask, "block long, slice int, keys binary, n binary")
    return asked.groupBy("slice").applyInPandas(answer, "block long, slice int, answer binary, tokens long, words long")


def walked(blocks: DataFrame, totals: DataFrame, parts: int, total: int, distinct: int, least: float, frequent: float) -> DataFrame:
    """Walks each block's texts through the states that they need, as far as is known without the failure arcs' weights.

    Rows with a slice ask for the weights of contexts (keys) and give what this block's own n-grams add to contexts' sums
    (own, p, low: probabilities of the followers, and what these would get from the shorter context). One row without a
    slice per block has its texts' figures and, in turn, which of all contexts asked for each text fails from.
    """
    scale = total + 0.1 * (distinct + 1)

    def run(key, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        g = Grams(list(texts["rows"]))
        got = np.concatenate([_unpack(a).astype(np.int64) for a in answers.sort_values("slice")["answer"]])
        c, owned = got >> 1, (got & 1).astype(bool)
        one, two, three = g.of
        last = lambda v, none: np.concatenate(([none], v[:-1]))
        before, pair_before = last(one, 0), last(two, -1)  # of the context; the first token of a text has none
        often = c[one] >= frequent
        ok2 = (two >= 0) & (c[two] >= least) & often & last(often, False)
        ok3 = (three >= 0) & (c[three] >= least) & ok2 & last(ok2, False)
        p1 = (c[one] + 0.1) / scale
        p2 = np.where(ok2, (c[two] - DISCOUNT) / np.maximum(c[before], 1), 1.0)
        p3 = np.where(ok3, (c[three] - DISCOUNT) / np.maximum(c[pair_before], 1), 1.0)
        base = np.log10(p1)
        sure = np.where(ok3, np.log10(p3), np.where(ok2, np.log10(p2), base))
        # Failure arcs: from a pair that is a state, and on from the word where it has no arc either.
        from_pair = np.where(~ok3 & (three >= 0) & last(ok2, False), pair_before, -1)
        from_word = np.where(~ok2 & (two >= 0) & last(often, False), before, -1)
        both = np.stack([from_pair, from_word], axis=1)
        need, which = np.unique(both[both >= 0], return_inverse=True)
        fails = np.add.reduceat((both >= 0).sum(axis=1), np.cumsum(g.sizes) - g.sizes)

        def mine(ok, gram):  # one place of each n-gram that this block owns
            at = np.nonzero(ok)[0]
            at = at[owned[gram[at]]]
            return at[np.unique(gram[at], return_index=True)[1]]

        m2, m3 = mine(ok2, two), mine(ok3, three)
        own, place = np.unique(np.concatenate([before[m2], pair_before[m3]]), return_inverse=True)
        sums = [np.bincount(place, weights=np.concatenate(v), minlength=len(own)) for v in ([p2[m2], p3[m3]], [p1[m2], p2[m3]])]
        asks = {s: (k,) for s, k in _sliced(parts, g.keys[need])}
        gives = {s: more for s, *more in _sliced(parts, g.keys[own], *sums)}
        no_key, no_sum = _pack(g.keys[:0]), _pack(sums[0][:0])
        rows = [(key[0], s, *asks.get(s, (no_key,)), *gives.get(s, (no_key, no_sum, no_sum)), None) for s in sorted(asks.keys() | gives.keys())]
        edges = np.cumsum(g.sizes)[:-1]
        add = lambda v: [math.fsum(x.tolist()) for x in np.split(v, edges)]
        docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(g.docs, pa.int64()), "held_out": pa.array(g.held, pa.bool_()), "n_tokens": g.sizes, "n_known": np.add.reduceat((c[one] > 0).astype(np.int64), np.cumsum(g.sizes) - g.sizes), "base_score": pa.array(add(base)), "sure": pa.array(add(sure)), "fails": fails.astype(np.int64)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as writer:
            writer.write_batch(docs)
        rows.append((key[0], None, _pack(_small(which)), None, None, None, sink.getvalue().to_pybytes()))
        out = pd.DataFrame(rows, columns=["block", "slice", "keys", "own", "p", "low", "docs"])
        out["slice"] = out["slice"].astype("Int32")
        return out

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(run, "block long, slice int, keys binary, own binary, p binary, low binary, docs binary")


def weights(asked: DataFrame) -> DataFrame:
    """block, slice, answer: log10 weights of the failure arcs of the contexts asked for; 0 where one is no state."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        own, place = np.unique(np.concatenate([_unpack(k) for k in pdf["own"]]), return_inverse=True)
        p, low = (np.bincount(place, weights=np.concatenate([_unpack(v) for v in pdf[name]]), minlength=len(own)) for name in ("p", "low"))
        # A last context of weight 0 stands for all that are no states.
        weight = np.append(np.log10((1 - p).clip(1e-12) / (1 - low).clip(1e-12)), 0.0)

        def of(keys: np.ndarray) -> np.ndarray:
            at = np.searchsorted(own, keys)
            hit = at < len(own)
            hit[hit] = own[at[hit]] == keys[hit]
            return weight[np.where(hit, at, len(own))]

        return pd.DataFrame({"block": pdf["block"].to_numpy(), "slice": np.int32(key[0]), "answer": [_pack(of(_unpack(k))) for k in pdf["keys"]]})

    return asked.groupBy("slice").applyInPandas(run, "block long, slice int, answer binary")


class Counts:
    """Sorted word ids with their counts, for look-ups by arrays and a bounded table of frequent words."""

    def __init__(self, w: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(w)
        self.w, self.c = w[order], c[order]

    def of(self, w: np.ndarray) -> np.ndarray:
        if not len(self.w):
            return np.zeros(len(w), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.w, w), len(self.w) - 1)
        return np.where(self.w[at] == w, self.c[at], 0)


class Automaton:
    """The plain version in one piece, for texts of any few states. States are contexts: 0 the empty one, then words, then pairs of words. An arc leads on by a word with its log10
    probability; where a state has none, its failure arc leads to the shorter context at a weight.

    A bigram's probability is (count - DISCOUNT) / count of its context; what discounts and pruning leave of a context,
    over what its followers would get from the shorter one, is the weight of the failure arc. The empty context gives
    each word the smoothed unigram probability, which covers unseen words; so every state's probabilities sum to one
    over all known words and one unseen one. A text begins in the empty context.
    """

    def __init__(self, grams: pd.DataFrame, counts: Counts, total: int, distinct: int) -> None:
        self.total, self.distinct = total, distinct
        self.state: dict[tuple, int] = {(): 0}
        self.arcs: list[dict[int, tuple[float, int]]] = [{}]
        self.fail: list[tuple[int, float]] = [(0, 0.0)]
        pairs = grams[grams["ord"] == 2]
        unsigned = lambda col: col.to_numpy(dtype=np.int64).view(np.uint64)
        a, b, n = unsigned(pairs["a"]), unsigned(pairs["b"]), pairs["n"].to_numpy()
        p_b = self.unigram(counts.of(b))
        prob2 = self._level(a, n, counts.of(a), p_b, [(int(x),) for x in a], [()] * len(a), b)
        two = {(int(x), int(y)): (int(k), float(p)) for x, y, k, p in zip(a, b, n, prob2, strict=True)}
        triples = grams[grams["ord"] == 3]
        if len(triples):
            rows = [(int(x), int(y), int(z), int(k)) for x, y, z, k in zip(unsigned(triples["a"]), unsigned(triples["b"]), unsigned(triples["c"]), triples["n"], strict=True)]
            rows = [r for r in rows if (r[0], r[1]) in two and (r[1], r[2]) in two]
            if rows:
                lower = np.array([two[r[1], r[2]][1] for r in rows])
                self._level(np.array([hash(r[:2]) for r in rows]), np.array([r[3] for r in rows]), np.array([two[r[0], r[1]][0] for r in rows]), lower, [r[:2] for r in rows], [(r[1],) for r in rows], np.array([r[2] for r in rows], dtype=np.uint64))
        # Where an arc leads: the longest context that is a state.
        for context, s in list(self.state.items()):
            arcs = self.arcs[s]
            for w, (p, _) in arcs.items():
                arcs[w] = (p, self.state.get((*context, w)[-2:], self.state.get((w,), 0)))
        self.single = {c[0]: s for c, s in self.state.items() if len(c) == 1}

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def _level(self, group, n, context_n, lower, contexts, shorter, word) -> np.ndarray:
        prob = (n - DISCOUNT) / context_n
        frame = pd.DataFrame({"g": group, "p": prob, "l": lower})
        sums = frame.groupby("g", sort=False)[["p", "l"]].transform("sum")
        weight = np.log10((1 - sums["p"].to_numpy()).clip(1e-12) / (1 - sums["l"].to_numpy()).clip(1e-12)) if len(frame) else []
        for context, short, w, p, back in zip(contexts, shorter, word, prob, weight, strict=True):
            if context not in self.state:
                self.state[context] = len(self.arcs)
                self.arcs.append({})
                self.fail.append((self.state.get(short, 0), float(back)))
            self.arcs[self.state[context]][int(w)] = (math.log10(p), 0)
        return prob

    def log10(self, ids: list[int], base: list[float]) -> float:
        """Log10 probability of a text's tokens; base: their log10 smoothed unigram probabilities."""
        total, state = 0.0, 0
        arcs, fail, single = self.arcs, self.fail, self.single
        for w, low in zip(ids, base, strict=True):
            while state:
                arc = arcs[state].get(w)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                state, back = fail[state]
                total += back
            else:
                total += low
                state = single.get(w, 0)
        return total


def _let_go(df: DataFrame) -> None:
    """Gives the shuffles that led to a written table to Spark's cleaner: once a later query has run, the driver's
    garbage collection finds them unused.
    """
    df.select("block").limit(1).collect()
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame, *, mod: int = 10, least: int = LEAST, min_share: float = 0.0, word_share: float = 0.0) -> DataFrame:
    """Scores every row by a model of those whose id's crc32 is no multiple of mod.

    All words, pairs and triples are counted exactly; those of two and three words seen least times or more are arcs of
    the automaton (see Automaton), of any words and at every size. min_share and word_share, shares of all training
    tokens that n-grams and their words must have, are off unless asked for. Blocks of texts ask slices of the key space
    for the counts, then for the failure arcs' weights, of what they hold, so no task holds more than its block's states.
    The traversal is unrolled over a block's tokens: the state before each is the longest suffix that is a state, so arcs
    taken and failure arcs on the way are found for all tokens at once.
    Null and empty texts are the end token alone; rows are scored one by one, so repeated ids stay apart. Extra columns
    are ignored. No training text: all counts are 0.
    """
    blocks = in_blocks(documents, mod)
    parts = max(8, math.ceil((blocks.agg(F.sum("bytes").alias("n")).collect()[0].n or 0) / SLICE_BYTES))
    least = max(2.0, least)
    answers = stored(totals(blocks, parts, least), "totals")
    _let_go(answers)
    facts = answers.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).collect()[0]
    total, distinct = facts.n or 0, facts.v or 0
    walk = walked(blocks.select("block", "rows"), answers.select("block", "slice", "answer"), parts, total, distinct, max(least, min_share * total), max(1.0, word_share * total))
    walk = stored(walk, "walked")
    drop(blocks, answers)
    _let_go(walk)
    found = weights(walk.where("slice IS NOT NULL").select("block", "slice", "keys", "own", "p", "low"))

    def run(key, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        weight = np.concatenate([np.zeros(0), *[_unpack(a) for a in answers.sort_values("slice")["answer"]]])
        back = weight[_unpack(texts["keys"].iloc[0])]
        docs = pa.ipc.open_stream(texts["docs"].iloc[0]).read_all().to_pydict()
        failed = [math.fsum(x.tolist()) for x in np.split(back, np.cumsum(docs.pop("fails"))[:-1])]
        sure = docs.pop("sure")
        frame = pd.DataFrame({**docs, "doc_id": pd.array(docs["doc_id"], dtype="Int64"), "train_tokens": total, "score": [a + b for a, b in zip(sure, failed, strict=True)]})
        return frame[[c.split()[0] for c in OUT.split(", ")]]

    return walk.where("slice IS NULL").select("block", "keys", "docs").groupBy("block").cogroup(found.groupBy("block")).applyInPandas(run, OUT)


def op6_backoff_automaton(spark, sf_dir: str) -> DataFrame:
    """score() of documents: one row for each of theirs, null ids and texts and repeated rows too."""
    from .common import table

    return score(table(spark, sf_dir, "documents"))
