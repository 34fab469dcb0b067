"""SentencePiece encoding and decoding: a streaming Viterbi over the pieces of a model file.

The model file at hand is a BPE model, so the survivors at each position are not those of the largest score sum but
those whose neighbouring pieces BPE itself would leave apart: a piece may follow another if merging the two strings
gives exactly these two pieces. That relation makes the best path to each position unique, and equal to BPE's result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import worker_cache

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.ids = {self.pieces[i]: i for i in range(n) if not special[i]}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.raw = [b"" if model.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.longest = max(map(len, self.ids))
        self.root: dict = {}  # the pieces as a trie: a sign leads to the piece that ends there, or None, and to what goes on, or None
        for piece in sorted(self.ids):
            node = self.root
            for c in piece[:-1]:
                ends, on = node.get(c, (None, None))
                if on is None:
                    on = {}
                    node[c] = ends, on
                node = on
            node[piece[-1]] = piece, None
        # No piece has SPACE after another sign, and some white space is in no piece: all paths meet there.
        lone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.runs = re.compile(f"[{lone}]+|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+")
        self.apart: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.raw_array = pa.array(self.raw, pa.binary())
        self.packed = _Runs(self)

    def _merged(self, text: str) -> list[str]:
        """BPE of a short string: the best-ranked neighbours merge first, the leftmost of equals."""
        rank, none = self.rank, float("inf")
        parts = list(text)
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], none)
        return parts

    def _may_follow(self, left: str, right: str) -> bool:
        self.pairs += 1
        if self.pairs > 400_000:
            self.apart.clear()
            self.pairs = 0
        found = self.apart.setdefault(left, {})[right] = self._merged(left + right) == ([left, right] if left else [right])
        return found

    def _advance(self, window: str, last: list, lo: int, hi: int) -> None:
        """Takes the paths that end at positions lo to hi - 1 on over every piece that begins there.

        last has for each position the piece that ends the surviving path to it, or None; at 0 the last committed piece.
        A position has one surviving path, so what has been reached is not tried again.
        """
        root, apart, longest = self.root, self.apart, self.longest
        for at in range(lo, hi):
            left = last[at]
            if left is None:
                continue
            good, node, end = apart.get(left, {}), root, at
            for sign in window[at : at + longest]:
                piece, node = node.get(sign, (None, None))
                if piece is None and end == at:
                    piece = sign  # a sign of no piece stands for itself
                end += 1
                if piece is not None and last[end] is None:
                    fits = good.get(piece)
                    if fits is None:
                        fits = self._may_follow(left, piece)
                        good = apart[left]
                    if fits:
                        last[end] = piece
                if node is None:
                    break

    def commits(self, chunks) -> Iterator[bytes]:
        """Packed ids of a text that comes in chunks of any size, as they are settled; spaces must already be SPACE.

        What is not settled yet lies in a window (see _Window). Paths converge at the latest where a run ends, as no
        piece lies across such a place: the window begins anew there. Runs settled before come from a cache.
        """
        window, tail = _Window(self), ""
        for chunk in chunks:
            if not chunk:
                continue
            goes_on = self.runs.match(tail + chunk).end() - len(tail)
            yield window.feed(chunk[:goes_on])
            if goes_on < len(chunk):
                yield window.close()
                runs = self.runs.findall(chunk, goes_on)
                last = runs.pop()
                yield from map(self.packed.__getitem__, runs)
                window = _Window(self)
                yield window.feed(last)
            tail = chunk[-1]
        yield window.close()

    def stream(self, chunks) -> Iterator[int]:
        """The ids of commits()."""
        for packed in self.commits(chunks):
            yield from np.frombuffer(packed, np.int32).tolist()

    def _converged(self, last: list, done: int) -> int:
        """The last boundary that the surviving paths share; 0: none. Paths may end up to a piece beyond done."""
        ends = {i for i in range(done, min(len(last), done + self.longest)) if last[i]}
        while len(ends) > 1:
            top = max(ends)
            ends.discard(top)
            ends.add(top - len(last[top]))
        return min(ends.pop(), done) if ends else 0

    def _trace(self, last: list, at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def settled(self, window: str, last: list, done: int) -> bytes:
        """The packed ids of a window at the end of a run, whose positions before done are final."""
        self._advance(window, last, done, len(window))
        return self._packed(self._trace(last, len(window)))

    def _ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def _packed(self, pieces: list[str]) -> bytes:
        ids, out = self.ids, []
        for piece in pieces:
            i = ids.get(piece)
            out += [i] if i is not None else self._ids(piece)
        return array("i", out).tobytes()

    def pack(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers."""
        return b"".join(self.commits([SPACE + text.replace(" ", SPACE)])) if text else b""

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack(text), np.int32).tolist()

    def decode(self, ids) -> str:
        return _plain(b"".join(map(self.raw.__getitem__, ids)))

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        packed = [None if t is None else self.pack(t) for t in texts]
        ends = np.cumsum([0, *(len(p or b"") // 4 for p in packed)])
        offsets = pa.array(ends, pa.int32(), mask=np.array([*(p is None for p in packed), False]))
        return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32)))

    def decode_all(self, ids: pa.ListArray) -> list[str | None]:
        """The texts of many lists of ids: their pieces are gathered into one buffer and cut at the lists' ends."""
        values = ids.flatten()
        pieces = self.raw_array.take(values)
        at = np.frombuffer(pieces.buffers()[1], np.int32, len(values) + 1) if len(values) else np.zeros(1, np.int32)
        data = pieces.buffers()[2].to_pybytes() if len(values) else b""
        ends = np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())])
        valid = ids.is_valid().to_pylist()
        return [_plain(data[at[a] : at[b]]) if ok else None for a, b, ok in zip(ends, ends[1:], valid, strict=False)]


def _plain(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


class _Window:
    """The surviving paths over the text since the last commit.

    Positions before `done` are final; paths go on only from the last `longest` of them, as no piece is longer. Where
    all of these lead back to one boundary, what lies before it is settled, is committed and leaves the window.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec, self.text, self.last, self.done, self.fresh = codec, "", [""], 0, True

    def feed(self, text: str) -> bytes:
        """Takes more text; the packed ids that it settles."""
        codec, longest, out = self.codec, self.codec.longest, []
        for lo in range(0, len(text), longest):
            part = text[lo : lo + longest]
            self.text += part
            self.last += [None] * len(part)
            ready = len(self.text) - longest + 1
            if self.fresh and len(self.text) <= _Runs.LONGEST or ready <= self.done:
                continue
            codec._advance(self.text, self.last, self.done, ready)
            self.done = ready
            if ready >= 2 * longest and (at := codec._converged(self.last, ready)):
                settled = codec._trace(self.last, at)
                out.append(codec._packed(settled))
                self.text, self.last, self.done, self.fresh = self.text[at:], [settled[-1], *self.last[at + 1 :]], ready - at, False
        return b"".join(out)

    def close(self) -> bytes:
        """The packed ids of what is left, at the end of a run; what was not begun may be in the cache."""
        if not self.text:
            return b""
        return self.codec.packed[self.text] if self.fresh and not self.done else self.settle()

    def settle(self) -> bytes:
        return self.codec.settled(self.text, self.last, self.done)


class _Runs(dict):
    """Run -> its packed ids. Runs of more than LONGEST signs aren't kept, and others are forgotten once two generations of MOST runs did not use them."""

    MOST = 250_000
    LONGEST = 32

    def __init__(self, codec: Codec) -> None:
        self.codec, self.old = codec, {}

    def __missing__(self, run: str) -> bytes:
        packed = self.old.get(run)
        if packed is None and len(run) <= self.LONGEST:
            packed = self.codec.settled(run, [""] + [None] * len(run), 0)
        elif packed is None:
            window = _Window(self.codec)
            packed = window.feed(run) + window.settle()
        if len(run) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.old = {}  # freed before the copy is made
                self.old.update(self)
                self.clear()
            self[run] = packed
        return packed


def _codec(path: str, name: str) -> Codec:
    """The codec of a path that this worker can open; a worker keeps it, with what it knows, for its next tasks."""

    def opened() -> Codec:
        if os.path.exists(path):
            return Codec(path)
        from pyspark import SparkFiles

        return Codec(SparkFiles.get(name))

    return worker_cache(("codec", path), opened)


def encode(documents: DataFrame, model: str | None = None, *, text: str = "text", decoded: str | None = None) -> DataFrame:
    """documents with ids (array<int>): the pieces of each whole text. Null text: null ids; empty text: no ids.

    decoded: a further column, what decode() makes of the ids, by the same worker. Columns of these names are replaced;
    all other columns and all rows stay as they are.
    """
    path = model or default_model()
    new = ["ids"] if decoded is None else ["ids", decoded]
    kept = [c for c in documents.columns if c not in new]
    at = kept.index(text)
    rows = documents.select(*kept)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, t) for c, t in zip(new, [T.ArrayType(T.IntegerType()), T.StringType()], strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, os.path.basename(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = codec.encode_all(part.column(at).to_pylist())
                more = [] if decoded is None else [pa.array(codec.decode_all(ids), pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *more], names=[*kept, *new])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text that its ids stand for; null ids give a null text."""
    path = model or default_model()
    kept = [c for c in encoded.columns if c != out]
    at = kept.index(ids)
    rows = encoded.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, os.path.basename(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode_all(part.column(at)), pa.string())], names=[*kept, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 and lossless (the decoded text is the text) for every document."""
    from .common import table

    rows = encode(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), decoded="decoded")
    return rows.select("doc_id", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
