"""SentencePiece encoding and decoding in numpy: Viterbi over words of equal length at once."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mix64, table

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
SPACE = "▁"
#: Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message: integers, or bytes for strings, messages and fixed 32-bit values."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = (4, i) if tag & 7 == 5 else (8, i) if tag & 7 == 1 else varint(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Vocabulary:
    """A SentencePiece model file: pieces, scores, kinds, and what its normalizer does. Character maps and user-defined pieces aren't supported."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.model, self.fallback, self.prefix = UNIGRAM, False, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                self.model, self.fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                self.prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("models that map characters, trim white space or don't escape blanks are not supported")
        if self.model not in (UNIGRAM, BPE) or any(k in (4, 5) for k in self.kinds):
            raise ValueError("only Unigram and BPE models without user-defined or unused pieces are supported")
        self.unknown = self.kinds.index(UNKNOWN)


class Encoder:
    """Encodes and decodes with a vocabulary.

    A text's units (a blank or blanks and what follows) are independent, as no piece goes over a unit's end; this is checked.
    Units of equal length advance together: at each place, hashes of the substrings that end there are looked up in the
    sorted hashes of the pieces, and the best is kept as a back-pointer. For a Unigram model the best has the largest sum of
    scores. For a BPE model, whose scores are merge ranks and not probabilities, it is the last piece of the prefix's BPE
    encoding: the one piece that fits the last piece of the encoding before it. Two pieces fit if no merge over their border
    would have come before the merges that made them.
    """

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        own = [i for i, k in enumerate(v.kinds) if k == NORMAL]
        if any(re.search(f"[^{SPACE}]{SPACE}", v.pieces[i]) or "\n" in v.pieces[i] for i in own):
            raise ValueError("a piece goes over the end of a word")
        self.longest = max(len(v.pieces[i]) for i in own)
        keys = np.array([self._key(v.pieces[i]) for i in own], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(own)[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces have one hash")
        self.key_of = np.zeros(len(v.pieces), np.uint64)
        self.key_of[self.ids] = self.keys
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(mix64(self.keys) >> _U(44)).astype(np.int64)] = True
        self.powers = np.multiply.accumulate(np.r_[_U(1), np.full(self.longest + 1, _BASE)])
        self.size = np.array([len(p) for p in v.pieces])
        self.score = np.array(v.scores)
        self.bytes_of = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == BYTE}
        if v.model == BPE:
            self._merges(own)
        self.unit = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.kept: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)
        text = [b"" if k in (CONTROL,) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        text[v.unknown] = b" \xe2\x81\x87 "
        self.text = text

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def _merges(self, own: list[int]) -> None:
        """Each piece's merge order and the two pieces that BPE makes it of; -1 for characters. Pieces that BPE never makes take no part."""
        v = self.v
        rank = {v.pieces[i]: r for r, i in enumerate(sorted(own, key=lambda i: (-v.scores[i], i)))}
        number = {v.pieces[i]: i for i in own}
        self.rank = np.full(len(v.pieces), -1)
        self.left, self.right = np.full(len(v.pieces), -1), np.full(len(v.pieces), -1)
        self.made = np.zeros(len(v.pieces), bool)
        self.order = np.full(len(v.pieces), np.iinfo(np.int64).max)
        for p, i in number.items():
            self.order[i] = rank[p]
            parts, last = list(p), None
            while len(parts) > 1:
                best = min(((rank.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=None)
                if best[0] == 1 << 60:
                    break
                k = best[1]
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.made[i] = len(parts) == 1 and (last is None or (last[0] in number and last[1] in number))
            if self.made[i] and last:
                self.rank[i], self.left[i], self.right[i] = rank[p], number[last[0]], number[last[1]]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(len(keys), -1)
        some = np.flatnonzero(self.maybe[(mix64(keys) >> _U(44)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            hit = self.keys[at] == keys[some]
            out[some[hit]] = self.ids[at[hit]]
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves piece a before piece b: going back in time, no merge over the border is due before the next one inside."""
        out = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            joint = self._find(self.key_of[a[live]] * self.powers[np.minimum(self.size[b[live]], self.longest + 1)] + self.key_of[b[live]])
            due = (joint >= 0) & (self.order[joint] < limit[live])
            out[live[due]] = False
            live = live[~due]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            more = (ra >= 0) | (rb >= 0)
            live, ra, rb = live[more], ra[more], rb[more]
            first = ra > rb
            limit[live] = np.where(first, ra, rb + 1)
            x, y = live[first], live[~first]
            a[x], b[y] = self.right[a[x]], self.left[b[y]]
        return out

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: code points, a row a unit. The pieces of all rows, one after the other, and how many each row has; an unknown character c is -2 - c."""
        rows, n = codes.shape
        h = np.zeros((n + 1, rows), np.uint64)
        for i in range(n):
            h[i + 1] = h[i] * _BASE + codes[:, i].astype(np.uint64) + _U(1)
        last = np.full((n + 1, rows), -1)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        bpe, lowest = self.v.model == BPE, self.score[self.ids].min() - 10
        for j in range(1, n + 1):
            for size in range(1, min(j, self.longest) + 1):
                found = self._find(h[j] - h[j - size] * self.powers[size])
                r = np.flatnonzero(found >= 0)
                if bpe and len(r):
                    r = r[self.made[found[r]]]
                    before = last[j - size, r]
                    known = before >= 0
                    ok = np.ones(len(r), bool)
                    ok[known] = self._fit(before[known], found[r[known]])
                    value = np.where(ok, float(size), -np.inf)
                else:
                    value = best[j - size, r] + self.score[found[r]]
                up = value > best[j, r]
                best[j, r[up]], last[j, r[up]] = value[up], found[r[up]]
            none = np.flatnonzero(last[j] == -1)
            if not bpe:
                alone = best[j - 1] + lowest
                none = np.flatnonzero((last[j] == -1) | (alone > best[j]))
                best[j, none] = alone[none]
            last[j, none] = -2 - codes[none, j - 1]
        out = np.full((rows, n), np.iinfo(np.int64).min)
        at, live, step = np.full(rows, n), np.arange(rows), n
        while len(live):
            step -= 1
            t = last[at[live], live]
            out[live, step] = t
            at[live] -= np.where(t >= 0, self.size[np.maximum(t, 0)], 1)
            live = live[at[live] > 0]
        mask = out != np.iinfo(np.int64).min
        return out[mask], mask.sum(axis=1)

    def _expanded(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as byte pieces, or as the unknown piece."""
        bad = np.flatnonzero(tokens < 0)
        if not len(bad):
            return tokens, counts
        row = np.repeat(np.arange(len(counts)), counts)
        spelled = {c: ([self.bytes_of[f"<0x{b:02X}>"] for b in chr(-2 - c).encode("utf-8", "surrogatepass")] if self.v.fallback else [self.v.unknown]) for c in set(tokens[bad].tolist())}
        width = np.ones(len(tokens), np.int64)
        width[bad] = [len(spelled[c]) for c in tokens[bad].tolist()]
        out = np.repeat(tokens, width)
        starts = np.cumsum(width) - width
        for i in bad.tolist():
            out[starts[i] : starts[i] + width[i]] = spelled[int(tokens[i])]
        return out, np.bincount(row, width, len(counts)).astype(np.int64)

    def _learn(self, units: list[str], batch: int = 4096) -> None:
        """Encodes new units and keeps them."""
        by_size: dict[int, list[str]] = {}
        for u in units:
            by_size.setdefault(len(u), []).append(u)
        flat, counts = [self.flat], [np.diff(self.starts)]
        for n, us in by_size.items():
            rows = max(1, min(batch, 2_000_000 // n))
            for i in range(0, len(us), rows):
                part = us[i : i + rows]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n).astype(np.int64)
                tokens, c = self._expanded(*self._viterbi(codes))
                flat.append(tokens.astype(np.int32))
                counts.append(c)
                for u in part:
                    self.kept[u] = len(self.kept)
        self.flat = np.concatenate(flat)
        self.starts = np.r_[0, np.cumsum(np.concatenate(counts))]

    def units(self, text: str | None) -> list[str]:
        return self.unit.findall((SPACE if self.v.prefix else "") + text.replace(" ", SPACE)) if text else []

    def prepare(self, texts, most_kept: int = 300_000) -> None:
        """Encodes the units of texts that aren't kept yet, all at once: the more there are, the longer the vectors."""
        if len(self.kept) > most_kept:
            self.kept, self.flat, self.starts = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        new: set[str] = set()
        for t in texts:
            new.update(self.units(t))
        self._learn(sorted(new.difference(self.kept)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        units, sizes = [], []
        for t in texts:
            got = self.units(t)
            units += got
            sizes.append(len(got))
        if new := set(units).difference(self.kept):
            self._learn(sorted(new))
        u = np.fromiter(map(self.kept.__getitem__, units), np.int64, len(units))
        counts = self.starts[u + 1] - self.starts[u]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[u] - (ends - counts), counts)
        of_unit = np.r_[0, ends][np.cumsum(sizes)] if sizes else np.empty(0, np.int64)
        return self.flat[at], np.diff(of_unit, prepend=0)

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        if ids is None:
            return None
        out = b"".join(map(self.text.__getitem__, ids))
        return out[1 if self.v.prefix and out[:1] == b" " else 0 :].decode("utf-8", "replace")


_made: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder a Python worker."""
    key = hash(data)
    if key not in _made:
        _made[key] = Encoder(Vocabulary(data))
    return _made[key]


def _encode(shared, keep: list[str], column: str, rows: int):
    def run(batches):
        e = _encoder(shared.value)
        for batch in batches:
            e.prepare(t.as_py() for t in batch.column(column))
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                ids, counts = e.encode(part.column(column).to_pylist())
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*keep, "ids"])

    return run


def _decode(shared, keep: list[str], column: str, to: str):
    def run(batches):
        e = _encoder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = [e.decode(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(text, pa.string())], [*keep, to])

    return run


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), more])


def model_bytes(path: str | None = None) -> bytes:
    """A model file; by default the installed public BPE vocabulary of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes, column: str = "text", rows: int = 256) -> DataFrame:
    """docs with ids, an array of int, in place of a column of that name; the other columns stay.

    Null and empty texts have no ids. Rows are encoded each on its own; an empty table gives an empty result. model is read
    on the driver and travels to the tasks; it has a fixed size.
    """
    keep = [c for c in docs.columns if c != "ids"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(lean(_encode(shared, keep, column, rows)), _schema(docs, keep, "ids array<int>"))


def decoded(docs: DataFrame, model: bytes, column: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the text of ids, null for null, in place of a column of that name; the other columns stay."""
    keep = [c for c in docs.columns if c != to]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(lean(_decode(shared, keep, column, to)), _schema(docs, keep, f"`{to}` string"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes()
    out = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    # A text's own U+2581 is a blank to SentencePiece.
    same = out["decoded"] == F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))
