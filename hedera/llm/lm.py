"""LM scoring by logistic context mixing: hashed-context bit predictors, gated weights, an adaptive refinement."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered_words, mix64, slices, table, texts, written

_U = np.uint64
ORDERS, BUCKETS, LENGTHS = 5, 25, 8
#: The end of a text is the empty word. A text is coded as its words' bytes, each with a blank, which no word contains.
END = b""
#: What stands before the first word.
START = b"\0\0\0\0"


# ---------------------------------------------------------------------------------------------------------------- bits


class Bits:
    """The bits of words in their texts, most significant first, with a slot in each order's table.

    Contexts are the 1 to 4 bytes before, over words' starts too, and the whole word so far. tails: the four bytes that stand
    before each word in its text (START, where there is none), the last one lowest. heads: words of which only the first four
    bytes count; of the others only those behind them do (without heads all bytes of all words).
    """

    def __init__(self, words: list[bytes], bits: int, tails: np.ndarray | None = None, heads: np.ndarray | None = None):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.bytes = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        self.of = np.repeat(np.arange(len(words)), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(self.bytes)) - starts[self.of]
        b = self.bytes.astype(np.uint64)
        before = np.zeros_like(b)
        for d in range(1, 5):
            before[d:] |= b[:-d] << _U(8 * (d - 1))
        first = np.flatnonzero(self.at < 4)
        own = self.at[first].astype(np.uint64) * _U(8)
        tail = np.zeros(len(words), np.uint64) if tails is None else tails.astype(np.uint64)
        before[first] = (before[first] & ((_U(1) << own) - _U(1))) | ((tail[self.of[first]] << own) & _U(0xFFFFFFFF))
        contexts = [mix64((before & _U((1 << 8 * k) - 1)) | _U(k << 32)) for k in range(1, 5)]
        # The word so far: sums of byte * odd**place from the word's start, brought to place 0.
        power = np.multiply.accumulate(np.r_[_U(1), np.full(len(b), 0x9E3779B97F4A7C15 | 1, np.uint64)])
        inverse = np.multiply.accumulate(np.r_[_U(1), np.full(len(b), pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), np.uint64)])
        total = np.r_[_U(0), np.add.accumulate((b + _U(1)) * power[:-1])]
        place = np.arange(len(b)) - self.at
        contexts.append(mix64((total[:-1] - total[place]) * inverse[place] + self.at.astype(np.uint64)))
        self.contexts, self.shift = contexts, _U(64 - bits)
        if heads is not None:
            own = np.flatnonzero((self.at < 4) == heads[self.of])
            self.bytes, self.of, self.at, self.contexts = self.bytes[own], self.of[own], self.at[own], [c[own] for c in contexts]

    def __iter__(self):
        """(bits of one place in all bytes, slots of each order)"""
        whole = self.bytes.astype(np.uint64)
        for m in range(8):
            node = (_U(1 << m) | (whole >> _U(8 - m))) * _U(0xD6E8FEB86659FD93)
            yield (self.bytes >> (7 - m)) & 1, [(((c ^ node) * _U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64) for c in self.contexts]


def places(keys: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words and the four bytes before them, of keys that are one after the other."""
    return [k[4:] for k in keys], np.frombuffer(b"".join([k[:4] for k in keys]), ">u4")


def heads_of(words: list[bytes]) -> list[bytes]:
    """Of each of a text's tokens the four bytes before it and its first four.

    What comes of a token's first four bytes (with the blank, if it is shorter) depends on its head only; from then on the four
    bytes before lie within the word, and what comes depends on the word only. So equal heads are learned from and scored
    once, and so are the rests of equal words.
    """
    stream, out, at = START + b" ".join(words) + b" ", [], 0
    for n in map(len, words):
        out.append(stream[at : at + 8] if n > 3 else stream[at : at + 4 + n])
        at += n + 1
    return out


def in_order(words: list[bytes]) -> list[bytes]:
    """A text's tokens, each behind the four bytes that stand before it."""
    out, tail = [], START
    for w in words:
        key = tail + w
        out.append(key)
        tail = (key + b" ")[-4:]
    return out


def _chunks(batches, size: int = 40_000):
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            heads, keys = part.column("head").to_numpy(zero_copy_only=False), part.column("key").to_pylist()
            yield part.column("c").to_numpy().astype(np.float64), *places([k if h else START + k for h, k in zip(heads.tolist(), keys, strict=True)]), heads


def _tables(bits: int, block: int):
    """A task's counts of zeros and ones in each slot, in blocks of slots; blocks without any count are left out."""

    def run(batches):
        counts = np.zeros((ORDERS, 2 << bits), np.float32)
        for c, words, tails, heads in _chunks(batches, 100_000):
            b = Bits(words, bits, tails, heads)
            weight = c[b.of]
            for y, slots in b:
                side = y.astype(np.int64) << bits
                for k, s in enumerate(slots):
                    counts[k] += np.bincount(s + side, weight, 2 << bits)
        zeros, ones = (counts[:, own].ravel() for own in (slice(0, 1 << bits), slice(1 << bits, None)))
        for i in range(0, len(ones), block):
            z, o = zeros[i : i + block], ones[i : i + block]
            if z.any() or o.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // block]), pa.array([z.tobytes()]), pa.array([o.tobytes()])], ["block", "zeros", "ones"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    z, o = (np.sum([np.frombuffer(x, np.float32) for x in group[name].to_pylist()], axis=0, dtype=np.float64).astype(np.float32).tobytes() for name in ("zeros", "ones"))
    return pa.table({"block": group["block"].slice(0, 1), "zeros": [z], "ones": [o]})


class Model:
    """Count tables, weights by gate and refinement tables; of a fixed size for given bits."""

    gates = LENGTHS * 4

    def __init__(self, bits: int, zeros: np.ndarray, ones: np.ndarray):
        self.bits, self.zeros, self.ones = bits, zeros, ones
        # Where the longest context has seen much, it leads at first; where it hasn't, shorter ones do.
        start = np.array([[0.1, 0.2, 0.3, 0.4, 0.0], [0.0, 0.1, 0.2, 0.3, 0.4], [0.0, 0.0, 0.1, 0.3, 0.6], [0.0, 0.0, 0.0, 0.1, 0.9]])
        self.weights = np.tile(start, (LENGTHS, 1))
        self.seen = np.zeros((self.gates, BUCKETS, 2))

    def inputs(self, slots: list[np.ndarray], at: np.ndarray, own: np.ndarray | None = None, y: np.ndarray | None = None):
        """Each order's stretched prediction, and the gate: place in the word and how much the longest context has seen.

        own: occurrences of the bit itself to leave out of the counts (the bit as if it came for the first time after the rest).
        """
        x = np.empty((len(slots), len(at)))
        for k, s in enumerate(slots):
            own_slots = slice(k << self.bits, (k + 1) << self.bits)
            n0, n1 = self.zeros[own_slots].take(s), self.ones[own_slots].take(s)
            if own is not None:
                n0, n1 = np.maximum(n0 - own * (y == 0), np.float32(0)), np.maximum(n1 - own * (y == 1), np.float32(0))
            x[k] = np.log((n1 + np.float32(0.02)) / (n0 + np.float32(0.02)))
        sure = np.searchsorted([0.5, 3.5, 50.0], n0 + n1)
        return x, np.minimum(at, LENGTHS - 1) * 4 + sure

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(sum(w.take(gate) * v for w, v in zip(np.ascontiguousarray(self.weights.T), x, strict=True)), -14, 14)

    def bucket(self, t: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(t, -12, 12) + 12)).astype(np.int64)

    def probability(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one: half the mixed prediction, half what came of predictions like it."""
        t = self.mixed(x, gate)
        n = self.seen[gate, self.bucket(t)]
        p = 1 / (1 + np.exp(-t))
        refined = (n[:, 1] + p) / (n[:, 0] + n[:, 1] + 1)
        return np.clip(0.5 * p + 0.5 * refined, 1e-7, 1 - 1e-7)

    def learn(self, words: list[bytes], c: np.ndarray, rate: float, tails: np.ndarray | None = None, heads: np.ndarray | None = None) -> None:
        """One online step on a batch: weights move along the gradient, and the refinement counts what came of the predictions."""
        b = Bits(words, self.bits, tails, heads)
        weight = c[b.of]
        for y, slots in b:
            x, gate = self.inputs(slots, b.at, np.ones(len(y), np.float32), y)
            t = self.mixed(x, gate)
            error = (y - 1 / (1 + np.exp(-t))) * weight
            size = np.bincount(gate, weight, self.gates) + 1e-9
            for k in range(ORDERS):
                self.weights[:, k] += rate * np.bincount(gate, error * x[k], self.gates) / size
            place = gate * BUCKETS + self.bucket(t)
            for bit in (0, 1):
                self.seen[:, :, bit] += np.bincount(place, weight * (y == bit), self.gates * BUCKETS).reshape(self.gates, BUCKETS)

    def log10(self, words: list[bytes], tails: np.ndarray | None = None, heads: np.ndarray | None = None) -> np.ndarray:
        return Scorer(self).log10(words, tails, heads)


class Scorer:
    """What scoring needs of a model: stretched predictions by slot, how much the longest context has seen, weights, refinement."""

    def __init__(self, m: Model):
        self.bits, self.model = m.bits, Model.__new__(Model)
        self.stretched = np.log((m.ones + np.float32(0.02)) / (m.zeros + np.float32(0.02))).reshape(ORDERS, -1)
        last = slice((ORDERS - 1) << m.bits, None)
        self.sure = np.searchsorted([0.5, 3.5, 50.0], m.zeros[last] + m.ones[last]).astype(np.uint8)
        self.model.weights, self.model.seen = m.weights, m.seen

    def log10(self, words: list[bytes], tails: np.ndarray | None = None, heads: np.ndarray | None = None, size: int = 4_000) -> np.ndarray:
        """Each word's log10 where it stands: the sum over its bits, or those of its first four bytes or of the others (see Bits)."""
        total = np.zeros(len(words))
        for i in range(0, len(words), size):
            own = slice(i, i + size)
            b = Bits(words[own], self.bits, *(None if x is None else x[own] for x in (tails, heads)))
            place, sums = np.minimum(b.at, LENGTHS - 1) * 4, np.ones(len(b.at))
            for y, slots in b:
                p = self.model.probability([t.take(s) for t, s in zip(self.stretched, slots, strict=True)], place + self.sure.take(slots[-1]))
                sums *= np.where(y == 1, p, 1 - p)  # 8 bits: 1e-56 at least
            total[own] = np.bincount(b.of, np.log10(sums), len(words[own]))
        return total


def _learner(model, rate: float, batch: int):
    def run(batches):
        m, mass, words = model.value, 0.0, 0
        m = _copy(m)
        for c, ws, tails, heads in _chunks(batches, batch):
            m.learn(ws, c, rate / math.sqrt(1 + words / (20 * batch)), tails, heads)
            mass += c.sum()
            words += len(ws)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([mass]), pa.array([m.weights.tobytes()]), pa.array([m.seen.tobytes()])], ["mass", "weights", "seen"])

    return run


def _copy(m: Model) -> Model:
    new = Model(m.bits, m.zeros, m.ones)
    new.weights, new.seen = m.weights.copy(), m.seen.copy()
    return new


def fitted(counts: DataFrame, n_bytes: int, bits_most: int = 20, rate: float = 0.02, batch: int = 2_000) -> Model:
    """A model of texts from counts (head, key, c) of their tokens' heads and of their words: tables, then weights and refinement online over all.

    Each task of the second pass goes through its keys in batches, from the same start; weights are averaged by the number
    of occurrences they saw, refinement counts are added. Tables grow with the keys' bytes up to 2**bits_most slots an order.
    """
    spark = counts.sparkSession
    counts = counts.where("head or octet_length(key) > 3")
    bits = min(bits_most, max(14, math.ceil(math.log2(n_bytes + 1))))
    block = 1 << 14
    # Each task's tables are of one size, so there are a few tasks a core, however many keys.
    merged = counts.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(_tables(bits, block), "block long, zeros binary, ones binary").groupBy("block").applyInArrow(_summed, "block long, zeros binary, ones binary")
    zeros, ones = (np.zeros(ORDERS << bits, np.float32) for _ in range(2))
    # At most ORDERS * 2**bits_most slots, whatever the input.
    for r in written(merged).toLocalIterator():
        own = slice(r["block"] * block, r["block"] * block + block)
        zeros[own], ones[own] = np.frombuffer(r["zeros"], np.float32), np.frombuffer(r["ones"], np.float32)
    model = Model(bits, zeros, ones)
    shared = spark.sparkContext.broadcast(model)
    # Learning goes through the keys in an order that doesn't follow the alphabet.
    steps = counts.mapInArrow(_learner(shared, rate, batch), "mass double, weights binary, seen binary")
    # A row for each task, made at once by all and added up one by one.
    mass, weights = 0.0, np.zeros_like(model.weights)
    for r in written(steps).toLocalIterator():
        weights += r["mass"] * np.frombuffer(r["weights"]).reshape(weights.shape)
        model.seen += np.frombuffer(r["seen"]).reshape(model.seen.shape)
        mass += r["mass"]
    if mass:
        model.weights = weights / mass
    shared.unpersist()
    return model


# --------------------------------------------------------------------------------------------------------------- texts


def _counts(batches):
    """(head, key, c) of the heads and words of the texts' tokens; summed per batch of some MB."""
    for batch in slices(batches, "text", 8 << 20):
        heads, own = Counter(), Counter()
        for text in texts(batch, "text"):
            words = [*lowered_words(text), END]
            heads.update(heads_of(words))
            own.update(words)
        for head, counted in ((True, heads), (False, own)):
            items = list(counted.items())
            for i in range(0, len(items), 100_000):
                part = items[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([head] * len(part)), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["head", "key", "c"])


class _Numbers(dict):
    """Numbers of keys in the order they come; `new` has those since it was last emptied."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


def in_context(order: np.ndarray, lp: np.ndarray, cache: float = 0.3, here: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """log10 probability of a text's tokens, and counts of tokens.

    order: the token at each place, numbered from 0; here: the model's log10 at each place (lp: for each token,
    if it is the same everywhere). Two predictors are mixed: the model, and the model with the text so far (a token's share of the places before) at a weight of
    cache. Their log odds are the sum of what they gained on the text so far, so the mixture adapts to texts that repeat
    themselves.
    """
    n = len(order)
    by = np.argsort(order, kind="stable")
    counts = np.bincount(order, minlength=0 if lp is None else len(lp))
    r = np.empty(n)
    r[by] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    p = lp[order] if here is None else here
    # The share of the text so far, relative to the model's probability.
    ratio = r / np.maximum(np.arange(n), 1) / 10.0**p
    ratio = np.where(np.arange(n) > 0, (1 - cache) + cache * ratio, 1.0)
    odds = np.r_[0.0, np.cumsum(np.log(ratio))[:-1]] * 0.1
    weight = 1 / (1 + np.exp(-np.clip(odds, -4, 4)))
    return float((np.log10((1 - weight) + weight * ratio) + p).sum()), counts


def _rare(frequent):
    """A text's distinct words that aren't frequent, each with how often it occurs there."""

    def run(batches):
        known = frequent.value
        for batch in batches:
            times, words, rows = [], [], []
            for text in texts(batch, "text"):
                before = len(words)
                for w, k in Counter([*lowered_words(text), END]).items():
                    if w not in known:
                        times.append(k)
                        words.append(w)
                rows.append(len(words) - before)
            ids = np.repeat(batch.column("doc").to_numpy(), rows)
            for i in range(0, len(words), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(times[s], pa.int32()), pa.array(words[s], pa.binary())], ["doc", "k", "word"])

    return run


def _scores(scorer, frequent, keep: list[str], most: int = 400_000):
    """Each text's score, and what its frequent words add to the sums of the base."""

    def run(batches):
        known, model = frequent.value, scorer.value
        heads, own = _Numbers(), _Numbers()
        of_heads, of_rests, c = (np.zeros(0) for _ in range(3))
        for batch in slices(batches, "text", 4 << 20):
            # Equal heads and equal words have the same scores: those of the texts before are kept.
            if len(heads) + len(own) > most:
                heads, own = _Numbers(), _Numbers()
                of_heads, of_rests, c = (np.zeros(0) for _ in range(3))
            out, rows = [], []
            for text in texts(batch, "text"):
                words = [*lowered_words(text), END]
                rows.append([np.fromiter(map(number.__getitem__, part), np.int64, len(words)) for number, part in ((heads, heads_of(words)), (own, words))])
            of_heads = np.r_[of_heads, model.log10(*places(heads.new), np.ones(len(heads.new), bool))]
            of_rests = np.r_[of_rests, model.log10(own.new, None, np.zeros(len(own.new), bool))]
            c = np.r_[c, np.array([known.get(w, 0) for w in own.new], np.float64)]
            heads.new, own.new = [], []
            for h, w in rows:
                found, order = np.unique(w, return_inverse=True)
                score, k = in_context(order, None, here=of_heads[h] + of_rests[w])
                times = c[found]
                out.append((len(w), int(k[times > 0].sum()), float(k @ np.log10(times + 1)), score))
            n_tokens, n_known, base, score = zip(*out, strict=True) if out else ((), (), (), ())
            sums = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), *sums], [*keep, "n_tokens", "k0", "b0", "score"])

    return run


def scored(docs: DataFrame, frequent_most: int = 1 << 17, frequent_bytes: int = 64, bits_most: int = 20) -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    docs: doc_id, text and a boolean held_out; other columns are ignored. Texts are lower-cased in A-Z and split at ASCII
    white space; each has one end token. base_score is the add-one unigram log10 probability under the counts of texts that
    are not held out. score is the log10 probability under the mixing model: a text's bytes (its words, each with a blank)
    are predicted in order, bit by bit, from five hashed contexts, the 1 to 4 bytes before (over words' starts too) and the
    word so far. Their log odds are combined with weights gated by place and confidence and refined by what came of such
    predictions; a word's probability is then mixed with the text so far at a weight that adapts. bits_per_byte is that in
    bits over the UTF-8 bytes of the text, at least one. Null and empty texts have the end token only. Rows that are equal
    in doc_id and text have equal results; an empty table gives an empty result. Without training texts all counts are 0.

    What comes of a word's first four bytes depends on them and the four before, what comes of the others on the word, so
    counts of heads and of words hold all that tables and weights are learned from, and a task scores equal ones once. For the base, up to frequent_most words of highest count and at most
    frequent_bytes bytes travel to the tasks (some MB, whatever the input); the others meet their counts in a join, where
    none is hot: all have less than 1/frequent_most of the tokens, but for overlong ones. Texts are not moved.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.xxhash64("doc_id", "text").alias("doc"))
    counts = written(docs.where("not held_out").select("text").mapInArrow(_counts, "head boolean, key binary, c long").groupBy("head", "key").agg(F.sum("c").alias("c")))
    words = counts.where("not head").select(F.col("key").alias("word"), "c")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    size = F.octet_length("key")
    n_bytes = counts.agg(F.coalesce(F.sum(F.when(F.col("head"), F.least(size - 3, F.lit(4))).otherwise(F.greatest(size - 3, F.lit(0)))), F.lit(0))).first()[0]
    scorer = spark.sparkContext.broadcast(Scorer(fitted(counts, n_bytes, bits_most)))
    top = words.where(F.octet_length("word") <= frequent_bytes).orderBy(F.desc("c"), "word").limit(frequent_most)
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): r["c"] for r in top.toLocalIterator()})

    rare = docs.select("doc", "text").mapInArrow(_rare(frequent), "doc long, k int, word binary")
    # Rows that are equal in doc_id and text give the same lines again: one of each is kept.
    rare = rare.groupBy("doc", "word").agg(F.first("k").alias("k")).join(words, "word")
    rare = rare.groupBy("doc").agg(F.sum("k").alias("k1"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("b1"))
    whole = docs.select("doc_id", "held_out", "doc", "text", F.greatest(F.octet_length("text"), F.lit(1)).alias("size"))
    keep = ["doc_id", "held_out", "doc", "size"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, doc long, size int, n_tokens long, k0 long, b0 double, score double"
    out = whole.mapInArrow(_scores(scorer, frequent, keep), schema).join(rare, "doc", "left")
    bits = -F.col("score") * math.log2(10) / F.coalesce("size", F.lit(1))
    known = F.col("k0") + F.coalesce("k1", F.lit(0))
    base = F.col("b0") + F.coalesce("b1", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out")))
