"""Jaccard self-join on word shingles: prefix filters under several global orders, intersected before verification."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, lean, lowered_words, mix64, slices, table, texts, written

_U = np.uint64


class _Words(dict):
    """64-bit hashes of words, kept until there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def sets_of(found: list[bytes | None], size: int, known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, one text after the other, and where each text's begin and end.

    A text of fewer words than size is one shingle, an empty one none.
    """
    words = [lowered_words(t) for t in found]
    count = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(count.sum()))
    width = np.minimum(count, size)
    made = np.where(count > 0, count - width + 1, 0)
    of = np.repeat(np.arange(len(words)), made)
    place = np.arange(len(of)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(np.cumsum(count) - count, made)
    total = width[of].astype(np.uint64)
    short = (width < size)[of]
    for i in range(size):
        longer = mix64(total * _U(0x9E3779B97F4A7C15) + h[np.minimum(place + i, len(h) - 1)])
        total = np.where(short & (width[of] <= i), total, longer) if short.any() else longer
    starts = np.r_[0, np.cumsum(made)]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        total[a:b].sort()
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    return total[new], np.r_[0, np.cumsum(np.bincount(of[new], minlength=len(words)))].astype(np.int64)


def _signatures(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each set; the first hash is the set's id."""
    n = np.diff(ends)
    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        a[some] = np.add.reduceat(mix64(values + _U(1)), ends[:-1][some])
        b[some] = np.bitwise_xor.reduceat(mix64(values ^ _U(0x5851F42D4C957F2D)), ends[:-1][some])
    return n, a.view(np.int64), b.view(np.int64)


def needed(n, percent: int):
    """The least intersection of a set of n with any set that it links to."""
    return -(-n * percent // 100)


def _keys(tokens: np.ndarray, heat: np.ndarray, which: int) -> np.ndarray:
    """By these, tokens stand in a global order: rare ones before common ones, and within that by a hash that differs by order.

    The first order goes by fine classes of counts; the others by coarse ones, which put only very common tokens last.
    """
    return (heat[min(which, 1)].astype(np.uint64) << _U(56)) | (mix64(tokens ^ _U(0xA5A5A5A5 * (which + 1))) >> _U(8))


def _least(keys: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(keys, k - 1)[:k] if k < len(keys) else np.arange(len(keys))


class Heats:
    """How common tokens are, by bucket, in classes: fine, coarse, and the logarithm of the parts into which a token's sets are dealt."""

    def __init__(self, counts: np.ndarray, bits: int, quota: int):
        mean = max(1.0, float(counts.mean()))
        fine = np.clip(np.rint(24 * np.log2((counts + 1) / (mean + 1)) + 128), 0, 255)
        coarse = np.clip(np.floor(np.log2(np.maximum(counts / (4 * mean + 16), 0.5))) + 1, 0, 255)
        parts = np.ceil(np.log2(np.maximum(counts / max(quota, 8 * mean), 1)))
        self.classes, self.bits = np.stack([fine, coarse, parts]).astype(np.uint8), bits

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.classes[:, (tokens >> _U(64 - self.bits)).astype(np.int64)]


# ----------------------------------------------------------------------------------------------------- scans of all texts


def _scan(size: int, bits: int):
    """Rows of documents (doc_id, row, size and two hashes of the set) and, per task, packed counts of shingles by bucket, in blocks."""
    names = ["doc_id", "row", "n", "id", "b", "packed"]

    def run(batches):
        known, counts = _Words(), np.zeros(1 << bits, np.uint32)
        for batch in slices(batches, "text"):
            values, ends = sets_of(texts(batch, "text"), size, known)
            np.add.at(counts, (values >> _U(64 - bits)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *map(pa.array, _signatures(values, ends)), pa.nulls(batch.num_rows, pa.binary())], names)
        part = TaskContext.get().partitionId() % 64
        for i in range(0, len(counts), 65536):
            if (block := counts[i : i + 65536]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // 65536]), pa.array([part]), *[pa.array([0])] * 3, pa.array([_packed(block)])], names)

    return run


def _packed(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max()))
    return kind.char.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.dtype(data[:1].decode()))


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros(65536, np.uint64)
    for x in group["packed"].to_pylist():
        total += _unpacked(x)
    return pa.table({"doc_id": group["doc_id"].slice(0, 1), "row": group["row"].slice(0, 1), "packed": [_packed(total)]})


class _Once:
    """Which sets a task sees for the first time, as far as it remembers."""

    def __init__(self):
        self.seen: set = set()

    def new(self, *keys: np.ndarray) -> np.ndarray:
        out = []
        for i, key in enumerate(zip(*(k.tolist() for k in keys), strict=True)):
            if key[0] and key not in self.seen:
                if len(self.seen) > 50_000:
                    self.seen.clear()
                self.seen.add(key)
                out.append(i)
        return np.array(out, np.int64)


def _prefixes(size: int, percent: int, shared):
    """A row for each prefix token under the first order: token, salt (0, or for tokens with very many sets 1 and the part that
    the set is dealt to), set (n, id), and how common its tokens are on average. Sets that a task has just seen aren't repeated."""

    def run(batches):
        known, heats, once = _Words(), shared.value, _Once()
        for batch in slices(batches, "text"):
            values, ends = sets_of(texts(batch, "text"), size, known)
            n, ids, b = _signatures(values, ends)
            heat = heats.of(values)
            keys = _keys(values, heat, 0)
            length = n - needed(n, percent) + 1
            own = once.new(n, ids, b)
            if not len(own):
                continue
            take = np.concatenate([ends[i] + _least(keys[ends[i] : ends[i + 1]], int(length[i])) for i in own.tolist()])
            of = np.repeat(own, length[own])
            total = np.r_[0, np.cumsum(heat[0], dtype=np.int64)]
            hot = 100 * (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1)
            tokens, parts = values[take], heat[2][take].astype(np.uint64)
            salt = np.where(parts > 0, 1 + (mix64(ids[of].view(np.uint64) ^ tokens) & ((_U(1) << parts) - _U(1))), 0)
            cols = [tokens.view(np.int64), salt.astype(np.int32), n[of].astype(np.int32), ids[of], hot[of].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["token", "salt", "n", "id", "hot"])

    return run


#: Bits of the map by which documents whose sets are needed are found without a shuffle of texts: 2 MB, whatever the input.
_MAP = 24


def _slots(rows: np.ndarray) -> np.ndarray:
    return (mix64(rows.view(np.uint64)) >> _U(64 - _MAP)).astype(np.int64)


def _mapped(rows: DataFrame) -> np.ndarray:
    """A bit for each slot that some row has."""

    def run(batches):
        bits = np.zeros(1 << _MAP, bool)
        for batch in batches:
            bits[_slots(batch.column("row").to_numpy())] = True
        packed = np.packbits(bits).reshape(-1, 1 << 15)
        for i in np.flatnonzero(packed.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([zlib.compress(packed[i].tobytes(), 1)])], ["at", "bits"])

    def merged(group: pa.Table) -> pa.Table:
        one = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in group["bits"].to_pylist()])
        return pa.table({"at": group["at"].slice(0, 1), "bits": [zlib.compress(one.tobytes(), 1)]})

    out = np.zeros((1 << _MAP) >> 3, np.uint8)
    schema = "at long, bits binary"
    for r in rows.select("row").mapInArrow(run, schema).groupBy("at").applyInArrow(merged, schema).toLocalIterator():
        out[r["at"] << 15 : (r["at"] + 1) << 15] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _wanted(batches, size: int, marked):
    """(values, ends, sizes, ids) of new sets of the documents whose slot is marked."""
    known, bits, once = _Words(), marked.value, _Once()
    for batch in slices(batches, "text"):
        at = _slots(batch.column("row").to_numpy())
        take = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
        if len(take):
            values, ends = sets_of(texts(batch.take(pa.array(take)), "text"), size, known)
            n, ids, b = _signatures(values, ends)
            own = once.new(n, ids, b)
            if len(own):
                parts = [values[ends[i] : ends[i + 1]] for i in own.tolist()]
                yield parts, n[own], ids[own]


def _sets(size: int, marked):
    def run(batches):
        for parts, n, ids in _wanted(batches, size, marked):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(parts).view(np.int64)))], ["id", "n", "s"])

    return run


# ---------------------------------------------------------------------------------------------------------------- sketches


def _lengths(n, percent: int):
    """Under the orders but the first, prefixes are longer, so that sets that link share several tokens of them."""
    return np.minimum(n, n - needed(n, percent) + np.maximum(1, n // 10))


def _width(n):
    """A power of two of at least n, and of at least 64."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def parity(tokens: np.ndarray, width: int) -> np.ndarray:
    """For each class of tokens modulo width whether it has an odd number of them, as bits.

    Two sets' bits differ in at most as many places as there are tokens in one set only, and mostly in nearly as many.
    """
    odd = np.bincount((tokens & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sketches(size: int, percent: int, orders: int, shared, marked):
    """For each wanted set the parities of its prefix under every order but the first, and those of the whole set."""

    def run(batches):
        heats = shared.value
        for parts, n, ids in _wanted(batches, size, marked):
            out = []
            for s in parts:
                heat, k = heats.of(s), int(_lengths(len(s), percent))
                some = [parity(s[_least(_keys(s, heat, j), k)], int(_width(4 * k))) for j in range(1, orders)]
                out.append(np.concatenate([*some, parity(s, int(_width(2 * len(s))))]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(out, pa.binary())], ["id", "n", "sketch"])

    return run


def _differences(bits: list[np.ndarray], left: np.ndarray, right: np.ndarray, may: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """In how many places the bits of left and right rows differ, for pairs in `may`; longer bits are folded to the length of shorter ones."""
    words = np.array([len(x) for x in bits], np.int64)
    out = np.zeros(may.shape, np.int64)
    common = np.minimum(words[left][:, None], words[right][None, :])
    for w in np.unique(common[may]).tolist():
        folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, w), axis=0) if len(x) >= w else np.zeros(w, np.uint64) for x in bits])
        i, j = np.nonzero(may & (common == w))
        for k in range(0, len(i), max(1, chunk // w)):
            a, b = i[k : k + max(1, chunk // w)], j[k : k + max(1, chunk // w)]
            out[a, b] = np.bitwise_count(folded[left[a]] ^ folded[right[b]]).sum(axis=1, dtype=np.int64)
    return out


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(pc.list_flatten(column).to_numpy(), ends[:-1]) if len(ends) else []


def _common(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many tokens each left list shares with each right list, as products of 0-1 matrices over the tokens that two lists have."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, place, counts = np.unique(np.concatenate(lists) if lists else np.empty(0, np.int64), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    often = counts[place] > 1
    rows, place = rows[often], number[place[often]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    for start in range(0, int((counts > 1).sum()), columns):
        lo, hi = np.searchsorted(place, [start, start + columns])
        m = np.zeros((len(lists), columns), np.float32)
        m[rows[lo:hi], place[lo:hi] - start] = 1
        out += m[left] @ m[right].T
    return out


def _open(block: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right rows of a block (both, where is_left is null), which pairs of them a link may join (other components, sizes that allow it), and sizes."""
    comp, ids, n = (block[c].to_numpy(zero_copy_only=False) for c in ("comp", "id", "n"))
    left, right = (np.flatnonzero(block["is_left"].fill_null(side).to_numpy(zero_copy_only=False) == side) for side in (True, False))
    a, b = n[left][:, None], n[right][None, :]
    may = (comp[left][:, None] != comp[right][None, :]) & (ids[left][:, None] != ids[right][None, :])
    return left, right, may & (100 * b >= percent * a) & (100 * a >= percent * b), n


def _parts(may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each left and right row of a block the part it is in (rows that pairs in `may` connect), and -1 outside of pairs."""
    left = np.where(may.any(axis=1), np.arange(len(may)), -1)
    none = len(may)
    while True:
        right = np.where(may, left[:, None], none).min(axis=0, initial=none)
        new = np.where(may, right[None, :], none).min(axis=1, initial=none)
        new[left < 0] = -1
        if (new == left).all():
            return left, np.where(right == none, -1, right)
        left = new


def possible(n: np.ndarray, sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray, may: np.ndarray, percent: int, orders: int) -> np.ndarray:
    """Pairs in `may` whose prefixes may share enough tokens under every order but the first, and whose sets may differ in few enough.

    Sets of sizes n and m that link have a = ceil(percent * (n + m) / (100 + percent)) tokens in common; at most n - p tokens
    of the first are outside of its prefix of p tokens, so prefixes of p and q share a + min(p - n, q - m) at least, and at
    most p + q less twice that are in one prefix only. No pair that links is left out.
    """
    p = _lengths(n, percent)
    need = -(-percent * (n[left][:, None] + n[right][None, :]) // (100 + percent))
    least = np.minimum((p - n)[left][:, None], (p - n)[right][None, :]) + need
    short, whole = _width(4 * p) // 64, _width(2 * n) // 64
    for j in range(orders):
        if not may.any():
            return may
        if j < orders - 1:
            bits, most = [s[j * k : (j + 1) * k] for s, k in zip(sketches, short.tolist(), strict=True)], p[left][:, None] + p[right][None, :] - 2 * least
        else:
            bits, most = [s[len(s) - k :] for s, k in zip(sketches, whole.tolist(), strict=True)], n[left][:, None] + n[right][None, :] - 2 * need
        may = may & (_differences(bits, left, right, may) <= most)
    return may


def _survivors(percent: int, orders: int):
    """Sets of a block with another of it that every filter lets pass, as smaller blocks: each part of the block that such pairs
    connect is one, (blk, id, is_left, comp), and blk is a hash of what it holds. Parts of several blocks with the same sets
    are thus the same rows, and are compared once. (Sides swap so that the smaller hash is left.)"""

    def run(block: pa.Table) -> pa.Table:
        ids, comp = block["id"].to_numpy(), block["comp"].to_numpy()
        left, right, may, n = _open(block, percent)
        sketches = [np.frombuffer(x, np.uint64) for x in block["sketch"].to_pylist()]
        may = possible(n, sketches, left, right, may, percent, orders)
        of_left, of_right = _parts(may)
        rows = np.concatenate([left[of_left >= 0], right[of_right >= 0]]).astype(np.int64)
        part = np.concatenate([of_left[of_left >= 0], of_right[of_right >= 0]])
        is_left = np.arange(len(rows)) < (of_left >= 0).sum()
        hashes = np.zeros((2, len(left)), np.uint64)
        np.add.at(hashes, ((~is_left).astype(np.int64), part), mix64(ids[rows].view(np.uint64) + _U(1)))
        swap = hashes[1] < hashes[0]
        blk = mix64(hashes.min(axis=0) + mix64(hashes.max(axis=0))) if len(left) else np.empty(0, np.uint64)
        cols = [pa.array(blk[part].view(np.int64)), pa.array(ids[rows], pa.int64()), pa.array(is_left ^ swap[part]), pa.array(comp[rows], pa.int64())]
        return pa.table(cols, ["blk", "id", "is_left", "comp"])

    return run


def _verifier(percent: int):
    """Links between the left and the right sets of a block that are in different components so far: one for each left set and right component."""

    def run(block: pa.Table) -> pa.Table:
        ids, comp = block["id"].to_numpy(), block["comp"].to_numpy()
        left, right, may, n = _open(block, percent)
        both = _common(_lists(block["s"]), left, right).astype(np.int64) if may.any() else np.zeros(may.shape, np.int64)
        i, j = np.nonzero(may & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)))
        _, first = np.unique(np.stack([i, comp[right][j]]), axis=1, return_index=True) if len(i) else (None, np.empty(0, np.int64))
        return pa.table({"u": pa.array(ids[left][i[first]], pa.int64()), "v": pa.array(ids[right][j[first]], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of links (u, v): comp is the smallest id reachable. Labels move to the smallest neighbour and jump to their label's label until none changes."""
    edges = written(links.select("u", "v").union(links.select("v", "u")).distinct())
    label = written(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("comp")))
    while True:
        near = edges.join(label.select(F.col("id").alias("v"), "comp"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("other"))
        step = label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "other").alias("comp"))
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("over"))
        new = written(step.join(jump, "comp", "left").select("id", "was", F.least("comp", F.coalesce("over", "comp")).alias("comp")))
        changed = new.where("was <> comp").limit(1).count()
        dropped(label)
        label = new.select("id", "comp")
        if not changed:
            dropped(edges)
            return label


def _merged(parts: DataFrame, most: int) -> DataFrame:
    """Blocks (blk, id, is_left, comp) that share sets, directly or over others, as one block without sides if it has at most
    `most` sets: each of them is then fetched once, not once a block. Larger ones stay as they are."""
    first = parts.groupBy("blk").agg(F.min("id").alias("u"))
    group = components(parts.join(first, "blk").select("u", F.col("id").alias("v")).where("u <> v")).withColumnRenamed("comp", "group")
    small = group.groupBy("group").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") <= most)
    dealt = written(parts.join(group.join(small, "group"), "id", "left"))
    one = dealt.where("held is not null").select(F.xxhash64("group").alias("blk"), "id", F.lit(None).cast("boolean").alias("is_left"), "comp").distinct()
    return one.union(dealt.where("held is null").select("blk", "id", "is_left", "comp"))


def _buckets(pre: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of prefix rows: (token, id, hub, of, salted), the sets that share a token with others, and (id, hub) pairs to compare first.

    One shuffle by token serves all of it. Buckets break where sizes do: sets of sizes too far apart can't link. Each bucket
    has as its hub the set with the most common tokens. Near copies share many tokens; buckets that hold the same sets
    ask the same questions, so they are named by what they hold and their rows kept once (buckets whose names clash are
    one bucket: more is compared, nothing lost). Tokens with very many sets are dealt in parts by the salt; each part has
    a hub, and the parts' hubs meet the token's.
    """
    pre = pre.repartition("token", "salt").groupBy("token", "salt", "n", "id").agg(F.max("hot").alias("hot"))
    by_size = Window.partitionBy("token", "salt").orderBy("n", "id")
    apart = F.coalesce(F.lag("n").over(by_size) * 100 < F.col("n") * percent, F.lit(True))
    pre = pre.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    at = Window.partitionBy("token", "salt", "run")
    held = pre.withColumn("most", F.max(F.struct("hot", "id")).over(at)).withColumn("of", F.count(F.lit(1)).over(at))
    salted = F.col("salt") > 0
    held = held.withColumn("what", F.bit_xor(F.xxhash64("id")).over(at)).where((F.col("of") > 1) | salted)
    bucket = F.when(salted, F.xxhash64("token")).otherwise(F.xxhash64("what", "of"))
    held = written(held.select(bucket.alias("token"), "id", F.col("most.id").alias("hub"), F.col("most.hot").alias("hot"), F.col("of").cast("int").alias("of"), salted.alias("salted")).distinct())
    tops = held.where("salted").select("token", "hub", "hot").distinct()
    top = tops.groupBy("token").agg(F.max(F.struct("hot", "hub")).alias("top"))
    pairs = held.select("id", "hub").union(tops.join(top, "token").select(F.col("hub").alias("id"), F.col("top.hub").alias("hub")))
    return held, written(pairs.where("id <> hub").distinct())


def classes(docs: DataFrame, size: int = 5, percent: int = 80, orders: int = 3, bits: int = 22, block: int = 256, quota: int = 512) -> DataFrame:
    """A row per document: doc_id, row (a hash of doc_id and text), n_shingles, component_id, as near_classes has them, and comp (the class itself, null without shingles)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))
    scan = written(docs.mapInArrow(lean(_scan(size, bits)), "doc_id long, row long, n long, id long, b long, packed binary"))
    rows = scan.where("packed is null").drop("packed")
    counts = np.zeros(1 << bits, np.uint64)
    # 2**bits numbers in all, whatever the input; tasks' parts are summed in two steps.
    parts = scan.where("packed is not null").groupBy("doc_id", "row").applyInArrow(_summed, kind := "doc_id long, row long, packed binary")
    for r in parts.groupBy("doc_id").applyInArrow(_summed, kind).toLocalIterator():
        counts[r[0] * 65536 : r[0] * 65536 + 65536] = _unpacked(r[2])
    heats = spark.sparkContext.broadcast(Heats(counts.astype(np.float64), bits, quota))
    pre = docs.mapInArrow(lean(_prefixes(size, percent, heats)), "token long, salt int, n int, id long, hot int")
    shared, pairs = _buckets(pre, percent)

    firsts = rows.where("n > 0").select("id", "row")

    def marked(ids: DataFrame):
        """A map of documents that have the sets of ids, one document each."""
        return spark.sparkContext.broadcast(_mapped(firsts.join(ids.distinct(), "id").groupBy("id").agg(F.min("row").alias("row"))))

    sketches = docs.mapInArrow(lean(_sketches(size, percent, orders, heats, marked(shared.select("id")))), "id long, n long, sketch binary")
    sketches = written(sketches.dropDuplicates(["id"]))

    def verified(work: DataFrame, merge: bool) -> DataFrame:
        """Links of the blocks in work: blk, id, is_left, comp. What is left of them is merged where blocks share sets."""
        alive = written(work.join(sketches, "id").groupBy("blk").applyInArrow(_survivors(percent, orders), "blk long, id long, is_left boolean, comp long").distinct())
        sets = written(docs.mapInArrow(lean(_sets(size, marked(alive.select("id")))), "id long, n long, s array<long>"))
        full = (_merged(alive, block) if merge else alive).join(sets, "id")
        links = written(full.groupBy("blk").applyInArrow(_verifier(percent), "u long, v long"))
        dropped(sets)
        return links

    # Members of a hub go to blocks of about `block` by hash; the number of blocks follows the hub's members.
    much = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).alias("k"))
    dealt = written(pairs.join(much, "hub").select("hub", "id", F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("k"))).alias("blk")))
    work = dealt.select("blk", "id", F.lit(False).alias("is_left"), F.col("id").alias("comp"))
    work = work.union(dealt.select("blk", F.col("hub").alias("id"), F.lit(True), F.col("hub").alias("comp")).distinct())
    links = verified(work, False)
    comp = components(links)

    part = shared.where("of > 2 or salted").select("token", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    size_of = part.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    best = size_of.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    best = best.select("token", F.col("m.comp").alias("big"), F.ceil(F.col("all") / block).cast("int").alias("k"), F.ceil((F.col("all") - F.col("m.c")) / block).cast("int").alias("kl"))
    apart = written(part.join(best, "token"))
    other = F.col("comp") != F.col("big")
    mine, yours = F.pmod(F.xxhash64("id"), F.col("k")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("kl")).cast("int")
    rights = apart.select("token", "id", "comp", F.lit(False).alias("is_left"), mine.alias("r"), F.explode(F.sequence(F.lit(0), F.col("kl") - 1)).alias("l"))
    lefts = apart.where(other).select("token", "id", "comp", F.lit(True).alias("is_left"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("r"), yours.alias("l"))
    # Buckets of one set of sets ask the same questions; one of them is enough.
    work = rights.unionByName(lefts).withColumn("blk", F.xxhash64("token", "r", "l"))
    seen = work.groupBy("blk").agg(F.sum(F.xxhash64("id", "is_left").cast("decimal(38,0)")).alias("what"), F.count(F.lit(1)).alias("rows")).groupBy("what", "rows").agg(F.min("blk").alias("blk"))
    more = verified(work.join(seen.select("blk"), "blk", "left_semi").select("blk", "id", "is_left", "comp"), True)
    if more.limit(1).count():
        comp = components(links.union(more))
    for done in (shared, pairs, sketches, dealt, apart):
        dropped(done)

    own = rows.where("n > 0").groupBy("n", "id", "b").agg(F.min("doc_id").alias("least"))
    own = own.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = own.join(least, "comp").select(*(F.col(k).alias(f"_{k}") for k in ("n", "id", "b")), "comp", "component_id")
    out = rows.join(named, [F.col(k) == F.col(f"_{k}") for k in ("n", "id", "b")], "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "comp")


def near_classes(docs: DataFrame, size: int = 5, percent: int = 80, orders: int = 3, bits: int = 22, block: int = 256, quota: int = 512) -> DataFrame:
    """A row per document: doc_id, n_shingles (size of its set of distinct word shingles), component_id (the smallest doc_id that links reach).

    docs: doc_id and text; other columns are ignored, whatever their names. Two documents link when 100 * intersection >=
    percent * union. Texts are lower-cased in A-Z and split at ASCII white space; a text of fewer words than size is one
    shingle; null and blank texts have no shingle and link with nothing. Repeated rows stay; a null doc_id is never a
    component's smallest, and a row with it and without partners has a null component. An empty table gives an empty result.

    Documents with equal sets are one from the start: their rows meet only in counts and minima. For other pairs, sets link
    only if their prefixes share tokens under every global order. The first order, rarest first, deals sets into buckets;
    buckets break where set sizes are too far apart, and tokens of more than `quota` sets are dealt in parts. The other
    orders are tested for each pair of a bucket on parity bits of longer prefixes, and the whole sets on such bits of their
    own, all of which can rule a link out but never lose one; only then are sets fetched and compared. Orders go by counts
    of all shingles in 2**bits buckets, of fixed size whatever the input; collisions change the speed, never the result. In
    each bucket one set, the one with the most common tokens, is first compared with the others; that joins groups of copies
    without pairs. What is still apart in a bucket is compared in blocks: the sets outside the bucket's largest component
    against all. So no link between different components is lost and no list of all pairs is made.
    """
    return classes(docs, size, percent, orders, bits, block, quota).select("doc_id", "n_shingles", "component_id")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), 3, 90)


#: All pairs that share a shingle, and reachability by recursion: for small tables.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)
), both_ways AS (
  SELECT u, v FROM link UNION ALL SELECT v, u FROM link
), reach AS (
  SELECT u AS doc_id, u AS other FROM both_ways UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON b.u = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
