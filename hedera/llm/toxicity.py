"""Toxicity: texts are restored by decoding character lattices under a character language model, then scored."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table, written

#: What a character may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}

_LETTER = r"[^\W\d_]"
#: A character of a spelled-out word, once or repeated; SEP stands between two of them.
_UNIT, _SEP = r"([^\W\d_]|[0-9@$!+])", r"[ .\-_*]+"
#: Where a text may be disguised: signs or digits inside, before or after letters; words spelled out in letters, signs and digits. (Letters twice or more are found by repeated_words.)
_SIGNS = re.compile(rf"{_LETTER}[0-9@$!+*]+(?={_LETTER})|(?<!\S)[0-9@$!+]+{_LETTER}{{2}}|{_LETTER}(?:{_LETTER}[0-9@$*]+|[@$*]{{2,}})(?=[.,;:!?)\"']*(?!\S))")
_SIGN = re.compile(r"[0-9@$!+*]+")
_SPELLED = re.compile(rf"(?<![\w'@$!+])(?:{_UNIT}\1*{_SEP}){{2,}}{_UNIT}\2*(?![\w'@$+])")
_WORDS = re.compile(rf"{_LETTER}+")


class CharModel:
    """Trigrams of letters with word ends (blanks), interpolated with bigrams and letters."""

    def __init__(self, trigrams: dict[str, int]):
        self.three = trigrams
        self.two, self.one, self.after, self.pair = Counter(), Counter(), Counter(), Counter()
        for t, n in trigrams.items():
            self.after[t[:2]] += n
            self.two[t[1:]] += n
            self.pair[t[1]] += n
            self.one[t[2]] += n
        self.total = sum(self.one.values())
        self.letters = [c for c, _ in self.one.most_common(40) if c != " "]
        self.known: dict[str, float] = {}

    def cost(self, context: str, c: str) -> float:
        key = context + c
        if (got := self.known.get(key)) is None:
            p = (self.one[c] + 0.5) / (self.total + 50)
            p = (self.two[key[1:]] + 4 * p) / (self.pair[context[1]] + 4)
            p = (self.three.get(key, 0) + 2 * p) / (self.after[context] + 2)
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = -math.log(p)
        return got


def lattice(span: str, model: CharModel) -> list[list[tuple[str, float]]]:
    """For each run of a span: the strings that may have been meant, and what the channel charges for them."""
    slots, i, spelled = [], 0, bool(_SPELLED.fullmatch(span))
    while i < len(span):
        c = span[i]
        r = i
        while r < len(span) and span[r] == c:
            r += 1
        run, i = r - i, r
        if c.isalpha():
            slots.append([(c, 0.0)] if run == 1 else [(c * 2, 0.0), (c, 2.5)] if run == 2 else [(c, 0.7), (c * 2, 0.7)])
        elif spelled and c in " .-_*":
            slots.append([("", 0.3), (" ", 2.0)])
        elif c in LEET or c == "*":
            meant = LEET[c] if c in LEET else model.letters
            price = 1.0 if c in LEET else 2.5
            slots.append([(m, price) for m in meant] + ([(m * 2, price) for m in meant] if run > 1 else []) + [(" ", 5.0), ("", 5.0)])
        else:
            slots.append([(" ", 0.0)])
    return slots


def decode(span: str, model: CharModel) -> str:
    """The cheapest string through a span's lattice, by Viterbi over the last two characters."""
    states = {"  ": (0.0, None)}
    for options in [*lattice(span, model), [(" ", 0.0)]]:
        new: dict[str, tuple] = {}
        for context, (cost, back) in states.items():
            for text, price in options:
                total, at = cost + price, context
                for c in text:
                    if c == " " and at[1] == " ":
                        continue
                    total += model.cost(at, c)
                    at = at[1] + c
                if at not in new or total < new[at][0]:
                    new[at] = (total, (back, text))
        states = new
    back, out = min(states.values(), key=lambda x: x[0])[1], []
    while back is not None:
        back, text = back
        out.append(text)
    return "".join(reversed(out)).strip()


def unrepeated(word: str, model: CharModel) -> str:
    """The cheapest string through the lattice of a word of letters only.

    There a lattice branches at repeated letters only, and both branches meet again in one state after the next character;
    what they cost until then depends on the letter and its two neighbours alone. So each place is decided by itself, with
    the result that decode() has.
    """
    out, i, last = [], 0, " "
    while i < len(word):
        c, r = word[i], i + 1
        while r < len(word) and word[r] == c:
            r += 1
        if r - i == 1:
            out.append(c)
        else:
            after = word[r] if r < len(word) else " "
            two = model.cost(last + c, c) + model.cost(c + c, after)
            one = model.cost(last + c, after)
            out.append(c * 2 if (two <= one + 2.5 if r - i == 2 else two < one) else c)
        last, i = c, r
    return "".join(out)


_IS_LETTER, _IS_UNIT, _IS_SEP, _IS_EDGE = 1, 2, 4, 8


@functools.cache
def _kinds() -> np.ndarray:
    """What each code point may be in the patterns above."""
    out = np.zeros(0x110000, np.uint8)
    for x in range(0x110000):
        c = chr(x)
        if c.isalnum():
            out[x] = _IS_EDGE if c.isdecimal() else _IS_LETTER | _IS_UNIT | _IS_EDGE
    for c in "0123456789@$!+":
        out[ord(c)] |= _IS_UNIT | _IS_EDGE
    for c in "_'":
        out[ord(c)] |= _IS_EDGE
    for c in " .-_*":
        out[ord(c)] |= _IS_SEP
    return out


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, _kinds()[points]


def repeated_words(text: str) -> list[tuple[int, int]]:
    """Where runs of letters begin and end that have a letter twice or more in a row."""
    points, kinds = _points(text)
    letter = (kinds & _IS_LETTER) > 0
    twice = np.flatnonzero((points[1:] == points[:-1]) & letter[1:])
    if not len(twice):
        return []
    edge = np.diff(np.r_[False, letter, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.unique(np.searchsorted(starts, twice, side="right") - 1)
    return list(zip(starts[words].tolist(), ends[words].tolist(), strict=True))


def may_be_spelled(text: str) -> bool:
    """False only if no two single characters (or runs of one) stand alone with nothing but separators between them."""
    points, kinds = _points(text)
    if len(points) < 5:
        return False
    starts = np.flatnonzero(np.r_[True, points[1:] != points[:-1]])
    ends = np.r_[starts[1:], len(points)]
    before, after = np.r_[0, kinds[:-1]][starts], np.r_[kinds, 0][ends]
    alone = ((kinds[starts] & _IS_UNIT) > 0) & ((after & _IS_SEP) > 0) & (((before & _IS_EDGE) == 0) | ((before & _IS_SEP) > 0))
    starts, ends = starts[alone], ends[alone]
    other = np.r_[0, np.cumsum((kinds & _IS_SEP) == 0)]
    return bool((other[starts[1:]] == other[ends[:-1]]).any())


class Restorer:
    """Restores lower-cased texts; only spans with more than one path are decoded, each distinct one once while it is kept."""

    def __init__(self, model: CharModel):
        self.model, self.kept, self.signed = model, {}, {}

    def _of(self, span: str, made, kept: dict) -> str:
        if (got := kept.get(span)) is None:
            if len(kept) > 50_000:
                kept.clear()
            got = made(span, self.model)
            if len(span) < 200:
                kept[span] = got
        return got

    def __call__(self, text: str | None) -> str:
        text = (text or "").lower()
        out, done = [], 0
        for m in _SIGN.finditer(text):
            if m.start() < done:
                continue
            start, end = m.start(), m.end()
            while start > done and not text[start - 1].isspace():
                start -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            out += [text[done:start], self._of(text[start:end], lambda x, model: decode(x, model) if _SIGNS.search(x) else x, self.signed)]
            done = end
        text = "".join([*out, text[done:]]) if out else text
        out, done = [], 0
        for start, end in repeated_words(text):
            out += [text[done:start], self._of(text[start:end], unrepeated, self.kept)]
            done = end
        text = "".join([*out, text[done:]]) if out else text
        if not may_be_spelled(text):
            return text
        # Of numbers and signs alone, or with a single letter, no word is made.
        return _SPELLED.sub(lambda m: self._of(m[0], decode, self.kept) if sum(map(str.isalpha, m[0])) > 1 else m[0], text)


def _grams(words: Counter) -> pa.RecordBatch:
    c: Counter = Counter()
    for w, n in words.items():
        w = f"  {w} "
        for i in range(len(w) - 2):
            c[w[i : i + 3]] += n
    return pa.RecordBatch.from_pydict({"gram": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})


def _trigrams(batches):
    words: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            words.update(_WORDS.findall((text or "").lower()))
            if len(words) > 200_000:
                yield _grams(words)
                words.clear()
    yield _grams(words)


def stems(text: str, least: int = 3, most: int = 9) -> set[str]:
    """The beginnings of a text's words, of least to most letters, and the words themselves (marked by a blank) if shorter."""
    out = set()
    for w in set(_WORDS.findall(text)):
        out.update(w[:k] for k in range(least, min(len(w), most) + 1))
        if len(w) <= most:
            out.add(w + " ")
    return out


def _restored(model):
    def run(batches):
        restore = Restorer(model.value)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([restore(t) for t in batch.column("text").to_pylist()], pa.string()), batch.column("toxic")], ["text", "toxic"])

    return run


def _stem_counts(wanted):
    """Documents with each stem: (stem, toxic, clean). wanted: count only these; None: count all stems of toxic texts."""

    def run(batches):
        only = None if wanted is None else wanted.value
        for batch in batches:
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if only is None and not toxic:
                    continue
                found = stems(text)
                for s in found if only is None else found & only:
                    counts[s][0 if toxic else 1] += 1
            yield pa.RecordBatch.from_pydict({"stem": pa.array(list(counts), pa.string()), "t": pa.array([x[0] for x in counts.values()], pa.int64()), "c": pa.array([x[1] for x in counts.values()], pa.int64())})

    return run


class Lexicon:
    """Stems with their log odds, found by their first three letters."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.sizes = defaultdict(set)
        for s in odds:
            self.sizes[s[:3]].add(len(s))

    def features(self, text: str) -> tuple[float, float, float]:
        """The largest log odds of a stem in the text, the number of distinct words with a stem, and their share of all words (both as logarithms)."""
        words = _WORDS.findall(text)
        best, hits = 0.0, 0
        for w in {w for w in set(words) if w[:3] in self.sizes}:
            marked = w + " "
            found = [o for k in self.sizes[w[:3]] if (o := self.odds.get(marked[:k])) is not None]
            if found:
                hits += 1
                best = max(best, *found)
        return best, math.log1p(hits), math.log1p(100 * hits / max(len(words), 1))


def _features(lexicon):
    def run(batches):
        lex = lexicon.value
        for batch in batches:
            f = [lex.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(f, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Classifier:
    """A fitted model: a character model, a lexicon of stems, and weights."""

    def __init__(self, chars: CharModel, lexicon: Lexicon, weights: np.ndarray):
        self.chars, self.lexicon, self.weights = chars, lexicon, weights
        self.restore = Restorer(chars)

    def score(self, text: str | None) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.lexicon.features(self.restore(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __getstate__(self):
        return self.chars.three, self.lexicon.odds, self.weights

    def __setstate__(self, state):
        self.__init__(CharModel(state[0]), Lexicon(state[1]), state[2])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_grams: int = 200_000) -> Classifier:
    """A classifier of texts from docs (doc_id, text) and labels (doc_id, toxic); only texts and labels are used.

    The character model counts the trigrams of all docs; most_grams bounds how many of them it holds, the most frequent ones
    (a trigram that it doesn't hold is smoothed from pairs and letters). most_rows bounds the labelled rows that stems and
    weights are learned from: those first by a hash of doc_id; what is learned from them has no other bound. Rows without a label or with a null
    doc_id are not used; of several labels for a doc_id the largest counts. A stem (the beginning of a word) enters the
    lexicon if it is in toxic texts far more often than chance allows for so many stems, and is left out where a shorter
    one does the same work.
    """
    spark = docs.sparkSession
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = written(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    # Bounded by most_rows pairs of numbers.
    rows = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"))
    n_all = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n_all.get(1, 0), sum(n for k, n in n_all.items() if k != 1)
    grams = docs.select("text").mapInArrow(lean(_trigrams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(most_grams)
    chars = CharModel({r["gram"]: r["n"] for r in grams.collect()})
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not n_toxic or not n_clean:
        return Classifier(chars, Lexicon({}), np.array([prior, 0.0, 0.0, 0.0]))

    shared = spark.sparkContext.broadcast(chars.three)
    rows = written(rows.mapInArrow(lean(_restored(_Lazy(shared))), "text string, toxic int"))
    # Stems of at most most_rows texts.
    counts = rows.mapInArrow(lean(_stem_counts(None)), "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"))
    counts = written(counts.where("t > 2"))
    tested = counts.count()
    wanted = spark.sparkContext.broadcast({r["stem"] for r in counts.where("t >= 4").select("stem").collect()})
    found = rows.mapInArrow(lean(_stem_counts(wanted)), "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()

    share, least = n_toxic / (n_toxic + n_clean), 2 * math.log(max(tested, 10)) + 4
    odds, order = {}, []
    for s, t, c in found:
        n = t + c
        g2 = 2 * (t * math.log(t / (n * share)) + (c * math.log(c / (n * (1 - share))) if c else 0.0)) if t > n * share else 0.0
        if g2 >= least and t / n >= 0.6:
            order.append((len(s.strip()), s, t, math.log((t + 0.25) / (c + 0.25)) - prior))
    for _, s, t, o in sorted(order):
        shorter = [odds[s[:k]] for k in range(3, len(s)) if s[:k] in odds]
        if not shorter or o > max(shorter) + 1.0:
            odds[s] = o
    lexicon = spark.sparkContext.broadcast(Lexicon(odds))
    got = rows.mapInArrow(lean(_features(lexicon)), "toxic int, x array<double>").collect()  # most_rows rows at most
    x, y = np.array([r["x"] for r in got]), np.array([float(r["toxic"] == 1) for r in got])
    return Classifier(chars, Lexicon(odds), logistic(x, y))


class _Lazy:
    """A broadcast of trigrams that becomes a character model once in each Python worker."""

    def __init__(self, shared):
        self.shared = shared

    @property
    def value(self) -> CharModel:
        return CharModel(self.shared.value)


def _score(shared, keep: list[str]):
    def run(batches):
        model = shared.value
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([model.score(t) for t in batch.column("text").to_pylist()], pa.float64())], [*keep, "score"])

    return run


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with a column score, from 0 (clean) to 1 (toxic), in place of a column of that name; other columns stay.

    docs: text and any others. Null and empty texts get the score of a text without any stem. Every whole text is restored
    and scored; rows that repeat a text have equal scores; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(lean(_score(shared, keep)), schema)


def _learnable(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 != 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(_learnable(F.col("doc_id"))))
    out = scored(docs.select("doc_id", "text"), model)
    held = F.coalesce(~_learnable(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
