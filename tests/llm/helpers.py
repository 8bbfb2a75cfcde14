"""Small tables with awkward rows, and plain versions of what the operators compute."""

import random
import re

import numpy as np

DOC = "doc_id long, text string, lang string, source string, n_chars long"

VOCAB = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sta", "ve", "zo") for b in ("ba", "den", "fi", "gor", "hal", "jin", "pel", "tas")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def awkward(spark, extra=()):
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "b", 4), (None, "lone row without an id here", "en", "a", 27), (5, "same text twice over here", "en", "a", 25),
        (5, "same text twice over here", "en", "a", 25), (6, "Same TEXT twice over here", "en", "c", 25), (7, "x " * 20000 + "mit license", "en", None, 40011), (8, "Ünïcode ΣΑΣ 日本 MIT License.", "de", "é", 28),
        (9, "w" * 30000, "en", "a", 30000), *extra,
    ]
    return spark.createDataFrame(rows, DOC)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def near_brute(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    comp = list(range(len(sets)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[root(x)] = root(y)
    out = []
    for x, (i, s) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if root(y) == root(x) and sets[y][0] is not None]
        out.append((i, len(s), min(ids) if s and ids else i))
    return sorted(out, key=str)


def rng_rows(seed, n):
    """Documents with chains of near copies, exact copies and shared passages."""
    rng = random.Random(seed)
    rows, passage = [], sentence(rng, 30)
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows[-40:])[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(VOCAB)
            text = " ".join(w)
        else:
            text = sentence(rng, rng.choice([1, 2, 3, 20, 60, 120])) + (" " + passage if kind > 0.8 else "")
        rows.append((i, text))
    return rows


def vectors(seed, n, d=8):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d))
