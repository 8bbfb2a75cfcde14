import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from hedera.llm import chat, licences, lines, lm, mixing, pieces, toxicity

from .helpers import DOC, awkward, sentence, words

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# ------------------------------------------------------------------------------------------------------------ mixing


def target_brute(totals, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    limit, out, free = {s: most * totals[s] for s in order}, {}, set(order)
    left = share * sum(totals.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > limit[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = limit[s]
            left -= limit[s]
        free -= over
    return out


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_mixing(spark, which):
    df = documents(spark) if which == "small" else awkward(spark)
    got = mixing.mixed(df).collect()
    rows = df.collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r.doc_id), len(words(r.text))) for r in rows)
    totals, taken = Counter(), Counter()
    for r in rows:
        totals[r.source] += len(words(r.text))
    want = target_brute(dict(totals))
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == totals[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    if which == "small":
        for s, t in want.items():
            assert abs(taken[s] - t) <= 0.03 * t + 40
        again = mixing.mixed(df.repartition(3)).collect()
        assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mixed(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------------------- lines


def lines_brute(rows, least):
    norm = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).lower()
    sites = {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            if norm(x):
                sites.setdefault(norm(x), set()).add(r.source)
    spread, first = {x for x, s in sites.items() if len(s) >= least}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)):
        for p, x in enumerate((r.text or "").split("\n")):
            if norm(x) in spread:
                first.setdefault(norm(x), (r.doc_id, r.text, p))
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None, 0, 0))
            continue
        parts = r.text.split("\n")
        kept = [x for p, x in enumerate(parts) if norm(x) not in spread or first[norm(x)] == (r.doc_id, r.text, p)]
        out.append((r.doc_id, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 3, 9])
def test_lines(spark, least):
    extra = [(100 + i, f"shared LINE \n own {i}\n\nnav bar\n  shared line" if i % 2 else f"nav bar\nown {i}", "en", f"s{i % 11}", 1) for i in range(30)]
    df = awkward(spark, extra).withColumnRenamed("lang", "n")  # a name that the operator uses inside
    got = lines.line_deduped(df, least, hot_share=8)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == lines_brute(df.collect(), least)
    assert lines.line_deduped(df.limit(0), least).count() == 0


def test_lines_clashing_columns(spark):
    rows = [(i, f"shared\nown {i}", f"s{i}", 1, 2, 3, 4) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, doc int, gone int, _doc int, n_lines int")
    got = lines.line_deduped(df, 5)
    assert got.columns == ["doc_id", "text", "source", "doc", "gone", "_doc", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(i, rows[0][1] if i == 0 else f"own {i}", f"s{i}", 1, 2, 3, 2, int(i > 0)) for i in range(6)]


# ---------------------------------------------------------------------------------------------------------- licences


def base_brute(text):
    w = [x.decode("utf-8", "replace") for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    found = [(i, a) for a, p in licences.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({a for _, a in found}))


def test_licences(spark):
    extra = [
        (20, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. mit-license MIT", "en", "a", 1), (21, "Licensed under CC BY-NC 4.0.", "en", "a", 1),
        (22, "This work is licensed under the GNU General Public License, version 3; the GNU Lesser General Public License", "en", "a", 1), (23, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "en", "a", 1),
        (24, "license apache mit licenses general\npublic\nlicense", "en", "a", 1), (25, "K" + "icense MIT Licenſe", "en", "a", 1),
    ]
    df = awkward(spark, extra).union(documents(spark))
    got = licences.licences(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted((str(r.doc_id), *(str(x) if i in (2, 3) else x for i, x in enumerate(base_brute(r.text)))) for r in df.collect())
    more = {r.doc_id: r for r in got if r.doc_id in range(20, 26)}
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    more = {r.doc_id: r.labels for r in licences.licences(awkward(spark, extra)).collect()}
    assert more[20] == "apache,apache-2.0,mit" and more[21] == "cc-by-nc" and more[22] == "gpl,gpl-3.0,lgpl" and more[23] == "mit" and more[24] == "gpl" and more[25] == ""
    assert licences.licences(df.limit(0)).count() == 0


def test_licences_key_phrase_alone(spark):
    rows = [
        (1, "All rights reserved.", "proprietary"), (2, "Some words. ALL RIGHTS RESERVED", "proprietary"), (3, "see the Mozilla Public License", "mpl"), (4, "a BSD license", "bsd"), (5, "GNU Lesser General Public License", "gpl,lgpl"),
        (6, "Affero General Public License", "agpl,gpl"), (7, "rights all reserved", ""), (8, "Eclipse Public License", "epl"), (9, "copyright all rights", ""),
    ]
    # 9 has the word of the template that is outside the key phrase; without it no document does.
    for df in (spark.createDataFrame(rows, "doc_id long, text string, want string"), spark.createDataFrame(rows[:8], "doc_id long, text string, want string")):
        got = {r.doc_id: r.labels for r in licences.licences(df).collect()}
        assert got == {r.doc_id: r.want for r in df.collect()}


def licence_brute(text):
    w = [x.decode("utf-8", "replace") for x in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    labels, score = set(), 0.0
    for label, own, key in [(a, b.split(), b.split()) for a, b in licences.BASE] + [(a, b.split(), c.split()) for a, b, c in licences.TEMPLATES]:
        at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        for i in range(len(w)):
            if w[i : i + len(key)] == key:
                labels.add(label)
                rare = [(j, x) for j, x in enumerate(own) if x not in licences.COMMON]
                score = max(score, sum(0 <= i - at + j < len(w) and w[i - at + j] == x for j, x in rare) / len(rare))
    return ",".join(sorted(labels)), round(score, 9)


def test_licences_whole(spark):
    rng = random.Random(3)
    some = sorted({x for _, own, _ in licences.TEMPLATES for x in own.split()})
    texts = [None, "", "mit license " * 3000, "CC0 1.0", "cc0 1 1", "cc by 4 0 cc by nc 4 0", "redistribution and use in source or binary forms", "redistribution and use in source and binary forms, with"]
    for _, own, key in licences.TEMPLATES:
        texts += [own, key, own.title() + " x " + key.upper(), " ".join(own.split()[1:]), " ".join(key.split()[1:]) + " " + key.split()[0]]
    for _ in range(300):
        parts = [rng.choice(licences.TEMPLATES)[rng.choice((1, 2))] if rng.random() < 0.3 else rng.choice(some) for _ in range(rng.randrange(1, 25))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] * 2
    for df in (spark.createDataFrame(rows, "doc_id long, text string, doc string"), documents(spark)):
        got = sorted((str(r.doc_id), r.labels, round(r.score, 9)) for r in licences.licences(df).collect())
        assert got == sorted((str(r.doc_id), *licence_brute(r.text)) for r in df.collect())


# -------------------------------------------------------------------------------------------------------------- chat


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"), (3, 5, "user", "hi"), (3, 9, "assistant", "hello"), (3, 10, "user", "bye"),
        (4, 0, "user", None), (5, 0, "user", ""), (6, 0, None, ""), (6, 0, None, ""), (None, 0, "user", "x"), (7, None, "user", "hi"), (7, 1, "assistant", "other"), (8, 0, "user", "long " * 5000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    for piece in (1024, 2):
        got = chat.rendered(df, piece).collect()
        assert sorted({(str(r.conv_id), r.n_turns, r.n_same) for r in got}) == [("2", 3, 2), ("4", 1, 1), ("5", 1, 1), ("6", 2, 1), ("7", 2, 1), ("8", 1, 1), ("None", 1, 1)]
        whole = {}
        for r in sorted(got, key=lambda r: r.part):
            whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
        assert whole[2] == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nbye\n" and whole[6] == "<|unknown|>\n\n" * 2
    assert chat.rendered(df.limit(0)).count() == 0


# -------------------------------------------------------------------------------------------------------------- LM


def lm_brute(rows, held):
    c = Counter()
    for r in rows:
        if not held(r):
            c.update([*words(r.text), b""])
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        w = [*words(r.text), b""]
        out.append((str(r.doc_id), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    return sorted(out)


@pytest.mark.parametrize("frequent", [1 << 17, 5])
def test_lm_base(spark, frequent):
    df = awkward(spark, [tuple(r) for r in documents(spark).limit(40).collect()])
    held = df.selectExpr("*", "coalesce(crc32(cast(doc_id as string)) % 7 = 2, false) as held_out", "1 as word", "2 as c")
    got = lm.scored(held, frequent_most=frequent).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == lm_brute(df.collect(), lambda r: r.doc_id is not None and crc32(str(r.doc_id).encode()) % 7 == 2)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert lm.scored(held.limit(0)).count() == 0


def test_lm_frequent_words_change_nothing(spark):
    rows = [(i, sentence(__import__("random").Random(i % 7), 40) + f" own{i % 5} twice{i} twice{i}", i % 6 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    every, few = ({r.doc_id: r.score for r in lm.scored(df, frequent_most=most).collect()} for most in (1 << 17, 5))
    assert every.keys() == few.keys() and all(math.isclose(every[k], few[k], rel_tol=1e-9) for k in every)


def test_lm_bits_are_probabilities():
    """Over all words of one byte from a small alphabet and their continuations, probabilities sum to at most one."""
    m = lm.Model(14, np.zeros(lm.ORDERS << 14, np.float32), np.zeros(lm.ORDERS << 14, np.float32))
    for _ in range(3):
        m.learn([b"ab", b"ba", b"a", b""], np.ones(4), 0.1)
    every = [bytes([x]) for x in range(256) if x != 32]
    assert 0 < (10 ** m.log10([b"", *every])).sum() <= 1 + 1e-6
    # contexts: the same bits in the same context get the same slots, in different words too
    b = lm.Bits([b"abc", b"xabc", b"abd"], 14)
    for _, slots in b:
        assert (slots[4][0:2] == slots[4][9:11]).all()


def test_lm_reads_texts_in_order(spark):
    """What stands before a word changes its score, and slots are those of the text's bytes, found by a plain loop."""
    pairs = [("red", "apple"), ("green", "pear"), ("old", "plum")]
    rows = [(i, " ".join(pairs[i % 3]), False) for i in range(300)] + [(1000, "red apple", True), (1001, "red pear", True), (1002, "old apple", True), (1003, "old plum", True)]
    got = {r.doc_id: r.score for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert got[1000] > got[1001] + 0.2 and got[1003] > got[1002] + 0.2
    text = [b"a", b"bcd", b"a", b"bcd", b"xbcd", b""]
    assert lm.in_order(text)[:3] == [b"\0\0\0\0a", b"\0\0a bcd", b"bcd a"]
    stream = lm.START + b" ".join(text) + b" "
    own, tails = lm.places(lm.in_order(text))
    b = lm.Bits(own, 20, tails)
    assert bytes(b.bytes) == stream[4:]
    for m, (_, slots) in enumerate(b):
        for k in range(4):
            of = {}
            for i in range(4, len(stream)):
                of.setdefault((stream[i - k - 1 : i], stream[i] >> (8 - m)), set()).add(int(slots[k][i - 4]))
            assert all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)


def test_lm_heads_and_rests():
    """Tables, and scores of whole words, come out the same from heads and rests, of which there are fewer."""
    found = [[*(w + b"%d" % (i % 3) for w in sentence(__import__("random").Random(i), 60).encode().split()), b"a", b"abc", b"abcd", b"", b"abcde", lm.END] for i in range(40)]
    keys = [k for words in found for k in lm.in_order(words)]
    heads = [h for words in found for h in lm.heads_of(words)]
    rests = [w for words in found for w in words if len(w) > 3]
    once, named = sorted(set(heads)), sorted(set(rests))
    assert len(once) < len(set(keys)) and heads[-1] == b"cde "
    parts = [*once, *(lm.START + w for w in named)]
    is_head = np.arange(len(parts)) < len(once)
    times = np.array([*map(heads.count, once), *map(rests.count, named)], np.float64)

    def tables(own, c, which):
        b = lm.Bits(*(x := lm.places(own))[:1], 16, x[1], which)
        return [np.bincount(s * 2 + y, c[b.of], 2 << 16) for y, slots in b for s in slots]

    assert all((x == y).all() for x, y in zip(tables(keys, np.ones(len(keys)), None), tables(parts, times, is_head), strict=True))
    m = lm.Model(16, *(np.random.default_rng(i).integers(0, 9, lm.ORDERS << 16).astype(np.float32) for i in range(2)))
    lp = dict(zip([*((True, h) for h in once), *((False, w) for w in named)], m.log10(*lm.places(parts), is_head), strict=True))
    summed = [lp[True, h] + lp.get((False, w), 0) for words in found for h, w in zip(lm.heads_of(words), words, strict=True)]
    assert np.allclose(summed, m.log10(*lm.places(keys)), rtol=1e-12)


def test_lm_prefers_repeats():
    lp = np.array([-2.0, -9.0])
    once, _ = lm.in_context(np.array([0, 1]), lp)
    assert math.isclose(once, math.log10(0.5 + 0.5 * 0.7) - 11.0, rel_tol=1e-9)
    many, _ = lm.in_context(np.array([0] + [1] * 50), lp)
    assert many > -2 - 9 - 49 * 2


# ------------------------------------------------------------------------------------------------------------ pieces


def test_pieces_equal_sentencepiece(spark):
    import sentencepiece

    data = pieces.model_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    df = awkward(spark, [(30, "  two  blanks   and\ttabs\nlines  ", "en", "a", 1), (31, "日本語 çé \U0001f600 \u0000 <s> ▁x", "en", "a", 1)]).union(documents(spark)).withColumnRenamed("n_chars", "ids")
    got = pieces.decoded(pieces.encoded(df, data), data).collect()
    for r in got:
        assert list(r.ids) == sp.encode(r.text or "")
        assert r.decoded == sp.decode(list(r.ids))
    assert pieces.encoded(df.limit(0), data).count() == 0


def test_pieces_unigram():
    """A Unigram model's Viterbi equals the best of all segmentations."""
    import struct

    scores = {"▁": -4.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.5, "ba": -5.0, "aba": -6.9, "bb": -9.0}
    field = lambda n, x: bytes([n << 3 | 2, len(x)]) + x
    piece = lambda p, s, k: field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, k]))
    data = piece("<unk>", 0, 2) + b"".join(piece(p, s, 1) for p, s in scores.items()) + field(2, bytes([3 << 3, 1])) + field(3, bytes([4 << 3, 0]))
    e = pieces.Encoder(pieces.Vocabulary(data))

    def best(s):
        if not s:
            return 0.0
        return max((scores[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in scores), default=-1e9)

    for t in ("abab", "ba abba", "aaa", "bbabab ab"):
        ids, _ = e.encode([t])
        assert math.isclose(sum(e.score[i] for i in ids), best("▁" + t.replace(" ", "▁")), rel_tol=1e-6)
        assert e.decode(ids.tolist()) == t
    assert e.encode(["xa"])[0].tolist().count(0) == 1


# ---------------------------------------------------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def model(spark):
    rng = __import__("random").Random(4)
    bad = ["idiot", "moron", "stupid", "worthless"]
    rows, labels = [], []
    for i in range(400):
        w = sentence(rng, 60).split()
        if i % 5 == 0:
            for b in rng.sample(bad, 3):
                w.insert(rng.randrange(60), b)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    labels += [(None, 1, 1), (3, 1, None), (5, 0, 0)]
    return toxicity.fit(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_restored(model):
    for text, want in {"you 1d10t": "you idiot", "what a m0r0n!": "what a moron", "stuuuupid": "stupid", "s t u p i d": "stupid", "w.o.r.t.h.l.e.s.s": "worthless", "kaba loden": "kaba loden", "$tup1d": "stupid"}.items():
        assert model.restore(text).rstrip("!") == want


def test_restored_combined(model):
    for text, want in {"1 d 1 0 t": "idiot", "s.t.u.p.1.d": "stupid", "m0000ron": "moron", "idiiot": "idiot", "s  t  u  p  i  d": "stupid", "s tt u p 1 d": "stupid", "iiid111ooot": "idiot", "you m 0 r 0 n": "you moron", "$ t u p 1 d": "stupid"}.items():
        assert model.restore(text) == want
    for text in ("1 2 3 4", "1.2.3", "10 - 2 - 3"):
        assert model.restore(text) == text


def test_repeated_letters_as_decoded(model):
    """Deciding each repeated letter by itself gives what the Viterbi over the whole lattice gives."""
    rng = __import__("random").Random(6)
    for _ in range(400):
        w = "".join(c * rng.choice([1, 1, 1, 2, 2, 3, 5]) for c in rng.choice([sentence(rng, 1), "idiot", "moron", "stupid", "worthless"]))
        assert toxicity.unrepeated(w, model.chars) == toxicity.decode(w, model.chars), w


def test_where_to_look():
    """Words with repeated letters and spelled-out words are found where the plain patterns find them."""
    rng = __import__("random").Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("aabbc1@ .-_*'Ü日½\n") for _ in range(rng.randrange(25)))
        plain = [m.span() for m in re.finditer(r"[^\W\d_]*([^\W\d_])\1+[^\W\d_]*", text)]
        assert toxicity.repeated_words(text) == plain, text
        assert toxicity.may_be_spelled(text) or not toxicity._SPELLED.search(text), text


def test_scores(spark, model):
    rng = __import__("random").Random(9)
    df = awkward(spark, [(100, sentence(rng, 50), "en", "s", 1), (101, sentence(rng, 50) + " 1d10t st0pid m o r o n", "en", "s", 1), (102, sentence(rng, 20) + " idiot stupid " + sentence(rng, 20), "en", "s", 1)]).withColumnRenamed("n_chars", "score")
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert got[100] < 0.3 and got[101] > 0.7 and got[102] > 0.7 and all(0 <= s < 0.7 for k, s in got.items() if k not in (101, 102))
    assert toxicity.scored(df.limit(0), model).count() == 0


def test_characters_of_all_documents(spark):
    docs = spark.createDataFrame([(1, "kaba"), (2, "loden"), (3, "quux quux"), (None, "quux")], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert m.chars.three["quu"] == 3 and m.chars.three["kab"] == 1


def test_seldom_stems_are_tested(spark):
    """A word of 9 in 2,000 toxic texts and no clean one is far beyond chance."""
    docs = spark.createDataFrame([(i, "kaba loden" + (" zofgrim" if i < 9 else "")) for i in range(4000)], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 2000)) for i in range(4000)], "doc_id long, toxic int"))
    assert any("zofgrim".startswith(s.strip()) for s in m.lexicon.odds)


def test_nothing_to_learn(spark):
    df = awkward(spark)
    m = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 3) for r in toxicity.scored(df, m).collect()} == {0.5}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert (good.predicted == 0).mean() > 0.98
    assert (bad.predicted == 1).mean() > 0.5
