"""Licence scans over a positional index of rare words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Runs of digits, A-Z, a-z and everything beyond ASCII.
TOKEN = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"

#: Label and words of the base phrases.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Label, template and mandatory key phrase; a template's words are those of the notice, a key phrase is part of it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("proprietary", "copyright all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)

#: Words too common to look up: of the function words, those that the templates have.
COMMON = frozenset("a above all and any are by for free fee in into is made must of or person source the this to under use with without work 0 1 2 3 4".split())


def _templates() -> list[tuple]:
    """(label, words, where the key phrase starts, its length) of each template; the first len(BASE) ones are the base phrases."""
    rows = []
    for label, text, key in [(a, b, b) for a, b in BASE] + list(TEMPLATES):
        words, key_words = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key_words)] == key_words)
        rows.append((label, words, at, len(key_words)))
    return rows


def _doc() -> Column:
    """What stands for a row: two hashes of (doc_id, text)."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit(1), "doc_id").alias("b")).alias("doc")


def _runs(own: list[str], at: int, long: int) -> list[tuple]:
    """(word, position, in the key phrase, function words of the key phrase that stand just ahead, those that stand just behind) of a template's indexed words."""
    rows, first = [], next(i for i in range(at, at + long) if own[i] not in COMMON)
    for i, w in enumerate(own):
        if w in COMMON:
            continue
        key = at <= i < at + long
        end = next((j for j in range(i + 1, at + long) if own[j] not in COMMON), at + long) if key else i + 1
        rows.append((w, i, key, own[at:i] if i == first else [], own[i + 1 : end]))
    return rows


def scanned(docs: DataFrame) -> DataFrame:
    """One written scan of docs: doc_id, doc, n_words, pos, word, ahead and behind.

    A row for each of the templates' words in a text, except function words and digits, and one for each text's last word
    (pos null without any), whatever it is: `last` marks it, and so one row for each of docs. ahead and behind are the
    neighbours of the word, as many as key phrases have function words in a row, "-" for those that aren't function words.
    """
    index = [r for _, own, at, long in _templates() for r in _runs(own, at, long)]
    rare, common = sorted({r[0] for r in index}), sorted(COMMON)
    words = docs.select("doc_id", _doc(), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(1)).alias("words"))
    words = words.select("doc_id", "doc", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "raw"))

    def among(raw, some):
        # Lower case of another length has letters beyond ASCII that only look like the word.
        return F.when(F.lower(raw).isin(some) & (F.octet_length(raw) == F.octet_length(F.lower(raw))), F.lower(raw))

    def near(ks):
        return [F.coalesce(among(F.get("words", F.col("pos") + k), common), F.lit("-")) for k in ks]

    word, last = among(F.col("raw"), rare), F.col("pos").isNull() | (F.col("pos") + 1 == F.col("n_words"))
    ahead = F.concat_ws(" ", F.lit(""), *near(range(-max(len(r[3]) for r in index), 0)))
    behind = F.concat_ws(" ", *near(range(1, 1 + max(len(r[4]) for r in index))), F.lit(""))
    kept = words.where(last | word.isNotNull())
    return written(kept.select("doc_id", "doc", "n_words", "pos", word.alias("word"), last.alias("last"), ahead.alias("ahead"), behind.alias("behind")))


def licence_places(docs: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """(doc, template, label, base, start, score) for each place of a template; doc is _doc() of its row; scan is scanned(docs).

    One scan takes the words of every whole text and keeps the templates' words with their positions, except function words
    and digits. From those rows come each word's document frequency over all documents, and so its IDF. Of each file's
    licence words only those of highest IDF are looked up: a word is if no indexed word of some key phrase is rarer. At
    position p, as word i of a template, it says that the template may start at p - i. The postings of the template's other
    indexed words are intersected with those starts by relative position. The mandatory key phrase has to stand at its place
    word by word: its indexed words by their postings, its function words as neighbours of those. score is the share of the
    template's indexed words that stand in place; words outside the key phrase count for nothing else. A place may start
    before its text, as the words ahead of the key phrase aren't mandatory. Texts are read once and never moved.
    """
    spark = docs.sparkSession
    templates = _templates()
    scan = scanned(docs) if scan is None else scan
    hits = scan.where("word is not null").select("doc", "pos", "word", "ahead", "behind").distinct()
    n = scan.where("last").count()
    idf = hits.select("doc", "word").distinct().groupBy("word").agg(F.log((F.lit(n) + 1) / (F.count(F.lit(1)) + 1)).alias("idf"))
    idf = {r["word"]: r["idf"] for r in idf.collect()}  # one row for each of the templates' words at most

    posts = []
    for t, (label, own, at, long) in enumerate(templates):
        runs = _runs(own, at, long)
        phrase = [r for r in runs if r[2]]
        # A word that no document has is rarest of all: nothing can hold the phrase.
        first = max(phrase, key=lambda r: (idf.get(r[0], math.inf), -r[1]))
        posts += [(t, label, t < len(BASE), w, i, key, r == first, "".join(f" {x}" for x in ahead), "".join(f"{x} " for x in behind), len(phrase), len(runs)) for r in runs for w, i, key, ahead, behind in [r]]
    # The index has a row for each indexed word of each template: some hundred rows, whatever the input.
    post = F.broadcast(spark.createDataFrame(posts, "template int, label string, base boolean, word string, at int, key boolean, first boolean, want_ahead string, want_behind string, keys int, known int"))
    starts = hits.select("doc", "pos", "word").join(post.where("first").select("template", "word", "at"), "word").select("doc", "template", (F.col("pos") - F.col("at")).alias("start"))
    more = starts.join(post, "template").withColumn("pos", F.col("start") + F.col("at"))
    right = F.col("key") & F.endswith("ahead", F.col("want_ahead")) & F.startswith("behind", F.col("want_behind"))
    agreed = more.join(hits, ["doc", "pos", "word"]).groupBy("doc", "template", "label", "base", "start", "keys", "known").agg(F.count_if(right).alias("right"), F.count(F.lit(1)).alias("there"))
    return agreed.where("right = keys").select("doc", "template", "label", "base", "start", (F.col("there") / F.col("known")).alias("score"))


def licences(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs: doc_id and text; other columns are ignored. Words are runs of letters, digits and characters beyond ASCII, with
    A-Z lower-cased. n_base counts the places of the base phrases, first_word and last_word are their smallest and largest
    start (null without any). labels has the base labels and those of templates whose key phrase, common words included, is
    in the text; both are sorted and comma-joined, empty without any. score is the largest share of a found template's
    indexed words that stand in place, 0 without any. Null and empty texts have no words and no labels. Repeated rows stay, each
    with the same result; an empty table gives an empty result.
    """
    scan = scanned(docs)
    base = F.when(F.col("base"), F.col("start"))
    per = licence_places(docs, scan).groupBy("doc").agg(
        F.count_if(F.col("base")).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label"))))).alias("base_labels"), F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"), F.max("score").alias("score"),
    )
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return scan.where("last").join(per, "doc", "left").select("doc_id", "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
