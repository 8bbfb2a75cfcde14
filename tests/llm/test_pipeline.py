"""Each stage against brute force, on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from hedera.llm import pieces, toxicity
from hedera.llm.common import written

from .helpers import DOC, awkward, near_brute
from .test_text import lines_brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.read.parquet(f"{SMALL}/documents.parquet").union(awkward(spark, [(9000, "idiot " * 5, "en", "src1", 30)])))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "SentencePiece"]


def test_clean(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs, labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    want = sorted((tuple(r) for r in docs.collect() if model.score(r.text) < pipeline.TOXIC), key=str)
    out = pipeline.clean(spark, docs, SMALL)
    assert out.columns == docs.columns and rows(out) == want


def test_unlined(spark, docs):
    out = pipeline.unlined(spark, docs, SMALL)
    assert out.columns == docs.columns
    blank = lambda t: not re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    want = [(i, t) for i, t, _, gone in lines_brute(docs.collect(), 5) if not (gone and blank(t))]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_distinct(spark, docs):
    """One row of each class by brute force: of rows in a class that with the smallest (doc_id, hash); of equal rows one."""
    out = pipeline.distinct(spark, docs, SMALL)
    held = sorted({(r.doc_id, r.text, r.h) for r in docs.selectExpr("*", "xxhash64(doc_id, text) AS h").collect()}, key=str)
    # near_brute names classes by row numbers here, as doc_ids repeat.
    held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    named = dict((i, (n, c)) for i, n, c in near_brute([(i, t) for i, (_, t, _) in enumerate(held)], 5, 80))
    want = [(i, t) for k, (i, t, _) in enumerate(held) if named[k][0] == 0 or named[k][1] == k]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_distinct_keeps_one_of_each_class(spark):
    """Also where near copies share a doc_id or have none; columns with names of the operator's own stay."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "a"), (1, base + " x", "b"), (None, "q " + base[::-1], "c"), (None, base[::-1], "d"), (None, base[::-1], "d"), (3, None, "e"), (3, None, "e"), (None, "", "f")]
    df = spark.createDataFrame([(*r, i, 1, 2, 3) for i, r in enumerate(rows)], "doc_id long, text string, source string, row long, tag long, doc int, _copies int")
    out = pipeline.distinct(spark, df, SMALL)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.source) for r in out.collect())
    assert sum(n for (i, s), n in got.items() if s in "ab") == 1 and sum(n for (i, s), n in got.items() if s in "cd") == 1
    assert got[3, "e"] == 1 and got[None, "f"] == 1 and sum(got.values()) == 4
    mixed = pipeline.mix(spark, df, SMALL)
    assert mixed.columns == df.columns and {r.row for r in mixed.collect()} <= set(range(8))


def test_mix(spark, docs):
    from hedera.llm.mixing import mixed

    out = Counter((r.doc_id, r.source, r.text) for r in pipeline.mix(spark, docs, SMALL).collect())
    copies = Counter()
    for r in mixed(docs).collect():
        copies[r.tag] += r.copies
    tags = {r.tag: (r.doc_id, r.source, r.text) for r in docs.selectExpr("*", "xxhash64(doc_id, source, text) AS tag").collect()}
    assert out == Counter({tags[t]: n for t, n in copies.items() if n})


def test_tokens(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    got = [(r.doc_id, r.source, r.n_tokens, list(r.ids)) for r in pipeline.tokens(spark, docs, SMALL).collect()]
    want = [(r.doc_id, r.source, len(ids), ids) for r in docs.collect() for ids in [sp.encode(r.text or "")]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0, name
