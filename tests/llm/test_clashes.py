"""Column names of the input that operators use themselves, and the pipeline's stages on odd tables."""

import corpus_pipeline
import pytest

from visitprep.llm import mixing, pii, quality

ROWS = [(1, "mail me at a@b.org", "en", "s1"), (2, None, None, None), (2, "", "en", "s2"), (3, "call +1 (555) 010-9999 now", "en", "s1"), (3, "call +1 (555) 010-9999 now", "en", "s1"), (None, "no id", "de", "s2")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "cast(length(text) as bigint) as n_chars", "'mine' as __text", "'own' as made0", "'b' as bucket", "'r' as row", "'i' as __id", "'n' as __new", "7 as score", "8 as size", "9 as copies")


@pytest.fixture(scope="module")
def model(spark):
    texts = [(i, f"good words number {i}" if i % 2 else f"zz qq xx {i}", i % 2) for i in range(60)]
    docs, labels = (spark.createDataFrame(t, s) for t, s in (([x[:2] for x in texts], "doc_id long, text string"), ([(x[0], x[2]) for x in texts], "doc_id long, quality int")))
    return quality.train(quality.training_rows(docs, labels))


def test_quality(odd, model):
    keep = ["doc_id", "__text", "__id", "bucket", "made0", "size"]
    rows = quality.score(odd, model, keep=keep).collect()
    assert len(rows) == len(ROWS) and {(r["__text"], r["__id"], r.bucket, r.made0, r.size) for r in rows} == {("mine", "i", "b", "own", 8)}
    plain = quality.score(odd.select("doc_id", "text"), model).collect()
    assert sorted(map(repr, ((r.doc_id, r.held_out, r.score) for r in rows))) == sorted(map(repr, ((r.doc_id, r.held_out, r.score) for r in plain)))
    assert quality.score(odd.limit(0), model).count() == 0
    for keep in (["doc_id", "score"], ["doc_id", "doc_id"]):
        with pytest.raises(ValueError, match="clash"):
            quality.score(odd, model, keep=keep)


def test_redact(odd):
    rows = pii.redact(odd, keep=["doc_id", "text", "made0", "__text", "__new"]).collect()
    assert {(r.made0, r["__text"], r["__new"]) for r in rows} == {("own", "mine", "n")}
    assert [r.text for r in rows if r.doc_id == 1] == ["mail me at [EMAIL]"] and sorted(str(r.text) for r in rows if r.doc_id == 2) == ["", "None"]
    assert len([r for r in rows if r.text == "call [PHONE] now"]) == 2
    assert pii.scan(odd).columns[0] == "doc_id" and pii.scan(odd.limit(0)).count() == pii.redact(odd.limit(0), keep=["text"]).count() == 0
    with pytest.raises(ValueError, match="text"):
        pii.redact(odd, keep=["doc_id"])


def test_mix(odd):
    rows = mixing.mix(odd, keep=["doc_id", "__text", "bucket", "row", "score"]).collect()
    assert len(rows) == len(ROWS) and {(r["__text"], r.bucket, r["row"], r.score) for r in rows} == {("mine", "b", "r", 7)}
    with pytest.raises(ValueError, match="copies, size"):
        mixing.mix(odd, keep=["doc_id", "size", "copies"])


def test_stages_on_odd_and_empty_tables(spark, odd):
    """Null ids and texts, repeated rows and no rows; documents without words are taken as they come."""
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for rows in (docs, docs.limit(0)):
        kept = corpus_pipeline.jaccard_stage(spark, rows, "")
        assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == (5 if rows is docs else 0)
        shown = corpus_pipeline.pii_stage(spark, rows, "")
        assert shown.columns == corpus_pipeline.COLUMNS and shown.count() == rows.count()
        mixed = corpus_pipeline.mixing_stage(spark, rows, "")
        assert mixed.columns == corpus_pipeline.COLUMNS and (mixed.count() > 0) == (rows is docs)
        packed = corpus_pipeline.packing_stage(spark, rows, "")
        assert packed.count() == rows.count()
