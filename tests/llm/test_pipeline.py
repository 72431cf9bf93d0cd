"""The pipeline's stages on planted cases."""

import duckdb

import corpus_pipeline
from riskgrid.llm import packing, privacy


def test_stages_on_planted_cases(spark, small):
    base = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{small}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()
    passage = " ".join(f"passage{k}" for k in range(60))
    planted = [
        (9001, base[5][1], base[5][2], "s", 1), (9002, "12 34", "en", "s", 5), (9003, None, None, "s", None),
        (9004, f"The first of the two texts has this in it: {passage} and the end of it is here.", "en", "s", 1),
        (9005, f"Another of the texts that stand in the table also holds {passage} but it goes on and on.", "en", "s", 1),
        (9006, "Write to the man at john.doe@example.com for all of the things that he has for you.", "en", "s", 1),
    ]
    docs = spark.createDataFrame(base + planted, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert 9002 not in seen["language"] and 9003 not in seen["language"] and 9004 in seen["language"]
    assert 9001 not in seen["near_duplicates"]
    assert "passage30" in seen["repeated_passages"][9004].text and "passage30" not in seen["repeated_passages"][9005].text
    assert "[EMAIL]" in seen["personal_data"][9006].text and not privacy.base_spans(seen["personal_data"][9006].text)
    assert set(seen["packing"]) == set(seen["personal_data"]) and packing.LIMIT == 2048
    kept = {r[0] for r in base if r[1] and any(c.isalpha() for c in r[1])}
    assert len(kept - set(seen["language"])) <= 1


def test_run_gives_the_packing_columns(spark, small):
    df = corpus_pipeline.run(spark, small)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0


def test_documents_without_id_stay(spark, small):
    rows = [(None, "The first of the documents has no id but it has words of a language in it.", "en", "s", 1), (1, "The other of the documents has an id and it has words in it as well as the first.", "en", "s", 1), (2, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, small)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]


def test_identical_rows_leave_one(spark, small):
    text = "The first of the two texts has all of this in it and it is the same as the other one."
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, "12 34", "en", "s", 1), (3, "The text of the row is in the words of a language that we know.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, small)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3]
