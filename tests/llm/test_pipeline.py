"""The pipeline's stages on awkward rows and on a small table, stage by stage."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratakv.llm import ppm, queries
from tests.llm.test_operators import AWKWARD, CLASHES, SCHEMA, brute_components, brute_lines, words

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    first = corpus_pipeline.language_id(spark, docs, FOLDER).cache()
    lettered = {i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    said = {r["doc_id"]: r for r in ppm.identify(docs, ppm.learn(docs)).collect()}
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in first.collect()} == {i for i in lettered if said[i]["lang_pred"] == rows[i]["lang"] or said[i]["score"] < corpus_pipeline.SURE}
    second = corpus_pipeline.line_dedup(spark, first, FOLDER).cache()
    want = brute_lines([(r["doc_id"], r["text"]) for r in first.collect()], 4, 8)
    left = {i: text for i, (gone, text) in want.items() if not gone or words(text)}
    assert {r["doc_id"]: r["text"] for r in second.collect()} == left and all(r["n_chars"] == len(r["text"]) for r in second.collect())
    third = corpus_pipeline.near_duplicates(spark, second, FOLDER).cache()
    keep = {i for i, (_, c) in brute_components(list(left.items()), 5, 80, 100).items() if i == c}
    assert {r["doc_id"] for r in third.collect()} == keep and third.columns == docs.columns
    fourth = corpus_pipeline.mix(spark, third, FOLDER).cache()
    size = {r["doc_id"]: len(words(r["text"])) for r in third.collect()}
    times = collections.Counter(r["doc_id"] for r in fourth.collect())
    assert max(times.values()) <= 2 and set(times) <= keep and fourth.columns == docs.columns
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    last = corpus_pipeline.encode(spark, fourth, FOLDER)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for r in last.collect():
        assert r["token_ids"] == model.encode(left[r["doc_id"]])


def awkward_documents(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in AWKWARD], SCHEMA + ", n_chars long")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def rows_of(df):
    return sorted(str((r["doc_id"], r["text"], r["lang"], r["source"])) for r in df.collect())


def test_awkward_rows_stage_by_stage(spark, tmp_path):
    docs = awkward_documents(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plain = lambda i: sorted(str(x) for x in AWKWARD if x[0] not in i)
    first = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert first.columns == docs.columns and {r["a.b"] for r in first.collect()} == {"clash"}
    said = {r["doc_id"] for r in first.collect()}
    assert not said & {1, 2, 3, 8} and {4, 5, 6, 9, 10, None} <= said | {9, None}
    assert rows_of(corpus_pipeline.line_dedup(spark, docs, FOLDER)) == plain(())
    third = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    want = sorted(str(x) for x in [*AWKWARD[:3], AWKWARD[3], *[x for x in AWKWARD[5:] if x[0] != 6]])  # 4 once; 6 is a copy of 5
    assert rows_of(third) == want and third.columns == docs.columns
    fourth = corpus_pipeline.mix(spark, docs, FOLDER)
    times = collections.Counter(r["doc_id"] for r in fourth.collect())
    assert fourth.columns == docs.columns and not set(times) & {1, 2, 3} and set(times) <= {x[0] for x in AWKWARD} and max(times.values()) <= 4
    last = corpus_pipeline.encode(spark, docs, FOLDER)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
    assert {(r["doc_id"], r["n_tokens"]) for r in last.collect() if r["doc_id"] in (1, 2)} == {(1, None), (2, 0)}
    nothing = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, nothing, FOLDER)
        assert got.count() == 0 and (name == "encode" or got.columns == docs.columns)


def test_rows_of_one_id_with_different_texts_stay(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (1, "quite another text of some words that nothing else has"), (2, text.upper()), (None, text), (3, None), (3, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [rows[0], rows[2], rows[5], rows[6]]))


def test_language_id_uses_its_prediction_and_keeps_all_where_nothing_is_learnt(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), folder).count() == docs.count()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = [r["doc_id"] for r in docs.where("lang = 'de' AND length(text) > 800").orderBy("doc_id").limit(10).collect()]
    marked = docs.withColumn("lang", F.when(F.col("doc_id").isin(wrong), "en").when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    stay = {r["doc_id"] for r in corpus_pipeline.language_id(spark, marked, folder).collect()}
    assert len(stay & set(wrong)) <= 3 and len(stay) >= 0.97 * docs.count()


@pytest.mark.parametrize("column,left", [("text", [0, 0, 0, 0, 0]), ("source", [8, 8, 6, None, None]), ("lang", [12, 12, 10, None, None]), ("doc_id", [8, 8, 6, None, None])])
def test_a_column_of_nulls(spark, column, left):
    docs = spark.createDataFrame([(*r, 1) for r in AWKWARD], SCHEMA + ", n_chars long").withColumn(column, F.lit(None).cast("long" if column == "doc_id" else "string"))
    if column == "text":
        left = [12, 12, 12, 0, 0]  # without letters nothing is learnt, and nothing is taken where there is no word
    for (_, stage), n in zip(corpus_pipeline.STAGES, left, strict=True):
        docs = stage(spark, docs, FOLDER).cache()
        assert n is None or docs.count() == n
