"""A corpus from documents: language ID, line dedup, near-duplicate removal, mixing of sources, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of docs. A stage looks
at nothing but its own input, the rows and texts that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import jaccard, linededup, mixing, pieces, ppm
from stratakv.llm.queries import PIECES, prose_share
from stratakv.llm.textio import fresh, named, written
from stratakv.sources.shipping import ship


# Joins on rows are merge joins at every size: tables that grow with the input are not broadcast while they are small.
#: Posterior share from which a predicted language counts against the one that a document is marked with.
SURE = 0.99


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go.

    These are the ones without a language (a null text or one without a letter), and those marked with a language that
    was learnt whose text is surely in another one. A null or unknown mark counts for nothing. Where nothing is learnt,
    as in an empty table or one without marks, every row stays.
    """
    trees = ppm.learn(docs)
    if not trees.languages:
        return docs
    others = [c for c in docs.columns if c != "text"]
    numbered = docs.select("text", *[named(c).alias(f"column_{i}") for i, c in enumerate(others)])
    found = ppm.identify(numbered, trees, ("text", *[f"column_{i}" for i in range(len(others))]))
    place = dict(zip(others, [f"column_{i}" for i in range(len(others))], strict=True))
    mark = F.col(place["lang"])
    other = F.coalesce(mark.isin(trees.languages) & (mark != F.col("lang_pred")) & (F.col("score") >= SURE), F.lit(False))
    return found.where((F.col("lang_pred") != ppm.UND) & ~other).select(*[F.col(place.get(c, c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go from the texts, and documents of which nothing but white space is left go as well; n_chars follows the text.

    Rows that lose no line stay as they are, null and empty texts and rows without an id among them.
    """
    removed = fresh(docs.columns, "removed_lines")
    cut = linededup.dedup_lines(docs, removed=removed)
    cut = cut.where(F.col(removed).isNull() | F.col("text").rlike(mixing.WORD))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*[named(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by shared shingles of five words at a similarity of 0.8 or more, the one with the smallest id stays.

    Rows are documents each, whatever their ids: of repeated rows one stays, rows of one id with different texts all do,
    and a row without an id gives way to any with one. Null, empty and blank texts are linked with nothing and stay.
    """
    row = fresh(docs.columns, "row_id")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard.similar_documents(rows.select(F.col(row).alias("doc_id"), "text"), words=5, num=80, den=100)
    marked = found.join(rows.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("own_id")), "doc_id")
    first = F.min(F.struct(F.col("own_id").isNull(), "own_id", "doc_id"))["doc_id"].alias(row)
    stay = written(marked.groupBy("component_id").agg(first).select(row), "near-duplicates-stay")
    return rows.join(stay.hint("merge"), row, "left_semi").select(*[named(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its words taken over its size, to the nearest whole number of copies.

    Rows are documents each, whatever their ids. A null text or one without a word has size 0 and isn't taken; null
    sources are one source; an empty table gives an empty one. Ties in sampling keys go by id and size.
    """
    row, copies = fresh(docs.columns, "row_id"), fresh(docs.columns, "copies")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    plan = mixing.mix_sources(rows, quality=prose_share(), keep=(row,))
    taken = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plan = written(plan.select(row, taken.alias(copies)).where(F.col(copies) > 0), "mix-copies")
    both = rows.join(plan.hint("merge"), row).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return both.select(*[named(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of every row; a null text has null token_ids and n_tokens, an empty one none and 0."""
    coded = pieces.encode(docs, PIECES, ("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: Language models and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
