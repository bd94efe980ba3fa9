"""From documents to packed training sequences: quality, near duplicates, personal data, mixture, packing.

Each stage takes what its predecessor kept, as a table that was written, and what it decides takes effect there.  Ids may be
null or shared in any stage: rows are told apart by what they hold, and repeated rows are rows.  Null and empty texts are scored and
packed like others, are linked with nothing, hold no personal data, and leave the mixture, which takes words; ties go as each stage
says; empty tables give empty tables; columns beyond those of documents are kept, whatever their names, up to the packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import op3_quality, op5_mixing, op7_pii, op8_packing, op10_jaccard_join
from tessera.llm.common import stored, unused

#: Words of a shingle, and the percentage of shared shingles, at which two documents are near duplicates.
SHINGLE, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model accepts (score of 0.7 or more); each row by its own text, so repeated rows go or stay together."""
    model = op3_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "score")
    return op3_quality.score(docs, model, name=name).where(F.col(name) >= op3_quality.CUT).drop(name)


def _mark(*columns: str) -> Column:
    """A key of a row that its columns alone decide, so nothing has to be written for it: ids may be null or shared."""
    return F.xxhash64(*columns)


def _row_key(*columns: str) -> Column:
    """128 bits that tell rows of these columns apart, a null in one from a null in another too."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links (SHINGLE words, SIMILAR % or more): that with the smallest id, null last.

    Texts that merely share an id, or have none, are documents of their own; of repeated rows of one id and text one stays.
    Rows without words are linked with nothing and all stay.
    """
    mark, row, first = (unused(docs, name) for name in ("mark", "row_key", "first_row"))
    marked = docs.withColumn(mark, _mark("doc_id", "text"))
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("doc_id"), F.col(mark).alias("mark"))
    classes = op10_jaccard_join.join(marked.select(key.alias(row), "text"), row, shingle=SHINGLE, num=SIMILAR, den=100)
    kept = classes.where(F.col(row) == F.col("component_id")).groupBy(F.col(f"{row}.mark").alias(mark)).agg((F.max("n_shingles") == 0).alias(row))
    order = F.row_number().over(Window.partitionBy(mark, "doc_id").orderBy("text"))
    return marked.join(kept, mark).withColumn(first, order).where(F.col(row) | (F.col(first) == 1)).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; null texts stay null, and n_chars is that of the new text."""
    return op7_pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number; documents of which it takes less than half go.

    Rows alike in id, source and text share what is taken of them; a null source is a source; rows without words go.
    """
    mark, copies, copy = (unused(docs, name) for name in ("mark", "mixed_copies", "mixed_copy"))
    marked = docs.withColumn(mark, _row_key("doc_id", "source", "text"))
    times = F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int")
    taken = op5_mixing.mix(marked, id_col=mark).groupBy(mark).agg(times.alias(copies)).where(F.col(copies) > 0)
    return marked.join(taken, mark).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row a piece of a document.  A null text is its end id alone; rows of one id are packed each."""
    return op8_packing.packed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: The ranking model, the field, the tokenizer and the packing are no SQL; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
