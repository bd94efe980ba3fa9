"""Token counts by prefix dynamic programming.

``token_counts`` keeps, for each text, the exact token count at every prefix and answers truncation and budget
questions from that table without encoding anything, whatever the text's characters; special tokens inside a text count as
the library counts them.  Null texts count as empty; null ids are kept as they are; repeated rows stay repeated; other
columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches
from tessera.llm.bpe_words import PrefixCounts

_LOADED: dict[str, PrefixCounts] = {}


def counts_for(path: str) -> PrefixCounts:
    """One table of word counts for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounts(path)
    return _LOADED[path]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens, and fit_chars: how many leading characters stay within the budget of tokens.

    An empty table gives an empty result, a null or empty text 0, 0 and 0.
    """
    bounded_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches):
        import pyarrow as pa

        counts = counts_for(path)
        for b in batches:
            n_bytes, n_tokens, fit = [], [], []
            for s in b.column(1):
                text = s.as_py() or ""
                t = counts.table(text)
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(t.total)
                fit.append(t.longest(budget))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fit, pa.int64())], ["id", "n_bytes", "n_tokens", "fit_chars"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, fit_chars long").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=512)
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
