"""Line dedup over batches that come one after the other, with levelled sorted runs of line hashes; DataFrame functions alone.

A run is a table with a row for each key of a batch, in buckets and sorted by hash: in how many documents the key is, and which document
keeps it, if the batch was the first to hold it.  A new batch is merge-joined with the runs there are: keys that no run has (the
anti join) are given a keeper, of the others only the count goes on, and the batch becomes a run of its own.  FANOUT runs of a
level are merged into one of the next before another batch comes, so a key is rewritten once a level and a batch meets few runs.
As all runs have the same buckets, one for each partition of the session's shuffles, merges and anti joins move no row of a run.

So the first batch to hold a line keeps it, and within a batch the largest id.  ``deduplicated`` deals a table's documents to batches
by descending id, and thereby the largest id of all keeps a line.  Rows that share an id are one document, and so are those without an
id, which come last; each row loses its own lines.  A null text is one empty line.  Repeated rows stay repeated; an empty table gives
an empty result; of other columns none matters.  A line is known by 128 bits.  A text is split in one task; a line that stands in
a third of all documents is summed before it is shuffled and dropped by a join that Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, remove, shared_dir, shuffle_width, stored, tidy, unused

#: Keys shorter than SHORT code points always stay; others lose lines from so many documents on.
SHORT, DOCUMENTS = 40, 5
#: Runs of a level that are merged into one of the next; batches that a table is dealt to.
FANOUT, BATCHES = 2, 4
#: What is stripped at both ends of a line (fixed values: \x20 and \x09 to \x0D).
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def key_of(line: Column) -> Column:
    """A line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart, null from empty too."""
    return F.xxhash64(text.isNull(), text)


def keyed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT) -> DataFrame:
    """h1, h2, id, row, pos of every line whose key has so many code points; row and id together name a text."""
    # hashed in a step of its own, else Spark would hash the text again for each line
    own = df.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("row"), split_lines(F.col(text_col)).alias("lines"))
    own = own.select("id", "row", F.posexplode("lines").alias("pos", "line"))
    keys = own.select("id", "row", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= short)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key", F.length("key")).alias("h2"), "id", "row", "pos")


class LineRuns:
    """Levels of sorted runs in the shared folder: h1, h2, docs, fresh, keeper.  A run is written once and read as it is, so a lost
    executor costs a re-read."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, max(2, fanout), shuffle_width(spark)
        self.levels: list[list[DataFrame]] = []

    def _written(self, rows: DataFrame) -> DataFrame:
        path = shared_dir(self.spark, "line-run")
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        run.stored_at, run.called = path, name
        return run

    def _gone(self, runs: list[DataFrame]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE {r.called}")
            remove(self.spark, r.stored_at)
        tidy(self.spark)

    def runs(self) -> list[DataFrame]:
        return [r for level in reversed(self.levels) for r in level]

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one.  Counts add up, and the one that met a key first has its keeper."""
        other = b.select(*KEY, F.col("docs").alias("docs_b"), F.col("fresh").alias("fresh_b"), F.col("keeper").alias("keeper_b"))
        both = a.join(other, KEY, "full_outer")
        zero, no = F.lit(0), F.lit(False)
        first = F.coalesce("fresh", no)
        return both.select(*KEY, (F.coalesce("docs", zero) + F.coalesce("docs_b", zero)).alias("docs"), (first | F.coalesce("fresh_b", no)).alias("fresh"), F.when(first, F.col("keeper")).otherwise(F.col("keeper_b")).alias("keeper"))

    def _compacted(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                old, self.levels[k] = self.levels[k], []
                self.levels[k + 1].append(self._written(reduce(self.merged, old)))
                self._gone(old)

    def add(self, lines: DataFrame) -> DataFrame:
        """The batch's own run; of its rows those marked fresh are the keys that no earlier batch had."""
        self._compacted()
        # distinct ids are counted in two steps, so a line of very many documents is dealt by document first
        one = lines.groupBy(*KEY).agg((F.countDistinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"), F.max("id").alias("keeper"))
        seen = []
        for r in self.runs():
            seen.append(unused(one, f"seen{len(seen)}"))
            one = one.join(r.select(*KEY, F.lit(True).alias(seen[-1])), KEY, "left")
        fresh = reduce(Column.__and__, [F.col(s).isNull() for s in seen], F.lit(True))
        run = self._written(one.select(*KEY, "docs", fresh.alias("fresh"), F.when(fresh, F.col("keeper")).alias("keeper")))
        self.levels = self.levels or [[]]
        self.levels[0].append(run)
        return run

    def frequent(self, documents: int = DOCUMENTS) -> DataFrame:
        """h1, h2, docs, keeper of keys in so many documents."""
        return reduce(self.merged, self.runs()).where(F.col("docs") >= documents).select(*KEY, "docs", "keeper")

    def close(self) -> None:
        self._gone(self.runs())
        self.levels = []


def by_descending_id(lines: DataFrame, batches: int) -> Column:
    """0 for the largest ids, up to batches - 1 for the smallest and null: ranges of about equal numbers of lines."""
    cuts = lines.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    return sum((F.coalesce(F.col("id") < F.lit(c), F.lit(True)).cast("int") for c in sorted(set(cuts or []))), F.lit(0))


def dropped_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """id, row, gone (places of lines) of every text that loses lines.  Rows alike in id and text share theirs."""
    lost = lines.join(frequent, KEY).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, documents: int = DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """id, n_lines, n_dropped and the text that is left for each row."""
    spark = df.sparkSession
    lines = keyed_lines(df, id_col, text_col, short)
    dealt = stored(lines.withColumn("batch", by_descending_id(df.select(F.col(id_col).alias("id")), batches)), "lines")
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(dealt.where(F.col("batch") == k).drop("batch"))
    lost = stored(dropped_lines(dealt, runs.frequent(documents)), "dropped")
    runs.close()
    discard(dealt)
    # lines are split before the join, as an expression that a lambda refers to would be evaluated for each line
    own = df.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("row"), split_lines(F.col(text_col)).alias("lines"))
    both = own.join(lost.toDF("id_", "row_", "gone"), (F.col("row") == F.col("row_")) & F.col("id").eqNullSafe(F.col("id_")), "left")
    # a difference of sets of numbers is linear, however many lines a text loses
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda p: F.get("lines", p)))
    return both.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), F.array_join(left, "\n").alias("kept"))


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.r, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id, r"""
