"""A kept inverted index of the policy library, appended per batch.

Three tables per batch, in folders of their own, so that a batch that is run again replaces
only itself; a line in the commit log makes a batch visible:

* ``documents``: key, length, attributes and text, in folders by a hash of the key;
* ``postings``: (term, key, tf, length, attributes), in folders by a hash of the term and
  sorted by term inside a file, so that a search opens the folders of its terms and of these the
  row groups that hold them;
* ``counts``: documents and words per attribute values. They add up over batches; a document
  that comes again in a later batch retires its earlier edition (``retired``) and is counted off.

A search reads postings of its own terms and a few counts, and no text. Terms are counted inside the
row: sorted once, a term's count is the distance between the ends of two runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.text import tokens
from ledgerwatch.operators.state import BatchLog

K1, B = 1.2, 0.75
ATTRIBUTES = ("domain", "doc_type", "doc_title")
BUCKETS = 16


def term_counts(text: Column) -> Column:
    """Array of (term, tf) of a text, from one sort of its words."""

    def runs(words: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == F.size(words)) | (F.get(words, i - 1) != F.get(words, i)))
        # ends is bound as well, so that neither array is computed again for each element
        return F.flatten(
            F.transform(
                F.array(ends),
                lambda e: F.transform(
                    e, lambda last, i: F.struct(F.get(words, last - 1).alias("term"), (last - F.when(i > 0, F.get(e, i - 1)).otherwise(0)).cast("bigint").alias("tf"))
                ),
            )
        )

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.flatten(F.transform(F.array(F.sort_array(tokens(text))), lambda words: F.when(F.size(words) > 0, runs(words)).otherwise(none)))


class SearchIndex:
    """``key`` identifies a document; ``attributes`` are the columns that a search can filter by."""

    def __init__(self, spark: SparkSession, root: str, key: str = "section", text: str = "chunk_text", attributes: tuple[str, ...] = ATTRIBUTES, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.text, self.attributes, self.buckets = spark, root.rstrip("/"), key, text, attributes, buckets
        self.log = BatchLog(spark, f"{self.root}/_commits")
        labels = ", ".join(f"{a} string" for a in attributes)
        self._schemas = {
            "documents": f"{key} string, dl bigint, {labels}, {text} string, batch_id bigint, bucket int",
            "postings": f"term string, {key} string, tf bigint, dl bigint, {labels}, batch_id bigint, bucket int",
            "counts": f"{labels}, n bigint, words bigint, batch_id bigint",
            "retired": f"{key} string, edition bigint, batch_id bigint",
        }

    def _bucket(self, column: Column | str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, batches: list[int]) -> DataFrame:
        """A table over the committed batches."""
        paths = [f"{self.root}/{name}/batch_id={i}" for i in batches]
        if not paths:
            return self.spark.createDataFrame([], self._schemas[name])
        return self.spark.read.schema(self._schemas[name]).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _write(self, rows: DataFrame, name: str, batch_id: int, *order: str) -> DataFrame:
        path = f"{self.root}/{name}/batch_id={batch_id}"
        if order:
            # rebalance: the folder of a term that most documents hold is split over several files
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self._schemas[name].rpartition(", batch_id")[0] + (", bucket int" if order else "")).parquet(path)

    def append(self, docs: DataFrame, batch_id: int) -> None:
        """Index a batch of documents (one row per key); a committed batch is left as it is."""
        batches = self.log.committed()
        if batch_id in batches:
            return
        labels = [F.col(a).cast("string").alias(a) for a in self.attributes]
        length = F.coalesce(F.size(tokens(F.col(self.text))), F.lit(0)).cast("bigint")
        rows = docs.select(F.col(self.key), length.alias("dl"), *labels, F.col(self.text), self._bucket(self.key).alias("bucket"))
        batch = self._write(rows, "documents", batch_id, self.key)
        posted = batch.select(F.explode(term_counts(F.col(self.text))).alias("p"), self.key, "dl", *self.attributes)
        posted = posted.select("p.term", self.key, "p.tf", "dl", *self.attributes, self._bucket("p.term").alias("bucket"))
        self._write(posted, "postings", batch_id, "term", self.key)
        # the folders of a batch's keys are all that is read of earlier batches
        earlier = self._current("documents", batches).join(batch.select("bucket", self.key), ["bucket", self.key], "left_semi")
        retired = self._write(earlier.select(self.key, F.col("batch_id").alias("edition")), "retired", batch_id)
        gone = earlier.join(retired.withColumnRenamed("edition", "batch_id"), [self.key, "batch_id"], "left_semi")
        change = batch.select(*self.attributes, "dl", F.lit(1).alias("sign")).unionByName(gone.select(*self.attributes, "dl", F.lit(-1).alias("sign")))
        counts = change.groupBy(*self.attributes).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("words"))
        self._write(counts, "counts", batch_id)
        self.log.commit(batch_id)

    def _current(self, name: str, batches: list[int]) -> DataFrame:
        """A table without the rows of editions that a later batch has replaced."""
        rows = self._read(name, batches)
        if len(batches) < 2:
            return rows
        retired = self._read("retired", batches).select(self.key, F.col("edition").alias("batch_id"))
        return rows.join(retired, [self.key, "batch_id"], "left_anti")

    def _admitted(self, rows: DataFrame, wanted: dict[str, str | list[str] | None]) -> DataFrame:
        for name, value in wanted.items():
            if name not in self.attributes:
                raise ValueError(f"no such attribute: {name}")
            if value is not None:
                rows = rows.where(F.col(name).isin([value] if isinstance(value, str) else value))
        return rows

    def postings(self, terms: list[str], batches: list[int] | None = None, **attributes: str | list[str] | None) -> DataFrame:
        """Postings of some terms: only their folders are listed, and only row groups that hold them read."""
        rows = self._current("postings", self.log.committed() if batches is None else batches)
        buckets = self.spark.sql("SELECT 1").select(F.array_distinct(F.array(*[self._bucket(F.lit(t)) for t in terms]))).first()[0]  # folds: no job
        return self._admitted(rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)), attributes)

    def search(self, queries: DataFrame, terms: list[str], k: int = 6, bounded: bool = False, **attributes: str | list[str] | None) -> DataFrame:
        """The k best documents per query (query_id, query_text) by BM25: query_id, key, score, rank.

        ``terms`` are all terms that the queries may hold. Postings are shuffled once, by
        document; queries meet them there, so what moves does not grow with the queries, and
        only k rows per query and task go on. ``bounded``: the caller knows that there are few
        different queries, and their weights are broadcast; otherwise Spark decides by their size.
        """
        batches = self.log.committed()
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
        posted = self.postings(terms, batches, **attributes)
        totals = self._admitted(self._read("counts", batches), attributes).agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("mean_dl"))
        corpus = totals.select(F.struct("n", "mean_dl")).scalar()
        frequency = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = asked.join(frequency, "term").select("query_id", "term", F.log(1 + (corpus["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / corpus["mean_dl"])
        part = F.col("idf") * (F.col("tf") * F.lit(K1 + 1)) / (F.col("tf") + norm)
        weights = F.broadcast(weights) if bounded else weights
        by_document = posted.select("term", self.key, "tf", "dl").repartition(self.key)
        scored = by_document.join(weights, "term").groupBy("query_id", self.key).agg(F.round(F.sum(part), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def texts(self, hits: DataFrame) -> DataFrame:
        """key, attributes and text of the documents hit; folders without a hit are not read."""
        wanted = hits.select(self.key).distinct().select(self.key, self._bucket(self.key).alias("bucket"))
        return self._current("documents", self.log.committed()).join(wanted, ["bucket", self.key]).select(self.key, *self.attributes, self.text)
