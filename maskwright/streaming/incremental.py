"""New documents into one dictionary, batch by batch, with Structured Streaming.

Each micro-batch is detected, its new keys are numbered behind the stored ones
and its masked rows and the dictionary are written under the batch's number. A
replayed batch starts from the dictionary of the batch before it and overwrites
its own output, so aliases and rows come out the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aliases, rewrite
from ..operators.scratch import cleared, written
from ..operators.spans import occurrences, with_spans


class Sink:
    def __init__(self, spark: SparkSession, root: str, detectors, key: str = "doc_id", allow=frozenset()):
        self.spark, self.root, self.detectors, self.key, self.allow = spark, root.rstrip("/"), detectors, key, allow

    def _batches(self) -> list[int]:
        """Numbers of the batches whose dictionary is whole, in order."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        p = hadoop.Path(f"{self.root}/entries/*/_SUCCESS")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or ())

    def dictionary(self, before: int | None = None) -> DataFrame:
        """Entries as the last batch under ``before``, or the last of all, left them."""
        done = [n for n in self._batches() if before is None or n < before]
        if done:
            return self.spark.read.schema(aliases.ENTRIES).parquet(f"{self.root}/entries/batch={done[-1]}")
        return aliases.empty_entries(self.spark)

    def __call__(self, batch: DataFrame, n: int) -> None:
        """Rows are rewritten from their own spans, so the key may be null or repeated; it only orders what is numbered."""
        with cleared(self.spark):
            docs = written(with_spans(batch.select(F.col(self.key), "text"), self.detectors, "text", self.allow), "batch")
            occ = occurrences(docs, [self.key]).withColumn("file_ord", F.col(self.key)).withColumn("rel", F.col(self.key).cast("string"))
            entries = aliases.assign(occ, self.dictionary(n), aliases.empty_entities(self.spark))
            entries.write.mode("overwrite").parquet(f"{self.root}/entries/batch={n}")
            entries = self.spark.read.schema(aliases.ENTRIES).parquet(f"{self.root}/entries/batch={n}")
            rewrite.pseudonymise(docs, entries).write.mode("overwrite").parquet(f"{self.root}/masked/batch={n}")


def run_available(stream: DataFrame, sink: Sink) -> None:
    """Work off all input that is there, then stop."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{sink.root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()


def hits_per_window(stream: DataFrame, detectors, size: str = "1 hour", late: str = "10 minutes", time: str = "ts", text: str = "text") -> DataFrame:
    """Values found per category and event-time window, for streams that carry a time."""
    found = with_spans(stream.withWatermark(time, late), detectors, text)
    return found.select(time, F.explode("spans.category").alias("category")).groupBy(F.window(time, size), "category").count()
