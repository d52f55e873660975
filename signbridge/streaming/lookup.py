"""Sign lookup on a stream of sign rows (a by-product, not a reference operator).

The reference has no streaming code. Its row-local expressions and the vocabulary lookup
are stream-static operations, so the same functions run unchanged on a streaming
DataFrame; this module only wires them to ``readStream`` / ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vocab as vc


def lookup_stream(signs_stream: DataFrame, vocab: DataFrame) -> DataFrame:
    """Streaming sign rows -> units (stream-static left join on the symbol key)."""
    keyed = vc.parse_sign_rows(signs_stream)
    lex = vocab.select(F.col("symbol").alias("key"), F.col("canonical").alias("_canon"))
    return keyed.join(lex, "key", "left") \
        .withColumn("word", F.coalesce(F.col("_canon"), F.lit("<unk>"))).drop("_canon")


def start_lookup(spark, source_dir: str, schema: str, vocab: DataFrame, sink_dir: str, checkpoint_dir: str,
                 trigger_once: bool = True):
    """Run ``lookup_stream`` from Parquet files in ``source_dir`` into Parquet in ``sink_dir``.

    Each micro-batch is appended by ``foreachBatch``; progress lives in ``checkpoint_dir``
    (a shared folder on a cluster) so a restarted query resumes where it stopped."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    units = lookup_stream(stream, vocab)

    def write_batch(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("append").parquet(sink_dir)

    writer = units.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()
