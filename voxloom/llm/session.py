"""Session settings that bound the memory of Python stages."""

from __future__ import annotations

from pyspark.sql import SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of one Arrow batch; a batch always holds one row at least.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, so a batch of long texts stays small."""
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return spark
