"""How large the batches are in which rows go to Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a batch that goes to a Python worker. Rows alone, which Spark counts, do not bound memory: 10,000 long documents are gigabytes.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose rows then go to Python workers in batches of about BATCH_BYTES, unless the session has a limit of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df
