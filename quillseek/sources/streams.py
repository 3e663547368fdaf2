"""Files as a stream, drained once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def drained(spark: SparkSession, like: DataFrame, path: str, change: Callable[[DataFrame], DataFrame], complete: bool = False) -> DataFrame:
    """All that a stream over the Parquet files at path gives, after `change`, as a stored table.

    complete: the whole result at the end, for aggregations, instead of rows as they come.

    The stream writes Parquet beside its checkpoint in the folder of spark.checkpoint.dir, or in a folder of
    its own if that is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        folder = tempfile.mkdtemp(prefix="quillseek-stream-")
    here = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    # a glob reads one file as well as a folder of part files
    rows = spark.readStream.schema(like.schema).parquet(f"{path}*")
    out = change(rows)
    start = out.writeStream.option("checkpointLocation", f"{here}/state").trigger(availableNow=True)
    if complete:
        query = start.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{here}/rows")).start()
    else:
        query = start.format("parquet").option("path", f"{here}/rows").start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{here}/rows")
