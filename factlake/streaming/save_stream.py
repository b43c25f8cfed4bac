"""Saving from a stream: each micro-batch runs through the batch operator against the stored snapshot.

Batches are keyed by their id, so a batch that is run again after a failure replaces its own output and starts from the same
snapshot as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.registry import Saver
from ..operators.save import checked, committed


def save_stream(requests: DataFrame, path: str, savers: dict[str, Saver], trigger: dict | None = None) -> StreamingQuery:
    """Starts saving streaming requests(seq, saver, key, payload, app_id); seq must grow from batch to batch for a key.

    Results go to ``path``/results/batch=N, the snapshot after batch N to ``path``/snapshot/batch=N. Requests are checked once and written, since
    results and snapshot both come from them. The snapshots of the last two batches stay: a batch that is run again needs the one before it.
    """

    def save(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/snapshot/batch={n - 1}") if n else None
        checked(batch, savers).write.mode("overwrite").parquet(f"{path}/checked/batch={n}")
        results, snapshot = committed(spark.read.parquet(f"{path}/checked/batch={n}"), before)
        results.write.mode("overwrite").parquet(f"{path}/results/batch={n}")
        snapshot.write.mode("overwrite").parquet(f"{path}/snapshot/batch={n}")
        for name, last in (("checked", n), ("snapshot", n - 2)):
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/batch={last}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return requests.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
