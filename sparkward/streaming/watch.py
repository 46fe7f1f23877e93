"""The scan as a stream: every micro-batch of new files goes through the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import findings_of
from ..sources.files import from_table


def watch(rows: DataFrame, path: str, text: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the findings of every batch of a streaming (path, text) table to Parquet at ``out``.

    Findings are keyed by file, so a batch needs no state from the ones before; a
    replayed batch overwrites its own folder, so each file counts once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        files = from_table(batch, F.col(path), F.col(text))
        findings_of(files).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
