"""A stream of submissions, upserted into a store of project tables.

Each micro-batch is folded to one row per key and committed once; a replay of it changes nothing, and neither does the
same data under other batch numbers, as first time, last time and last payload can be combined in any order and any
grouping. So late and repeated data need no watermark, no state store grows with the table, and no batch rewrites it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from annolytics.streaming.store import FAN_IN, ProjectStore


def stream_upsert(submissions: DataFrame, root: str, checkpoint: str, available_now: bool = False, fan_in: int = FAN_IN) -> StreamingQuery:
    """Start upserting a stream into the annotations of the store at ``root``. ``available_now`` stops when the input is used up.

    After a commit, folders are merged where there are enough of them: the stream needs no stop, and readers go on.
    """
    store = ProjectStore(submissions.sparkSession, root, fan_in)

    def append(batch: DataFrame, batch_id: int) -> None:
        store.upsert({"annotations": batch}, stream=checkpoint, batch=batch_id)
        store.compact("annotations")

    writer = submissions.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The annotation table that has been streamed to ``root``."""
    return ProjectStore(spark, root).read("annotations")
