"""Event-triggered runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.sources.targets import resolve_targets


def valid_triggers(events: DataFrame) -> DataFrame:
    """Events whose attributes name a target."""
    target = F.try_element_at(F.col("attributes"), F.lit("target"))
    return events.withColumn("target", target).filter(F.coalesce(F.col("target"), F.lit("")) != "")


def stream_triggers(
    events: DataFrame, targets: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Call ``act`` with the distinct known targets of each micro-batch of events.

    All of a batch's targets run as one job; ``act`` must tolerate a repeated
    batch, as the full run does.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        chosen = resolve_targets(batch.select("target").distinct(), targets)
        if not chosen.isEmpty():
            act(chosen, batch_id)

    return (
        valid_triggers(events)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
