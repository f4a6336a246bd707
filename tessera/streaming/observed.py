"""What each trigger of a query has seen and dropped, as a table.

The stream carries an observation of its rows; a listener takes it from each progress report, together with the rows that the
query's state operators dropped because they were behind the watermark (an aggregation counts them after its partial sums:
rows of one task, window and key count once). Triggers are told apart by query and number, which go on after a restart from the checkpoint; of a
trigger that ran twice the last report counts.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

NAME = "seen"


def observed(stream: DataFrame, **counts: Column) -> DataFrame:
    """The stream with an observation of its rows and of further counts."""
    return stream.observe(NAME, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])


class TriggerCounts(StreamingQueryListener):
    """Gathers the observations and dropped rows of every trigger that had rows."""

    def __init__(self):
        self.rows: dict[tuple[str, int], dict] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(NAME)
        counts = seen.asDict() if seen is not None else {}
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        if counts.get("rows") or late:
            self.rows[str(p.id), p.batchId] = {**counts, "late": late}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the last report of a query that has ended is in; reports come in order."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"no word of the end of {query.runId}")

    def table(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """(query, trigger, rows, the further counts, late)."""
        schema = ", ".join(["query string", "trigger long", "rows long", *[f"{n} long" for n in names], "late long"])
        return spark.createDataFrame([(q, t, r.get("rows", 0), *[r.get(n) for n in names], r["late"]) for (q, t), r in sorted(self.rows.items())], schema)


def counted(stream: DataFrame, run: Callable[[DataFrame], StreamingQuery], **counts: Column) -> tuple[StreamingQuery, DataFrame]:
    """Runs ``run`` on the observed stream to its end; the query and its table of counts."""
    spark, listener = stream.sparkSession, TriggerCounts()
    spark.streams.addListener(listener)
    try:
        query = run(observed(stream, **counts))
        query.awaitTermination()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    return query, listener.table(spark, list(counts))
