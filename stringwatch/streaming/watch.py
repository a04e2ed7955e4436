"""What a stream leaves out: rows without time and rows behind the watermark.

Detectors count rows without time in an observed metric; rows that come too late
are counted by the engine's stateful operators. A listener sums both up over the
batches of every query, so that each input row can be accounted for.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

QUALITY, WITHOUT_TIME = "stream_quality", "rows_without_time"


@dataclass
class LeftOut:
    """Numbers of one query: rows read, without time, and too late."""

    input_rows: int = 0
    without_time: int = 0
    late: int = 0


class StreamWatch(StreamingQueryListener):
    """Listener with the numbers of every query by its run id; ``with`` adds and removes it."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark
        self.queries: dict[str, LeftOut] = defaultdict(LeftOut)
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def __enter__(self) -> "StreamWatch":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def of(self, query, seconds: float = 30) -> LeftOut:
        """Numbers of a query that has ended, once its last event has come."""
        run = str(query.runId)
        if not self.ended[run].wait(seconds):
            raise TimeoutError("the end of the query was not announced")
        return self.queries[run]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        numbers = self.queries[str(progress.runId)]
        numbers.input_rows += progress.numInputRows
        observed = progress.observedMetrics.get(QUALITY)
        numbers.without_time += (observed[WITHOUT_TIME] or 0) if observed is not None else 0
        numbers.late += sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()
