"""End a stream between two batches: the running one is finished, the next one is left for the restart."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class StopAsked(Exception):
    """Raised in place of a batch after a stop was asked for; the batch stays uncommitted and comes again after a restart."""


class OrderlyStop(StreamingQueryListener):
    """Asks a query to stop, by ``ask`` or by a mark that is looked for after every batch and while waiting.

    A mark is anything that another process can set, such as a file (``file_mark``). ``score_stream`` registers it before the query starts, ``wait`` takes
    it away.
    """

    def __init__(self, marked: Callable[[], bool] = lambda: False):
        self.marked = marked
        self.asked = threading.Event()
        self.finished: dict[str, list[int]] = {}  # query id: its finished batches

    def ask(self) -> None:
        self.asked.set()

    def between(self, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """``write`` for batches that begin before the stop is asked for; it is never left half done."""

        def gated(batch: DataFrame, batch_id: int) -> None:
            if self.asked.is_set():
                raise StopAsked(f"batch {batch_id} is left for the restart")
            write(batch, batch_id)

        return gated

    def wait(self, query: StreamingQuery, poll: float = 1.0) -> None:
        """Return when the query has ended by itself or by the stop. Its own failures are raised."""
        try:
            while query.isActive and not query.awaitTermination(poll):
                self._look()
                status = query.status
                # from here on no batch is let in, so a query that has none in work has nothing to lose
                if self.asked.is_set() and not (status["isTriggerActive"] and status["isDataAvailable"]):
                    query.stop()
        except StreamingQueryException as error:
            if StopAsked.__name__ not in str(error):
                raise
        finally:
            SparkSession.active().streams.removeListener(self)

    def _look(self) -> None:
        if self.marked():
            self.ask()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.finished.setdefault(str(event.progress.id), []).append(event.progress.batchId)
        self._look()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def file_mark(spark: SparkSession, path: str) -> Callable[[], bool]:
    """Whether a file is there, on any file system the cluster knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return lambda: place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
