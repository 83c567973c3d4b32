"""Live counters: measures that Spark takes of rows as they pass, added up while a query runs."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def page_counts(df: DataFrame) -> list[Column]:
    """Pages, and of them the failed and (where rows tell it) the retried ones."""
    more = [F.count_if("retried").alias("retried")] if "retried" in df.columns else []
    return [F.count("*").alias("pages"), F.count_if(F.col("status") == "failed").alias("failed"), *more]


def observed(df: DataFrame, measures: list[Column], name: str = "progress") -> tuple[DataFrame, Observation]:
    """The same rows, and what the first action on them has counted; its ``get`` waits for that action."""
    seen = Observation(name)
    return df.observe(seen, *measures), seen


class Counters(StreamingQueryListener):
    """Sums of the measures that streams observe under a name, after each of their batches.

    ``spark.streams.addListener`` starts it. A batch that is reported again, as after a restart, counts
    once.
    """

    def __init__(self, name: str):
        self.name, self._batches, self._lock, self.history = name, {}, Lock(), []

    def watch(self, stream: DataFrame, measures: list[Column]) -> DataFrame:
        """The stream with the measures taken of each of its batches."""
        return stream.observe(self.name, *measures)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is not None:
            with self._lock:
                self._batches[str(p.id), p.batchId] = row.asDict()
            self.history.append(self.totals())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        """The sums over all batches so far."""
        out: dict[str, int] = {}
        with self._lock:
            for own in self._batches.values():
                for k, v in own.items():
                    out[k] = out.get(k, 0) + (v or 0)
        return out
