"""Live metrics and bounded runs of a streaming query, from its own progress events (AG23, AG24, SS9).

A :class:`ProgressTotals` listener hears of every micro-batch, however many there are, and adds up its input rows and the
values the query observes. ``observe_latencies`` puts the collector's message counter and latency histogram into a
stream as observed metrics: Spark computes them while the batch runs, no second query reads the data.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from latencylab.functions.columns import rescale_metric_latency
from latencylab.operators.metrics import DEFAULT_HISTOGRAM_BOUNDS

LIVE = "live_latency"


def observe_latencies(records: DataFrame, bounds: Sequence[float] = DEFAULT_HISTOGRAM_BOUNDS, name: str = LIVE) -> DataFrame:
    """``records`` (with ``latency_ms``) observed under ``name``: messages with a latency, the sum of the rescaled latencies, and how
    many lie at or below each bound. A metric of all labels together: an observation has one row a batch."""
    x = F.when(F.col("latency_ms").isNotNull(), rescale_metric_latency("latency_ms"))
    return records.observe(
        name, F.count(x).alias("messages"), F.coalesce(F.sum(x), F.lit(0.0)).alias("latency_sum"),
        *[F.count_if(x <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(bounds)],
    )


class ProgressTotals(StreamingQueryListener):
    """Input rows and observed values of one query, added up batch by batch (a batch that is reported again counts once)."""

    def __init__(self, name: str | None = None):
        self.name = name
        self.rows: dict[int, int] = {}
        self.observed: dict[int, dict] = {}
        self.changed = threading.Condition()
        self.ended = False
        self._run: str | None = None
        self._early: list = []

    def follow(self, query) -> None:
        """The query to listen to; events that came before are kept until this is known."""
        with self.changed:
            self._run = str(query.runId)
            early, self._early = self._early, []
        for p in query.recentProgress:
            self._add(p["batchId"], p["numInputRows"], p.observedMetrics if hasattr(p, "observedMetrics") else {})
        for event in early:
            self._heard(event)

    def _add(self, batch: int, rows: int, observed) -> None:
        with self.changed:
            self.rows[int(batch)] = int(rows)
            if self.name and observed and self.name in observed:
                self.observed[int(batch)] = observed[self.name].asDict()
            self.changed.notify_all()

    def _heard(self, progress) -> None:
        if str(progress.runId) == self._run:
            self._add(progress.batchId, progress.numInputRows, progress.observedMetrics)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self.changed:
            if self._run is None:
                self._early.append(event.progress)
                return
        self._heard(event.progress)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.changed:
            if str(event.runId) == self._run:
                self.ended = True
                self.changed.notify_all()

    def total(self) -> int:
        return sum(self.rows.values())

    def histogram(self, bounds: Sequence[float] = DEFAULT_HISTOGRAM_BOUNDS) -> dict:
        """Messages, latency sum, mean latency and the cumulative count of each bound so far."""
        with self.changed:
            batches = list(self.observed.values())
        n, total = sum(b["messages"] for b in batches), sum(b["latency_sum"] for b in batches)
        return {"messages": n, "latency_sum": total, "avg_latency": total / n if n else None,
                "le": {b: sum(x[f"le_{i}"] for x in batches) for i, b in enumerate(bounds)}}


def await_idle(query, idle_seconds: float = 30.0, max_messages: int | None = None, poll_seconds: float = 1.0,
               totals: ProgressTotals | None = None) -> int:
    """Bounded collection: stop the query after ``idle_seconds`` without input rows,
    or once ``max_messages`` rows were read. Returns the number of rows read.

    The wait ends with the batch event that reaches the bound; ``poll_seconds`` is only how often a query that
    ended by itself is noticed. Batches before this call are counted from the query's recent progress; give ``totals``, added
    as a listener before the query started, where there may be more than Spark keeps there."""
    streams = SparkSession.active().streams
    own = totals is None
    totals = totals or ProgressTotals()
    if own:
        streams.addListener(totals)
    totals.follow(query)
    try:
        seen, since = totals.total(), time.time()
        while query.isActive and not totals.ended:
            with totals.changed:
                totals.changed.wait(max(0.0, min(poll_seconds, since + idle_seconds - time.time())))
            if totals.total() > seen or query.status["isDataAvailable"]:  # a batch in work is not idleness
                seen, since = totals.total(), time.time()
            if (max_messages is not None and seen >= max_messages) or time.time() - since >= idle_seconds:
                break
        query.stop()
        totals.follow(query)  # batches whose event is still on its way
        return totals.total()
    finally:
        if own:
            streams.removeListener(totals)
