"""T-3 / T-7: restarts with a failure budget, and how long they take."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

RESTART_SCHEMA = "attempt int, failed_at double, restart_ms long, error string"
POLL_SECONDS = 0.2


@dataclass
class Restart:
    attempt: int
    failed_at: float            # seconds since the epoch
    restart_ms: int | None      # until the new run's first report; None: it made none
    error: str


def supervise(
    start: Callable[[], StreamingQuery], tolerated: int = 2, pause: float = 0.0
) -> list[Restart]:
    """Run ``start()`` (same checkpoint every time, so a run resumes where the one
    before failed) until it ends by itself.  A failed run is started again up to
    ``tolerated`` times; the next failure is raised.  Returns the restarts."""
    restarts: list[Restart] = []
    query, since = start(), None
    while True:
        try:
            while not query.awaitTermination(POLL_SECONDS):
                since = _measured(query, restarts, since)
            _measured(query, restarts, since)
            return restarts
        except StreamingQueryException as failure:
            since = _measured(query, restarts, since)
            if len(restarts) >= tolerated:
                raise
            restarts.append(Restart(len(restarts) + 1, time.time(), None, str(failure).split("\n")[0]))
            since = time.monotonic()
            time.sleep(pause)
            query = start()


def _measured(query: StreamingQuery, restarts: list[Restart], since: float | None) -> float | None:
    """Note the restart time once the new run has reported a batch."""
    if since is None or not query.recentProgress:
        return since
    restarts[-1].restart_ms = int((time.monotonic() - since) * 1000)
    return None


def restart_frame(spark: SparkSession, restarts: list[Restart]) -> DataFrame:
    return spark.createDataFrame([(r.attempt, r.failed_at, r.restart_ms, r.error) for r in restarts], RESTART_SCHEMA)
