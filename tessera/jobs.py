"""Background evaluations: one at a time, each kept under the key of its request."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, Row, SparkSession

from tessera.operators import metrics


class Evaluations:
    """``submit`` gives a key at once; equal requests share one run. Results are a row a metric set, so they are small."""

    def __init__(self, spark: SparkSession, dataset: str, judgments: str):
        self.spark, self.dataset, self.judgments = spark, dataset, judgments
        self._pool, self._lock, self._jobs = ThreadPoolExecutor(1), Lock(), {}

    def submit(self, request: dict, run: Callable[[], DataFrame], qrels: DataFrame) -> str:
        key = metrics.cache_key(request, self.dataset, self.judgments)

        def work() -> Row:
            self.spark.sparkContext.setJobGroup(key, "evaluation", interruptOnCancel=True)
            return metrics.overall(run(), qrels).first()

        with self._lock:
            if key not in self._jobs:
                self._jobs[key] = self._pool.submit(work)
        return key

    def status(self, key: str) -> str:
        job: Future | None = self._jobs.get(key)
        return "unknown" if job is None else "failed" if job.done() and job.exception() else "done" if job.done() else "running"

    def result(self, key: str, timeout: float | None = None) -> dict:
        return self._jobs[key].result(timeout).asDict()

    def cancel(self, key: str) -> None:
        self.spark.sparkContext.cancelJobGroup(key)
