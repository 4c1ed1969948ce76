"""Runs that can be cancelled while they work: each has a job tag, and the queue's cancel flags interrupt by tag."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Hashable, Iterable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


def run_all(spark: SparkSession, runs: dict[Hashable, Callable], flagged: Callable[[], Iterable], poll: float = 0.5) -> dict[Hashable, tuple[str, object]]:
    """Status and result of each run: completed with what it returned, failed with its error, or cancelled.

    The runs work side by side. flagged(), asked every `poll` seconds, names those to cancel: their Spark jobs are
    interrupted, and no others. A run that ends just as its flag is set is cancelled too, and its result dropped.
    """
    # A session's own tags are known to the thread that set them only; those of the context are known to all.
    context, mark, out = spark.sparkContext, uuid.uuid4().hex, {}
    tags = {run: f"run-{mark}-{k}" for k, run in enumerate(runs)}

    def work(run, action) -> None:
        context.addJobTag(tags[run])
        try:
            out[run] = "completed", action()
        except Exception as e:  # whatever it is belongs to this run
            out[run] = "failed", e
        finally:
            context.removeJobTag(tags[run])

    threads = {run: InheritableThread(target=work, args=(run, action), daemon=True, session=spark) for run, action in runs.items()}
    for thread in threads.values():
        thread.start()
    wanted: set = set()
    while any(t.is_alive() for t in threads.values()):
        wanted |= set(flagged()) & set(runs)
        for run in wanted:
            if threads[run].is_alive():
                context.cancelJobsWithTag(tags[run])  # again until it stops: a job may have started after the last time
        time.sleep(poll)
    wanted |= set(flagged()) & set(runs)
    return {run: ("cancelled", None) if run in wanted else out[run] for run in runs}
