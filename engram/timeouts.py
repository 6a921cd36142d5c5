"""A time limit for a job of many Spark jobs."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")

CONSOLIDATION_SECONDS = 30 * 60
OVERRIDE = "ENGRAM_CONSOLIDATION_SECONDS"


class JobTimeout(TimeoutError):
    pass


def consolidation_seconds(given: str | None = None) -> float | None:
    """The limit of a consolidation run; None is no limit.

    ``given`` (by default the environment's ``ENGRAM_CONSOLIDATION_SECONDS``) overrides it where it is
    a whole number; 0 means no limit.
    """
    given = os.environ.get(OVERRIDE) if given is None else given
    text = (given or "").strip()
    if not (text.isascii() and text.isdigit()):
        return CONSOLIDATION_SECONDS
    return float(text) if int(text) else None


def within(spark: SparkSession, seconds: float | None, job: Callable[[], T]) -> T:
    """``job()``, or ``JobTimeout`` after ``seconds``; its Spark jobs are cancelled then.

    Jobs are known by a tag of the calling thread. A job that starts after the time is up is
    cancelled as well, until ``job`` gives in.
    """
    if seconds is None:
        return job()
    context, tag, over, done = spark.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        over.set()
        while not done.wait(0.2):
            context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        found = job()
    except Exception as failed:
        if over.is_set():
            raise JobTimeout(f"stopped after {seconds:g} seconds") from failed
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    if over.is_set():
        raise JobTimeout(f"stopped after {seconds:g} seconds")
    return found
