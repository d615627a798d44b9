"""Calls of a judge from tasks: bounded in number, each with a deadline, tried again only where that can help.

A judge is a function from a prompt to a reply that may be slow, refuse, or be down.  A call
that outlives its deadline is given up, though its thread may run on; a task that has seen
``max_outages`` calls in a row time out or fail for good takes the judge for dead and asks no
more, so that a dead judge costs a bounded time.  Every prompt comes back with an outcome.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ripplespark.config import Rerank

Ask = Callable[[str], str | None]

#: HTTP codes after which another try may succeed.
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)
FIRST_WAIT_S, LONGEST_WAIT_S, LONGEST_TOLD_S = 0.5, 8.0, 60.0
MAX_OUTAGES = 5
PER_WORKER = 8
OUTCOMES = ("answered", "timeout", "refused", "failed", "skipped")


class JudgeError(Exception):
    """What a judge says instead of a reply: an HTTP code, and seconds to wait if it told them."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


class Answer(NamedTuple):
    reply: str | None
    outcome: str
    tries: int


def within(call: Callable[[], str | None], seconds: float) -> str | None:
    """The result of a call, or TimeoutError after so many seconds."""
    out: list = []
    done = threading.Event()

    def run() -> None:
        try:
            out.append((call(), None))
        except BaseException as error:  # noqa: BLE001  handed to the caller
            out.append((None, error))
        done.set()

    threading.Thread(target=run, daemon=True).start()
    if not done.wait(seconds):
        raise TimeoutError(f"no reply within {seconds} s")
    value, error = out[0]
    if error is not None:
        raise error
    return value


def answer(ask: Ask, prompt: str, cfg: Rerank, wait: Callable[[float], None] = time.sleep) -> Answer:
    """One prompt's reply. Codes that mean the prompt itself is refused end at once; whatever else is tried again."""
    outcome = "failed"
    for n in range(cfg.max_retries + 1):
        told = None
        try:
            return Answer(within(lambda: ask(prompt), cfg.timeout_s), "answered", n + 1)
        except TimeoutError:
            outcome = "timeout"
        except JudgeError as error:
            if error.status is not None and error.status not in RETRYABLE:
                return Answer(None, "refused", n + 1)
            outcome, told = "failed", error.retry_after
        except Exception:  # noqa: BLE001  a judge may fail in any way
            outcome = "failed"
        if n < cfg.max_retries:
            wait(min(LONGEST_TOLD_S, told) if told is not None else min(LONGEST_WAIT_S, FIRST_WAIT_S * 2**n))
    return Answer(None, outcome, cfg.max_retries + 1)


class Pool:
    """So many calls at once; after ``max_outages`` prompts in a row without an answer no more are made."""

    def __init__(self, ask: Ask, cfg: Rerank, size: int, max_outages: int = MAX_OUTAGES, wait: Callable[[float], None] = time.sleep):
        self.ask, self.cfg, self.wait, self.max_outages = ask, cfg, wait, max_outages
        self.threads = ThreadPoolExecutor(max(1, size))
        self.outages, self.lock = 0, threading.Lock()

    def one(self, prompt: str | None) -> Answer:
        if prompt is None or self.outages >= self.max_outages:
            return Answer(None, "skipped", 0)
        got = answer(self.ask, prompt, self.cfg, self.wait)
        with self.lock:
            self.outages = 0 if got.outcome in ("answered", "refused") else self.outages + 1
        return got

    def all(self, prompts: list[str | None]) -> list[Answer]:
        return list(self.threads.map(self.one, prompts))


def replied(prompts: DataFrame, ask: Ask, cfg: Rerank | None = None, max_outages: int = MAX_OUTAGES, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rows with a ``prompt``, and reply, outcome and tries: at most ``concurrency`` calls at once over all tasks.

    A null prompt is skipped. Rows stay whatever becomes of their calls.
    """
    cfg = cfg or Rerank()
    # as many tasks as can run at once share the calls, as a task's own threads take turns on one core
    tasks = min(max(1, cfg.concurrency), max(1, prompts.sparkSession.sparkContext.defaultParallelism))
    each = min(PER_WORKER, max(1, cfg.concurrency) // tasks)
    tasks = max(1, cfg.concurrency) // each
    at = prompts.columns.index("prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(ask, cfg, each, max_outages, wait)
        for batch in batches:
            got = pool.all(batch.column(at).to_pylist())
            more = [pa.array([a.reply for a in got], pa.string()), pa.array([a.outcome for a in got], pa.string()), pa.array([a.tries for a in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "reply", "outcome", "tries"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.repartition(tasks).mapInArrow(run, f"{kinds}, reply string, outcome string, tries int")
