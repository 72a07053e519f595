"""The model call as an injected function.

``fn(prompt: str) -> str`` is applied with ``mapInPandas``; a task has up to ``in_flight`` calls under
way, so the concurrency is that times the tasks. A call that takes longer than ``timeout_seconds``
counts as failed. Failures are retried a fixed number of times with a fixed wait and then become an
error row instead of failing the job. Rows leave in their order, as soon as a few are answered.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _limited(fn: Callable[[str], str], prompt: str, seconds: float | None) -> str:
    """``fn(prompt)``, or TimeoutError after ``seconds``; a call that hangs is left behind in a thread that ends with the worker."""
    if seconds is None:
        return fn(prompt)
    answer: Future = Future()

    def call():
        try:
            answer.set_result(fn(prompt))
        except BaseException as e:  # noqa: BLE001
            answer.set_exception(e)

    threading.Thread(target=call, daemon=True).start()
    try:
        return answer.result(seconds)
    except TimeoutError:
        if answer.done():  # the call's own error
            raise
        raise TimeoutError(f"no answer within {seconds} s") from None


def _attempts(fn: Callable[[str], str], prompt: str, retries: int, wait_seconds: float, seconds: float | None) -> tuple:
    """(answer, error, attempts) of one prompt."""
    for attempt in range(1, retries + 1):
        try:
            return _limited(fn, prompt, seconds), None, attempt
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if attempt < retries and wait_seconds:
                time.sleep(wait_seconds)
    return None, error, retries


def _answers(batches, prompt_col: str, work: Callable[[str], tuple], names: tuple[str, ...], in_flight: int):
    """Rows with the columns that ``work`` gives for their prompts, in order, up to ``in_flight`` prompts at a time."""
    pool, waiting = ThreadPoolExecutor(in_flight), deque()

    def answered():
        """The rows at the head that are answered, one at least, as pieces of their batches."""
        waiting[0][2].result()
        rows = []
        while waiting and len(rows) < in_flight and waiting[0][2].done():
            rows.append(waiting.popleft())
        while rows:
            pdf, first, _ = rows[0]
            mine = [r[2].result() for r in rows if r[0] is pdf]
            rows = rows[len(mine):]
            yield pdf.iloc[first:first + len(mine)].assign(**{n: list(c) for n, c in zip(names, zip(*mine))})

    try:
        for pdf in batches:
            for i, prompt in enumerate(pdf[prompt_col]):
                if len(waiting) >= 2 * in_flight:  # calls under way, and as many to follow them
                    yield from answered()
                waiting.append((pdf, i, pool.submit(work, prompt)))
        while waiting:
            yield from answered()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def apply_scorer(df: DataFrame, fn: Callable[[str], str], prompt_col: str = "prompt", out_col: str = "response",
                 retries: int = 3, wait_seconds: float = 2.0, partitions: int | None = None, in_flight: int = 1,
                 timeout_seconds: float | None = None) -> DataFrame:
    """Y1 + Y2: adds ``out_col`` (null on failure), ``error`` and ``attempts``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType()),
                                              T.StructField("error", T.StringType()),
                                              T.StructField("attempts", T.IntegerType())])

    def run(batches):
        yield from _answers(batches, prompt_col, lambda p: _attempts(fn, p, retries, wait_seconds, timeout_seconds),
                            (out_col, "error", "attempts"), in_flight)

    src = df.repartition(partitions) if partitions else df
    return src.mapInPandas(run, schema)


def score_with_reprompt(df: DataFrame, fn: Callable[[str], str], parse: Callable[[str], str | None],
                        rewrite: Callable[[str], str], prompt_col: str = "prompt", passes: int = 1,
                        retries: int = 3, wait_seconds: float = 2.0, partitions: int | None = None, in_flight: int = 1,
                        timeout_seconds: float | None = None) -> DataFrame:
    """Score, then re-prompt rows whose reply does not parse, at most ``passes`` times.

    All passes of a row run one after another where the row is, so a scorer that answers
    differently each time is asked once a pass and no row is lost or doubled. ``parse`` and
    ``rewrite`` are Python callables (``parse`` returns null for an unparsable reply). Output
    adds ``response``, ``error``, ``attempts``, ``parsed`` and ``passes_used``.
    """
    schema = T.StructType(df.schema.fields + [
        T.StructField("response", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()), T.StructField("parsed", T.StringType()),
        T.StructField("passes_used", T.IntegerType())])

    def ask(prompt: str) -> tuple:
        for used in range(passes + 1):
            reply, error, attempts = _attempts(fn, prompt, retries, wait_seconds, timeout_seconds)
            value = parse(reply) if reply is not None else None
            if value is not None:
                break
            prompt = rewrite(prompt) if used < passes else prompt
        return reply, error, attempts, value, used

    def run(batches):
        yield from _answers(batches, prompt_col, ask, ("response", "error", "attempts", "parsed", "passes_used"), in_flight)

    src = df.repartition(partitions) if partitions else df
    return src.mapInPandas(run, schema)
