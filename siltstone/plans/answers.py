"""Model answers in a plan: recorded ones by a join, live ones by a provider in each task, within a budget by waves."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.model import Provider, StopAsking, ask, repaired
from ..sources.stepwise import Stepwise


def recorded(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """``pages`` with ``answer``, the recorded text of each page; a page without one has null."""
    return pages.join(answers.select("page_id", "answer"), "page_id", "left")


def repaired_json(raw: Column) -> Column:
    """Answers as JSON that parses as far as it goes."""

    @F.arrow_udf(T.StringType())
    def mend(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else repaired(t.as_py()) for t in texts], pa.string())

    return mend(raw)


def _reply(provider: Callable[[], Provider], retries: int) -> Callable[..., Column]:
    """(answer, error, held) of a prompt; held are those that a spent quota leaves unasked."""
    made = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("held", T.BooleanType())])

    @F.arrow_udf(made)
    def reply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client, stopped = provider(), None
        for prompts in batches:
            out = []
            for p in prompts:
                answer = error = None
                held = False
                try:
                    if stopped:
                        raise StopAsking(stopped)
                    answer = json.dumps(ask(client, p.as_py(), retries=retries), ensure_ascii=False)
                except StopAsking as e:
                    stopped = error = str(e)
                    held = True
                except Exception as e:  # noqa: BLE001  one page never fails the job
                    error = f"{type(e).__name__}: {e}"
                out.append({"answer": answer, "error": error, "held": held})
            yield pa.array(out, pa.struct([("answer", pa.string()), ("error", pa.string()), ("held", pa.bool_())]))

    return reply


def asked(pages: DataFrame, provider: Callable[[], Provider], *, retries: int = 2) -> DataFrame:
    """``pages`` (with ``prompt``) and ``answer`` and ``answer_error``; each task makes one provider.

    A spent daily quota ends the asking of a task: its later rows get the error at once.
    """
    replied = pages.withColumn("_r", _reply(provider, retries)("prompt"))
    return replied.withColumns({"answer": F.col("_r.answer"), "answer_error": F.col("_r.error")}).drop("_r")


def asked_within(prompts: Stepwise, provider: Callable[[], Provider], *, budget: int, wave: int, retries: int = 2, tasks: int | None = None) -> str:
    """Ask for ``budget`` of the planned rows (with ``prompt``) that have no answer yet, exactly as many if there are, a wave of them at a time.

    The answers are ``prompts.done()``: a row that was answered, or that failed for a reason of its own after its tries, is asked no more by any
    run.  When a daily quota is spent each task of the wave learns it by one request at most, its other rows are held, no wave follows, and the
    next run asks the held rows first.  Gives how the asking ended.  Of a wave that an executor's or the driver's loss cuts short, what was not kept is asked again.
    """

    def answer(rows: DataFrame) -> DataFrame:
        replied = rows.withColumn("_r", _reply(provider, retries)("prompt"))
        return replied.withColumns({"answer": F.col("_r.answer"), "answer_error": F.col("_r.error"), "_held": F.col("_r.held")}).drop("_r", "prompt")

    return prompts.run(answer, rows_a_step=wave, most=budget, again=F.col("_held"), tasks=tasks)
