"""Work in steps: budgets, spent quotas, cancelling, steps that were lost, and counts of stages made in passing."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from siltstone.plans import answers, run
from siltstone.plans.stages import Stages
from siltstone.sources.stepwise import CANCELLED, HELD, SPENT, WHOLE, Stepwise


def logged(folder):
    """A provider that leaves a line in a file for each request, and has a daily quota while a file says so."""

    class Logged:
        def answer(self, prompt):
            with open(f"{folder}/log", "a") as f:
                f.write(prompt + "\n")
            try:
                with open(f"{folder}/limit") as f:
                    limit = int(f.read())
            except FileNotFoundError:
                limit = 10**9
            with open(f"{folder}/log") as f:
                if sum(1 for _ in f) > limit:
                    raise RuntimeError("429: quota of requests per day is spent")
            return '{"said": "' + prompt + '"}'

    return Logged


def prompts(spark, folder, n):
    rows = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("p"), "id").alias("prompt"))
    return Stepwise(spark, f"{folder}/steps").plan(rows, [F.xxhash64("page_id"), F.col("page_id")])


def asked_of(folder):
    return open(f"{folder}/log").read().split()


def test_budget_is_used_exactly_and_no_page_is_asked_twice(spark, tmp_path):
    folder = str(tmp_path)
    work = prompts(spark, folder, 100)
    assert answers.asked_within(work, logged(folder), budget=37, wave=10, tasks=8) == SPENT
    assert work.done().count() == 37 == len(asked_of(folder))
    again = Stepwise(spark, f"{folder}/steps")
    assert answers.asked_within(again, logged(folder), budget=1000, wave=40, tasks=8) == WHOLE
    assert sorted(asked_of(folder)) == sorted(f"p{k}" for k in range(100))
    assert {r["answer"] for r in again.done().collect()} == {f'{{"said": "p{k}"}}' for k in range(100)}
    assert answers.asked_within(again, logged(folder), budget=5, wave=5, tasks=8) == WHOLE
    assert len(asked_of(folder)) == 100


def test_spent_quota_stops_all_tasks_and_its_pages_are_asked_later(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "limit").write_text("30")
    work = prompts(spark, folder, 200)
    assert answers.asked_within(work, logged(folder), budget=200, wave=50, tasks=4) == HELD
    done = work.done().count()
    asked = asked_of(folder)
    assert done <= 30 and len(asked) <= 30 + 2 * 4  # a request a task learns of it, not one a page
    (tmp_path / "limit").unlink()
    (tmp_path / "log").write_text("")
    assert answers.asked_within(work, logged(folder), budget=10, wave=50, tasks=4) == SPENT
    assert work.done().count() == done + 10  # the held ones first, within the budget
    assert answers.asked_within(work, logged(folder), budget=200, wave=50, tasks=4) == WHOLE
    rows = work.done().collect()
    assert sorted(r["page_id"] for r in rows) == list(range(200)) and all(r["answer"] for r in rows)
    assert len(asked_of(folder)) == 200 - done


def doubled(rows):
    return rows.select("number", (F.col("id") * 2).alias("twice"))


def test_cancelled_run_goes_on_where_it_was(spark, tmp_path):
    work = Stepwise(spark, str(tmp_path / "steps")).plan(spark.range(1000), [F.col("id")])

    def slow(batches):
        for b in batches:
            time.sleep(60 if b.column("number")[0].as_py() > 400 or b.num_rows == 0 else 0)
            yield b

    ended = []

    def going():
        ended.append(work.run(lambda rows: doubled(rows).mapInArrow(slow, "number long, twice long"), rows_a_step=200, tasks=2))

    thread = threading.Thread(target=going)
    thread.start()
    for _ in range(600):
        if (done := work.done()) is not None and done.count() == 400:
            break
        time.sleep(0.1)
    time.sleep(1)
    work.cancel()
    thread.join(30)
    assert ended == [CANCELLED]
    assert work.done().count() == 400
    assert work.run(doubled, rows_a_step=300) == WHOLE
    assert sorted(r["twice"] for r in work.done().collect()) == [2 * k for k in range(1000)]


def test_lost_step_does_not_count_and_failures_are_told(spark, tmp_path):
    work = Stepwise(spark, str(tmp_path / "steps")).plan(spark.range(20), [F.col("id")])
    assert work.done() is None
    assert work.run(doubled, rows_a_step=5, most=10) == SPENT
    lost = next((tmp_path / "steps" / "done").glob("step=000000000000006-*"))
    (lost / "_SUCCESS").unlink()
    assert work.done().count() == 5
    with pytest.raises(Exception, match="no such thing"):
        work.run(lambda rows: doubled(rows).where(F.raise_error(F.lit("no such thing")).isNull()), rows_a_step=5)
    assert work.run(doubled, rows_a_step=7) == WHOLE
    assert sorted(r["twice"] for r in work.done().collect()) == [2 * k for k in range(20)]


def test_no_rows_and_ties(spark, tmp_path):
    none = Stepwise(spark, str(tmp_path / "none")).plan(spark.range(0), [F.col("id")])
    assert none.run(doubled, rows_a_step=5) == WHOLE and none.done() is None
    ties = Stepwise(spark, str(tmp_path / "ties")).plan(spark.range(50).select((F.col("id") % 3).alias("id")), [F.col("id")])
    assert ties.run(doubled, rows_a_step=8) == WHOLE
    assert sorted(r["twice"] for r in ties.done().collect()) == sorted(2 * (k % 3) for k in range(50))


def test_stages_are_counted_without_another_evaluation(spark, tmp_path):
    tasks = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            tasks.add(b.num_rows)
            yield b

    stage = spark.range(30).select(F.col("id"), F.lit("abcd").alias("load_error")).mapInArrow(counted, "id long, load_error string")
    seen = Stages(run.snapshots(str(tmp_path)))
    assert seen("parsed", stage).count() == 30
    row = seen.table(spark).first()
    assert (row["stage"], row["rows"], row["failed"], row["chars"], row["tokens"]) == ("parsed", 30, 30, 120, 30) and row["seconds"] > 0
    assert tasks.value == 30
    passed = Stages(run.in_memory)
    assert passed("merged", stage) is stage and passed.table(spark).count() == 0
