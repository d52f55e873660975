"""Model answers with second attempts, as stored tables.

Answers come from outside: ``ask`` turns a table of prompts into a table of answers. What it
returns is written once, part by part, each with a commit record, and never asked for again, so a run that
died goes on where it stopped. Rows whose answer repeats itself, holds the unknown marker or is missing are
asked once more with the next attempt's parameters; the last answer counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sinks.writers import build_stage

#: ``ask(prompts, parameters)`` -> rows with the prompts' id and an answer.
Ask = Callable[[DataFrame, Mapping[str, object]], DataFrame]

# The request parameters of the first and the second attempt.
ATTEMPT_PARAMS: list[dict[str, object]] = [{"temperature": 0}, {"temperature": 0, "presence_penalty": 0.6}]


def needs_retry(answer: F.Column) -> F.Column:
    """Whether an answer is missing, repeats its units too much or holds the unknown marker."""
    return answer.isNull() | F.coalesce(tx.repetition_flag(tx.split_units(answer)), F.lit(False))


def _fingerprints(prompts: DataFrame, part: F.Column) -> dict[int, str]:
    """Of each part of the prompts: its rows, and a sum over hashes of them (one row a part)."""
    rows = prompts.groupBy(part.alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*prompts.columns).cast("decimal(38,0)")).alias("h"))
    return {r["p"]: f"{r['n']} {r['h']}" for r in rows.collect()}


def ask_with_retries(prompts: DataFrame, ask: Ask, path: str, q_id: str = "q_id", answer: str = "answer",
                     attempts: Sequence[Mapping[str, object]] = ATTEMPT_PARAMS, parts: int = 8) -> DataFrame:
    """All attempts: ``q_id``, ``attempt`` (from 1), ``answer``, ``needs_retry``; stored below ``path``.

    ``prompts`` holds unique ids (null: asked like others) and columns that can be hashed (no maps). Ids are
    dealt over ``parts`` by hash; each part of each attempt is a stage of its own that is asked for once per
    prompts and parameters. The loop runs ``len(attempts)`` times at most, and ends when no row is left. A prompt for
    which ``ask`` returns no row has a null answer. Only a task that Spark runs again repeats requests."""
    spark = prompts.sparkSession
    part = F.pmod(F.xxhash64(F.col(q_id)), F.lit(parts)).cast("int")
    pending, done = prompts, None
    for number, params in enumerate(attempts, 1):
        prints = _fingerprints(pending, part)
        if not prints:
            break
        asked = []
        for p, print_ in sorted(prints.items()):
            def answers(rows=pending.where(part == p), params=params) -> DataFrame:
                got = ask(rows, params).select(F.col(q_id).alias("_id"), F.col(answer).cast("string").alias("_answer"))
                return rows.join(got, F.col(q_id).eqNullSafe(F.col("_id")), "left").select(
                    F.col(q_id).alias("q_id"), F.lit(number).alias("attempt"), F.col("_answer").alias("answer"),
                    needs_retry(F.col("_answer")).alias("needs_retry"))
            asked.append(build_stage(spark, f"{path}/attempt={number}/part={p}", answers, params={"prompts": print_, **params}))
        attempt = _union(asked)
        done = attempt if done is None else done.unionByName(attempt)
        again = attempt.where("needs_retry").select(F.col("q_id").alias("_id"))
        pending = pending.join(again, F.col(q_id).eqNullSafe(F.col("_id")), "left_semi")
    return done if done is not None else _none(spark, prompts.schema[q_id].dataType.simpleString())


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _none(spark: SparkSession, id_type: str) -> DataFrame:
    return spark.createDataFrame([], f"q_id {id_type}, attempt int, answer string, needs_retry boolean")


def last_answers(attempts: DataFrame) -> DataFrame:
    """The answers that count: ``q_id``, ``answer``, ``needs_retry`` of the last attempt, and ``attempts``."""
    last = F.max(F.struct("attempt", "answer", "needs_retry"))
    return attempts.groupBy("q_id").agg(last.alias("_l")).select(
        "q_id", "_l.answer", "_l.needs_retry", F.col("_l.attempt").cast("bigint").alias("attempts"))
