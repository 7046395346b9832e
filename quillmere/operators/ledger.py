"""A ledger of provider calls: each answer is stored under its prompt's hash and the model, and no prompt is asked twice.

Prompts are looked up before any call; those without an answer, each once however often it occurs, are dealt over the tasks
and asked. A call that fails is a row with its error and not a failed task, so what the other calls have answered is
stored with the same commit, and a later run asks only for what is missing. Tasks write their answers to the shared folder
as they end: when an executor is lost, only its unfinished tasks ask again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Layout, Store
from ..tables import cut

LAYOUTS = {
    "answers": Layout("prompt_hash string, model string, answer string", ("prompt_hash", "model"), ("prompt_hash",), 64),
    "failures": Layout("prompt_hash string, model string, error string", ("prompt_hash", "model"), ("prompt_hash",)),
}
#: Prompts that one task asks at most, so that a lost one repeats few calls.
CALLS = 200


class Unanswered(RuntimeError):
    """Some calls have failed; the answers of the others are stored."""


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, calls: int = CALLS):
        self.store, self.calls = Store(spark, folder, LAYOUTS), calls

    def failures(self, model: str) -> DataFrame:
        """prompt_hash, error of calls that have no answer yet."""
        return self.store.read("failures").where(F.col("model") == model).select("prompt_hash", "error")

    def complete(self, rows: DataFrame, prompt: str, provider, json_mode: bool = False, strict: bool = True) -> DataFrame:
        """rows with `answer` for their column `prompt`. With strict, failed calls raise Unanswered once all answers are
        stored; without, their rows have a null answer. Null prompts have null answers and are not asked."""
        model = provider.model_id()
        asked = cut(rows.withColumn("prompt_hash", F.sha2(prompt, 256)), "asked")
        change = self.store.begin()
        known = change.read("answers").where(F.col("model") == model).groupBy("prompt_hash").agg(F.min("answer").alias("answer"))
        missing = asked.where(F.col(prompt).isNotNull()).groupBy("prompt_hash").agg(F.first(prompt).alias("prompt")).join(known, "prompt_hash", "left_anti")
        missing = cut(missing, "missing")

        def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for key, text in part[["prompt_hash", "prompt"]].itertuples(index=False):
                    try:
                        out.append((key, provider.complete(text, json_mode=json_mode), None))
                    except Exception as e:  # whatever a provider raises
                        out.append((key, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["prompt_hash", "answer", "error"])

        tasks = max(1, -(-missing.count() // self.calls))
        called = cut(missing.repartition(tasks, "prompt_hash").mapInPandas(call, "prompt_hash string, answer string, error string"), "called")
        named = called.withColumn("model", F.lit(model))
        answered = named.where("error is null")
        change.append("answers", answered.select("prompt_hash", "model", "answer"))
        change.merge("failures", named.where("error is not null").select("prompt_hash", "model", "error"), deleted=answered.select("prompt_hash", "model"))
        change.commit()
        failed = called.where("error is not null")
        if strict and not failed.isEmpty():
            raise Unanswered(f"{failed.count()} calls failed, one with {failed.first()['error']}")
        every = known.unionByName(called.where("error is null").select("prompt_hash", "answer"))
        return cut(asked.join(every, "prompt_hash", "left").drop("prompt_hash"), "answered")
