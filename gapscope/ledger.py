"""Replies of models, stored before they are used, so that no step pays twice for one prompt.

A call is keyed by a digest of the model's name and the prompt. Prompts are asked once however many
rows hold them; what the ledger has is not asked again, found by an anti join; what is asked is
appended to the ledger in one job, and only then read. A refusal is final, and the row's next
prompt is tried; any other failure is stored with its reason, comes back as a column, and is asked
again in the next run. A task that is lost while it asks repeats its own prompts, ``per_task`` at
most; a stored reply is never asked for again.

A ``Ledger`` is handed to the steps in place of a model function.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.operators.rounds import cut, drop_table


class Refused(Exception):
    """The model will not answer this prompt; a shorter one may pass."""


REFUSED = "refused"
TEXT, VECTOR = "string", "array<double>"


def call_key(model: str, prompt: Column) -> Column:
    """64 hex digits that stand for a call; null for a null prompt."""
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), prompt).cast("binary"), 256)


def settled(ledger: DataFrame) -> DataFrame:
    """One row per call of ``ledger`` (call, reply, failure, stamp): its reply, else its refusal, else its last failure."""
    rank = F.struct(F.col("reply").isNotNull(), F.coalesce(F.col("failure") == REFUSED, F.lit(False)), "stamp", "failure")
    return ledger.groupBy("call").agg(F.max_by(F.struct("reply", "failure"), rank).alias("s")).select("call", "s.reply", "s.failure")


def missing(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    """(call, prompt) of ``asked`` (call, prompt) that have neither a reply nor a refusal, each call once."""
    known = ledger.where(F.col("reply").isNotNull() | (F.col("failure") == REFUSED)).select("call")
    return asked.where("call is not null").groupBy("call").agg(F.min("prompt").alias("prompt")).join(known, "call", "left_anti")


@dataclass(frozen=True)
class Ledger:
    """``call(prompt)`` gives a reply of ``kind``; ``folder`` is a table that all runs of all steps may share."""

    folder: str
    model: str
    call: Callable
    kind: str = TEXT
    attempts: int = 3
    pause: float = 0.0
    per_task: int = 256

    def stored(self, spark: SparkSession) -> DataFrame:
        schema = f"call string, reply {self.kind}, failure string, stamp double"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.folder)

    def ask(self, asked: DataFrame) -> None:
        """Append what is missing of ``asked`` (call, prompt)."""
        spark = asked.sparkSession
        todo = cut(missing(asked, self.stored(spark)))
        n = todo.count()
        if n:
            me = self

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    out = [(call, *me.once(prompt), time.time()) for call, prompt in zip(batch["call"], batch["prompt"])]
                    yield pd.DataFrame(out, columns=["call", "reply", "failure", "stamp"])

            tasks = -(-n // self.per_task)
            replies = todo.repartition(tasks, "call").mapInPandas(run, f"call string, reply {self.kind}, failure string, stamp double")
            replies.write.mode("append").parquet(self.folder)
        drop_table(spark, todo)

    def once(self, prompt: str) -> tuple[object, str | None]:
        """Reply and failure of one call; the reason names the error."""
        reason = None
        for attempt in range(self.attempts):
            try:
                reply = self.call(prompt)
                return (list(map(float, reply)) if self.kind == VECTOR else str(reply)), None
            except Refused:
                return None, REFUSED
            except Exception as error:  # what a remote service may raise is not known; it is kept and shown
                reason = f"{type(error).__name__}: {error}"
                time.sleep(self.pause * 2**attempt)
        return None, reason

    def replies(self, df: DataFrame, prompts: Column, reply: str = "reply", failure: str | None = None) -> DataFrame:
        """``df`` with the reply to the first prompt of each array that is not refused, and why there is none."""
        spark = df.sparkSession
        rows = cut(df.withColumn("__prompts", prompts).withColumn("__key", F.sha2(F.to_json("__prompts").cast("binary"), 256)))
        lists = rows.where("__key is not null").groupBy("__key").agg(F.first("__prompts").alias("__prompts"))
        level, pending, done = 0, cut(lists), []
        while not pending.isEmpty():
            prompt = F.get("__prompts", F.lit(level))
            at = cut(pending.select("__key", "__prompts", prompt.alias("prompt"), call_key(self.model, prompt).alias("call")))
            self.ask(at.select("call", "prompt"))
            known = at.join(settled(self.stored(spark)), "call", "left")
            go_on = (F.coalesce(F.col("failure"), F.lit(REFUSED)) == REFUSED) & F.col("reply").isNull() & (F.size("__prompts") > level + 1)
            known = cut(known.withColumn("__on", go_on))
            done.append(known.where("not __on").select("__key", "reply", "failure"))
            drop_table(spark, pending, at)
            pending, level = cut(known.where("__on").select("__key", "__prompts")), level + 1
        found = done[0] if done else spark.createDataFrame([], f"__key string, reply {self.kind}, failure string")
        for part in done[1:]:
            found = found.unionByName(part)
        found = found.select("__key", F.col("reply").alias(reply), F.col("failure").alias(failure or "__failure"))
        out = rows.join(found, "__key", "left").drop("__key", "__prompts")
        return out if failure else out.drop("__failure")
