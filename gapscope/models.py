"""Remote models as functions the caller hands in.

``embed_fn(texts) -> vectors`` and ``chat_fn(prompt) -> reply`` run inside Spark
tasks on Arrow batches. Rows whose input is null are not sent. Cap the number of
parallel calls by coalescing the frame first. A ``Ledger`` in place of such a
function stores replies and asks for what is missing only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.ledger import Ledger, Refused
from gapscope.operators.rounds import cut

__all__ = ["ChatFn", "EmbedFn", "Refused", "ask", "embed", "text_pieces", "with_reply", "with_vector"]

EmbedFn = Callable[[Sequence[str]], Sequence[Sequence[float]]]
ChatFn = Callable[[str], str]


def text_pieces(text: Column, max_chars: int) -> Column:
    """The whole text in pieces of at most ``max_chars`` characters; null and blank texts have none."""
    n = F.ceil(F.length(text) / max_chars).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * max_chars + 1, F.lit(max_chars)))
    return F.when(F.trim(F.translate(text, "\t\n\r", "   ")) != "", cut)


def embed(
    text: Column, embed_fn: EmbedFn, *, batch: int = 16, attempts: int = 4, max_chars: int = 8000, pause: float = 0.0
) -> Column:
    """Vector of each text; null for blank texts and for calls that keep failing.

    A text longer than the model takes goes in pieces; its vector is their mean by length.
    """

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            todo = [(i, piece) for i, pieces in enumerate(part) if pieces is not None for piece in pieces]
            sums: dict[int, np.ndarray] = {}
            failed = set()
            for at in range(0, len(todo), batch):
                group = todo[at : at + batch]
                for attempt in range(attempts):
                    try:
                        vectors = embed_fn([piece for _, piece in group])
                    except Exception:
                        time.sleep(pause * 2**attempt)
                        continue
                    for (i, piece), v in zip(group, vectors):
                        sums[i] = sums.get(i, 0.0) + np.asarray(v, float) * len(piece)
                    break
                else:
                    failed |= {i for i, _ in group}
            out = pd.Series([None] * len(part), dtype=object)
            for i, total in sums.items():
                if i not in failed:
                    out.iloc[i] = (total / sum(len(piece) for piece in part.iloc[i])).tolist()
            yield out

    return run(text_pieces(text, max_chars))


def ask(prompts: Column, chat_fn: ChatFn, *, attempts: int = 3, pause: float = 0.0) -> Column:
    """Reply to the first prompt of each array; later ones are used when it is refused."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([_reply(p, chat_fn, attempts, pause) for p in part], dtype=object)

    return run(prompts)


def with_reply(df: DataFrame, prompts: Column, model, name: str = "reply") -> DataFrame:
    """``df`` with the reply to each row's prompts: by a function inside the plan, or through a ledger."""
    if isinstance(model, Ledger):
        return model.replies(df, prompts, name)
    return df.withColumn(name, ask(prompts, model))


def with_vector(df: DataFrame, text: Column, model, name: str, *, max_chars: int = 8000) -> DataFrame:
    """``df`` with the vector of each text: by a function inside the plan, or piece by piece through a ledger."""
    if not isinstance(model, Ledger):
        return df.withColumn(name, embed(text, model, max_chars=max_chars))
    rows = cut(df.withColumn("__text", F.sha2(text.cast("binary"), 256)).withColumn("__pieces", text_pieces(text, max_chars)))
    pieces = rows.where("__pieces is not null").groupBy("__text").agg(F.first("__pieces").alias("p")).select("__text", F.explode("p").alias("piece"))
    found = model.replies(pieces, F.array("piece"), "vector")
    # The mean by length, number by number; a text of which a piece failed has none.
    parts = found.select("__text", F.length("piece").alias("n"), F.posexplode_outer("vector").alias("at", "x"), F.col("vector").isNull().alias("failed"))
    sums = parts.groupBy("__text", "at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.max("failed").alias("failed"))
    whole = sums.groupBy("__text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(name), F.max("failed").alias("failed")).where("not failed").drop("failed")
    kept = rows.drop("__pieces", *([name] if name in rows.columns else []))
    return kept.join(whole, "__text", "left").drop("__text")


def _reply(prompts, chat_fn: ChatFn, attempts: int, pause: float) -> str | None:
    if prompts is None:
        return None
    for prompt in prompts:
        for attempt in range(attempts):
            try:
                return chat_fn(prompt)
            except Refused:
                break
            except Exception:
                time.sleep(pause * 2**attempt)
    return None
