"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent character n-grams, taken from
padded words. A document gets such a list too, and the language whose profile is least out
of place wins: each n-gram of the document costs the distance between its two ranks, or the
profile size where the profile lacks it. n-grams of equal count share their middle rank, so
nothing depends on an order among ties; two languages at equal distance go to the lower name.

Learning counts n-grams over all training rows (per task first, then per language); only the
profiles, size x languages, come to the driver. A null text, or one without a letter, is
``und`` with score 0, and so is everything when nothing could be learned. The score is 1
minus the distance as a share of the largest possible one; where so many n-grams tie that none
ranks below the profile size, it is ``und`` and 0. Rows with a null language or text
teach nothing. Repeated rows count as often as they occur and are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.llm.common import give_back, worker_store

PROFILE_SIZE = 300
LONGEST = 4
#: Characters whose n-grams are held at once, and n-grams that a task sums before it hands them on.
SLICE_CHARS = 1 << 17
MOST_GRAMS = 1 << 20
EDGE = 1  # stands for the padding; no letter has this code


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def grams(texts: Sequence[str], longest: int = LONGEST) -> list[np.ndarray]:
    """Per text all its n-grams of 1 to ``longest`` (at most 4) characters, in no order.

    A word is a run of letters with an edge on either side; an n-gram lies in one word with
    its edges and holds a letter. It is packed into 64 bits, 16 for each character; characters
    beyond the basic plane are folded to 16 bits.
    """
    known = worker_store("langid", "letters", letters)
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4") for t in texts]
    edge = np.array([EDGE], np.uint32)
    codes = np.concatenate([x for part in parts for x in (edge, part)] + [edge])
    # A text's windows begin between its own edge and the next text's.
    starts = np.cumsum([0] + [len(part) + 1 for part in parts])
    letter = known[codes]
    letter[starts] = False
    chars = np.where(letter, codes & 0xFFFF, EDGE).astype(np.uint64)
    found, inner, packed = [], None, None
    for n in range(1, longest + 1):
        if n == 1:
            packed, valid = chars, letter
        else:
            packed = (packed[:-1] << np.uint64(16)) | chars[n - 1 :]
            if n == 2:
                valid = letter[:-1] | letter[1:]
            else:
                inner = letter[1:-1] if n == 3 else inner[:-1] & letter[n - 2 : -1]
                valid = inner
        at = np.flatnonzero(valid)
        found.append((packed[at].view(np.int64), np.searchsorted(at, starts)))
    return [np.concatenate([values[cuts[k] : cuts[k + 1]] for values, cuts in found]) for k in range(len(texts))]


def slices(texts: Sequence[str]) -> Iterator[list[str]]:
    """The texts in groups of bounded size; a longer text is a group of its own."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often (or with what weight) each occurs."""
    if weights is None:
        values = np.sort(values)
        first = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1)) if len(values) else np.empty(0, np.int64)
        return values[first], np.diff(np.append(first, len(values)))
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, weights, len(distinct)).astype(np.int64)


def gram_counts(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, n) over all rows with a text and a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for lang, (gram, n) in sums.items():
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})
            sums.clear()

        held: dict[str, list[np.ndarray]] = {}

        def fold(lang: str) -> None:
            new = counted(np.concatenate(held.pop(lang)))
            old = sums.get(lang)
            sums[lang] = new if old is None else counted(*(np.concatenate(pair) for pair in zip(old, new)))

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for some in slices(list(texts)):
                    held.setdefault(lang, []).append(np.concatenate(grams(some, longest)))
                    if sum(map(len, held[lang])) > MOST_GRAMS:
                        fold(lang)
            for lang in list(held):
                fold(lang)
            if sum(len(g) for g, _ in sums.values()) > MOST_GRAMS:
                yield from rows()
            give_back()
        yield from rows()

    taught = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    return taught.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, size: int = PROFILE_SIZE) -> dict[str, dict[int, float]]:
    """Per language the middle rank of each of its ``size`` most frequent n-grams (ties to the lower number)."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= size).drop("__r")
    out: dict[str, dict[int, float]] = {}
    for lang, rows in top.toPandas().sort_values(["lang", "n", "gram"], ascending=[True, False, True]).groupby("lang"):
        out[lang] = dict(zip(rows["gram"].tolist(), middle_ranks(rows["n"].to_numpy()).tolist()))
    return out


def middle_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank from 0 by falling count; equal counts share the middle of their places."""
    values, at, sizes = np.unique(-counts, return_inverse=True, return_counts=True)
    return (np.cumsum(sizes) - sizes + (sizes - 1) / 2)[at]


class Detector:
    """Compares documents with profiles; built once per worker."""

    def __init__(self, profiles: dict[str, dict[int, float]], size: int, longest: int):
        self.names, self.size, self.longest = sorted(profiles), size, longest
        self.known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.names), len(self.known)), np.nan)
        for k, name in enumerate(self.names):
            own = profiles[name]
            self.ranks[k, np.searchsorted(self.known, np.array(list(own), np.int64))] = list(own.values())

    def detect(self, found: np.ndarray) -> tuple[str, float]:
        """Language and score of a document, given all its n-grams."""
        if not len(found) or not self.names:
            return "und", 0.0
        distinct, counts = counted(found)
        ranks = middle_ranks(counts)
        first = ranks < self.size
        distinct, ranks = distinct[first], ranks[first]
        if not len(distinct):  # so many n-grams tie that none is among the first ones
            return self.names[self.nearest_of(np.unique(found))], 0.0
        at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
        known = self.known[at] == distinct
        apart = np.abs(self.ranks[:, at[known]] - ranks[known])
        costs = np.where(np.isnan(apart), self.size, np.minimum(apart, self.size)).sum(axis=1) + self.size * (~known).sum()
        best = int(np.argmin(costs))
        return self.names[best], float(1 - costs[best] / (self.size * len(distinct)))


    def nearest_of(self, distinct: np.ndarray) -> int:
        """The language that ranks n-grams without an order of their own highest; the lowest name if none knows any."""
        ranks = self.ranks[:, np.isin(self.known, distinct)]
        return int(np.argmin(np.where(np.isnan(ranks), self.size, np.minimum(ranks, self.size)).sum(axis=1)))


def predict(text: Column, profiles: dict[str, dict[int, float]], size: int = PROFILE_SIZE, longest: int = LONGEST) -> Column:
    """Per text a struct of lang_pred and score."""
    stamp = f"detector {hash(repr(sorted((k, sorted(v.items())) for k, v in profiles.items())))} {size} {longest}"

    @F.pandas_udf("lang_pred string, score double")
    def detect(texts: pd.Series) -> pd.DataFrame:
        found = worker_store("langid", stamp, lambda: Detector(profiles, size, longest))
        rows = [found.detect(g) for some in slices([t or "" for t in texts]) for g in grams(some, longest)]
        give_back()
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return detect(text)


def held_out(doc_id: Column) -> Column:
    """Documents kept for testing: CRC-32 of the id as text leaves 2 when divided by 4 (a null id is not kept)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, dict[int, float]]:
    """Profiles from the documents that are not held out."""
    return profiles(gram_counts(docs.where(~held_out(F.col("doc_id")))))
