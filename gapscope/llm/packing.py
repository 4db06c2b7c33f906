"""Large-item matching: packs token sequences into as few bins as it can.

1. Texts become ids (plus one separator id); the tokenizers library merges each new word. Ids of more than ``capacity`` are cut into full
   pieces and a rest; nothing else is cut. One row per piece stays: its length and checksum.
2. The lengths are at most ``capacity`` different numbers, so their histogram is small
   whatever the corpus, and one exact plan for all pieces is made from it on the driver.
   Lengths above a third of the capacity fit a bin at most twice: from the longest down each
   is matched with the longest that still fits beside it. Smaller lengths then go, from the
   longest down, into the smallest gap that holds them; new bins open when none does.
   A step of the plan places a whole range of equal pieces into a range of bins.
3. Pieces are ranked among those of their length (range by range, so that a length with a
   third of all rows is no single task's work), and the plan gives bin and offset by rank.

Null text is empty text: its piece holds the separator alone. Rows without an id, repeated
ids and repeated rows are packed like any others. An empty table gives no rows.
"""

from __future__ import annotations

import string
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.llm.bpe import Memo, WordBpe, byte_characters, encoder
from gapscope.llm.common import cut, small_batches, worker_store

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


#: Chunks of text and words whose ids a worker remembers, as bytes. Most new chunks are known words in another case or before other marks.
MEMO_CHUNKS, MEMO_WORDS = 50_000, 300_000
#: Letters below this one are Latin.
PAST_LATIN = "\u0250"
MARKS = string.punctuation


class LibraryBpe(WordBpe):
    """Splits texts as WordBpe does and leaves the merges of each new word to the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model, self.letters = Tokenizer.from_file(path).model, byte_characters()
        self.packed_words = Memo(self.packed_word, MEMO_WORDS)
        latin = "".join(c for c in map(chr, range(ord(PAST_LATIN))) if c.isalpha())
        #: Whether the pattern takes Latin letters as one word, and the marks after them as another.
        self.plain_split = self.words(latin + MARKS) == [latin, MARKS]

    def word(self, word: str) -> list[int]:
        plain = word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode())
        return [t.id for t in self.model.tokenize(plain)]

    def packed_word(self, word: str) -> bytes:
        ids = self.word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, chunk: str) -> bytes:
        """The ids of a chunk as little-endian numbers of 32 bits."""
        known = self.packed_words
        if self.plain_split and "<" not in chunk:
            low = chunk.lower()
            body = low if low.isalpha() else low.rstrip(MARKS)
            if body.isalpha() and (body.isascii() or (max(body) < PAST_LATIN and unicodedata.is_normalized("NFC", chunk))):
                return known[body] if len(body) == len(low) else known[body] + known[low[len(body) :]]
        if self.split_special and "<" in chunk and len(pieces := self.split_special.split(chunk)) > 1:
            return b"".join(struct.pack("<I", self.special[p]) if p in self.special else self.packed(p) for p in pieces if p)
        return b"".join(map(known.__getitem__, self.words(self.normal(chunk))))


def pieces(text: Column, path: str, capacity: int, separator: int) -> Column:
    """Per text the pieces of its ids and the separator id after them."""
    ending = np.uint32(separator).astype("<u4").tobytes()

    @F.pandas_udf(PIECES)
    def encode(texts: pd.Series) -> pd.Series:
        bpe = encoder(path, LibraryBpe)
        known = worker_store("bpe", f"packed {path}", lambda: Memo(bpe.packed, MEMO_CHUNKS))
        out = []
        for t in texts:
            data = b"".join(map(known.__getitem__, bpe.split(t or ""))) + ending
            step = 4 * capacity
            out.append(
                [{"piece": k // step, "start": k // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                 for k in range(0, len(data), step) for part in (data[k : k + step],)]
            )
        return pd.Series(out, dtype=object)

    return encode(text)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, number, first bin, offset) that place every piece once.

    ``counts`` is the histogram of lengths. Piece ``rank`` of a length goes to bin
    ``first bin + rank - first rank`` of the step whose ranks hold it.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    used = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int]] = []
    bins = 0
    open_: list[tuple[int, int, int]] = []  # gap, first bin, number of bins; sorted by gap

    def place(length: int, number: int, first: int, offset: int) -> None:
        steps.append((length, used[length], number, first, offset))
        used[length] += number
        left[length] -= number

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect_left(large, capacity - length + 1) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == length):
                at -= 1
            other = large[at] if at >= 0 else 0
            number = min(left[length], left[other]) if other and other != length else left[length] // 2 if other else left[length]
            place(length, number, bins, 0)
            if other:
                place(other, number, bins, length)
            if capacity - length - other:
                insort(open_, (capacity - length - other, bins, number))
            bins += number
    for length in [n for n in left if 3 * n <= capacity]:
        while left[length]:
            at = bisect_left(open_, (length, -1, -1))
            if at == len(open_):
                many = -(-left[length] // (capacity // length))
                open_.append((capacity, bins, many))
                bins += many
            gap, first, number = open_.pop(at)
            # The bin with the smallest gap keeps it after each piece, so it is filled at once.
            each = min(gap // length, left[length])
            here = min(number, left[length] // each)
            for k in range(each):
                place(length, here, first, capacity - gap + k * length)
            if gap - each * length:
                insort(open_, (gap - each * length, first, here))
            if number > here:
                insort(open_, (gap, first + here, number - here))
    return steps


def ranked_in_length(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name`` = place from 0 among the rows of equal ``length``; hot lengths span many ranges."""
    ranged = cut(table.repartitionByRange("length", *order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("length", "__range").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("length").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sums.select("length", "__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start")))
    inside = F.row_number().over(Window.partitionBy("__range", "length").orderBy(*order)) - 1
    return ranged.withColumn("__inside", inside).join(starts, ["length", "__range"]).select(
        *table.columns, (F.col("__start") + F.col("__inside")).alias(name)
    )


def pack(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    small_batches(docs.sparkSession)
    cutup = docs.select("doc_id", F.explode(pieces(F.col("text"), path, capacity, separator)).alias("p")).select("doc_id", "p.*")
    table = cut(cutup)
    counts = {int(r["length"]): int(r["n"]) for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Sorted by (length, first rank): both lists are bounded by the capacity, not by the corpus.
    steps = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    steps = docs.sparkSession.sparkContext.broadcast(steps)
    ranked = ranked_in_length(table, ["doc_id", "piece", "ids_crc32"], "__rank")

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = steps.value
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            lo, hi = np.searchsorted(s[:, 0], [n, n + 1])
            rows = np.flatnonzero(length.to_numpy() == n)
            at[rows] = lo + np.searchsorted(s[lo:hi, 1], rank.to_numpy()[rows], side="right") - 1
        return pd.DataFrame({"sequence_id": s[at, 3] + rank.to_numpy() - s[at, 1], "offset": s[at, 4]})

    found = ranked.withColumn("__at", look_up("length", "__rank"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset")
