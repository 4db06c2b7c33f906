"""BPE encoding and decoding over a contiguous rank array.

A short word is held as a list of parts (the boundaries) beside a list of the ranks of
adjacent parts. The lowest rank is found by scanning, its boundary is deleted, and only
the ranks left and right of it are looked up again; for the handful of parts a word has,
that beats any queue. Words above ``LONG_WORD`` parts use a heap over linked parts, which
gives the same merges (lowest rank first, then leftmost) without quadratic scans.

Texts fall into chunks at white space, which no word crosses; a worker remembers the
chunks it has met, up to a bound, so only new ones are merged. Null text is empty text and
has no ids. The vocabulary file is a parameter; tasks open it by path on each worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from gapscope.llm.common import worker_store

#: Fixed values of the file format: white space of Unicode, and what ``str.split`` takes beyond it.
SPACE = "\t-\r \x85\xa0  -     　"
NOT_SPACE_HERE = "\x1c\x1d\x1e\x1f"
LONG_WORD = 256
ID_BITS = 32
ID_MASK = (1 << ID_BITS) - 1
MEMO_CHUNKS, MEMO_WORDS = 300_000, 150_000
MEMO_CHARS = 48


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


class WordBpe:
    """Encoder of a word-end BPE file: NFC, lower case, split, byte characters, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.chunks = regex.compile(f"[^{SPACE}]+").findall
        # A merge's rank with the new part's id in its low bits: one number to compare and to use.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), rank << ID_BITS | self.vocab[a + b])
        letters = byte_characters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.none = len(model["merges"]) << ID_BITS
        self.known: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        return self.chunks(text) if any(c in text for c in NOT_SPACE_HERE) else text.split()

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        if len(parts) > LONG_WORD:
            return self.long_word(parts)
        look, none = self.merges.get, self.none
        ranks = [look(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] = best & ID_MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = look((parts[i], parts[i + 1]), none)
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        look = self.merges.get
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (m := look((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = best & ID_MASK, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := look((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (m, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a piece of text without white space."""
        if chunk.isascii() and chunk.isalpha():
            return self.known_word(chunk.lower())
        if self.split_special and "<" in chunk and len(pieces := self.split_special.split(chunk)) > 1:
            return [i for p in pieces for i in ([self.special[p]] if p in self.special else self.chunk(p) if p else [])]
        return [i for word in self.words(self.normal(chunk)) for i in self.known_word(word)]

    def normal(self, chunk: str) -> str:
        """NFC and lower case."""
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        # Lower case goes letter by letter, so a final sigma is an ordinary one.
        return "".join(c.lower() for c in plain) if "\u03a3" in plain else plain.lower()

    def known_word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.word(word)
            if len(word) <= MEMO_CHARS:
                if len(self.known) >= MEMO_WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.split(text or "") for i in self.chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space, as the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


class Memo(dict):
    """Remembers what ``make`` gives for a chunk; starts anew when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk: str):
        out = self.make(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


def encoder(path: str, kind: type[WordBpe] = WordBpe) -> WordBpe:
    return worker_store("bpe", f"{kind.__name__} {path}", lambda: kind(path))


def memo(path: str, name: str, form, kind: type[WordBpe] = WordBpe, most: int = MEMO_CHUNKS) -> Memo:
    """``form`` of each chunk's ids, kept by the worker."""
    bpe = encoder(path, kind)
    return worker_store("bpe", f"{name} {path}", lambda: Memo(lambda chunk: form(bpe, bpe.chunk(chunk)), most))


def digests(text: Column, path: str) -> Column:
    """Per text a struct of n_tokens, ids_sha256 and decoded_sha256."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def encode(texts: pd.Series) -> pd.DataFrame:
        bpe = encoder(path)
        known = memo(path, "digest", lambda b, ids: (len(ids), " ".join(map(str, ids)), b.decode(ids)))
        rows = []
        for t in texts:
            found = [x for c in bpe.split(t or "") if (x := known[c])[0]]
            n, ids, tokens = zip(*found) if found else ((), (), ())
            rows.append((sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(tokens).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(text)


def ids(text: Column, path: str) -> Column:
    """Per text its ids, array<int>."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = encoder(path)
        known = memo(path, "ids", lambda b, i: i)
        return pd.Series([[i for c in bpe.split(t or "") for i in known[c]] for t in texts], dtype=object)

    return encode(text)


def decoded(column: Column, path: str) -> Column:
    """Per array of ids its text; null stays null."""

    @F.pandas_udf("string")
    def decode(arrays: pd.Series) -> pd.Series:
        bpe = encoder(path)
        return pd.Series([None if a is None else bpe.decode(a) for a in arrays], dtype=object)

    return decode(column)
