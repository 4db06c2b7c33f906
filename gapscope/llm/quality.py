"""Quality rules by line labelling: a linear-chain conditional random field marks lines.

Every line of a text becomes a vector of shape features; the field scores each line's label
(content or boilerplate) and each pair of neighbouring labels, and Viterbi decoding gives the
best labelling of the whole text. A text passes when enough of its words are in content lines.
Plain counts that every text must pass first (``base``) are exact.

The field is fitted here, from document labels: lines of good documents count as content,
those of bad ones as boilerplate, and after a first fit the lines of bad documents take the
labels that the field itself gives them. At most ``train_docs`` labelled documents, half of
each kind and chosen by a hash of their ids, are used; only their line features, of at most
``train_lines`` lines each, reach the driver. Everything else covers all rows and whole texts.

Null or empty text has no words and fails the base rules. Without labels of both kinds the
field marks every line as content. Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import worker_store

SYMBOLS = "#*$%&|<>"
UPPER, LOWER, DIGIT, SYMBOL, PUNCT, SPACE, BANG = (1 << k for k in range(7))
TABLE_SIZE = 0x3000
FEATURES = 11
SEGMENT = 32


def character_kinds() -> np.ndarray:
    """Flags of each character below ``TABLE_SIZE``; later ones have none."""
    kinds = np.zeros(TABLE_SIZE, np.uint8)
    for k in range(TABLE_SIZE):
        c = chr(k)
        kinds[k] = (
            UPPER * c.isupper() | LOWER * c.islower() | DIGIT * c.isdigit() | SYMBOL * (c in SYMBOLS)
            | PUNCT * (k < 128 and c.isprintable() and not c.isalnum() and c != " ") | SPACE * (c in "\t\n\x0b\x0c\r ") | BANG * (c == "!")
        )
    kinds[-1] = 0
    return kinds


@dataclass
class Reading:
    """What one pass over a text finds."""

    words: np.ndarray  # per line
    features: np.ndarray  # per line with a word
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0  # different codes mean different windows
    windows = list(zip(*(words[k : n + k] for k in range(width))))
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    steps = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            steps[i] += 1
            steps[i + width] -= 1
    return int((np.cumsum(steps) > 0).sum())


def read(text: str) -> Reading:
    kinds = worker_store("quality", "character kinds", character_kinds)
    codes = np.frombuffer(f"{text}\n".encode("utf-32-le", "surrogatepass"), "<u4")
    flags = kinds[np.minimum(codes, TABLE_SIZE - 1)]
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), starts)

    space = (flags & SPACE) > 0
    first = ~space
    first[1:] &= space[:-1]
    words = per_line(first)
    chars = per_line(~space)
    kind = {k: per_line((flags & k) > 0) for k in (UPPER, LOWER, DIGIT, SYMBOL, PUNCT, BANG)}

    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    split = [line.split() for line in lines]
    full = [k for k, w in enumerate(split) if w]
    seen: set[bytes] = set()
    again = np.zeros(len(lines))
    for k in full:
        again[k] = lines[k] in seen
        seen.add(lines[k])
    distinct = np.array([len(set(w)) for w in split])

    at = np.array(full, np.int64)
    n, c = words[at].astype(float), np.maximum(chars[at], 1).astype(float)
    letters = np.maximum(kind[UPPER][at] + kind[LOWER][at], 1)
    features = np.column_stack(
        [np.ones(len(at)), np.log1p(n), c / np.maximum(n, 1) / 10, kind[UPPER][at] / letters, kind[DIGIT][at] / c, np.minimum(kind[SYMBOL][at] / np.maximum(n, 1), 2),
         np.minimum(kind[PUNCT][at] / np.maximum(n, 1), 2), np.minimum(kind[BANG][at] / np.maximum(n, 1), 2), 1 - distinct[at] / np.maximum(n, 1), again[at], 1 - letters / c]
    ).reshape(-1, FEATURES)
    return Reading(
        words, features, int(chars.sum()), int(kind[SYMBOL].sum()), int(again.sum()), repeated_words([w for line in split for w in line])
    )


@dataclass
class Field:
    """Weights of a linear chain over the labels boilerplate (0) and content (1)."""

    weights: np.ndarray  # features x 2
    between: np.ndarray  # from label x to label
    start: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best labelling; on equal scores the content label wins."""
        if not len(features):
            return np.empty(0, np.int64)
        local = (features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.between.tolist()
        b, c = local[0][0] + self.start[0], local[0][1] + self.start[1]
        back = []
        for lb, lc in local[1:]:
            to_b, to_c = (c + t10 >= b + t00), (c + t11 >= b + t01)
            back.append((to_b, to_c))
            b, c = lb + (c + t10 if to_b else b + t00), lc + (c + t11 if to_c else b + t01)
        label = int(c >= b)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


ALL_CONTENT = Field(np.column_stack([np.zeros(FEATURES), np.ones(FEATURES)]) * (np.arange(FEATURES) == 0)[:, None], np.zeros((2, 2)), np.zeros(2))


def fit(texts: list[np.ndarray], labels: list[np.ndarray], steps: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps; texts are held as segments of equal length with a mask."""
    segments = [(x[k : k + SEGMENT], y[k : k + SEGMENT]) for x, y in zip(texts, labels) for k in range(0, len(x), SEGMENT)]
    n, width = len(segments), max(len(x) for x, _ in segments)
    x, y, mask = np.zeros((n, width, FEATURES)), np.zeros((n, width), np.int64), np.zeros((n, width))
    for k, (a, b) in enumerate(segments):
        x[k, : len(a)], y[k, : len(a)], mask[k, : len(a)] = a, b, 1
    onehot = np.eye(2)[y] * mask[..., None]
    pairs = np.einsum("nta,ntb->ab", onehot[:, :-1], onehot[:, 1:])
    total = mask.sum()
    theta = [np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for step in range(1, steps + 1):
        local = np.einsum("ntf,fl->ntl", x, theta[0])
        alpha, beta = np.zeros((width, n, 2)), np.zeros((width, n, 2))
        alpha[0] = local[:, 0] + theta[2]
        for t in range(1, width):
            new = np.logaddexp(alpha[t - 1][:, :1] + theta[1][0], alpha[t - 1][:, 1:] + theta[1][1]) + local[:, t]
            alpha[t] = np.where(mask[:, t, None] > 0, new, alpha[t - 1])
        for t in range(width - 2, -1, -1):
            ahead = local[:, t + 1] + beta[t + 1]
            new = np.logaddexp(ahead[:, :1] + theta[1][:, 0], ahead[:, 1:] + theta[1][:, 1])
            beta[t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        norm = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        marginal = np.exp(alpha + beta - norm[None, :, None]).transpose(1, 0, 2) * mask[..., None]
        joint = np.exp(
            alpha[:-1, :, :, None] + theta[1] + (local.transpose(1, 0, 2)[1:] + beta[1:])[:, :, None, :] - norm[None, :, None, None]
        ) * mask.T[1:, :, None, None]
        slope = [
            np.einsum("ntf,ntl->fl", x, marginal - onehot) / total + ridge * theta[0],
            (joint.sum((0, 1)) - pairs) / total + ridge * theta[1],
            (marginal[:, 0] - onehot[:, 0]).sum(0) / total,
        ]
        for k, g in enumerate(slope):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return Field(*theta)


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = 2000, train_lines: int = 256) -> Field:
    """The field fitted on a bounded sample of labelled documents."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("__quality"))
    # A sample of fixed size for either kind: at most train_docs rows, so it may be broadcast.
    sample = None
    for kind in (0, 1):
        some = own.where(F.col("__quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs // 2)
        sample = some if sample is None else sample.union(some)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([read(t).features[:train_lines].ravel() for t in texts], dtype=object)

    taught = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = taught.select("__quality", "doc_id", features("text").alias("__x")).toPandas().sort_values(["doc_id", "__quality"], kind="stable")
    texts = [np.asarray(x, float).reshape(-1, FEATURES) for x in rows["__x"]]
    good = rows["__quality"].to_numpy()
    full = [k for k, x in enumerate(texts) if len(x)]
    texts, good = [texts[k] for k in full], good[full]
    if len(set(good.tolist())) < 2:
        return ALL_CONTENT
    first = fit(texts, [np.full(len(x), g) for x, g in zip(texts, good)])
    return fit(texts, [np.ones(len(x), np.int64) if g else first.decode(x) for x, g in zip(texts, good)])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def judge(text: Column, field: Field, min_share: float = 0.5, min_words: int = 10, max_repeat: int = 20) -> Column:
    """Per text a struct of the base counts, the share of words in content lines, and the verdict."""

    @F.pandas_udf(RESULT)
    def rule(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            r = read(t or "")
            n = int(r.words.sum())
            marked = field.decode(r.features)
            share = float((r.words[r.words > 0] * marked).sum() / n) if n else 0.0
            failed = n < min_words or 100 * r.n_repeat_words > max_repeat * n
            rows.append((n, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, share, failed, not failed and share >= min_share))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return rule(text)
