"""Collocations against plain counting in Python, with and without sending frequent words and pairs."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapscope.llm import collocations

COLUMNS = "lang string, text string, n long, phrase string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    return [w for w in (re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lowered(text))) if w]


def plain_counts(docs):
    counts, total = defaultdict(Counter), Counter()
    for lang, text, *_ in docs:
        for words in pieces(text):
            total[lang or "und"] += len(words)
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return counts, total


def brute(docs, least, most):
    counts, total = plain_counts(docs)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        best = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "Of", "É", "é", "data", "a", "big", "new-york", "日本", "x'y"]
    rare = [f"r{k}" for k in range(400)]
    passage = "It was the best of times it was the worst of times: so far, so good"
    docs = []
    for k in range(300):
        words = [rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "!?", "\r\n", " \x0b"]) for w in words)
        if k % 4 == 0:
            text += passage
        if k % 5 == 0:
            text = "a a a a a a big big a " + text
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text, k, "clash"))
    return docs + [("en", None, 0, None), ("en", "", 0, ""), ("fr", " . , ", 0, ""), (None, None, 0, ""), ("long", "one two three " * 100_000, 0, "")]


@pytest.mark.parametrize("sent", [collocations.SENT_BYTES, 20, 0])
def test_against_plain_counting(spark, sent):
    docs = corpus(2)
    df = spark.createDataFrame(docs, COLUMNS).repartition(5)
    out = collocations.ranked(df, least=5, most=60, most_bytes=sent)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == brute(docs, 5, 60)


def test_counts_come_from_the_flow(spark):
    docs = corpus(3)
    df = spark.createDataFrame(docs, COLUMNS)
    known = collocations.sent_words(collocations.word_counts(df), 4, 1 << 20)
    assert known.words is not None
    for frequent in (collocations.Frequent(None), known, collocations.sent_pairs(df, known, 4, 1 << 20)):
        grams = collocations.longest_grams(df, frequent)
        got = {(r.lang, tuple(r.phrase.split(" "))): r.a for r in collocations.counts(grams, 4).collect()}
        assert got == {(lang, p): a for lang, f in plain_counts(docs)[0].items() for p, a in f.items() if a >= 4}


def test_unary_paths(spark):
    text = "one two three four five six seven"
    docs = [("en", text, 0, "")] * 6 + [("en", "nine " + text + " eight", 0, "")] * 6 + [("en", "four five six two", 0, "")] * 6
    phrases = collocations.counts(collocations.longest_grams(spark.createDataFrame(docs, COLUMNS), collocations.Frequent(None)), 5)
    got = {r.edge: (r.path, r.place, r.a) for r in collocations.paths(phrases).collect()}
    first = "one two three four"
    # A path ends where a piece ends or begins, or counts part: at "one two three", "four five six" and "five six seven".
    assert got == {
        "nine one two three": ("nine one two three", 0, 6), first: (first, 0, 12), "two three four five": (first, 1, 12), "three four five six": (first, 2, 12),
        "four five six seven": ("four five six seven", 0, 12), "five six seven eight": ("five six seven eight", 0, 6), "four five six two": ("four five six two", 0, 6),
    }
    inner = {r.phrase for r in collocations.inner_nodes(collocations.paths(phrases)).collect()}
    assert inner == {"two three four", "three four five"}


def test_words_of_texts_side_by_side():
    texts = pa.array(["ab c", "", "d", ". e", "f g,", "h"], pa.large_string())
    distinct, ids, near = collocations.words(texts.slice(0))
    assert distinct.take(pa.array(ids)).to_pylist() == list("ab c d e f g h".split()) and near.tolist() == [True, False, False, False, True, False, False]
    distinct, ids, _ = collocations.words(texts.slice(2, 2))
    assert distinct.take(pa.array(ids)).to_pylist() == ["d", "e"]
    assert len(collocations.words(pa.array(["", ""], pa.large_string()))[1]) == 0


def test_products_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 5), ("en", "b", 1, big + 1), ("en", "a b c", 3, big // 5 * 4), ("en", "c", 1, big), ("en", "b c", 2, big // 5 * 4 + 1)], "lang string, phrase string, size int, a long")
    runs = spark.createDataFrame([], "lang string, edge string, path string, place long, a long")
    left = collocations.phrases_left(phrases, runs)
    assert {r.phrase for r in left.collect()} == {"a b c"}  # "a b" is covered to 80 hundredths exactly
    got = {r.phrase: r.score for r in collocations.scored(phrases.where("size = 2"), phrases).collect()}
    assert got == {"a b": 2_000_000 * big // (2 * big + 6), "b c": 2_000_000 * (big // 5 * 4 + 1) // (2 * big + 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert collocations.ranked(df).count() == 0
    assert collocations.ranked(spark.createDataFrame([("en", None, 0, "")], COLUMNS)).select(F.count("*")).first()[0] == 0
