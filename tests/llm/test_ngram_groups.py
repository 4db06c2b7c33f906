"""Texts of the n-gram join are worked on together, with what each would give alone."""

import numpy as np
import pytest

from gapscope.llm import common
from gapscope.llm import ngramjoin as nj
from gapscope.operators import rounds


@pytest.mark.parametrize("words", [1, 7, 1 << 16])
def test_windows_of_a_group_are_those_of_its_texts(monkeypatch, words):
    monkeypatch.setattr(nj, "GROUP_WORDS", words)
    texts = [None, "", "one", "one two", "a b c", "a b c d a b c", " ", "x " * 50, "é É z", "a b"]
    for width in (1, 3, 5):
        made = [f for g in nj.in_groups(texts) for (f,) in nj.apart(g, width, lambda h: (nj.windows(h, width),))]
        alone = [nj.windows(nj.word_hashes(t), width) for t in texts]
        assert len(made) == len(alone) and all(np.array_equal(a, b) for a, b in zip(made, alone))


def test_known_hashes_are_found_and_others_are_not():
    rng = np.random.default_rng(1)
    top = np.uint64(2**64 - 1)
    keys = np.unique(np.r_[rng.integers(0, 2**64 - 1, 5000, np.uint64), np.arange(40, dtype=np.uint64) + np.uint64(9), np.uint64(0), top])
    values = rng.integers(1, 60, len(keys)).astype(np.uint8)
    held = dict(zip(keys.tolist(), values.tolist()))
    asked = np.r_[keys, keys + np.uint64(1), rng.integers(0, 2**64 - 1, 5000, np.uint64)]
    assert nj.Known(keys, values)(asked).tolist() == [held.get(x, 0) for x in asked.tolist()]
    assert nj.Known(keys[:0], values[:0])(asked).tolist() == [0] * len(asked)
    assert nj.Known(keys[:1], values[:1])(np.r_[top, keys[:1]]).tolist() == [0, int(values[0])]


def test_classes_are_the_rarest_words_unless_the_token_is_often_met():
    hashes = nj.word_hashes("a b c d b c d")
    found = nj.windows(hashes, 3)
    a, b, c, d = hashes[:4]
    order = nj.Orders(np.array([b, c, d]), np.array([64, 40, 32]), found[1:2])
    assert order.classes(hashes, found).tolist() == [0, 255, 6, 6, 255]


def test_prefixes_are_made_once_for_each_text(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    nothing = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    found = docs.select("doc_id", nj.prefixes(docs, 3, 90, nothing).alias("p")).select("doc_id", "p.*").where("n > 0")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["doc_id"], r["n"]) for r in found.collect()] == [(1, 2)]


def test_no_texts_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rounds, "shared_folder", lambda _: str(tmp_path))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join([f"x{k}", *words])) for k in range(8)], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in nj.join(docs).collect()}
    kept = [spark.read.parquet(str(p)).columns for p in tmp_path.iterdir()]
    assert got == {(k, 0) for k in range(8)}
    assert kept and not any({"text", "a", "hub"} & set(c) for c in kept)


def test_another_operators_memory_is_dropped():
    common.worker_store("an operator", "memo", lambda: [1])
    assert common.claim(nj.OWNER) == {}
