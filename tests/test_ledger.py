"""The ledger of replies: one call per distinct prompt, none for what is stored, reasons for failures."""

import json
import sys
from collections import Counter
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gapscope.ledger import REFUSED, VECTOR, Ledger, call_key, settled
from gapscope.models import Refused, with_reply, with_vector
from gapscope.plans import gaps as gp
from gapscope.plans import review as rv

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file


def counting(folder, reply):
    """A stand-in whose calls are lines of a file per task."""

    def call(prompt):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return reply(prompt)

    return call


def calls(folder):
    return Counter(p.read_text() for p in folder.iterdir())


def answer(prompt):
    if prompt.startswith("long"):
        raise Refused
    if prompt.startswith("down"):
        raise ConnectionError("no route")
    return "ok " + prompt


@pytest.fixture
def place(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path


def test_each_prompt_is_asked_once(spark, place):
    led = Ledger(str(place / "ledger"), "m1", counting(place / "calls", answer), per_task=2)
    df = spark.createDataFrame(
        [(k, p) for k, p in enumerate([["a"], ["a"], ["b"], ["long 1", "a"], ["long 1", "long 2"], ["down", "b"], None, [], ["long 1", None], ["a", "b"]] * 3)], "i int, p array<string>"
    ).repartition(4)
    out = led.replies(df, F.col("p"), failure="why").orderBy("i").collect()
    want = [("ok a", None), ("ok a", None), ("ok b", None), ("ok a", None), (None, REFUSED), (None, "ConnectionError: no route"), (None, None), (None, None), (None, None), ("ok a", None)]
    assert [(r.reply, r.why) for r in out] == want * 3
    assert calls(place / "calls") == {"a": 1, "b": 1, "long 1": 1, "long 2": 1, "down": 3}
    # The next run asks only for what failed, and takes the rest from the ledger.
    again = led.replies(df, F.col("p"), failure="why").orderBy("i").collect()
    assert again == out and calls(place / "calls") == {"a": 1, "b": 1, "long 1": 1, "long 2": 1, "down": 6}
    up = replace(led, call=counting(place / "calls", lambda p: "back " + p))
    assert up.replies(df, F.col("p"), failure="why").where("i = 5").first().reply == "back down"
    # Another model is another call.
    other = replace(led, model="m2", call=counting(place / "calls", lambda p: "m2 " + p))
    assert other.replies(df.where("i = 0"), F.col("p")).first().reply == "m2 a" and calls(place / "calls")["a"] == 2


def test_plans_take_a_ledger(spark, place):
    reply = json.dumps({"is_duplicate": True, "confidence": "HIGH", "reason": "x"})
    led = Ledger(str(place / "ledger"), "m", counting(place / "calls", lambda p: reply))
    p = spark.createDataFrame([("r", 1, 9, 0.5, "same"), ("r", 2, 9, 0.5, "same"), ("s", 1, 9, 0.5, "else")], "run_id string, a long, b long, sim double, prompt string")
    for _ in range(2):
        assert gp.accepted_pairs(p, led).count() == 3
    assert calls(place / "calls") == {"same": 1, "else": 1}
    q = spark.createDataFrame([("r", 1, "q")], "run_id string, cluster_id long, prompt string")
    assert rv.opinions(q, led).count() == 0  # the reply lacks keys
    summed = spark.createDataFrame([("r", 1, ["x"]), ("r", 2, None)], "run_id string, cluster_id long, prompts array<string>")
    assert [(r.cluster_id, r.summary) for r in gp.summaries(summed, led).collect()] == [(1, reply)]


def test_vectors(spark, place):
    def embed_one(text):
        if "boom" in text:
            raise RuntimeError("no")
        return [float(len(text)), 1.0]

    led = Ledger(str(place / "ledger"), "e", counting(place / "calls", embed_one), kind=VECTOR, attempts=1)
    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, None), (4, "x" * 10 + "boom"), (5, "y" * 25), (6, "abc")], "i int, t string")
    for _ in range(2):
        got = {r["i"]: r.v for r in with_vector(df, F.col("t"), led, "v", max_chars=10).collect()}
        assert got == {1: [3.0, 1.0], 2: None, 3: None, 4: None, 5: [pytest.approx((100 + 100 + 25) / 25), 1.0], 6: [3.0, 1.0]}
    assert calls(place / "calls") == {"abc": 1, "x" * 10: 1, "boom": 2, "y" * 10: 1, "yyyyy": 1}
    plain = {r["i"]: r.v for r in with_vector(df, F.col("t"), lambda texts: [embed_one(t) for t in texts], "v", max_chars=10).collect()}
    assert plain == got


def test_settled_rows_and_empty_tables(spark, place):
    rows = [("a", None, "E: 1", 1.0), ("a", "r", None, 2.0), ("a", None, "E: 3", 3.0), ("b", None, REFUSED, 1.0), ("b", None, "E", 5.0), ("c", None, "E: 1", 1.0), ("c", None, "E: 2", 2.0)]
    got = {r.call: (r.reply, r.failure) for r in settled(spark.createDataFrame(rows, "call string, reply string, failure string, stamp double")).collect()}
    assert got == {"a": ("r", None), "b": (None, REFUSED), "c": (None, "E: 2")}
    led = Ledger(str(place / "ledger"), "m", answer)
    none = spark.createDataFrame([], "i int, p array<string>")
    assert with_reply(none, F.col("p"), led).count() == 0
    assert spark.range(1).select(call_key("m", F.lit(None).cast("string")).alias("k")).first().k is None
