"""Table-driven checks of the text rules, with the awkward inputs."""

import pytest
from pyspark.sql import functions as F

from gapscope.functions import article_rules as ar
from gapscope.functions import text as tx


def evaluate(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_evidence_tier(spark):
    values = [None, "", "[$$ made", "x" * 151, "x" * 150, "x" * 51, "x" * 50, "***" * 60, " \n" + "x" * 50 + " ", "*** " + "y" * 51]
    assert evaluate(spark, values, tx.evidence_tier) == [4, 4, 1, 2, 3, 3, 4, 4, 4, 3]


@pytest.mark.parametrize(
    "text, clean",
    [
        (None, ""),
        ("", ""),
        ("From: a\nTo: b\nSubject: c\nThe printer is down", "The printer is down"),
        ("first\r\nsecond\rthird", "first second third"),
        ("kept\n---\ndropped", "kept"),
        ("kept\n----- Forwarded message\nFrom: x", "kept"),
        ("kept __________ dropped", "kept"),
        ("a -- b stays", "a -- b stays"),
        ("*** ***\n  ***  \ntext", "text"),
        ("On Monday, somebody at the desk wrote:\n> quoted\nnew", "new"),
        ("On x wrote:", "On x wrote:"),
        ("Get Outlook for iOS\nSent from my phone\nbody", "body"),
        ("x-mailer: thing\nX-Spam-Level: 1\nbody", "body"),
        (">quoted without blank stays", ">quoted without blank stays"),
        ("   \n\t\n", ""),
        ("one two\x0bthree", "one two three"),
    ],
)
def test_strip_email_noise(spark, text, clean):
    assert evaluate(spark, [text], tx.strip_email_noise) == [clean]


def test_boilerplate(spark):
    values = [
        "Assign the first task, then SET THE WO STATUS TO done", "assign the first task", "Click on the View REQ located under Functions",
        "please see related REQ", "please open the related req now", "*** Requested: me\nComments: none", "", None,
    ]
    assert evaluate(spark, values, tx.is_boilerplate) == [True, False, True, True, True, True, False, False]


def test_generic_subject(spark):
    values = [
        None, "", "help", "Service Request - Account", "INC - printer broken", "new request for laptop", "password reset", "password reset for mail",
        "Fw: hello there", "re: ", "printer does not print", "  general inquiry ", "incident - mail",
    ]
    assert evaluate(spark, values, tx.is_generic_subject) == [
        True, True, True, True, True, True, True, False, True, True, False, True, True,
    ]


def test_email_dominated(spark):
    values = ["From: a\nTo: b\nhello", "From: a\nhello\nthere", "From: a\nTo: b", None, "From: a\nTo: b\nx\ny\nz", "\n\nCC: a\n\nBCC: b\nx\ny"]
    assert evaluate(spark, values, tx.is_email_dominated) == [True, False, False, False, False, True]


def test_word_count(spark):
    assert evaluate(spark, [None, "", "  ", "a b", " a b\nc "], tx.word_count) == [0, 0, 0, 2, 3]


def test_has_resolution(spark):
    assert evaluate(spark, [None, "x" * 30, "x" * 31, "***" * 20 + "x" * 30], tx.has_resolution) == [False, False, True, False]


@pytest.mark.parametrize(
    "text, clean",
    [
        ("Name: Jo\nPhone : 1\nPersonal backup Email: x\nreal line", "real line"),
        ("*** *** word\nword *** more text", "word *** more text"),
        ('{"a": 1}\n"error": 2\n404 *** gone\nok', "ok"),
        ("mail a.b+c@site.example.org or 202-555-0199 or 202.555.0199", "mail [email] or [phone] or [phone]"),
        ("id G12345 and G123456", "id G12345 and [id]"),
        ("***-*** x y z", "***-*** x y z"),
        ("", ""),
        ("all ***\n*** ***", "all ***"),
    ],
)
def test_sanitise(spark, text, clean):
    assert evaluate(spark, [text], tx.sanitise) == [clean]


def test_normalise_terms_longest_first_and_as_substring(spark):
    terms = {"net": "network", "netid": "login", "": ""}
    fn = lambda c: tx.normalise_terms(c, {k: v for k, v in terms.items() if k})
    assert evaluate(spark, ["NETID *** net", "cabinet"], fn) == ["login   network".replace("login", "login"), "cabinetwork"]


def test_join_texts(spark):
    df = spark.createDataFrame([("a", "b"), ("a", " "), (None, "b"), (None, None)], "p string, r string")
    assert [r[0] for r in df.select(tx.join_texts(F.col("p"), F.col("r"))).collect()] == ["a  b", "a", "b", ""]


def test_gap_class_at_the_bounds(spark):
    assert evaluate(spark, [0.9, 0.8999, 0.87, 0.8699], tx.gap_class, "double") == ["COVERED", "PARTIAL", "PARTIAL", "CRITICAL"]


def test_kb_status(spark):
    df = spark.createDataFrame([(5, 0.1), (0, 0.86), (0, 0.87), (1, 0.1)], "n int, s double")
    assert [r[0] for r in df.select(tx.kb_status(F.col("n"), F.col("s"))).collect()] == ["OVER-RELIED", "ORPHAN", "PERIPHERAL", "ACTIVE"]


def test_canonical_and_confidence(spark):
    assert evaluate(spark, ["same as Cluster  12.", "none", None], tx.canonical_from_recommendation) == [12, None, None]
    values = ["0.85", "0.6", "0.59", "high", "LOW", "odd", None]
    assert evaluate(spark, values, tx.confidence_label) == ["HIGH", "MEDIUM", "LOW", "HIGH", "LOW", "LOW", "LOW"]


def test_lists(spark):
    values = ['["a", "b"]', "plain", "", None, '{"a": 1}']
    assert evaluate(spark, values, tx.parse_list) == [["a", "b"], ["plain"], None, None, ['{"a": 1}']]
    assert evaluate(spark, ["a\n \n b ", '["x"]', ""], tx.parse_lines) == [["a", "b"], ["x"], None]


def test_notes(spark):
    text = " see this --- • one • Need more help? • two "
    assert evaluate(spark, [text, "only notes", None], tx.note_body) == ["see this", "only notes", ""]
    assert evaluate(spark, [text, "only notes", None], tx.note_contacts) == [["one", "two"], [], []]


def test_accept_label(spark):
    fn = lambda c: tx.accept_label(c, F.lit("old"))
    assert evaluate(spark, [None, "One", " Two Words ", "a b c d e f g h", "a b c d e f g h i"], fn) == ["old", "old", "Two Words", "a b c d e f g h", "old"]


def test_quality_score(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, None), (2, ["a", "b"], "x" * 50, "desk", 0.9), (3, ["a", "b", "c"], "x", "", 0.69), (4, ["a", "b", "c"], "x" * 50, "desk", None)],
        "i int, s array<string>, p string, e string, c double",
    )
    cols = [F.col(c) for c in "spec"]
    out = df.orderBy("i").select(ar.quality_score(*cols).alias("q"), ar.quality_issues(*cols).alias("l")).collect()
    assert [r["q"] for r in out] == [4, 9, 6, 10]
    assert out[0]["l"] == ["Too few resolution steps", "Problem statement too short", "Missing escalation trigger"]
    assert out[2]["l"] == ["Problem statement too short", "Missing escalation trigger", "Low model confidence"]


def expected_status(verdict, novel, aligned, flag):
    if verdict == "INSUFFICIENT":
        return "FAIL"
    if flag == "PARTIAL":
        return "VALIDATED" if verdict == "VALIDATED" and aligned else "PARTIAL"
    if not novel and not aligned:
        return "FAIL"
    return "VALIDATED" if verdict == "VALIDATED" and novel and aligned else "PARTIAL"


def test_final_verdict_truth_table(spark):
    rows = [
        (v, n, a, f) for v in ar.VERDICTS for n in (True, False) for a in (True, False) for f in ("CRITICAL", "PARTIAL", "COVERED")
    ]
    df = spark.createDataFrame(rows, "v string, n boolean, a boolean, f string")
    got = df.select("*", ar.final_verdict(F.col("v"), F.col("n"), F.col("a"), F.col("f")).alias("s")).collect()
    assert all(r["s"] == expected_status(r["v"], r["n"], r["a"], r["f"]) for r in got)


def test_verdict_and_notes(spark):
    assert evaluate(spark, ["validated", "x", None], ar.normalise_verdict) == ["VALIDATED", "PARTIAL", "PARTIAL"]
    df = spark.createDataFrame(
        [(1, None, 0.1, "CRITICAL"), (2, None, 0.1, "PARTIAL"), (3, "n", 0.1, "CRITICAL"), (4, "n", 0.2, "CRITICAL")], "i int, n string, e double, f string"
    )
    out = [r[0] for r in df.orderBy("i").select(ar.notes_with_evidence(F.col("n"), F.col("e"), F.col("f"))).collect()]
    assert out == [ar.ABSENT_NOTE, ar.LOW_EVIDENCE_NOTE, "n" + ar.LOW_EVIDENCE_NOTE, "n"]
