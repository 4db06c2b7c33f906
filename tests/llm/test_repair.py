"""Conversation repair against a search over all repairs of short conversations, and by parts of long ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapscope.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string"
VISIBLE = re.compile("[^\x20\x09-\x0d]")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        harm = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        kept = out.setdefault(conv, [])
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def marked(rows):
    """Rows in order with their first fault."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for turn, role, text in rows:
        shown = VISIBLE.findall(text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


LEGAL = re.compile(r"(s?(ua)+)?\Z")


def brute(rows):
    """Cheapest repair among all strings of edits, with at most two insertions beside each other."""
    rows = marked(rows)
    best = None

    def go(at, cost, audit, messages, initials, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if not re.match(r"(s?(ua)*u?)\Z", initials):
            return
        if at == len(rows):
            if LEGAL.match(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, messages)
        else:
            turn, role, text, fault = rows[at]
            go(at + 1, cost + 3, audit + "D", messages, initials, 0)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(at + 1, cost + more, audit + "K", [*messages, (role, text)], initials + role[:1] if role else initials + "?", 0)
                for other in ("user", "assistant"):
                    go(at + 1, cost + 2 + more, audit + "R", [*messages, (other, text)], initials + other[0], 0)
        if inserts < 2:
            for other in ("user", "assistant"):
                go(at, cost + 2, audit + "I", [*messages, (other, "")], initials + other[0], inserts + 1)

    go(0, 0, "", [], "", 0)
    turns = [r[0] for r in rows if r[0] is not None]
    count = Counter(r[3] for r in rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, messages = best
    figures = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost)
    return figures, audit, messages


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(longest + 1)):
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, 0, 3, 99]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "u", "s"]),
                         rng.choice(["a.", "b!", "c", "d?  \n", " ", None, "", "é", "É。", " ", "x, y,"])))
    return rows


def by_conv(df):
    return {r.conv_id: (tuple(r[f] for f in repair.FIGURES), r.audit, r.repaired_sha256) for r in df.collect()}


def digest(messages):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()


@pytest.fixture(scope="module")
def short():
    rows = conversations(5, 250, 6) + [(None, None, None, None), (None, 1, "user", "hm."), (1 << 60, 2, "user", "q.")]
    return rows, {conv: brute(kept) for conv, kept in damaged(rows).items()}


def test_least_costs_and_audits(spark, short):
    rows, want = short
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], COLUMNS + ", audit string, cost int")
    out = repair.report(repair.damage(df))
    assert out.columns == ["conv_id", *repair.FIGURES, "audit", "repaired_sha256"]
    assert by_conv(out) == {conv: (f, a, digest(m)) for conv, (f, a, m) in want.items()}


def test_repaired_rows(spark, short):
    rows, want = short
    got = {}
    for r in repair.repaired(repair.damage(spark.createDataFrame(rows, COLUMNS))).orderBy("conv_id", "place").collect():
        if r.edit != "D":
            got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {conv: m for conv, (_, _, m) in want.items() if m}


@pytest.mark.parametrize("ranges", [1, 40])
def test_one_conversation_over_many_tasks(spark, ranges):
    """Long conversations are derived by stretches and ranges; a plain table over all rows gives the same."""
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.choice('abcdefgh')}{rng.randrange(900)}{rng.choice('.!?,')}") for k in range(3000)]
    rows += [(8, 1, "user", "same."), (8, 2, "assistant", "then.")] + [(8, 1, "user", "same.")] * 2000 + [(k, 0, "user", "q?") for k in range(100, 140)]
    out = damaged(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = by_conv(repair.report(repair.damage(spark.createDataFrame(rows, COLUMNS))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert set(got) == set(out)
    for conv, kept in out.items():
        figures, audit, messages = table_of_all_rows(marked(kept))
        assert got[conv][0][1:] == figures and got[conv][1] == audit and got[conv][2] == digest(messages)


def table_of_all_rows(rows):
    """Viterbi over states, holding whole audits."""
    best = {"": (0, "", ())}
    for _, role, text, fault in rows:
        new = {}
        for state, (cost, audit, said) in best.items():
            options = [(state, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                more, due = fault == "truncated", "a" if state == "u" else "u"
                names = {"u": "user", "a": "assistant"}
                for to in "ua":
                    ins = 0 if to == due else 1
                    head = ((names[due], ""),) * ins
                    options.append((to, 2 * ins + 2 + more, "I" * ins + "R", (*head, (names[to], text))))
                    if role[:1] == to:
                        options.append((to, 2 * ins + more, "I" * ins + "K", (*head, (role, text))))
                if role[:1] == "s" and state == "":
                    options.append(("s", more, "K", ((role, text),)))
            for to, c, letters, more_said in options:
                value = (cost + c, audit + letters)
                if to not in new or value < new[to][0]:
                    new[to] = (value, (said, more_said))
        best = {to: (*value, link) for to, (value, link) in new.items()}
    close = {"": [], "a": [], "u": ["assistant"], "s": ["user", "assistant"]}
    cost, audit, state = min((c + 2 * len(close[s]), a + "I" * len(close[s]), s) for s, (c, a, _) in best.items())
    parts, link = [], best[state][2]
    while link:
        link, said = link
        parts.append(said)
    messages = [m for part in reversed(parts) for m in part] + [(r, "") for r in close[state]]
    count = Counter(r[3] for r in rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (count["blank"], count["duplicate"], count["truncated"], illegal, cost), audit, messages


def test_values_of_an_item_keep_their_order():
    """No audit of an item begins another one, so joining letters keeps the order of equal costs."""
    rng = random.Random(1)
    for _ in range(200):
        steps = [repair.edits(rng.choice("brtf"), rng.choice("sua?"), rng.choice([1, 1, 2])) for _ in range(5)]
        for start in repair.STATES:
            all_, left = {start: [(0, "")]}, steps
            for step in left:
                grown = {}
                for state, values in all_.items():
                    for to, c, letters in step[state]:
                        grown.setdefault(to, []).extend((cost + c, audit + letters) for cost, audit in values)
                all_ = grown
            assert repair.lightest(steps, start, False) == {s: min(v) for s, v in all_.items()}
            for values in all_.values():
                audits = sorted({a for _, a in values})
                assert not any(b.startswith(a) for a, b in zip(audits, audits[1:]))


def test_gone_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "x.", 0), (2, 5, "system", "s.", 1), (3, None, "user", "a" * 2_000_000 + ".", 1)], COLUMNS + ", n int")
    got = by_conv(repair.report(df))
    assert got[1] == ((0,) * 6, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == ((0, 0, 0, 0, 0, 3), "D", hashlib.sha256(b"").hexdigest())
    assert got[3][1] == "KI" and got[3][2] == digest([("user", "a" * 2_000_000 + "."), ("assistant", "")])
    assert repair.report(df.limit(0)).count() == 0 and repair.repaired(df.limit(0)).count() == 0
    named = spark.createDataFrame([("c", 1, "user", "q?")], "conv_id string, turn int, role string, text string")
    assert repair.report(named).first().conv_id == "c"
