"""Conversation structure repair: the lightest derivation of a legal conversation, by Knuth's agenda.

A conversation is its rows by turn (null turns first; rows of one turn by role and digest of the
text). Legal are no rows at all, or an optional system row and then user and assistant rows in
turn, ending with an assistant's; what counts is the initial of a role. Edits and their costs:
Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant row 2; a row
that is blank, or repeats role and text of an earlier row, must be deleted, and a truncated row
(its last visible character is none of ``.!?``) that is not deleted adds 1. The audit is the
string of the edits' initials; of the cheapest repairs the one with the least audit counts.

*Deduction.* An item is (rows read, state), where the state is what the repaired rows end with:
nothing, system, user or assistant. An edit of a row is an axiom that leads from a state to a
state and has a cost and letters; an item and an axiom derive the next item, whose value is the
sum of the costs and the joined letters. That function is superior: it never makes (cost, audit)
smaller and keeps the order of values of one item, as letters of inserted rows stand before the
row they precede, so no audit of an item begins another one. Items are therefore popped from an
agenda in the order of (cost, audit), each is final when popped, and the search ends when the goal
is. A stretch of rows is an axiom too: its value from each state to each state is derived the same
way, so long conversations are derived stretch by stretch, and stretches of stretches.

*On Spark.* Rows without their texts are put in order over ranges, so one conversation may span
many tasks; a task derives the conversations that lie within its range, and for the first and last
one the stretch it saw; what belongs to one conversation is then derived from its stretches, one
per range at most. Texts meet the audits in a stream in conversation order, a row at a time; the
hash of a conversation is one such stream, as SHA-256 has no other way.

Null roles and texts count as one space, null conversation ids are one conversation, and a role
that is empty or has another initial can only be deleted or changed. Identical rows are one row
with a number. ``n`` (optional) says how often a row occurs; with 0 it is gone, but its
conversation is not: without rows left its figures are 0 and its audit is empty. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import ASCII_SPACE, cut

#: Costs of the edits, and what a truncated row adds that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
STATES = NOTHING, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
GOAL = "goal"
#: Rows of a stretch, and stretches of a longer one.
STRETCH, FAN = 64, 16
BLANK, REPEATED, OPEN, SOUND = "b", "r", "t", "f"
LEGAL = {"su", "ua", "au"}
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

# State before -> (state after, cost, letters) of every edit.
Step = dict[str, list[tuple[str, int, str]]]

# ----------------------------------------------------------------------------------- deduction


def next_role(state: str) -> str:
    """The role that may follow: the one that an insertion or a change of role gives."""
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=4096)
def edits(kind: str, initial: str, n: int) -> Step:
    """Axioms of a row that occurs ``n`` times; all but its first occurrence must go."""
    if kind in (BLANK, REPEATED):
        return {p: [(p, DELETE * n, "D" * n)] for p in STATES}
    again, letters, open_ = DELETE * (n - 1), "D" * (n - 1), TRUNCATED * (kind == OPEN)
    step: Step = {p: [(p, DELETE + again, "D" + letters)] for p in STATES}
    for p in STATES:
        for role in (USER, ASSISTANT):
            first = "" if next_role(p) == role else "I"
            before = INSERT * len(first) + open_ + again
            step[p].append((role, before + REROLE, first + "R" + letters))
            if initial == role:
                step[p].append((role, before + KEEP, first + "K" + letters))
    if initial == SYSTEM:
        step[NOTHING].append((SYSTEM, KEEP + open_ + again, "K" + letters))
    return step


#: Insertions that end a conversation legally.
CLOSE = {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}


def lightest(steps: Sequence[Step], start: str, to_goal: bool) -> dict[str, tuple[int, str]]:
    """Least (cost, audit) of every state after all steps, or of the goal alone."""
    agenda, final, ends = [(0, "", 0, start)], set(), {}
    while agenda:
        cost, audit, level, state = heappop(agenda)
        if (level, state) in final:
            continue
        final.add((level, state))
        if state == GOAL:
            return {GOAL: (cost, audit)}
        if level < len(steps):
            for after, more, letters in steps[level][state]:
                if (level + 1, after) not in final:
                    heappush(agenda, (cost + more, audit + letters, level + 1, after))
        elif to_goal:
            heappush(agenda, (cost + INSERT * len(CLOSE[state]), audit + CLOSE[state], level, GOAL))
        else:
            ends[state] = (cost, audit)
    return ends


def stretch(steps: Sequence[Step]) -> Step:
    """Many steps as one."""
    return {p: [(q, *value) for q, value in lightest(steps, p, False).items()] for p in STATES}


def condensed(steps: list[Step]) -> list[Step]:
    while len(steps) > FAN:
        steps = [stretch(steps[k : k + FAN]) for k in range(0, len(steps), FAN)]
    return steps


class Seen:
    """What a task knows of the rows of one conversation that it has read so far."""

    def __init__(self, conv: str):
        self.conv, self.rows, self.stretches = conv, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = None

    def add(self, turn: int | None, initial: str, kind: str, n: int) -> None:
        if n < 1:
            return
        self.rows.append(edits(kind, initial, n))
        if len(self.rows) == STRETCH:
            self.stretches.append(stretch(self.rows))
            self.rows = []
        self.blank += n * (kind == BLANK)
        self.duplicate += (n - 1) * (kind != BLANK) + (kind == REPEATED)
        self.truncated += kind == OPEN
        self.illegal += n - 1
        self.follow(initial, initial, turn, turn, turn is not None)

    def follow(self, first: str, last: str, low: int | None, high: int | None, turns: int) -> None:
        """Take in what comes after: its first and last role initial and its turns."""
        self.illegal += self.last is not None and self.last + first not in LEGAL
        self.first, self.last = first if self.first is None else self.first, last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def steps(self) -> list[Step]:
        return condensed(self.stretches + ([stretch(self.rows)] if self.rows else [])) if self.stretches else self.rows

    def result(self) -> dict:
        cost, audit = lightest(self.steps(), NOTHING, True)[GOAL]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost, "audit": audit}

    def part(self, place: int) -> dict:
        steps = self.steps()
        one = steps[0] if len(steps) == 1 else stretch(steps)
        known = [self.blank, self.duplicate, self.truncated, self.illegal, self.turns]
        return {"conv": self.conv, "place": place, "steps": [(p, q, c, a) for p in STATES for q, c, a in one[p]], "counts": known,
                "ends": [] if self.first is None else [self.first, self.last], "turns": [] if self.low is None else [self.low, self.high]}


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PART = "conv string, place int, steps array<struct<p: string, q: string, c: long, a: string>>, counts array<long>, ends array<string>, turns array<long>"
READ = RESULT + PART.removeprefix("conv string")
READ_COLUMNS = ["conv", *FIGURES, "audit", "place", "steps", "counts", "ends", "turns"]


def read_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of the conversations that begin and end within a range of ordered rows; parts of its first and last one."""
    place = TaskContext.get().partitionId()
    seen, at_edge = None, True

    def record(done: Seen, edge: bool) -> tuple:
        known = done.part(place) if edge else done.result()
        return tuple(known.get(c) for c in READ_COLUMNS)

    for batch in batches:
        out = []
        for conv, has_turn, turn, initial, kind, n in zip(*(batch[c].tolist() for c in ("conv", "has_turn", "turn", "initial", "kind", "n"))):
            if seen is None or conv != seen.conv:
                if seen is not None:
                    out.append(record(seen, at_edge))
                    at_edge = False
                seen = Seen(conv)
            seen.add(turn if has_turn else None, initial, kind, n)
        yield pd.DataFrame(out, columns=READ_COLUMNS, dtype=object)
    if seen is not None:
        yield pd.DataFrame([record(seen, True)], columns=READ_COLUMNS, dtype=object)


def join_parts(parts: pd.DataFrame) -> pd.DataFrame:
    """The result of a conversation from its parts, one per range at most."""
    whole = Seen(parts["conv"].iloc[0])
    for part in parts.sort_values("place").itertuples():
        step: Step = {p: [] for p in STATES}
        for move in part.steps:
            step[move["p"]].append((move["q"], move["c"], move["a"]))
        whole.stretches.append(step)
        blank, duplicate, truncated, illegal, turns = map(int, part.counts)
        whole.blank, whole.duplicate, whole.truncated, whole.illegal = whole.blank + blank, whole.duplicate + duplicate, whole.truncated + truncated, whole.illegal + illegal
        if len(part.ends):
            whole.follow(*part.ends, *(map(int, part.turns) if len(part.turns) else (None, None)), turns)
    return pd.DataFrame([whole.result()])


# -------------------------------------------------------------------------------------- tables


def normal(rows: DataFrame) -> DataFrame:
    """conv (never null), turn, role, text, digest, n; the order of a conversation is turn, role, digest."""
    n = F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long")
    text, gone = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(n, F.lit(0)) < 1
    full = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        F.when(gone, "").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"), F.when(gone, "").otherwise(text).alias("text"), F.when(gone, 0).otherwise(n).alias("n"),
    )
    return full.withColumn("digest", F.md5(F.col("text").cast("binary")))


def faults(full: DataFrame) -> DataFrame:
    """conv, turn, has_turn, role, digest, initial, kind, n: one row for identical rows, without texts."""
    shown = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    kind = F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(OPEN)
    facts = cut(full.select("conv", "turn", "role", "digest", kind.alias("kind"), "n").groupBy("conv", "turn", "role", "digest").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")))
    # The first turn of what a conversation says in several turns; null turns come first.
    again = facts.where((F.col("kind") != BLANK) & (F.col("n") > 0)).groupBy("conv", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).getField("turn").alias("first_turn"), F.count("*").alias("times")
    ).where("times > 1")
    later = ~F.col("turn").eqNullSafe(F.col("first_turn")) & F.col("times").isNotNull()
    kind = F.when((F.col("kind") != BLANK) & later, REPEATED).otherwise(F.col("kind"))
    return facts.join(again, ["conv", "role", "digest"], "left").select(
        "conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("has_turn"), "role", "digest", F.left("role", F.lit(1)).alias("initial"), kind.alias("kind"), "n"
    )


def derive(full: DataFrame) -> DataFrame:
    """conv, the figures and the audit of every conversation."""
    order = ["conv", "has_turn", "turn", "role", "digest"]
    ranged = faults(full).repartitionByRange(*order).sortWithinPartitions(*order)
    read = cut(ranged.select("conv", "has_turn", "turn", "initial", "kind", "n").mapInPandas(read_range, READ))
    parts = read.where("audit is null").select("conv", "place", "steps", "counts", "ends", "turns").groupBy("conv").applyInPandas(join_parts, RESULT)
    return read.where("audit is not null").select("conv", *FIGURES, "audit").unionByName(parts)


class Stream:
    """Follows the rows of conversations beside their audits and says what each repaired conversation holds."""

    def __init__(self):
        self.state, self.audit, self.at, self.last = NOTHING, "", 0, None

    def begin(self, audit: str) -> None:
        self.state, self.audit, self.at, self.last = NOTHING, audit, 0, None

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = next_role(self.state)
            self.state, self.at = role, self.at + 1
            yield "I", NAMES[role], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = next_role(self.state)
            role = NAMES[self.state]
        elif edit == "K":
            self.state = role[0]
        yield edit, role, text


NAMES = {USER: "user", ASSISTANT: "assistant"}


def told(full: DataFrame, found: DataFrame) -> DataFrame:
    """conv, kind, role, text: the result of a conversation (kind 0) and then its rows (kind 1), in order in one partition."""
    heads = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.concat_ws(",", *FIGURES, "audit").alias("text"))
    copies = full.where("n > 0").withColumn("kind", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    rows = copies.select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    order = ["conv", "kind", "turn", "role", "digest"]
    return heads.unionByName(rows).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text")


def conv_id(like: DataFrame) -> Column:
    return F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(like.schema["conv_id"].dataType).alias("conv_id")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the rows of every repaired conversation by place, with the deleted ones (place null)."""
    full = cut(normal(rows))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, conv, place = Stream(), None, 0
        for batch in batches:
            out = []

            def keep(moves: Iterator[tuple[str, str, str]], out: list = out) -> None:
                nonlocal place
                for edit, role, text in moves:
                    out.append((conv, None if edit == "D" else place, edit, role, text))
                    place += edit != "D"

            for name, kind, role, text in batch.itertuples(index=False):
                if kind == 0:
                    keep(stream.inserted())
                    conv, place = name, 0
                    stream.begin(text.rsplit(",", 1)[1])
                else:
                    keep(stream.row(role, text))
            yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"]).astype({"place": "Int64"})
        rest = list(stream.inserted())
        yield pd.DataFrame([(conv, place + k, *m) for k, m in enumerate(rest)], columns=["conv", "place", "edit", "role", "text"])

    out = told(full, derive(full)).mapInPandas(follow, "conv string, place long, edit string, role string, text string")
    return out.select(conv_id(rows), "place", "edit", "role", "text")


def report(rows: DataFrame) -> DataFrame:
    """conv_id, figures, audit, and the SHA-256 of the repaired conversation's ``role:text`` lines."""
    full = cut(normal(rows))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, digest, head, empty = Stream(), hashlib.sha256(), None, True

        def take(moves: Iterator[tuple[str, str, str]]) -> None:
            nonlocal empty
            for edit, role, text in moves:
                if edit != "D":
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False

        def finished() -> tuple:
            take(stream.inserted())
            return head[0], *map(int, head[1][:-1]), head[1][-1], digest.hexdigest()

        columns = ["conv", *FIGURES, "audit", "repaired_sha256"]
        for batch in batches:
            out = []
            for conv, kind, role, text in batch.itertuples(index=False):
                if kind == 0:
                    if head is not None:
                        out.append(finished())
                    head, digest, empty = (conv, text.split(",")), hashlib.sha256(), True
                    stream.begin(head[1][-1])
                else:
                    take(stream.row(role, text))
            yield pd.DataFrame(out, columns=columns)
        if head is not None:
            yield pd.DataFrame([finished()], columns=columns)

    fields = ", ".join(f"{f} long" for f in FIGURES)
    out = told(full, derive(full)).mapInPandas(follow, f"conv string, {fields}, audit string, repaired_sha256 string")
    return out.select(conv_id(rows), *FIGURES, "audit", "repaired_sha256")


def damage(rows: DataFrame, of: int = 20) -> DataFrame:
    """conv_id, turn, role, text, n: rows harmed by the CRC-32 of ``conv_id:turn``, for trying out the repair.

    Of every ``of`` remainders 0 drops the row, 1 empties its text, 2 takes the ends of its
    sentences, 3 repeats it and 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % of
    harmed = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    n = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return harmed.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), n.alias("n"))
