"""Text rules as column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapscope.config import (
    BOILERPLATE_SIGNATURES,
    GENERIC_SUBJECT_OPENINGS,
    MAIL_HEADERS,
    PERSONAL_FIELDS,
    TERM_REPLACEMENTS,
    Thresholds,
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


# Unicode white space, spelt out so that every regex engine means the same by it.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same characters one by one, for trimming without a pattern.
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
EDGE_SPACE = f"^{WS}+|{WS}+$"
SEPARATOR = "-{3,}|_{10,}"
HEADER_LINE = "(?i)^(" + "|".join(MAIL_HEADERS) + "):"
REDACTED_LINE = rf"^{WS}*(\*\*\*{WS}*)+$"
REPLY_LINE = rf"(?is)^On{WS}+.{{5,80}}wrote{WS}*:"
QUOTED_LINE = rf"^>+{WS}"
OUTLOOK_LINE = rf"(?i)^{WS}*Get{WS}+Outlook{WS}+for{WS}+(iOS|Android|Mac|Windows)"
SENT_FROM_LINE = rf"(?i)^{WS}*Sent{WS}+from{WS}+my{WS}+"
NOISE_LINES = (HEADER_LINE, REDACTED_LINE, REPLY_LINE, QUOTED_LINE, OUTLOOK_LINE, SENT_FROM_LINE)
# One pattern for all of them, so that a line is looked at once.
NOISE_LINE = "(?i)" + "|".join(f"(?:{re.sub('^[(][?]i?s?[)]', '', p)})" for p in NOISE_LINES)
GENERIC_SUBJECT = "(?i)^(" + "|".join(GENERIC_SUBJECT_OPENINGS).replace(r"\s", WS) + ")"
REDACTED_TOKEN = r"^\*+[-.*]*$"
ERROR_CODE_LINE = rf"^[0-9]{{3}}{WS}+\*+"
MAIL_ADDRESS = r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}"
PHONE_NUMBER = rf"\b[0-9]{{3}}({WS}|[-.])[0-9]{{3}}({WS}|[-.])[0-9]{{4}}\b"
ID_NUMBER = r"\bG[0-9]{6,}\b"
CLUSTER_NUMBER = r"(?i)cluster\s+([0-9]+)"
CONTACT_BULLET = "•"
CONTACT_HEADING = "need more help"


def personal_line(headers: Sequence[str] = PERSONAL_FIELDS) -> str:
    return f"(?i)^({'|'.join(headers)}){WS}*:"


def strip(c: Column) -> Column:
    """Drop white space, of any kind, at both ends."""
    return F.trim(c, F.lit(WS_CHARS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def lines(c: Column) -> Column:
    """Non-blank lines, each stripped."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda s: s != "")


def first_text(*cols: Column) -> Column:
    return F.coalesce(*cols, F.lit(""))


def snippet(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def evidence_tier(c: Column) -> Column:
    """1 = template reply, 2 = long, 3 = short, 4 = nothing usable."""
    size = F.length(strip(F.replace(c, F.lit("***"), F.lit(""))))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", 4)
        .when(c.startswith("[$$"), 1)
        .when(size > 150, 2)
        .when(size > 50, 3)
        .otherwise(4)
    )


def strip_email_noise(c: Column) -> Column:
    """Text of the newest message without headers, quotes, signatures and redacted lines."""
    newest = F.split(F.coalesce(c, F.lit("")), SEPARATOR, 2)[0]

    return F.array_join(F.filter(lines(newest), lambda line: ~line.rlike(NOISE_LINE)), " ")


def is_boilerplate(
    c: Column, signatures: Sequence[Sequence[str]] = BOILERPLATE_SIGNATURES
) -> Column:
    def matches(low: Column) -> Column:
        found = F.lit(False)
        for group in signatures:
            every = F.lit(True)
            for phrase in group:
                every = every & low.contains(phrase)
            found = found | every
        return found

    return let(F.lower(F.coalesce(c, F.lit(""))), matches)


def is_generic_subject(c: Column) -> Column:
    subject = strip(F.coalesce(c, F.lit("")))
    return (F.size(words(subject)) < 2) | subject.rlike(GENERIC_SUBJECT)


def is_email_dominated(c: Column, share: float = Thresholds.email_share) -> Column:
    def dominated(kept: Column) -> Column:
        headers = F.filter(kept, lambda s: s.rlike(HEADER_LINE))
        return (F.size(kept) >= 3) & (F.size(headers) / F.size(kept) > share)

    return let(lines(F.coalesce(c, F.lit(""))), dominated)


def has_resolution(c: Column, min_chars: int = 30) -> Column:
    return F.coalesce(F.length(F.replace(c, F.lit("***"), F.lit(""))) > min_chars, F.lit(False))


def sanitise(c: Column, headers: Sequence[str] = PERSONAL_FIELDS) -> Column:
    """Drop personal, redacted and machine lines; mask addresses, phones and id numbers."""
    personal = personal_line(headers)

    def redacted(line: Column) -> Column:
        marks = lambda tokens: F.size(F.filter(tokens, lambda t: t.rlike(REDACTED_TOKEN))) / F.size(tokens)
        return line.contains("*") & (let(words(line), marks) > 0.5)

    def keep(line: Column) -> Column:
        return ~(
            line.startswith("{")
            | line.startswith('"error"')
            | line.rlike(personal)
            | line.rlike(ERROR_CODE_LINE)
            | redacted(line)
        )

    # Cheap tests decide whether a pattern can match at all.
    def mask(line: Column) -> Column:
        line = F.when(line.contains("@"), F.regexp_replace(line, MAIL_ADDRESS, "[email]")).otherwise(line)
        digits = line.rlike("[0-9]{3}")
        masked = F.regexp_replace(F.regexp_replace(line, PHONE_NUMBER, "[phone]"), ID_NUMBER, "[id]")
        return F.when(digits, masked).otherwise(line)

    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip)
    parts = F.filter(parts, lambda s: s != "")
    return F.array_join(F.transform(F.filter(parts, keep), mask), " ")


def normalise_terms(c: Column, terms: Mapping[str, str] | None = None) -> Column:
    """Lower-case, blank out redactions, then replace known short names, longest first."""
    terms = TERM_REPLACEMENTS if terms is None else terms
    out = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("***"), F.lit(" "))
    for term in sorted(terms, key=lambda t: -len(t)):
        out = F.replace(out, F.lit(term), F.lit(terms[term]))
    return out


def join_texts(problem: Column, resolution: Column) -> Column:
    """Both texts with two blanks between them, or the one that is there."""
    return F.concat_ws(
        "  ",
        F.nullif(strip(problem), F.lit("")),
        F.nullif(strip(resolution), F.lit("")),
    )


def gap_class(
    sim: Column,
    covered: float = Thresholds.covered,
    partial: float = Thresholds.partial,
    below: str = "CRITICAL",
) -> Column:
    return F.when(sim >= covered, "COVERED").when(sim >= partial, "PARTIAL").otherwise(below)


def recommendation(flag: Column, label: Column, title: Column) -> Column:
    label, title = snippet(label, 40), snippet(F.coalesce(title, F.lit("")), 45)
    return (
        F.when(
            flag == "CRITICAL",
            F.concat(F.lit("GENERATE: Create new KB article — '"), label, F.lit("'")),
        )
        .when(
            flag == "PARTIAL",
            F.concat(F.lit("UPDATE: Expand '"), title, F.lit("' to cover '"), label, F.lit("'")),
        )
        .otherwise(
            F.concat(F.lit("MONITOR: '"), title, F.lit("' adequately covers this cluster"))
        )
    )


def duplicate_recommendation(target: Column, reason: Column) -> Column:
    return F.concat(
        F.lit("DUPLICATE: Confirmed — same problem as cluster "),
        target.cast("string"),
        F.lit(". "),
        F.coalesce(reason, F.lit("")),
    )


def kb_status(
    best_for: Column,
    max_sim: Column,
    partial: float = Thresholds.partial,
    over_relied: int = Thresholds.over_relied,
) -> Column:
    return (
        F.when(best_for >= over_relied, "OVER-RELIED")
        .when((best_for == 0) & (max_sim < partial), "ORPHAN")
        .when(best_for > 0, "ACTIVE")
        .otherwise("PERIPHERAL")
    )


def canonical_from_recommendation(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, CLUSTER_NUMBER, 1), F.lit("")).cast("long")


def confidence_label(c: Column) -> Column:
    """Label of a number in 0..1, or of a text that is already a label."""
    number = c.cast("string").try_cast("double")
    upper = F.upper(c.cast("string"))
    return (
        F.when(number >= 0.85, "HIGH")
        .when(number >= 0.60, "MEDIUM")
        .when(number.isNull() & upper.isin("HIGH", "MEDIUM", "LOW"), upper)
        .otherwise("LOW")
    )


def parse_list(c: Column) -> Column:
    """Items of a JSON array, or the whole text as the only item; blank is null."""
    return F.when(
        F.coalesce(c, F.lit("")) != "",
        F.coalesce(F.from_json(c, "array<string>"), F.array(c)),
    )


def parse_lines(c: Column) -> Column:
    """Items of a JSON array, or the non-blank lines; blank is null."""
    split = F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s != "")
    return F.when(
        F.coalesce(c, F.lit("")) != "", F.coalesce(F.from_json(c, "array<string>"), split)
    )


def note_body(c: Column) -> Column:
    return strip(F.split(F.coalesce(c, F.lit("")), "---", 2)[0])


def note_contacts(c: Column) -> Column:
    """Bullets after the first ``---``, without the heading bullet."""
    tail = F.coalesce(F.get(F.split(F.coalesce(c, F.lit("")), "---", 2), F.lit(1)), F.lit(""))
    bullets = F.transform(F.split(strip(tail), CONTACT_BULLET), strip)
    return F.filter(bullets, lambda s: (s != "") & ~F.lower(s).contains(CONTACT_HEADING))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def accept_label(label: Column, fallback: Column) -> Column:
    """A model's label when it has two to eight words, else the fallback."""
    label = strip(F.coalesce(label, F.lit("")))
    return F.when(F.size(words(label)).between(2, 8), label).otherwise(fallback)
