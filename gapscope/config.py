"""Parameters and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    """Every bound a step uses. Vectors of another model need other similarity bounds."""

    covered: float = 0.90
    partial: float = 0.87
    duplicate_candidate: float = 0.88
    article_duplicate: float = 0.95
    novelty_critical: float = 0.87
    novelty_other: float = 0.97
    alignment: float = 0.75
    shown_source: float = 0.87
    low_coherence: float = 0.55
    min_resolution_words: int = 5
    min_activity_words: int = 30
    min_clean_words: int = 22
    email_share: float = 0.40
    min_cluster_tickets: int = 20
    split_floor: int = 500
    split_target: int = 300
    over_relied: int = 5
    low_evidence: float = 0.2
    k_values: tuple[int, ...] = (10, 20, 30, 50, 75, 100, 125)
    tier_weights: tuple[float, ...] = (3.0, 1.5, 0.5, 0.0)
    priority_weights: dict[str, float] = field(
        default_factory=lambda: {"volume": 0.35, "recency": 0.25, "gap": 0.25, "evidence": 0.15}
    )


# Seed of every sampling and clustering step.
SEED = 42

# Similarities are compared and ranked at this many decimals, so that the order of
# additions inside a dot product cannot decide a tie.
SIM_DIGITS = 9

# Phrases of the system-generated work-order templates. A text is a
# template when every phrase of one group occurs in it.
BOILERPLATE_SIGNATURES: tuple[tuple[str, ...], ...] = (
    ("assign the first", "set the wo status to"),
    ("click on the view req", "located under functions"),
    ("please see related req",),
    ("please open the related req",),
    ("*** requested:", "comments:"),
)

# Header names that open a mail header line.
MAIL_HEADERS: tuple[str, ...] = (
    "From", "To", "CC", "BCC", "Subject", "Date", "Sent", "Assigned To", "Pending by",
    "Importance", "Priority", "Reply-To", "Return-Path", "X-[A-Za-z0-9-]+",
)

# Openings of a subject line that says nothing about the problem.
GENERIC_SUBJECT_OPENINGS: tuple[str, ...] = (
    r"service\s+request(\s*-\s*.*)?",
    r"inc\s*-\s*",
    r"incident\s*-\s*",
    r"new\s+request",
    r"general\s+inquiry",
    r"access\s+request",
    r"password\s+(reset|change)\s*$",
    r"fwd?:\s*",
    r"re:\s*$",
)

# Field names whose lines are dropped before a text leaves the cluster.
# A site adds its own through the ``headers`` argument.
PERSONAL_FIELDS: tuple[str, ...] = ("Name", "Phone", "Email", "Username", "Personal.*Email")

# Service types that count as "not stated".
UNSTATED_SERVICES: tuple[str, ...] = ("", "Unknown", "N/A", "None", "none")

# Words too common in tickets to name a cluster. Site names, product
# names and the like are added through the ``stop_words`` argument.
TICKET_STOP_WORDS: tuple[str, ...] = (
    "https", "edu", "http", "www", "com", "net", "org", "gov",
    "called", "calling", "assisted", "assistance", "confirmed", "checked",
    "provided", "instructions", "instruction", "helped", "resolved", "issue",
    "came", "picked", "dropped", "customer", "user", "follow", "sent", "available",
    "answered", "answer", "asked", "ask", "contact", "ticket", "closed", "got",
    "given", "give", "need", "added", "add", "requested", "action", "forwarded",
    "forward", "completed", "complete", "submitted", "submit", "assigned", "assign",
    "created", "create", "opened", "open", "status", "progress", "started", "start",
    "set", "does", "non", "details", "detail", "task", "comment", "comments",
    "noted", "note", "subject", "email", "fwd", "thank", "thanks", "attached",
    "form", "hello", "image", "dear", "please", "request", "regards", "number",
    "new", "date", "day", "days", "time", "week", "month", "year",
    "role", "roles", "staff", "member", "team", "group", "department", "division",
    "office", "via", "per", "able", "let", "just", "know", "use", "used", "update",
    "updated", "access", "account", "poc",
)

# Short names replaced before tokens are taken. A site adds its own
# through the ``terms`` argument.
TERM_REPLACEMENTS: dict[str, str] = {
    "sspr": "password self service reset",
}
