"""Text rules over every text of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.config import TICKET_STOP_WORDS, Thresholds
from gapscope.functions import article_rules as ar
from gapscope.functions import text as tx
from gapscope.operators import labelling as lb
from gapscope.queries.roles import STOP_WORDS, Tables
from gapscope.queries import sql_roles as q
from gapscope.queries.registry import query

def listed(c):
    """A list as one text, so that both engines hash the same."""
    return F.array_join(c, " | ")


@query("txt_evidence_tier", f"SELECT text_id, {q.tier('text')} AS tier FROM r_texts")
def evidence_tier(t: Tables):
    return t.texts().select("text_id", tx.evidence_tier(F.col("text")).alias("tier"))


@query(
    "txt_strip_email_noise",
    f"""SELECT text_id, md5(clean) AS clean_md5, length(clean)::INTEGER AS clean_length
    FROM (SELECT text_id, {q.strip_email('text')} AS clean FROM r_texts)""",
)
def strip_email_noise(t: Tables):
    clean = t.texts().select("text_id", tx.strip_email_noise(F.col("text")).alias("clean"))
    return clean.select("text_id", F.md5("clean").alias("clean_md5"), F.length("clean").alias("clean_length"))


@query("txt_boilerplate", f"SELECT text_id, {q.boilerplate('text')} AS boilerplate FROM r_texts")
def boilerplate(t: Tables):
    return t.texts().select("text_id", tx.is_boilerplate(F.col("text")).alias("boilerplate"))


@query(
    "txt_generic_subject",
    f"SELECT text_id, {q.generic_subject('split_part(text, chr(10), 1)')} AS generic FROM r_texts",
)
def generic_subject(t: Tables):
    return t.texts().select("text_id", tx.is_generic_subject(F.split("text", "\n", 2)[0]).alias("generic"))


@query(
    "txt_email_dominated",
    f"SELECT text_id, {q.email_dominated('text', Thresholds.email_share)} AS dominated FROM r_texts",
)
def email_dominated(t: Tables):
    return t.texts().select("text_id", tx.is_email_dominated(F.col("text")).alias("dominated"))


@query("txt_word_count", f"SELECT text_id, len({q.words('text')})::INTEGER AS words FROM r_texts")
def word_count(t: Tables):
    return t.texts().select("text_id", tx.word_count(F.col("text")).alias("words"))


@query(
    "txt_has_resolution",
    "SELECT source, id, coalesce(length(replace(answer, '***', '')) > 30, false) AS usable FROM r_source",
)
def has_resolution(t: Tables):
    both = t.incidents().select(F.lit("incident").alias("source"), "id", F.col("resolution_summary").alias("a")).unionByName(
        t.workorders().select(F.lit("workorder").alias("source"), "id", F.col("activity_logs_text").alias("a"))
    )
    return both.select("source", "id", tx.has_resolution(F.col("a")).alias("usable"))


@query(
    "txt_sanitise",
    f"""SELECT text_id, md5(clean) AS clean_md5, length(clean)::INTEGER AS clean_length
    FROM (SELECT text_id, {q.sanitise('text')} AS clean FROM r_texts)""",
)
def sanitise(t: Tables):
    clean = t.texts().select("text_id", tx.sanitise(F.col("text")).alias("clean"))
    return clean.select("text_id", F.md5("clean").alias("clean_md5"), F.length("clean").alias("clean_length"))


@query(
    "txt_normalise_terms",
    f"SELECT text_id, md5({q.normalise_terms('text')}) AS text_md5 FROM r_texts",
)
def normalise_terms(t: Tables):
    return t.texts().select("text_id", F.md5(tx.normalise_terms(F.col("text"))).alias("text_md5"))


@query(
    "txt_join_texts",
    f"""SELECT source, id, md5(concat_ws('  ', nullif({q.strip('detailed_description')}, ''),
    nullif({q.strip('answer')}, ''))) AS text_md5 FROM r_source""",
)
def join_texts(t: Tables):
    cols = lambda df, s, r: df.select(
        F.lit(s).alias("source"), "id",
        F.md5(tx.join_texts(F.col("detailed_description"), F.col(r))).alias("text_md5"),
    )
    return cols(t.incidents(), "incident", "resolution_summary").unionByName(
        cols(t.workorders(), "workorder", "activity_logs_text")
    )


@query(
    "txt_first_text",
    "SELECT source, source_id, md5(problem_text) AS problem_md5 FROM r_unified",
)
def first_text(t: Tables):
    from gapscope.sources.tables import unified_tickets

    u = unified_tickets(t.incidents(), t.workorders())
    return u.select("source", "source_id", F.md5("problem_text").alias("problem_md5"))


SNIPPETS = (100, 200, 300, 350, 400, 500, 600, 8000)


@query(
    "txt_snippets",
    "SELECT text_id, " + ", ".join(f"md5(substr(text, 1, {n})) AS s{n}" for n in SNIPPETS) + " FROM r_texts",
)
def snippets(t: Tables):
    return t.texts().select("text_id", *[F.md5(tx.snippet(F.col("text"), n)).alias(f"s{n}") for n in SNIPPETS])


@query("txt_gap_class", f"SELECT o_orderkey, {q.gap_class('price / 500000', 0.9, 0.87)} AS gap FROM r_tickets")
def gap_class(t: Tables):
    return t.tickets().select("o_orderkey", tx.gap_class(F.col("price") / 500000).alias("gap"))


@query(
    "txt_recommendation",
    "SELECT run_id, cluster_id, recommendation FROM r_gaps",
)
def recommendation(t: Tables):
    return t.gaps().select("run_id", "cluster_id", "recommendation")


@query(
    "txt_kb_status",
    """SELECT run_id, cluster_id, CASE WHEN size >= 25 THEN 'OVER-RELIED' WHEN size - 12 = 0 AND max_kb_sim < 0.5 THEN 'ORPHAN'
    WHEN size - 12 > 0 THEN 'ACTIVE' ELSE 'PERIPHERAL' END AS status FROM (SELECT * REPLACE (greatest(size, 12) AS size) FROM r_clusters)""",
)
def kb_status(t: Tables):
    best_for = F.greatest("size", F.lit(12)) - 12
    return t.clusters().select(
        "run_id", "cluster_id", tx.kb_status(best_for, F.col("max_kb_sim"), 0.5, 13).alias("status")
    )


@query(
    "txt_canonical_id",
    r"SELECT run_id, cluster_id, nullif(regexp_extract(recommendation, '(?i)cluster\s+([0-9]+)', 1), '')::BIGINT AS canonical FROM r_gaps",
)
def canonical_id(t: Tables):
    return t.gaps().select(
        "run_id", "cluster_id", tx.canonical_from_recommendation(F.col("recommendation")).alias("canonical")
    )




@query(
    "txt_confidence_label",
    f"""SELECT doc_id, CASE WHEN TRY_CAST(c AS DOUBLE) >= 0.85 THEN 'HIGH' WHEN TRY_CAST(c AS DOUBLE) >= 0.6 THEN 'MEDIUM'
    WHEN TRY_CAST(c AS DOUBLE) IS NULL AND upper(c) IN ('HIGH', 'MEDIUM', 'LOW') THEN upper(c) ELSE 'LOW' END AS confidence
    FROM (SELECT d.doc_id, CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'unsure' ELSE (n_chars / 4000)::VARCHAR END AS c
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
)
def confidence_label(t: Tables):
    d = t.raw("documents").join(t.raw("labels"), "doc_id", "left")
    c = F.when(F.col("quality") == 1, "high").when(F.col("toxic") == 1, "unsure").otherwise(
        (F.col("n_chars") / 4000).cast("string")
    )
    return d.select("doc_id", tx.confidence_label(c).alias("confidence"))


@query(
    "txt_parse_list",
    """SELECT event_id, array_to_string(CASE WHEN c = '' THEN NULL WHEN json_valid(c) AND json_type(c) = 'ARRAY'
    THEN from_json(c, '["VARCHAR"]') ELSE [c] END, ' | ') AS items
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN ''
          ELSE '["' || event_type || '", "' || user_id || '"]' END AS c FROM events)""",
)
def parse_list(t: Tables):
    e = t.raw("events")
    c = (
        F.when(F.col("event_type") == "view", F.col("props")).when(F.col("event_type") == "click", "")
        .otherwise(F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]')))
    )
    return e.select("event_id", listed(tx.parse_list(c)).alias("items"))


@query(
    "txt_parse_lines",
    f"""SELECT text_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
    lambda s: {q.strip('s')}), lambda s: s <> ''), ' | ')) AS items_md5 FROM r_texts WHERE text <> ''""",
)
def parse_lines(t: Tables):
    return t.texts().where("text <> ''").select("text_id", F.md5(listed(tx.parse_lines(F.col("text")))).alias("items_md5"))


@query(
    "txt_split_notes",
    f"""SELECT article_id, {q.strip("split_part(coalesce(additional_notes, ''), '---', 1)")} AS body,
    array_to_string(list_filter(list_transform(string_split({q.strip("coalesce(split_part(additional_notes, '---', 2), '')")}, '•'),
      lambda s: {q.strip('s')}), lambda s: s <> '' AND NOT contains(lower(s), 'need more help')), ' | ') AS contacts
    FROM r_articles""",
)
def split_notes(t: Tables):
    n = F.col("additional_notes")
    return t.articles().select(
        "article_id", tx.note_body(n).alias("body"), listed(tx.note_contacts(n)).alias("contacts")
    )


@query(
    "txt_nan_to_null",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events",
)
def nan_to_null(t: Tables):
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return t.raw("events").select("event_id", tx.nan_to_null(v).alias("value"))


FAULTS = (
    ("len(resolution_steps) < 2", "Too few resolution steps", 3),
    ("len(resolution_steps) = 2", "Needs more steps", 1),
    ("length(problem_statement) < 50", "Problem statement too short", 2),
    ("coalesce(escalation_trigger, '') = ''", "Missing escalation trigger", 1),
    ("confidence < 0.7", "Low model confidence", 1),
)
SCORE_SQL = "greatest(0, 10" + "".join(f" - CASE WHEN {c} THEN {p} ELSE 0 END" for c, _, p in FAULTS) + ")"
ISSUES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{i}' END" for c, i, _ in FAULTS) + "], lambda s: s IS NOT NULL)"


def article_parts():
    return F.col("resolution_steps"), F.col("problem_statement"), F.col("escalation_trigger"), F.col("confidence")


@query(
    "art_quality_score",
    f"""SELECT article_id, {SCORE_SQL} AS score, array_to_string({ISSUES_SQL}, ' | ') AS issues, {SCORE_SQL} < 6 AS needs_review
    FROM r_articles""",
)
def quality_score(t: Tables):
    score = ar.quality_score(*article_parts())
    return t.articles().select(
        "article_id", score.alias("score"), listed(ar.quality_issues(*article_parts())).alias("issues"),
        (score < 6).alias("needs_review"),
    )


@query(
    "art_low_evidence",
    f"""SELECT article_id, confidence - 0.4 < 0.2 AS low,
    array_to_string(CASE WHEN confidence - 0.4 < 0.2 THEN list_append({ISSUES_SQL}, {q.lit(ar.LOW_EVIDENCE_ISSUE)}) ELSE {ISSUES_SQL} END, ' | ') AS issues,
    CASE WHEN confidence - 0.4 >= 0.2 THEN additional_notes
         WHEN additional_notes IS NULL AND gap_flag = 'CRITICAL' THEN {q.lit(ar.ABSENT_NOTE)}
         ELSE coalesce(additional_notes, '') || {q.lit(ar.LOW_EVIDENCE_NOTE)} END AS notes
    FROM r_articles""",
)
def low_evidence(t: Tables):
    e = F.col("confidence") - 0.4
    return t.articles().select(
        "article_id", ar.low_evidence(e).alias("low"),
        listed(ar.issues_with_evidence(ar.quality_issues(*article_parts()), e)).alias("issues"),
        ar.notes_with_evidence(F.col("additional_notes"), e, F.col("gap_flag")).alias("notes"),
    )


@query(
    "art_embedding_text",
    "SELECT article_id, md5(title || ' ' || problem_statement || ' ' || coalesce(array_to_string(resolution_steps, ' '), '')) AS text_md5 FROM r_articles",
)
def embedding_text(t: Tables):
    c = ar.embedding_text(F.col("title"), F.col("problem_statement"), F.col("resolution_steps"))
    return t.articles().select("article_id", F.md5(c).alias("text_md5"))


@query(
    "art_verdict_normalised",
    """SELECT event_id, CASE WHEN upper(v) IN ('VALIDATED', 'PARTIAL', 'INSUFFICIENT') THEN upper(v) ELSE 'PARTIAL' END AS verdict
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'validated' WHEN 'click' THEN 'Insufficient' WHEN 'error' THEN NULL ELSE event_type END AS v FROM events)""",
)
def verdict_normalised(t: Tables):
    kind = F.col("event_type")
    v = F.when(kind == "view", "validated").when(kind == "click", "Insufficient").when(kind != "error", kind)
    return t.raw("events").select("event_id", ar.normalise_verdict(v).alias("verdict"))


VERDICT_SQL = """CASE WHEN verdict = 'INSUFFICIENT' THEN 'FAIL'
  WHEN flag = 'PARTIAL' THEN CASE WHEN verdict = 'VALIDATED' AND aligned THEN 'VALIDATED' ELSE 'PARTIAL' END
  WHEN NOT novel AND NOT aligned THEN 'FAIL' WHEN verdict = 'VALIDATED' AND novel AND aligned THEN 'VALIDATED' ELSE 'PARTIAL' END"""


@query(
    "art_final_verdict",
    f"""SELECT event_id, {VERDICT_SQL} AS status FROM (SELECT event_id, value >= 50 AS novel, user_id >= 75 AS aligned,
      CASE event_type WHEN 'view' THEN 'VALIDATED' WHEN 'click' THEN 'INSUFFICIENT' WHEN 'purchase' THEN 'VALIDATED' ELSE 'PARTIAL' END AS verdict,
      CASE WHEN value < 25 OR value >= 75 THEN 'PARTIAL' ELSE 'CRITICAL' END AS flag FROM events)""",
)
def final_verdict(t: Tables):
    kind, value = F.col("event_type"), F.col("value")
    verdict = F.when(kind.isin("view", "purchase"), "VALIDATED").when(kind == "click", "INSUFFICIENT").otherwise("PARTIAL")
    flag = F.when((value < 25) | (value >= 75), "PARTIAL").otherwise("CRITICAL")
    return t.raw("events").select(
        "event_id", ar.final_verdict(verdict, value >= 50, F.col("user_id") >= 75, flag).alias("status")
    )


@query(
    "art_fallback_verdict",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value >= 50 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END
    ELSE 'VALIDATED' END AS verdict FROM events""",
)
def fallback_verdict(t: Tables):
    failed = F.col("event_type") == "error"
    return t.raw("events").select(
        "event_id", F.when(failed, ar.fallback_verdict(F.col("value") >= 50)).otherwise("VALIDATED").alias("verdict")
    )


@query(
    "txt_accept_label",
    f"""SELECT text_id, md5(CASE WHEN len({q.words('s')}) BETWEEN 2 AND 8 THEN {q.strip('s')} ELSE text_id END) AS label_md5
    FROM (SELECT text_id, split_part(text, chr(10), 1) AS s FROM r_texts)""",
)
def accept_label(t: Tables):
    return t.texts().select(
        "text_id", F.md5(tx.accept_label(F.split("text", "\n", 2)[0], F.col("text_id"))).alias("label_md5")
    )


@query(
    "txt_reply_keys",
    """SELECT event_id, props FROM events WHERE json_valid(props) AND json_exists(props, '$.k')""",
)
def reply_keys(t: Tables):
    from gapscope.plans.review import has_keys

    return t.raw("events").where(has_keys(F.col("props"), ["k"])).select("event_id", "props")


@query(
    "txt_label_tokens",
    f"""SELECT text_id, len(w)::INTEGER AS tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (
      SELECT text_id, list_filter(regexp_extract_all({q.normalise_terms('text')}, '[a-zA-Z]{{3,}}'),
        lambda s: s NOT IN ({', '.join(q.lit(s) for s in STOP_WORDS)})) AS w FROM r_texts)""",
)
def label_tokens(t: Tables):
    assert set(TICKET_STOP_WORDS) <= set(STOP_WORDS)
    w = t.texts().select("text_id", lb.tokens(F.col("text"), STOP_WORDS).alias("w"))
    return w.select("text_id", F.size("w").alias("tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))
