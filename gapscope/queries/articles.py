"""Drafting, validation, retrieval, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope import ledger as lg
from gapscope.config import Thresholds
from gapscope.functions import article_rules as ar
from gapscope.operators import clustering as cl
from gapscope.operators.rounds import cut
from gapscope.plans import audits as au
from gapscope.plans import drafting as dr
from gapscope.plans import retrieval as rt
from gapscope.queries import roles as r
from gapscope.plans import validation as va
from gapscope.queries.roles import Tables
from gapscope.queries import sql_roles as q
from gapscope.queries.gaps import TIER
from gapscope.queries.registry import query
from gapscope.queries.texts import ISSUES_SQL, SCORE_SQL, VERDICT_SQL, listed
from gapscope.sources import tables as tb

STATED = "('', 'Unknown', 'N/A', 'None', 'none')"
MODES = f"""SELECT run_id, cluster_id, arg_min(service_type, (-n, service_type)) AS service_type FROM (
    SELECT run_id, cluster_id, service_type, count(*) AS n FROM r_assign WHERE service_type NOT IN {STATED} GROUP BY ALL) GROUP BY ALL"""
CRITICAL = f"SELECT g.*, coalesce(m.service_type, 'Unknown') AS service_type FROM r_gaps g LEFT JOIN ({MODES}) m USING (run_id, cluster_id) WHERE gap_flag = 'CRITICAL'"


def critical(t: Tables):
    return dr.critical_gaps(t.gaps(), t.assignments())


@query("art_critical_gaps", f"SELECT run_id, cluster_id, cluster_label, size, priority_score, service_type FROM ({CRITICAL}) ORDER BY priority_score DESC")
def critical_gaps(t: Tables):
    return critical(t).select("run_id", "cluster_id", "cluster_label", "size", "priority_score", "service_type")


def balanced_sql(budget: int) -> str:
    return f"""WITH c AS ({CRITICAL}), ty AS (SELECT run_id, service_type, count(*) AS n, max(priority_score) AS best FROM c GROUP BY ALL),
    s1 AS (SELECT *, sum(n) OVER (PARTITION BY run_id) AS total FROM ty),
    s2 AS (SELECT *, greatest(1, round_even({budget} * n / total, 0)::BIGINT) AS share FROM s1),
    s3 AS (SELECT *, sum(share) OVER (PARTITION BY run_id) AS drawn FROM s2),
    s4 AS (SELECT *, CASE WHEN drawn > {budget} THEN greatest(1, floor(share * ({budget} / drawn))) ELSE share END AS slots FROM s3),
    s5 AS (SELECT *, sum(slots) OVER (PARTITION BY run_id) AS used, row_number() OVER (PARTITION BY run_id ORDER BY best DESC, service_type) AS place FROM s4),
    s6 AS (SELECT *, slots + CASE WHEN drawn > {budget} AND place <= {budget} - used THEN 1 ELSE 0 END AS final FROM s5),
    k AS (SELECT c.*, total, final, row_number() OVER (PARTITION BY c.run_id, c.service_type ORDER BY c.priority_score DESC, c.cluster_id) AS r1 FROM c JOIN s6 USING (run_id, service_type)),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority_score DESC, cluster_id) AS r2 FROM k WHERE total <= {budget} OR r1 <= final)
    SELECT run_id, cluster_id, service_type, priority_score FROM o WHERE r2 <= {budget}"""


@query("art_balanced_gaps", balanced_sql(13))
def balanced_gaps(t: Tables):
    return dr.balanced_gaps(critical(t), 13).select("run_id", "cluster_id", "service_type", "priority_score")


@query("art_partial_gaps", "SELECT g.run_id, g.cluster_id, g.best_kb_id, k.issue AS kb_issue, md5(k.solution) AS solution_md5 FROM r_gaps g LEFT JOIN r_kb k ON k.kb_id = g.best_kb_id WHERE g.gap_flag = 'PARTIAL'")
def partial_gaps(t: Tables):
    p = dr.partial_gaps(t.gaps(), t.kb())
    return p.select("run_id", "cluster_id", "best_kb_id", "kb_issue", F.md5("kb_solution").alias("solution_md5"))


EVIDENCE = """SELECT * FROM (SELECT a.run_id, a.cluster_id, a.source, a.source_id, coalesce(e.evidence_tier, 4) AS tier, u.problem_text, u.resolution_text,
    row_number() OVER (PARTITION BY a.run_id, a.cluster_id ORDER BY coalesce(e.evidence_tier, 4), md5('42|' || a.source || '|' || a.source_id), a.source, a.source_id) AS pick
    FROM r_assign a JOIN r_unified u USING (source, source_id) LEFT JOIN r_rows e ON e.run_id = a.run_id AND e.source = a.source AND e.source_id = a.source_id
    WHERE length(replace(u.resolution_text, '***', '')) > 30) WHERE pick <= 5"""


def evidence(t: Tables):
    return dr.cluster_evidence(t.assignments(), tb.unified_tickets(t.incidents(), t.workorders()), t.ticket_rows())


@query("art_evidence", f"SELECT run_id, cluster_id, source, source_id, tier, pick, md5(problem_text) AS problem_md5, md5(resolution_text) AS resolution_md5 FROM ({EVIDENCE})")
def cluster_evidence(t: Tables):
    e = evidence(t)
    return e.select(
        "run_id", "cluster_id", "source", "source_id", "tier", F.col("pick").cast("long").alias("pick"),
        F.md5("problem_text").alias("problem_md5"), F.md5("resolution_text").alias("resolution_md5"),
    )


EV_SCORE = f"SELECT run_id, cluster_id, count(*) AS evidence_count, least(1, sum({TIER.replace('coalesce(evidence_tier, 4)', 'tier')}) / (3.0 * count(*))) AS ev_quality FROM ({EVIDENCE}) GROUP BY ALL"


@query("art_evidence_scores", f"SELECT g.run_id, g.cluster_id, coalesce(evidence_count, 0) AS evidence_count, round(coalesce(ev_quality, 0), 6) AS ev_quality FROM r_gaps g LEFT JOIN ({EV_SCORE}) USING (run_id, cluster_id)")
def evidence_scores(t: Tables):
    s = dr.evidence_scores(t.gaps(), evidence(t))
    return s.select("run_id", "cluster_id", "evidence_count", F.round("ev_quality", 6).alias("ev_quality"))


def open_gaps(t: Tables):
    gaps = t.gaps().withColumn("top_terms", F.when(F.col("cluster_id") % 4 != 0, F.col("cluster_label")))
    none = F.lit(None).cast("string")
    critical_ones = dr.critical_gaps(gaps, t.assignments()).drop("service_type").withColumn("kb_issue", none).withColumn("kb_solution", none)
    return critical_ones.unionByName(dr.partial_gaps(gaps, t.kb()))


ITEMS = f"""SELECT run_id, cluster_id, list('<item>' || chr(10) || '<problem>' || substr(coalesce(problem_text, ''), 1, 400) || '</problem>' || chr(10) || '<resolution>' || substr(resolution_text, 1, 600)
    || '</resolution>' || chr(10) || '</item>' ORDER BY pick) AS items FROM ({EVIDENCE}) GROUP BY ALL"""


@query("art_prompts", f"""WITH g AS (SELECT g.*, k.issue AS kb_issue, k.solution AS kb_solution, coalesce(i.items, []) AS items FROM r_gaps g LEFT JOIN r_kb k ON k.kb_id = g.best_kb_id AND g.gap_flag = 'PARTIAL'
      LEFT JOIN ({ITEMS}) i ON i.run_id = g.run_id AND i.cluster_id = g.cluster_id WHERE g.gap_flag IN ('CRITICAL', 'PARTIAL')),
    tries AS (SELECT *, unnest(list_distinct([len(items), greatest(len(items) - 2, 0), 0])) AS shown FROM g)
    SELECT run_id, cluster_id, shown::BIGINT AS shown, md5('Write a help-desk article for this gap.' || chr(10) || 'Topic: ' || cluster_label || chr(10) || 'Tickets: ' || format('{{:,}}', size) || chr(10) || 'Terms: '
      || CASE WHEN cluster_id % 4 <> 0 THEN cluster_label ELSE 'N/A' END || chr(10) || 'Priority: ' || round(priority_score::DECIMAL(18, 4), 2)::VARCHAR
      || CASE WHEN gap_flag = 'PARTIAL' THEN chr(10) || 'This article covers part of it; write only what it leaves out.' || chr(10) || 'Title: ' || coalesce(best_kb_title, '') || chr(10)
        || 'Issue: ' || substr(coalesce(kb_issue, ''), 1, 400) || chr(10) || 'Solution: ' || substr(coalesce(kb_solution, ''), 1, 600) || chr(10) ELSE '' END
      || chr(10) || 'Evidence:' || chr(10) || CASE WHEN shown > 0 THEN array_to_string(items[1:shown], chr(10)) ELSE '(none: write a general article)' END || chr(10) || chr(10)
      || 'Reply with one JSON object: title, category, keywords, problem_statement, affected_systems, resolution_steps, additional_notes, escalation_trigger, confidence.') AS prompt_md5 FROM tries""")
def draft_prompts(t: Tables):
    """Every prompt that may be tried, by the number of evidence items in it."""
    e = cut(evidence(t))
    p = dr.draft_prompts(dr.evidence_scores(open_gaps(t), e), e).select("run_id", "cluster_id", F.posexplode("prompts").alias("at", "prompt"))
    n = e.groupBy("run_id", "cluster_id").agg(F.count("*").alias("n"))
    # The tries are the distinct ones of: all items, two less, none.
    tries = F.array_distinct(F.array(F.coalesce("n", F.lit(0)), F.greatest(F.coalesce("n", F.lit(0)) - 2, F.lit(0)), F.lit(0)))
    shown = F.get(tries, F.col("at")).cast("long")
    return p.join(n, ["run_id", "cluster_id"], "left").select("run_id", "cluster_id", shown.alias("shown"), F.md5("prompt").alias("prompt_md5"))


@query("art_replies", """SELECT run_id, cluster_id, title, len(resolution_steps) AS steps, confidence::DOUBLE AS confidence, escalation_trigger, md5(problem_statement) AS problem_md5
    FROM r_articles WHERE quality = 1 AND title IS NOT NULL""")
def draft_replies(t: Tables):
    """Replies made from the documents: whole articles, some without a title, some that are no JSON."""
    fields = ["category", "problem_statement", "resolution_steps", "additional_notes", "escalation_trigger", "confidence"]
    reply = F.when(F.col("quality") == 1, F.to_json(F.struct("title", *fields))).when(F.col("toxic") == 1, F.to_json(F.struct(*fields))).otherwise("no answer")
    a = dr.parse_drafts(t.articles().select("run_id", "cluster_id", reply.alias("reply")))
    return a.select("run_id", "cluster_id", "title", F.size("resolution_steps").cast("long").alias("steps"), "confidence", "escalation_trigger", F.md5("problem_statement").alias("problem_md5"))


@query("art_assemble", f"""SELECT article_id, {SCORE_SQL} AS quality_score, {SCORE_SQL} < 6 OR ev < 0.2 AS needs_review, round(ev, 3) AS ev_quality,
    array_to_string(CASE WHEN ev < 0.2 THEN list_append({ISSUES_SQL}, {q.lit(ar.LOW_EVIDENCE_ISSUE)}) ELSE {ISSUES_SQL} END, ' | ') AS issues,
    md5(title || ' ' || problem_statement || ' ' || coalesce(array_to_string(resolution_steps, ' '), '')) AS text_md5
    FROM (SELECT *, length(problem_statement) / 10000 AS ev FROM r_articles)""")
def assemble(t: Tables):
    a = dr.assemble(t.articles().drop("article_embedding").withColumn("ev_quality", F.length("problem_statement") / 10000))
    return a.select(
        "article_id", "quality_score", "needs_review", "ev_quality", listed(F.col("quality_issues")).alias("issues"),
        F.md5("embedding_text").alias("text_md5"),
    )


def scored_articles(t: Tables):
    a = t.articles().withColumn("priority_score", F.length("problem_statement") / 1000)
    parts = (F.col("resolution_steps"), F.col("problem_statement"), F.col("escalation_trigger"), F.col("confidence"))
    return dr.list_order(a.withColumn("quality_score", ar.quality_score(*parts)))


@query("art_list_order", """SELECT run_id, article_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN gap_flag = 'CRITICAL' THEN 0 ELSE 1 END,
    length(problem_statement) DESC, cluster_id) AS position FROM r_articles""")
def list_order(t: Tables):
    return scored_articles(t).select("run_id", "article_id", "position")


DUPLICATE_WALK = f"""WITH RECURSIVE a AS (SELECT *, {SCORE_SQL} AS q, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN gap_flag = 'CRITICAL' THEN 0 ELSE 1 END,
      length(problem_statement) DESC, cluster_id) AS place FROM r_articles),
    p AS (SELECT x.run_id, x.place AS i, y.place AS j, x.q AS qi, y.q AS qj, row_number() OVER (PARTITION BY x.run_id ORDER BY x.place, y.place) AS n
      FROM a x JOIN a y ON x.run_id = y.run_id AND x.place < y.place AND x.article_embedding IS NOT NULL AND y.article_embedding IS NOT NULL
      AND {q.cosine('x.article_embedding', 'y.article_embedding')} > 0.2),
    walk AS (SELECT DISTINCT run_id, 0::BIGINT AS n, 0::BIGINT AS i, false AS skip, []::BIGINT[] AS dups, []::BIGINT[] AS kept FROM p
      UNION ALL SELECT run_id, n, i, skip, CASE WHEN acts THEN list_append(dups, CASE WHEN qi >= qj THEN j ELSE i END) ELSE dups END,
        CASE WHEN acts THEN list_append(kept, CASE WHEN qi >= qj THEN i ELSE j END) ELSE kept END
      FROM (SELECT *, NOT skip AND NOT list_contains(dups, j) AS acts FROM (
        SELECT w.run_id, p.n, p.i, p.j, p.qi, p.qj, w.dups, w.kept, CASE WHEN p.i = w.i THEN w.skip ELSE list_contains(w.dups, p.i) END AS skip
        FROM walk w JOIN p ON p.run_id = w.run_id AND p.n = w.n + 1))),
    e AS (SELECT run_id, arg_max(dups, n) AS dups, arg_max(kept, n) AS kept FROM walk GROUP BY run_id),
    u AS (SELECT run_id, unnest(dups) AS d, unnest(kept) AS k, unnest(range(len(dups))) AS seq FROM e),
    f AS (SELECT run_id, d, arg_max(k, seq) AS k FROM u GROUP BY ALL)
    SELECT a.run_id, a.article_id, a.cluster_id, b.cluster_id AS duplicate_of FROM a LEFT JOIN f ON f.run_id = a.run_id AND f.d = a.place LEFT JOIN a b ON b.run_id = f.run_id AND b.place = f.k"""


@query("art_mark_duplicates", DUPLICATE_WALK)
def mark_duplicates(t: Tables):
    a = dr.mark_duplicates(cut(scored_articles(t)), bound=0.2)
    return a.select("run_id", "article_id", "cluster_id", "duplicate_of")


@query("art_resolve_duplicates", "SELECT a.article_id, b.article_id AS is_duplicate_of FROM r_articles a LEFT JOIN r_articles b ON b.run_id = a.run_id AND b.cluster_id = a.cluster_id - 1")
def resolve_duplicates(t: Tables):
    a = t.articles().withColumn("duplicate_of", F.col("cluster_id") - 1)
    return dr.resolve_duplicates(a).select("article_id", "is_duplicate_of")


# A document's text is read as the one ticket behind its draft.
@query("val_prompts", """SELECT run_id, article_id, md5(CASE WHEN gap_flag = 'PARTIAL' THEN 'The article supplements a known one; overlap is expected. Judge only what it adds.'
      ELSE 'No known article covers this topic. Judge whether the draft settles it.' END || chr(10) || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Problem: ' || coalesce(problem_statement, '')
    || chr(10) || 'Steps:' || chr(10) || coalesce(array_to_string(resolution_steps, chr(10)), '') || chr(10) || 'Escalation: ' || coalesce(escalation_trigger, '') || chr(10) || chr(10) || 'Evidence:' || chr(10)
    || CASE WHEN toxic = 0 THEN '<item>' || chr(10) || '<problem>' || substr(coalesce(problem_statement, ''), 1, 350) || '</problem>' || chr(10) || '<resolution>' || substr(title, 1, 500) || '</resolution>'
      || chr(10) || '</item>' ELSE '(no ticket evidence available)' END || chr(10) || chr(10) || 'Verdict rule: '
    || CASE WHEN gap_flag = 'PARTIAL' THEN 'VALIDATED from 7 on, PARTIAL from 4 to 6, INSUFFICIENT below 4' ELSE 'VALIDATED from 7 on with gap_confirmed, PARTIAL from 4 to 6, INSUFFICIENT below 4' END
    || chr(10) || 'Reply with one JSON object: coverage_score, gap_confirmed, missing_elements, verdict, critique.') AS prompt_md5 FROM r_articles""")
def critique_prompts(t: Tables):
    a = t.articles()
    proof = a.where("toxic = 0").select(
        "run_id", "cluster_id", F.col("problem_statement").alias("problem_text"), F.col("title").alias("resolution_text"), F.lit(1).alias("pick")
    )
    return va.critique_prompts(a, proof).select("run_id", "article_id", F.md5("prompt").alias("prompt_md5"))


# --- validation --------------------------------------------------------------


def labelled_articles(t: Tables):
    return t.articles().where(F.col("article_embedding").isNotNull()).withColumn("cluster_id", F.col("article_label"))


def label_centroids(t: Tables):
    """Mean vector per language and label."""
    lang = t.raw("documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("run_id"))
    return cl.centroids(t.vectors().withColumnRenamed("label", "cluster_id").join(lang, "vec_id"), "vec", ["run_id", "cluster_id"])


def critiqued(t: Tables):
    """Replies made from the labels; toxic drafts got none."""
    label = F.col("article_label")
    verdict = F.when(label >= 7, "validated").when(label >= 3, "other").otherwise("Insufficient")
    reply = F.to_json(F.struct((F.col("quality") * 4 + 3).alias("coverage_score"), (label >= 5).alias("gap_confirmed"), verdict.alias("verdict")))
    a = t.articles().where("toxic = 0 AND article_embedding IS NOT NULL")
    return va.normalise_critiques(a.select("run_id", "article_id", reply.alias("reply")))


def validated(t: Tables):
    limits = Thresholds(novelty_critical=r.NOVEL_CRITICAL, novelty_other=r.NOVEL_OTHER, alignment=r.ALIGNED)
    existing = t.kb().where("kb_vec IS NOT NULL").withColumnRenamed("title", "kb_title")
    return va.validation_rows(labelled_articles(t), existing, label_centroids(t), critiqued(t), limits)


LABEL_CENTROIDS = """SELECT run_id, label, list(m ORDER BY i) AS centroid FROM (SELECT d.lang AS run_id, v.label, i, avg(v.vec[i]) AS m
    FROM r_vec v JOIN documents d ON d.doc_id = v.vec_id, range(1, 65) AS g(i) GROUP BY ALL) GROUP BY ALL"""
REPLIED = """SELECT article_id, (quality * 4 + 3)::DOUBLE AS score, article_label >= 5 AS confirmed,
    CASE WHEN article_label >= 7 THEN 'VALIDATED' WHEN article_label >= 3 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS verdict FROM r_articles WHERE toxic = 0"""
VALIDATION = f"""SELECT *, {VERDICT_SQL} AS validation_status FROM (
    SELECT n.run_id, n.article_id, n.gap_flag AS flag, p.score AS review_coverage_score, n.novel, coalesce(c.s >= {r.ALIGNED}, false) AS aligned,
      CASE WHEN p.verdict IS NULL THEN n.novel ELSE p.confirmed END AS review_gap_confirmed,
      coalesce(p.verdict, CASE WHEN coalesce(c.s >= {r.ALIGNED}, false) THEN 'PARTIAL' ELSE 'INSUFFICIENT' END) AS verdict, p.verdict IS NULL AS review_fallback,
      round(coalesce(n.sim, 0), 4) AS max_existing_kb_sim, coalesce(n.title, '') AS closest_existing_kb, round(coalesce(c.s, 0), 4) AS cluster_alignment_score
    FROM (SELECT *, coalesce(sim < CASE WHEN gap_flag = 'CRITICAL' THEN {r.NOVEL_CRITICAL} ELSE {r.NOVEL_OTHER} END, true) AS novel FROM (
      SELECT a.run_id, a.article_id, a.gap_flag, k.title, {q.cosine('a.article_embedding', 'k.kb_vec')} AS sim,
        row_number() OVER (PARTITION BY a.article_id ORDER BY {q.cosine('a.article_embedding', 'k.kb_vec')} DESC, k.kb_id) AS n
      FROM r_articles a LEFT JOIN r_kb k ON k.run_id = a.run_id WHERE a.article_embedding IS NOT NULL) WHERE n = 1) n
    JOIN (SELECT a.article_id, {q.cosine('a.article_embedding', 'l.centroid')} AS s FROM r_articles a LEFT JOIN ({LABEL_CENTROIDS}) l ON l.run_id = a.run_id AND l.label = a.article_label) c USING (article_id)
    LEFT JOIN ({REPLIED}) p USING (article_id))"""


@query("val_critiques", """SELECT article_id, (quality * 4 + 3)::DOUBLE AS coverage_score, article_label >= 5 AS gap_confirmed,
    CASE WHEN article_label >= 7 THEN 'VALIDATED' WHEN article_label >= 3 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS verdict
    FROM r_articles WHERE toxic = 0 AND article_embedding IS NOT NULL""")
def val_critiques(t: Tables):
    return critiqued(t).select("article_id", "coverage_score", "gap_confirmed", "verdict")


@query("val_rows", f"""SELECT run_id, article_id, flag AS gap_flag, review_coverage_score, review_gap_confirmed, verdict AS review_verdict, review_fallback, max_existing_kb_sim,
    closest_existing_kb, cluster_alignment_score, novel AS novelty_pass, aligned AS alignment_pass, validation_status FROM ({VALIDATION})""")
def val_rows(t: Tables):
    return validated(t).drop("cluster_id", "review_critique", "review_missing_elements")


def metric(place: int, name: str, result: str, target: str, status: str) -> str:
    return f"SELECT run_id, {place} AS place, {q.lit(name)} AS metric, {result} AS result, '{target}' AS target, {status} AS status, 'validation' AS category FROM a"


def grade(test: str, miss: str) -> str:
    return f"CASE WHEN {test} THEN 'Pass ✅' ELSE '{miss}' END"


def of(c: str) -> str:
    return f"{c} || '/' || n || ' (' || format('{{:.0f}}', {c} / n * 100) || '%)'"


@query("val_scorecard", f"""WITH a AS (SELECT run_id, count(*) AS n, count(*) FILTER (validation_status = 'VALIDATED') AS ok, count(*) FILTER (validation_status = 'PARTIAL') AS part,
    count(*) FILTER (validation_status = 'FAIL') AS bad, count(*) FILTER (novel) AS new, coalesce(avg(review_coverage_score), 0) AS score, coalesce(avg(cluster_alignment_score), 0) AS near
    FROM ({VALIDATION}) GROUP BY run_id)
    {metric(1, 'Articles fully validated (VALIDATED)', of('ok'), '> 70%', grade('ok / n * 100 >= 70', 'Fail ❌'))}
    UNION ALL {metric(2, 'Articles partially valid (PARTIAL)', of('part'), '—', "'Info'")}
    UNION ALL {metric(3, 'Articles failed validation (FAIL)', of('bad'), '< 10%', grade('bad / n * 100 < 10', 'Fail ❌'))}
    UNION ALL {metric(4, 'Mean LLM coverage score (0-10)', "format('{:.1f}', score) || '/10'", '> 6.0', grade('score >= 6', 'Fail ❌'))}
    UNION ALL {metric(5, 'Articles with gap novelty confirmed', of('new'), '> 80%', grade('new / n * 100 >= 80', 'Warn ⚠'))}
    UNION ALL {metric(6, 'Mean cluster alignment score', "format('{:.3f}', near)", '> 0.75', grade('near >= 0.75', 'Warn ⚠'))}""")
def scorecard(t: Tables):
    return va.scorecard(validated(t))


@query("val_to_review", f"SELECT run_id, article_id FROM ({VALIDATION}) WHERE validation_status IN ('PARTIAL', 'FAIL')")
def to_review(t: Tables):
    return va.to_review(validated(t))


# --- retrieval ---------------------------------------------------------------

HITS = f"""SELECT conv_id, run_id, source || ':' || source_id AS entry, rank, greatest(0, sim) AS similarity, title, category, {q.strip('substr(content, 1, 400)')} AS snippet, is_generated FROM (
    SELECT c.conv_id, i.*, {q.cosine('c.query_vec', 'i.embedding')} AS sim,
      row_number() OVER (PARTITION BY c.conv_id ORDER BY {q.cosine('c.query_vec', 'i.embedding')} DESC, i.source || ':' || i.source_id) AS rank
    FROM r_questions c JOIN r_index i ON i.run_id = c.run_id) WHERE rank <= 4"""


def hits(t: Tables):
    return rt.retrieve(t.questions(), t.search_index())


@query("rag_retrieve", f"SELECT conv_id, entry, rank, similarity, title, category, md5(snippet) AS snippet_md5, is_generated FROM ({HITS})")
def retrieve(t: Tables):
    return hits(t).select("conv_id", "entry", F.col("rank").cast("long").alias("rank"), "similarity", "title", "category", F.md5("snippet").alias("snippet_md5"), "is_generated")


@query("rag_shown_sources", f"SELECT conv_id, entry FROM ({HITS}) WHERE similarity >= 0.25")
def shown_sources(t: Tables):
    return rt.shown_sources(hits(t), 0.25).select("conv_id", "entry")


CONTEXT = f"""SELECT conv_id, string_agg('[' || rank || '] ' || title || ' (' || CASE WHEN is_generated THEN 'Generated KB' ELSE 'Existing KB' END || ' | ' || category || ')' || chr(10) || snippet,
    chr(10) || chr(10) ORDER BY rank) AS context FROM ({HITS}) GROUP BY conv_id"""


@query("rag_context", f"SELECT conv_id, md5(context) AS context_md5 FROM ({CONTEXT})")
def context(t: Tables):
    return rt.contexts(hits(t)).select("conv_id", F.md5("context").alias("context_md5"))


@query("rag_messages", f"""SELECT c.conv_id, md5('system:' || coalesce(x.context, '') || chr(10) || coalesce(h.said || chr(10), '') || 'user:' || c.question) AS messages_md5
    FROM r_questions c LEFT JOIN ({CONTEXT}) x USING (conv_id) LEFT JOIN (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS said FROM (
      SELECT t.*, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn DESC) AS back FROM conversations t JOIN r_questions u ON u.conv_id = t.conv_id AND t.turn < u.turn)
      WHERE back <= 3 AND role IN ('user', 'assistant') GROUP BY conv_id) h USING (conv_id)""")
def messages(t: Tables):
    asked = t.questions()
    history = t.raw("conversations").join(asked.select("conv_id", F.col("turn").alias("asked")), "conv_id").where("turn < asked")
    m = rt.messages(history, asked, rt.contexts(hits(t)), keep=3)
    flat = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return m.select("conv_id", F.md5(flat).alias("messages_md5"))


# --- audits ------------------------------------------------------------------


@query("audit_service_distribution", """SELECT a.run_id, service_type, count(*) FILTER (gap_flag = 'CRITICAL') AS critical, count(*) FILTER (gap_flag = 'PARTIAL') AS partial,
    count(*) FILTER (gap_flag = 'COVERED') AS covered, count(*) AS total FROM r_assign a JOIN r_gaps g USING (run_id, cluster_id) GROUP BY ALL""")
def service_distribution(t: Tables):
    return au.service_distribution(t.assignments(), t.gaps())


@query("audit_coverage_delta", """SELECT coalesce(b.run_id, a.run_id) AS run_id, coalesce(b.flag, a.flag) AS flag, coalesce(nb, 0) AS count_before, coalesce(na, 0) AS count_after, coalesce(na, 0) - coalesce(nb, 0) AS delta
    FROM (SELECT run_id, gap_flag AS flag, count(*) AS nb FROM r_clusters WHERE gap_flag <> 'DUPLICATE' GROUP BY ALL) b
    FULL JOIN (SELECT run_id, CASE WHEN gap_flag = 'CRITICAL' AND size >= 18 THEN 'PARTIAL' ELSE gap_flag END AS flag, count(*) AS na FROM r_clusters WHERE gap_flag <> 'DUPLICATE' GROUP BY ALL) a
    ON a.run_id = b.run_id AND a.flag = b.flag""")
def coverage_delta(t: Tables):
    after = t.clusters().withColumn("gap_flag", F.when(F.expr("gap_flag = 'CRITICAL' AND size >= 18"), "PARTIAL").otherwise(F.col("gap_flag")))
    return au.coverage_delta(t.clusters(), after)


BIAS = """WITH o AS (SELECT a.run_id, service_type, gap_flag, count(*) AS o FROM r_assign a JOIN r_gaps g USING (run_id, cluster_id) GROUP BY ALL),
    e AS (SELECT *, sum(o) OVER (PARTITION BY run_id, service_type) AS row, sum(o) OVER (PARTITION BY run_id, gap_flag) AS col, sum(o) OVER (PARTITION BY run_id) AS n FROM o)
    SELECT run_id, sum(o * o / (row * col / n)) - any_value(n) AS statistic, (count(DISTINCT service_type) - 1) * (count(DISTINCT gap_flag) - 1) AS degrees_of_freedom,
    arg_max(service_type, (round(o - row * col / n, 6), service_type)) FILTER (gap_flag = 'CRITICAL') AS most_affected FROM e GROUP BY run_id"""


@query("audit_bias_statistic", f"SELECT run_id, round(statistic, 6) AS statistic, degrees_of_freedom, most_affected FROM ({BIAS})")
def bias_statistic(t: Tables):
    return au.bias_statistic(t.assignments(), t.gaps()).withColumn("statistic", F.round("statistic", 6))


# The tail of chi-square as 1 less the series of the incomplete gamma function, term by term from lgamma.
TAIL = """1 - list_sum([exp(d / 2.0 * ln(x / 2.0) - x / 2.0 - lgamma(d / 2.0 + n + 1) + n * ln(x / 2.0)) FOR n IN range(0, CAST(ceil(x) AS BIGINT) + 200)])"""


@query("audit_bias_p_value", f"""SELECT run_id, 'chi2_contingency' AS test_name, round(x, 6) AS statistic, d AS degrees_of_freedom, round(p, 9) AS p_value, p < 0.05 AS bias_detected FROM (
    SELECT *, CASE WHEN d <= 0 OR x <= 0 THEN 1.0 WHEN x > d + 100 THEN 0.0 ELSE greatest(0.0, {TAIL}) END AS p FROM (SELECT run_id, statistic AS x, degrees_of_freedom AS d FROM ({BIAS})))""")
def bias_p_value(t: Tables):
    p = au.bias_p_value(t.assignments(), t.gaps())
    return p.withColumn("statistic", F.round("statistic", 6)).withColumn("p_value", F.round("p_value", 9))



def findings_sql() -> str:
    fields = {"title": "title", "problem_statement": "problem_statement", "resolution_steps": "array_to_string(resolution_steps, chr(10))", "additional_notes": "additional_notes"}
    return " UNION ALL ".join(
        f"SELECT run_id, article_id, cluster_id, '{f}' AS field, '{kind}' AS pii_type, '{level}' AS severity, unnest(regexp_extract_all({c}, {q.rx(p)})) AS match FROM r_articles"
        for f, c in fields.items() for kind, p, level in au.PERSONAL_DATA
    )


@query("audit_personal_findings", findings_sql())
def personal_findings(t: Tables):
    return au.personal_findings(t.articles())


# --- replies of models ---------------------------------------------------------

CALLS = "SELECT doc_id, sha256('m' || chr(10) || text) AS call, text FROM documents WHERE text IS NOT NULL"
LEDGER = f"""SELECT call, CASE WHEN toxic = 0 AND quality = 1 THEN 'good' END AS reply, CASE WHEN toxic = 1 THEN 'TimeoutError: late' WHEN quality = 0 THEN 'refused' END AS failure, doc_id AS stamp
    FROM ({CALLS}) JOIN labels USING (doc_id)"""


def ledger_tables(t: Tables):
    """Documents play prompts; labels play what a ledger holds: replies, refusals and calls that failed."""
    d = t.raw("documents").select("doc_id", F.col("text").alias("prompt"), lg.call_key("m", F.col("text")).alias("call")).where("prompt is not null")
    reply = F.when((F.col("toxic") == 0) & (F.col("quality") == 1), "good")
    failure = F.when(F.col("toxic") == 1, "TimeoutError: late").when(F.col("quality") == 0, lg.REFUSED)
    held = d.join(t.raw("labels"), "doc_id").select("call", reply.alias("reply"), failure.alias("failure"), F.col("doc_id").cast("double").alias("stamp"))
    return d, held


@query("mdl_missing_calls", f"""SELECT call, length(min(text)) AS n_chars FROM ({CALLS})
    WHERE call NOT IN (SELECT call FROM ({LEDGER}) WHERE reply IS NOT NULL OR failure = 'refused') GROUP BY call""")
def missing_calls(t: Tables):
    """What a run asks: prompts without a reply or a refusal, each once."""
    prompts, held = ledger_tables(t)
    return lg.missing(prompts, held).select("call", F.length("prompt").cast("long").alias("n_chars"))


@query("mdl_settled_calls", f"""SELECT doc_id, s.reply AS reply, s.failure AS failure FROM ({CALLS}) LEFT JOIN (
    SELECT call, arg_max(struct_pack(reply := reply, failure := failure), struct_pack(a := reply IS NOT NULL, b := coalesce(failure = 'refused', false), c := stamp)) AS s FROM ({LEDGER}) GROUP BY call) l USING (call)""")
def settled_calls(t: Tables):
    """Every prompt with what the ledger knows of it: its reply, or why there is none."""
    prompts, held = ledger_tables(t)
    return prompts.join(lg.settled(held), "call", "left").select("doc_id", "reply", "failure")
