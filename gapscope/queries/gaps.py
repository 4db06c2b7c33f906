"""Gap scores, duplicates, second opinion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.operators import clustering as cl
from gapscope.operators import merging as mg
from gapscope.operators import similarity as sm
from gapscope.operators.quantiles import pairs_above_percentile, similarity_percentile
from gapscope.operators.rounds import cut
from gapscope.plans import coverage as cv
from gapscope.plans import gaps as gp
from gapscope.plans import review as rv
from gapscope.queries import roles as r
from gapscope.queries.roles import Tables
from gapscope.queries import sql_roles as q
from gapscope.queries.coverage import UNIT_SIDES, members
from gapscope.queries.registry import query

AS_OF = "2001-08-01"

# The source of a ticket plays its run here, so every operator sees two runs.


def run_vectors(t: Tables):
    return cv.working_vectors(t.ticket_vectors()).withColumnRenamed("source", "run_id")


def run_clusters(t: Tables):
    """run_id, cluster_id, size, centroid and the columns prompts need."""
    v = run_vectors(t)
    c = cl.centroids(v, "cluster_vec", ["run_id", "cluster_id"])
    sizes = v.groupBy("run_id", "cluster_id").agg(F.count("*").alias("size"))
    name = F.concat(F.lit("Cluster_"), F.col("cluster_id").cast("string"))
    return c.join(sizes, ["run_id", "cluster_id"]).withColumn("cluster_label", name).withColumn(
        "top_terms", F.lit("")
    ).withColumn("summary", name)


def run_matrix(t: Tables):
    left = run_clusters(t).select(F.struct("run_id", "cluster_id").alias("c"), "centroid")
    m = sm.full_matrix(sm.Side(left, "centroid", ["c"]), sm.Side(t.kb(), "kb_vec", ["kb_id"]))
    return cut(m.select("c.*", "kb_id", "sim"))


RUN_CENTROIDS = f"""SELECT run_id, cluster_id, any_value(n) AS size, list(m ORDER BY i) AS centroid FROM (
    SELECT source AS run_id, cluster_id, i, avg(mixed[i]) AS m, count(*) AS n FROM ({UNIT_SIDES}), range(1, 65) AS g(i) GROUP BY ALL) GROUP BY ALL"""
MATRIX = f"SELECT c.run_id, c.cluster_id, c.size, k.kb_id, {q.cosine('c.centroid', 'k.kb_vec')} AS sim FROM ({RUN_CENTROIDS}) c, r_kb k"
P75 = f"SELECT run_id, quantile_cont(sim, 0.75) AS p75 FROM ({MATRIX}) GROUP BY run_id"
SCORED = f"""SELECT *, 0.5 * max_kb_sim + 0.3 * avg_top3_sim + 0.2 * n_above_p75 / n_kb AS coverage_score, {q.gap_class('max_kb_sim', r.CLUSTER_COVERED, r.CLUSTER_PARTIAL)} AS gap_flag FROM (
    SELECT m.run_id, m.cluster_id, any_value(size) AS size, arg_min(kb_id, n) AS best_kb_id, max(sim) AS max_kb_sim, avg(sim) FILTER (n <= 3) AS avg_top3_sim,
      count(*) FILTER (sim > p75) AS n_above_p75, count(*) AS n_kb
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY sim DESC, kb_id) AS n FROM ({MATRIX})) m JOIN ({P75}) p USING (run_id) GROUP BY ALL)"""


def scored(t: Tables, matrix=None):
    matrix = run_matrix(t) if matrix is None else matrix
    return gp.coverage_scores(matrix, covered=r.CLUSTER_COVERED, partial=r.CLUSTER_PARTIAL)


@query("gap_best_article", f"SELECT run_id, cluster_id, best_kb_id, round(max_kb_sim, 4) AS max_kb_sim, gap_flag FROM ({SCORED})")
def best_article(t: Tables):
    return scored(t).select("run_id", "cluster_id", "best_kb_id", F.round("max_kb_sim", 4).alias("max_kb_sim"), "gap_flag")


@query("gap_percentile", f"SELECT run_id, round(p75, 9) AS p75 FROM ({P75})")
def percentile(t: Tables):
    return similarity_percentile(run_matrix(t), "sim", 0.75, ["run_id"], "p75").withColumn("p75", F.round("p75", 9))


@query("gap_coverage_scores", f"SELECT run_id, cluster_id, round(avg_top3_sim, 6) AS avg_top3_sim, n_above_p75, round(coverage_score, 6) AS coverage_score FROM ({SCORED})")
def coverage_scores(t: Tables):
    return scored(t).select("run_id", "cluster_id", F.round("avg_top3_sim", 6).alias("avg_top3_sim"), "n_above_p75", F.round("coverage_score", 6).alias("coverage_score"))


@query("gap_coverage_scores_one_run", f"""SELECT cluster_id, kb_count, above FROM (WITH m AS (SELECT v.cluster_id, k.kb_id, {q.cosine('v.answer', 'k.kb_vec')} AS sim FROM r_sides v, r_kb k)
    SELECT cluster_id, count(*) AS kb_count, count(*) FILTER (sim > (SELECT quantile_cont(sim, 0.75) FROM m)) AS above FROM m GROUP BY cluster_id)""")
def coverage_scores_one_run(t: Tables):
    """Percentile of one large matrix: every ticket against every article. Its entries are counted, never stored."""
    left = sm.Side(cv.working_vectors(t.ticket_vectors()), "kb_side_vec", ["ticket_id", "cluster_id"])
    counted = pairs_above_percentile(left, sm.Side(t.kb(), "kb_vec", ["kb_id"]), "cluster_id", 0.75)
    return counted.select("cluster_id", F.col("pairs").alias("kb_count"), "above")


TIER = "CASE coalesce(evidence_tier, 4) WHEN 1 THEN 3.0 WHEN 2 THEN 1.5 WHEN 3 THEN 0.5 ELSE 0.0 END"


@query("gap_evidence_quality", f"SELECT run_id, cluster_id, round(avg({TIER}), 4) AS evidence_quality FROM r_assign LEFT JOIN r_rows USING (run_id, source, source_id) GROUP BY ALL")
def evidence_quality(t: Tables):
    return gp.evidence_quality(t.assignments(), t.ticket_rows())


RECENT = f"SELECT run_id, cluster_id, count(*) FILTER (s.reported_date >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS recent_count FROM r_assign a JOIN r_source s ON s.id = a.source_id AND s.source = 'incident' WHERE a.source = 'incident' GROUP BY ALL"


@query("gap_recent_counts", RECENT)
def recent_counts(t: Tables):
    return gp.recent_counts(t.assignments(), t.incidents(), AS_OF)


SIGNALS = f"""SELECT c.run_id, c.cluster_id, c.size, coalesce(recent_count, 0) AS recent_count, c.max_kb_sim AS coverage_score, coalesce(e.q, 0) AS evidence_quality
    FROM r_clusters c LEFT JOIN ({RECENT}) USING (run_id, cluster_id) LEFT JOIN (
      SELECT run_id, cluster_id, round(avg({TIER}), 4) AS q FROM r_assign LEFT JOIN r_rows USING (run_id, source, source_id) GROUP BY ALL) e USING (run_id, cluster_id)"""


def scale(c: str) -> str:
    w = "OVER (PARTITION BY run_id)"
    return f"coalesce(({c} - min({c}) {w}) / nullif((max({c}) {w} - min({c}) {w})::DOUBLE, 0), 0)"


def signals(t: Tables):
    c = t.clusters().select("run_id", "cluster_id", "size", F.col("max_kb_sim").alias("coverage_score"))
    key = ["run_id", "cluster_id"]
    return c.join(gp.recent_counts(t.assignments(), t.incidents(), AS_OF), key, "left").join(
        gp.evidence_quality(t.assignments(), t.ticket_rows()), key, "left"
    )


@query("gap_min_max", f"SELECT run_id, cluster_id, round({scale('size')}, 6) AS size_scaled, round({scale('max_kb_sim')}, 6) AS max_kb_sim_scaled FROM r_clusters")
def min_max(t: Tables):
    m = gp.min_max(t.clusters(), ["size", "max_kb_sim"])
    return m.select("run_id", "cluster_id", F.round("size_scaled", 6).alias("size_scaled"), F.round("max_kb_sim_scaled", 6).alias("max_kb_sim_scaled"))


PRIORITY = f"""SELECT run_id, cluster_id, raw / greatest(max(raw) OVER (PARTITION BY run_id), 1e-9) AS priority_score FROM (
    SELECT run_id, cluster_id, 0.35 * {scale('size')} + 0.25 * {scale('recent_count')} + 0.25 * (1 - {scale('coverage_score')}) + 0.15 * {scale('evidence_quality')} AS raw FROM ({SIGNALS}))"""


@query("gap_priorities", f"SELECT run_id, cluster_id, round(priority_score, 6) AS priority_score FROM ({PRIORITY})")
def priorities(t: Tables):
    return gp.priorities(signals(t)).select("run_id", "cluster_id", F.round("priority_score", 6).alias("priority_score"))


def flagged_clusters(t: Tables):
    """Clusters above 12 tickets play the CRITICAL ones."""
    flag = F.when(F.col("size") > 12, "CRITICAL").otherwise("PARTIAL")
    return cut(run_clusters(t).withColumn("gap_flag", flag))


CANDIDATES = f"""WITH c AS (SELECT *, CASE WHEN size > 12 THEN 'CRITICAL' ELSE 'PARTIAL' END AS gap_flag FROM ({RUN_CENTROIDS}))
    SELECT a.run_id, a.cluster_id AS a, b.cluster_id AS b, {q.cosine('a.centroid', 'b.centroid')} AS sim FROM c a JOIN c b
    ON a.run_id = b.run_id AND a.cluster_id < b.cluster_id AND a.gap_flag = 'CRITICAL' AND b.gap_flag = 'CRITICAL' AND {q.cosine('a.centroid', 'b.centroid')} > -0.2"""


@query("gap_duplicate_candidates", CANDIDATES)
def duplicate_candidates(t: Tables):
    return gp.duplicate_candidates(flagged_clusters(t), -0.2)


def pair_side(name: str) -> str:
    return f"""'CLUSTER {name.upper()} (ID=' || {name}.cluster_id || ', ' || {name}.size || ' tickets)' || chr(10) || 'Label: Cluster_' || {name}.cluster_id || chr(10) || 'Terms: ' || chr(10)
      || 'Summary: Cluster_' || {name}.cluster_id"""


PAIR_PROMPTS = f"""SELECT p.run_id, p.a AS a, p.b AS b, p.sim, 'Would one and the same article settle the tickets of both clusters?' || chr(10) || chr(10) || {pair_side('a')} || chr(10) || chr(10) || {pair_side('b')}
      || chr(10) || chr(10) || 'Similarity: ' || format('{{:.4f}}', p.sim) || chr(10) || {q.lit('Reply with JSON: {"is_duplicate": bool, "confidence": "HIGH|MEDIUM|LOW", "reason": "..."}')} AS prompt
    FROM ({CANDIDATES}) p JOIN ({RUN_CENTROIDS}) a ON a.run_id = p.run_id AND a.cluster_id = p.a JOIN ({RUN_CENTROIDS}) b ON b.run_id = p.run_id AND b.cluster_id = p.b"""


@query("gap_pair_prompts", f"SELECT run_id, a, b, sim, md5(prompt) AS prompt_md5 FROM ({PAIR_PROMPTS})")
def pair_prompts(t: Tables):
    c = flagged_clusters(t)
    p = gp.pair_prompts(gp.duplicate_candidates(c, -0.2), c)
    return p.select("run_id", "a", "b", "sim", F.md5("prompt").alias("prompt_md5"))


@query("gap_decisions", f"SELECT run_id, a, b, sim, CASE WHEN (a + b) % 4 = 0 THEN '' ELSE 'pair ' || a || '-' || b END AS reason FROM ({CANDIDATES}) WHERE sim > 0 AND (a + b) % 4 IN (0, 1)")
def decisions(t: Tables):
    """Replies made from the pairs: sure (in either spelling, with a reason or without), unsure, negative, no JSON."""
    pairs = gp.duplicate_candidates(flagged_clusters(t), -0.2)
    kind, yes = (F.col("a") + F.col("b")) % 4, (F.col("sim") > 0).alias("is_duplicate")
    why = F.concat(F.lit("pair "), "a", F.lit("-"), "b").alias("reason")
    reply = (
        F.when(kind == 0, F.to_json(F.struct(yes, F.lit("high").alias("confidence")))).when(kind == 1, F.to_json(F.struct(yes, F.lit("HIGH").alias("confidence"), why)))
        .when(kind == 2, F.to_json(F.struct(yes, F.lit("MEDIUM").alias("confidence"), why))).otherwise("no answer")
    )
    return gp.accept(pairs.withColumn("reply", reply)).select("run_id", "a", "b", "sim", "reason")


MERGE_WALK = f"""WITH RECURSIVE c AS (SELECT run_id, cluster_id, size, centroid FROM ({RUN_CENTROIDS})),
    p AS (SELECT a.run_id, a.cluster_id AS a, b.cluster_id AS b, {q.cosine('a.centroid', 'b.centroid')} AS sim,
      CASE WHEN a.size >= b.size THEN a.cluster_id ELSE b.cluster_id END AS stays, CASE WHEN a.size >= b.size THEN b.cluster_id ELSE a.cluster_id END AS goes
      FROM c a JOIN c b ON a.run_id = b.run_id AND a.cluster_id < b.cluster_id AND {q.cosine('a.centroid', 'b.centroid')} > 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sim DESC, a, b) AS n FROM p),
    walk AS (SELECT DISTINCT run_id, 0::BIGINT AS n, []::BIGINT[] AS gone, []::BIGINT[] AS kept FROM o
      UNION ALL SELECT w.run_id, o.n,
        CASE WHEN list_contains(w.gone, o.a) OR list_contains(w.gone, o.b) THEN w.gone ELSE list_append(w.gone, o.goes) END,
        CASE WHEN list_contains(w.gone, o.a) OR list_contains(w.gone, o.b) THEN w.kept ELSE list_append(w.kept, o.stays) END
      FROM walk w JOIN o ON o.run_id = w.run_id AND o.n = w.n + 1)
    SELECT run_id, unnest(gone) AS cluster_id, unnest(kept) AS merged_into, 'close' AS reason
    FROM (SELECT run_id, arg_max(gone, n) AS gone, arg_max(kept, n) AS kept FROM walk GROUP BY run_id)"""


@query("gap_greedy_merges", MERGE_WALK)
def greedy_merges(t: Tables):
    """Closest cluster pairs of a run as accepted pairs, over all ticket clusters."""
    c = run_clusters(t)
    pairs = sm.pairs_above(c, "cluster_id", "centroid", 0.0, by=["run_id"]).withColumn("reason", F.lit("close"))
    return mg.greedy_merges(pairs, c)


@query("gap_merge_by_asking", MERGE_WALK)
def merge_by_asking(t: Tables):
    """The same merges, with pairs brought forward a few at a time."""
    yes = lambda pairs: pairs.withColumn("reason", F.lit("close"))
    return mg.merge_by_asking(run_clusters(t), yes, 0.0, batch=1)


def merges(t: Tables):
    return t.clusters().where("gap_flag = 'DUPLICATE'").select("run_id", "cluster_id", "merged_into")


@query("gap_resolve_chains", """WITH RECURSIVE step AS (SELECT run_id, cluster_id, cluster_id - 1 AS merged_into FROM r_clusters WHERE size < 20 AND cluster_id > 0
      ), walk AS (SELECT run_id, cluster_id, merged_into FROM step UNION ALL SELECT w.run_id, w.cluster_id, s.merged_into FROM walk w JOIN step s ON s.run_id = w.run_id AND s.cluster_id = w.merged_into)
    SELECT run_id, cluster_id, min(merged_into) AS merged_into FROM walk GROUP BY ALL""")
def resolve_chains(t: Tables):
    """Small clusters point at their left neighbour, which makes chains."""
    m = t.clusters().where("size < 20 AND cluster_id > 0").select("run_id", "cluster_id", (F.col("cluster_id") - 1).alias("merged_into"))
    return mg.resolve_chains(m)


@query("gap_move_tickets", """SELECT a.run_id, a.source, a.source_id, coalesce(d.merged_into, a.cluster_id) AS cluster_id, coalesce(t.cluster_label, a.cluster_label) AS cluster_label
    FROM r_assign a LEFT JOIN r_clusters d ON d.run_id = a.run_id AND d.cluster_id = a.cluster_id AND d.gap_flag = 'DUPLICATE'
    LEFT JOIN r_clusters t ON t.run_id = a.run_id AND t.cluster_id = d.merged_into""")
def move_tickets(t: Tables):
    m = mg.move_tickets(t.assignments(), merges(t), t.clusters())
    return m.select("run_id", "source", "source_id", "cluster_id", "cluster_label")


@query("gap_merge_clusters", """SELECT c.run_id, c.cluster_id, CASE WHEN c.gap_flag = 'DUPLICATE' THEN 0 ELSE c.size + coalesce(d.extra, 0) END::BIGINT AS size, c.gap_flag
    FROM r_clusters c LEFT JOIN (SELECT run_id, merged_into AS cluster_id, sum(size) AS extra FROM r_clusters WHERE gap_flag = 'DUPLICATE' GROUP BY ALL) d USING (run_id, cluster_id)""")
def merge_clusters(t: Tables):
    moved = mg.move_tickets(t.assignments(), merges(t), t.clusters())
    return mg.merge_clusters(t.clusters(), moved, merges(t)).select("run_id", "cluster_id", "size", "gap_flag")


# Sizes and scores of a run as lists in cluster order, one merge after another.
REPAIR_WALK = f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cluster_id) AS i FROM r_gaps),
    m AS (SELECT d.run_id, d.i AS d, k.i AS k, row_number() OVER (PARTITION BY d.run_id ORDER BY d.cluster_id) AS n
      FROM g d JOIN g k ON k.run_id = d.run_id AND k.cluster_id = d.merged_into WHERE d.gap_flag = 'DUPLICATE'),
    walk AS (SELECT run_id, 0::BIGINT AS n, list(size::DOUBLE ORDER BY i) AS sizes, list(priority_score ORDER BY i) AS scores FROM g GROUP BY run_id
      UNION ALL SELECT run_id, n, list_transform(grown, lambda x, j: CASE WHEN j = d THEN 0.0::DOUBLE ELSE x END),
        list_transform(scores, lambda x, j: CASE WHEN j = k THEN round(x
          - 0.35 * coalesce((sizes[k] - list_min(sizes)) / nullif(list_max(sizes) - list_min(sizes), 0), 0)
          + 0.35 * coalesce((grown[k] - list_min(grown)) / nullif(list_max(grown) - list_min(grown), 0), 0), 4) ELSE x END)
      FROM (SELECT w.run_id, m.n, m.d, m.k, w.sizes, w.scores,
          list_transform(w.sizes, lambda x, j: CASE WHEN j = m.k THEN x + w.sizes[m.d] ELSE x END) AS grown
        FROM walk w JOIN m ON m.run_id = w.run_id AND m.n = w.n + 1)),
    e AS (SELECT run_id, arg_max(sizes, n) AS sizes, arg_max(scores, n) AS scores FROM walk GROUP BY run_id)
    SELECT g.run_id, g.cluster_id, e.sizes[g.i]::BIGINT AS size, e.scores[g.i] AS priority_score, g.gap_flag,
      CASE WHEN g.gap_flag = 'DUPLICATE' THEN 'DUPLICATE: Merged into cluster ' || g.merged_into || '. Tickets physically reassigned.' ELSE g.recommendation END AS recommendation
    FROM g JOIN e USING (run_id)"""


@query("gap_repair_priority", REPAIR_WALK)
def repair_priority(t: Tables):
    return mg.repair_priority(t.gaps(), merges(t)).select("run_id", "cluster_id", "size", "priority_score", "gap_flag", "recommendation")


@query("gap_report", f"""SELECT s.run_id, s.cluster_id, 'Cluster_' || s.cluster_id AS cluster_label, s.size, round(s.max_kb_sim, 4) AS max_kb_sim, round(s.avg_top3_sim, 4) AS avg_top3_sim,
    s.n_above_p75, round(s.coverage_score, 4) AS coverage_score, round(s.size / 100, 4) AS priority_score,
    CASE WHEN s.cluster_id > 7 THEN 'DUPLICATE' ELSE s.gap_flag END AS gap_flag,
    CASE WHEN s.cluster_id > 7 THEN {q.duplicate_text('s.cluster_id - 7', "'same'")} ELSE {q.recommendation('s.gap_flag', "('Cluster_' || s.cluster_id)", 'k.title')} END AS recommendation,
    s.best_kb_id, k.title AS best_kb_title, CASE WHEN s.cluster_id > 7 THEN s.cluster_id - 7 END AS merged_into
    FROM ({SCORED}) s LEFT JOIN r_kb k ON k.kb_id = s.best_kb_id""")
def report(t: Tables):
    c = run_clusters(t).select("run_id", "cluster_id", "cluster_label", "size", (F.col("size") / 100).alias("priority_score"))
    s = scored(t).join(c, ["run_id", "cluster_id"])
    m = c.where("cluster_id > 7").select("run_id", "cluster_id", (F.col("cluster_id") - 7).alias("merged_into"), F.lit("same").alias("reason"))
    return gp.gap_report(s, t.kb(), m)


@query("gap_flag_counts", "SELECT run_id, gap_flag, count(*) AS clusters FROM r_gaps GROUP BY ALL")
def flag_counts(t: Tables):
    return gp.flag_counts(t.gaps())


@query("gap_kb_utilization", f"""SELECT *, CASE WHEN clusters_as_best >= 3 THEN 'OVER-RELIED' WHEN clusters_as_best = 0 AND max_cluster_sim < {r.CLUSTER_PARTIAL} THEN 'ORPHAN'
    WHEN clusters_as_best > 0 THEN 'ACTIVE' ELSE 'PERIPHERAL' END AS status FROM (
    SELECT m.run_id, m.kb_id, count(*) FILTER (s.best_kb_id = m.kb_id) AS clusters_as_best, round(max(m.sim), 4) AS max_cluster_sim, round(avg(m.sim), 4) AS mean_cluster_sim,
      count(*) FILTER (m.sim > p.p75) AS breadth_count FROM ({MATRIX}) m JOIN ({P75}) p USING (run_id) JOIN ({SCORED}) s ON s.run_id = m.run_id AND s.cluster_id = m.cluster_id GROUP BY ALL)""")
def kb_utilization(t: Tables):
    m = run_matrix(t)
    return gp.kb_utilization(m, scored(t, m), partial=r.CLUSTER_PARTIAL, over_relied=3)


SNIPPETS = f"""SELECT run_id, cluster_id, pick, s FROM (SELECT run_id, cluster_id, pick, substr({q.sanitise('problem_text')}, 1, 300) AS s FROM (
    SELECT a.run_id, a.cluster_id, u.problem_text, row_number() OVER (PARTITION BY a.run_id, a.cluster_id ORDER BY md5('42|' || u.source || '|' || u.source_id), u.source, u.source_id) AS pick
    FROM r_assign a JOIN r_unified u USING (source, source_id) WHERE length(u.problem_text) > 20) WHERE pick <= 20) WHERE length(s) > 20"""


@query("gap_summary_samples", f"SELECT run_id, cluster_id, pick, md5(s) AS snippet_md5 FROM ({SNIPPETS})")
def summary_samples(t: Tables):
    s = gp.summary_samples(members(t))
    return s.select("run_id", "cluster_id", F.col("pick").cast("long").alias("pick"), F.md5("snippet").alias("snippet_md5"))


FEWER = "CASE WHEN {c} > 5 THEN greatest(5, {c} // 2) ELSE {c} END"
SUMMARY_HEAD = "Summarise this cluster of support tickets in five labelled sections: problem type, affected users, systems and tools, failure patterns, typical resolution."


@query("gap_summary_prompts", f"""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY pick) AS k, count(*) OVER (PARTITION BY run_id, cluster_id) AS n FROM ({SNIPPETS})),
    halved AS (SELECT *, {FEWER.format(c='n')} AS n2 FROM numbered), tries AS (SELECT *, unnest(list_distinct([n, n2, {FEWER.format(c='n2')}])) AS shown FROM halved)
    SELECT run_id, cluster_id, shown, md5({q.lit(SUMMARY_HEAD)} || chr(10) || 'Tickets: ' || any_value(c.size) || chr(10) || 'Gap status: ' || any_value(c.gap_flag) || chr(10) || 'Terms: '
      || any_value(c.cluster_label) || chr(10) || 'Samples:' || chr(10) || string_agg(k || '. ' || s, chr(10) ORDER BY k)) AS prompt_md5
    FROM tries JOIN r_clusters c USING (run_id, cluster_id) WHERE k <= shown GROUP BY run_id, cluster_id, shown""")
def summary_prompts(t: Tables):
    """Every prompt that may be tried, by the number of samples in it."""
    p = gp.summary_prompts(t.clusters().withColumn("top_terms", F.col("cluster_label")), gp.summary_samples(members(t)))
    each = p.select("run_id", "cluster_id", F.explode("prompts").alias("prompt"))
    shown = F.size(F.split(F.substring_index("prompt", "\nSamples:\n", -1), r"\n", -1)).cast("long")
    return each.select("run_id", "cluster_id", shown.alias("shown"), F.md5("prompt").alias("prompt_md5"))


# --- second opinion ----------------------------------------------------------


REVIEWED = f"""SELECT run_id, cluster_id, size, rank, m.kb_id, title, substr({q.strip("coalesce(solution, '')")}, 1, 500) AS snippet, round(sim, 4) AS sim FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY sim DESC, kb_id) AS rank FROM ({MATRIX})) m JOIN (SELECT kb_id, title, solution FROM r_kb) k USING (kb_id) WHERE rank <= 10"""


@query("rev_candidates", f"SELECT run_id, cluster_id, rank, kb_id, title, md5(snippet) AS snippet_md5, sim FROM ({REVIEWED})")
def candidates(t: Tables):
    c = rv.candidates(run_clusters(t), t.kb())
    return c.select("run_id", "cluster_id", F.col("rank").cast("long").alias("rank"), "kb_id", "title", F.md5("snippet").alias("snippet_md5"), "sim")


@query("rev_candidates_tiled", f"SELECT run_id, cluster_id, rank, kb_id, sim FROM ({REVIEWED})")
def candidates_tiled(t: Tables):
    c = rv.candidates(run_clusters(t), t.kb(), broadcast_bytes=0, block_rows=64, chunk_bytes=0)
    return c.select("run_id", "cluster_id", F.col("rank").cast("long").alias("rank"), "kb_id", "sim")


@query("rev_candidates_blocks", f"SELECT run_id, cluster_id, rank, kb_id, sim FROM ({REVIEWED})")
def candidates_blocks(t: Tables):
    c = rv.candidates(run_clusters(t), t.kb(), block_rows=16)
    return c.select("run_id", "cluster_id", F.col("rank").cast("long").alias("rank"), "kb_id", "sim")


REVIEW_ITEM = """rank || '. Title: ' || title || chr(10) || '   Vector similarity: ' || format('{:.4f}', sim) || chr(10) || '   Content: '
      || CASE WHEN snippet = '' THEN '(no content)' ELSE replace(snippet, chr(10), ' ') END"""


@query("rev_prompts", f"""SELECT run_id, cluster_id, md5('A cluster of support tickets found no article close enough by vector.' || chr(10) || 'Decide whether one of the candidates settles it all the same.' || chr(10) || chr(10)
    || 'Label: Cluster_' || cluster_id || chr(10) || 'Top terms: ' || chr(10) || 'Tickets: ' || any_value(size) || chr(10) || 'Summary: Cluster_' || cluster_id || chr(10) || chr(10) || 'Candidates:' || chr(10)
    || string_agg({REVIEW_ITEM}, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Reply with one JSON object with the keys match_found, matched_kb_id, matched_kb_title, confidence, reasoning.') AS prompt_md5
    FROM ({REVIEWED}) GROUP BY run_id, cluster_id""")
def review_prompts(t: Tables):
    c = run_clusters(t)
    return rv.candidate_prompts(c, rv.candidates(c, t.kb())).select("run_id", "cluster_id", F.md5("prompt").alias("prompt_md5"))


@query("rev_replies", """SELECT run_id, cluster_id, max_kb_sim < 0.49 AS match_found, cluster_id::VARCHAR AS matched_kb_id, CASE WHEN size % 2 = 0 THEN cluster_label END AS matched_kb_title, 'HIGH' AS confidence,
    'because' AS reasoning FROM r_clusters WHERE cluster_id % 3 = 0""")
def review_replies(t: Tables):
    """Replies made from the clusters: whole ones, some without a key, some that are no JSON."""
    match, kb = (F.col("max_kb_sim") < 0.49).alias("match_found"), F.col("cluster_id").cast("string").alias("matched_kb_id")
    title = F.when(F.col("size") % 2 == 0, F.col("cluster_label")).alias("matched_kb_title")
    rest = [F.lit("HIGH").alias("confidence"), F.lit("because").alias("reasoning")]
    whole = F.to_json(F.struct(match, kb, title, *rest), {"ignoreNullFields": "false"})
    kind = F.col("cluster_id") % 3
    reply = F.when(kind == 0, whole).when(kind == 1, F.to_json(F.struct(match, kb, title))).otherwise("no answer")
    return rv.parse_opinions(t.clusters().select("run_id", "cluster_id", reply.alias("reply")))


FOUND = """SELECT run_id, cluster_id, max_kb_sim < 0.49 AS match_found, CASE WHEN place = 1 THEN '' ELSE cluster_label END AS matched_kb_title,
    CASE WHEN size >= 20 THEN 'HIGH' WHEN size >= 16 THEN 'medium' ELSE 'LOW' END AS confidence, 'because' AS reasoning FROM r_placed WHERE size >= 14 AND max_kb_sim < 0.51"""


def found(t: Tables):
    c = t.clusters().where("size >= 14 AND max_kb_sim < 0.51")
    first = t.clusters().groupBy("run_id", F.floor(F.col("cluster_id") / 5).alias("g")).agg(
        F.min_by("cluster_id", F.struct((-F.col("size")).alias("s"), "cluster_id")).alias("cluster_id")
    ).select("run_id", "cluster_id", F.lit(True).alias("first"))
    size = F.col("size")
    return c.join(first, ["run_id", "cluster_id"], "left").select(
        "run_id", "cluster_id", (F.col("max_kb_sim") < 0.49).alias("match_found"),
        F.when(F.col("first"), "").otherwise(F.col("cluster_label")).alias("matched_kb_title"),
        F.when(size >= 20, "HIGH").when(size >= 16, "medium").otherwise("LOW").alias("confidence"), F.lit("because").alias("reasoning"),
    )


@query("rev_store_opinions", f"SELECT c.run_id, c.cluster_id, matched_kb_title AS review_match, confidence AS review_confidence, reasoning AS review_reason FROM r_clusters c LEFT JOIN ({FOUND}) f USING (run_id, cluster_id)")
def store_opinions(t: Tables):
    return rv.store_opinions(t.clusters(), found(t)).select("run_id", "cluster_id", "review_match", "review_confidence", "review_reason")


HIT = "coalesce(f.match_found AND upper(f.confidence) = 'HIGH' AND f.matched_kb_title <> '', false)"


@query("rev_override_flags", f"""SELECT g.run_id, g.cluster_id, CASE WHEN {HIT} AND g.gap_flag = 'CRITICAL' THEN 'PARTIAL' ELSE g.gap_flag END AS gap_flag,
    CASE WHEN {HIT} AND g.gap_flag = 'CRITICAL' THEN 'UPDATE: Expand ''' || substr(f.matched_kb_title, 1, 50) || ''' to cover this cluster (LLM-validated)' ELSE g.recommendation END AS recommendation
    FROM r_gaps g LEFT JOIN ({FOUND}) f USING (run_id, cluster_id)""")
def override_flags(t: Tables):
    return rv.override_flags(t.gaps(), found(t)).select("run_id", "cluster_id", "gap_flag", "recommendation")


@query("rev_counts", f"""SELECT count(*) AS asked, count(match_found) AS validated, count(*) FILTER (match_found AND upper(confidence) = 'HIGH') AS matches_high,
    count(*) FILTER (match_found AND upper(confidence) = 'MEDIUM') AS matches_medium, count(*) FILTER (match_found AND upper(confidence) = 'LOW') AS matches_low,
    count(*) FILTER (NOT match_found) AS no_match, count(*) FILTER ({HIT}) AS overrides, count(*) FILTER (match_found IS NULL) AS failed
    FROM r_clusters c LEFT JOIN ({FOUND}) f USING (run_id, cluster_id) WHERE gap_flag = 'CRITICAL' AND summary <> ''""")
def review_counts(t: Tables):
    from gapscope.sources.tables import critical_with_summary

    return rv.review_counts(critical_with_summary(t.clusters()), found(t))
