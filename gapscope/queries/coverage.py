"""Vectors, coverage, clustering and labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.config import Thresholds
from gapscope.functions import vectors as vc
from gapscope.models import text_pieces
from gapscope.operators import axes as ax
from gapscope.operators import clustering as cl
from gapscope.operators import minibatch as mb
from gapscope.operators import neighbours as nb
from gapscope.operators.pruned import pruned_pairs_above
from gapscope.operators import labelling as lb
from gapscope.operators import similarity as sm
from gapscope.plans import coverage as cv
from gapscope.plans import preprocess as pp
from gapscope.queries import roles as r
from gapscope.queries.roles import Tables
from gapscope.queries import sql_roles as q
from gapscope.queries.registry import query
from gapscope.sources import tables as tb


def checksum(v: str):
    terms = F.transform(F.col(v), lambda x, i: x * (i + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 6)


# --- scans -------------------------------------------------------------------


@query("src_incidents", "SELECT id, ticket_number, service_type, assigned_group, reported_date, description, md5(answer) AS resolution_md5 FROM r_source WHERE source = 'incident'")
def incidents(t: Tables):
    cols = ["id", "ticket_number", "service_type", "assigned_group", "reported_date", "description"]
    return t.incidents().select(*cols, F.md5("resolution_summary").alias("resolution_md5"))


@query("src_workorders", "SELECT id, ticket_number, service_type, assigned_group, md5(answer) AS activity_md5 FROM r_source WHERE source = 'workorder'")
def workorders(t: Tables):
    return t.workorders().select("id", "ticket_number", "service_type", "assigned_group", F.md5("activity_logs_text").alias("activity_md5"))


@query("src_vector_columns", f"SELECT id, {q.checksum('e_description')} AS description_sum, e_description IS NOT NULL AS has_e_description, {q.checksum('e_resolution_summary')} AS resolution_sum, e_resolution_summary IS NOT NULL AS has_e_resolution_summary FROM r_inc")
def vector_columns(t: Tables):
    text = t.incident_inputs().select(
        "id", F.to_json("e_description").alias("e_description"), "e_resolution_summary"
    )
    v = tb.with_vectors(text, "e_description", "e_resolution_summary")
    return v.select(
        "id", checksum("e_description").alias("description_sum"), "has_e_description",
        checksum("e_resolution_summary").alias("resolution_sum"), "has_e_resolution_summary",
    )


@query("src_selected_columns", "SELECT id, service_type FROM r_source WHERE source = 'incident'")
def selected_columns(t: Tables):
    return t.incidents().select("id", "service_type")


@query("src_kb_articles", f"""SELECT kb_id, title, {q.checksum(q.combine('kb_vec', 'second', 0.5, 0.5))} AS vec_sum
    FROM (SELECT k.*, n.vec AS second FROM r_kb k LEFT JOIN r_vec n ON n.vec_id = k.kb_id + 1)""")
def kb_articles(t: Tables):
    second = t.vectors().select((F.col("vec_id") - 1).alias("kb_id"), F.col("vec").alias("e_solution"))
    raw = t.kb().withColumnRenamed("kb_vec", "e_title").join(second, "kb_id", "left").withColumn("id", F.col("kb_id"))
    out = tb.kb_articles(raw)
    return out.select(F.col("id").alias("kb_id"), "title", checksum("kb_vec").alias("vec_sum"))


@query("src_kb_entries", f"""SELECT source_id AS id, title, {q.checksum(q.unit('embedding'))} AS vec_sum FROM r_index WHERE NOT is_generated
    UNION ALL SELECT d.doc_id::VARCHAR, split_part(d.text, chr(10), 1), {q.checksum('v.vec')} FROM documents d JOIN r_vec v ON v.vec_id = d.doc_id
    WHERE d.doc_id NOT IN (SELECT kb_id FROM r_kb)""")
def kb_entries(t: Tables):
    docs = t.raw("documents").join(t.vectors(), F.col("doc_id") == F.col("vec_id")).select(
        F.col("doc_id").alias("id"), F.split("text", "\n", 2)[0].alias("title"), F.col("vec").alias("kb_vec")
    )
    return tb.kb_entries(t.search_index(), docs).select("id", "title", checksum("kb_vec").alias("vec_sum"))


@query("src_run_tickets", "SELECT r.run_id, u.source, u.source_id, u.ticket_number, md5(u.problem_text) AS problem_md5, md5(u.resolution_text) AS resolution_md5 FROM r_rows r JOIN r_unified u USING (source, source_id) WHERE r.quality_pass")
def run_tickets(t: Tables):
    """Digests are taken before tickets meet their runs, so texts are not moved for that."""
    u = tb.unified_tickets(t.incidents(), t.workorders())
    u = u.withColumn("problem_text", F.md5("problem_text")).withColumn("resolution_text", F.md5("resolution_text"))
    return tb.run_tickets(t.ticket_rows(), u).select("run_id", "source", "source_id", "ticket_number", F.col("problem_text").alias("problem_md5"), F.col("resolution_text").alias("resolution_md5"))


@query("src_live_articles", "SELECT article_id, title FROM r_articles WHERE toxic = 0 AND article_embedding IS NOT NULL")
def live_articles(t: Tables):
    a = t.articles().withColumn("is_duplicate_of", F.when(F.col("toxic") == 1, "A0"))
    return tb.live_articles(a).select("article_id", "title")


@query("src_critical_clusters", "SELECT run_id, cluster_id, size, summary FROM r_clusters WHERE gap_flag = 'CRITICAL' AND summary <> '' ORDER BY size DESC, cluster_id")
def critical_clusters(t: Tables):
    return tb.critical_with_summary(t.clusters()).select("run_id", "cluster_id", "size", "summary")


@query("src_unified_tickets", "SELECT source, source_id, ticket_number, service_type, assigned_group, md5(problem_text) AS problem_md5, md5(resolution_text) AS resolution_md5 FROM r_unified")
def unified_tickets(t: Tables):
    u = tb.unified_tickets(t.incidents(), t.workorders())
    return u.select("source", "source_id", "ticket_number", "service_type", "assigned_group", F.md5("problem_text").alias("problem_md5"), F.md5("resolution_text").alias("resolution_md5"))


@query("src_row_count", "SELECT count(*) AS n FROM r_assign")
def row_count(t: Tables):
    return tb.row_count(t.assignments())


# --- vectors -----------------------------------------------------------------


@query("vec_parse", f"SELECT vec_id, {q.checksum('vec')} AS vec_sum FROM r_vec UNION ALL SELECT -1 - event_id, NULL FROM events")
def parse(t: Tables):
    v = t.vectors().select("vec_id", F.to_json("vec").alias("txt"))
    e = t.raw("events").select((-1 - F.col("event_id")).alias("vec_id"), F.col("props").alias("txt"))
    p = v.unionByName(e).select("vec_id", vc.parse_vector(F.col("txt")).alias("vec"))
    return p.select("vec_id", checksum("vec").alias("vec_sum"))


@query("vec_normalise", f"SELECT vec_id, CASE WHEN label = 0 THEN 0.0 ELSE {q.checksum(q.unit('vec'))} END AS vec_sum FROM r_vec")
def normalise(t: Tables):
    v = t.vectors().withColumn("v", vc.normalise(F.transform("vec", lambda x: x * F.col("label"))))
    return v.select("vec_id", checksum("v").alias("vec_sum"))


@query("vec_combine", f"SELECT ticket_id, {q.checksum(q.combine('problem_vec', 'res_vec'))} AS vec_sum FROM r_tv")
def combine(t: Tables):
    v = t.ticket_vectors().withColumn("v", vc.combine(F.col("problem_vec"), F.col("res_vec")))
    return v.select("ticket_id", checksum("v").alias("vec_sum"))


@query("vec_blended_matrix", f"SELECT id, {q.checksum(q.combine('e_description', 'e_detailed_description'))} AS vec_sum, e_description IS NOT NULL OR e_detailed_description IS NOT NULL AS has_vector FROM r_inc")
def blended_matrix(t: Tables):
    b = tb.blended(t.incident_inputs(), "e_description", "e_detailed_description")
    return b.select("id", checksum("vector").alias("vec_sum"), "has_vector")


INC_PROBLEM = f"""CASE WHEN {q.generic_subject('description')} AND e_detailed_description IS NOT NULL THEN e_detailed_description
    ELSE {q.combine('e_description', 'e_detailed_description')} END"""


@query("vec_incident_problem", f"SELECT id, {q.generic_subject('description')} AS generic_subject, {q.checksum(INC_PROBLEM)} AS vec_sum FROM r_inc")
def incident_problem(t: Tables):
    f = pp.incident_features(t.incident_inputs())
    return f.select("id", "generic_subject", checksum("problem_vec").alias("vec_sum"))


WO_CLEAN = f"SELECT *, {q.strip_email('detailed_description')} AS clean FROM r_wo"
WO_FACTS = f"""SELECT *, len({q.words('clean')})::INTEGER AS clean_words, {q.boilerplate('clean')} AS boilerplate,
    len({q.words('activity_logs_text')})::INTEGER AS res_word_count, {q.email_dominated('activity_logs_text', Thresholds.email_share)} AS email_dominated,
    {q.tier('activity_logs_text')} AS evidence_tier FROM ({WO_CLEAN})"""
WO_MASKED = f"SELECT *, clean_words >= 22 AND NOT boilerplate AS to_embed, CASE WHEN clean_words >= 22 AND NOT boilerplate THEN e_clean END AS e_detail FROM ({WO_FACTS})"
WO_PROBLEM = f"""SELECT *, CASE WHEN e_description IS NOT NULL AND e_detail IS NOT NULL THEN {q.combine('e_description', 'e_detail')}
    WHEN boilerplate AND e_activity_logs IS NOT NULL THEN e_activity_logs ELSE e_description END AS problem_vec FROM ({WO_MASKED})"""


def workorder_features(t: Tables):
    return pp.workorder_features(pp.clean_workorders(t.workorder_inputs()))


@query("vec_workorder_problem", f"SELECT id, {q.checksum('problem_vec')} AS vec_sum FROM ({WO_PROBLEM})")
def workorder_problem(t: Tables):
    return workorder_features(t).select("id", checksum("problem_vec").alias("vec_sum"))


def sides(t: Tables):
    return cv.working_vectors(t.ticket_vectors())


def kb_side(t: Tables, *extra: str) -> sm.Side:
    return sm.Side(t.kb(), "kb_vec", ["kb_id", *extra])


def ticket_side(t: Tables) -> sm.Side:
    return sm.Side(t.ticket_vectors().withColumn("answer", F.coalesce("res_vec", "problem_vec")), "answer", ["ticket_id"])


ALL_SIMS = f"SELECT s.ticket_id, k.kb_id, k.title, {q.cosine('s.answer', 'k.kb_vec')} AS sim FROM r_sides s, r_kb k"
RANKED = f"SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY sim DESC, kb_id) AS rank FROM ({ALL_SIMS})"


@query("vec_full_matrix", f"SELECT ticket_id, kb_id, sim AS sim FROM ({ALL_SIMS})")
def full_matrix(t: Tables):
    m = sm.full_matrix(ticket_side(t), kb_side(t))
    return m.select("ticket_id", "kb_id", "sim")


@query("vec_nearest", f"SELECT ticket_id, kb_id, sim AS sim FROM ({RANKED}) WHERE rank = 1")
def nearest(t: Tables):
    n = sm.nearest(ticket_side(t), kb_side(t))
    return n.select("ticket_id", "kb_id", "sim")


@query("vec_nearest_tiled", f"SELECT ticket_id, kb_id, sim AS sim FROM ({RANKED}) WHERE rank = 1")
def nearest_tiled(t: Tables):
    """The layout for article sets beyond the broadcast bound."""
    n = sm.nearest(ticket_side(t), kb_side(t), broadcast_bytes=0, block_rows=128)
    return n.select("ticket_id", "kb_id", "sim")


@query("vec_top_k", f"SELECT ticket_id, rank, kb_id, sim AS sim FROM ({RANKED}) WHERE rank <= 10")
def top_k(t: Tables):
    n = sm.top_k(ticket_side(t), kb_side(t), 10)
    return n.select("ticket_id", F.col("rank").cast("long").alias("rank"), "kb_id", "sim")


PAIRS_ABOVE = f"SELECT a.vec_id AS a, b.vec_id AS b, {q.cosine('a.vec', 'b.vec')} AS sim FROM r_vec a JOIN r_vec b ON a.vec_id < b.vec_id AND {q.cosine('a.vec', 'b.vec')} > "


@query("vec_pairs_above", PAIRS_ABOVE + "0.35")
def pairs_above(t: Tables):
    return sm.pairs_above(t.vectors(), "vec_id", "vec", 0.35).select("a", "b", "sim")


@query("vec_pairs_pruned", PAIRS_ABOVE + "0.35")
def pairs_pruned(t: Tables):
    return pruned_pairs_above(t.vectors(), "vec_id", "vec", 0.35, cell_rows=256).select("a", "b", "sim")


@query("vec_cluster_sides", f"SELECT ticket_id, {q.checksum('mixed')} AS mixed_sum, {q.checksum('answer')} AS answer_sum FROM r_sides")
def cluster_sides(t: Tables):
    s = cv.working_vectors(t.ticket_vectors())
    # Stored vectors are single precision, so their length is one to seven digits only.
    raw = s.withColumn("mixed", F.when(F.col("res_vec").isNull(), F.col("problem_vec")).otherwise(F.col("cluster_vec")))
    raw = raw.withColumn("answer", F.coalesce("res_vec", "problem_vec"))
    return raw.select("ticket_id", checksum("mixed").alias("mixed_sum"), checksum("answer").alias("answer_sum"))


UNIT_SIDES = f"SELECT ticket_id, source, cluster_id, {q.unit('mixed')} AS mixed, {q.unit('answer')} AS answer FROM r_sides"
CENTROIDS = f"""SELECT cluster_id, list(m ORDER BY i) AS mixed, list(a ORDER BY i) AS answer FROM (
    SELECT cluster_id, i, avg(mixed[i]) AS m, avg(answer[i]) AS a FROM ({UNIT_SIDES}), range(1, 65) AS g(i) GROUP BY cluster_id, i) GROUP BY cluster_id"""


@query("vec_centroids", f"SELECT cluster_id, {q.checksum('mixed')} AS centroid_sum, {q.checksum('answer')} AS kb_centroid_sum FROM ({CENTROIDS})")
def centroids(t: Tables):
    s = sides(t)
    both = cl.centroids(s, "cluster_vec", ["cluster_id"]).join(
        cl.centroids(s, "kb_side_vec", ["cluster_id"], "kb_centroid"), "cluster_id"
    )
    return both.select("cluster_id", checksum("centroid").alias("centroid_sum"), checksum("kb_centroid").alias("kb_centroid_sum"))


INTRA = f"SELECT u.cluster_id, avg(list_cosine_similarity(u.mixed, c.mixed)) AS intra FROM ({UNIT_SIDES}) u JOIN ({CENTROIDS}) c USING (cluster_id) GROUP BY u.cluster_id"


@query("vec_intra_similarity", f"SELECT cluster_id, round(intra, 4) AS intra_sim, round(intra, 4) < 0.55 AS low FROM ({INTRA})")
def intra_similarity(t: Tables):
    s = sides(t)
    c = cl.centroids(s, "cluster_vec", ["cluster_id"])
    i = F.round("intra_sim", 4)
    return cl.intra_similarity(s, "cluster_vec", c, ["cluster_id"]).select(
        "cluster_id", i.alias("intra_sim"), (i < Thresholds.low_coherence).alias("low")
    )


@query("vec_novelty", f"""SELECT article_id, gap_flag, round(coalesce(sim, 0), 4) AS max_existing_kb_sim, coalesce(title, '') AS closest_existing_kb,
    coalesce(sim < CASE WHEN gap_flag = 'CRITICAL' THEN {r.NOVEL_CRITICAL} ELSE {r.NOVEL_OTHER} END, true) AS novelty_pass
    FROM (SELECT a.article_id, a.gap_flag, k.title, {q.cosine('a.article_embedding', 'k.kb_vec')} AS sim,
      row_number() OVER (PARTITION BY a.article_id ORDER BY {q.cosine('a.article_embedding', 'k.kb_vec')} DESC, k.kb_id) AS n
      FROM r_articles a LEFT JOIN r_kb k ON k.run_id = a.run_id AND a.quality = 0 WHERE a.article_embedding IS NOT NULL) WHERE n = 1""")
def novelty(t: Tables):
    """Drafts of high quality find no articles here (their run is renamed) and count as new."""
    a = t.articles().withColumn("run_id", F.when(F.col("quality") == 0, F.col("run_id")).otherwise("none"))
    n = sm.novelty(
        sm.Side(a, "article_embedding", ["article_id", "gap_flag"]),
        sm.Side(t.kb().withColumnRenamed("title", "kb_title"), "kb_vec", ["kb_id", "kb_title"]),
        "gap_flag", by=["run_id"], critical=r.NOVEL_CRITICAL, other=r.NOVEL_OTHER,
    )
    return n.select("article_id", "gap_flag", F.round("max_existing_kb_sim", 4).alias("max_existing_kb_sim"), "closest_existing_kb", "novelty_pass")


@query("vec_alignment", f"""SELECT article_id, round(coalesce(s, 0), 4) AS alignment_score, coalesce(s >= {r.ALIGNED}, false) AS alignment_pass FROM (
    SELECT a.article_id, {q.cosine('a.article_embedding', 'c.mixed')} AS s FROM r_articles a LEFT JOIN ({CENTROIDS}) c ON c.cluster_id = a.article_label
    WHERE a.article_embedding IS NOT NULL)""")
def alignment(t: Tables):
    c = cl.centroids(sides(t), "cluster_vec", ["cluster_id"])
    a = t.articles().where(F.col("article_embedding").isNotNull()).drop("cluster_id").withColumnRenamed("article_label", "cluster_id")
    out = sm.alignment(a, c, ["cluster_id"], "article_embedding", "centroid", r.ALIGNED)
    return out.select("article_id", F.round("alignment_score", 4).alias("alignment_score"), "alignment_pass")


@query("vec_approximate_top_k")
def approximate_top_k(t: Tables):
    n = cl.approximate_top_k(ticket_side(t), kb_side(t), 5, lists=10, probes=8)
    return n.select("ticket_id", "rank", "kb_id", "sim")


@query("vec_neighbour_graph")
def neighbour_graph(t: Tables):
    return nb.build(kb_side(t)).edges.select(F.col("node").alias("kb_id"), F.col("mate").alias("other_kb_id"), "sim")


@query("vec_neighbour_search")
def neighbour_search(t: Tables):
    found = nb.search(ticket_side(t), nb.build(kb_side(t)), 5)
    return found.select(F.col("query").alias("ticket_id"), "rank", F.col("node").alias("kb_id"), "sim")


UNIT_CENTROIDS = f"SELECT cluster_id, {q.unit('mixed')} AS vec FROM ({CENTROIDS})"


def along(k: int) -> str:
    return f"round(list_dot_product(list_transform(list_zip(vec, m), lambda z: z[1] - z[2]), p_axis{k}.axis), 6)"


@query("vec_project_centroids", f"WITH {q.principal(UNIT_CENTROIDS)} SELECT cluster_id, {along(1)} AS pca_x, {along(2)} AS pca_y FROM p_rows, p_mean, p_axis1, p_axis2")
def project_centroids(t: Tables):
    c = cl.centroids(sides(t), "cluster_vec", ["cluster_id"])
    return cl.project_2d(c).select("cluster_id", F.round("pca_x", 6).alias("pca_x"), F.round("pca_y", 6).alias("pca_y"))


def axis_row(k: int) -> str:
    return (f"SELECT {k} AS axis, round(variance, 6) AS variance, round(variance / list_sum(list_transform(range(1, 65), lambda i: s[i][i])), 6) AS share, "
            f"{q.checksum('axis')} AS axis_sum FROM p_axis{k}, p_left1")


@query("vec_principal_axes", f"WITH {q.principal(f'SELECT mixed AS vec FROM ({UNIT_SIDES})', 3)} {axis_row(1)} UNION ALL {axis_row(2)} UNION ALL {axis_row(3)}")
def principal_axes(t: Tables):
    """How much of the spread of all ticket vectors lies along their first three axes."""
    rows = sides(t)
    found = ax.principal_axes(rows, "cluster_vec", 3)
    listed = [(k + 1, float(v), float(v) / found.whole if found.whole else 0.0, a.tolist()) for k, (a, v) in enumerate(zip(found.axes, found.variances))]
    table = rows.sparkSession.createDataFrame(listed, "axis int, variance double, share double, a array<double>")
    return table.select("axis", F.round("variance", 6).alias("variance"), F.round("share", 6).alias("share"), checksum("a").alias("axis_sum"))


@query("vec_text_pieces", r"""SELECT text_id, i AS piece, md5(substr(text, i * 1000 + 1, 1000)) AS piece_md5 FROM (
    SELECT *, unnest(range(CAST(ceil(length(text) / 1000) AS BIGINT))) AS i FROM r_texts WHERE trim(translate(text, chr(9) || chr(10) || chr(13), '   ')) <> '')""")
def embedded_pieces(t: Tables):
    """What is sent to the embedding model: all of every text, piece by piece."""
    pieces = t.texts().select("text_id", F.posexplode(text_pieces(F.col("text"), 1000)).alias("piece", "p"))
    return pieces.select("text_id", F.col("piece").cast("long").alias("piece"), F.md5("p").alias("piece_md5"))


# --- coverage ----------------------------------------------------------------

COVERAGE = f"SELECT ticket_id, sim AS max_kb_sim, kb_id AS best_kb_id, substr(title, 1, 500) AS best_kb_title, {q.gap_class('sim', r.COVERED, r.PARTIAL, 'UNCOVERED')} AS coverage FROM ({RANKED}) WHERE rank = 1"


def ticket_coverage_table(t: Tables):
    return cv.ticket_coverage(t.ticket_vectors(), t.kb(), ("ticket_id",), r.COVERED, r.PARTIAL)


@query("cov_ticket_coverage", COVERAGE)
def ticket_coverage(t: Tables):
    return ticket_coverage_table(t)


@query("cov_counts", f"SELECT coverage, count(*) AS tickets FROM ({COVERAGE}) GROUP BY coverage")
def coverage_counts(t: Tables):
    return cv.coverage_counts(ticket_coverage_table(t))


@query("cov_uncovered_only", f"SELECT ticket_id FROM ({COVERAGE}) WHERE coverage = 'UNCOVERED'")
def uncovered_only(t: Tables):
    return cv.select_for_clustering(sides(t), ticket_coverage_table(t), only_uncovered=True).select("ticket_id")


CLUSTER_BEST = f"""SELECT * FROM (SELECT c.cluster_id, k.kb_id, k.title, {q.cosine('c.answer', 'k.kb_vec')} AS sim,
    row_number() OVER (PARTITION BY c.cluster_id ORDER BY {q.cosine('c.answer', 'k.kb_vec')} DESC, k.kb_id) AS n FROM ({CENTROIDS}) c, r_kb k) WHERE n = 1"""


@query("cov_cluster_summary", f"""SELECT s.cluster_id, s.size, round(i.intra, 4) AS intra_sim, b.kb_id AS best_kb_id, b.title AS best_kb_title,
    round(b.sim, 4) AS max_kb_sim, {q.gap_class('b.sim', r.CLUSTER_COVERED, r.CLUSTER_PARTIAL)} AS gap_flag
    FROM (SELECT cluster_id, count(*) AS size FROM r_tv GROUP BY 1) s JOIN ({INTRA}) i USING (cluster_id) JOIN ({CLUSTER_BEST}) b USING (cluster_id)""")
def cluster_summary(t: Tables):
    return cv.cluster_summary(sides(t), t.kb(), ("cluster_id",), r.CLUSTER_COVERED, r.CLUSTER_PARTIAL).drop("centroid", "kb_centroid")


# --- quality filter ----------------------------------------------------------

INC_JUDGED = f"""SELECT *, CASE WHEN problem_vec IS NULL OR e_resolution_summary IS NULL THEN 'no-vector'
    WHEN res_word_count < 5 THEN 'short' END AS drop_reason FROM (
    SELECT *, {INC_PROBLEM} AS problem_vec, len({q.words("coalesce(resolution_summary, '')")})::INTEGER AS res_word_count, {q.tier('resolution_summary')} AS evidence_tier FROM r_inc)"""
WO_JUDGED = f"""SELECT *, CASE WHEN problem_vec IS NULL OR e_activity_logs IS NULL THEN 'no-vector' WHEN res_word_count < 30 THEN 'short'
    WHEN NOT to_embed THEN 'no-detail' WHEN boilerplate THEN 'boilerplate' WHEN email_dominated THEN 'email' END AS drop_reason FROM ({WO_PROBLEM})"""


@query("qua_incidents", f"SELECT id, drop_reason IS NULL AS quality_pass, drop_reason, res_word_count, evidence_tier FROM ({INC_JUDGED})")
def quality_incidents(t: Tables):
    j = pp.judge_incidents(pp.incident_features(t.incident_inputs()))
    return j.select("id", "quality_pass", "drop_reason", "res_word_count", "evidence_tier")


@query("qua_workorders", f"SELECT id, drop_reason IS NULL AS quality_pass, drop_reason, res_word_count, evidence_tier, clean_words FROM ({WO_JUDGED})")
def quality_workorders(t: Tables):
    j = pp.judge_workorders(workorder_features(t))
    return j.select("id", "quality_pass", "drop_reason", "res_word_count", "evidence_tier", "clean_words")


@query("qua_drop_funnel", f"""SELECT count(*) AS total, count(*) FILTER (drop_reason IS NULL) AS usable, count(*) FILTER (drop_reason = 'no-vector') AS no_vector,
    count(*) FILTER (drop_reason = 'short') AS short, count(*) FILTER (drop_reason = 'no-detail') AS no_detail,
    count(*) FILTER (drop_reason = 'boilerplate') AS boilerplate, count(*) FILTER (drop_reason = 'email') AS email FROM ({WO_JUDGED})""")
def drop_funnel(t: Tables):
    return pp.drop_funnel(pp.judge_workorders(workorder_features(t)))


@query("qua_boilerplate_first", f"""SELECT id, CASE WHEN drop_reason = 'no-detail' AND boilerplate THEN 'boilerplate' ELSE drop_reason END AS drop_reason FROM ({WO_JUDGED})""")
def boilerplate_first(t: Tables):
    return pp.judge_workorders(workorder_features(t), boilerplate_first=True).select("id", "drop_reason")


@query("qua_embed_mask", f"SELECT id, clean_words, boilerplate, to_embed FROM ({WO_MASKED})")
def embed_mask(t: Tables):
    return pp.clean_workorders(t.workorder_inputs()).select("id", "clean_words", "boilerplate", "to_embed")


@query("qua_step_statistics", f"""SELECT (SELECT count(*) FROM r_inc) AS total_incidents, (SELECT count(*) FROM ({INC_JUDGED}) WHERE drop_reason IS NULL) AS usable_incidents,
    (SELECT count(*) FROM r_wo) AS total_workorders, (SELECT count(*) FROM ({WO_JUDGED}) WHERE drop_reason IS NULL) AS usable_workorders,
    (SELECT count(*) FROM ({INC_JUDGED}) WHERE drop_reason IS NULL) + (SELECT count(*) FROM ({WO_JUDGED}) WHERE drop_reason IS NULL) AS total_embedded,
    (SELECT count(*) FROM r_kb) AS kb_articles""")
def step_statistics(t: Tables):
    return pp.step_statistics(
        pp.judge_incidents(pp.incident_features(t.incident_inputs())), pp.judge_workorders(workorder_features(t)), t.kb()
    )


# --- clusters ----------------------------------------------------------------


@query("clu_kmeans")
def kmeans(t: Tables):
    k = cl.kmeans(sides(t).drop("cluster_id"), "cluster_vec", 8)
    return k.select("ticket_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query("clu_sweep")
def sweep(t: Tables):
    return cl.choose_k(cl.sweep(sides(t), "cluster_vec"))


@query("clu_minibatch")
def minibatch_kmeans(t: Tables):
    k = mb.kmeans(sides(t).drop("cluster_id"), "ticket_id", "cluster_vec", 8)
    return k.select("ticket_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query("clu_minibatch_sweep")
def minibatch_sweep(t: Tables):
    return cl.choose_k(mb.sweep(sides(t), "ticket_id", "cluster_vec"))


@query("clu_choose_k", """WITH sized AS (SELECT run_id, year(o_orderdate) AS y, service_type AS s, count(*) AS n FROM r_tickets JOIN orders USING (o_orderkey) GROUP BY ALL),
    swept AS (SELECT month(reported_date)::INTEGER AS k, run_id, avg(price) / 1000000 AS silhouette, count(*) / (sum(count(*)) OVER (PARTITION BY run_id)) AS max_share FROM r_tickets GROUP BY 1, 2),
    scored AS (SELECT *, round(silhouette - 2 * greatest(0, max_share - 0.10), 6) AS score FROM swept)
    SELECT run_id, k, round(silhouette, 6) AS silhouette, round(max_share, 6) AS max_share, score,
    row_number() OVER (PARTITION BY run_id ORDER BY score DESC, k) = 1 AS is_best_k FROM scored""")
def choose_k(t: Tables):
    """Months of a run stand for the values of K."""
    m = t.tickets().groupBy("run_id", F.month("reported_date").alias("k")).agg(
        (F.avg("price") / 1000000).alias("silhouette"), F.count("*").alias("n")
    )
    total = m.groupBy("run_id").agg(F.sum("n").alias("all"))
    swept = m.join(total, "run_id").withColumn("max_share", F.col("n") / F.col("all"))
    c = cl.choose_k(swept, ["run_id"])
    return c.select("run_id", "k", *[F.round(x, 6).alias(x) for x in ("silhouette", "max_share", "score")], "is_best_k")


@query("clu_sizes", "SELECT run_id, cluster_id, count(*) AS size FROM r_assign GROUP BY ALL")
def cluster_sizes(t: Tables):
    return cl.cluster_sizes(t.assignments(), ["run_id"])


@query("clu_largest_share", "SELECT run_id, count(*) AS clusters, sum(size)::BIGINT AS tickets, round(max(size) / sum(size), 6) AS max_share FROM r_clusters GROUP BY run_id")
def largest_share(t: Tables):
    s = cl.largest_share(cl.cluster_sizes(t.assignments(), ["run_id"]), ["run_id"])
    return s.withColumn("max_share", F.round("max_share", 6))


SILHOUETTE = """WITH u AS (SELECT vec_id, label, vec FROM r_vec),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(sqrt(greatest(0, 2 - 2 * round(list_cosine_similarity(a.vec, b.vec), 9)))) AS total, count(*) AS n FROM u a, u b GROUP BY ALL),
    s AS (SELECT vec_id, label, max(total / nullif(n - 1, 0)) FILTER (other = label) AS a, min(total / n) FILTER (other <> label) AS b FROM d GROUP BY ALL)
    SELECT """


@query("clu_silhouette", SILHOUETTE + "vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM s")
def silhouette(t: Tables):
    v = t.vectors().withColumnRenamed("label", "cluster_id")
    s = cl.euclidean_silhouette(v, "vec_id", "vec")
    return s.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query("clu_squared_silhouette", """WITH d AS (SELECT a.vec_id, a.label, b.label AS other, sum(2 - 2 * list_cosine_similarity(a.vec, b.vec)) AS total, count(*) AS n
      FROM r_vec a JOIN r_vec b ON true GROUP BY ALL),
    s AS (SELECT vec_id, label, max(total / nullif(n - 1, 0)) FILTER (other = label) AS a, min(total / n) FILTER (other <> label) AS b FROM d GROUP BY ALL)
    SELECT vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM s""")
def squared_silhouette(t: Tables):
    s = cl.squared_silhouette(t.vectors().withColumnRenamed("label", "cluster_id"), "vec_id", "vec")
    return s.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query("clu_sampled_silhouette", SILHOUETTE + "round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS rows FROM s")
def sampled_silhouette(t: Tables):
    v = t.vectors().withColumnRenamed("label", "cluster_id")
    return cl.sampled_silhouette(v, "vec_id", "vec", 10000).withColumn("silhouette", F.round("silhouette", 6))


@query("clu_oversize_bound", "SELECT greatest(20, 2 * floor(median(size)))::BIGINT AS max_size FROM r_clusters")
def oversize_bound(t: Tables):
    return cl.oversize_bound(t.clusters(), 20)


@query("clu_split_oversize")
def split_oversize(t: Tables):
    start = sides(t).withColumn("cluster_id", F.when(F.col("cluster_id") >= 5, 5).otherwise(F.col("cluster_id")).cast("int"))
    out = cl.split_oversize(start, "ticket_id", "cluster_vec", floor=50, target=40)
    return out.select("ticket_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query("clu_renumber", "SELECT run_id, source_id, dense_rank() OVER (PARTITION BY run_id ORDER BY cluster_id) - 1 AS cluster_id FROM r_assign")
def renumber(t: Tables):
    a = t.assignments().withColumn("cluster_id", F.col("cluster_id") * 3 + 1)
    return cl.renumber(a, ["run_id"]).select("run_id", "source_id", "cluster_id")


@query("clu_enough_tickets", "SELECT count(*) >= 20 AS enough FROM r_tv")
def enough_tickets(t: Tables):
    return t.ticket_vectors().agg((F.count("*") >= Thresholds.min_cluster_tickets).alias("enough"))


# --- labels ------------------------------------------------------------------

STOPS = ", ".join(q.lit(s) for s in r.STOP_WORDS)
DOC_TOKENS = f"""SELECT doc_id, substr(source, 4)::BIGINT AS cluster_id, list_filter(regexp_extract_all({q.normalise_terms(q.strip('text'))}, '[a-zA-Z]{{3,}}'),
    lambda s: s NOT IN ({STOPS})) AS w FROM documents"""
DOC_TERMS = f"""SELECT doc_id, cluster_id, term, count(*) AS tf FROM (SELECT doc_id, cluster_id, unnest(
    list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ({DOC_TOKENS})) GROUP BY ALL"""
VOCAB = f"""SELECT * FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, (SELECT count(*) FROM documents) AS n FROM ({DOC_TERMS}) GROUP BY term)
    WHERE df >= 5 AND df <= 0.8 * n ORDER BY total DESC, term LIMIT 5000"""
WEIGHTS = f"""SELECT doc_id, cluster_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (
    SELECT c.*, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM ({DOC_TERMS}) c JOIN ({VOCAB}) v USING (term))"""
TOP_TERMS = f"""SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS rank FROM (
    SELECT cluster_id, term, round(sum(weight) / any_value(size), 12) AS weight FROM ({WEIGHTS}) JOIN (
      SELECT substr(source, 4)::BIGINT AS cluster_id, count(*) AS size FROM documents GROUP BY 1) USING (cluster_id) GROUP BY cluster_id, term)"""


def label_docs(t: Tables):
    return t.documents().select("doc_id", F.substring("source", 4, 9).cast("long").alias("cluster_id"), "text")


def label_counts(t: Tables):
    return lb.term_counts(label_docs(t), "doc_id", "text", None, r.STOP_WORDS)


@query("lbl_term_counts", f"SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS total FROM ({DOC_TERMS}) GROUP BY doc_id")
def term_counts(t: Tables):
    return label_counts(t).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("total"))


@query("lbl_vocabulary", f"SELECT term, df, total FROM ({VOCAB})")
def vocabulary(t: Tables):
    return lb.vocabulary(label_counts(t), label_docs(t)).select("term", "df", "total")


def label_weights(t: Tables):
    counts = label_counts(t)
    return lb.tfidf(counts, lb.vocabulary(counts, label_docs(t)), "doc_id")


@query("lbl_tfidf", f"SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS top_weight, round(sum(weight * weight), 6) AS squares FROM ({WEIGHTS}) GROUP BY doc_id")
def tfidf(t: Tables):
    w = F.col("weight")
    return label_weights(t).groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.round(F.sum(w), 6).alias("weight_sum"), F.round(F.max(w), 6).alias("top_weight"),
        F.round(F.sum(w * w), 6).alias("squares"),
    )


@query("lbl_cluster_terms", f"SELECT cluster_id, rank, term, round(weight, 6) AS weight FROM ({TOP_TERMS}) WHERE rank <= 20")
def cluster_terms(t: Tables):
    c = lb.cluster_terms(label_weights(t), label_docs(t))
    return c.select("cluster_id", F.col("rank").cast("long").alias("rank"), "term", F.round("weight", 6).alias("weight"))


FOLD = f"""SELECT cluster_id, list_reduce(list_prepend({{'kept': []::VARCHAR[], 'seen': []::VARCHAR[]}}, list_transform(terms, lambda x: {{'kept': [x], 'seen': string_split(x, ' ')}})),
    lambda s, x: CASE WHEN len(list_filter(x.seen, lambda w: NOT list_contains(s.seen, w))) > 0 AND len(s.kept) < 10
      THEN {{'kept': list_concat(s.kept, x.kept), 'seen': list_concat(s.seen, x.seen)}} ELSE s END).kept AS kept
    FROM (SELECT cluster_id, list(term ORDER BY rank) AS terms FROM ({TOP_TERMS}) WHERE rank <= 20 GROUP BY cluster_id)"""


@query("lbl_cluster_labels", f"""SELECT c.cluster_id, coalesce(array_to_string(kept[1:3], ' / '), 'Cluster_' || c.cluster_id) AS cluster_label,
    coalesce(array_to_string(kept, ', '), '') AS top_terms FROM (SELECT DISTINCT substr(source, 4)::BIGINT AS cluster_id FROM documents) c LEFT JOIN ({FOLD}) f USING (cluster_id)""")
def cluster_labels(t: Tables):
    return lb.labels(lb.cluster_terms(label_weights(t), label_docs(t)), label_docs(t))


def samples(t: Tables):
    u = tb.unified_tickets(t.incidents(), t.workorders())
    ids = t.assignments().join(u.select("source", "source_id"), ["source", "source_id"], "left_semi")
    return cv.label_samples(ids, tickets=u)


def members(t: Tables):
    return t.assignments().select("run_id", "source", "source_id", "cluster_id").join(
        tb.unified_tickets(t.incidents(), t.workorders()), ["source", "source_id"]
    )


FLAT = lambda c: q.strip(f"replace(coalesce({c}, ''), chr(10), ' ')")


SAMPLES = f"""SELECT cluster_id, string_agg(n || '. ' || b, chr(10) ORDER BY n) AS samples FROM (
    SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY pick) AS n, b FROM (
      SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('42|' || source || '|' || source_id), source, source_id) AS pick,
        concat_ws('  ', CASE WHEN p <> '' THEN 'Problem: ' || p END, CASE WHEN r <> '' THEN 'Resolution: ' || r END) AS b
      FROM (SELECT a.cluster_id, u.source, u.source_id, substr({FLAT('problem_text')}, 1, 100) AS p, substr({FLAT('resolution_text')}, 1, 100) AS r
            FROM r_assign a JOIN r_unified u USING (source, source_id))) WHERE pick <= 5 AND b <> '') GROUP BY cluster_id"""


@query("lbl_samples", f"SELECT cluster_id, md5(samples) AS samples_md5 FROM ({SAMPLES})")
def label_samples(t: Tables):
    s = samples(t)
    return s.select("cluster_id", F.md5("samples").alias("samples_md5"))


def named_clusters(t: Tables):
    c = t.clusters().groupBy("cluster_id").agg(F.min("cluster_label").alias("cluster_label"), F.sum("size").alias("size"))
    return c.withColumn("top_terms", F.when(F.col("cluster_id") % 4 != 0, F.col("cluster_label")))


NAMED = """SELECT cluster_id, min(cluster_label) AS cluster_label, sum(size)::BIGINT AS size, CASE WHEN cluster_id % 4 <> 0 THEN min(cluster_label) END AS top_terms
    FROM r_clusters GROUP BY cluster_id"""


@query("lbl_prompts", f"""SELECT cluster_id, md5({q.lit("Name this group of support tickets in three to six words, title case.")} || chr(10) || 'Tickets: ' || size || chr(10) || 'Terms: '
    || coalesce(top_terms, '') || chr(10) || 'Samples:' || chr(10) || samples || chr(10) || chr(10) || {q.lit('Reply with JSON: {"label": "..."}')}) AS prompt_md5
    FROM ({NAMED}) JOIN ({SAMPLES}) USING (cluster_id)""")
def label_prompts(t: Tables):
    return cv.label_prompts(named_clusters(t), samples(t)).select("cluster_id", F.md5("prompt").alias("prompt_md5"))


@query("lbl_replies", f"""SELECT cluster_id, CASE WHEN cluster_id % 3 = 0 THEN 'About ' || cluster_label ELSE cluster_label END AS cluster_label, size FROM ({NAMED})""")
def label_replies(t: Tables):
    """Replies made from the clusters: good ones, short ones, some without the key, some that are no JSON."""
    c = named_clusters(t)
    label, kind = F.concat(F.lit("About "), "cluster_label"), F.col("cluster_id") % 3
    reply = F.when(kind == 0, F.to_json(F.struct(label.alias("label")))).when(kind == 1, F.to_json(F.struct(label.alias("name")))).otherwise(label)
    return cv.use_labels(c, c.select("cluster_id", reply.alias("reply"))).select("cluster_id", "cluster_label", "size")
