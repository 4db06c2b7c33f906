"""Report queries and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.operators.clustering import choose_k
from gapscope.plans import reports as rp
from gapscope.plans import rollup as ru
from gapscope.queries.roles import Tables
from gapscope.queries import sql_roles as q
from gapscope.queries.articles import VALIDATION, scored_articles, validated
from gapscope.queries.coverage import checksum
from gapscope.queries.registry import query
from gapscope.queries.texts import SCORE_SQL, listed
from gapscope.sources import sinks as sk
from gapscope.sources import tables as tb

# --- runs --------------------------------------------------------------------

ORDER = "CASE status WHEN 'complete' THEN 0 WHEN 'running' THEN 1 ELSE 2 END, started_at DESC, run_id"
WITH_CRITICAL = "SELECT run_id FROM r_clusters WHERE gap_flag = 'CRITICAL' AND size > 25"


@query("dash_runs", f"SELECT run_id, started_at, status, false AS hidden FROM r_runs WHERE run_id IN ({WITH_CRITICAL}) AND run_id <> '1999' ORDER BY {ORDER} LIMIT 20")
def runs(t: Tables):
    return rp.run_list(t.runs(), t.clusters().where("gap_flag = 'CRITICAL' AND size > 25"), hidden=["1999"])


@query("dash_runs_hidden", f"SELECT run_id, started_at, status, run_id = '1999' AS hidden FROM r_runs ORDER BY {ORDER} LIMIT 200")
def runs_hidden(t: Tables):
    return rp.run_list(t.runs(), t.clusters(), hidden=["1999"], include_hidden=True, require_clusters=False, most=200)


@query("dash_latest_run", "SELECT * FROM r_runs WHERE run_id IN (SELECT run_id FROM r_gaps WHERE gap_flag = 'COVERED') ORDER BY started_at DESC LIMIT 1")
def latest_run(t: Tables):
    return rp.latest_run(t.runs(), t.gaps().where("gap_flag = 'COVERED'"))


# --- clusters ----------------------------------------------------------------

BARE = """SELECT *, CASE WHEN summary = '' THEN '' END AS review_match, NULL::VARCHAR AS review_confidence, NULL::VARCHAR AS review_reason,
    CASE WHEN size < 12 THEN NULL ELSE max_kb_sim END AS pca_x FROM r_clusters"""
MATCHES = """SELECT run_id, cluster_id, cluster_label || ' article' AS matched_kb_title, CASE WHEN max_kb_sim < 0.47 THEN 'HIGH' ELSE 'LOW' END AS confidence, 'close' AS reasoning
    FROM r_clusters WHERE size >= 16"""
COUNTS = "SELECT run_id, cluster_id, count(*) FILTER (source = 'workorder') AS wo_tickets, count(*) FILTER (source = 'incident') AS inc_tickets FROM r_assign GROUP BY ALL"


def list_sql(keep: str) -> str:
    return f"""SELECT run_id, cluster_id, cluster_label, size, CASE WHEN gap_flag = 'CRITICAL' AND conf = 'HIGH' AND match <> '' THEN 'PARTIAL' ELSE gap_flag END AS gap_flag, max_kb_sim, pca_x,
    nullif(summary, '') AS summary, nullif(match, '') AS review_match, conf AS review_confidence, why AS review_reason,
    CASE WHEN gap_flag = 'DUPLICATE' THEN merged_into END AS canonical_cluster_id, wo_tickets, inc_tickets FROM (
    SELECT c.*, CASE WHEN coalesce(review_match, '') = '' THEN m.matched_kb_title ELSE review_match END AS match, m.confidence AS conf, m.reasoning AS why,
      coalesce(wo_tickets, 0) AS wo_tickets, coalesce(inc_tickets, 0) AS inc_tickets
    FROM ({BARE}) c LEFT JOIN ({MATCHES}) m USING (run_id, cluster_id) LEFT JOIN ({COUNTS}) s USING (run_id, cluster_id)) WHERE {keep}"""


def bare_clusters(t: Tables):
    none = F.lit(None).cast("string")
    return t.clusters().drop("merged_into").select(
        "*", F.when(F.col("summary") == "", "").alias("review_match"), none.alias("review_confidence"), none.alias("review_reason"),
        F.when(F.col("size") < 12, F.lit(float("nan"))).otherwise(F.col("max_kb_sim")).alias("pca_x"),
    )


def matches(t: Tables):
    return t.clusters().where("size >= 16").select(
        "run_id", "cluster_id", F.concat("cluster_label", F.lit(" article")).alias("matched_kb_title"),
        F.when(F.col("max_kb_sim") < 0.47, "HIGH").otherwise("LOW").alias("confidence"), F.lit("close").alias("reasoning"),
    )


def listed_clusters(t: Tables, **kw):
    return rp.cluster_list(bare_clusters(t), t.gaps(), matches(t), t.assignments(), **kw)


@query("dash_clusters", list_sql("NOT (run_id = '1997' AND cluster_id IN (5, 57))"))
def clusters(t: Tables):
    hidden = t.clusters().where("run_id = '1997' AND cluster_id IN (5, 57)").select("run_id", "cluster_id")
    return listed_clusters(t, excluded=hidden)


@query("dash_clusters_by_source", list_sql("wo_tickets > 0"))
def clusters_by_source(t: Tables):
    return listed_clusters(t, source="workorder")


@query("dash_source_counts", COUNTS)
def source_counts(t: Tables):
    return rp.source_counts(t.assignments())


DETAIL = """SELECT a.run_id, a.cluster_id, a.source, a.ticket_number, a.service_type, a.assigned_group, md5(u.problem_text) AS problem_md5, md5(coalesce(u.resolution_text, '')) AS resolution_md5
    FROM r_assign a JOIN r_unified u USING (source, source_id)"""


def detail(t: Tables, clusters=None):
    """Digests are taken before tickets meet their clusters, so texts are not moved for that."""
    u = tb.unified_tickets(t.incidents(), t.workorders())
    u = u.withColumn("problem_text", F.md5("problem_text")).withColumn("resolution_text", F.md5(F.coalesce("resolution_text", F.lit(""))))
    return rp.tickets_of(t.assignments(), u, clusters).select(
        "run_id", "cluster_id", "source", "ticket_number", "service_type", "assigned_group",
        F.col("problem_text").alias("problem_md5"), F.col("resolution_text").alias("resolution_md5"),
    )


@query("dash_tickets", DETAIL)
def tickets(t: Tables):
    return detail(t)


@query("dash_tickets_of_clusters", DETAIL + " WHERE a.cluster_id IN (3, 77)")
def tickets_of_clusters(t: Tables):
    return detail(t, [3, 77])


SWEPT = """SELECT run_id, k, inertia, silhouette, row_number() OVER (PARTITION BY run_id ORDER BY round(silhouette - 2 * greatest(0, max_share - 0.10), 9) DESC, k) = 1 AS is_best_k FROM (
    SELECT run_id, month(reported_date)::INTEGER AS k, round(sum(price) / 1000, 1) AS inertia, round(avg(price) / 1000000, 6) AS silhouette, 0.05 AS max_share FROM r_tickets GROUP BY ALL)"""


def swept(t: Tables):
    s = t.tickets().groupBy("run_id", F.month("reported_date").alias("k")).agg(
        (F.sum("price") / 1000).alias("inertia"), (F.avg("price") / 1000000).alias("silhouette"), F.lit(0.05).alias("max_share")
    )
    return sk.sweep_rows(choose_k(s.withColumn("silhouette", F.round("silhouette", 6)), ["run_id"]))


@query("dash_sweep", f"SELECT run_id, k, inertia, silhouette, is_best_k FROM ({SWEPT}) ORDER BY run_id, k")
def sweep(t: Tables):
    return rp.sweep_rows(swept(t))


@query("dash_best_k", f"SELECT run_id, k, silhouette FROM ({SWEPT}) WHERE is_best_k")
def best_k(t: Tables):
    return rp.best_k(swept(t)).select("run_id", "k", "silhouette")


BREAKDOWN = "SELECT a.run_id, a.service_type, g.gap_flag, count(*) AS tickets FROM r_assign a JOIN r_gaps g USING (run_id, cluster_id) {where} GROUP BY ALL"


@query("dash_service_breakdown", BREAKDOWN.format(where=""))
def service_breakdown(t: Tables):
    return rp.service_breakdown(t.assignments(), t.gaps())


@query("dash_service_breakdown_source", BREAKDOWN.format(where="WHERE a.source = 'incident'"))
def service_breakdown_source(t: Tables):
    return rp.service_breakdown(t.assignments(), t.gaps(), "incident")


@query("dash_source_mix", "SELECT run_id, source, count(*) AS tickets FROM r_assign GROUP BY ALL")
def source_mix(t: Tables):
    return rp.source_mix(t.assignments())


MIX = "SELECT a.run_id, a.cluster_id, c.cluster_label, a.source, count(*) AS tickets FROM r_assign a JOIN r_clusters c USING (run_id, cluster_id) GROUP BY ALL"


@query("dash_source_mix_clusters", MIX)
def source_mix_clusters(t: Tables):
    return rp.source_mix_per_cluster(t.assignments(), t.clusters())


@query("dash_workorder_clusters", f"SELECT run_id, count(*) FILTER (wo_tickets > 0) AS clusters_with_wo, count(*) FILTER (wo_tickets / (wo_tickets + inc_tickets) > 0.5) AS wo_dominant FROM ({COUNTS}) GROUP BY run_id")
def workorder_clusters(t: Tables):
    return rp.workorder_clusters(t.assignments())


@query("dash_incident_dominant", f"""SELECT run_id, count(*) AS total_clusters, count(*) FILTER (wo_tickets > 0) AS clusters_with_wo, count(*) FILTER (wo_tickets / (wo_tickets + inc_tickets) > 0.5) AS wo_dominant,
    count(*) - count(*) FILTER (wo_tickets / (wo_tickets + inc_tickets) > 0.5) AS inc_dominant FROM r_clusters JOIN ({COUNTS}) USING (run_id, cluster_id) GROUP BY run_id""")
def incident_dominant(t: Tables):
    return rp.incident_dominant(t.assignments(), t.clusters())


@query("dash_gap_distribution", "SELECT run_id, gap_flag, count(*) AS clusters, sum(size)::BIGINT AS tickets FROM r_clusters GROUP BY ALL")
def gap_distribution(t: Tables):
    return rp.gap_distribution(t.clusters())


@query("dash_flag_totals", """SELECT run_id, count(*) AS total, count(*) FILTER (gap_flag = 'CRITICAL') AS critical, count(*) FILTER (gap_flag = 'PARTIAL') AS partial,
    count(*) FILTER (gap_flag = 'COVERED') AS covered, count(*) FILTER (gap_flag = 'DUPLICATE') AS duplicate FROM r_clusters GROUP BY run_id""")
def flag_totals(t: Tables):
    return rp.flag_totals(t.clusters())


@query("dash_largest_clusters", """SELECT run_id, place, cluster_id, substr(cluster_label, 1, 42) AS label, size, gap_flag FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY size DESC, cluster_id) AS place FROM r_clusters) WHERE place <= 30""")
def largest_clusters(t: Tables):
    c = rp.largest_clusters(t.clusters())
    return c.withColumn("place", F.col("place").cast("long"))


@query("dash_service_pivot", f"""SELECT run_id, service_type, {", ".join(f"coalesce(sum(tickets) FILTER (gap_flag = '{f}'), 0)::BIGINT AS {f.lower()}" for f in rp.FLAGS)}, sum(tickets)::BIGINT AS total
    FROM ({BREAKDOWN.format(where="")}) GROUP BY ALL""")
def service_pivot(t: Tables):
    return rp.service_pivot(rp.service_breakdown(t.assignments(), t.gaps()))


@query("dash_source_pivot", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY total DESC, cluster_id) AS place FROM (
    SELECT run_id, cluster_id, substr(cluster_label, 1, 38) AS label, coalesce(sum(tickets) FILTER (source = 'incident'), 0)::BIGINT AS incident,
    coalesce(sum(tickets) FILTER (source = 'workorder'), 0)::BIGINT AS workorder, sum(tickets)::BIGINT AS total FROM ({MIX}) GROUP BY ALL)) WHERE place <= 30""")
def source_pivot(t: Tables):
    p = rp.source_pivot(rp.source_mix_per_cluster(t.assignments(), t.clusters()))
    return p.withColumn("place", F.col("place").cast("long"))


@query("dash_merged_sizes", """SELECT c.run_id, c.cluster_id, c.size, c.size + coalesce(d.extra, 0)::BIGINT AS merged_size, coalesce(d.ids, '') AS duplicates FROM r_clusters c LEFT JOIN (
    SELECT run_id, merged_into AS cluster_id, sum(size) AS extra, string_agg(cluster_id, ',' ORDER BY size DESC, cluster_id) AS ids FROM r_clusters WHERE gap_flag = 'DUPLICATE' GROUP BY ALL) d USING (run_id, cluster_id)""")
def merged_sizes(t: Tables):
    c = t.clusters().withColumn("canonical_cluster_id", F.col("merged_into"))
    return rp.merged_sizes(c).withColumn("duplicates", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ","))


@query("dash_filter_clusters", "SELECT run_id, cluster_id, cluster_label FROM r_clusters WHERE gap_flag IN ('CRITICAL', 'PARTIAL') AND contains(lower(cluster_label), 'machin')")
def filter_clusters(t: Tables):
    return rp.filter_clusters(t.clusters(), ["CRITICAL", "PARTIAL"], "Machin").select("run_id", "cluster_id", "cluster_label")


@query("dash_scatter", "SELECT run_id, gap_flag, cluster_id, cluster_label, size, max_kb_sim AS pca_x, size / 100 AS pca_y FROM r_clusters WHERE size >= 12")
def scatter(t: Tables):
    c = t.clusters().withColumn("pca_x", F.when(F.col("size") >= 12, F.col("max_kb_sim"))).withColumn("pca_y", F.col("size") / 100)
    return rp.scatter(c)


def rollup_sql() -> str:
    sets = ", ".join(f"({', '.join(columns)})" for columns in ru.LEVELS.values())
    bits = {name: sum(1 << (len(ru.DIMENSIONS) - 1 - i) for i, d in enumerate(ru.DIMENSIONS) if d not in columns) for name, columns in ru.LEVELS.items()}
    names = " ".join(f"WHEN {b} THEN '{name}'" for name, b in bits.items())
    return f"""SELECT run_id, CASE id {names} END AS level, cluster_id, source, service_type, gap_flag, tickets FROM (
        SELECT run_id, cluster_id, source, service_type, gap_flag, sum(n)::BIGINT AS tickets, count(held) AS held, grouping({", ".join(ru.DIMENSIONS)}) AS id FROM (
            SELECT run_id, cluster_id, source, service_type, gap_flag, CASE WHEN held THEN 1 ELSE 0 END AS n, held
            FROM (SELECT *, true AS held FROM r_assign) a FULL JOIN (SELECT run_id, cluster_id, gap_flag FROM r_gaps) g USING (run_id, cluster_id))
        GROUP BY GROUPING SETS ({sets}))
    WHERE held > 0 OR id IN ({bits['cluster']}, {bits['flag']}, {bits['run']})"""


@query("dash_rollup", rollup_sql())
def rollup(t: Tables):
    return ru.rollup(t.assignments(), t.gaps())


# --- articles ----------------------------------------------------------------


def stored_articles(t: Tables):
    """Drafts as stored, every draft after a toxic one being its duplicate."""
    a = scored_articles(t)
    before = a.where("toxic = 1").select(F.col("article_id").alias("is_duplicate_of"), (F.col("cluster_id") + 1).alias("cluster_id"))
    return a.join(before, "cluster_id", "left").withColumn("needs_review", F.col("quality_score") < 10).withColumn(
        "symptoms", F.when(F.col("quality") == 1, F.to_json("resolution_steps")).otherwise(F.col("problem_statement"))
    )


STORED = f"""SELECT a.*, {SCORE_SQL.replace('resolution_steps', 'a.resolution_steps').replace('problem_statement', 'a.problem_statement').replace('escalation_trigger', 'a.escalation_trigger').replace('confidence', 'a.confidence')} AS quality_score, b.article_id AS is_duplicate_of
    FROM r_articles a LEFT JOIN r_articles b ON b.cluster_id = a.cluster_id - 1 AND b.toxic = 1"""


@query("dash_articles", f"""SELECT a.run_id, a.cluster_id, title, category, quality_score::DOUBLE AS quality_score, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    quality_score < 10 AS needs_review, md5(problem_statement) AS problem_md5, md5(CASE WHEN len(resolution_steps) > 0 THEN array_to_string(resolution_steps, ' | ') END) AS steps_md5,
    md5(CASE WHEN quality = 1 THEN array_to_string(resolution_steps, ' | ') WHEN problem_statement <> '' THEN array_to_string(list_filter(list_transform(string_split(problem_statement, chr(10)),
      lambda s: {q.strip('s')}), lambda s: s <> ''), ' | ') END) AS symptoms_md5, additional_notes, is_duplicate_of, coalesce(w.n, 0) AS wo_in_cluster
    FROM ({STORED}) a LEFT JOIN (SELECT cluster_id, count(*) AS n FROM r_assign WHERE source = 'workorder' GROUP BY ALL) w USING (cluster_id)""")
def articles(t: Tables):
    """Tickets of all years count for the cluster of the same number."""
    runs = t.articles().select("run_id", "cluster_id")
    tickets = t.assignments().drop("run_id").join(runs, "cluster_id")
    a = rp.article_list(stored_articles(t), tickets)
    return a.select(
        "run_id", "cluster_id", "title", "category", "quality_score", "confidence", "needs_review", F.md5("problem_statement").alias("problem_md5"),
        F.md5(listed("resolution_steps")).alias("steps_md5"), F.md5(listed("symptoms")).alias("symptoms_md5"), "additional_notes", "is_duplicate_of", "wo_in_cluster",
    )


@query("dash_article_stats", f"""SELECT run_id, count(*) FILTER (is_duplicate_of IS NULL) AS canonical, count(is_duplicate_of) AS duplicates, round(avg(quality_score), 1) AS avg_quality,
    count(*) FILTER (quality_score < 10) AS needs_review, coalesce(any_value(v.n), 0) AS validated FROM ({STORED}) LEFT JOIN (
      SELECT run_id, count(*) AS n FROM ({VALIDATION}) WHERE validation_status = 'VALIDATED' GROUP BY ALL) v USING (run_id) GROUP BY run_id""")
def article_stats(t: Tables):
    return rp.article_stats(stored_articles(t), validated(t))


USE = "SELECT kb_id, CASE WHEN kb_id < 125 THEN 'ACTIVE' ELSE 'ORPHAN' END AS status, kb_id AS clusters_as_best FROM r_kb WHERE issue < 'fr'"


def use(t: Tables):
    k = t.kb().where("issue < 'fr'")
    return k.select("kb_id", F.when(F.col("kb_id") < 125, "ACTIVE").otherwise("ORPHAN").alias("status"), F.col("kb_id").alias("clusters_as_best"))


@query("dash_existing_kb", f"SELECT k.kb_id, k.title, k.issue, md5(k.solution) AS solution_md5, u.status AS util_status, u.clusters_as_best AS util_count FROM r_kb k LEFT JOIN ({USE}) u USING (kb_id)")
def existing_kb(t: Tables):
    e = rp.existing_articles(t.kb(), use(t))
    return e.select("kb_id", "title", "issue", F.md5("solution").alias("solution_md5"), "util_status", "util_count")


@query("dash_existing_stats", f"""SELECT count(*) AS total, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'ORPHAN') AS orphaned, count(*) FILTER (status = 'OVER-RELIED') AS over_relied
    FROM r_kb LEFT JOIN ({USE}) USING (kb_id)""")
def existing_stats(t: Tables):
    return rp.existing_stats(t.kb(), use(t))


@query("dash_filter_articles", f"SELECT run_id, cluster_id, title, category FROM ({STORED}) WHERE toxic = 0 AND (contains(lower(title), 'the') OR contains(lower(category), 'the'))")
def filter_articles(t: Tables):
    hidden = t.articles().where("toxic = 1").select("run_id", "cluster_id")
    return rp.visible_articles(stored_articles(t), hidden, "The").select("run_id", "cluster_id", "title", "category")


@query("dash_visible_article_stats", f"""SELECT run_id, count(*) FILTER (is_duplicate_of IS NULL) AS canonical, count(is_duplicate_of) AS duplicates, round(avg(quality_score), 1) AS avg_quality,
    count(*) FILTER (quality_score < 10) AS needs_review, coalesce(any_value(v.n), 0) AS validated FROM ({STORED}) LEFT JOIN (
      SELECT run_id, count(*) AS n FROM ({VALIDATION}) WHERE validation_status = 'VALIDATED' GROUP BY ALL) v USING (run_id) WHERE toxic = 0 GROUP BY run_id""")
def visible_article_stats(t: Tables):
    hidden = t.articles().where("toxic = 1").select("run_id", "cluster_id")
    return rp.article_stats(rp.visible_articles(stored_articles(t), hidden), validated(t))


@query("dash_filter_existing", f"SELECT kb_id, title FROM r_kb JOIN ({USE}) USING (kb_id) WHERE status = 'ACTIVE' AND (contains(lower(title), 'en') OR contains(lower(issue), 'en'))")
def filter_existing(t: Tables):
    return rp.filter_existing(rp.existing_articles(t.kb(), use(t)), "EN", "ACTIVE").select("kb_id", "title")


# --- table maintenance -------------------------------------------------------

# The stored state is that of the dear tickets, the new write that of the cheap ones.
# A merge gives the content of the runs that occur in the new write.
OLD, NEW = "price >= 100000", "price < 300000"


@query("sink_ticket_embeddings", f"""SELECT source, source_id, run_id, CASE WHEN {NEW} THEN 2 ELSE 1 END AS res_word_count, CASE WHEN {NEW} THEN evidence_tier ELSE 4 END AS evidence_tier, price >= 20000 AS quality_pass
    FROM r_tickets WHERE {OLD} OR {NEW}""")
def sink_ticket_embeddings(t: Tables):
    x = t.tickets()
    shape = lambda w, n, tier: x.where(w).select(
        "source", "source_id", "run_id", F.lit(None).cast("array<double>").alias("problem_vec"), F.lit(None).cast("array<double>").alias("res_vec"),
        (F.col("price") >= 20000).alias("quality_pass"), F.lit(n).alias("res_word_count"), tier.alias("evidence_tier"),
    )
    merged = sk.upsert_table("ticket_embeddings", shape(OLD, 1, F.lit(4)), shape(NEW, 2, F.col("evidence_tier")))
    return merged.select("source", "source_id", "run_id", "res_word_count", "evidence_tier", "quality_pass")


@query("sink_ticket_coverage", f"SELECT source, source_id, run_id, CASE WHEN {NEW} THEN 'COVERED' ELSE 'PARTIAL' END AS coverage, CASE WHEN {NEW} THEN assigned_group ELSE service_type END AS best_kb_title FROM r_tickets WHERE {OLD} OR {NEW}")
def sink_ticket_coverage(t: Tables):
    x = t.tickets()
    shape = lambda w, c, title: x.where(w).select(
        "source", "source_id", "run_id", F.lit(0.5).alias("max_kb_sim"), F.lit("1").alias("best_kb_id"), F.col(title).alias("best_kb_title"), F.lit(c).alias("coverage")
    )
    m = sk.upsert_table("ticket_coverage", shape(OLD, "PARTIAL", "service_type"), shape(NEW, "COVERED", "assigned_group"))
    return m.select("source", "source_id", "run_id", "coverage", "best_kb_title")


@query("sink_cluster_sweep", f"SELECT run_id, k, inertia + CASE WHEN is_best_k THEN 1 ELSE 0 END AS inertia, silhouette, is_best_k FROM ({SWEPT})")
def sink_cluster_sweep(t: Tables):
    s = swept(t)
    return sk.upsert_table("cluster_sweep", s, s.where("is_best_k").withColumn("inertia", F.col("inertia") + 1))


@query("sink_clusters", "SELECT run_id, cluster_id, CASE WHEN size >= 15 THEN upper(cluster_label) ELSE cluster_label END AS cluster_label, CASE WHEN size >= 15 THEN size + 1 ELSE size END AS size, gap_flag, summary AS top_terms FROM r_clusters WHERE run_id IN (SELECT run_id FROM r_clusters WHERE size >= 15)")
def sink_clusters(t: Tables):
    none = F.lit(None).cast("double")
    c = t.clusters().select(
        "run_id", "cluster_id", "cluster_label", F.col("summary").alias("top_terms"), "size", F.lit(None).cast("array<double>").alias("centroid"),
        "gap_flag", "max_kb_sim", none.alias("pca_x"), none.alias("pca_y"), none.alias("intra_sim"),
    )
    new = c.where("size >= 15").withColumn("cluster_label", F.upper("cluster_label")).withColumn("size", F.col("size") + 1).withColumn("top_terms", F.lit("ignored"))
    return sk.upsert_table("clusters", c, new).select("run_id", "cluster_id", "cluster_label", "size", "gap_flag", "top_terms")


@query("sink_cluster_assignments", f"SELECT run_id, source, source_id, CASE WHEN {NEW} THEN cluster_id + 1000 ELSE cluster_id END AS cluster_id, service_type FROM r_tickets WHERE {OLD} OR {NEW}")
def sink_cluster_assignments(t: Tables):
    cols = ["run_id", "source", "source_id", "cluster_id", "cluster_label", "service_type", "assigned_group", "ticket_number"]
    old = t.tickets().where(OLD).select(*cols)
    new = t.tickets().where(NEW).select(*cols).withColumn("cluster_id", F.col("cluster_id") + 1000)
    return sk.upsert_table("cluster_assignments", old, new).select("run_id", "source", "source_id", "cluster_id", "service_type")


@query("sink_cluster_kb_sim", "SELECT run_id, cluster_id, rank() OVER (PARTITION BY run_id, cluster_id ORDER BY kb_id) - 1 AS kb_idx, substr(title, 1, 300) AS kb_title, round(kb_id / 7, 6) AS similarity FROM (SELECT c.run_id, c.cluster_id, k.kb_id, k.title FROM r_clusters c JOIN r_kb k ON k.kb_id = c.cluster_id)")
def sink_cluster_kb_sim(t: Tables):
    k = t.kb().select(F.col("kb_id").alias("cluster_id"), F.lit(0).alias("kb_idx"), F.col("title").alias("kb_title"), (F.col("kb_id") / 7).alias("sim"))
    rows = t.clusters().select("run_id", "cluster_id").join(k, "cluster_id")
    new = sk.matrix_rows(rows)
    return sk.upsert_table("cluster_kb_sim", new.withColumn("similarity", F.lit(0.0)), new).select("run_id", "cluster_id", F.col("kb_idx").cast("long").alias("kb_idx"), "kb_title", "similarity")


@query("sink_gap_analysis", "SELECT run_id, cluster_id, size, CASE WHEN size >= 15 THEN 'PARTIAL' ELSE gap_flag END AS gap_flag, priority_score FROM r_gaps WHERE run_id IN (SELECT run_id FROM r_gaps WHERE size >= 15)")
def sink_gap_analysis(t: Tables):
    g = t.gaps().select("run_id", "cluster_id", "cluster_label", "size", "gap_flag", "priority_score", "recommendation", "best_kb_title")
    new = g.where("size >= 15").withColumn("gap_flag", F.lit("PARTIAL"))
    return sk.upsert_table("gap_analysis", g, new).select("run_id", "cluster_id", "size", "gap_flag", "priority_score")


@query("sink_kb_utilization", "SELECT run_id, kb_id AS kb_idx, CASE WHEN kb_id < 125 THEN 'ACTIVE' ELSE 'ORPHAN' END AS status, issue AS kb_article_id FROM r_kb")
def sink_kb_utilization(t: Tables):
    k = t.kb().select("run_id", F.col("kb_id").alias("kb_idx"), F.lit("ORPHAN").alias("status"), F.col("issue").alias("kb_article_id"))
    new = k.where("kb_idx < 125").withColumn("status", F.lit("ACTIVE")).withColumn("kb_article_id", F.lit("ignored"))
    return sk.upsert_table("kb_utilization", k, new)


@query("sink_seed_index", f"""SELECT source, source_id, run_id, title, content_md5, vec_sum FROM (
    SELECT 'existing' AS source, k.kb_id::VARCHAR AS source_id, r.run_id, k.title, md5({q.index_content('k.title', 'k.issue', 'k.solution')}) AS content_md5, {q.checksum('k.kb_vec')} AS vec_sum
    FROM r_kb k, (SELECT DISTINCT run_id FROM r_kb) r)""")
def sink_seed_index(t: Tables):
    k = t.kb().withColumnRenamed("kb_id", "id")
    e = sk.existing_entries(k, k.select("run_id"))
    return e.select("source", "source_id", "run_id", "title", F.md5("content").alias("content_md5"), checksum("embedding").alias("vec_sum"))


@query("sink_replace_articles", "SELECT 'article' AS kind, run_id, article_id FROM r_articles WHERE run_id IN ('fr', 'es') OR quality = 1 UNION ALL SELECT 'result', run_id, article_id FROM r_articles WHERE run_id IN ('fr', 'es') AND toxic = 1")
def sink_replace_articles(t: Tables):
    """Runs en and de are written again with their good drafts only."""
    a = t.articles().select("run_id", "article_id", "title", "quality", "toxic")
    fresh = a.where("run_id IN ('en', 'de') AND quality = 1")
    kept, results = sk.replace_articles(a, a.where("toxic = 1"), fresh)
    return kept.select(F.lit("article").alias("kind"), "run_id", "article_id").unionByName(
        results.select(F.lit("result").alias("kind"), "run_id", "article_id")
    )


@query("sink_replace_generated", f"""SELECT run_id, source, source_id, md5(content) AS content_md5 FROM r_index WHERE source = 'existing' UNION ALL
    SELECT run_id, 'generated', cluster_id::VARCHAR, md5({q.index_content('problem_statement', "array_to_string(resolution_steps, ' ')")}) FROM r_articles WHERE article_embedding IS NOT NULL""")
def sink_replace_generated(t: Tables):
    r = sk.replace_generated(t.search_index(), t.articles())
    return r.select("run_id", "source", "source_id", F.md5("content").alias("content_md5"))


@query("sink_reindex_counts", """SELECT run_id, count(*) AS total, any_value(coalesce(d.n, 0)) AS deleted, count(article_embedding) AS inserted FROM r_articles
    LEFT JOIN (SELECT run_id, count(*) AS n FROM r_index WHERE source = 'generated' GROUP BY ALL) d USING (run_id) GROUP BY run_id""")
def sink_reindex_counts(t: Tables):
    return sk.reindex_counts(t.search_index(), t.articles())


@query("sink_replace_metrics", "SELECT run_id, category, metric FROM (SELECT lang AS run_id, source AS category, 'old' AS metric FROM documents WHERE NOT (lang = 'en' AND source = 'src1') UNION ALL SELECT DISTINCT lang, 'src1', 'new' FROM documents WHERE lang = 'en')")
def sink_replace_metrics(t: Tables):
    d = t.raw("documents")
    old = d.select(F.col("lang").alias("run_id"), F.col("source").alias("category"), F.lit("old").alias("metric"))
    new = d.where("lang = 'en'").select(F.col("lang").alias("run_id"), F.lit("src1").alias("category"), F.lit("new").alias("metric")).distinct()
    return sk.replace_metrics(old, new, "src1")


@query("sink_purge_run", "SELECT 'cluster_assignments' AS tbl, run_id, count(*) AS n FROM r_assign WHERE run_id <> '1998' GROUP BY ALL UNION ALL SELECT 'clusters', run_id, count(*) FROM r_clusters WHERE run_id <> '1998' GROUP BY ALL")
def sink_purge_run(t: Tables):
    left = sk.purge_run({"clusters": t.clusters(), "cluster_assignments": t.assignments()}, "1998", sk.CLUSTER_STEP_TABLES)
    parts = [df.groupBy(F.lit(n).alias("tbl"), "run_id").agg(F.count("*").alias("n")) for n, df in left.items()]
    return parts[0].unionByName(parts[1])


@query("sink_delete_run", """SELECT 'pipeline_runs' AS tbl, run_id, count(*) AS n FROM r_runs WHERE run_id <> '1998' GROUP BY ALL UNION ALL SELECT 'gap_analysis', run_id, count(*) FROM r_gaps WHERE run_id <> '1998' GROUP BY ALL
    UNION ALL SELECT 'cluster_assignments', run_id, count(*) FROM r_assign WHERE run_id <> '1998' GROUP BY ALL UNION ALL SELECT 'removed', '1998', count(*) FROM r_runs WHERE run_id = '1998'""")
def sink_delete_run(t: Tables):
    ledger, left, removed = sk.delete_run(t.runs(), {"gap_analysis": t.gaps(), "cluster_assignments": t.assignments()}, "1998")
    count = lambda n, df: df.groupBy(F.lit(n).alias("tbl"), "run_id").agg(F.count("*").alias("n"))
    out = count("pipeline_runs", ledger)
    for n, df in left.items():
        out = out.unionByName(count(n, df))
    return out.unionByName(removed.select(F.lit("removed").alias("tbl"), F.lit("1998").alias("run_id"), F.col("removed").alias("n")))


@query("sink_patch_articles", """SELECT run_id, cluster_id, CASE WHEN toxic = 1 THEN 'Fixed' ELSE title END AS title, CASE WHEN quality = 0 THEN 'note' ELSE additional_notes END AS additional_notes,
    toxic = 1 OR quality = 0 AS patched FROM r_articles""")
def sink_patch_articles(t: Tables):
    a = t.articles()
    patches = a.select("run_id", "cluster_id", F.when(F.col("toxic") == 1, "Fixed").alias("title"), F.when(F.col("quality") == 0, "note").alias("additional_notes"))
    return sk.patch_articles(a, patches, ["title", "additional_notes"]).select("run_id", "cluster_id", "title", "additional_notes", "patched")


@query("sink_flag_for_review", f"SELECT article_id, quality_score < 10 OR article_id IN (SELECT article_id FROM ({VALIDATION}) WHERE validation_status IN ('PARTIAL', 'FAIL')) AS needs_review FROM ({STORED})")
def sink_flag_for_review(t: Tables):
    from gapscope.plans.validation import to_review

    return sk.flag_for_review(stored_articles(t), to_review(validated(t))).select("article_id", "needs_review")


@query("sink_validation_rows", f"SELECT run_id, article_id, validation_status FROM ({VALIDATION}) UNION ALL SELECT 'old', article_id, 'FAIL' FROM r_articles WHERE toxic = 1")
def sink_validation_rows(t: Tables):
    """Results of the validated runs replaced; those of another run stay."""
    fresh = validated(t).select("run_id", "article_id", "validation_status")
    bad = t.articles().where("toxic = 1")
    other = bad.select(F.lit("old").alias("run_id"), "article_id", F.lit("FAIL").alias("validation_status"))
    stale = bad.select("run_id", "article_id", F.lit("FAIL").alias("validation_status"))
    hit = F.col("run_id").isin("en", "fr", "de", "es")
    return sk.replace_rows(other.unionByName(stale), fresh, hit)

