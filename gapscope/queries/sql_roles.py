"""The roles of ``gapscope.queries.roles`` in SQL, and SQL spellings of shared rules."""

from __future__ import annotations

from gapscope.functions import text as rules
from gapscope.queries import roles


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(s: str) -> str:
    """A pattern as an SQL literal."""
    return lit(s)


def strip(c: str) -> str:
    return f"regexp_replace({c}, {rx(rules.EDGE_SPACE)}, '', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {rx(rules.WS + '+')}), lambda w: w <> '')"


def lines(c: str) -> str:
    each = f"list_transform(string_split_regex({c}, {rx(rules.LINE_BREAK)}), lambda s: {strip('s')})"
    return f"list_filter({each}, lambda s: s <> '')"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 9)"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


def mix(a: str, b: str, wa: float, wb: float) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] * {wa} + z[2] * {wb})"


def combine(a: str, b: str, wa: float = 0.4, wb: float = 0.6) -> str:
    return (
        f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} "
        f"ELSE {unit(mix(a, b, wa, wb))} END"
    )


def checksum(v: str) -> str:
    """One number that depends on every element and its place."""
    return f"round(list_sum(list_transform({v}, lambda x, i: x * i)), 6)"


def principal(rows: str, n: int = 2, width: int = 64) -> str:
    """CTEs over ``rows`` (vec): ``p_mean`` (m) and, per axis, ``p_axis1`` .. (axis, variance) by squared powers of the covariance."""
    at = f"range(1, {width + 1})"
    scaled = f"list_transform(s, lambda a: list_transform(a, lambda x: x / list_sum(list_transform({at}, lambda i: s[i][i]))))"
    out = f"""RECURSIVE p_rows AS MATERIALIZED ({rows}),
    p_mean AS MATERIALIZED (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(vec[i]) AS m FROM p_rows, {at} g(i) GROUP BY i)),
    p_flat AS MATERIALIZED (SELECT list_transform({at}, lambda i: vec[i] - m[i]) AS c FROM p_rows, p_mean),
    p_left1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS s FROM (SELECT i, list(x ORDER BY j) AS r FROM (
        SELECT i, j, avg(c[i] * c[j]) AS x FROM p_flat, {at} a(i), {at} b(j) GROUP BY i, j) GROUP BY i))"""
    for k in range(1, n + 1):
        out += f""",
    p_power{k}(n, p) AS (SELECT 0, {scaled} FROM p_left{k} UNION ALL SELECT n + 1, {scaled} FROM (
        SELECT n, list_transform(p, lambda a: list_transform(p, lambda b: list_dot_product(a, b))) AS s FROM p_power{k} WHERE n < 40)),
    p_line{k} AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (
        SELECT p[list_position(d, list_max(d))] AS v FROM (SELECT p, list_transform({at}, lambda i: p[i][i]) AS d FROM p_power{k} WHERE n = 40))),
    p_sure{k} AS (SELECT list_transform(v, lambda x: x * sign(v[list_position(z, list_max(z))])) AS axis FROM (
        SELECT v, list_transform(v, lambda x: round(abs(x), 9)) AS z FROM p_line{k})),
    p_axis{k} AS MATERIALIZED (SELECT axis, list_dot_product(axis, list_transform(s, lambda a: list_dot_product(a, axis))) AS variance FROM p_sure{k}, p_left{k}),
    p_left{k + 1} AS MATERIALIZED (SELECT list_transform({at}, lambda i: list_transform({at}, lambda j: s[i][j] - variance * axis[i] * axis[j])) AS s FROM p_left{k}, p_axis{k})"""
    return out


def gap_class(c: str, covered: float, partial: float, below: str = "CRITICAL") -> str:
    return f"CASE WHEN {c} >= {covered} THEN 'COVERED' WHEN {c} >= {partial} THEN 'PARTIAL' ELSE '{below}' END"


def recommendation(flag: str, label: str, title: str) -> str:
    return f"""CASE {flag}
      WHEN 'CRITICAL' THEN 'GENERATE: Create new KB article — ''' || substr({label}, 1, 40) || ''''
      WHEN 'PARTIAL' THEN 'UPDATE: Expand ''' || substr(coalesce({title}, ''), 1, 45) || ''' to cover ''' || substr({label}, 1, 40) || ''''
      ELSE 'MONITOR: ''' || substr(coalesce({title}, ''), 1, 45) || ''' adequately covers this cluster' END"""


def duplicate_text(target: str, reason: str) -> str:
    return f"'DUPLICATE: Confirmed — same problem as cluster ' || {target} || '. ' || {reason}"


def strip_email(c: str) -> str:
    newest = f"string_split_regex(coalesce({c}, ''), {rx(rules.SEPARATOR)})[1]"
    noise = " OR ".join(f"regexp_matches(s, {rx(p)})" for p in rules.NOISE_LINES)
    return f"coalesce(array_to_string(list_filter({lines(newest)}, lambda s: NOT ({noise})), ' '), '')"


def boilerplate(c: str) -> str:
    groups = [
        "(" + " AND ".join(f"contains(lower({c}), {lit(p)})" for p in group) + ")"
        for group in rules.BOILERPLATE_SIGNATURES
    ]
    return "(" + " OR ".join(groups) + ")"


def generic_subject(c: str) -> str:
    return f"(len({words(strip(f'coalesce({c}, {lit(str())})'))}) < 2 OR regexp_matches({strip(f'coalesce({c}, {lit(str())})')}, {rx(rules.GENERIC_SUBJECT)}))"


def email_dominated(c: str, share: float) -> str:
    return (
        f"(len({lines(c)}) >= 3 AND len(list_filter({lines(c)}, lambda s: regexp_matches(s, {rx(rules.HEADER_LINE)})))"
        f" / len({lines(c)}) > {share})"
    )


def tier(c: str) -> str:
    size = "length(" + strip(f"replace({c}, '***', '')") + ")"
    return (
        f"CASE WHEN coalesce({c}, '') = '' THEN 4 WHEN starts_with({c}, '[$$') THEN 1 "
        f"WHEN {size} > 150 THEN 2 WHEN {size} > 50 THEN 3 ELSE 4 END"
    )


def sanitise(c: str) -> str:
    parts = f"list_filter(list_transform(string_split({c}, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')"
    redacted = f"len(list_filter({words('s')}, lambda w: regexp_matches(w, {rx(rules.REDACTED_TOKEN)})))"
    drop = (
        f"regexp_matches(s, {rx(rules.personal_line())}) OR {redacted} / len({words('s')}) > 0.5 "
        f"OR starts_with(s, '{{') OR starts_with(s, '\"error\"') OR regexp_matches(s, {rx(rules.ERROR_CODE_LINE)})"
    )
    masked = f"regexp_replace(s, {rx(rules.MAIL_ADDRESS)}, '[email]', 'g')"
    masked = f"regexp_replace({masked}, {rx(rules.PHONE_NUMBER)}, '[phone]', 'g')"
    masked = f"regexp_replace({masked}, {rx(rules.ID_NUMBER)}, '[id]', 'g')"
    kept = f"list_filter({parts}, lambda s: NOT ({drop}))"
    return f"coalesce(array_to_string(list_transform({kept}, lambda s: {masked}), ' '), '')"


def normalise_terms(c: str) -> str:
    out = f"replace(lower(coalesce({c}, '')), '***', ' ')"
    for term in sorted(rules.TERM_REPLACEMENTS, key=lambda t: -len(t)):
        out = f"replace({out}, {lit(term)}, {lit(rules.TERM_REPLACEMENTS[term])})"
    return out


def index_content(*parts: str) -> str:
    joined = " || ' ' || ".join(f"coalesce({p}, '')" for p in parts)
    return f"substr({strip(joined)}, 1, 500)"


_segments = "[" + ", ".join(lit(s) for s in roles.SEGMENTS) + "]"

ROLES: dict[str, str] = {
    "r_vec": "SELECT vec_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings",
    "r_kb": """
SELECT d.doc_id AS kb_id, split_part(d.text, chr(10), 1) AS title, d.lang || ' ' || d.source AS issue,
       d.text AS solution, v.vec AS kb_vec, d.lang AS run_id
FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 JOIN r_vec v ON v.vec_id = d.doc_id""",
    "r_own": "SELECT * FROM r_vec WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "r_tv": """
SELECT o.vec_id AS ticket_id, CASE WHEN d.lang = 'en' THEN 'incident' ELSE 'workorder' END AS source,
       o.label AS cluster_id, o.vec AS problem_vec, n.vec AS res_vec
FROM r_own o LEFT JOIN r_own n ON n.vec_id = o.vec_id + 1 LEFT JOIN documents d ON d.doc_id = o.vec_id""",
    "r_sides": f"""
SELECT ticket_id, source, cluster_id,
       CASE WHEN res_vec IS NULL THEN problem_vec ELSE {unit(mix('problem_vec', 'res_vec', 0.5, 0.5))} END AS mixed,
       coalesce(res_vec, problem_vec) AS answer
FROM r_tv""",
    "r_tickets": f"""
SELECT year(o_orderdate)::VARCHAR AS run_id,
       CASE WHEN o_orderstatus = 'P' THEN 'workorder' ELSE 'incident' END AS source,
       o_orderkey::VARCHAR AS source_id,
       c_nationkey::BIGINT * 5 + list_position({_segments}, c_mktsegment) - 1 AS cluster_id,
       n_name || ' / ' || c_mktsegment AS cluster_label,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' ELSE o_orderpriority END AS service_type,
       n_name AS assigned_group, 'T' || o_orderkey AS ticket_number, o_orderdate AS reported_date,
       CASE WHEN o_totalprice < 20000 THEN NULL WHEN o_totalprice >= 375000 THEN 1
            WHEN o_totalprice >= 250000 THEN 2 WHEN o_totalprice >= 125000 THEN 3 ELSE 4 END AS evidence_tier,
       o_totalprice AS price, o_orderkey, o_custkey, c_nationkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "r_assign": """
SELECT run_id, source, source_id, cluster_id, cluster_label, service_type, assigned_group, ticket_number
FROM r_tickets""",
    "r_rows": "SELECT run_id, source, source_id, evidence_tier, price >= 20000 AS quality_pass FROM r_tickets",
    "r_source": """
SELECT t.source, t.source_id AS id, t.ticket_number, t.service_type, t.assigned_group, t.reported_date,
       t.service_type || ' ' || t.assigned_group AS description, d.text AS detailed_description, a.text AS answer
FROM r_tickets t LEFT JOIN documents d ON d.doc_id = t.o_orderkey LEFT JOIN documents a ON a.doc_id = t.o_custkey""",
    "r_unified": """
SELECT source, id AS source_id, ticket_number, service_type, assigned_group,
       coalesce(detailed_description, description, '') AS problem_text, answer AS resolution_text
FROM r_source""",
    "r_sized": """
SELECT run_id, cluster_id, cluster_label, c_nationkey, count(*) AS size,
       round(avg(price) / 500000, 4) AS max_kb_sim
FROM r_tickets GROUP BY ALL""",
    "r_placed": """
SELECT *, row_number() OVER w AS place, first_value(cluster_id) OVER w AS first
FROM r_sized WINDOW w AS (PARTITION BY run_id, c_nationkey ORDER BY size DESC, cluster_id)""",
    "r_clusters": f"""
SELECT run_id, cluster_id, cluster_label, size, max_kb_sim,
       CASE WHEN place = 5 THEN 'DUPLICATE'
            ELSE {gap_class('max_kb_sim', roles.SIZE_COVERED, roles.SIZE_PARTIAL)} END AS gap_flag,
       CASE WHEN place = 5 THEN first END AS merged_into,
       CASE WHEN place <= 3 THEN cluster_label || ' summary' ELSE '' END AS summary
FROM r_placed""",
    "r_gaps": f"""
SELECT c.*, round(c.size / max(c.size) OVER (PARTITION BY c.run_id), 4) AS priority_score,
       k.kb_id AS best_kb_id, k.title AS best_kb_title,
       CASE WHEN c.gap_flag = 'DUPLICATE' THEN {duplicate_text('c.merged_into', "'same'")}
            ELSE {recommendation('c.gap_flag', 'c.cluster_label', 'k.title')} END AS recommendation
FROM r_clusters c LEFT JOIN r_kb k ON k.kb_id = c.cluster_id""",
    "r_runs": """
SELECT year(o_orderdate)::VARCHAR AS run_id, min(o_orderdate) AS started_at,
       CASE WHEN max(o_orderdate) < make_date(year(o_orderdate)::INT, 12, 31) THEN 'running'
            WHEN min(o_orderdate) > make_date(year(o_orderdate)::INT, 1, 1) THEN 'failed' ELSE 'complete' END AS status
FROM orders GROUP BY year(o_orderdate)""",
    "r_mails": """
SELECT conv_id || '-' || turn AS id, conv_id, turn, role, text,
       'From: ' || role || chr(10) || 'Subject: Case ' || conv_id || chr(10)
       || CASE WHEN role = 'system' THEN 'Please see related REQ for any additional information' || chr(10) ELSE '' END
       || text || chr(10) || '*** ***' || chr(10) || 'G0000' || conv_id || ' call 202-555-0' || lpad(conv_id::VARCHAR, 3, '0')
       || chr(10) || 'On the day after the user wrote:' || chr(10) || '> ' || role || chr(10)
       || 'Sent from my phone' || chr(10) || '-----Original message-----' || chr(10) || text AS mail
FROM conversations""",
    "r_texts": """
SELECT 'd' || doc_id AS text_id, text FROM documents UNION ALL
SELECT 'p' || page_id, html FROM pages UNION ALL
SELECT 'b' || item_id, text FROM benchmark UNION ALL
SELECT 'm' || id, mail FROM r_mails""",
    "r_inc": """
SELECT d.doc_id::VARCHAR AS id, split_part(d.text, chr(10), 1) AS description, d.text AS detailed_description,
       n.text AS resolution_summary, v0.vec AS e_description, v1.vec AS e_detailed_description,
       v2.vec AS e_resolution_summary
FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
LEFT JOIN r_vec v0 ON v0.vec_id = d.doc_id LEFT JOIN r_vec v1 ON v1.vec_id = d.doc_id + 1
LEFT JOIN r_vec v2 ON v2.vec_id = d.doc_id + 2""",
    "r_wo": """
SELECT m.id, m.mail AS detailed_description, m.text AS activity_logs_text,
       v0.vec AS e_description, v1.vec AS e_activity_logs, v2.vec AS e_clean
FROM r_mails m LEFT JOIN r_vec v0 ON v0.vec_id = m.conv_id
LEFT JOIN r_vec v1 ON v1.vec_id = m.conv_id + m.turn LEFT JOIN r_vec v2 ON v2.vec_id = m.conv_id + 2 * m.turn""",
    "r_articles": """
SELECT d.lang AS run_id, 'A' || d.doc_id AS article_id, d.doc_id AS cluster_id,
       split_part(d.text, chr(10), 1) AS title, d.source AS category, d.text AS problem_statement,
       list_filter(string_split(d.text, chr(10)), lambda s: s <> '') AS resolution_steps,
       CASE WHEN l.toxic = 1 THEN '' ELSE 'Escalate to ' || d.source END AS escalation_trigger,
       CASE WHEN l.quality = 1 THEN 0.9 ELSE 0.5 END AS confidence,
       CASE WHEN l.toxic = 0 THEN 'See ' || d.source || ' --- • desk ' || d.lang || ' • Need more help? •' END AS additional_notes,
       CASE WHEN l.quality = 1 THEN 'CRITICAL' ELSE 'PARTIAL' END AS gap_flag,
       v.vec AS article_embedding, v.label AS article_label, l.quality, l.toxic
FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN r_vec v ON v.vec_id = d.doc_id""",
    "r_index": f"""
SELECT run_id, 'existing' AS source, kb_id::VARCHAR AS source_id, title, '' AS category,
       {index_content('title', 'issue', 'solution')} AS content, kb_vec AS embedding, false AS is_generated
FROM r_kb UNION ALL
SELECT run_id, 'generated', cluster_id::VARCHAR, title, category,
       {index_content('problem_statement', "array_to_string(resolution_steps, ' ')")}, article_embedding, true
FROM r_articles WHERE quality = 0 AND article_embedding IS NOT NULL""",
    "r_questions": """
SELECT c.conv_id, c.question, c.turn, v.vec AS query_vec, d.lang AS run_id
FROM (SELECT conv_id, arg_max(text, turn) AS question, max(turn) AS turn FROM conversations
      WHERE role = 'user' GROUP BY conv_id) c
JOIN r_vec v ON v.vec_id = c.conv_id JOIN documents d ON d.doc_id = c.conv_id""",
}
