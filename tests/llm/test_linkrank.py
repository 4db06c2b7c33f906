"""Rules and link-graph propagation against brute force and the SQL twin, on pages with links."""

import random
import re
from collections import Counter

import duckdb
import pytest

from gapscope.llm import linkrank

LINKS = ['<a href="http://{}/x">', "<A HREF='//{}'>", "<a href=https://{}?q>", '<a class=u href="/{}">', '<a href="http://{}/x"><a href="http://{}/x">']
URLS = "page_id long, url string, html string, host string, rule string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", after[len(host) :])[0]


def series(seeds, edges, least=linkrank.LEAST):
    """The series in whole units: seeds {host: units}, edges {(a, b): w}."""
    whole = Counter()
    for (a, _), w in edges.items():
        whole[a] += w
    now = {h: s * (100 - linkrank.DAMPING) // 100 for h, s in seeds.items()}
    scores = Counter()
    while now:
        scores.update(now)
        then = Counter()
        for (a, b), w in edges.items():
            if now.get(a, 0) >= least:
                then[b] += now[a] * linkrank.DAMPING * w // (100 * whole[a])
        now = {h: m for h, m in then.items() if m}
    return scores


def brute(pages, rules):
    out, hosts, edges = [], {}, Counter()
    for page, url, html, *_ in pages:
        host, path = split(url)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[2:] if fits else (None, None)
        out.append((page, host, path, rule, verdict))
        if host:
            hosts.setdefault(host, []).append(verdict)
            for b in {m.lower() for m in re.findall(r"""<a href=["']?(?:https?:)?//([^/?#"' >]+)""", html or "", re.I)} - {host}:
                edges[host, b] += 1
    part = lambda v: {h: s.count(v) * linkrank.UNIT // len(s) for h, s in hosts.items() if v in s}
    trust, distrust = series(part("allow"), edges), series(part("block"), {(b, a): w for (a, b), w in edges.items()})
    bad = {h for h in distrust if distrust[h] > trust[h] and distrust[h] >= linkrank.THRESHOLD}
    return [(*r[:4], r[4] or ("block" if r[1] in bad else "allow")) for r in out], bad


def order(rows):
    return sorted(map(str, map(tuple, rows)))


def linked_pages(seed, n=400):
    rng = random.Random(seed)
    hosts = [f"{p}h{k}.{d}" for k in range(12) for p, d in [("www.", "example.com"), ("", "a.net"), ("", "b.org"), ("x.", "c.org")]] + ["net", "com"]
    pages = []
    for k in range(n):
        host = hosts[0] if rng.random() < 0.3 else rng.choice(hosts)  # one host holds a third of the rows
        links = "".join(rng.choice(LINKS).replace("{}", rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)) for _ in range(rng.randrange(4)))
        url = f"http{'s' * rng.randrange(2)}://{host}{rng.choice(['', '/en/1', '/es/2?x=/fr/', '/fr/', '/fr', '#/en/', '/de/3#top', '?u=http://net/es/'])}"
        pages.append((k % 390, url, f"<p>{links}</p>", "clash", "clash"))
    return pages + [(None, None, None, None, None), (1, "no scheme", '<a href="http://net/">', "", ""), (2, "http://", "", "", ""), (3, "HTTP://EXAMPLE.com/en/É", None, "", ""), (3, "HTTP://EXAMPLE.com/en/É", None, "", "")]


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force_and_sql(spark, seed):
    pages = linked_pages(seed)
    df = spark.createDataFrame(pages, URLS)
    got = linkrank.judge(df, linkrank.rule_table(spark, linkrank.RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want, bad = brute(pages, linkrank.RULES)
    assert order(got.collect()) == order(want) and bad
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [p[:3] for p in pages])
    assert order(con.execute(linkrank.SQL).fetchall()) == order(want)


def test_scores_follow_and_oppose_links(spark):
    links = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "c", 5), ("c", "a", 2), ("d", "a", 1)], "a string, b string, w long")
    seeds = spark.createDataFrame([("a", linkrank.UNIT), ("e", 7)], "host string, seed long")
    got = {r.host: r.score for r in linkrank.propagate(seeds, links).collect()}
    edges = {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 5, ("c", "a"): 2, ("d", "a"): 1}
    assert got == dict(series({"a": linkrank.UNIT, "e": 7}, edges))
    # The series is the fixed point of personalised PageRank, to what is not passed on.
    rank = {h: 0.0 for h in "abcd"}
    for _ in range(300):
        rank = {"a": 0.15 + 0.85 * (rank["c"] + rank["d"]), "b": 0.85 * 0.75 * rank["a"], "c": 0.85 * (0.25 * rank["a"] + rank["b"]), "d": 0.0}
    assert all(abs(got.get(h, 0) / linkrank.UNIT - rank[h]) < 2e-3 for h in rank)


def test_rules_of_many_lengths_and_no_rules(spark):
    urls = [("a.b.c", "/x/y/z"), ("b.c", "/x"), ("c", ""), ("zb.c", "/x/y"), (".", "/"), ("a..c", "/x/"), ("." * 50_000 + "b.c", "/x/y/" + "z" * 100_000)]
    rules = [("b.c", "/x", "block"), ("c", "/x/y/z", "allow"), ("c", "", "allow"), ("B.C", "/x", "allow"), ("b.c", "/x/y", "block"), ("c", None, "block"), ("", "/", "block")]
    df = spark.createDataFrame(urls, "host string, path string")
    got = {(r.host, r.path): (r["rule"], r.ruled) for r in linkrank.fitting_rules(df, linkrank.rule_table(spark, rules)).collect()}
    assert got == {urls[0]: ("b.c/x/y", "block"), urls[1]: ("b.c/x", "block"), urls[2]: ("c", "allow"), urls[3]: ("c", "allow"), urls[5]: ("c", "allow"), urls[6]: ("b.c/x/y", "block")}
    none = linkrank.rule_table(spark, rules).limit(0)
    assert linkrank.fitting_rules(df, none).count() == 0
    pages = spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string")
    assert [tuple(r) for r in linkrank.judge(pages, none).collect()] == [(1, "a", "/", None, "allow")]
    assert linkrank.judge(pages.limit(0), linkrank.rule_table(spark, rules)).count() == 0


def test_built_in_functions_only(spark):
    plan = linkrank.judge(spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string").repartition(2), linkrank.rule_table(spark, linkrank.RULES))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
