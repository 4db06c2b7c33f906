"""Archives, vectors, sharding, n-gram join and line dedup on small inputs and against brute force."""

import base64
import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.llm import linededup, ngramjoin, sharding, vectordedup, warc
from gapscope.llm.components import components

# ------------------------------------------------------------------------------------ archives


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_pages_come_back_from_archives(spark):
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "y" * 100_000), (3, "u\r\nv: w", "x"), (4, None, None), (5, "http://a/5", ""), (1 << 60, "http://é/", "x")]
    rows += [(7, "same", "z"), (7, "same", "z"), (None, "none", "x"), (None, "none", "only"), (9, "é 日本", "é\r\n\r\n日本")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    out = warc.round_trip(df.select("page_id", "url", "html")).collect()
    assert len(out) == len(rows)
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[digest(html)] = min(first.get(digest(html), page), page)
    expected = []
    for page, _, html in rows:
        lead = first.get(digest(html))
        kind = ("response", None) if lead in (None, page) else ("revisit", lead)
        expected.append((page, len((html or "").encode()), digest(html), *kind))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out), key=order) == sorted(expected, key=order)
    assert warc.round_trip(df.select("page_id", "url", "html").limit(0)).count() == 0


def test_payloads_and_packages(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k % 3}é") for k in range(40)], "page_id long, url string, html string")
    files = warc.write_packages(warc.with_first(df, least=0).repartition(3), str(tmp_path), max_bytes=2000)
    assert files.count() > 3
    got = {r.page_id: r for r in warc.read_records(warc.index(files, stretch=900), keep_payload=True).collect()}
    assert len(got) == 40 and bytes(got[2].payload).decode() == "<p>2é" and got[5].record_type == "revisit" and got[5].refers_to == 2
    dealt = warc.read_records(warc.index(files, stretch=900), tasks=6)
    assert sorted(r.page_id for r in dealt.collect()) == list(range(40)) and dealt.rdd.getNumPartitions() == 6  # however small the index is
    assert dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
    with zipfile.ZipFile(files.first().path) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED} and warc.ARCHIVE in z.namelist()


def test_reading_tasks_follow_the_archives(spark):
    few = spark.sparkContext.defaultParallelism
    assert warc.reading_tasks(spark, 0) == few and warc.reading_tasks(spark, 1 << 40) == 4096 and warc.reading_tasks(spark, (1 << 40) + 1) == 4097


def test_least_payload_of_a_revisit(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", ""), (4, "d", "")], "page_id long, url string, html string")
    assert {r.page_id: r["first"] for r in warc.with_first(df, least=1).collect()} == {1: 1, 2: 1, 3: None, 4: None}


@pytest.mark.parametrize("limit", [None, 10])
def test_zip_directory(monkeypatch, limit):
    if limit:  # every size and offset above it goes to ZIP64 fields, as in files of many gigabytes
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data, held = io.BytesIO(), {"a.txt": b"one" * 50, "é/b": b"", "c": bytes(range(256))}
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        for name, value in held.items():
            z.writestr(name, value)
        z.writestr(zipfile.ZipInfo("packed"), b"zzz" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    raw = data.getvalue()
    if limit:
        assert warc.END64 in raw
    found = warc.members(lambda at, n: raw[at : at + n], len(raw))
    assert {m.name: raw[m.at : m.at + m.size] for m in found} == held
    with pytest.raises(ValueError):
        warc.members(lambda at, n: raw[at : at + n][::-1], len(raw))


# ------------------------------------------------------------------------------------- vectors


def brute_vectors(rows, least):
    usable = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault((i, label, tuple(x + 0.0 for x in v)), k)
    keys = list(usable)
    unit = [np.array(k[2]) / np.linalg.norm(np.array(k[2])) for k in keys]
    near = [[j for j, b in enumerate(keys) if i != j and a[1] == b[1] and len(a[2]) == len(b[2]) and unit[i] @ unit[j] >= least] for i, a in enumerate(keys)]
    label = {k[0]: k[0] for k in keys}
    for _ in keys:
        for i, js in enumerate(near):
            low = min([label[keys[i][0]], *(label[keys[j][0]] for j in js)])
            for x in (i, *js):
                label[keys[x][0]] = min(label[keys[x][0]], low)
    return {keys[i]: len(js) for i, js in enumerate(near)}, label


@pytest.mark.parametrize("block", [5, 64])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(160):
        base = rng.normal(size=6) if k % 4 else np.ones(6) + rng.normal(size=6) * 0.02
        rows.append((k, [float(x) for x in np.float32(base)], int(k % 3)))
    for k in range(160, 220):  # chains: each links with the next
        a = (k - 160) * 0.15
        rows.append((k, [float(np.float32(np.cos(a))), float(np.float32(np.sin(a))), 0.0, 0.0, 0.0, 0.0], 7))
    rows += [(300 + k, rows[4][1], 1) for k in range(30)] + [(400, None, 1), (401, [0.0] * 6, 1), (402, [float("nan")] * 6, 1), (403, [1.0] * 6, None)]
    rows += [(404, [], 1), (405, [1.0, None, 1, 1, 1, 1], 1), (406, [float("inf")] * 6, 1), (407, [1.0] * 5, 0), (408, [2.0] * 5, 0), (409, [-0.0, 1, 0, 0, 0, 0], 5), (410, [0.0, 1, 0, 0, 0, 0], 5)]
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], c, 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, n_links int")
    n, component = brute_vectors(rows, 0.98)
    n = {k[0]: v for k, v in n.items()}
    out = vectordedup.dedup(df.select("vec_id", "embedding", "label"), 0.98, block).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_links, r.component_id) == (n.get(r.vec_id, 0), component.get(r.vec_id, r.vec_id)), r
        assert r.kept == (r.vec_id == r.component_id)


def test_vectors_without_ids_and_none(spark):
    df = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vectordedup.dedup(df).collect()), key=str) == sorted([(None, 0, None, False)] * 2 + [(1, 0, 1, True)] * 2, key=str)
    assert vectordedup.dedup(df.limit(0)).count() == 0
    assert vectordedup.dedup(df.where("vec_id is null")).count() == 2


def test_whole_balls_are_linked_at_once():
    rng = np.random.default_rng(1)
    points = np.ones((500, 8)) + rng.normal(size=(500, 8)) * 0.001
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = vectordedup.cover_tree(points)
    linked, forest = vectordedup.walk(points, np.ones(500, np.int64), tree, None, 0.98)
    assert (linked == 499).all() and len({forest.root(k) for k in range(500)}) == 1

    def nested(ball):
        for inner in ball.inside:
            assert inner.radius <= ball.radius / 2 + 1e-9
            nested(inner)
        if ball.inside:
            assert sorted(k for b in ball.inside for k in b.rows) == sorted(ball.rows)

    nested(tree)


# ------------------------------------------------------------------------------------ components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200 + k, 200) for k in range(50)] + [(5, 5)]
    label = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in range(len(links)):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label


# -------------------------------------------------------------------------------------- sharding


def test_shards_are_even_and_keep_groups(spark):
    rows = [(k, f"text {k // 4}") for k in range(800)] + [(1000 + k, "hot") for k in range(400)] + [(None, None), (None, None), (5, "text 1"), (5, "text 1"), (6, ""), (7, "é")]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    sizes = sorted(r["size"] for r in out)
    assert sizes == sorted(len((t or "").encode()) + 1 for _, t in rows)
    groups = {}
    for r in out:
        if r.doc_id is not None and r.doc_id < 800:
            groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) < 0.25 * len(groups)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_shards_of_few(spark, n):
    out = sharding.assign(spark.createDataFrame([(k, "t") for k in range(n)], "doc_id long, text string"), 16).collect()
    assert len(out) == n and len({(r.shard, r.slot) for r in out}) == n and all(r.slot == 0 for r in out)


# ----------------------------------------------------------------------------------- n-gram join


def brute_join(rows, width, percent):
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        size = min(width, len(words))
        sets.append((i, {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()))
    label = {i: i for i, _ in rows if i is not None}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and None not in (a, b) and 100 * len(x & y) >= percent * len(x | y)]
    for _ in rows:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return sorted((i, len(s), label.get(i)) for i, s in sets if i is not None), sorted(len(s) for i, s in sets if i is None)


@pytest.mark.parametrize("width,percent,hot", [(3, 90, 1 << 16), (5, 80, 1 << 16), (2, 60, 4)])
def test_join_against_brute_force(spark, monkeypatch, width, percent, hot):
    monkeypatch.setattr(ngramjoin, "HOT_TOKENS", hot)
    monkeypatch.setattr(ngramjoin, "LEAST_WORDS", 4)
    rng = random.Random(width)
    common = [f"c{k}" for k in range(30)]
    rows = []
    for k in range(60):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 90))]
        if k % 3 == 0:
            words = common + words[: rng.randint(0, 12)]
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "one"), (504, "ONE"), (505, "é É"), (506, "É é"), (None, "one"), (None, None), (3, rows[3][1]), (508, "one two"), (509, "a " * 900)]
    rows += [(600 + k, " ".join(common)) for k in range(40)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int")
    out = ngramjoin.join(df, width, percent).collect()
    named, unnamed = brute_join(rows, width, percent)
    assert sorted(tuple(r) for r in out if r.doc_id is not None) == named
    assert sorted(r.n_shingles for r in out if r.doc_id is None) == unnamed and all(r.component_id is None for r in out if r.doc_id is None)


def test_join_of_nothing(spark):
    assert ngramjoin.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in ngramjoin.join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


# ------------------------------------------------------------------------------------ line dedup


def brute_runs(rows, min_words):
    """Word by word: a word goes if a window of enough words around it stood somewhere before."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    seen, out = {}, {}
    for d, r in enumerate(order):
        tokens = re.findall(r"([\x20\x09-\x0D]*)([^\x20\x09-\x0D]+)", r[1])
        words = [w for _, w in tokens]
        dead = set()
        for i in range(len(words) - min_words + 1):
            window = tuple(words[i : i + min_words])
            first = seen.setdefault(window, (d, i))
            if first[0] != d or first[1] + min_words <= i:
                dead.update(range(i, i + min_words))
        text, gone = "", []
        for k, (gap, word) in enumerate(tokens):
            if k in dead:
                gone.append(gap)
                continue
            if gone:
                # Words of different lines stay on different lines.
                broken = [g for g in (gap, gone[0]) if "\n" in g] or ["\n" for g in gone[1:] if "\n" in g] or [gap]
                gap = broken[0] if k > len(gone) else ""
            gone = []
            text += gap + word
        if dead and tokens and len(tokens) - 1 not in dead:
            text += re.search(r"[\x20\x09-\x0D]*\Z", r[1])[0]
        out[r] = text if dead else r[1]
    return out


def worded(text):
    return sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))


@pytest.mark.parametrize("seed,gram", [(0, 3), (1, 7), (2, 12), (3, 1)])
def test_lines_against_brute_force(spark, seed, gram):
    rng = random.Random(seed)
    lines = [" ".join(f"{c}{k}" for k in range(rng.randint(1, 6))) for c in "abcdefghij"] + ["", "  ", "x"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for k in range(25)]
    rows += [(30, rows[0][1]), (31, None), (32, ""), (33, "\n\n"), (None, rows[1][1]), (34, " a0  \n" + lines[0]), (0, rows[0][1]), (35, "x\n" * 50), (2, rows[4][1])]
    # Passages that begin and end within lines, on lines of other lengths, and at the ends of a text.
    passage = [f"p{k}" for k in range(9)]
    rows += [(40, "own words " + " ".join(passage) + " \t the end\t"), (41, "A " + "\n".join(passage) + " B\n"), (42, "\n" + "  ".join(passage[:8]) + "\n\n rest\n"), (43, "new\n\x0b" + "\r\n".join(passage) + "  ")]
    rows += [(44 + k, " ".join(rng.choice(["p1", "q", "q", "é"]) for _ in range(40))) for k in range(6)]
    rows += [(None, "z " + rows[-5][1].replace(" ", "\n", 5)), (60, "one\x1ctwo " * 9)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_lines string")
    out = linededup.dedup(df, 7, gram).collect()
    expected = brute_runs(rows, 7)
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(str((i, None if t is None else expected[i, t])) for i, t in rows)
    assert sorted(map(str, ((r.doc_id, r.n_lines, r.n_deleted, r.changed) for r in out))) == sorted(
        str((i, worded(t), worded(t) - worded(t and expected[i, t]), t is not None and expected[i, t] != t)) for i, t in rows
    )


def test_no_run_of_given_documents_comes_twice(spark):
    """At sf0.1 no document keeps 50 words in a row that an earlier one kept as well; all else stays."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = {(r.doc_id, r.text) for r in linededup.dedup(docs).collect()}
    rows = [tuple(r) for r in docs.collect()]
    expected = brute_runs(rows, 50)
    assert found == {(i, t and expected[i, t]) for i, t in rows}


def test_lines_of_nothing(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = linededup.dedup(spark.createDataFrame([(1, "w " * 60), (2, "w " * 60 + "\nnew")], "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("other")))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "w " * 60, 2: "new"} and "other" in kept.columns


def test_texts_that_share_a_gram_only_are_not_compared(spark, monkeypatch):
    """Windows meet where a half of what surrounds a gram is shared, and then that half only."""
    made, write = [], linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df: made.append(write(df)) or made[-1])

    def compared(rows):
        made.clear()
        out = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        expected = brute_runs(rows, 50)
        assert {(r.doc_id, r.text) for r in out} == {(i, expected[i, t]) for i, t in rows}
        return sum(t.count() for t in made if {"a", "b"} <= set(t.columns) and "print" not in t.columns)

    own = lambda doc, side: " ".join(f"{doc}{side}{k}" for k in range(60))
    common = " ".join(f"same{k}" for k in range(20))
    assert compared([(k, f"{own(k, 'a')} {common} {own(k, 'b')}") for k in range(30)]) == 0
    words = [f"w{k}" for k in range(400)]
    near = " ".join([*words[:200], "other", *words[201:]])
    assert 0 < compared([(1, " ".join(words)), (2, near)]) <= 100


def test_only_groups_on_a_border_are_cut(spark):
    """At sf0.1 at most one group per border; on tiny inputs no more cuts than the best placement needs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    spread = sharding.assign(docs).groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n")).where("n > 1").count()
    assert spread <= 15
    rng = random.Random(6)
    for _ in range(4):
        sizes = [rng.randrange(1, 5) for _ in range(rng.randrange(2, 6))]
        rows = [(100 * g + k, f"t{g}") for g, n in enumerate(sizes) for k in range(n)] + [(None, None)]
        out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
        counts = {}
        for r in out:
            counts.setdefault(r.shard, []).append(r)
        full = sorted((len(rows) + k) // 3 for k in range(3))
        assert sorted(len(counts.get(s, ())) for s in range(3)) == full
        where = {}
        for r in out:
            where.setdefault(r.text_crc32, set()).add(r.shard)
        assert sum(len(s) - 1 for s in where.values()) <= least_cuts(sizes + [1], full) + 2  # a border each at most


def least_cuts(sizes, full):
    """Fewest additional shards that groups need, over all ways to fill shards of the given sizes."""
    from functools import lru_cache

    @lru_cache(None)
    def go(k, room):
        if k == len(sizes):
            return 0
        best = 99
        parts = [(a, b, sizes[k] - a - b) for a in range(sizes[k] + 1) for b in range(sizes[k] - a + 1)]
        for p in parts:
            if all(x <= y for x, y in zip(p, room)):
                best = min(best, sum(x > 0 for x in p) - 1 + go(k + 1, tuple(y - x for x, y in zip(p, room))))
        return best

    return go(0, tuple(full))
