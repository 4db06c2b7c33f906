"""BPE, packing, language, line labelling and main text on small inputs and against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscope.llm import bpe, htmltext, langid, packing, quality
from gapscope.llm.queries import vocabulary

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])
ODD = [
    "", "  \n\t ", "'S don't we'll", "İstanbul ΑΣ ΣΑΣ", "<|endoftext|>x<|startoftext|> <|EndOfText|>", "a\x1cb \x85 c　d é é ́x", "½ ² ٣ 123abc x_y __ a--b!!",
    "日本語テスト ﬁ ẞ", "x" * 700, "abc " * 400, "​ zero﻿", "👩‍👩‍👧 🇩🇪", "\x00 \x7f", "Ǆ ǆ", "ab" * 3000,
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def prose():
    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")


def test_bpe_is_the_library(spark, library, prose):
    texts = [*ODD, *prose["text"].head(60), None, *ODD[:3]]
    rows = documents(spark, texts).select("doc_id", bpe.digests(F.col("text"), vocabulary()).alias("d"), bpe.ids(F.col("text"), vocabulary()).alias("ids")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.d.n_tokens == len(ids), texts[r.doc_id]
        assert r.d.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.d.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_words_merge_as_short_ones():
    one = bpe.WordBpe(vocabulary())
    rng = random.Random(1)
    for _ in range(50):
        word = "".join(rng.choice("thean") for _ in range(rng.randint(2, 60)))
        data = word.encode()
        parts = [one.inner[b] for b in data[:-1]] + [one.last[data[-1]]]
        assert one.long_word(parts) == one.word(word)


def test_decoded_column(spark):
    df = documents(spark, ["the cat", None]).select("doc_id", bpe.decoded(bpe.ids(F.col("text"), vocabulary()), vocabulary()).alias("t"))
    assert {r.doc_id: r.t for r in df.collect()} == {0: "the</w> cat</w>", 1: ""}


def test_packing_keeps_every_piece(spark, library):
    rng = random.Random(2)
    texts = [" ".join("the" for _ in range(n)) for n in [*(rng.randint(0, 30) for _ in range(80)), 130, 200, 63, 64, 65, 64]] + [None, "", "the"]
    capacity = 64
    rows = packing.pack(documents(spark, texts), vocabulary(), capacity).collect()
    pieces: dict[int, list] = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length == min(capacity, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r.length for r in rows) // capacity) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_rank_once(seed):
    rng = random.Random(seed)
    capacity = 60
    counts = Counter(rng.choice([rng.randint(1, 60), rng.randint(20, 40), 60]) for _ in range(400))
    placed, bins = Counter(), {}
    for length, first, number, start, offset in packing.plan(counts, capacity):
        for k in range(number):
            placed[length, first + k] += 1
            bins.setdefault(start + k, []).append((offset, length))
    assert placed == Counter({(n, k): 1 for n, c in counts.items() for k in range(c)})
    for held in bins.values():
        assert sum(n for _, n in held) <= capacity and sum(3 * n > capacity for _, n in held) <= 2
        assert sorted(held)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:]))
    assert len(bins) <= -(-sum(n * c for n, c in counts.items()) // capacity) * 1.1 + 2


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), vocabulary()).count() == 0


def word_grams(text, longest):
    import re

    def packed(gram):
        code = 0
        for c in gram:
            code = code << 16 | (1 if c == "_" else ord(c) & 0xFFFF)
        return code - (1 << 64) if code >> 63 else code

    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    return Counter(
        packed(g) for w in words if w for n in range(1, longest + 1) for i in range(len(w) + 3 - n) if re.search("[^_]", g := f"_{w}_"[i : i + n])
    )


def ranked(text, size, longest):
    grams = word_grams(text, longest)
    out = {}
    for g, n in grams.items():
        above, equal = sum(v > n for v in grams.values()), sum(v == n for v in grams.values())
        if above + (equal - 1) / 2 < size:
            out[g] = above + (equal - 1) / 2
    return out


def test_language_is_the_brute_force(spark, prose):
    size, longest = 50, 3
    docs = spark.createDataFrame(prose[["doc_id", "text", "lang"]].head(80)).union(spark.createDataFrame([(900, None, "en"), (901, "12 !?", "en"), (902, "the", None), (903, "日本語のテスト 𝒳y", "ja"), (904, "", "en")], "doc_id long, text string, lang string"))
    counts = langid.gram_counts(docs, longest)
    profiles = langid.profiles(counts, size)
    sums: dict[str, Counter] = {}
    for r in docs.collect():
        if r.text and r.lang:
            sums.setdefault(r.lang, Counter()).update(word_grams(r.text, longest))
    for lang, c in sums.items():
        top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]
        n = np.array([x[1] for x in top])
        assert profiles[lang] == {g: (n > v).sum() + ((n == v).sum() - 1) / 2 for g, v in top}
    found = {r.doc_id: r.p for r in docs.select("doc_id", langid.predict(F.col("text"), profiles, size, longest).alias("p")).collect()}
    for r in docs.collect():
        own = ranked(r.text or "", size, longest)
        if not word_grams(r.text or "", longest):
            assert tuple(found[r.doc_id]) == ("und", 0.0)
            continue
        if not own:  # all tie past the profile size
            assert found[r.doc_id].lang_pred in profiles and found[r.doc_id].score == 0.0
            continue
        costs = {k: sum(min(abs(p[g] - rank), size) if g in p else size for g, rank in own.items()) for k, p in profiles.items()}
        best = min(sorted(costs), key=costs.get)
        assert found[r.doc_id].lang_pred == best and found[r.doc_id].score == pytest.approx(1 - costs[best] / (size * len(own)))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = docs.select("lang", langid.held_out(F.col("doc_id")).alias("h"), langid.predict(F.col("text"), langid.learn(docs)).alias("p")).where("h")
    right, n = found.agg(F.sum((F.col("p.lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.98


def test_language_without_lessons(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    assert profiles == {} and docs.select(langid.predict(F.col("text"), profiles)).count() == 0
    assert documents(spark, ["text"]).select(langid.predict(F.col("text"), profiles).alias("p")).first().p.lang_pred == "und"


def test_language_of_a_text_whose_ngrams_all_tie(spark):
    """A text with letters has a learned language: the one that ranks its n-grams highest, with score 0."""
    text = "".join(chr(0x4E00 + k) for k in range(160))
    far = {"en": {g: float(k) for k, g in enumerate(range(1, 20))}, "de": {0x4E05: 250.0}, "fr": {0x4E05: 10.0, 0x4E06: 12.0}}
    for profiles, want in ((far, "fr"), ({k: far[k] for k in ("en", "de")}, "de"), ({"es": far["en"], "en": far["en"]}, "en")):
        found = documents(spark, [text]).select(langid.predict(F.col("text"), profiles).alias("p")).first().p
        assert (found.lang_pred, found.score) == (want, 0.0)


def base_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(*(words[k:] for k in range(5))))
    marked = {i + k for i, w in enumerate(zip(*(words[k:] for k in range(5)))) if windows[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_quality_base_counts(spark, prose):
    texts = [*prose["text"].head(60), *ODD, None, "a b c d e a b c d e", "x\nx\n \nx", "a b c d e f " * 40, "  nbsp  ", "\r\n a\x0bb\x0cc"]
    field = quality.ALL_CONTENT
    for r in documents(spark, texts).select("doc_id", quality.judge(F.col("text"), field).alias("q")).collect():
        n, *rest = base_counts(texts[r.doc_id])
        assert (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words) == (n, *rest), texts[r.doc_id]
        assert r.q.base_failed == (n < 10 or 100 * rest[3] > 20 * n) and r.q.kept == (not r.q.base_failed)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_labelling(seed):
    rng = np.random.default_rng(seed)
    field = quality.Field(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    x = rng.normal(size=(7, quality.FEATURES))

    def score(y):
        return field.start[y[0]] + sum(float(x[t] @ field.weights[:, y[t]]) for t in range(7)) + sum(field.between[y[t], y[t + 1]] for t in range(6))

    best = max(score([m >> t & 1 for t in range(7)]) for m in range(128))
    assert score(field.decode(x).tolist()) == pytest.approx(best)


def test_quality_tells_labelled_documents_apart(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = docs.select("doc_id", quality.judge(F.col("text"), quality.learn(docs, labels)).alias("q")).join(labels, "doc_id").where("not q.base_failed").toPandas()
    kept = judged["q"].map(lambda q: q["kept"])
    assert kept[judged["quality"] == 1].mean() > 0.98 and kept[judged["quality"] == 0].mean() < 0.2


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(documents(spark, ["a b"]), none) is quality.ALL_CONTENT


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><div class=box>{notice}</div><div class=story>{text}</div></body></html>"


def test_repeated_branch_of_a_host_is_cut(spark):
    page = lambda notice, text: PAGE.replace("{notice}", notice).replace("{text}", text)
    rows = [(k, f"http://a.example/{k}", page("All the same here", f"story number {k}")) for k in range(12)]
    rows += [(50, "http://b.example/", page("Only once", "one &amp; two<p>three\n four")), (51, None, None), (52, "nohost", "<p>x"), (52, "nohost", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(df).collect()}
    assert all(found[k][0] == f"story number {k}" for k in range(12))
    assert found[50][0] == "Only once\n\none & two\n\nthree four" and found[51] == ("", 0) and found[52] == ("x", 1)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_equal_articles_of_a_host_stay(spark):
    html = "<body><article><h1>H</h1><p>same text</p></article><footer>f</footer></body>"
    df = spark.createDataFrame([(k, "https://c.example/x", html) for k in range(20)], "page_id long, url string, html string")
    assert {r.text for r in htmltext.extract(df).collect()} == {"H\n\nsame text"}


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><p><b>one<br><p>two &lt;b&gt; &copy;</article>", "one\n\ntwo <b> ©"),
        ("<p>a<script>var t='</p>'</script>b", "ab"),
        ("<!-- <p>no</p> --><p>yes<!-- open", "yes"),
        ("<main><p>x</p><section class='comments'><p>c</p></section></main><p>out", "x"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<p title='a>b'>t</p><p class=\"cookie-bar\">n</p>", "t"),
        ("a < b & c", "a < b & c"),
        ("<article class='post comments-open'><p>x</p></article>", "x"),
        ("<main class='with-sidebar'><p>x</p><div class='sidebar'>s</div></main>", "x"),
        ("<div class='layout has-sidebar'><article><p>x</p></article></div>", "x"),
        ("<p>top</p><div class='layout sidebar-right'><article><p>the long story</p><div class='share'>s</div></article></div>", "the long story"),
        ("<div class='menu'><main id='search'><p>x</p></main></div>", "x"),
        ("<div><p>story</p></div><div class='comments'><article class='comment'>longer than the story</article><article>c</article></div>", "story"),
        ("<article><p>x</p></article><div class='related'><article class='related'>a much longer teaser</article></div>", "x"),
        ("<article class='notice'></article><p>y</p>", "y"),
    ],
)
def test_page_shapes(html, text):
    assert htmltext.main_text(html) == text
