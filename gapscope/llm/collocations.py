"""Phrase collocation mining on a weighted de Bruijn graph of words.

Texts are cut into pieces at sentence and line marks, pieces into words. Every place in a piece
gives one row: the longest gram that starts there, ``LONGEST`` words or what is left of the piece.
Grams of full length are the edges of a de Bruijn graph, from the node of their first words to the
node of their last ones; the shorter ones are the ends of pieces. Equal rows are counted, in each
task first, and that is the only table of the size of the corpus.

All other counts come from the graph. What flows out of a node, plus the pieces that end in it,
is how often the node's words occur; the nodes with the same first words sum up to the next
shorter count, again with the ends of pieces. A frequent node through which all of its count
flows, from one edge into one edge, is the inside of a unary path: paths are compacted by pointer
doubling, each edge gets its path and place, and such a node is never a phrase of its own, since a
longer one holds it every time. What remains are edges, branching nodes and shorter phrases.

*Less to count, same counts.* A phrase is as rare as its rarest word or pair of words. Words are
counted first, then pairs of frequent words; a place whose word or next pair is too rare ends a
piece. No frequent phrase holds such a place, and every word still has its row, so all counts of
frequent phrases are the same. The frequent words and pairs are sent to all tasks if they are
measured to take at most ``SENT_BYTES``; beyond it places are not cut there, with the same result.

Null texts are empty, null languages are ``und``, repeated rows count again; texts without words,
empty tables and languages without frequent phrases give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.llm.common import cut, drop_table, in_small_batches

LONGEST, LEAST, COVERED, MOST = 4, 30, 80, 2000
#: Scores are whole numbers: twice the count per sum of its parts' counts, in millionths.
SCALE = 2_000_000
#: Frequent words, and frequent pairs, that are sent to all tasks take this many bytes at most.
SENT_BYTES = 64 << 20
SLICE_BYTES = 1 << 20
#: Bytes that part words within a piece, and that end a piece.
GAPS, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"

KINDS = np.zeros(256, np.uint8)
KINDS[list(GAPS)] = 1
KINDS[list(ENDS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# --------------------------------------------------------------------------------------- words


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of stretches of a batch; more than ``size`` bytes only for a single text."""
    langs = pc.fill_null(batch.column("lang").cast(pa.string()), "und")
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    for lang in pc.unique(langs).to_pylist():
        some = texts.filter(pc.equal(langs, lang))
        ends = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(some):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield lang, some.slice(at, to - at)
            at = to


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in turn, and whether it is in one piece with the next one."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    kinds = KINDS[raw]
    inside = kinds == 0
    text_start = np.zeros(len(raw) + 1, bool)
    text_start[offsets - offsets[0]] = True
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    torn = np.zeros(len(raw) + 1, bool)  # two texts that meet within a word
    torn[1:-1] = text_start[1:-1] & inside[1:] & inside[:-1]
    first, last = np.flatnonzero((edge == 1) | torn), np.flatnonzero((edge == -1) | torn)
    piece = np.cumsum((kinds == 2) | text_start[:-1])[first] if len(first) else first
    lengths = np.concatenate(([0], np.cumsum(last - first))).astype(np.int64)
    plain = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(lengths), pa.py_buffer(raw[inside])]).dictionary_encode()
    near = np.zeros(len(first), bool)
    near[:-1] = piece[1:] == piece[:-1]
    return plain.dictionary, plain.indices.to_numpy(), near


def rows(lang: str, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    langs = pa.DictionaryArray.from_arrays(np.zeros(n, np.int8), [lang]).cast(pa.string())
    return pa.RecordBatch.from_pydict({"lang": langs} | columns)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in slices(batch):
                distinct, ids, _ = words(texts)
                yield rows(lang, word=distinct.cast(pa.string()), n=pa.array(np.bincount(ids, minlength=len(distinct))))

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Frequent:
    """What may be in a frequent phrase, as far as it could be sent: words by language, pairs of their numbers."""

    def __init__(self, words: dict[str, pa.Array] | None, pairs: dict[str, np.ndarray] | None = None):
        self.words, self.pairs = words, pairs

    def numbers(self, lang: str, distinct: pa.Array) -> np.ndarray:
        """Number of each distinct word, -1 for a rare one; all are numbered alike where words were not sent."""
        if self.words is None:
            return np.zeros(len(distinct), np.int64)
        known = self.words.get(lang)
        if known is None:
            return np.full(len(distinct), -1)
        return pc.fill_null(pc.index_in(distinct, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def pair_keys(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """A number for each word and the one after it."""
        return ids[:-1] * len(self.words[lang]) + ids[1:]

    def near(self, lang: str, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Where a frequent phrase may go on from a word to the next one."""
        near = near & (ids >= 0)
        near[:-1] &= ids[1:] >= 0
        if self.pairs is not None and near.any():
            at = np.flatnonzero(near)
            known, asked = self.pairs.get(lang, np.empty(0, np.int64)), self.pair_keys(lang, ids)[at]
            found = np.searchsorted(known, asked)
            near[at] = (found < len(known)) & (known[np.minimum(found, len(known) - 1)] == asked) if len(known) else False
        return near


def sent_words(counts: DataFrame, least: int, most_bytes: int) -> Frequent:
    frequent = counts.where(F.col("n") >= least)
    if (frequent.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0) > most_bytes:
        return Frequent(None)
    table = frequent.select("lang", "word").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    langs, known = table.column("lang").combine_chunks(), table.column("word").combine_chunks().cast(pa.large_string())
    return Frequent({lang: known.filter(pc.equal(langs, lang)) for lang in pc.unique(langs).to_pylist()})


def sent_pairs(docs: DataFrame, known: Frequent, least: int, most_bytes: int) -> Frequent:
    """``known`` with the frequent pairs of frequent words."""
    if known.words is None:
        return known
    held = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in slices(batch):
                distinct, ids, near = words(texts)
                ids = held.value.numbers(lang, distinct)[ids]
                at = np.flatnonzero(held.value.near(lang, ids, near))
                if len(at):
                    pair, n = np.unique(held.value.pair_keys(lang, ids)[at], return_counts=True)
                    yield rows(lang, pair=pa.array(pair), n=pa.array(n))

    pairs = docs.select("lang", "text").mapInArrow(count, "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = cut(pairs.select("lang", "pair"))
    sent = Frequent(known.words)
    if pairs.count() * 8 <= most_bytes:
        table = pairs.toArrow()
        langs, keys = table.column("lang").combine_chunks(), table.column("pair").combine_chunks()
        sent.pairs = {lang: np.sort(keys.filter(pc.equal(langs, lang)).to_numpy()) for lang in pc.unique(langs).to_pylist()}
    drop_table(docs.sparkSession, pairs)
    return sent


# --------------------------------------------------------------------------------------- graph


def longest_grams(docs: DataFrame, known: Frequent, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, size, n): how often each gram is the longest one that starts at a place."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in slices(batch):
                distinct, ids, near = words(texts)
                numbers = held.value.numbers(lang, distinct)[ids]
                near = held.value.near(lang, numbers, near)
                alone = np.bincount(ids[(numbers >= 0) & ~near], minlength=len(distinct))
                at = np.flatnonzero(alone)
                yield rows(lang, gram=distinct.take(pa.array(at)).cast(pa.string()), size=pa.array(np.ones(len(at), np.int32)), n=pa.array(alone[at]))
                at = np.flatnonzero(near)
                sizes, parts, more = np.full(len(at), 2, np.int32), [pa.array(ids[at]), pa.array(ids[at + 1])], near[at]
                for k in range(2, longest):
                    more = more & near[np.minimum(at + k - 1, len(near) - 1)]
                    sizes += more
                    parts.append(pa.array(ids[np.minimum(at + k, len(ids) - 1)], mask=~more))
                grams = pc.binary_join_element_wise(*(distinct.take(p).cast(pa.string()) for p in parts), " ", null_handling="skip")
                yield rows(lang, gram=grams, size=pa.array(sizes), n=pa.array(np.ones(len(at), np.int64)))

    found = docs.select("lang", "text").mapInArrow(count, "lang string, gram string, size int, n long")
    return found.groupBy("lang", "gram", "size").agg(F.sum("n").alias("n"))


def first_words(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def last_words(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", -n)


def counts(grams: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, a) of all phrases of 1 to ``longest`` words that occur ``least`` times or more.

    Size by size: the flow out of the nodes, which the sums of the next longer phrases are, and the ends of pieces.
    """
    spark = grams.sparkSession
    sums = grams.where(F.col("size") == longest).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    frequent = [sums.where(F.col("a") >= least).withColumn("size", F.lit(longest))]
    held = []
    for size in range(longest - 1, 0, -1):
        flow = sums.select("lang", first_words(F.col("phrase"), size).alias("phrase"), "a")
        ends = grams.where(F.col("size") == size).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
        sums = cut(flow.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("a").alias("a")))
        held.append(sums)
        frequent.append(sums.where(F.col("a") >= least).withColumn("size", F.lit(size)))
    out = frequent[0]
    for part in frequent[1:]:
        out = out.unionByName(part)
    out = cut(out.select("lang", "phrase", "size", "a"))
    drop_table(spark, *held)
    return out


def paths(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, edge, path, place, a) of all frequent edges: the first edge of their unary path and how far they are from it.

    A path runs on through a node when one edge brings, and one edge takes, all of its count.
    Some piece begins on every walk, so no path is a ring, and doubling pointers ends.
    """
    spark = phrases.sparkSession
    edges = phrases.where(F.col("size") == longest).select("lang", F.col("phrase").alias("edge"), "a")
    nodes = phrases.where(F.col("size") == longest - 1).select("lang", F.col("phrase").alias("node"), F.col("a").alias("whole"))
    out = edges.withColumn("node", first_words(F.col("edge"), longest - 1)).join(nodes, ["lang", "node"]).where("a = whole").select("lang", "node", "edge")
    into = edges.withColumn("node", last_words(F.col("edge"), longest - 1)).join(nodes, ["lang", "node"]).where("a = whole").select("lang", "node", F.col("edge").alias("before"))
    step = out.join(into, ["lang", "node"]).select("lang", "edge", "before")
    now = cut(edges.join(step, ["lang", "edge"], "left").select("lang", "edge", "a", F.coalesce("before", "edge").alias("path"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("long").alias("place")))
    while True:
        heads = now.select("lang", F.col("edge").alias("path"), F.col("path").alias("up"), F.col("place").alias("more")).where("more > 0")
        jumped = cut(now.join(heads, ["lang", "path"], "left").select("lang", "edge", "a", F.coalesce("up", "path").alias("path"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("up").isNotNull().alias("moved")))
        drop_table(spark, now)
        now = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return now


def inner_nodes(paths_: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase): the nodes that unary paths run through."""
    return paths_.where("place > 0").select("lang", first_words(F.col("edge"), longest - 1).alias("phrase"))


# ---------------------------------------------------------------------------------------- rank


def exact(column: str, digits: int = 20) -> Column:
    return F.col(column).cast(f"decimal({digits},0)")


def phrases_left(phrases: DataFrame, paths_: DataFrame, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """Phrases of two words or more that no longer one covers to ``covered`` hundredths of their count.

    Of the longer phrases only those by one word matter: any still longer one is no more frequent.
    """
    found = phrases.where("size > 1").join(inner_nodes(paths_, longest), ["lang", "phrase"], "left_anti")
    longer = phrases.where("size > 2").withColumn("less", F.col("size") - 1)
    held = longer.select("lang", "a", F.explode(F.array(*(F.expr(f"substring_index(phrase, ' ', {sign}less)") for sign in ("", "-")))).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covers = exact("longer") * F.lit(100).cast("decimal(3,0)") >= exact("a") * F.lit(covered).cast("decimal(3,0)")
    return found.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covers).drop("longer")


def scored(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """``found`` with l, r and score of the cut that scores lowest."""
    cuts = found.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    known = lambda part, count: phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(count))
    joined = parts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"])
    # Whole-number division of a decimal; the product may pass 64 bits, the quotient is SCALE / 2 at most.
    score = F.expr(f"CAST((CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    lowest = joined.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def ranked(docs: DataFrame, least: int = LEAST, covered: int = COVERED, most: int = MOST, most_bytes: int = SENT_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases. ``docs`` has lang and text."""
    spark = docs.sparkSession
    with in_small_batches(spark):
        words_ = cut(word_counts(docs))
        known = sent_pairs(docs, sent_words(words_, least, most_bytes), least, most_bytes)
        grams = cut(longest_grams(docs, known))
    phrases = counts(grams, least)
    runs = paths(phrases)
    top = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(phrases_left(phrases, runs, covered), phrases).withColumn("rank", F.row_number().over(top).cast("long")).where(F.col("rank") <= most)
    whole = words_.groupBy("lang").agg(F.sum("n").alias("n"))
    out = cut(best.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    drop_table(spark, words_, grams, phrases, runs)
    return out


SQL = f"""WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, words FROM (
        SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS words
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents) s
    ) w WHERE len(words) > 0
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), counts AS (
    SELECT lang, m AS size, array_to_string(words[i : i + m - 1], ' ') AS phrase, count(*) AS a
    FROM places, (VALUES (1), (2), (3), (4)) s(m) WHERE i + m - 1 <= len(words) GROUP BY ALL
), totals AS (
    SELECT lang, sum(a) AS n FROM counts WHERE size = 1 GROUP BY lang
), frequent AS (
    SELECT lang, size, phrase, string_split(phrase, ' ') AS words, a FROM counts WHERE a >= {LEAST}
), inside AS (
    SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM frequent, (VALUES (2), (3)) s(m), (VALUES (1), (2), (3)) t(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL
), kept AS (
    SELECT f.* FROM frequent f LEFT JOIN inside i ON i.lang = f.lang AND i.phrase = f.phrase
    WHERE size > 1 AND (longer IS NULL OR 100 * longer::HUGEINT < {COVERED} * a::HUGEINT)
), cuts AS (
    SELECT k.lang, k.phrase, k.a, c, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * k.a) // (l.a + r.a) AS score
    FROM kept k, (VALUES (1), (2), (3)) s(c), frequent l, frequent r
    WHERE c < k.size AND l.lang = k.lang AND r.lang = k.lang
      AND l.phrase = array_to_string(k.words[: c], ' ') AND r.phrase = array_to_string(k.words[c + 1 :], ' ')
), scores AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), best AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scores QUALIFY rank <= {MOST}
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best JOIN totals USING (lang)"""
