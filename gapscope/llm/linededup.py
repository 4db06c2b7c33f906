"""Dedup of repeated passages across lines by winnowing; DataFrame functions only.

A *run* is a stretch of words of one text, over as many lines or parts of lines as it takes. A
run of at least ``min_words`` words that occurred before (in the order of doc_id, then text, then
word) is a later repeat, and its words are deleted. First occurrences stay, and what overlaps
its own first occurrence is no repeat.

1. Fingerprints. Every window of ``min_words`` words selects the place with the smallest hash
   (the last one on ties) among those that leave a gram of ``gram`` words in the window. Equal
   windows select equal grams, so a repeated run is guaranteed to leave one gram at two places.
   Whole lines are too coarse a unit: a run that begins and ends within lines may hold none.
2. Positions. A place reaches over all windows that selected it. Only places whose gram occurs
   at two or more go on; those of equal reach are joined, and all but the first are repeats whole.
3. Matches. Where places of one gram differ in reach, the first of each kind is extended both
   ways word by word: its windows are joined with their first place, and later ones are repeats.
   A window holds half of its other words left of the gram or more than half right of it; only
   windows whose half is met in two kinds are compared.
4. Overlapping repeats merge, and their words go. Lines left without a word go with them; of a
   line that is partly in a run the other words stay, with the white space before them.

Windows are compared by 128 bits, reaches by 64 beside those of their gram, unlike texts of one
doc_id told apart by 60; halves by 32, as a chance match only adds windows to compare. Up to 2^32
documents with such windows are numbered. Counts and first places are partial sums, so a passage
with a third of all places is no task's burden; joins on them can be split.

A null or empty text has no words and comes back as it is. Rows of equal doc_id and text are
one document, and each gets its result; a null doc_id comes after all others. A text whose
words all go becomes the empty text; one that ends in a repeat loses the white space at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.functions.text import let
from gapscope.llm.common import cut, drop_table
from gapscope.operators.rounds import numbered

MIN_WORDS, GRAM = 50, 8
WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: A word with the white space before it; these and the white space at the end make up a text.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
LOW = (1 << 31) - 1


def digest(text: Column) -> Column:
    """60 bits that stand for a text, in the order of its MD5; null for a null text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def word_hashes(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(t, GAP, -1), lambda w: F.xxhash64(w))))


def narrowed(values: Column, span: int) -> Column:
    """The smallest of each ``span`` values in a row, up to four times as many a step; later ones see fewer."""
    def least(offsets: list[int]):
        return lambda v: F.transform(v, lambda x, i: F.least(x, *[F.get(v, i + k) for k in offsets]))

    reach = 1
    while reach < span:
        offsets = sorted({min(k * reach, span - reach) for k in (1, 2, 3)})
        values, reach = let(values, least(offsets)), min(4 * reach, span)
    return values


def places(texts: DataFrame, min_words: int, gram: int) -> DataFrame:
    """Every selected place of ``texts`` (id, d, words): first and last of the windows that select it, its
    gram (print), all its words (whole), and the halves that ``repeats`` asks for.

    Places become rows before they are hashed: Spark compiles what is done to columns, not what
    lambdas do to the items of an array.
    """
    reach = min_words - gram
    ranked = F.transform("words", lambda h, i: h.bitwiseOR(F.lit(LOW)) - i)
    long_enough = F.size("words") >= min_words
    smallest = texts.select("*", F.when(long_enough, narrowed(ranked, reach + 1)).alias("m"))
    chosen = smallest.select("*", F.when(long_enough, F.array_distinct(F.slice("m", F.lit(1), F.size("words") - min_words + 1))).alias("v")).drop("m")
    # The outer form: for the other one the optimiser adds a filter that makes the array a second time.
    rows = chosen.select("*", F.posexplode_outer("v").alias("k", "own")).where("own is not null")
    before, after = F.get("v", F.col("k") - 1), F.get("v", F.col("k") + 1)

    def place(c: Column) -> Column:
        return F.lit(LOW) - c.bitwiseAND(F.lit(LOW)).cast("int")

    # A place's windows begin where the one before left, or where this smaller one came in, and end likewise.
    first = F.when(F.col("k") == 0, 0).when(F.col("own") < before, place(F.col("own")) - reach).otherwise(place(before) + 1)
    last = F.when(after.isNull(), F.size("words") - min_words).when(after < F.col("own"), place(after) - reach - 1).otherwise(place(F.col("own")))
    ends = rows.select("id", "d", "words", place(F.col("own")).alias("p"), first.alias("first"), last.alias("last"))
    half = reach // 2
    ends = ends.select("*", (F.col("p") - half).alias("middle"))
    return ends.select(
        "id", "d", "first", "last", "middle",
        F.xxhash64(F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + min_words)).alias("whole"),
        F.xxhash64(F.slice("words", F.col("p") + 1, F.lit(gram))).alias("print"),
        F.when(F.col("first") <= F.col("middle"), F.hash(F.slice("words", F.col("middle") + 1, F.lit(half + gram)))).alias("left"),
        F.when(F.col("last") > F.col("middle"), F.hash(F.slice("words", F.col("p") + 1, F.lit(min_words - half + 1)))).alias("right"),
    )


def keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), digest(F.col("text")).alias("d"), "text")


def fingerprints(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(id, d, first, last, whole, print): the selected places of all texts long enough."""
    return places(keyed(docs).select("id", "d", word_hashes(F.col("text")).alias("words")), min_words, gram)


def hashed(table: DataFrame) -> DataFrame:
    """``table`` as the side of a join that is hashed, part by part, so that the longer side is not sorted."""
    return table.hint("shuffle_hash")


def same_document(table: DataFrame, key: DataFrame) -> Column:
    return table["id"].eqNullSafe(key["__id"]) & (table["d"] == key["__d"])


def repeats(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(__id, __d, __runs): for every document with later repeats, the sorted (first, last) of windows of them."""
    prints = cut(fingerprints(docs, min_words, gram))
    spot = F.xxhash64("id", "d", "first")
    often = cut(prints.groupBy("print").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("print"))
    kept = cut(prints.join(hashed(often), "print", "left_semi"))
    drop_table(docs.sparkSession, prints, often)

    def order(at: str) -> Column:
        return F.struct(F.col("id").isNull().alias("unnamed"), "id", "d", F.col(at).alias("at"))

    def near(at: str) -> Column:
        """Whether a place is its origin or overlaps it."""
        return F.col("id").eqNullSafe(F.col("origin.id")) & (F.col("d") == F.col("origin.d")) & (F.col(at) < F.col("origin.at") + min_words)

    classes = cut(kept.groupBy("print", "whole").agg(F.min(order("first")).alias("origin"), F.min("left").alias("left"), F.min("right").alias("right")))
    members = cut(kept.join(hashed(classes.select("print", "whole", "origin")), ["print", "whole"]).select("id", "d", "first", "last", "middle", "print", "left", "right", near("first").alias("near")))
    drop_table(docs.sparkSession, kept)

    def sides(table: DataFrame, *columns: str) -> DataFrame:
        """The windows of a place that hold what stands left of its gram, and those that hold what stands right."""
        both = F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("key")) for k in ("left", "right")])
        return table.select(*columns, "print", F.explode(both).alias("s")).select(*columns, "print", "s.*").where("key is not null")

    mixed = sides(classes).groupBy("print", "side", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    tried = sides(members.where("near"), "id", "d", "first", "last", "middle").join(mixed, ["print", "side", "key"], "left_semi")
    begin = F.when(F.col("side") == "left", F.col("first")).otherwise(F.greatest("first", F.col("middle") + 1))
    end = F.when(F.col("side") == "left", F.least("last", "middle")).otherwise(F.col("last"))
    tested = tried.groupBy("id", "d").agg(F.collect_set(F.struct(begin.alias("first"), end.alias("last"))).alias("ranges"))
    tested = cut(numbered(tested.withColumn("unnamed", F.col("id").isNull()), ["unnamed", "id", "d"], "n"))
    drop_table(docs.sparkSession, classes)
    tested = tested.select(F.col("id").alias("__id"), F.col("d").alias("__d"), "n", "ranges")
    texts = keyed(docs)
    texts = texts.join(hashed(tested), same_document(texts, tested)).dropDuplicates(["n"])

    held = F.slice("words", F.col("at") + 1, F.lit(min_words))
    ranges = texts.select("n", word_hashes(F.col("text")).alias("words"), "ranges").select("n", "words", F.explode_outer("ranges").alias("r"))
    starts = ranges.select("n", "words", F.explode_outer(F.sequence("r.first", "r.last")).alias("at"))
    # One number orders windows by document, then place.
    windows = cut(starts.select(F.shiftleft(F.col("n").cast("long"), 31).bitwiseOR(F.col("at").cast("long")).alias("spot"), F.xxhash64(held).alias("a"), F.xxhash64(F.lit(1), held).alias("b")))
    firsts = windows.groupBy("a", "b").agg(F.min("spot").alias("origin"), F.max("spot").alias("final")).where(F.col("final") >= F.col("origin") + min_words).drop("final")
    later = windows.join(hashed(firsts), ["a", "b"]).where(F.col("spot") >= F.col("origin") + min_words)
    at = F.col("spot").bitwiseAND(F.lit(LOW)).cast("int")
    later = later.groupBy(F.shiftright("spot", 31).alias("n")).agg(F.collect_set(F.struct(at.alias("first"), at.alias("last"))).alias("runs"))
    later = later.join(tested.select("__id", "__d", "n"), "n").select("__id", "__d", "runs")
    runs = members.where("not near").groupBy(F.col("id").alias("__id"), F.col("d").alias("__d")).agg(F.collect_set(F.struct("first", "last")).alias("runs")).unionByName(later)
    return runs.groupBy("__id", "__d").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("__runs"))


def rest(text: Column, runs: Column, min_words: int) -> Column:
    """The text without the words of the windows that begin in ``runs``, which are sorted and apart."""
    begins = F.transform(F.filter(runs, lambda r, k: (k == 0) | (F.get(runs, k - 1)["last"] + min_words < r["first"])), lambda r: r["first"])
    ends = F.transform(
        F.filter(runs, lambda r, k: (k + 1 == F.size(runs)) | (F.get(runs, k + 1)["first"] > r["last"] + min_words)), lambda r: r["last"] + min_words
    )
    gap = lambda token: F.regexp_extract(token, r"^[\x20\x09-\x0D]*", 0)

    def joined(tokens: Column, b: Column, e: Column) -> Column:
        def piece(end: Column, k: Column) -> Column:
            """What stands between a repeat's end and the next one's begin."""
            begin, until = F.get(b, k), F.coalesce(F.get(b, k + 1), F.size(tokens))
            before, after = gap(F.get(tokens, begin)), gap(F.get(tokens, end))
            over = F.exists(F.slice(tokens, begin + 2, end - begin - 1), lambda t: gap(t).contains("\n"))
            space = F.when(begin == 0, "").when(after.contains("\n"), after).when(before.contains("\n"), before).when(over, "\n").otherwise(after)
            return F.when(end < F.size(tokens), F.concat(space, F.regexp_replace(F.array_join(F.slice(tokens, end + 1, until - end), ""), r"^[\x20\x09-\x0D]+", ""))).otherwise("")

        head = F.array_join(F.slice(tokens, 1, F.get(b, F.lit(0))), "")
        tail = F.when(F.element_at(e, -1) < F.size(tokens), F.regexp_extract(text, r"[\x20\x09-\x0D]*\z", 0)).otherwise("")
        return F.concat(head, F.array_join(F.transform(e, piece), ""), tail)

    return let(F.regexp_extract_all(text, F.lit(f"({TOKEN})")), lambda t: let(begins, lambda b: let(ends, lambda e: joined(t, b, e))))


def worded_lines(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))), F.lit(0)).cast("long")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` without the words of later repeated runs, how many lines with a word each text
    had (``n_lines``) and lost whole (``n_deleted``), and whether it lost any word (``changed``);
    other columns stay."""
    gone = cut(repeats(docs, min_words, min(gram, min_words)))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_deleted", "changed")]
    joined = docs.join(hashed(gone), docs["doc_id"].eqNullSafe(gone["__id"]) & (digest(docs["text"]) == gone["__d"]), "left")
    left = F.when(F.col("__runs").isNotNull(), rest(F.col("text"), F.col("__runs"), min_words))
    both = joined.select(*others, F.col("text").alias("__all"), F.explode(F.array(left)).alias("__left"))
    changed = F.col("__left").isNotNull()
    lines = worded_lines(F.col("__all"))
    return both.select(
        *others, F.coalesce("__left", "__all").alias("text"), lines.alias("n_lines"),
        F.when(changed, lines - worded_lines(F.col("__left"))).otherwise(F.lit(0)).cast("long").alias("n_deleted"), changed.alias("changed"),
    )


#: The same by comparing all windows of 50 words.
SQL = r"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
tokened AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(text)) AS doc, doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS tokens FROM texts
),
bare AS (SELECT *, list_transform(tokens, lambda t: regexp_replace(t, '^[\x20\x09-\x0D]+', '')) AS words FROM tokened),
windows AS (
  SELECT doc, p, md5(array_to_string(words[p + 1 : p + 50], ' ')) AS held
  FROM (SELECT doc, words, unnest(range(len(words) - 49)) AS p FROM bare WHERE len(words) >= 50)
),
placed AS (SELECT doc, p, first_value(doc) OVER w AS d, first_value(p) OVER w AS a FROM windows WINDOW w AS (PARTITION BY held ORDER BY doc, p)),
later AS (SELECT doc, p FROM placed WHERE doc <> d OR p >= a + 50),
token AS (SELECT doc, unnest(tokens) AS t, unnest(words) AS word, unnest(range(len(words))) AS k FROM bare WHERE doc IN (SELECT doc FROM later)),
spread AS (
  SELECT t.doc, t.k, t.word, t.t[1 : length(t.t) - length(t.word)] AS gap,
    max(l.p) OVER (PARTITION BY t.doc ORDER BY t.k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS dead
  FROM token t LEFT JOIN later l ON l.doc = t.doc AND l.p = t.k
),
before AS (SELECT *, max(CASE WHEN NOT dead THEN k END) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM spread),
stretch AS (
  SELECT doc, coalesce(prior, -1) AS prior, arg_min(gap, k) AS first_gap, bool_or(contains(gap, chr(10)) AND k > coalesce(prior, -1) + 1) AS broken
  FROM before WHERE dead GROUP BY ALL
),
kept AS (
  SELECT b.doc, string_agg(CASE
      WHEN s.doc IS NULL THEN b.gap WHEN b.prior IS NULL THEN '' WHEN contains(b.gap, chr(10)) THEN b.gap
      WHEN contains(s.first_gap, chr(10)) THEN s.first_gap WHEN s.broken THEN chr(10) ELSE b.gap END || b.word, '' ORDER BY b.k) AS kept, max(b.k) AS p
  FROM before b LEFT JOIN stretch s ON s.doc = b.doc AND s.prior = coalesce(b.prior, -1) AND b.k > coalesce(b.prior, -1) + 1
  WHERE NOT b.dead GROUP BY b.doc
),
changed AS (
  SELECT b.doc_id, b.text, coalesce(k.kept, '') || CASE WHEN k.p = len(b.words) - 1 THEN regexp_extract(b.text, '[\x20\x09-\x0D]*$') ELSE '' END AS rest
  FROM bare b LEFT JOIN kept k USING (doc) WHERE b.doc IN (SELECT doc FROM later)
),
counted AS (
  SELECT d.doc_id, d.text, c.rest, coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0) AS n_lines,
    len(list_filter(string_split(c.rest, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_left
  FROM documents d LEFT JOIN changed c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.text = d.text
)
SELECT doc_id, coalesce(rest, text) AS text, n_lines, CASE WHEN rest IS NULL THEN 0 ELSE n_lines - n_left END AS n_deleted, rest IS NOT NULL AS changed FROM counted
"""
