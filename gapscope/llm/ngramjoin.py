"""n-gram Jaccard join by filtering under several global orders of the tokens.

A document is the set of its shingles (runs of ``width`` words, A-Z in lower case; a shorter
text is one shingle; no words, no set). Two sets are linked when their overlap is at least
``percent`` hundredths of their union. For such a pair and *any* order of all tokens, prefixes
of the two sets share tokens, the more the closer the sizes are. So:

1. Equal sets are one class from the start; its smallest doc_id stands for it.
2. Each task counts its words and tokens and reports those it meets often. Tokens with a word
   that was not reported come first in every order, tokens of reported words after them by
   the count of their rarest word, and reported tokens last. (Any choice is right here; it
   decides how well prefixes tell documents apart. Both lists keep a bounded number of the
   most reported, so they can be sent to all tasks.) Within a class, a hash orders tokens,
   another one in each order.
3. Order A makes candidates: sets that share a token of their A-prefixes. Orders B and C are
   intersected with it: both prefixes must share as many tokens as the sizes demand.
4. What is left is verified on the words themselves.

Links matter only for the groups they form, so a token with many sets is not paired out. The
smallest set is paired with the others first (a star); sets that have become one component
need no more comparing, and tokens whose sets are in two components or more go round again
with more hubs each time, until every pair is decided or joined. Stars, joins and first hubs
spread over tasks; nothing gathers a token's sets.

Tokens are 64-bit hashes of the words (a false equal pair of tokens in one comparison is a
matter of 1 in 10^13). Null text is no text. A null doc_id has its n_shingles, no component
and no links. Rows with one doc_id are one member of a component, with all their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.llm.common import claim, cut, drop_table, give_back, small_batches
from gapscope.llm.components import components

HOT_TOKENS = HOT_WORDS = 1 << 16
BLOCK_TOKENS = 1 << 21
#: Texts are taken together until they have so many words, which numpy then works on at once.
GROUP_WORDS = 1 << 16
#: Known numbers are looked up by so many of their first bits.
LOOK_BITS = 20
LEAST_TOKENS, LEAST_WORDS = 4, 32
#: Hubs of a token in the first round, in the second, and how many times as many in each later one.
FIRST_HUBS, MORE_HUBS, HUB_GROWTH = 1, 32, 8
#: Ids that are sent to all tasks at most; above it the join is left to be a shuffle.
SENT_IDS = 2_000_000
ODD = 0x9E3779B97F4A7C15
#: Under this name workers drop what other operators remembered.
OWNER = "ngramjoin"


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern; another one for each salt."""
    x = x + np.uint64(salt * ODD % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The token of every run of ``width`` words, or of all words if there are fewer."""
    size = min(width, len(hashes))
    n = len(hashes) - size + 1 if size else 0
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mixed(out + hashes[k : k + n], 7)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted tokens of the set."""
    return distinct(windows(word_hashes(text), width))


def in_groups(texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
    """Word hashes of the texts, in lists of about ``GROUP_WORDS`` words."""
    group, held = [], 0
    for text in texts:
        group.append(word_hashes(text))
        held += len(group[-1])
        if held >= GROUP_WORDS:
            yield group
            group, held = [], 0
    if group:
        yield group


def apart(group: list[np.ndarray], width: int, make: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``make`` gives for the words of each text: a value for every window. Texts with a whole window are made as one."""
    long = [h for h in group if len(h) >= width]
    made, start = make(np.concatenate(long)) if long else (), 0
    for hashes in group:
        if len(hashes) < width:
            yield make(hashes)
        else:
            yield tuple(m[start : start + len(hashes) - width + 1] for m in made)
            start += len(hashes)


def least_overlap(percent: int, both: int) -> int:
    """Fewest common tokens of a linked pair whose sizes add up to ``both``."""
    return -(-percent * both // (100 + percent))


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """Tokens that must be looked at for any partner, and for partners that are not smaller."""
    return n + 1 - -(-percent * n // 100), n + 1 - least_overlap(percent, 2 * n)


class Known:
    """Values of known 64-bit hashes; 0 for all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        at = np.argsort(keys)
        self.keys, self.values = np.r_[keys[at], np.uint64(2**64 - 1)], np.r_[values[at], values.dtype.type(0)]
        held = np.bincount((keys >> np.uint64(64 - LOOK_BITS)).astype(np.int64), minlength=1 << LOOK_BITS)
        self.first, self.steps = (np.cumsum(held) - held).astype(np.int32), int(held.max())

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.first[hashes >> np.uint64(64 - LOOK_BITS)]
        for _ in range(self.steps):
            at += self.keys[at] < hashes
        return np.where(self.keys[at] == hashes, self.values[at], self.values.dtype.type(0))


class Orders:
    """Global orders of tokens: a class by how often words and tokens were reported, then a hash.

    A token's place in an order is a number: its class in the highest byte, its hash below.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: np.ndarray):
        self.levels = Known(words, (np.ceil(np.log2(counts)) + 1).astype(np.uint8))
        self.often = Known(tokens, np.ones(len(tokens), np.uint8))

    def classes(self, hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Class of the token at each window of the words."""
        level, n = self.levels(hashes), len(found)
        out = level[:n].copy()
        for k in range(1, len(hashes) - n + 1):
            np.minimum(out, level[k : n + k], out=out)
        out[self.often(found) == 1] = 255
        return out.astype(np.uint64)


def places(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    return classes << np.uint64(56) | mixed(tokens, order) >> np.uint64(8)


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    return np.partition(values, size - 1)[:size] if size < len(values) else values


SCAN = "doc_id long, n_shingles long, class string, kind string, item long, seen long"


def scan(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts: a row per document with its set's size and class, and rows of often met words and tokens."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim(OWNER)
        blocks: dict[str, list[np.ndarray]] = {"word": [], "token": []}

        def report() -> Iterator[pd.DataFrame]:
            for kind, least in (("word", LEAST_WORDS), ("token", LEAST_TOKENS)):
                items, seen = np.unique(np.concatenate(blocks[kind]) if blocks[kind] else np.empty(0, np.uint64), return_counts=True)
                blocks[kind].clear()
                often = seen >= least
                yield pd.DataFrame({"doc_id": None, "n_shingles": None, "class": None, "kind": kind, "item": items[often].view(np.int64), "seen": seen[often]})

        for batch in batches:
            sizes, names = [], []
            for group in in_groups(batch["text"]):
                for hashes, (found,) in zip(group, apart(group, width, lambda h: (windows(h, width),))):
                    tokens = distinct(found)
                    sizes.append(len(tokens))
                    names.append(class_name(tokens))
                    blocks["word"].append(hashes)
                    blocks["token"].append(tokens)
                if sum(map(len, blocks["token"])) > BLOCK_TOKENS:
                    yield from report()
            # Ids come as text: beside nulls they would become floats.
            ids = pd.array([None if x is None else int(x) for x in batch["doc_id"]], "Int64")
            yield pd.DataFrame({"doc_id": ids, "n_shingles": sizes, "class": names, "kind": None, "item": None, "seen": None})
        yield from report()
        give_back()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(read, SCAN)


def class_name(tokens: np.ndarray) -> str | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest() if len(tokens) else None


def often_met(read: DataFrame, kind: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` items with the highest reported counts, and the counts."""
    summed = read.where(F.col("kind") == kind).groupBy("item").agg(F.sum("seen").alias("seen"))
    top = summed.orderBy(F.desc("seen"), "item").limit(most).toPandas()
    return top["item"].to_numpy(np.int64).view(np.uint64), top["seen"].to_numpy(np.int64)


def prefixes(docs: DataFrame, width: int, percent: int, often: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """Per text a struct: the prefix of order A, 8 bytes a token (its first n_index are the index part), and those of B and C, 4 bytes a token."""
    known = docs.sparkSession.sparkContext.broadcast(often)
    made: list[Orders] = []  # once in a task

    def placed(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        found = windows(hashes, width)
        kinds = made[0].classes(hashes, found)
        return found, *(places(found, kinds, k) for k in (1, 2, 3))

    @F.pandas_udf("class string, n int, n_index int, a binary, b binary, c binary, lost int")
    def find(texts: pd.Series) -> pd.DataFrame:
        claim(OWNER)
        made[:] = made or [Orders(*known.value)]
        rows = []
        for found, *orders in (x for group in in_groups(texts) for x in apart(group, width, placed)):
            if not len(found):
                rows.append((None, 0, 0, b"", b"", b"", 0))
                continue
            tokens, at = np.unique(found, return_index=True)
            size, n_index = prefix_sizes(len(tokens), percent)
            first, *short = (smallest(o[at], size) for o in orders)
            short = [distinct(s.astype("<u4")) for s in short]
            # Shortening may make tokens equal; how many are lost is allowed for later.
            lost = size - min(map(len, short))
            rows.append((class_name(tokens), len(tokens), n_index, np.sort(first).astype("<u8").tobytes(), *(s.tobytes() for s in short), lost))
        return pd.DataFrame(rows, columns=["class", "n", "n_index", "a", "b", "c", "lost"])

    # Else a filter on its result is a second run of it, in a worker of its own.
    return find.asNondeterministic()(F.col("text"))


def sent(df: DataFrame, rows: int) -> DataFrame:
    """Sent to all tasks if ``rows`` (of an id or two) is within the bound; else as the optimiser sees fit."""
    return F.broadcast(df) if rows <= SENT_IDS else df


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose B- and C-prefixes share as many tokens as their sizes demand."""
    mine = sets.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("b").alias("bx"), F.col("c").alias("cx"), "lost")
    other = sets.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("b").alias("by"), F.col("c").alias("cy"))

    @F.pandas_udf("boolean")
    def share(nx: pd.Series, ny: pd.Series, lost: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        claim(OWNER)
        out = []
        for m, n, less, *pairs in zip(nx, ny, lost, zip(bx, by), zip(cx, cy)):
            overlap = least_overlap(percent, m + n)
            # Prefixes of these sizes have so many tokens in common, whatever the order.
            need = min(prefix_sizes(k, percent)[0] - k + overlap for k in (m, n)) - less
            out.append(all(len(np.intersect1d(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), assume_unique=True)) >= need for x, y in pairs))
        return pd.Series(out, dtype=bool)

    # Only the sets that the pairs name are moved.
    rows = pairs.count()
    needed = other.join(sent(pairs.select("y").distinct(), rows), "y", "left_semi")
    both = sent(pairs, rows).join(mine, "x").join(needed, "y")
    return both.where(share("nx", "ny", "lost", "bx", "by", "cx", "cy")).select("x", "y").distinct()


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (x, y) that are links by their words, as a table. Texts are taken from ``docs`` for these pairs only and not kept."""

    @F.pandas_udf("boolean")
    def linked(xs: pd.Series, ys: pd.Series) -> pd.Series:
        claim(OWNER)
        out, last, mine = [], None, None
        for x, y in zip(xs, ys):
            if mine is None or x != last:
                last, mine = x, shingles(x, width)
            other = shingles(y, width)
            common = len(np.intersect1d(mine, other, assume_unique=True))
            out.append(len(mine) > 0 and 100 * common >= percent * (len(mine) + len(other) - common))
        return pd.Series(out, dtype=bool)

    rows = pairs.count()
    if not rows:
        return pairs
    ids = cut(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    texts = cut(docs.select(F.col("doc_id").alias("id"), "text").join(sent(ids, ids.count()), "id", "left_semi"))
    with_y = sent(pairs, rows).join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y")
    # Only the texts that the pairs name are moved.
    needed = texts.select(F.col("id").alias("x"), F.col("text").alias("tx")).join(sent(pairs.select("x").distinct(), rows), "x", "left_semi")
    links = cut(with_y.join(needed, "x").where(linked("tx", "ty")).select("x", "y"))
    drop_table(docs.sparkSession, ids, texts)
    return links


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component_id) after the components that new links (x, y) touch are merged."""
    ends = links
    for c in ("x", "y"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("component_id").alias(f"c{c}")), c)
    merged = components(ends.select(F.col("cx").alias("a"), F.col("cy").alias("b")))
    new = merged.select(F.col("node").alias("old"), F.col("component_id").alias("new"))
    return cut(labels.join(new, F.col("component_id") == F.col("old"), "left").select("node", F.coalesce("new", "component_id").alias("component_id")))


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    read = cut(scan(docs, width))
    members = read.where(F.col("n_shingles").isNotNull()).select("doc_id", "n_shingles", "class")
    classes = cut(members.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("rep")))
    often = (*often_met(read, "word", HOT_WORDS), often_met(read, "token", HOT_TOKENS)[0])

    found = prefixes(docs, width, percent, often)
    whole = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), found.alias("p")).select("id", "p.*").where(F.col("n") > 0)
    # Only copies need not go on, and they are the fewer: they are looked up, so that no prefix is moved.
    copies = cut(members.join(classes, "class").where(F.col("doc_id") > F.col("rep")).select(F.col("doc_id").alias("id"), "class").distinct())
    sets = cut(whole.join(sent(copies, copies.count()), ["id", "class"], "left_anti"))
    drop_table(spark, copies)

    tokens = F.transform(F.sequence(F.lit(1), F.octet_length("a") - 7, F.lit(8)), lambda i: F.substring(F.col("a"), i, F.lit(8)))
    postings = sets.select("id", "n", "n_index", F.posexplode(tokens).alias("at", "token")).select("token", "n", "id", (F.col("at") < F.col("n_index")).alias("index"))
    shared = cut(postings.groupBy("token").agg(F.count("*").alias("k"), F.max("index").alias("index")).where((F.col("k") > 1) & F.col("index")).select("token"))
    open_ = cut(postings.join(shared, "token", "left_semi"))
    ids = cut(open_.select("id").distinct())
    n_ids = ids.count()
    whole, sets = sets, cut(sets.drop("a").join(sent(ids, n_ids), "id", "left_semi"))
    drop_table(spark, whole, shared)

    by_size = F.struct("n", "id")
    # Tokens of the B-prefixes in 16 bits; linked sets share as many as their sizes demand, less those that shortening made equal.
    number = lambda i: (F.conv(F.hex(F.substring(F.col("b"), i, F.lit(2))), 16, 10).cast("int") - 32768).cast("short")
    short = sets.select("id", "lost", (F.octet_length("b") / 4).cast("int").alias("size"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.octet_length("b") - 3, F.lit(4)), number)).alias("marks"))
    marks = cut(short.select("id", "marks", (F.col("lost") + F.col("size") - F.size("marks")).alias("less")))
    tried = None
    labels = cut(ids.select(F.col("id").alias("node"), F.col("id").alias("component_id")))
    open_ = open_.withColumn("component", F.col("id"))
    hubs = FIRST_HUBS
    while not open_.isEmpty():
        # The next hubs of each token: its smallest sets that are indexed under it.
        order = Window.partitionBy("token").orderBy("n", "id")
        indexed = open_.where("index").withColumn("r", F.row_number().over(order)).where(F.col("r") <= hubs)
        heads = cut(indexed.select("token", F.struct("n", "id").alias("hub"), F.col("component").alias("hub_component")))
        near, may_link = open_, F.lit(True)
        if tried is not None:  # a token that is still open is met by many unlike sets: they must share enough of order B to meet
            near = open_.join(marks, "id")
            mine = marks.select(F.col("id").alias("hub_id"), F.col("marks").alias("hub_marks"), F.col("less").alias("hub_less"))
            bare, heads = heads, cut(heads.join(mine, F.col("hub.id") == F.col("hub_id")).drop("hub_id"))
            drop_table(spark, bare)
            overlap = F.expr(f"({percent} * (n + hub.n) + {99 + percent}) div {100 + percent}")
            need = overlap + 1 - F.expr(f"({percent} * n + 99) div 100")  # the larger set's prefix is the one that demands less
            may_link = F.size(F.array_intersect("marks", "hub_marks")) >= need - F.col("less") - F.col("hub_less")
        near = near.join(heads, "token").where(
            (by_size > F.col("hub")) & (100 * F.col("hub.n") >= percent * F.col("n")) & (F.col("component") != F.col("hub_component")) & may_link
        )
        pairs = near.select(F.col("hub.id").alias("x"), F.col("id").alias("y")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        pairs = cut(pairs)
        maybe = cut(likely(pairs, sets, percent))
        found = verified(maybe, docs, width, percent)
        before, labels = labels, joined(labels, found)
        # Whatever has been a hub is decided; the rest of a token goes on unless it is one component.
        last = heads.groupBy("token").agg(F.max("hub").alias("last"))
        rest = open_.select("token", "n", "id", "index").join(last, "token").where(by_size > F.col("last")).drop("last")
        rest = cut(rest.join(labels, F.col("id") == F.col("node")).select("token", "n", "id", "index", F.col("component_id").alias("component")))
        still = rest.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("index").alias("index"))
        going = cut(still.where((F.col("low") < F.col("high")) & F.col("index")).select("token"))
        done = open_, heads, maybe, found, before, rest, going
        open_ = cut(rest.join(going, "token", "left_semi"))
        # What a round made goes with it, so that only one round's tables are there at a time.
        drop_table(spark, *done)
        tried, done = (pairs, ()) if tried is None else (cut(tried.union(pairs)), (tried, pairs))
        drop_table(spark, *done)
        hubs = MORE_HUBS if hubs == FIRST_HUBS else HUB_GROWTH * hubs

    grouped = cut(classes.join(labels, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("component_id", "rep").alias("component_id")))
    out = members.join(grouped, "class", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.cast("long").alias("component_id"))


#: The same by comparing every two sets.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingled AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words
),
sets AS (SELECT doc_id, s, len(s) AS n FROM shingled),
classes AS (SELECT list_sort(s) AS s, n, min(doc_id) AS rep FROM sets WHERE n > 0 GROUP BY ALL),
tokens AS (SELECT rep, n, unnest(s) AS t FROM classes),
common AS (
  SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS k FROM tokens x JOIN tokens y ON x.t = y.t AND x.rep < y.rep
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL
),
links AS (SELECT a, b FROM common WHERE 100 * k >= 90 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
labels AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.s = list_sort(s.s) LEFT JOIN labels l ON l.rep = c.rep
"""
