"""TF-IDF terms and labels of clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.config import SEED, TICKET_STOP_WORDS
from gapscope.functions.text import join_texts, let, normalise_terms
from gapscope.operators.rounds import cut

TOKEN = "[a-zA-Z]{3,}"


def english_stop_words(spark) -> list[str]:
    """Spark's own English stop words joined with the ticket words."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")) | set(TICKET_STOP_WORDS))


def tokens(text: Column, stop_words: Sequence[str], terms: Mapping[str, str] | None = None) -> Column:
    """Words of three letters or more that are no stop words, then their neighbour pairs."""
    found = F.regexp_extract_all(normalise_terms(text, terms), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(list(stop_words)))


def with_pairs(unigrams: Column) -> Column:
    n = F.size(unigrams)
    pairs = F.zip_with(
        F.slice(unigrams, F.lit(1), n - 1),
        F.slice(unigrams, F.lit(2), n - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n >= 2, F.concat(unigrams, pairs)).otherwise(unigrams)


def term_counts(
    docs: DataFrame,
    key: str,
    problem: str,
    resolution: str | None,
    stop_words: Sequence[str],
    terms: Mapping[str, str] | None = None,
    carry: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """``(key, carry.., term, tf)``, a stored table; ``docs`` has one row per document.

    Terms are counted inside the row, so nothing is shuffled and no repeated token leaves it. The row
    gives its sorted terms and where their runs begin; rows per run are made of them in compiled code.
    """
    text = F.col(problem) if resolution is None else join_texts(F.col(problem), F.col(resolution))
    counted = let(tokens(text, stop_words, terms), lambda t: let(with_pairs(t), term_runs))
    # An inner explode would make Spark test the array's size first and take the tokens twice.
    runs = docs.select(key, *carry, F.explode_outer(F.array(counted)).alias("__r"))
    begins = runs.select(key, *carry, "__r", F.posexplode("__r.begins").alias("__k", "__at"))
    until = F.coalesce(F.get("__r.begins", F.col("__k") + 1), F.size("__r.terms"))
    return cut(begins.select(key, *carry, F.get("__r.terms", F.col("__at")).alias("term"), (until - F.col("__at")).cast("long").alias("tf")))


def term_runs(terms: Column) -> Column:
    """(terms, begins) of an array: sorted, and where each run of equal terms begins; null without terms.

    ``sort_array`` compares texts itself; ``array_sort`` would interpret a comparator for every two of them.
    """

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))
        return F.struct(s.alias("terms"), begins.alias("begins"))

    return F.when(F.size(terms) > 0, let(F.sort_array(terms), runs))


def vocabulary(
    counts: DataFrame,
    documents: DataFrame,
    *,
    min_docs: int = 5,
    max_share: float = 0.80,
    size: int = 5000,
) -> DataFrame:
    """Terms in at least ``min_docs`` and at most ``max_share`` of the documents.

    Of those the ``size`` with the largest total count, so at most ``size`` rows.
    """
    n = documents.agg(F.count("*").alias("n")).scalar()
    return (
        counts.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        .withColumn("n", n)
        .where((F.col("df") >= min_docs) & (F.col("df") <= max_share * F.col("n")))
        .orderBy(F.desc("total"), "term")
        .limit(size)
    )


def tfidf(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Weight ``(1 + ln tf) (ln((1 + n)/(1 + df)) + 1)``, scaled to length one per document."""
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    # The vocabulary has a row limit, which bounds what is broadcast.
    known = counts.join(F.broadcast(vocab), "term")
    raw = known.withColumn("__w", (1 + F.log("tf")) * idf)
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("__w") / length).select(*counts.columns, "weight")


def cluster_terms(
    weights: DataFrame, documents: DataFrame, cluster: str = "cluster_id", top: int = 20
) -> DataFrame:
    """Mean weight per cluster (documents without terms count) and the ``top`` terms."""
    sizes = documents.groupBy(cluster).agg(F.count("*").alias("__size"))
    means = (
        weights.groupBy(cluster, "term")
        .agg(F.sum("weight").alias("__sum"))
        .join(sizes, cluster)
        .select(cluster, "term", F.round(F.col("__sum") / F.col("__size"), 12).alias("weight"))
    )
    w = Window.partitionBy(cluster).orderBy(F.desc("weight"), "term")
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def distinct_terms(ranked: Column, keep: int = 10) -> Column:
    """Terms that bring a new word, in order, at most ``keep``."""

    def step(state: Column, term: Column) -> Column:
        parts = F.split(term, " ")
        fresh = (F.size(F.array_except(parts, state["seen"])) > 0) & (F.size(state["kept"]) < keep)
        return F.struct(
            F.when(fresh, F.array_append(state["kept"], term)).otherwise(state["kept"]).alias("kept"),
            F.when(fresh, F.array_union(state["seen"], parts)).otherwise(state["seen"]).alias("seen"),
        )

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("kept"), empty.alias("seen"))
    return F.aggregate(ranked, start, step, lambda s: s["kept"])


def labels(terms: DataFrame, clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``cluster_label`` of three terms and ``top_terms`` of ten for every cluster."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"]
    )
    kept = terms.groupBy(cluster).agg(ordered.alias("__terms")).select(
        cluster, distinct_terms(F.col("__terms")).alias("__kept")
    )
    name = F.when(F.size("__kept") > 0, F.array_join(F.slice("__kept", 1, 3), " / "))
    fallback = F.concat(F.lit("Cluster_"), F.col(cluster).cast("string"))
    return clusters.select(cluster).distinct().join(kept, cluster, "left").select(
        cluster,
        F.coalesce(name, fallback).alias("cluster_label"),
        F.coalesce(F.array_join("__kept", ", "), F.lit("")).alias("top_terms"),
    )


def draw(seed: int, *cols: str) -> Column:
    """Repeatable random order: a hash both Spark and SQL engines know."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_members(
    members: DataFrame, by: Sequence[str], key: Sequence[str], n: int, seed: int = SEED
) -> DataFrame:
    """Up to ``n`` rows of each group in repeatable random order, as ``pick`` from 1.

    The rank is filtered right above its window, so Spark keeps at most ``n`` rows
    of a group per input partition before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy("__draw", *key)
    return (
        members.withColumn("__draw", draw(seed, *key))
        .withColumn("pick", F.row_number().over(w))
        .where(F.col("pick") <= n)
        .drop("__draw")
    )
