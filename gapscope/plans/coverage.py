"""Clustering step: coverage of tickets, cluster summaries, labels from samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.config import SEED, Thresholds
from gapscope.functions.text import accept_label, gap_class, snippet, strip
from gapscope.functions.vectors import cluster_vector, kb_side_vector
from gapscope.models import ChatFn, with_reply
from gapscope.operators.clustering import centroids, intra_similarity
from gapscope.operators.labelling import sample_members
from gapscope.operators.similarity import Side, classify, nearest


def working_vectors(tickets: DataFrame) -> DataFrame:
    """``cluster_vec`` for clustering and ``kb_side_vec`` for comparing with articles."""
    p, r = F.col("problem_vec"), F.col("res_vec")
    return tickets.withColumn("cluster_vec", cluster_vector(p, r)).withColumn("kb_side_vec", kb_side_vector(p, r))


def ticket_coverage(
    tickets: DataFrame,
    articles: DataFrame,
    keys: tuple[str, ...] = ("ticket_id",),
    covered: float = Thresholds.covered,
    partial: float = Thresholds.partial,
    **layout,
) -> DataFrame:
    """Closest article of every ticket and its class; no shuffle while the articles fit a broadcast.

    Cosines do not depend on length, so the resolution (or problem) vector goes in as stored.
    Where there is no article at all, every ticket is as far from one as can be.
    """
    lead = keys[0]
    answers = tickets.withColumn("__answer", F.coalesce("res_vec", "problem_vec"))
    hits = nearest(
        Side(answers, "__answer", list(keys)), Side(articles, "kb_vec", ["kb_id", "title"]), **layout
    )
    # Either every ticket meets an article or none does; only the latter adds rows here.
    some = articles.where(F.col("kb_vec").isNotNull()).select(F.lit(1).alias("n")).limit(1).agg(F.count("*")).scalar()
    alone = answers.where(F.col("__answer").isNotNull() & (some == 0)).select(
        *keys, *[F.lit(None).cast(articles.schema[c].dataType).alias(c) for c in ("kb_id", "title")], F.lit(0.0).alias("sim")
    )
    hits = hits.select(*alone.columns).union(alone)
    return classify(hits, covered, partial).select(
        lead, *keys[1:], F.col("sim").alias("max_kb_sim"), F.col("kb_id").alias("best_kb_id"),
        snippet(F.col("title"), 500).alias("best_kb_title"), "coverage",
    )


def coverage_counts(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("coverage").agg(F.count("*").alias("tickets"))


def select_for_clustering(tickets: DataFrame, coverage: DataFrame, only_uncovered: bool = False) -> DataFrame:
    """All tickets, or on demand those no article covers."""
    if not only_uncovered:
        return tickets
    open_ = coverage.where("coverage = 'UNCOVERED'").select("ticket_id")
    return tickets.join(open_, "ticket_id", "left_semi")


def cluster_summary(
    tickets: DataFrame,
    articles: DataFrame,
    by: tuple[str, ...] = ("cluster_id",),
    covered: float = Thresholds.covered,
    partial: float = Thresholds.partial,
    **layout,
) -> DataFrame:
    """Size, centroid, coherence, closest article and flag of every cluster.

    ``centroid`` lies in the blended space; the article is found from the centroid of
    the resolution-side vectors.
    """
    by = list(by)
    blended = centroids(tickets, "cluster_vec", by)
    answer = centroids(tickets, "kb_side_vec", by, "kb_centroid")
    intra = intra_similarity(tickets, "cluster_vec", blended, by)
    sizes = tickets.groupBy(*by).agg(F.count("*").alias("size"))
    best = nearest(
        Side(answer.withColumn("__c", F.struct(*by)), "kb_centroid", ["__c"]),
        Side(articles, "kb_vec", ["kb_id", "title"]),
        **layout,
    ).select("__c.*", "kb_id", "title", "sim")
    return (
        sizes.join(blended, by).join(answer, by).join(intra, by).join(best, by, "left")
        .select(
            *by, "size", "centroid", "kb_centroid",
            F.round("intra_sim", 4).alias("intra_sim"),
            F.col("kb_id").alias("best_kb_id"), F.col("title").alias("best_kb_title"),
            F.round("sim", 4).alias("max_kb_sim"),
            gap_class(F.col("sim"), covered, partial).alias("gap_flag"),
        )
    )


def label_samples(members: DataFrame, n: int = 5, chars: int = 200, seed: int = SEED, tickets: DataFrame | None = None) -> DataFrame:
    """Numbered sample block of up to ``n`` members per cluster.

    ``members`` has cluster_id, source, source_id; problem_text and resolution_text are its own or those
    of ``tickets``, by source and source_id.
    """
    flat = lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    half = chars // 2
    ids = members.select("cluster_id", "source", "source_id")
    picked = sample_members(ids, ["cluster_id"], ["source", "source_id"], n, seed)
    texts = (members if tickets is None else tickets).select(
        "source", "source_id",
        snippet(flat(F.col("problem_text")), half).alias("p"),
        snippet(flat(F.col("resolution_text")), half).alias("r"),
    )
    block = F.concat_ws(
        "  ",
        F.when(F.col("p") != "", F.concat(F.lit("Problem: "), "p")),
        F.when(F.col("r") != "", F.concat(F.lit("Resolution: "), "r")),
    )
    # The ``n`` ids of a cluster go to the texts; joined by a shuffle, every text would move.
    rows = texts.join(F.broadcast(picked), ["source", "source_id"]).withColumn("b", block).where("b <> ''")
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("pick", "b"))),
        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["b"]),
    )
    return rows.groupBy("cluster_id").agg(F.array_join(parts, "\n").alias("samples"))


def label_prompts(clusters: DataFrame, samples: DataFrame) -> DataFrame:
    """Prompt asking for a short name, from size, terms and samples."""
    prompt = F.concat(
        F.lit("Name this group of support tickets in three to six words, title case.\nTickets: "),
        F.col("size").cast("string"), F.lit("\nTerms: "), F.coalesce("top_terms", F.lit("")),
        F.lit("\nSamples:\n"), F.col("samples"), F.lit('\n\nReply with JSON: {"label": "..."}'),
    )
    return clusters.join(samples, "cluster_id").select("cluster_id", prompt.alias("prompt"))


def model_labels(clusters: DataFrame, prompts: DataFrame, chat_fn: ChatFn) -> DataFrame:
    """``cluster_label`` from the model where it is usable, else the term label."""
    return use_labels(clusters, with_reply(prompts, F.array("prompt"), chat_fn).select("cluster_id", "reply"))


def use_labels(clusters: DataFrame, replies: DataFrame) -> DataFrame:
    """``replies`` has cluster_id and the model's JSON."""
    found = replies.select("cluster_id", F.get_json_object("reply", "$.label").alias("__l"))
    joined = clusters.join(found, "cluster_id", "left")
    return joined.withColumn("cluster_label", accept_label(F.col("__l"), F.col("cluster_label"))).drop("__l")
