"""Per-run tables on partitioned Parquet: merge by key, replace, delete.

Each operator computes the new content of the touched runs; ``write_runs`` puts it
in place. The new partitions are written under another name first and then moved, run
by run, with the old ones set aside until all are in place, so a failed write or move leaves
the table as it was; a run without rows is removed.
Other runs are neither read nor rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.functions.article_rules import index_content
from gapscope.functions.text import snippet


@dataclass(frozen=True)
class TableRule:
    """Natural key of a table and the columns a repeated write changes."""

    keys: tuple[str, ...]
    updates: tuple[str, ...]


TICKET_KEY = ("source", "source_id", "run_id")
RULES: Mapping[str, TableRule] = {
    "ticket_embeddings": TableRule(
        TICKET_KEY, ("problem_vec", "res_vec", "quality_pass", "res_word_count", "evidence_tier")
    ),
    "ticket_coverage": TableRule(TICKET_KEY, ("max_kb_sim", "best_kb_id", "best_kb_title", "coverage")),
    "cluster_sweep": TableRule(("run_id", "k"), ("inertia", "silhouette", "is_best_k")),
    "clusters": TableRule(
        ("cluster_id", "run_id"),
        ("cluster_label", "size", "centroid", "gap_flag", "max_kb_sim", "pca_x", "pca_y", "intra_sim"),
    ),
    "cluster_assignments": TableRule(TICKET_KEY, ("cluster_id", "cluster_label")),
    "cluster_kb_sim": TableRule(("run_id", "cluster_id", "kb_idx"), ("similarity", "kb_title")),
    "gap_analysis": TableRule(
        ("cluster_id", "run_id"),
        ("cluster_label", "size", "top_terms", "max_kb_sim", "avg_top3_sim", "n_above_p75",
         "coverage_score", "priority_score", "gap_flag", "recommendation", "best_kb_title", "best_kb_idx"),
    ),
    "kb_utilization": TableRule(
        ("kb_idx", "run_id"),
        ("title", "clusters_as_best", "max_cluster_sim", "mean_cluster_sim", "breadth_count", "status"),
    ),
    "kb_search_index": TableRule(TICKET_KEY, ("embedding", "title")),
}

# Tables with rows of a run, children before parents.
RUN_TABLES = (
    "chat_feedback", "chat_messages", "chat_sessions", "kb_validation_results", "pii_findings",
    "bias_audit", "generated_kb_articles", "evaluation_results", "coverage_delta",
    "service_gap_distribution", "gap_analysis", "kb_utilization", "cluster_kb_matches",
    "cluster_kb_sim", "cluster_assignments", "cluster_sweep", "ticket_coverage", "clusters",
    "kb_search_index", "ticket_embeddings",
)
CLUSTER_STEP_TABLES = (
    "cluster_assignments", "cluster_kb_sim", "cluster_sweep", "clusters", "ticket_coverage",
)


def upsert(
    current: DataFrame, incoming: DataFrame, keys: Sequence[str], updates: Sequence[str]
) -> DataFrame:
    """Rows of both; where a key is in both, the ``updates`` columns are the incoming ones.

    Only runs that occur in ``incoming`` come out: those are the partitions to write.
    """
    if "run_id" in keys:
        current = current.join(incoming.select("run_id").distinct(), "run_id", "left_semi")
    old = current.withColumn("__old", F.lit(True)).alias("o")
    new = incoming.withColumn("__new", F.lit(True)).alias("n")
    both = old.join(new, list(keys), "full_outer")

    def pick(c: str):
        if c in keys:
            return F.col(c)
        if c not in incoming.columns:
            return F.col(f"o.{c}").alias(c)
        fresh = F.col("n.__new").isNotNull()
        if c not in updates:
            fresh = fresh & F.col("o.__old").isNull()
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[pick(c) for c in current.columns])


def upsert_table(name: str, current: DataFrame, incoming: DataFrame) -> DataFrame:
    rule = RULES[name]
    return upsert(current, incoming, rule.keys, rule.updates)


def _folders(spark: SparkSession, path: str):
    """The store's file system and the partition folders of a table by run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(place) if files.exists(place) else []
    return files, {unquote(f.getPath().getName().removeprefix("run_id=")): f.getPath() for f in found if f.getPath().getName().startswith("run_id=")}


def stage(df: DataFrame, path: str) -> str:
    """Write ``df`` beside the table at ``path``; ``put`` moves it there."""
    staged = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.partitionBy("run_id").parquet(staged)
    return staged


class StuckMove(OSError):
    """A partition that could not be moved back; its rows stay in the folder that the message names."""


def _move(files, source, target) -> None:
    """Rename, or say that the store did not: some stores return false and leave things as they were."""
    if not files.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def _undo(made: Sequence[tuple]) -> None:
    for files, source, target in reversed(made):
        try:
            _move(files, target, source)
        except Exception as error:
            raise StuckMove(f"rows that belong to {source} are in {target}") from error


def _delete(folders: Sequence[tuple]) -> None:
    for files, folder in folders:
        files.delete(folder, True)


def put(spark: SparkSession, staged: str | None, path: str, runs: Sequence[str] | None = None) -> None:
    """Replace the partitions of ``runs`` (by default the staged ones) by what was staged."""
    put_all(spark, [(staged, path, runs)])


def put_all(spark: SparkSession, tables: Sequence[tuple[str | None, str, Sequence[str] | None]]) -> None:
    """``put`` for several (staged, path, runs), all or none.

    Old partitions are moved aside, new ones in; only when all are in place is anything deleted.
    If a move fails, those made are undone, so every run has its old rows or its new ones.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path
    made, spare = [], [(_folders(spark, staged)[0], place(staged)) for staged, _, _ in tables if staged]
    try:
        for staged, path, runs in tables:
            files, old = _folders(spark, path)
            new = _folders(spark, staged)[1] if staged else {}
            aside = f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"
            spare.append((files, place(aside)))
            files.mkdirs(place(path))
            for run in runs if runs is not None else new:
                moves = [(old[run], place(aside, old[run].getName()))] if run in old else []
                moves += [(new[run], place(path, new[run].getName()))] if run in new else []
                for source, target in moves:
                    files.mkdirs(target.getParent())
                    _move(files, source, target)
                    made.append((files, source, target))
    except Exception:
        _undo(made)  # where this fails too, nothing is deleted
        _delete(spare)
        raise
    _delete(spare)


def write_runs(df: DataFrame, path: str, runs: Sequence[str] | None = None) -> None:
    """Replace the partitions of ``runs``, by default those in ``df``; other runs stay.

    A run that is named and has no rows in ``df`` is removed from the store.
    """
    put(df.sparkSession, stage(df, path), path, runs)


def drop_run(spark: SparkSession, folder: str, names: Sequence[str], run_id: str) -> None:
    """Remove a run from the stored tables, in the given order."""
    for name in names:
        put(spark, None, f"{folder}/{name}", [run_id])


def sweep_rows(swept: DataFrame) -> DataFrame:
    """Sweep as stored: inertia to one decimal, silhouette to six."""
    return swept.select(
        "run_id", "k", F.round("inertia", 1).alias("inertia"),
        F.round("silhouette", 6).alias("silhouette"), "is_best_k",
    )


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """Cluster-by-article table as stored: six decimals, 300 characters of title."""
    return matrix.select(
        "run_id", "cluster_id", "kb_idx",
        snippet(F.col("kb_title"), 300).alias("kb_title"), F.round("sim", 6).alias("similarity"),
    )


def existing_entries(articles: DataFrame, runs: DataFrame) -> DataFrame:
    """Search-index rows of the existing articles for each of ``runs``.

    ``runs`` is a one-column table of the runs to seed (one, as a rule).
    """
    entry = articles.select(
        F.lit("existing").alias("source"), F.col("id").cast("string").alias("source_id"),
        F.coalesce("title", F.lit("")).alias("title"), F.lit(None).cast("string").alias("category"),
        index_content(F.col("title"), F.col("issue"), F.col("solution")).alias("content"),
        F.col("kb_vec").alias("embedding"), F.lit(False).alias("is_generated"),
    )
    seeds = runs.select("run_id").distinct().agg(F.collect_set("run_id").alias("run_id")).scalar()
    return entry.withColumn("run_id", F.explode(seeds))


def generated_entries(articles: DataFrame) -> DataFrame:
    """Search-index rows of the drafts that have a vector."""
    return articles.where(F.col("article_embedding").isNotNull()).select(
        F.lit("generated").alias("source"), F.col("cluster_id").cast("string").alias("source_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("category", F.lit("Other")).alias("category"),
        index_content(F.col("problem_statement"), F.array_join("resolution_steps", " ")).alias("content"),
        F.col("article_embedding").alias("embedding"), F.lit(True).alias("is_generated"), "run_id",
    )


def replace_rows(current: DataFrame, fresh: DataFrame, stale) -> DataFrame:
    """Content after dropping the ``stale`` rows and adding ``fresh``."""
    return current.where(~F.coalesce(stale, F.lit(False))).unionByName(fresh.select(*current.columns))


def replace_generated(index: DataFrame, articles: DataFrame) -> DataFrame:
    """Index with the generated entries of the articles' runs rebuilt."""
    fresh = generated_entries(articles)
    runs = articles.select("run_id").distinct().withColumn("__hit", F.lit(True))
    marked = index.join(runs, "run_id", "left")
    kept = marked.where(F.col("__hit").isNull() | (F.col("source") != "generated")).drop("__hit")
    return kept.unionByName(fresh.select(*kept.columns))


def reindex_counts(index: DataFrame, articles: DataFrame) -> DataFrame:
    """Per run: drafts in all, entries dropped, entries added by a rebuild."""
    drafts = articles.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count("article_embedding").alias("inserted")
    )
    dropped = index.where(F.col("source") == "generated").groupBy("run_id").agg(F.count("*").alias("deleted"))
    return drafts.join(dropped, "run_id", "left").select(
        "run_id", "total", F.coalesce("deleted", F.lit(0)).alias("deleted"), "inserted"
    )


def replace_articles(
    articles: DataFrame, results: DataFrame, fresh: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Articles with the runs of ``fresh`` replaced, and results without their dependents."""
    runs = fresh.select("run_id").distinct()
    gone = articles.join(runs, "run_id", "left_semi").select("article_id")
    kept_results = results.join(gone, "article_id", "left_anti")
    kept = articles.join(runs, "run_id", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns)), kept_results


def replace_metrics(metrics: DataFrame, fresh: DataFrame, category: str = "validation") -> DataFrame:
    """Metrics with those of one category replaced for the runs of ``fresh``."""
    runs = fresh.select("run_id").distinct().withColumn("__hit", F.lit(True))
    marked = metrics.join(runs, "run_id", "left")
    kept = marked.where(F.col("__hit").isNull() | (F.col("category") != category)).drop("__hit")
    return kept.unionByName(fresh.select(*kept.columns))


def purge_run(tables: Mapping[str, DataFrame], run_id: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The named tables without the rows of a run."""
    return {n: tables[n].where(F.col("run_id") != run_id) for n in names if n in tables}


def delete_run(
    ledger: DataFrame, tables: Mapping[str, DataFrame], run_id: str
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Ledger and child tables without a run, children first, and the ledger rows removed."""
    removed = ledger.where(F.col("run_id") == run_id).agg(F.count("*").alias("removed"))
    return ledger.where(F.col("run_id") != run_id), purge_run(tables, run_id, RUN_TABLES), removed


def patch_articles(articles: DataFrame, patches: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Articles with the non-null fields of matching patches; ``patched`` tells which changed."""
    keys = ["run_id", "cluster_id"]
    asked = F.lit(False)
    for f in fields:
        asked = asked | F.col(f).isNotNull()
    given = patches.where(asked).select(*keys, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__p"))
    joined = articles.join(given, keys, "left")
    return joined.select(
        *[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in articles.columns],
        F.col("__p").isNotNull().alias("patched"),
    )


def flag_for_review(articles: DataFrame, flagged: DataFrame) -> DataFrame:
    """Set ``needs_review`` where the article id is in ``flagged``; never clear it."""
    ids = flagged.select("article_id").distinct().withColumn("__f", F.lit(True))
    joined = articles.join(ids, "article_id", "left")
    return joined.select(
        *[(F.col(c) | F.col("__f").isNotNull()).alias(c) if c == "needs_review" else F.col(c)
          for c in articles.columns]
    )
