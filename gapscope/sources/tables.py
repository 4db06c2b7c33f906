"""Source tables: tickets of two kinds, knowledge-base articles, per-run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscope.functions.text import first_text
from gapscope.functions.vectors import as_doubles, combine, normalise, parse_vector


def _struct(**fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields.items()])


INCIDENTS = _struct(
    id="string", ticket_number="string", service_type="string", assigned_group="string",
    assigned_support_company="string", assigned_support_organization="string", impact="string",
    urgency="string", reported_source="string", reported_date="timestamp", resolved_date="timestamp",
    description="string", detailed_description="string", resolution_summary="string",
    pii_detected="boolean", e_description="string", e_detailed_description="string",
    e_resolution_summary="string",
)
WORKORDERS = _struct(
    id="string", ticket_number="string", service_type="string", assigned_group="string",
    status="string", description="string", detailed_description="string",
    activity_logs_text="string", e_description="string", e_activity_logs="string",
)
ARTICLES = _struct(
    id="string", title="string", issue="string", solution="string", e_title="string", e_solution="string"
)
INCIDENT_META = (
    "id", "ticket_number", "service_type", "assigned_group", "assigned_support_company", "impact",
    "urgency", "reported_source", "reported_date", "resolved_date", "resolution_summary",
    "pii_detected", "description",
)
WORKORDER_META = (
    "id", "ticket_number", "service_type", "assigned_group", "status", "activity_logs_text",
    "detailed_description",
)


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """A table with its declared schema; only the columns asked for reach the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Spread a plain scan of fewer splits than cores over the cores.

    Work per text is heavy on the processor, and one unsplittable file would keep it on
    one core. A scan with enough splits, as any large table has, is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def text_ranges(column: str, length: int = 1, alphabet: str = "0123456789abcdef") -> list[str]:
    """SQL conditions that together select every row once, by ranges of a text id.

    The ranges begin at the prefixes of ``length`` characters; ids before the first, after
    the last, or null are covered too.
    """
    starts = [""]
    for _ in range(length):
        starts = [s + c for s in starts for c in sorted(alphabet)]
    first = f"{column} < '{starts[0]}' OR {column} IS NULL"
    inner = [f"{column} >= '{low}' AND {column} < '{high}'" for low, high in zip(starts, starts[1:])]
    return [first, *inner, f"{column} >= '{starts[-1]}'"]


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    columns: Sequence[str] | None = None,
    split_on: str | None = None,
    splits: int = 32,
    bounds: tuple[str, str] | None = None,
    predicates: Sequence[str] | None = None,
    **properties: str,
) -> DataFrame:
    """The same table from its database, read in parallel.

    ``split_on`` with ``bounds`` cuts a numeric or time column into ranges; ``predicates``
    (see ``text_ranges``) give one task each and suit text ids.
    """
    if predicates:
        df = spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(properties))
        return df.select(*columns) if columns else df
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split_on and bounds:
        reader = (
            reader.option("partitionColumn", split_on)
            .option("numPartitions", splits)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
        )
    df = reader.options(**properties).load()
    return df.select(*columns) if columns else df


def _vector(df: DataFrame, name: str) -> Column:
    """Vector column stored as an array or as JSON text."""
    return parse_vector(F.col(name)) if df.schema[name].dataType == T.StringType() else as_doubles(F.col(name))


def with_vectors(df: DataFrame, *names: str) -> DataFrame:
    """Parse the named vector columns; each gets ``has_<name>`` beside it."""
    for name in names:
        df = df.withColumn(name, _vector(df, name)).withColumn(f"has_{name}", F.col(name).isNotNull())
    return df


def blended(
    df: DataFrame, first: str, second: str, wa: float = 0.4, wb: float = 0.6, name: str = "vector"
) -> DataFrame:
    """Blend of two vector columns and ``has_<name>``."""
    out = df.withColumn(name, combine(_vector(df, first), _vector(df, second), wa, wb))
    return out.withColumn(f"has_{name}", F.col(name).isNotNull())


def kb_articles(articles: DataFrame) -> DataFrame:
    """Articles that have a vector: even blend of title and solution, length one."""
    out = blended(articles, "e_title", "e_solution", 0.5, 0.5, "kb_vec").where("has_kb_vec")
    return out.select("id", "title", "issue", "solution", normalise(F.col("kb_vec")).alias("kb_vec"))


def kb_entries(index: DataFrame, articles: DataFrame) -> DataFrame:
    """Existing articles from the search index, one per article, plus those not indexed yet.

    ``articles`` comes from ``kb_articles``. An article indexed by several runs counts
    once, with the entry of the latest run.
    """
    kept = (
        index.where(~F.col("is_generated") & F.col("embedding").isNotNull())
        .groupBy(F.col("source_id").alias("id"))
        .agg(F.max_by(F.struct("title", "category", "embedding"), F.col("run_id").cast("string")).alias("e"))
        .select("id", "e.title", "e.category", normalise(as_doubles(F.col("e.embedding"))).alias("kb_vec"))
    )
    rest = articles.withColumn("id", F.col("id").cast(kept.schema["id"].dataType)).join(
        kept.select("id"), "id", "left_anti"
    )
    return kept.unionByName(
        rest.select("id", "title", F.lit(None).cast("string").alias("category"), "kb_vec")
    )


def unified_tickets(incidents: DataFrame, workorders: DataFrame) -> DataFrame:
    """Both kinds of ticket with one name each for problem and resolution text."""

    def shape(df: DataFrame, source: str, resolution: str) -> DataFrame:
        return df.select(
            F.lit(source).alias("source"),
            F.col("id").cast("string").alias("source_id"),
            "ticket_number",
            "service_type",
            "assigned_group",
            first_text(F.col("detailed_description"), F.col("description")).alias("problem_text"),
            F.col(resolution).alias("resolution_text"),
        )

    return shape(incidents, "incident", "resolution_summary").unionByName(
        shape(workorders, "workorder", "activity_logs_text")
    )


def run_tickets(embeddings: DataFrame, tickets: DataFrame, run_id: str | None = None) -> DataFrame:
    """Usable ticket vectors of a run (or of every run) with their texts."""
    kept = embeddings.where("quality_pass")
    if run_id is not None:
        kept = kept.where(F.col("run_id") == run_id)
    return kept.join(tickets, ["source", "source_id"])


def of_run(table: DataFrame, run_id: str, *columns: str) -> DataFrame:
    kept = table.where(F.col("run_id") == run_id)
    return kept.select(*columns) if columns else kept


def live_articles(articles: DataFrame) -> DataFrame:
    """Drafts that are no duplicate and have a vector."""
    return articles.where(F.col("is_duplicate_of").isNull() & F.col("article_embedding").isNotNull())


def critical_with_summary(clusters: DataFrame) -> DataFrame:
    return clusters.where((F.col("gap_flag") == "CRITICAL") & (F.col("summary") != "")).orderBy(
        F.desc("size"), "cluster_id"
    )


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))
