"""The given tables in the parts this engine works on.

A knowledge-base article is a document labelled as good that has a vector; every
other vector is a ticket's. Orders play the tickets that have dates and groups,
conversations the work orders with mail text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.functions.text import gap_class
from gapscope.functions.vectors import as_doubles
from gapscope.operators.labelling import TICKET_STOP_WORDS
from gapscope.sources.tables import spread

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
# Bounds that give every class some rows on these 64-number vectors.
COVERED, PARTIAL = 0.40, 0.34
CLUSTER_COVERED, CLUSTER_PARTIAL = 0.34, 0.30
DUPLICATE = 0.10
ALIGNED = 0.17
NOVEL_CRITICAL, NOVEL_OTHER = 0.40, 0.45
SIZE_COVERED, SIZE_PARTIAL = 0.53, 0.48
STOP_WORDS = tuple(
    sorted({*TICKET_STOP_WORDS, "the", "and", "that", "for", "with", "are", "was", "les", "des", "und", "der", "die", "los", "las", "que"})
)


class Tables:
    """Lazy access to the given tables and the roles drawn from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        """Documents spread over the cores, for work on their texts."""
        return spread(self.raw("documents"), "doc_id")

    # --- vectors -------------------------------------------------------------

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", as_doubles(F.col("embedding")).alias("vec"), F.col("label").cast("long").alias("label")
        )

    def kb(self) -> DataFrame:
        """kb_id, title, issue, solution, kb_vec, run_id"""
        good = self.raw("labels").where("quality = 1").select("doc_id")
        docs = self.raw("documents").join(good, "doc_id")
        return docs.join(self.vectors(), F.col("doc_id") == F.col("vec_id")).select(
            F.col("doc_id").alias("kb_id"),
            F.split("text", "\n", 2)[0].alias("title"),
            F.concat_ws(" ", "lang", "source").alias("issue"),
            F.col("text").alias("solution"),
            F.col("vec").alias("kb_vec"),
            F.col("lang").alias("run_id"),
        )

    def ticket_vectors(self) -> DataFrame:
        """ticket_id, source, cluster_id, problem_vec, res_vec (null where the next is no ticket)"""
        kb = self.raw("labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
        own = self.vectors().join(kb, "vec_id", "left_anti")
        after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("res_vec"))
        lang = self.raw("documents").select(F.col("doc_id").alias("vec_id"), "lang")
        return own.join(after, "vec_id", "left").join(lang, "vec_id", "left").select(
            F.col("vec_id").alias("ticket_id"),
            F.when(F.col("lang") == "en", "incident").otherwise("workorder").alias("source"),
            F.col("label").alias("cluster_id"),
            F.col("vec").alias("problem_vec"),
            "res_vec",
        )

    # --- tickets with dates and groups --------------------------------------

    def tickets(self) -> DataFrame:
        segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
        joined = (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        )
        price = F.col("o_totalprice")
        return joined.select(
            F.year("o_orderdate").cast("string").alias("run_id"),
            F.when(F.col("o_orderstatus") == "P", "workorder").otherwise("incident").alias("source"),
            F.col("o_orderkey").cast("string").alias("source_id"),
            (F.col("c_nationkey").cast("long") * 5 + segment).alias("cluster_id"),
            F.concat_ws(" / ", "n_name", "c_mktsegment").alias("cluster_label"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Unknown")
            .otherwise(F.col("o_orderpriority")).alias("service_type"),
            F.col("n_name").alias("assigned_group"),
            F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("ticket_number"),
            F.col("o_orderdate").alias("reported_date"),
            F.when(price < 20000, None).when(price >= 375000, 1).when(price >= 250000, 2)
            .when(price >= 125000, 3).otherwise(4).alias("evidence_tier"),
            price.alias("price"),
            "o_orderkey", "o_custkey", "c_nationkey",
        )

    def assignments(self) -> DataFrame:
        return self.tickets().select(
            "run_id", "source", "source_id", "cluster_id", "cluster_label", "service_type",
            "assigned_group", "ticket_number",
        )

    def ticket_rows(self) -> DataFrame:
        return self.tickets().select(
            "run_id", "source", "source_id", "evidence_tier", (F.col("price") >= 20000).alias("quality_pass")
        )

    def incidents(self) -> DataFrame:
        return self._source("incident", "resolution_summary")

    def workorders(self) -> DataFrame:
        return self._source("workorder", "activity_logs_text")

    def _source(self, source: str, resolution: str) -> DataFrame:
        t = self.tickets().where(F.col("source") == source)
        detail = self.raw("documents").select(F.col("doc_id").alias("o_orderkey"), F.col("text").alias("detailed_description"))
        answer = self.raw("documents").select(F.col("doc_id").alias("o_custkey"), F.col("text").alias(resolution))
        return t.join(detail, "o_orderkey", "left").join(answer, "o_custkey", "left").select(
            F.col("source_id").alias("id"), "ticket_number", "service_type", "assigned_group", "reported_date",
            F.concat_ws(" ", "service_type", "assigned_group").alias("description"),
            "detailed_description", resolution,
        )

    def clusters(self) -> DataFrame:
        """run_id, cluster_id, cluster_label, size, max_kb_sim, gap_flag, merged_into, summary"""
        from pyspark.sql import Window

        sized = self.tickets().groupBy("run_id", "cluster_id", "cluster_label", "c_nationkey").agg(
            F.count("*").alias("size"), F.round(F.avg("price") / 500000, 4).alias("max_kb_sim")
        )
        w = Window.partitionBy("run_id", "c_nationkey").orderBy(F.desc("size"), "cluster_id")
        first = F.first("cluster_id").over(w)
        ranked = sized.withColumn("place", F.row_number().over(w)).withColumn("first", first)
        dup = F.col("place") == 5
        return ranked.select(
            "run_id", "cluster_id", "cluster_label", "size", "max_kb_sim",
            F.when(dup, "DUPLICATE").otherwise(gap_class(F.col("max_kb_sim"), SIZE_COVERED, SIZE_PARTIAL)).alias("gap_flag"),
            F.when(dup, F.col("first")).alias("merged_into"),
            F.when(F.col("place") <= 3, F.concat(F.col("cluster_label"), F.lit(" summary"))).otherwise("").alias("summary"),
        )

    def gaps(self) -> DataFrame:
        """Gap rows: clusters with priority, best article and recommendation."""
        from gapscope.functions.text import duplicate_recommendation, recommendation

        kb = self.kb().select(F.col("kb_id").alias("cluster_id"), F.col("kb_id").alias("best_kb_id"), F.col("title").alias("best_kb_title"))
        c = self.clusters()
        top = c.groupBy("run_id").agg(F.max("size").alias("top"))
        text = F.when(
            F.col("gap_flag") == "DUPLICATE", duplicate_recommendation(F.col("merged_into"), F.lit("same"))
        ).otherwise(recommendation(F.col("gap_flag"), F.col("cluster_label"), F.col("best_kb_title")))
        return c.join(kb, "cluster_id", "left").join(top, "run_id").select(
            "run_id", "cluster_id", "cluster_label", "size", "max_kb_sim", "gap_flag", "merged_into",
            F.round(F.col("size") / F.col("top"), 4).alias("priority_score"), "best_kb_id", "best_kb_title",
            text.alias("recommendation"),
        )

    def runs(self) -> DataFrame:
        first, last = F.min("o_orderdate"), F.max("o_orderdate")
        year = F.year("o_orderdate")
        status = F.when(F.col("last") < F.make_date("y", F.lit(12), F.lit(31)), "running").when(
            F.col("started_at") > F.make_date("y", F.lit(1), F.lit(1)), "failed"
        ).otherwise("complete")
        return (
            self.raw("orders").groupBy(year.alias("y")).agg(first.alias("started_at"), last.alias("last"))
            .select(F.col("y").cast("string").alias("run_id"), "started_at", status.alias("status"))
        )

    # --- texts ---------------------------------------------------------------

    def texts(self) -> DataFrame:
        """Every text of the given tables: text_id, text"""
        doc = self.documents().select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text")
        page = spread(self.raw("pages"), "page_id").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("text_id"), F.col("html").alias("text"))
        item = self.raw("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("text_id"), "text")
        mail = self.mails().select(F.concat(F.lit("m"), F.col("id")).alias("text_id"), F.col("mail").alias("text"))
        return doc.unionByName(page).unionByName(item).unionByName(mail)

    def mails(self) -> DataFrame:
        """One mail per conversation turn: id, conv_id, turn, role, text, mail"""
        c = spread(self.raw("conversations"), "conv_id", "turn")
        opening = F.when(F.col("role") == "system", "Please see related REQ for any additional information\n").otherwise("")
        number = F.col("conv_id").cast("string")
        body = F.concat(
            F.lit("From: "), F.col("role"), F.lit("\nSubject: Case "), number, F.lit("\n"), opening,
            F.col("text"), F.lit("\n*** ***\nG0000"), number, F.lit(" call 202-555-0"), F.lpad(number, 3, "0"),
            F.lit("\nOn the day after the user wrote:\n> "), F.col("role"),
            F.lit("\nSent from my phone\n-----Original message-----\n"), F.col("text"),
        )
        return c.select(
            F.concat_ws("-", number, F.col("turn").cast("string")).alias("id"),
            "conv_id", "turn", "role", "text", body.alias("mail"),
        )

    # --- inputs of the first step -------------------------------------------

    def incident_inputs(self) -> DataFrame:
        """Documents as incidents: subject = first line, answer = next document."""
        d, v = self.raw("documents"), self.vectors()
        nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("resolution_summary"))
        at = lambda shift, name: v.select((F.col("vec_id") - shift).alias("doc_id"), F.col("vec").alias(name))
        return (
            d.join(nxt, "doc_id", "left").join(at(0, "e_description"), "doc_id", "left")
            .join(at(1, "e_detailed_description"), "doc_id", "left").join(at(2, "e_resolution_summary"), "doc_id", "left")
            .select(
                F.col("doc_id").cast("string").alias("id"), F.split("text", "\n", 2)[0].alias("description"),
                F.col("text").alias("detailed_description"), "resolution_summary",
                "e_description", "e_detailed_description", "e_resolution_summary",
            )
        )

    def workorder_inputs(self) -> DataFrame:
        """Mails as work orders; the vector of the cleaned text is taken as already computed."""
        v = self.vectors()
        at = lambda name: v.select(F.col("vec_id").alias("__at"), F.col("vec").alias(name))
        m = self.mails()
        return (
            m.withColumn("__at", F.col("conv_id")).join(at("e_description"), "__at", "left").drop("__at")
            .withColumn("__at", F.col("conv_id") + F.col("turn")).join(at("e_activity_logs"), "__at", "left").drop("__at")
            .withColumn("__at", F.col("conv_id") + 2 * F.col("turn")).join(at("e_clean"), "__at", "left").drop("__at")
            .select("id", F.col("mail").alias("detailed_description"), F.col("text").alias("activity_logs_text"),
                    "e_description", "e_activity_logs", "e_clean")
        )

    # --- articles ------------------------------------------------------------

    def articles(self) -> DataFrame:
        """Labelled documents as drafts; the language is the run, the label the quality."""
        d = self.raw("documents").join(self.raw("labels"), "doc_id")
        v = self.vectors().select(F.col("vec_id").alias("doc_id"), F.col("vec").alias("article_embedding"), "label")
        steps = F.filter(F.split("text", "\n"), lambda s: s != "")
        return d.join(v, "doc_id", "left").select(
            F.col("lang").alias("run_id"), F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("article_id"),
            F.col("doc_id").alias("cluster_id"), F.split("text", "\n", 2)[0].alias("title"),
            F.col("source").alias("category"), F.col("text").alias("problem_statement"), steps.alias("resolution_steps"),
            F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("Escalate to "), F.col("source"))).alias("escalation_trigger"),
            F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"),
            F.when(F.col("toxic") == 0, F.concat(F.lit("See "), F.col("source"), F.lit(" --- • desk "), F.col("lang"), F.lit(" • Need more help? •"))).alias("additional_notes"),
            F.when(F.col("quality") == 1, "CRITICAL").otherwise("PARTIAL").alias("gap_flag"),
            "article_embedding", F.col("label").alias("article_label"), "quality", "toxic",
        )

    def search_index(self) -> DataFrame:
        """Existing articles and drafts of low quality, per language."""
        from gapscope.functions.article_rules import index_content

        old = self.kb().select(
            "run_id", F.lit("existing").alias("source"), F.col("kb_id").cast("string").alias("source_id"), "title",
            F.lit("").alias("category"), index_content(F.col("title"), F.col("issue"), F.col("solution")).alias("content"),
            F.col("kb_vec").alias("embedding"), F.lit(False).alias("is_generated"),
        )
        a = self.articles().where("quality = 0")
        new = a.where(F.col("article_embedding").isNotNull()).select(
            "run_id", F.lit("generated").alias("source"), F.col("cluster_id").cast("string").alias("source_id"), "title",
            "category", index_content(F.col("problem_statement"), F.array_join("resolution_steps", " ")).alias("content"),
            F.col("article_embedding").alias("embedding"), F.lit(True).alias("is_generated"),
        )
        return old.unionByName(new)

    def questions(self) -> DataFrame:
        """Last user turn per conversation with the vector and language of the same number."""
        c = self.raw("conversations")
        last = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("turn"))
        v = self.vectors().select(F.col("vec_id").alias("conv_id"), F.col("vec").alias("query_vec"))
        lang = self.raw("documents").select(F.col("doc_id").alias("conv_id"), F.col("lang").alias("run_id"))
        return last.join(v, "conv_id").join(lang, "conv_id")


