"""Connected components of a link table, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import cut, drop_table


def components(links: DataFrame) -> DataFrame:
    """(node, component_id) of every node that ``links`` (a, b) name; the id is the smallest node.

    Each round every node takes the smallest label among its own and its neighbours', and
    then the label of that label, so chains shorten by half. Labels only fall; the loop ends
    when none did. Links to itself do no harm. Every round is a table in the shared folder.
    """
    spark = links.sparkSession
    both = cut(links.where(F.col("a") != F.col("b")).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        spread = cut(labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "m").alias("new")))
        heads = spread.select(F.col("node").alias("h"), F.col("new").alias("top"))
        # A label need not have a row of its own in a plain join: every label is a node here.
        jumped = cut(spread.join(heads, F.col("new") == F.col("h")).select("node", F.col("top").alias("label"), (F.col("top") < F.col("label")).alias("fell")))
        changed = not jumped.where("fell").isEmpty()
        drop_table(spark, labels, spread)
        labels = jumped.drop("fell")
        if not changed:
            drop_table(spark, both)
            return labels.select("node", F.col("label").alias("component_id"))
