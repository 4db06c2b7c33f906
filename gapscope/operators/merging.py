"""Duplicate clusters and duplicate articles.

The rules are greedy and ordered. Each is restated as a table that is refined
until it stops changing, so no run is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscope.config import Thresholds
from gapscope.operators.rounds import cut, differs
from gapscope.operators.similarity import SIM, Cell, Side, compare

RUN = ("run_id",)


def greedy_merges(
    accepted: DataFrame, sizes: DataFrame, by: Sequence[str] = RUN
) -> DataFrame:
    """``(by, cluster_id, merged_into, reason)`` of accepted pairs ``(a, b, sim)``.

    Pairs are taken by falling similarity. A pair counts only while neither side has
    been merged away; the larger cluster stays (``a`` when equal). A cluster is merged
    by its first pair whose larger side is still there at that point, and the larger
    side only depends on still larger ones, so the table below settles in as many
    rounds as the longest chain of ever larger clusters.
    """
    by = list(by)
    size = lambda side: sizes.select(*by, F.col("cluster_id").alias(side), F.col("size").alias(f"__{side}"))
    a_stays = F.col("__a") >= F.col("__b")
    pairs = (
        accepted.join(size("a"), [*by, "a"])
        .join(size("b"), [*by, "b"])
        .select(
            *by,
            F.when(a_stays, F.col("b")).otherwise(F.col("a")).alias("cluster_id"),
            F.when(a_stays, F.col("a")).otherwise(F.col("b")).alias("merged_into"),
            F.struct((-F.col("sim")).alias("s"), "a", "b").alias("__turn"),
            "reason",
        )
    )
    pairs = cut(pairs)

    def settle(gone: DataFrame) -> DataFrame:
        left_at = gone.select(
            *by, F.col("cluster_id").alias("merged_into"), F.col("__turn").alias("__left_at")
        )
        live = pairs.join(left_at, [*by, "merged_into"], "left").where(
            F.col("__left_at").isNull() | (F.col("__left_at") > F.col("__turn"))
        )
        first = F.min_by(F.struct("__turn", "merged_into", "reason"), F.col("__turn"))
        return live.groupBy(*by, "cluster_id").agg(first.alias("__f")).select(*by, "cluster_id", "__f.*")

    gone = pairs.where(F.lit(False)).select(*by, "cluster_id", "__turn", "merged_into", "reason")
    while True:
        new = cut(settle(gone))
        if not differs(new.drop("reason"), gone.drop("reason")):
            return new.select(*by, "cluster_id", "merged_into", "reason")
        gone = new


def merge_by_asking(
    clusters: DataFrame,
    decide: Callable[[DataFrame], DataFrame],
    bound: float = Thresholds.duplicate_candidate,
    *,
    batch: int = 4,
    by: Sequence[str] = RUN,
    **layout,
) -> DataFrame:
    """``greedy_merges`` over all pairs of ``clusters`` above ``bound``, asking as few as needed.

    ``clusters`` has ``by``, cluster_id, size and centroid; ``decide`` turns pairs
    ``(by, a, b, sim)`` into the accepted ones with a ``reason``. A cluster can only be
    merged by its pairs with larger clusters, and only the first that holds counts. So
    each round every cluster not merged yet brings its next few such pairs in turn order
    (twice as many each round); a merged one brings no more. The result is that of asking
    about every pair, yet a crowd of alike clusters never makes all its pairs.
    """
    by = list(by)
    base = cut(clusters.where(F.col("centroid").isNotNull()).select(
        *by, F.col("cluster_id").cast("long").alias("cluster_id"), F.col("size").cast("long").alias("size"), "centroid"
    ))
    mates = base.select(*by, F.col("cluster_id").alias("mate"), F.col("size").alias("mate_size"), "centroid")
    far_back = {"last_s": F.lit(-9.0), "last_a": F.lit(-1).cast("long"), "last_b": F.lit(-1).cast("long")}
    state = base.withColumns({**far_back, "done": F.lit(False), "live": F.lit(True)})
    accepted = None
    while not (live := state.where("live").drop("done", "live")).isEmpty():

        def next_pairs(cell: Cell, n: int = batch):
            v, u = cell.left_values("cluster_id")[:, None], cell.right_values("mate")[None, :]
            size, mate_size = cell.left_values("size")[:, None], cell.right_values("mate_size")[None, :]
            s, lo, hi = -cell.sim, np.minimum(u, v), np.maximum(u, v)
            ls, la, lb = (cell.left_values(c)[:, None] for c in ("last_s", "last_a", "last_b"))
            later = (s > ls) | ((s == ls) & ((lo > la) | ((lo == la) & (hi > lb))))
            larger = (mate_size > size) | ((mate_size == size) & (u < v))
            li, ri = np.nonzero((cell.sim > bound) & larger & later)
            rank = np.lexsort((hi[li, ri], lo[li, ri], s[li, ri], li))
            li, ri = li[rank], ri[rank]
            keep = np.arange(len(li)) - np.searchsorted(li, li, side="left") < n
            return li[keep], ri[keep], {"sim": cell.sim[li[keep], ri[keep]]}

        left = Side(live, "centroid", ["cluster_id", "size", "last_s", "last_a", "last_b"])
        hits = compare(left, Side(mates, "centroid", ["mate", "mate_size"]), next_pairs, SIM, by=by, **layout).rows
        turns = hits.select(
            *by, "cluster_id", (-F.col("sim")).alias("s"), F.least("cluster_id", "mate").alias("a"),
            F.greatest("cluster_id", "mate").alias("b"), "sim",
        )
        w = Window.partitionBy(*by, "cluster_id").orderBy("s", "a", "b")
        fresh = cut(turns.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= batch))
        if fresh.isEmpty():
            break
        news = decide(fresh.select(*by, "a", "b", "sim")).select(*by, "a", "b", "sim", "reason")
        accepted = cut(news if accepted is None else accepted.unionByName(news))
        # Merges found so far may fall again when their larger side turns out to be gone
        # earlier, so every cluster keeps its place and goes on from there.
        gone = greedy_merges(accepted, base, by).select(*by, "cluster_id", F.lit(True).alias("__gone"))
        reached = fresh.groupBy(*by, "cluster_id").agg(
            F.count("*").alias("__n"), F.max(F.struct("s", "a", "b")).alias("__last")
        )
        done = F.col("done") | (F.col("live") & (F.coalesce("__n", F.lit(0)) < batch))
        state = cut(
            state.join(reached, [*by, "cluster_id"], "left").join(gone, [*by, "cluster_id"], "left").select(
                *by, "cluster_id", "size", "centroid",
                *[F.coalesce(f"__last.{c}", f"last_{c}").alias(f"last_{c}") for c in ("s", "a", "b")],
                done.alias("done"), (~done & F.col("__gone").isNull()).alias("live"),
            )
        )
        batch *= 2
    if accepted is None:
        accepted = base.select(
            *by, F.col("cluster_id").alias("a"), F.col("cluster_id").alias("b"), F.lit(0.0).alias("sim"), F.lit("").alias("reason")
        ).limit(0)
    return greedy_merges(accepted, base, by)


def resolve_chains(merges: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Follow every pointer to its end; the reach doubles each round."""
    by = list(by)
    now = cut(merges.select(*by, "cluster_id", "merged_into"))
    while True:
        ahead = now.select(
            *by, F.col("cluster_id").alias("merged_into"), F.col("merged_into").alias("__end")
        )
        new = cut(
            now.join(ahead, [*by, "merged_into"], "left").select(
                *by, "cluster_id", F.coalesce("__end", "merged_into").alias("merged_into")
            )
        )
        if not differs(new, now):
            return new
        now = new


def move_tickets(
    assignments: DataFrame, merges: DataFrame, clusters: DataFrame, by: Sequence[str] = RUN
) -> DataFrame:
    """Assignments with the tickets of merged clusters under the remaining cluster."""
    by = list(by)
    target = merges.join(
        clusters.select(*by, F.col("cluster_id").alias("merged_into"), F.col("cluster_label").alias("__label")),
        [*by, "merged_into"],
        "left",
    )
    joined = assignments.join(target, [*by, "cluster_id"], "left")
    return joined.select(
        *[
            F.coalesce("merged_into", "cluster_id").alias(c) if c == "cluster_id"
            else F.when(F.col("merged_into").isNull(), F.col(c)).otherwise(F.col("__label")).alias(c)
            if c == "cluster_label" else F.col(c)
            for c in assignments.columns
        ]
    )


def merge_clusters(
    clusters: DataFrame, moved: DataFrame, merges: DataFrame, by: Sequence[str] = RUN
) -> DataFrame:
    """Cluster rows with sizes after the move; merged ones get size 0 and DUPLICATE."""
    by = list(by)
    counted = moved.groupBy(*by, "cluster_id").agg(F.count("*").alias("__new"))
    targets = merges.select(*by, F.col("merged_into").alias("cluster_id")).distinct().withColumn("__grew", F.lit(True))
    gone = merges.select(*by, "cluster_id").withColumn("__gone", F.lit(True))
    joined = (
        clusters.join(gone, [*by, "cluster_id"], "left")
        .join(targets, [*by, "cluster_id"], "left")
        .join(counted, [*by, "cluster_id"], "left")
    )
    size = F.when(F.col("__gone"), F.lit(0)).when(F.col("__grew"), F.col("__new")).otherwise(F.col("size"))
    flag = F.when(F.col("__gone"), "DUPLICATE").otherwise(F.col("gap_flag"))
    return joined.select(
        *[size.cast("long").alias(c) if c == "size" else flag.alias(c) if c == "gap_flag" else F.col(c)
          for c in clusters.columns]
    )


def repair_priority(
    gaps: DataFrame, merges: DataFrame, weight: float = 0.35, by: Sequence[str] = RUN
) -> DataFrame:
    """Sizes and priorities after merging, one merge after another by cluster id.

    At each merge the scaled volume of the remaining cluster is swapped for the new
    one. Chains are resolved beforehand, so a remaining cluster only grows and a
    merged one drops to zero once: the bounds of the scale follow from running
    maxima. Rows here are clusters, a number the driver already holds as centres.
    """
    by = list(by)
    sized = gaps.select(*by, "cluster_id", F.col("size").cast("double").alias("__own"))
    steps = merges.join(sized, [*by, "cluster_id"]).join(
        sized.select(*by, F.col("cluster_id").alias("merged_into"), F.col("__own").alias("__base")),
        [*by, "merged_into"],
    )
    order = Window.partitionBy(*by).orderBy("cluster_id")
    per_target = Window.partitionBy(*by, "merged_into").orderBy("cluster_id")
    steps = steps.withColumn("__t", F.row_number().over(order)).withColumn(
        "__new", F.col("__base") + F.sum("__own").over(per_target)
    ).withColumn("__old", F.col("__new") - F.col("__own"))
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    stay = sized.join(merges, [*by, "cluster_id"], "left_anti").groupBy(*by).agg(F.max("__own").alias("__stay"))
    first = steps.where(F.col("__t") == 1).select(*by, F.col("merged_into").alias("__first"))
    low = sized.join(first, by).groupBy(*by).agg(
        F.min("__own").alias("__low"),
        F.min(F.when(F.col("cluster_id") != F.col("__first"), F.col("__own"))).alias("__low_rest"),
    )
    steps = (
        steps.withColumn("__top_ahead", F.max("__own").over(ahead))
        .withColumn("__top_behind", F.max("__new").over(behind))
        .join(stay, by, "left")
        .join(low, by)
    )
    top_old = F.greatest("__stay", "__top_ahead", "__top_behind")
    top_new = F.greatest(top_old, "__new")
    low_old = F.when(F.col("__t") == 1, F.col("__low")).otherwise(0.0)
    low_new = F.when(F.col("__t") == 1, F.least("__low_rest", "__new")).otherwise(0.0)
    scaled = lambda x, lo, hi: F.coalesce((x - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
    change = weight * scaled(F.col("__new"), low_new, top_new) - weight * scaled(F.col("__old"), low_old, top_old)
    grown = steps.withColumn("__change", change).groupBy(*by, F.col("merged_into").alias("cluster_id")).agg(
        F.max("__new").alias("__size"),
        F.array_sort(F.collect_list(F.struct("__t", "__change"))).alias("__changes"),
    )
    gone = merges.select(*by, "cluster_id", "merged_into")
    joined = gaps.drop("merged_into").join(grown, [*by, "cluster_id"], "left").join(gone, [*by, "cluster_id"], "left")
    repaired = F.aggregate(
        "__changes", F.col("priority_score").cast("double"), lambda p, s: F.round(p + s["__change"], 4)
    )
    merged = F.col("merged_into").isNotNull()
    text = F.concat(
        F.lit("DUPLICATE: Merged into cluster "),
        F.col("merged_into").cast("string"),
        F.lit(". Tickets physically reassigned."),
    )
    new = {
        "size": F.when(merged, 0).otherwise(F.coalesce("__size", "size")).cast("long"),
        "priority_score": F.coalesce(repaired, F.col("priority_score")),
        "gap_flag": F.when(merged, "DUPLICATE").otherwise(F.col("gap_flag")),
        "recommendation": F.when(merged, text).otherwise(F.col("recommendation")),
    }
    kept = [new[c].alias(c) if c in new else F.col(c) for c in gaps.columns if c != "merged_into"]
    return joined.select(*kept, "merged_into")


UNDECIDED, ACTIVE, GONE = 0, 1, 2


def duplicate_articles(
    articles: DataFrame,
    *,
    key: str = "cluster_id",
    order: str = "position",
    quality: str = "quality_score",
    vector: str = "article_embedding",
    bound: float = Thresholds.article_duplicate,
    by: Sequence[str] = RUN,
    **layout,
) -> DataFrame:
    """``(by, key, duplicate_of)`` for every article that is a near copy of another.

    Articles take turns in list order. An article that is no duplicate yet marks every
    later near copy of no higher quality; a later near copy of higher quality that is
    not marked yet marks the article itself, the last one winning. An article is a
    duplicate at its turn when an earlier one that had its turn marks it, so states
    settle in rounds: each round asks every undecided article for its blockers. Blocks
    return one row per article, never pairs, so a crowd of copies costs no more rows.
    """
    by = list(by)
    base = cut(
        articles.where(F.col(vector).isNotNull()).select(
            *by, F.col(key).alias("__key"), F.col(order).cast("long").alias("__at"),
            F.coalesce(F.col(quality), F.lit(0)).cast("double").alias("__q"), F.col(vector).alias("__v"),
        )
    )
    state = cut(base.select(*by, "__at", F.lit(UNDECIDED).alias("__s")))
    blockers = T.StructType(
        [T.StructField("active", T.LongType()), T.StructField("open", T.LongType())]
    )

    def ask(cell: Cell):
        l_at, r_at = cell.left_values("__at"), cell.right_values("m_at")
        stops = (
            (cell.sim > bound)
            & (r_at[None, :] < l_at[:, None])
            & (cell.right_values("m_q")[None, :] >= cell.left_values("__q")[:, None])
        )
        s = cell.right_values("m_s")
        far = np.iinfo(np.int64).max
        first = lambda hit: np.where(hit, r_at[None, :], far).min(axis=1)
        return np.arange(len(l_at)), None, {
            "active": first(stops & (s == ACTIVE)[None, :]),
            "open": first(stops & (s == UNDECIDED)[None, :]),
        }

    def ask_all(rows: DataFrame, mates: DataFrame, kernel, values, fold) -> DataFrame:
        right = Side(
            mates.select(*by, F.col("__at").alias("m_at"), F.col("__q").alias("m_q"),
                         *[F.col(c).alias(f"m{c[1:]}") for c in mates.columns
                           if c not in {*by, "__at", "__q", "__v", "__key"}], "__v"),
            "__v",
            ["m_at", "m_q", *[f"m{c[1:]}" for c in mates.columns if c not in {*by, "__at", "__q", "__v", "__key"}]],
        )
        left = Side(rows, "__v", ["__at", "__q"])
        hits = compare(left, right, kernel, values, by=by, per_left=True, **layout).rows
        return hits.groupBy(*by, "__at").agg(*fold)

    far = F.lit(2**63 - 1)
    while True:
        known = base.join(state, [*by, "__at"])
        waiting = known.where(F.col("__s") == UNDECIDED)
        if waiting.isEmpty():
            break
        asked = ask_all(
            waiting.drop("__s"), known.where(F.col("__s") != GONE), ask, blockers,
            [F.min("active").alias("active"), F.min("open").alias("open")],
        )
        verdict = (
            F.when(F.col("active") < far, GONE).when(F.col("open") == far, ACTIVE).otherwise(UNDECIDED)
        )
        state = cut(
            state.join(asked, [*by, "__at"], "left").select(
                *by, "__at",
                F.when(F.col("active").isNull(), F.col("__s")).otherwise(verdict).alias("__s"),
            )
        )

    known = base.join(state, [*by, "__at"])
    first_block = ask_all(
        known.where(F.col("__s") == GONE).drop("__s"), known.where(F.col("__s") == ACTIVE), ask, blockers,
        [F.min("active").alias("__fb")],
    )
    marked = cut(known.join(first_block, [*by, "__at"], "left").withColumn("__fb", F.coalesce("__fb", far)))

    def overtake(cell: Cell):
        l_at, r_at = cell.left_values("__at"), cell.right_values("m_at")
        wins = (
            (cell.sim > bound)
            & (r_at[None, :] > l_at[:, None])
            & (cell.right_values("m_q")[None, :] > cell.left_values("__q")[:, None])
            & (cell.right_values("m_fb")[None, :] > l_at[:, None])
        )
        return np.arange(len(l_at)), None, {"last": np.where(wins, r_at[None, :], -1).max(axis=1)}

    overtaken = ask_all(
        marked.where(F.col("__s") == ACTIVE).drop("__s", "__fb"), marked.drop("__s"), overtake,
        T.StructType([T.StructField("last", T.LongType())]), [F.max("last").alias("__last")],
    ).where(F.col("__last") >= 0)
    pointed = marked.join(overtaken, [*by, "__at"], "left").withColumn(
        "__to", F.coalesce("__last", F.when(F.col("__fb") < far, F.col("__fb")))
    ).where(F.col("__to").isNotNull())
    names = base.select(*by, F.col("__at").alias("__to"), F.col("__key").alias("duplicate_of"))
    return pointed.join(names, [*by, "__to"]).select(*by, F.col("__key").alias(key), "duplicate_of")
