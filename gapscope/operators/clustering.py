"""Clusters: fitting, choosing K, splitting, centroids and quality measures."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscope.config import SEED, SIM_DIGITS, Thresholds
from gapscope.functions.vectors import dot, normalise
from gapscope.operators import minibatch as mb
from gapscope.operators.axes import principal_axes, project
from gapscope.operators.rounds import cut, drop_table, numbered
from gapscope.operators.settling import settle
from gapscope.operators.similarity import AT, BROADCAST_BYTES, MATE, SIM, Cell, Side, bytes_of, compare, nearest, top_k

FEATURES = "__features"
CENTRE_BYTES = 512 << 20
# A fit that rises by no more than the digits similarities are rounded to stands still.
LEAST_RISE = 10.0**-SIM_DIGITS
# A k-means fit ends when no centre moves farther.
LEAST_MOVE = 1e-4
ROUND_ROWS, ROUND_FILES = 4096, 64
# Vectors of a fit up to this size are sent whole to the tasks, one for each start.
HELD_BYTES = 64 << 20
# Centres of a split that pass the driver in all its rounds together; any others are shuffled to the rows.
SENT_BYTES = 256 << 20
SWEEP_SCHEMA = T.StructType(
    [
        T.StructField("k", T.IntegerType()),
        T.StructField("inertia", T.DoubleType()),
        T.StructField("silhouette", T.DoubleType()),
        T.StructField("max_share", T.DoubleType()),
    ]
)


def _featured(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(FEATURES, array_to_vector(F.col(vector).cast("array<double>")))


def _check_centres(k: int, width: int) -> None:
    """Centres live on the driver and in every task, so their size is checked."""
    if k * width * 8 > CENTRE_BYTES:
        raise ValueError(f"{k} centres of {width} numbers are too many; raise the split target")


@dataclass
class Rows(mb.Dealt):
    """All vectors of a table for full fits; ``held`` has them too where they are few enough to be sent whole."""

    held: Broadcast | None = None
    begun: threading.Event | None = None


def dealt_rows(df: DataFrame, vector: str) -> Rows:
    """The vectors of a table, written once in files that tasks share evenly."""
    vec = F.col(vector).cast("array<double>")
    slim = cut(df.where(F.col(vector).isNotNull()).select(F.xxhash64(vec).alias("__key"), vec.alias("vec")))
    seen = slim.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    rows = cut(slim.repartition(min(ROUND_FILES, max(1, -(-seen["n"] // ROUND_ROWS)))))
    drop_table(df.sparkSession, slim)
    dealt = Rows(rows, seen["n"], 1, seen["width"] or 0)
    if 0 < dealt.total * dealt.width * 8 <= HELD_BYTES:
        dealt.held = df.sparkSession.sparkContext.broadcast(mb.matrix(rows.select("vec").toArrow()["vec"]))
    return dealt


def drop_rows(dealt: Rows) -> None:
    drop_table(dealt.rows.sparkSession, dealt.rows)
    if dealt.held is not None:
        dealt.held.destroy()


def _start(sample: np.ndarray, k: int, start: int, seed: int) -> np.ndarray:
    return mb.far_apart(sample, k, np.random.default_rng([seed, k, start]))


def _held_fits(dealt: Rows, sample: np.ndarray, k: int, tries: int, max_iter: int, seed: int) -> list[mb.Model]:
    """A task for each start, which goes through all its rounds over the rows it was sent."""
    spark = dealt.rows.sparkSession
    held, drawn = dealt.held, spark.sparkContext.broadcast(sample)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("id").to_pylist():
                centres = settle(held.value, _start(drawn.value, k, start, seed), max_iter, LEAST_MOVE)
                yield pa.RecordBatch.from_pydict({"start": [start], "centres": [centres.ravel()]})

    found = spark.range(0, tries, 1, tries).mapInArrow(fit, "start long, centres array<double>").toArrow().sort_by("start")
    drawn.destroy()
    return [mb.Model(k, start, centres) for start, centres in enumerate(mb.matrix(found["centres"]).reshape(tries, k, -1).copy())]


def _shared_fits(dealt: Rows, sample: np.ndarray, k: int, tries: int, max_iter: int, seed: int) -> list[mb.Model]:
    """The starts are fitted side by side: a round is one reading of the rows for all that still move."""
    models = [mb.Model(k, start, _start(sample, k, start, seed)) for start in range(tries)]
    for _ in range(max_iter):
        live = [m for m in models if m.live]
        if not live:
            break
        n, _, _, total = mb.sums(dealt.rows, [m.centres for m in live])
        for i, model in enumerate(live):
            mine = slice(i * k, (i + 1) * k)
            fed = n[mine] > 0
            before, model.centres = model.centres, model.centres.copy()
            model.centres[fed] = total[mine][fed] / n[mine][fed, None]
            model.live = np.sqrt(((model.centres - before) ** 2).sum(axis=1).max()) > LEAST_MOVE
    return models


def fit_kmeans(dealt: Rows, k: int, *, tries: int = 15, max_iter: int = 500, seed: int = SEED) -> mb.Fit:
    """Best of ``tries`` fits by cost over all rows.

    A round gives each centre the mean of its rows. Start centres are drawn from a bounded sample, far from
    each other. Rows that fit ``HELD_BYTES`` are sent to a task for each start, which makes all its rounds;
    others are read in every round, by all starts together.
    """
    _check_centres(tries * k, dealt.width)
    k = min(k, dealt.total)
    sample = dealt.first_rows(dealt.rows, max(3 * mb.BATCH_ROWS, 3 * k), seed + 1)
    if dealt.begun is not None:
        dealt.begun.set()
    fits = _held_fits if dealt.held is not None else _shared_fits
    return mb.best_fits(dealt, fits(dealt, sample, k, tries, max_iter, seed))[0]


def kmeans(df: DataFrame, vector: str, k: int, **fit) -> DataFrame:
    """``df`` with a ``cluster_id`` per row.

    Ids follow the order of the centres, so that they do not hang on the order in which
    the fit happened to find them. The rows are stored once, so that a computed vector is
    not computed again beside the Python function that places it.
    """
    df = cut(df)
    dealt = dealt_rows(df, vector)
    if not dealt.total:
        return df.withColumn("cluster_id", F.lit(None).cast("int"))
    best = fit_kmeans(dealt, k, **fit)
    drop_rows(dealt)
    return df.withColumn("cluster_id", mb.nearest_centre(best.centres)(F.col(vector).cast("array<double>")))


def sweep(
    df: DataFrame,
    vector: str,
    k_values: Sequence[int] = Thresholds.k_values,
    *,
    tries: int = 5,
    max_iter: int = 300,
) -> DataFrame:
    """Inertia, silhouette and largest share of every K; K at or above the row count is void.

    The fits run at the same time, each begun once the one before has drawn its sample.
    """
    dealt = dealt_rows(df, vector)
    asked, running = [k for k in k_values if k < dealt.total], []
    inherit = inheritable_thread_target(df.sparkSession)  # no wrapper where threads are not tied to the JVM's
    fit = inherit(fit_kmeans) if callable(inherit) else fit_kmeans
    with ThreadPoolExecutor(max(1, len(asked))) as pool:
        for k in asked:
            own = replace(dealt, begun=threading.Event())
            running.append(pool.submit(fit, own, k, tries=tries, max_iter=max_iter))
            running[-1].add_done_callback(lambda _, begun=own.begun: begun.set())
            own.begun.wait()
    found = [r.result() for r in running]
    fits = {f.k: f for f in mb.best_fits(dealt, [mb.Model(f.k, 0, f.centres) for f in found], True)} if found else {}
    drop_rows(dealt)
    rows = [
        (k, fits[k].inertia, fits[k].silhouette, float(fits[k].sizes.max() / dealt.total)) if k in fits else (k, float("inf"), -1.0, 1.0) for k in k_values
    ]
    return df.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def choose_k(swept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sweep rows with ``score`` and ``is_best_k``: silhouette less a penalty on big shares."""
    score = F.col("silhouette") - 2.0 * F.greatest(F.lit(0.0), F.col("max_share") - 0.10)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "k")
    return swept.withColumn("score", score).withColumn("is_best_k", F.row_number().over(w) == 1)


def cluster_sizes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "cluster_id").agg(F.count("*").alias("size"))


def largest_share(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sizes.groupBy(*by).agg(
        F.count("*").alias("clusters"),
        F.sum("size").alias("tickets"),
        (F.max("size") / F.sum("size")).alias("max_share"),
    )


def oversize_bound(
    sizes: DataFrame, floor: int = Thresholds.split_floor
) -> DataFrame:
    """One row: the size above which a cluster is split."""
    median = F.percentile("size", F.lit(0.5))
    return sizes.agg(
        F.greatest(F.lit(floor), 2 * F.floor(median)).cast("long").alias("max_size")
    )


def _best_of_starts(rows: Side, centres: Side, **layout) -> DataFrame:
    """Best centre of every row in each start of its cluster; ties go to the lowest part."""

    def kernel(cell: Cell):
        starts, at = cell.right_values("__start"), np.arange(cell.sim.shape[0])
        picks = []
        for start in np.unique(starts):
            cols = np.flatnonzero(starts == start)
            picks.append(cols[cell.sim[:, cols].argmax(axis=1)])
        li, ri = np.tile(at, len(picks)), np.concatenate(picks)
        return li, ri, {"sim": cell.sim[li, ri]}

    def fold(table: pa.Table) -> pa.Table:
        at, start, sim, other = (table[c].to_numpy() for c in (AT, "__start", "sim", MATE))
        order = np.lexsort((other, -sim, start, at))
        own = np.stack([at[order], start[order]])
        return table.take(pa.array(order[np.r_[True, (own[:, 1:] != own[:, :-1]).any(axis=0)]]))

    hits = compare(rows, centres, kernel, SIM, by=["cluster_id"], fold=fold, **layout)
    if hits.whole:
        return hits.rows
    best = F.min_by(F.struct("__part", "sim"), F.struct((-F.col("sim")).alias("s"), F.col("__part").alias("i")))
    return hits.rows.groupBy("cluster_id", *rows.columns, "__start").agg(best.alias("__b")).select(
        "cluster_id", *rows.columns, "__start", "__b.__part", "__b.sim"
    )


def split_oversize(
    df: DataFrame,
    key: str,
    vector: str,
    *,
    floor: int = Thresholds.split_floor,
    target: int = Thresholds.split_target,
    tries: int = 5,
    max_iter: int = 200,
    seed: int = SEED,
    **layout,
) -> DataFrame:
    """Split every cluster above the bound once into ``ceil(size / target)`` parts.

    All oversize clusters are split side by side, each from ``tries`` draws: centres are
    rows of a table keyed by cluster and start, and each round is one nearest-centre pass
    within clusters and one grouped mean. A start takes part until its own fit stops rising,
    ``max_iter`` rounds at most; the start of best fit splits the cluster. Neither the number
    of parts nor a cluster holding most rows reaches the driver or a single task: centres are
    broadcast while those of all rounds stay within ``SENT_BYTES``, then shuffled. The first
    part keeps the id, the others follow past the last id, then ids are renumbered.
    """
    sizes = cluster_sizes(df)
    big = cut(
        sizes.where(F.col("size") > oversize_bound(sizes, floor).scalar()).select(
            "cluster_id", "size", F.greatest(F.lit(2), F.ceil(F.col("size") / target)).alias("__parts")
        )
    )
    if big.isEmpty():
        return renumber(df)
    members = cut(df.join(big, "cluster_id").select(
        "cluster_id", key, "size", "__parts", normalise(F.col(vector).cast("array<double>")).alias("__unit")
    ))
    # A hashed draw a little larger than needed; only its ids are ranked.
    draw = F.pmod(F.xxhash64(key, F.col("__start") + F.lit(seed)), F.lit(1 << 31)) / (1 << 31)
    margin = F.col("__parts") + 4 * F.sqrt("__parts") + 8
    one = ["cluster_id", "__start"]
    w = Window.partitionBy(*one).orderBy("__draw", key)
    starts = F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("__start")
    drawn = (
        members.select("cluster_id", key, "size", "__parts", starts)
        .withColumn("__draw", draw)
        .where(F.col("__draw") < margin / F.col("size"))
        .withColumn("__part", F.row_number().over(w) - 1)
        .where(F.col("__part") < F.col("__parts"))
        .select("cluster_id", key, "__start", "__part")
    )
    rows = members.select("cluster_id", key, "__unit")
    columns = [*one, "__part", "__centre", "__fit", "__live"]
    state = cut(rows.join(drawn, ["cluster_id", key]).select(
        *one, "__part", F.col("__unit").alias("__centre"), F.lit(float("-inf")).alias("__fit"), F.lit(True).alias("__live")
    ))
    layout, sent = dict(layout), 0
    most = layout.pop("broadcast_bytes", BROADCAST_BYTES)
    for _ in range(max_iter):
        live = state.where("__live")
        centres = Side(live, "__centre", ["__part", "__start"])
        size, bound = bytes_of(centres.slim(["cluster_id"]))[0], min(most, SENT_BYTES - sent)
        if not size:
            break
        sent += size if size <= bound else 0
        placed = _best_of_starts(Side(rows, "__unit", [key]), centres, broadcast_bytes=bound, **layout)
        moved = cut(
            _featured(rows.join(placed, ["cluster_id", key]), "__unit").groupBy(*one, "__part").agg(
                vector_to_array(Summarizer.mean(F.col(FEATURES))).alias("__centre"), F.sum("sim").alias("__sum"), F.count("*").alias("__n")
            )
        )
        fits = moved.groupBy(*one).agg((F.sum("__sum") / F.sum("__n")).alias("__fit"))
        before = live.groupBy(*one).agg(F.first("__fit").alias("__before"))
        judged = fits.join(before, one).withColumn("__live", F.col("__fit") - F.col("__before") > LEAST_RISE).drop("__before")
        after = cut(moved.join(judged, one).select(columns).unionByName(state.where(~F.col("__live"))))
        drop_table(df.sparkSession, state, moved)
        state = after
    fits = state.groupBy(*one).agg(F.first("__fit").alias("__fit"))
    best = fits.groupBy("cluster_id").agg(
        F.min_by("__start", F.struct((-F.round("__fit", SIM_DIGITS)).alias("f"), F.col("__start").alias("s"))).alias("__start")
    )
    centres = cut(state.join(best, one).select("cluster_id", "__part", "__centre"))
    drop_table(df.sparkSession, state)
    placed = cut(
        nearest(Side(rows, "__unit", [key]), Side(centres, "__centre", ["__part"]), by=["cluster_id"], broadcast_bytes=min(most, SENT_BYTES - sent), **layout)
    )
    split = df.join(placed.select("cluster_id", key, "__part"), ["cluster_id", key], "left").withColumn(
        "__part", F.coalesce("__part", F.lit(0))
    )
    ids = split.select("cluster_id", "__part").distinct()
    lead = F.row_number().over(Window.partitionBy("cluster_id").orderBy("__part")) > 1
    ids = numbered(ids.withColumn("__late", lead), ["__late", "cluster_id", "__part"], "__new").drop("__late")
    kind = df.schema["cluster_id"].dataType
    return split.join(ids, ["cluster_id", "__part"]).select(
        *[F.col("__new").cast(kind).alias(c) if c == "cluster_id" else F.col(c) for c in df.columns]
    )


def renumber(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cluster ids 0..K-1 in id order, ranked over the distinct ids only."""
    ids = df.select(*by, "cluster_id").distinct()
    if by:
        w = Window.partitionBy(*by).orderBy("cluster_id")
        ids = ids.withColumn("__new", F.row_number().over(w) - 1)
    else:
        ids = numbered(ids, ["cluster_id"], "__new")
    kind = df.schema["cluster_id"].dataType
    joined = df.join(ids, [*by, "cluster_id"])
    return joined.select(
        *[F.col("__new").cast(kind).alias(c) if c == "cluster_id" else F.col(c) for c in df.columns]
    )


def enough_tickets(df: DataFrame, minimum: int = Thresholds.min_cluster_tickets) -> bool:
    return df.count() >= minimum


def centroids(df: DataFrame, vector: str, by: Sequence[str], name: str = "centroid") -> DataFrame:
    """Mean vector per group; the sums are merged on the map side, so hot groups are cheap."""
    mean = Summarizer.mean(F.col(FEATURES))
    return (
        _featured(df.where(F.col(vector).isNotNull()), vector)
        .groupBy(*by)
        .agg(vector_to_array(mean).alias(name))
    )


def intra_similarity(
    df: DataFrame, vector: str, centroid_table: DataFrame, by: Sequence[str], name: str = "intra_sim"
) -> DataFrame:
    """Mean cosine of members and the direction of their centroid.

    The mean of ``x . c`` over members is ``mean(x) . c`` for unit vectors, so it
    follows from the centroid table alone: no join back to the tickets.
    """
    mean_unit = centroids(
        df.select(*by, normalise(F.col(vector).cast("array<double>")).alias("__unit")), "__unit", by, "__mean"
    )
    joined = mean_unit.join(centroid_table, list(by))
    return joined.select(*by, dot(F.col("__mean"), normalise(F.col("centroid"))).alias(name))


def euclidean_silhouette(df: DataFrame, key: str, vector: str, **layout) -> DataFrame:
    """Silhouette of every row from mean Euclidean distances between unit vectors.

    Tasks return one sum per (row, cluster); distances never become rows.
    """
    left = Side(df.select(F.col(key), F.col("cluster_id"), vector), vector, [key, "cluster_id"])
    right = Side(
        df.select(F.col(key).alias("__mate"), F.col("cluster_id").alias("other"), vector),
        vector,
        ["__mate", "other"],
    )

    def kernel(cell: Cell):
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cell.sim))
        names, at = np.unique(cell.right_values("other"), return_inverse=True)
        member = np.zeros((len(at), len(names)))
        member[np.arange(len(at)), at] = 1.0
        sums = apart @ member
        li, ci = np.indices(sums.shape).reshape(2, -1)
        return li, None, {
            "other": names[ci],
            "total": sums[li, ci],
            "members": member.sum(axis=0)[ci].astype(np.int64),
        }

    values = T.StructType(
        [
            T.StructField("other", df.schema["cluster_id"].dataType),
            T.StructField("total", T.DoubleType()),
            T.StructField("members", T.LongType()),
        ]
    )

    def fold(table: pa.Table) -> pa.Table:
        added = table.group_by([key, "cluster_id", "other"], use_threads=False).aggregate([("total", "sum"), ("members", "sum"), (AT, "min"), (MATE, "min")])
        return added.rename_columns([c.removesuffix("_sum").removesuffix("_min") for c in added.column_names]).select(table.column_names)

    sums = (
        compare(left, right, kernel, values, per_left=True, fold=fold, **layout)
        .rows.groupBy(key, "cluster_id", "other")
        .agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
    )
    own = F.col("other") == F.col("cluster_id")
    scored = sums.groupBy(key, "cluster_id").agg(
        F.max(F.when(own, F.col("total") / F.nullif(F.col("members") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("members"))).alias("b"),
        F.max(F.when(own, F.col("members"))).alias("size"),
    )
    s = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    value = F.when((F.col("size") <= 1) | F.col("b").isNull(), 0.0).otherwise(F.coalesce(s, F.lit(0.0)))
    return scored.select(key, "cluster_id", value.alias("silhouette"))


def squared_silhouette(df: DataFrame, key: str, vector: str, **layout) -> DataFrame:
    """Silhouette of every row from mean squared distances between unit vectors.

    The mean squared distance of ``x`` to a cluster is ``2 - 2 x . mean``, so each row meets
    the clusters' means instead of all other rows; a row's own place is taken out of its
    cluster by ``n / (n - 1)``.
    """
    units = df.where(F.col(vector).isNotNull()).select("cluster_id", normalise(F.col(vector).cast("array<double>")).alias("__unit"))
    sizes = units.groupBy("cluster_id").agg(F.count("*").alias("members"))
    means = centroids(units, "__unit", ["cluster_id"], "__mean").join(sizes, "cluster_id").select(
        F.col("cluster_id").alias("other"), "members", F.sqrt(dot(F.col("__mean"), F.col("__mean"))).alias("length"), "__mean"
    )

    def kernel(cell: Cell):
        apart = 2.0 - 2.0 * cell.sim * cell.right_values("length")
        n = cell.right_values("members")
        own = cell.left_values("cluster_id")[:, None] == cell.right_values("other")
        inner = np.where(own & (n > 1), apart * n / np.maximum(n - 1, 1), -np.inf).max(axis=1)
        outer = np.where(own, np.inf, apart).min(axis=1)
        return np.arange(len(own)), None, {"a": inner, "b": outer}

    values = T.StructType([T.StructField(c, T.DoubleType()) for c in ("a", "b")])
    met = compare(Side(df, vector, [key, "cluster_id"]), Side(means, "__mean", ["other", "members", "length"]), kernel, values, per_left=True, **layout)
    scored = met.rows.groupBy(key, "cluster_id").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    s = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    alone = F.isnan(F.col("a") - F.col("a")) | F.isnan(F.col("b") - F.col("b"))  # without a mate, or without another cluster
    return scored.select(key, "cluster_id", F.when(alone, 0.0).otherwise(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def sampled_silhouette(df: DataFrame, key: str, vector: str, rows: int, **layout) -> DataFrame:
    """Mean silhouette of up to ``rows`` rows picked by hash of the key."""
    picked = df.select(key).orderBy(F.xxhash64(F.col(key), F.lit(SEED)), key).limit(rows)
    return euclidean_silhouette(df.join(picked, key), key, vector, **layout).agg(
        F.avg("silhouette").alias("silhouette"), F.count("*").alias("rows")
    )


def project_2d(table: DataFrame, vector: str = "centroid") -> DataFrame:
    """Places of the unit centroids along their first two principal axes, ``pca_x`` and ``pca_y``."""
    unit = table.withColumn("__unit", normalise(F.col(vector)))
    return project(unit, "__unit", principal_axes(unit, "__unit"), ("pca_x", "pca_y")).drop("__unit")


def approximate_top_k(
    queries: Side,
    index: Side,
    k: int,
    *,
    lists: int = 10,
    probes: int = 3,
    seed: int = SEED,
    **layout,
) -> DataFrame:
    """Top ``k`` from the ``probes`` nearest of ``lists`` index lists.

    Lists are k-means cells of the index. A query visits its nearest lists only;
    long lists are cut into tiles by ``compare``, so a hot list is no hot task.
    """
    unit = cut(index.frame.where(F.col(index.vector).isNotNull()).withColumn(
        "__unit", normalise(F.col(index.vector).cast("array<double>"))
    ))
    dealt = dealt_rows(unit, "__unit")
    if not dealt.total:
        return top_k(queries, index, k)
    found = fit_kmeans(dealt, lists, seed=seed).centres
    drop_rows(dealt)
    listed = unit.withColumn("__list", mb.nearest_centre(found)(F.col("__unit"))).drop("__unit")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(mb.in_order(found))]
    centres = index.frame.sparkSession.createDataFrame(rows, "`__list` int, `__centre` array<double>")
    near = top_k(
        Side(queries.frame, queries.vector, list(queries.columns)),
        Side(centres, "__centre", ["__list"]),
        probes,
        **layout,
    ).select(queries.columns[0], "__list")
    routed = queries.frame.join(near, queries.columns[0])
    hits = top_k(
        Side(routed, queries.vector, [*queries.columns]),
        Side(listed, index.vector, [*index.columns]),
        k,
        by=["__list"],
        **layout,
    ).drop("rank", "__list")
    w = Window.partitionBy(queries.columns[0]).orderBy(F.desc("sim"), F.col(index.columns[0]))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
