"""Isolation forest on Spark (Liu, Ting and Zhou, 2008).

Rows are drawn for trees by hash and each tree keeps the smallest draws, so the
forest is trained from one pass and few rows are shuffled; trees grow in
parallel on samples of at most ``sample_size`` rows, and scoring is a vectorised
UDF over the trees, whose total size is bounded by trees x 2 x sample_size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclog.config import DAY_US, SECOND_US, ForestLimits, checked
from seclog.operators.features import FEATURES, anomaly_reasons
from seclog.operators.suppress import suppress_within

_NODE = "tree int, node int, feature int, threshold double, left int, right int, depth int, size int"


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Average depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def training_sample(
    rows: DataFrame, limits: ForestLimits, features: Sequence[str], identity: Sequence[str]
) -> DataFrame:
    """(tree, rank, features...) with at most ``sample_size`` rows per tree.

    Every row is drawn for every tree with one probability, twice what fills the tree, or 1 if there are too few
    rows for that; of the rows drawn a tree keeps those with the least draws. With fewer than ``min_samples`` rows
    there is no sample, and so an empty forest. The sample size per tree is a parameter of the method; scoring
    reads every row.
    """
    have = rows.count()
    if have < limits.min_samples:
        rows, have = rows.limit(0), 1
    chance = min(1.0, 2 * limits.sample_size / have)

    def draw(tree: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*identity, tree, F.lit(limits.seed)), 11) / F.lit(float(1 << 53))

    order = Window.partitionBy("tree").orderBy("draw", *identity)
    return (
        rows.select(
            *identity,
            *[F.col(f).cast("double").alias(f) for f in features],
            F.explode(F.filter(F.sequence(F.lit(0), F.lit(limits.trees - 1)), lambda t: draw(t) < chance)).alias("tree"),
        )
        .withColumn("draw", draw(F.col("tree")))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limits.sample_size)
        .select("tree", "rank", *features)
    )


def _grower(features: Sequence[str], limits: ForestLimits):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf.sort_values("rank")[list(features)].to_numpy(dtype=float)
        rng = np.random.default_rng([limits.seed, tree])
        limit = max(1, math.ceil(math.log2(max(2, len(data)))))
        nodes: list[list] = []
        work = [(np.arange(len(data)), 0, None)]
        while work:
            members, depth, link = work.pop()
            node = len(nodes)
            if link is not None:
                nodes[link[0]][link[1]] = node
            part = data[members]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
            if depth >= limit or len(members) <= 1 or len(spread) == 0:
                nodes.append([tree, node, -1, 0.0, -1, -1, depth, len(members)])
                continue
            feature = int(rng.choice(spread))
            column = part[:, feature]
            cut = float(rng.uniform(column.min(), column.max()))
            low = column <= cut
            nodes.append([tree, node, feature, cut, -1, -1, depth, len(members)])
            work.append((members[~low], depth + 1, (node, 5)))
            work.append((members[low], depth + 1, (node, 4)))
        return pd.DataFrame(
            nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "depth", "size"]
        )

    return grow


def _draws(base: np.ndarray, tree: int) -> np.ndarray:
    """A number in [0, 2^53) per row and tree from a hash of the row."""
    mixed = base + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(np.int64)


def sample_state(
    rows: DataFrame,
    limits: ForestLimits = ForestLimits(),
    features: Sequence[str] = FEATURES,
    identity: Sequence[str] = ("src_ip", "us"),
    bucket_us: int = DAY_US,
    known: DataFrame | None = None,
) -> DataFrame:
    """A sample per tree that can be merged: (bucket, tree, draw, row hash, features...).

    Of each bucket of time a tree keeps the ``sample_size`` rows with the least draws, so the sample of a bucket does not
    depend on how its rows were dealt to batches and tasks. ``known`` is such a state to merge with; ``rows`` has ``us``.
    Each task sends at most that many rows per tree and bucket.
    """
    names = list(features)
    schema = "bucket long, tree int, draw long, row long, " + ", ".join(f"{f} double" for f in names)
    given = rows.select(
        F.floor(F.col("us") / bucket_us).alias("bucket"),
        F.xxhash64(*identity, F.lit(limits.seed)).alias("row"),
        *[F.col(f).cast("double").alias(f) for f in names],
    )
    size, trees = limits.sample_size, limits.trees

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # per bucket: draws, row hashes and features of the rows kept, a column a tree
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            hashes, data = pdf["row"].to_numpy(), pdf[names].to_numpy(float)
            for bucket, places in pdf.groupby("bucket").indices.items():
                draw = np.stack([_draws(hashes[places].view(np.uint64), tree) for tree in range(trees)], 1)
                row = np.repeat(hashes[places][:, None], trees, 1)
                point = np.repeat(data[places][:, None, :], trees, 1)
                if bucket in held:
                    draw, row, point = (np.concatenate(x) for x in zip(held[bucket], (draw, row, point), strict=True))
                near = np.argsort(draw, axis=0, kind="stable")[:size]
                held[bucket] = tuple(np.take_along_axis(x, near if x.ndim == 2 else near[:, :, None], 0) for x in (draw, row, point))
        for bucket, (draw, row, point) in held.items():
            out = pd.DataFrame(point.reshape(-1, len(names)), columns=names)
            yield out.assign(bucket=bucket, tree=np.tile(np.arange(trees, dtype=np.int32), len(draw)), draw=draw.ravel(), row=row.ravel())[["bucket", "tree", "draw", "row", *names]]

    drawn = given.mapInPandas(least, schema)
    if known is not None:
        drawn = drawn.unionByName(known.select(*drawn.columns))
    order = Window.partitionBy("bucket", "tree").orderBy("draw", "row", *names)
    return drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).drop("rank")


def fit_state(state: DataFrame, limits: ForestLimits = ForestLimits(), features: Sequence[str] = FEATURES) -> DataFrame:
    """The forest of a merged sample: of all its buckets a tree takes the rows with the least draws."""
    checked(limits)
    order = Window.partitionBy("tree").orderBy("draw", "row", *features)
    sample = state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limits.sample_size)
    return sample.select("tree", "rank", *features).groupBy("tree").applyInPandas(_grower(features, limits), _NODE)


def fit(
    rows: DataFrame,
    limits: ForestLimits = ForestLimits(),
    features: Sequence[str] = FEATURES,
    identity: Sequence[str] = ("src_ip", "us"),
) -> DataFrame:
    """The forest as a table of nodes; inner nodes have a feature, leaves have -1.

    ``rows`` is read twice (size, sample): pass a table, not a long computation.
    """
    checked(limits)
    sample = training_sample(rows, limits, features, identity)
    return sample.groupBy("tree").applyInPandas(_grower(features, limits), _NODE)


def score(
    rows: DataFrame,
    forest: DataFrame,
    features: Sequence[str] = FEATURES,
    limits: ForestLimits = ForestLimits(),
) -> DataFrame:
    """Add ``score`` in [-1, 0]; lower is stranger.

    The forest is brought to the driver to be sent to the tasks: at most
    trees x (2 x sample_size - 1) small rows, checked here.
    """
    most = limits.trees * (2 * limits.sample_size - 1)
    nodes = forest.limit(most + 1).toPandas()
    if len(nodes) > most:
        raise ValueError(f"forest has more than {most} nodes")
    nodes = nodes.sort_values(["tree", "node"])
    roots = np.flatnonzero((nodes["node"] == 0).to_numpy())
    tree_start = np.repeat(roots, np.diff(np.r_[roots, len(nodes)]))
    feature = nodes["feature"].to_numpy()
    threshold = nodes["threshold"].to_numpy()
    left = np.where(feature >= 0, nodes["left"].to_numpy() + tree_start, -1)
    right = np.where(feature >= 0, nodes["right"].to_numpy() + tree_start, -1)
    leaf_depth = nodes["depth"].to_numpy() + average_path(nodes["size"].to_numpy())
    expected = float(average_path(nodes["size"].to_numpy()[roots]).mean())

    @F.pandas_udf("double")
    def forest_score(*columns: pd.Series) -> pd.Series:
        data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros(len(data))
        every = np.arange(len(data))
        for root in roots:
            at = np.full(len(data), root)
            while True:
                split = feature[at]
                inner = split >= 0
                if not inner.any():
                    break
                goes_left = data[every, np.maximum(split, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += leaf_depth[at]
        return pd.Series(-np.exp2(-(total / len(roots)) / expected))

    return rows.withColumn("score", forest_score(*[F.col(f).cast("double") for f in features]))


def anomalies(scored: DataFrame, limits: ForestLimits = ForestLimits()) -> DataFrame:
    """Rows below the contamination quantile, thinned per address, with reasons."""
    cut = scored.agg(
        F.percentile_approx("score", F.lit(limits.contamination), F.lit(10_000)).alias("cut")
    )
    strange = scored.filter(F.col("score") < cut.scalar()).withColumn("__n", F.lit(0))
    kept = suppress_within(strange, ["src_ip"], limits.cooldown_sec * SECOND_US, tie="__n").drop("__n")
    return kept.withColumn("reasons", anomaly_reasons(F.col("score")))
