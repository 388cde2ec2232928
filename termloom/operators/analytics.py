"""Tables behind figures: ablation sums, aligned curves, layer ranks and regions, local regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.settle import settled


def ablation(losses: DataFrame, scale: float, start: float, order: str = "position", digits: int = 9) -> DataFrame:
    """feature, norm_loss (its share of all losses times scale), cum_loss in order, reduced (start less cum_loss)."""
    total = losses.agg(F.sum("loss").alias("total"))
    shared = losses.join(total).withColumn("share", F.col("loss") * F.lit(scale) / F.col("total"))
    running = F.sum("share").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))  # one row a feature
    return shared.withColumn("cum", running).select("feature", order, F.round("share", digits).alias("norm_loss"), F.round("cum", digits).alias("cum_loss"), F.round(F.lit(start) - F.col("cum"), digits).alias("reduced"))


def aligned(curve: DataFrame, by: str, peak: float, value: str = "y", digits: int = 6) -> DataFrame:
    """Each group's values moved so that its largest is `peak`."""
    high = curve.groupBy(by).agg(F.max(value).alias("_high"))
    return curve.join(high, by).withColumn(value, F.round(F.col(value) + F.lit(peak) - F.col("_high"), digits)).drop("_high")


def overall_rank(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place from 1 in the order: sorted ranges, counted, each moved by the rows of the ranges before it."""
    spread = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["n"] for r in spread.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row a range
    before, moves = 0, []
    for k in sorted(counts):
        moves.append((k, before))
        before += counts[k]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(moves, "_range int, _before long"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return spread.withColumn("_inside", inside).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def layer_ranks(concepts: DataFrame, upper: float, lower: float) -> DataFrame:
    """concepts(level, concept, q) with in_layer and overall ranks by q and the region that q falls in."""
    order = [F.desc("q"), F.col("concept")]
    region = F.when(F.col("q") >= upper, "selection").when(F.col("q") < lower, "rejection").otherwise("uncertainty")
    in_layer = F.row_number().over(Window.partitionBy("level").orderBy(*order)).cast("long")
    return overall_rank(concepts, order, "overall").withColumns({"in_layer": in_layer, "region": region})


def local_regression(points: DataFrame, by: str, span: float = 0.75, degree: int = 2) -> DataFrame:
    """by, x, y and smooth: for each point of a group a tricube-weighted polynomial over the nearest share `span` of it.

    A group is a curve of a figure. Null points are left out; a group with fewer points than coefficients gives its mean.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
        n = len(x)
        near = min(n, max(degree + 1, int(np.ceil(span * n))))
        out = np.empty(n)
        for k in range(n):
            d = np.abs(x - x[k])
            reach = max(np.partition(d, near - 1)[near - 1], 1e-12) * (1.0 if span <= 1 else span)
            w = np.clip(1 - (d / (reach * 1.0000001)) ** 3, 0, None) ** 1.5
            if n <= degree or (w > 0).sum() <= degree:
                out[k] = y.mean()
                continue
            a = np.vander(x - x[k], degree + 1, increasing=True)
            out[k] = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0][0]
        return frame.assign(smooth=out)

    clean = points.select(by, F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null")
    kind = dict(clean.dtypes)[by]
    return clean.groupBy(by).applyInPandas(fit, f"{by} {kind}, x double, y double, smooth double")


def annotated(texts: DataFrame, annotator: Callable[[str], list[str]], id_col: str = "qid", text_col: str = "text") -> DataFrame:
    """qid, at, line: the lines that an external annotator writes for each text, in order; a null text has none.

    annotator runs in the executors, on one text after another; it may start a program and keep it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, k, line) for i, t in zip(frame[id_col], frame[text_col]) if t is not None for k, line in enumerate(annotator(t))]
            yield pd.DataFrame(found, columns=["qid", "at", "line"]).astype({"at": "int32"})

    return texts.select(id_col, text_col).mapInPandas(run, f"qid {dict(texts.dtypes)[id_col]}, at int, line string")
