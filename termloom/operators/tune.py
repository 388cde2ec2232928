"""Parameter search: grids, coordinate ascent, random draws and sweeps, every batch of points scored by one plan."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, axes: dict[str, Sequence[float]]) -> DataFrame:
    """point and one column an axis, all combinations in order."""
    rows = [(k, *map(float, p)) for k, p in enumerate(itertools.product(*axes.values()))]
    return spark.createDataFrame(rows, ", ".join(["point long", *(f"{a} double" for a in axes)]))


def drawn(width: int, count: int, seed: int = 0) -> np.ndarray:
    """`count` rows of `width` uniform draws, each row summing to one."""
    values = np.random.default_rng(seed).random((count, width))
    return values / values.sum(axis=1, keepdims=True)


def draws(spark: SparkSession, names: Sequence[str], count: int, seed: int = 0) -> DataFrame:
    """point and weights of `count` uniform draws that sum to one."""
    values = drawn(len(names), count, seed)
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(values)], ", ".join(["point long", *(f"{a} double" for a in names)]))


def weighted(features: DataFrame, points: DataFrame, names: Sequence[str], digits: int = 10) -> DataFrame:
    """point, qid, concept, score of every point's weights: a few points, so each feature row meets all of them."""
    score = sum((F.col(f"features.{n}") * F.col(f"points.{n}") for n in names), F.lit(0.0))
    return features.alias("features").join(F.broadcast(points.alias("points"))).select("point", "qid", "concept", F.round(score, digits).alias("score"))


def best(results: DataFrame, value: str = "map", point: str = "point"):
    """The row of the largest value, ties by smallest point."""
    return results.orderBy(F.desc(value), point).first()


def coordinate_ascent(start: dict[str, float], evaluate: Callable[[list[dict[str, float]]], list[float]], steps: Sequence[float] = (-0.4, -0.2, 0.0, 0.2, 0.4), rounds: int = 10) -> tuple[dict[str, float], float]:
    """Tries all steps of one weight at a time, keeping the best; ends after a round without gain. evaluate scores a batch."""
    now, value = dict(start), evaluate([start])[0]
    for _ in range(rounds):
        before = value
        for name in start:
            tried = [{**now, name: now[name] + s} for s in steps if s]
            got = evaluate(tried)
            k = max(range(len(got)), key=lambda i: got[i])
            if got[k] > value:
                now, value = tried[k], got[k]
        if value <= before:
            break
    return now, value


def sweep(start: dict[str, float], name: str, values: Sequence[float], evaluate: Callable[[list[dict[str, float]]], list[float]]) -> list[tuple[float, float]]:
    """(value, result) along one weight."""
    return list(zip(values, evaluate([{**start, name: v} for v in values])))
