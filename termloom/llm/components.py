"""Connected components of a link table by alternating stars, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, batch_of, column, cut, drop_cut, shuffled

#: Links that a task folds at once.
FOLD_ROWS = 1_000_000
#: Tasks that the links of one node are dealt to.
SALTS = 32


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) with the same components as the links a-b."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = place[: len(a)], place[len(a) :]
    parent = np.arange(len(ids))
    while True:
        la, lb = parent[ia], parent[ib]
        open_ = la != lb
        if not open_.any():
            break
        ia, ib, la, lb = ia[open_], ib[open_], la[open_], lb[open_]
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = parent != np.arange(len(ids))
    return ids[moved], ids[parent[moved]]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held, rows = [], 0

    def folded():
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return batch_of(schema, a, b)

    for batch in batches:
        if batch.num_rows:
            held.append((column(batch, "a").to_numpy(), column(batch, "b").to_numpy()))
            rows += batch.num_rows
        if rows >= FOLD_ROWS:
            yield folded()
            held, rows = [], 0
    if held:
        yield folded()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of links(a, b), root being the smallest node reachable, roots included.

    Each round folds links inside tasks, then applies a large star and a small star; it ends when a round changes
    nothing. Null ends and loops are dropped; an empty table gives an empty table. The result is a written table.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now, mark = cut(arrow_map(links, _fold, "a long, b long")), None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # links hang on roots, whose rows stay as they are; only other ends look up theirs, salted
        moved = least.where("m < u").select(F.col("u").alias("b"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        large = now.withColumn("salt", F.pmod(F.hash("a"), F.lit(SALTS))).join(shuffled(moved), ["b", "salt"], "left").select("a", F.coalesce("m", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(shuffled(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = cut(arrow_map(small_star.distinct(), _fold, "a long, b long"))
        before, now = now, after
        drop_cut(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
