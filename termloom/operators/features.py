"""Statistics of candidate concepts for a query, and their normalisation and combination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions import beliefs
from termloom.functions.text import printable
from termloom.operators import windows
from termloom.operators.index import Index
from termloom.operators.settle import Side, settled

#: Meetings of concepts with terms and pairs that are held at once.
MEETINGS = 2_000_000
# Names of the features.
FEATURES = (
    "expTDocScore", "topTermFrac", "numCanDocs", "avgCDocScore", "maxCDocScore", "conIdf", "avgColCor", "maxColCor",
    "avgTopColCor", "maxTopColCor", "avgColPCor", "maxColPCor", "avgTopColPCor", "maxTopColPCor",
)


def concept_matches(index: Index, concepts: DataFrame, width: int = 4) -> DataFrame:
    """concept, doc_id, len, tf of concepts(concept): a word's places, or those of a phrase's words in order, gaps of `width` at most."""
    exprs = concepts.select(F.col("concept").alias("expr_id"), F.filter(F.split("concept", " "), lambda w: w != "").alias("terms"))
    found = windows.single_terms(index, exprs.where(F.size("terms") == 1)).select("expr_id", "doc_id", "len", "tf")
    if not exprs.where(F.size("terms") > 1).isEmpty():
        found = found.unionByName(windows.ordered_window(index, exprs.where(F.size("terms") > 1), width).select("expr_id", "doc_id", "len", "tf"))
    return settled(found.withColumnRenamed("expr_id", "concept"))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row the least of its concept's count and those of each term (j -1) and each pair of terms, added up over a batch."""
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        lists = column("places")
        bounds = np.asarray(lists.offsets).astype(np.int64)
        start, sizes = bounds[:-1] - bounds[0], np.diff(bounds)
        places, counts = (np.asarray(column(c).flatten()).astype(np.int64) for c in ("places", "counts"))
        own, near = np.asarray(column("own")), np.asarray(column("near"))
        codes = [column(c).dictionary_encode().indices.to_numpy() for c in ("qid", "concept")]
        first, group = np.unique(codes[0].astype(np.int64) << 32 | codes[1], return_index=True, return_inverse=True)[1:]
        for n in np.unique(sizes):
            a, b = np.triu_indices(n, 1)
            rows = np.flatnonzero(sizes == n)
            for lo in range(0, len(rows), step := max(1, MEETINGS // (n + len(a)))):
                r = rows[lo : lo + step]
                at = start[r][:, None] + np.arange(n)
                idx, tf = places[at], counts[at]
                least = np.minimum(np.concatenate([tf, np.minimum(tf[:, a], tf[:, b])], axis=1), own[r][:, None]).ravel()
                i = np.concatenate([idx, idx[:, a]], axis=1)
                j = np.concatenate([np.full_like(idx, -1), idx[:, b]], axis=1)
                key = (group[r][:, None] << 44 | i << 22 | (j + 1)).ravel()  # a batch has under 2^19 rows, a title under 2^22 words
                order = np.argsort(key, kind="stable")
                key = key[order]
                cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                top = np.repeat(near[r], n + len(a))[order]
                at = pa.array(first[key[cut] >> 44])
                yield pa.RecordBatch.from_arrays(
                    [column("qid").take(at), column("concept").take(at), pa.array(key[cut] >> 22 & (1 << 22) - 1), pa.array((key[cut] & (1 << 22) - 1) - 1), pa.array(np.add.reduceat(least[order], cut)), pa.array(np.add.reduceat(top, cut).astype(np.int64))],
                    names=["qid", "concept", "i", "j", "n", "top"],
                )


def _co_occurrence(index: Index, held: DataFrame, terms: DataFrame, near: DataFrame) -> DataFrame:
    """The eight co-occurrence features of held(qid, concept, doc_id, tf), from the frequencies of the involved terms once.

    A concept meets a query term, or a pair of them, as often in a document as the rarest of them occurs there. Mean and
    largest of the collection's counts and of the feedback documents near(qid, doc_id) go over all terms and all pairs.
    """
    titles = Side(terms.select("qid", "idx", "term"))
    found = titles.restrict(index.postings(), "term").select("term", "doc_id", "tf").join(titles.frame, "term")
    inside = found.select("qid", "doc_id", "idx", "tf").join(held.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    lists = inside.groupBy("qid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "tf"))).alias("all"))  # terms of one title
    near = near.select("qid", "doc_id").withColumn("near", F.lit(1))
    rows = held.select("qid", "doc_id", "concept", F.col("tf").alias("own")).join(lists, ["qid", "doc_id"]).join(near, ["qid", "doc_id"], "left")
    rows = rows.select("qid", "concept", "own", F.coalesce("near", F.lit(0)).alias("near"), F.transform("all", lambda x: x["idx"]).alias("places"), F.transform("all", lambda x: x["tf"]).alias("counts"))
    schema = T.StructType([rows.schema["qid"], rows.schema["concept"], *(T.StructField(c, T.LongType()) for c in ("i", "j", "n", "top"))])
    each = rows.mapInArrow(_meetings, schema).groupBy("qid", "concept", "i", "j").agg(F.sum("n").alias("n"), F.sum("top").alias("top"))
    size = terms.groupBy("qid").agg(F.count("*").alias("t"))
    pairs = F.col("t") * (F.col("t") - 1) / 2

    def four(prefix: str, of, count: Column) -> list[Column]:
        total = lambda c: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0))
        most = lambda c: F.coalesce(F.max(F.when(of, F.col(c))), F.lit(0))
        return [
            F.try_divide(total("n"), count).alias(f"avgCol{prefix}Cor"), most("n").alias(f"maxCol{prefix}Cor"),
            F.try_divide(total("top"), count).alias(f"avgTopCol{prefix}Cor"), most("top").alias(f"maxTopCol{prefix}Cor"),
        ]

    return each.join(size, "qid").groupBy("qid", "concept").agg(*four("", F.col("j") < 0, F.first("t")), *four("P", F.col("j") >= 0, F.first(pairs)))


def concept_features(index: Index, terms: DataFrame, concepts: DataFrame, run: DataFrame, feedback: int = 10, width: int = 4) -> DataFrame:
    """qid, concept and the FEATURES (10 decimals) of concepts(qid, concept), terms(qid, idx, term) and run(qid, doc_id, rank, score).

    A concept is a word or a phrase. All features are absolute values; what has no occurrence counts 0. Averages go over
    all query terms or all pairs of them.
    """
    concepts = Side(concepts.select("qid", "concept")).frame
    tf = concept_matches(index, concepts, width)
    best = Side(run.where(F.col("rank") <= feedback).select("qid", "doc_id", "rank", "score"))
    top = best.frame
    best = best.restrict(index.lengths, "doc_id").join(top, "doc_id")
    whole = best.groupBy("qid").agg(F.max_by("score", -F.col("rank")).alias("first"), F.sum("len").alias("size"))
    cf = tf.groupBy("concept").agg(F.sum("tf").alias("cf"))
    held = settled(concepts.join(tf, "concept").select("qid", "concept", "doc_id", "tf"))
    inside = held.join(top, ["qid", "doc_id"]).groupBy("qid", "concept").agg(F.sum("tf").alias("occ"), F.count("*").alias("docs"), F.avg("score").alias("mean"), F.max("score").alias("largest"))
    out = concepts.join(whole, "qid", "left").join(inside, ["qid", "concept"], "left").join(cf, "concept", "left").join(index.totals().select("n_docs"))
    out = out.join(_co_occurrence(index, held, terms, top), ["qid", "concept"], "left")
    zero = lambda c: F.round(F.abs(F.coalesce(c, F.lit(0)).cast("double")), 10)
    own = {
        "expTDocScore": F.col("first"),
        "topTermFrac": F.try_divide(F.col("occ"), F.col("size")),
        "numCanDocs": F.col("docs"),
        "avgCDocScore": F.col("mean"),
        "maxCDocScore": F.col("largest"),
        "conIdf": beliefs.idf(F.col("n_docs"), F.coalesce("cf", F.lit(0))),
    }
    return out.select("qid", "concept", *[zero(own.get(f, F.col(f))).alias(f) for f in FEATURES])


def sum_to_one(features: DataFrame, columns: tuple[str, ...], by: str = "qid", digits: int = 8) -> DataFrame:
    """Every column divided by its sum over the group; 0 where the sum is 0."""
    group = Window.partitionBy(by)
    return features.withColumns({c: F.round(F.when(F.sum(c).over(group) != 0, F.col(c) / F.sum(c).over(group)).otherwise(0.0), digits) for c in columns})


def min_max(features: DataFrame, columns: tuple[str, ...], by: str = "qid", digits: int = 8) -> DataFrame:
    """Every column scaled to 0..1 over the group; 0 where all are equal."""
    group = Window.partitionBy(by)

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(group), F.max(c).over(group)
        return F.round(F.when(high != low, (F.col(c) - low) / (high - low)).otherwise(0.0), digits)

    return features.withColumns({c: scaled(c) for c in columns})


def combined(features: DataFrame, weights: dict[str, float], digits: int = 10) -> DataFrame:
    """qid, concept, score: the weighted sum of the named columns."""
    total = sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return features.select("qid", "concept", F.round(total, digits).alias("score"))


def added_up(scored: DataFrame, digits: int = 10) -> DataFrame:
    """qid, concept, score: the scores of scored(qid, term, concept, score) added up over the query's terms."""
    return scored.groupBy("qid", "concept").agg(F.round(F.sum("score"), digits).alias("score"))


def best_concepts(scored: DataFrame, count: int, original: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """qid, concept, score, rank of the first `count` by score, ties by concept; then, without moving ranks, those that
    are unprintable, under `least` or among original(qid, term) are left out."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "concept")
    out = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= count).where(printable(F.col("concept")))
    if least is not None:
        out = out.where(F.col("score") >= least)
    if original is not None:
        out = out.join(original.select("qid", F.col("term").alias("concept")), ["qid", "concept"], "left_anti")
    return out


#: Ways to weigh a concept for a query: by name, from the normalised features and the graph's weight.
SCORERS = {
    "features": lambda weights: sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0)),
    "association": lambda weights: F.col("weight"),
    "association_idf": lambda weights: F.col("weight") * F.col("conIdf"),
}


def scored_by(method: str, rows: DataFrame, weights: dict[str, float] | None = None, digits: int = 10) -> DataFrame:
    """qid, concept, score by a named method over rows with its columns. Raises KeyError for an unknown one."""
    return rows.select("qid", "concept", F.round(SCORERS[method](weights or {}), digits).alias("score"))
