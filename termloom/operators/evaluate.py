"""Retrieval metrics of runs against judgments, a topic at a time and in summary.

runs(qid, doc_id, rank), judgments(qid, doc_id, rel). Topics without a relevant document are left out. Any number of
runs is scored at once if both carry further key columns, named in `by`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Depths and recall levels of the standard metrics.
DEPTHS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
LEVELS = tuple(k / 10 for k in range(11))
COUNTS = ("num_ret", "num_rel", "num_rel_ret")
LEAST_PRECISION = 1e-5


def metric_names() -> list[str]:
    return [*COUNTS, "map", "Rprec", "bpref", "recip_rank", *(f"iprec_at_recall_{r:.2f}" for r in LEVELS), *(f"P_{k}" for k in DEPTHS)]


def per_topic(run: DataFrame, judgments: DataFrame, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """One row a topic that has relevant documents, one column a metric."""
    key = [*by, "qid"]
    relevant = judgments.where("rel > 0").select("qid", "doc_id").distinct()
    judged = judgments.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("num_rel"), F.count_if(F.col("rel") <= 0).alias("n_not"))
    judged = judged.where("num_rel > 0")
    topic = run.join(judged, "qid").join(relevant.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left")
    bad = judgments.where("rel <= 0").select("qid", "doc_id").distinct().withColumn("miss", F.lit(1))
    topic = topic.join(bad, ["qid", "doc_id"], "left").select(*key, "rank", "num_rel", "n_not", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("miss", F.lit(0)).alias("miss"))
    order = Window.partitionBy(*key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    walked = topic.withColumns({"hits": F.sum("hit").over(order), "misses": F.sum("miss").over(order)})
    precision = F.col("hits") / F.col("rank")
    bound = F.least(F.col("num_rel"), F.col("n_not"))
    lost = F.when(bound > 0, F.least(F.col("misses"), bound) / bound).otherwise(0.0)
    sums = [
        F.count("*").alias("num_ret"),
        F.first("num_rel").alias("num_rel"),
        F.sum("hit").alias("num_rel_ret"),
        (F.sum(F.when(F.col("hit") == 1, precision).otherwise(0.0)) / F.first("num_rel")).alias("map"),
        (F.sum(F.when(F.col("rank") <= F.col("num_rel"), F.col("hit")).otherwise(0)) / F.first("num_rel")).alias("Rprec"),
        (F.sum(F.when(F.col("hit") == 1, 1 - lost).otherwise(0.0)) / F.first("num_rel")).alias("bpref"),
        F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("recip_rank"),
        *[F.coalesce(F.max(F.when(F.col("hits") >= F.lit(r) * F.col("num_rel") - 1e-9, precision)), F.lit(0.0)).alias(f"iprec_at_recall_{r:.2f}".replace(".", "_")) for r in LEVELS],
        *[(F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / F.lit(k)).alias(f"P_{k}") for k in DEPTHS],
    ]
    out = walked.groupBy(*key).agg(*sums)
    return out.select(*key, *[F.col(c).cast("long").alias(c) for c in COUNTS], *[F.round(F.col(c).cast("double"), digits).alias(c) for c in out.columns if c not in (*key, *COUNTS)])


def summary(topics: DataFrame, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Counts summed, other metrics averaged, gm_map the geometric mean of precisions of LEAST_PRECISION at least, and num_q."""
    means = [c for c in topics.columns if c not in (*by, "qid", *COUNTS)]
    out = topics.groupBy(*by).agg(
        F.count("*").alias("num_q"),
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.round(F.avg(c), digits).alias(c) for c in means],
        F.round(F.exp(F.avg(F.ln(F.greatest(F.col("map"), F.lit(LEAST_PRECISION))))), digits).alias("gm_map"),
    )
    return out


def long_form(topics: DataFrame, digits: int = 4) -> DataFrame:
    """(metric, qid, value) rows of per_topic() or, with qid "all", of summary()."""
    columns = [c for c in topics.columns if c != "qid"]
    qid = F.col("qid").cast("string") if "qid" in topics.columns else F.lit("all")
    pairs = [x for c in columns for x in (f"'{c}'", f"cast(round({c}, {digits}) as double)")]
    return topics.withColumn("qid", qid).selectExpr("qid", f"stack({len(columns)}, {', '.join(pairs)}) as (metric, value)").select("metric", "qid", "value")


def sampled_ndcg(run: DataFrame, judgments: DataFrame, depth: int = 100, digits: int = 6) -> DataFrame:
    """qid, infndcg: gains 2^rel - 1 of judged documents, scaled by stratum size over judged in judgments(qid, doc_id, rel, rate).

    rate is the share of the document's stratum that was judged; a fully judged pool gives the plain nDCG.
    """
    gain = (F.pow(F.lit(2.0), F.greatest(F.col("rel"), F.lit(0))) - 1) / F.col("rate")
    got = run.where(F.col("rank") <= depth).join(judgments, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    ideal = judgments.withColumn("k", F.row_number().over(order)).where(F.col("k") <= depth).groupBy("qid").agg(F.sum(gain / F.log2(F.col("k") + 1)).alias("best"))
    return ideal.where("best > 0").join(got, "qid", "left").select("qid", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("best"), digits).alias("infndcg"))


def below(topics: DataFrame, least: float = 0.1) -> DataFrame:
    """Hard topics: qid and map of those under `least`."""
    return topics.where(F.col("map") < least).select("qid", "map")
