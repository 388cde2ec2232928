"""Ranking, windows, feedback, expansion, evaluation and tuning over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.operators import analytics, evaluate, features, graph, index, query, rank, tune, windows
from termloom.operators.settle import settled
from termloom.plans.collection import _BELIEF, SQL, collection, edges, full_run, judgments, kept, sql, table, title_leaves, title_run, topic_edges, topic_terms


def _title_array(terms: DataFrame) -> DataFrame:
    """qid, words: the title in order."""
    return terms.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "term"))), lambda s: s["term"]).alias("words"))


def _leaf(rows: DataFrame, kind: str, width: int, weight) -> DataFrame:
    key = F.concat(F.lit(f"#{kind}{width or ''}("), F.array_join("terms", " "), F.lit(")"))
    return rows.select("qid", key.alias("expr_id"), F.lit(kind).alias("kind"), F.lit(width).alias("width"), "terms", weight.alias("weight"))


def _pairs(titles: DataFrame) -> DataFrame:
    """qid, terms: neighbouring pairs of titles of two words and more."""
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    return titles.where(F.size("words") > 1).select("qid", "words", k).select("qid", F.array(F.element_at("words", F.col("k")), F.element_at("words", F.col("k") + 1)).alias("terms"))


def dirichlet_topk(spark: SparkSession, d: str) -> DataFrame:
    ix = collection(spark, d)
    return title_run(ix, topic_terms(spark, d), 10)


def weight_query_topk(spark: SparkSession, d: str) -> DataFrame:
    """#weight(0.7 #combine(title) 0.3 first)."""
    ix = collection(spark, d)
    terms = topic_terms(spark, d)
    first = query.term_leaves(terms.where("idx = 1"), F.lit(0.3))
    return rank.rank(ix, title_leaves(terms, 0.7).unionByName(first), 10)


def nested_weight_topk(spark: SparkSession, d: str) -> DataFrame:
    """#weight(0.2 #combine(title) 0.8 #combine(#weight(0.7 first 0.3 last)))."""
    ix = collection(spark, d)
    terms = topic_terms(spark, d)
    last = terms.withColumn("_n", F.max("idx").over(Window.partitionBy("qid"))).where("idx = _n")
    parts = title_leaves(terms, 0.2).unionByName(query.term_leaves(terms.where("idx = 1"), F.lit(0.56))).unionByName(query.term_leaves(last, F.lit(0.24)))
    return rank.rank(ix, parts, 10)


def two_stage_topk(spark: SparkSession, d: str) -> DataFrame:
    ix = collection(spark, d)
    return rank.rank(ix, title_leaves(topic_terms(spark, d)), 10, smoothing=rank.Smoothing(2500.0, 0.4))


def working_set_rank(spark: SparkSession, d: str) -> DataFrame:
    """The title run among labelled documents of good quality."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return rank.rank(collection(spark, d), title_leaves(topic_terms(spark, d)), 10, working_set=good)


def _window_exprs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_title_array(topic_terms(spark, d))).select(F.array_join("terms", " ").alias("expr_id"), "terms").distinct()


def ordered_window_count(spark: SparkSession, d: str) -> DataFrame:
    ix = collection(spark, d)
    return windows.collection_counts(windows.ordered_window(ix, _window_exprs(spark, d), 4))


def unordered_window_count(spark: SparkSession, d: str) -> DataFrame:
    ix = collection(spark, d)
    return windows.collection_counts(windows.unordered_window(ix, _window_exprs(spark, d), 17))


def cooccurrence_doc_count(spark: SparkSession, d: str) -> DataFrame:
    ix = collection(spark, d)
    return windows.collection_counts(windows.whole_document(ix, _window_exprs(spark, d)))


def phrase_template(spark: SparkSession, d: str) -> DataFrame:
    """0.8 #combine(title) 0.1 #combine(#od4 of neighbours) 0.1 #uw17(title), for titles of two words and more."""
    ix = collection(spark, d)
    terms = topic_terms(spark, d)
    titles = _title_array(terms).where(F.size("words") > 1)
    pairs = _pairs(titles)
    od = _leaf(pairs, "od", 4, F.lit(0.1) / F.count("*").over(Window.partitionBy("qid")))
    uw = _leaf(titles.withColumnRenamed("words", "terms"), "uw", 17, F.lit(0.1))
    leaves = title_leaves(terms.join(titles.select("qid"), "qid", "left_semi"), 0.8).unionByName(od).unionByName(uw)
    return rank.rank(ix, leaves, 10, kinds=(("term", 0), ("od", 4), ("uw", 17)))


def feedback_terms(spark: SparkSession, d: str) -> DataFrame:
    ix = collection(spark, d)
    return rank.feedback_terms(ix, title_run(ix, topic_terms(spark, d), 28), 28, 30)


def feedback_rank(spark: SparkSession, d: str) -> DataFrame:
    ix = collection(spark, d)
    terms = topic_terms(spark, d)
    leaves = title_leaves(terms)
    return rank.rank(ix, rank.with_feedback(leaves, settled(rank.feedback_terms(ix, rank.rank(ix, leaves, 28), 28, 30))), 10)


def assoc_graph_pmi(spark: SparkSession, d: str) -> DataFrame:
    return topic_edges(spark, d)


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(topic_terms(spark, d), topic_edges(spark, d))


def two_hop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops(topic_terms(spark, d), topic_edges(spark, d), 2).withColumn("layer", F.col("layer").cast("long"))


def term_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.term_pairs(topic_terms(spark, d), F.col("idx"))


def _concepts(spark: SparkSession, d: str):
    """Index, topic terms, and features of their neighbours that are no topic term themselves; all weightings read one table."""
    ix, terms = collection(spark, d), topic_terms(spark, d)

    def make() -> DataFrame:
        near = graph.neighbours(terms, topic_edges(spark, d)).select("qid", "concept").distinct()
        near = settled(near.join(terms.select("qid", F.col("term").alias("concept")), ["qid", "concept"], "left_anti"))
        return features.concept_features(ix, terms, near, full_run(spark, d))

    return ix, terms, kept(spark, d, "features", make)


def concept_features(spark: SparkSession, d: str) -> DataFrame:
    return _concepts(spark, d)[2]


def feature_normalize(spark: SparkSession, d: str) -> DataFrame:
    return features.sum_to_one(_concepts(spark, d)[2], features.FEATURES)


def minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    return features.min_max(_concepts(spark, d)[2], features.FEATURES)


# Points of the sweep.
SWEPT = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
WEIGHTS = {"topTermFrac": 0.2, "numCanDocs": 0.1, "conIdf": 0.3, "avgColCor": 0.2, "avgTopColCor": 0.2}


def _scored(spark: SparkSession, d: str):
    ix, terms, found = _concepts(spark, d)
    return ix, terms, settled(features.combined(features.sum_to_one(found, features.FEATURES), WEIGHTS))


def weighted_combine(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[2]


def select_top_concepts(spark: SparkSession, d: str) -> DataFrame:
    _, terms, scored = _scored(spark, d)
    return features.best_concepts(scored, 5, original=terms)


def threshold_concepts(spark: SparkSession, d: str) -> DataFrame:
    _, terms, scored = _scored(spark, d)
    return features.best_concepts(scored, 20, original=terms, least=0.05)


def _layers(terms: DataFrame, chosen: DataFrame) -> DataFrame:
    """qid, layer, weight, words: the title and its concepts in rank order; a title without concepts stands alone."""
    title = _title_array(terms).select("qid", F.lit(0).alias("layer"), F.lit(0.7).alias("weight"), "words")
    words = F.transform(F.sort_array(F.collect_list(F.struct("rank", "concept"))), lambda s: s["concept"])
    return title.unionByName(chosen.groupBy("qid").agg(words.alias("words")).select("qid", F.lit(1).alias("layer"), F.lit(0.3).alias("weight"), "words"))


def layered_query(spark: SparkSession, d: str) -> DataFrame:
    _, terms, scored = _scored(spark, d)
    layers = _layers(terms, features.best_concepts(scored, 5, original=terms))
    return layers.select("qid", F.col("layer").cast("long").alias("layer"), "weight", F.array_join("words", " ").alias("words"))


def expanded_query_text(spark: SparkSession, d: str) -> DataFrame:
    _, terms, scored = _scored(spark, d)
    return query.layered_text(_layers(terms, features.best_concepts(scored, 5, original=terms)))


def _expanded(terms: DataFrame, chosen: DataFrame) -> DataFrame:
    """Leaves of the title at 0.7 and the concepts at 0.3; a title without concepts has all weight."""
    has = chosen.select("qid").distinct().withColumn("_has", F.lit(0.7))
    title = title_leaves(terms).join(has, "qid", "left").withColumn("weight", F.col("weight") * F.coalesce("_has", F.lit(1.0))).drop("_has")
    return title.unionByName(query.term_leaves(chosen.withColumnRenamed("concept", "term"), F.lit(0.3) / F.count("*").over(Window.partitionBy("qid"))))


def expanded_rank(spark: SparkSession, d: str) -> DataFrame:
    ix, terms, scored = _scored(spark, d)
    return rank.rank(ix, _expanded(terms, features.best_concepts(scored, 5, original=terms)), 10)


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    ix = collection(spark, d)
    run = full_run(spark, d)
    return evaluate.per_topic(run, judgments(spark, d, ix, run))


def per_topic_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(_evaluated(spark, d))


def hard_topics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.below(_evaluated(spark, d), 0.5)


def _mixed(spark: SparkSession, d: str):
    """qid, doc_id, s0, s1 (title and first-term beliefs of documents with the first term) and judgments, once for all points."""
    ix = collection(spark, d)
    terms = topic_terms(spark, d)
    title = settled(rank.scores(ix, title_leaves(terms)))
    first = rank.scores(ix, query.term_leaves(terms.where("idx = 1"), F.lit(1.0))).withColumnRenamed("score", "s1")
    both = settled(title.withColumnRenamed("score", "s0").join(first, ["qid", "doc_id"]))
    return both, judgments(spark, d, ix, rank.top(title, 100))


def _measured(mixed: DataFrame, judged: DataFrame, points: DataFrame) -> DataFrame:
    """points with the summary of each, by one plan: a row of mixed meets every point, and points are few."""
    scored = mixed.join(F.broadcast(points)).select("point", "qid", "doc_id", F.round((F.col("c0") * F.col("s0") + F.col("c1") * F.col("s1")) / (F.col("c0") + F.col("c1")), 6).alias("score"))
    order = Window.partitionBy("point", "qid").orderBy(F.desc("score"), "doc_id")
    run = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 1000")
    return points.join(evaluate.summary(evaluate.per_topic(run, judged, by=("point",)), by=("point",)), "point")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """point, c0, c1 and summary under 3 x 3 weights."""
    return _measured(*_mixed(spark, d), tune.grid(spark, {"c0": (0.2, 0.5, 0.8), "c1": (0.0, 0.3, 0.6)}))


def _batch(spark: SparkSession, mixed: DataFrame, judged: DataFrame):
    """For searches: the mean average precision of each of a batch of weights, by one plan a batch."""

    def values(points: list[dict[str, float]]) -> list[float]:
        table_ = spark.createDataFrame([(k, p["c0"], p["c1"]) for k, p in enumerate(points)], "point long, c0 double, c1 double")
        found = {r.point: r.map for r in _measured(mixed, judged, table_).select("point", "map").collect()}  # a row a point
        return [found.get(k, 0.0) for k in range(len(points))]

    return values


def coordinate_ascent(spark: SparkSession, d: str) -> DataFrame:
    """Weights of title and first term after two rounds of coordinate ascent on mean average precision."""
    got, value = tune.coordinate_ascent({"c0": 0.6, "c1": 0.4}, _batch(spark, *_mixed(spark, d)), steps=(-0.2, 0.2), rounds=2)
    return spark.createDataFrame([(round(got["c0"], 6), round(got["c1"], 6), value)], "c0 double, c1 double, map double")


def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean average precision along the first term's weight, the title's being 0.5."""
    got = tune.sweep({"c0": 0.5, "c1": 0.0}, "c1", SWEPT, _batch(spark, *_mixed(spark, d)))
    return spark.createDataFrame(got, "c1 double, map double")


def grid_eval(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("point", "c0", "c1", "num_q", "map", "P_5")


def weight_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).orderBy(F.desc("map"), "point").limit(1).select("point", "c0", "c1", "map")


#: Random weightings: count and seed.
DRAWS = (200, 7)


def random_search(spark: SparkSession, d: str) -> DataFrame:
    """Best concept of each query under 200 random weightings."""
    found = features.sum_to_one(_concepts(spark, d)[2], features.FEATURES)
    scored = tune.weighted(found, tune.draws(spark, features.FEATURES, *DRAWS), features.FEATURES)
    return scored.groupBy("point", "qid").agg(F.max_by("concept", F.struct("score", "concept")).alias("concept"), F.max("score").alias("score"))


def expression_extents(spark: SparkSession, d: str) -> DataFrame:
    """Extents of neighbouring title words, in order within 4 places and in any order within 17."""
    ix, exprs = collection(spark, d), _window_exprs(spark, d)
    out = None
    for kind, found in (("od4", windows.ordered_window(ix, exprs, 4)), ("uw17", windows.unordered_window(ix, exprs, 17))):
        rows = windows.extents(found).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.select("kind", "expr_id", "doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


def _nested(spark: SparkSession, d: str) -> list[str]:
    """Texts of windows over two ordered pairs, of the first four words of each title with as many; a stated list."""
    titles = _title_array(topic_terms(spark, d)).where(F.size("words") >= 4).orderBy("qid")
    return list(dict.fromkeys("#uw30(#od4({} {}) #od4({} {}))".format(*r.words[:4]) for r in titles.select("words").collect()))


def nested_window_extents(spark: SparkSession, d: str) -> DataFrame:
    """Extents of unordered windows over ordered pairs."""
    found = windows.extents(windows.trees(collection(spark, d), _nested(spark, d)))
    return found.select("expr_id", "doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


def nested_window_rank(spark: SparkSession, d: str) -> DataFrame:
    """0.6 #combine(title) 0.4 #uw30(#od4(a b) #od4(c d)): a window of windows is smoothed like a term."""
    terms = topic_terms(spark, d)
    titles = _title_array(terms).where(F.size("words") >= 4)
    text = F.concat(F.lit("#uw30(#od4("), F.array_join(F.slice("words", 1, 2), " "), F.lit(") #od4("), F.array_join(F.slice("words", 3, 2), " "), F.lit("))"))
    trees = titles.select("qid", text.alias("expr_id"), F.lit("tree").alias("kind"), F.lit(0).alias("width"), F.array(text).alias("terms"), F.lit(0.4).alias("weight"))
    leaves = title_leaves(terms.join(titles.select("qid"), "qid", "left_semi"), 0.6).unionByName(trees)
    return rank.rank(collection(spark, d), leaves, 10, kinds=None)


def document_expression_counts(spark: SparkSession, d: str) -> DataFrame:
    """Collection and document counts of nested windows, as expression:count lines."""
    counts = windows.collection_counts(windows.trees(collection(spark, d), _nested(spark, d)))
    return counts.select("expr_id", F.concat_ws(":", "expr_id", F.col("n").cast("string")).alias("line"), "docs")


def _named(spark: SparkSession, d: str) -> DataFrame:
    return index.document_map(table(spark, d, "documents"))


def expression_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of neighbouring title words in order, once a match, as one line an expression."""
    found = windows.ordered_window(collection(spark, d), _window_exprs(spark, d), 4)
    return windows.listed(found, _named(spark, d)).select("expr_id", F.array_join("docnos", ",").alias("docnos"))


def brief_expression_lists(spark: SparkSession, d: str) -> DataFrame:
    """For neighbouring title words in any order within 17: all matches, and the best ten documents of the title that have one."""
    ix, terms = collection(spark, d), topic_terms(spark, d)
    pairs = settled(_pairs(_title_array(terms)).select("qid", F.concat_ws(":", F.col("qid").cast("string"), F.array_join("terms", " ")).alias("expr_id"), "terms"))
    best = full_run(spark, d).where("rank <= 10").select("qid", "doc_id").join(pairs.select("qid", "expr_id"), "qid")
    return windows.brief_list(windows.unordered_window(ix, pairs, 17), best, _named(spark, d)).select("expr_id", "n", F.array_join("docnos", ",").alias("docnos"))


def run_lists(spark: SparkSession, d: str) -> DataFrame:
    """The title run as one ordered list a query."""
    run = title_run(collection(spark, d), topic_terms(spark, d), 10).join(_named(spark, d), "doc_id")
    return rank.as_lists(run).select("qid", F.array_join("docnos", ",").alias("docnos"))


def phrase_concept_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of phrases: neighbouring words of each title, in order within 4 places."""
    ix, terms = collection(spark, d), topic_terms(spark, d)
    phrases = _pairs(_title_array(terms)).select("qid", F.array_join("terms", " ").alias("concept")).distinct()
    return features.concept_features(ix, terms, phrases, full_run(spark, d))


def second_hop(spark: SparkSession, d: str) -> DataFrame:
    """Concepts next to the two strongest neighbours of each title."""
    ix, terms = collection(spark, d), topic_terms(spark, d)
    near = topic_edges(spark, d).select(F.col("src").alias("term"), F.col("dst").alias("concept"), "weight").join(terms, "term").groupBy("qid", "concept").agg(F.max("weight").alias("score"))
    near = near.join(terms.select("qid", F.col("term").alias("concept")), ["qid", "concept"], "left_anti")
    front = settled(graph.seeds(near, 2))
    return graph.neighbours(front, edges(ix, front)).withColumnRenamed("term", "seed")


def additive_scores(spark: SparkSession, d: str) -> DataFrame:
    """Association weights of a concept added up over the title's words."""
    terms = topic_terms(spark, d)
    each = terms.join(topic_edges(spark, d).select(F.col("src").alias("term"), F.col("dst").alias("concept"), F.col("weight").alias("score")), "term")
    return features.added_up(each, 6)


def strategy_scores(spark: SparkSession, d: str) -> DataFrame:
    """Concepts by each of the scoring methods over the same statistics."""
    ix, terms, found = _concepts(spark, d)
    weight = topic_edges(spark, d).select(F.col("src").alias("term"), F.col("dst").alias("concept"), "weight").join(terms, "term").groupBy("qid", "concept").agg(F.max("weight").alias("weight"))
    rows = settled(features.sum_to_one(found, features.FEATURES).join(weight, ["qid", "concept"]))
    out = None
    for method in sorted(features.SCORERS):
        some = features.scored_by(method, rows, WEIGHTS).withColumn("method", F.lit(method))
        out = some if out is None else out.unionByName(some)
    return out


def concept_layer_texts(spark: SparkSession, d: str) -> DataFrame:
    """Queries of three layers: the title, its neighbouring words as phrase concepts, and its expansion concepts."""
    _, terms, scored = _scored(spark, d)
    words = _title_array(terms).select("qid", F.lit(0.95).alias("weight"), "words")
    phrases = terms.alias("a").join(terms.alias("b"), (F.col("a.qid") == F.col("b.qid")) & (F.col("b.idx") == F.col("a.idx") + 1)).select("a.qid", F.lit(1).alias("layer"), F.lit(0.05).alias("weight"), F.col("a.idx").alias("concept_rank"), F.concat_ws(" ", "a.term", "b.term").alias("concept"))
    chosen = features.best_concepts(scored, 3, original=terms).select("qid", F.lit(2).alias("layer"), F.lit(0.01).alias("weight"), F.col("rank").alias("concept_rank"), "concept")
    return query.concept_layers(words, phrases.unionByName(chosen))


def set_ops_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of English and of other documents: in both, in one only, in either."""
    voc = lambda where: collection_of(spark, d, where).vocabulary().select("term")
    en, other = voc("lang = 'en'"), voc("lang is null or lang <> 'en'")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return count(en.intersect(other), "both").unionByName(count(en.subtract(other), "first only")).unionByName(count(en.union(other).distinct(), "either"))


def collection_of(spark: SparkSession, d: str, where: str):
    return index.build(table(spark, d, "documents").where(where).select("doc_id", "text"))


def ablation_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Retail price of each brand as a feature's loss."""
    losses = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.sum(F.col("p_retailprice").cast("decimal(18,2)")) / 100).cast("double").alias("loss"))
    losses = losses.withColumn("loss", F.round("loss", 4)).withColumn("position", F.row_number().over(Window.orderBy("feature")).cast("long"))
    return analytics.ablation(losses, 0.1723, 0.2963, digits=6)


def shift_align(spark: SparkSession, d: str) -> DataFrame:
    curve = table(spark, d, "events").groupBy("event_type", F.hour("ts").cast("long").alias("x")).agg(F.round(F.avg("value"), 4).alias("y"))
    return analytics.aligned(curve, "event_type", 100.0)


def layer_rank_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("level"), F.col("s_suppkey").alias("concept"), F.round("s_acctbal", 2).alias("q"))
    return analytics.layer_ranks(rows, 6000.0, 2000.0)


def loess_smooth(spark: SparkSession, d: str) -> DataFrame:
    curve = table(spark, d, "events").groupBy("event_type", F.hour("ts").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return analytics.local_regression(curve, "event_type", 0.5)


QUERIES = [dirichlet_topk, weight_query_topk, nested_weight_topk, two_stage_topk, working_set_rank, ordered_window_count, unordered_window_count, cooccurrence_doc_count, phrase_template, feedback_terms, feedback_rank, assoc_graph_pmi, graph_neighbours, two_hop_neighbours, term_pairs, concept_features, feature_normalize, minmax_normalize, weighted_combine, select_top_concepts, threshold_concepts, layered_query, expanded_query_text, expanded_rank, per_topic_metrics, metric_summary, hard_topics, grid_eval, weight_argmax, random_search, expression_extents, nested_window_extents, nested_window_rank, document_expression_counts, expression_documents, brief_expression_lists, run_lists, phrase_concept_features, second_hop, additive_scores, strategy_scores, concept_layer_texts, coordinate_ascent, weight_sweep, set_ops_terms, ablation_cumulative, shift_align, layer_rank_regions, loess_smooth]

# --- oracles ----------------------------------------------------------------------------------------------------

_LEAVES = "leaves AS (SELECT qid, term, sum(w) AS w FROM ({}) GROUP BY qid, term), cands AS (SELECT DISTINCT qid, doc_id FROM leaves JOIN tf USING (term))"
_TITLE = "SELECT qid, term, {} / count(*) OVER (PARTITION BY qid) AS w FROM topics"


def _ranked(leaves: str, belief: str = _BELIEF, count: int = 10, where: str = "TRUE") -> str:
    return sql("top p len", _LEAVES.format(leaves) + f""",
s AS (SELECT c.qid, c.doc_id, round(sum(v.w * {belief}), 6) AS score FROM cands c JOIN leaves v ON v.qid = c.qid LEFT JOIN prob p ON p.term = v.term JOIN lens l ON l.doc_id = c.doc_id LEFT JOIN tf ON tf.term = v.term AND tf.doc_id = c.doc_id, tot WHERE {where} GROUP BY c.qid, c.doc_id)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {count}""")


_PAIR = "pairs AS (SELECT DISTINCT a.term || ' ' || b.term AS expr_id, a.term AS a, b.term AS b FROM topics a JOIN topics b ON a.qid = b.qid AND b.idx = a.idx + 1)"
_NEAR = "near AS (SELECT DISTINCT t.qid, e.dst AS concept FROM topics t JOIN edges e ON e.src = t.term WHERE (t.qid, e.dst) NOT IN (SELECT (qid, term) FROM topics)), ctf AS (SELECT term AS concept, doc_id, tf FROM tf WHERE term IN (SELECT concept FROM near))"
_OD4 = "od AS (SELECT expr_id, x.doc_id, x.pos AS b, min(y.pos) + 1 AS e FROM pairs p JOIN tok x ON x.term = p.a JOIN tok y ON y.term = p.b AND y.doc_id = x.doc_id AND y.pos > x.pos AND y.pos <= x.pos + 4 GROUP BY expr_id, x.doc_id, x.pos)"
_UW17 = "uw AS (SELECT expr_id, doc_id, b, min(e) AS e FROM (SELECT expr_id, x.doc_id, least(x.pos, y.pos) AS b, greatest(x.pos, y.pos) + 1 AS e FROM pairs p JOIN tok x ON x.term = p.a JOIN tok y ON y.term = p.b AND y.doc_id = x.doc_id AND abs(y.pos - x.pos) < 17) GROUP BY expr_id, doc_id, b)"
_PHRASES = f"{_PAIR}, {_OD4}, near AS (SELECT DISTINCT a.qid, a.term || ' ' || b.term AS concept FROM topics a JOIN topics b ON a.qid = b.qid AND b.idx = a.idx + 1), ctf AS (SELECT expr_id AS concept, doc_id, count(*) AS tf FROM od GROUP BY expr_id, doc_id)"
_FEATURES = """{},
ccf AS (SELECT concept, CAST(sum(tf) AS BIGINT) AS cf FROM ctf GROUP BY concept),
best AS (SELECT r.qid, r.doc_id, r.score, r.rank, l.len FROM run r JOIN lens l USING (doc_id) WHERE rank <= 10),
whole AS (SELECT qid, max(score) AS first, sum(len) AS size FROM best GROUP BY qid),
inside AS (SELECT n.qid, n.concept, sum(x.tf) AS occ, count(*) AS docs, avg(b.score) AS mean, max(b.score) AS largest FROM near n JOIN ctf x USING (concept) JOIN best b ON b.qid = n.qid AND b.doc_id = x.doc_id GROUP BY n.qid, n.concept),
tq AS (SELECT qid, idx, doc_id, tf FROM topics JOIN tf USING (term)),
sz AS (SELECT qid, count(*) AS t FROM topics GROUP BY qid),
one AS (SELECT n.qid, n.concept, y.idx, sum(least(x.tf, y.tf)) AS n, count(b.doc_id) AS near FROM near n JOIN ctf x USING (concept) JOIN tq y ON y.qid = n.qid AND y.doc_id = x.doc_id LEFT JOIN best b ON b.qid = n.qid AND b.doc_id = x.doc_id GROUP BY n.qid, n.concept, y.idx),
cor AS (SELECT qid, concept, sum(n) / CAST(t AS DOUBLE) AS a, max(n) AS b, sum(near) / CAST(t AS DOUBLE) AS c, max(near) AS d FROM one JOIN sz USING (qid) GROUP BY qid, concept, t),
two AS (SELECT n.qid, n.concept, y.idx AS i, z.idx AS j, sum(least(x.tf, y.tf, z.tf)) AS n, count(b.doc_id) AS near FROM near n JOIN ctf x USING (concept) JOIN tq y ON y.qid = n.qid AND y.doc_id = x.doc_id JOIN tq z ON z.qid = n.qid AND z.doc_id = x.doc_id AND y.idx > z.idx LEFT JOIN best b ON b.qid = n.qid AND b.doc_id = x.doc_id GROUP BY n.qid, n.concept, y.idx, z.idx),
pcor AS (SELECT qid, concept, sum(n) / (t * (t - 1) / CAST(2 AS DOUBLE)) AS a, max(n) AS b, sum(near) / (t * (t - 1) / CAST(2 AS DOUBLE)) AS c, max(near) AS d FROM two JOIN sz USING (qid) GROUP BY qid, concept, t),
feats AS (SELECT n.qid, n.concept, {} FROM near n LEFT JOIN whole w ON w.qid = n.qid LEFT JOIN inside i ON i.qid = n.qid AND i.concept = n.concept LEFT JOIN ccf v ON v.concept = n.concept LEFT JOIN cor c ON c.qid = n.qid AND c.concept = n.concept LEFT JOIN pcor q ON q.qid = n.qid AND q.concept = n.concept, tot)"""
_VALUES = ("w.first", "i.occ / CAST(w.size AS DOUBLE)", "i.docs", "i.mean", "i.largest", "ln(n_docs / CAST(greatest(coalesce(v.cf, 0), 1) AS DOUBLE))", "c.a", "c.b", "c.c", "c.d", "q.a", "q.b", "q.c", "q.d")
_ROUNDED = ", ".join(f'round(abs(CAST(coalesce({v}, 0) AS DOUBLE)), 10) AS "{f}"' for v, f in zip(_VALUES, features.FEATURES))
_FEATS = _FEATURES.format(_NEAR, _ROUNDED)
_ONE = ", ".join(f'round(CASE WHEN sum("{f}") OVER g <> 0 THEN "{f}" / sum("{f}") OVER g ELSE 0.0 END, 8) AS "{f}"' for f in features.FEATURES)
_MM = ", ".join(f'round(CASE WHEN max("{f}") OVER g <> min("{f}") OVER g THEN ("{f}" - min("{f}") OVER g) / (max("{f}") OVER g - min("{f}") OVER g) ELSE 0.0 END, 8) AS "{f}"' for f in features.FEATURES)
_SUM = " + ".join(f'{w} * "{f}"' for f, w in WEIGHTS.items())
_SCORED = f"{_FEATS}, normed AS (SELECT qid, concept, {_ONE} FROM feats WINDOW g AS (PARTITION BY qid)), scored2 AS (SELECT qid, concept, round({_SUM}, 10) AS score FROM normed), ranked AS (SELECT qid, concept, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, concept) AS rank FROM scored2)"
_CHOSEN = f"{_SCORED}, chosen AS (SELECT * FROM ranked WHERE rank <= 5)"
_LAYERS = f"{_CHOSEN}, layers AS (SELECT qid, 0 AS layer, 0.7 AS weight, string_agg(term, ' ' ORDER BY idx) AS words FROM topics GROUP BY qid UNION ALL SELECT qid, 1, 0.3, string_agg(concept, ' ' ORDER BY rank) FROM chosen GROUP BY qid)"
_DEPTHS = ", ".join(f"round(CAST(sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS DOUBLE) / {k}, 6) AS P_{k}" for k in evaluate.DEPTHS)
_LEVELS = ", ".join(f"round(coalesce(max(CASE WHEN hits >= {r} * num_rel - 1e-9 THEN CAST(hits AS DOUBLE) / rank END), 0.0), 6) AS iprec_at_recall_{f'{r:.2f}'.replace('.', '_')}" for r in evaluate.LEVELS)


def _per_topic(run: str, key: str) -> str:
    return f"""judged AS (SELECT qid, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS num_rel, sum(CASE WHEN rel <= 0 THEN 1 ELSE 0 END) AS n_not FROM qrels GROUP BY qid),
walked AS (SELECT r.*, j.num_rel, j.n_not, CASE WHEN q.rel > 0 THEN 1 ELSE 0 END AS hit, sum(CASE WHEN q.rel > 0 THEN 1 ELSE 0 END) OVER o AS hits, sum(CASE WHEN q.rel <= 0 THEN 1 ELSE 0 END) OVER o AS misses FROM {run} r JOIN judged j ON j.qid = r.qid AND j.num_rel > 0 LEFT JOIN qrels q ON q.qid = r.qid AND q.doc_id = r.doc_id WINDOW o AS (PARTITION BY {key} ORDER BY r.rank ROWS UNBOUNDED PRECEDING)),
per AS (SELECT {key.replace('r.', '')}, count(*) AS num_ret, CAST(first(num_rel) AS BIGINT) AS num_rel, CAST(sum(hit) AS BIGINT) AS num_rel_ret,
round(sum(CASE WHEN hit = 1 THEN CAST(hits AS DOUBLE) / rank ELSE 0.0 END) / first(num_rel), 6) AS map,
round(CAST(sum(CASE WHEN rank <= num_rel THEN hit ELSE 0 END) AS DOUBLE) / first(num_rel), 6) AS Rprec,
round(sum(CASE WHEN hit = 1 THEN 1 - CASE WHEN least(num_rel, n_not) > 0 THEN least(misses, least(num_rel, n_not)) / CAST(least(num_rel, n_not) AS DOUBLE) ELSE 0.0 END ELSE 0.0 END) / first(num_rel), 6) AS bpref,
round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0.0), 6) AS recip_rank, {_LEVELS}, {_DEPTHS}
FROM walked GROUP BY {key.replace('r.', '')})"""


_MEANS = [c.replace(".", "_") for c in evaluate.metric_names() if c not in evaluate.COUNTS]
_SUMMARY = "count(*) AS num_q, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in evaluate.COUNTS) + ", " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEANS) + ", round(exp(avg(ln(greatest(map, 1e-5)))), 6) AS gm_map"
def _points(points: str) -> str:
    return sql("qrel", f"""s1 AS (SELECT t.qid, tf.doc_id, round(ln((tf.tf + 1600.0 * p.p) / (l.len + 1600.0)), 6) AS s1 FROM topics t JOIN tf ON tf.term = t.term JOIN prob p ON p.term = t.term JOIN lens l ON l.doc_id = tf.doc_id WHERE t.idx = 1),
points AS ({points}),
pscored AS (SELECT point, s.qid, s.doc_id, round((CAST(c0 AS DOUBLE) * s.score + CAST(c1 AS DOUBLE) * s1.s1) / (CAST(c0 AS DOUBLE) + CAST(c1 AS DOUBLE)), 6) AS score FROM scored s JOIN s1 ON s1.qid = s.qid AND s1.doc_id = s.doc_id, points),
pruns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point, qid ORDER BY score DESC, doc_id) AS rank FROM pscored) WHERE rank <= 1000),
{_per_topic('pruns', 'r.point, r.qid')},
sums AS (SELECT p.point, CAST(p.c0 AS DOUBLE) AS c0, CAST(p.c1 AS DOUBLE) AS c1, x.num_q, x.map, x.P_5 FROM points p JOIN (SELECT point, {_SUMMARY} FROM per GROUP BY point) x USING (point))
""")


_GRID = _points("SELECT row_number() OVER (ORDER BY c0, c1) - 1 AS point, c0, c1 FROM (SELECT unnest([0.2, 0.5, 0.8]) AS c0), (SELECT unnest([0.0, 0.3, 0.6]) AS c1)")
_SWEEP = _points(f"SELECT row_number() OVER (ORDER BY c1) - 1 AS point, 0.5 AS c0, c1 FROM (SELECT unnest({list(SWEPT)}) AS c1)")
_WORDS4 = "quads AS (SELECT '#uw30(#od4(' || a || ' ' || b || ') #od4(' || c || ' ' || d || '))' AS expr_id, qid, a, b, c, d FROM (SELECT qid, max(term) FILTER (idx = 1) AS a, max(term) FILTER (idx = 2) AS b, max(term) FILTER (idx = 3) AS c, max(term) FILTER (idx = 4) AS d FROM topics GROUP BY qid) WHERE d IS NOT NULL)"
_TREES = f"""{_WORDS4},
pairs AS (SELECT DISTINCT a || ' ' || b AS expr_id, a, b FROM quads UNION SELECT DISTINCT c || ' ' || d, c, d FROM quads),
{_OD4},
each AS (SELECT DISTINCT expr_id, a || ' ' || b AS k1, c || ' ' || d AS k2 FROM quads),
st AS (SELECT DISTINCT q.expr_id, x.doc_id, x.b AS p, k1, k2 FROM each q JOIN od x ON x.expr_id = q.k1 OR x.expr_id = q.k2),
ends AS (SELECT s.expr_id, s.doc_id, p, min(CASE WHEN x.expr_id = k1 THEN x.e END) AS e1, min(CASE WHEN x.expr_id = k2 THEN x.e END) AS e2 FROM st s JOIN od x ON x.doc_id = s.doc_id AND (x.expr_id = k1 OR x.expr_id = k2) AND x.b >= p GROUP BY s.expr_id, s.doc_id, p),
trees AS (SELECT expr_id, doc_id, p AS b, greatest(e1, e2) AS e FROM ends WHERE e1 IS NOT NULL AND e2 IS NOT NULL AND greatest(e1, e2) - p <= 30)"""
_FEEDBACK = "fbest AS (SELECT r.qid, r.doc_id, exp(score) / sum(exp(score)) OVER (PARTITION BY qid) AS share, len FROM run r JOIN lens l USING (doc_id) WHERE rank <= 28), fw AS (SELECT qid, term, round(sum(share * tf / len), 8) AS weight FROM fbest JOIN tf USING (doc_id) GROUP BY qid, term), fb AS (SELECT qid, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS r FROM fw) WHERE r <= 30)"
_SCORE = "SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"


def _expression_score(leaves: str, found: str) -> str:
    """Scores of weighted expressions leaves(qid, expr_id, w) with matches found(expr_id, doc_id, tf), words included."""
    return f"""leaves AS (SELECT qid, expr_id, sum(w) AS w FROM ({leaves}) GROUP BY qid, expr_id), found AS ({found}),
fcf AS (SELECT expr_id, sum(tf) AS cf FROM found GROUP BY expr_id), cands AS (SELECT DISTINCT qid, doc_id FROM leaves JOIN found USING (expr_id)),
s AS (SELECT c.qid, c.doc_id, round(sum(v.w * ln((coalesce(f.tf, 0) + 1600.0 * coalesce(CAST(x.cf AS DOUBLE), 0.5) / n_tokens) / (l.len + 1600.0))), 6) AS score FROM cands c JOIN leaves v ON v.qid = c.qid LEFT JOIN fcf x ON x.expr_id = v.expr_id JOIN lens l ON l.doc_id = c.doc_id LEFT JOIN found f ON f.expr_id = v.expr_id AND f.doc_id = c.doc_id, tot GROUP BY c.qid, c.doc_id) {_SCORE}"""


_WORD_TF = "SELECT term AS expr_id, doc_id, tf FROM tf WHERE term IN (SELECT term FROM topics)"
_TEMPLATE = f"""{_PAIR}, {_OD4}, sz AS (SELECT qid, count(*) AS t FROM topics GROUP BY qid HAVING count(*) > 1),
tt AS (SELECT t.qid, t.term, k.doc_id, k.pos FROM topics t JOIN tok k USING (term) WHERE (t.qid, k.doc_id) IN (SELECT (qid, doc_id) FROM (SELECT a.qid, b.doc_id, count(*) AS n FROM topics a JOIN tf b USING (term) GROUP BY a.qid, b.doc_id) JOIN sz USING (qid) WHERE n = t)),
wide AS (SELECT qid, doc_id, count(*) AS tf FROM (SELECT x.qid, x.doc_id, x.pos, count(DISTINCT y.term) AS n FROM tt x JOIN tt y ON y.qid = x.qid AND y.doc_id = x.doc_id AND y.pos BETWEEN x.pos AND x.pos + 16 GROUP BY x.qid, x.doc_id, x.pos) JOIN sz USING (qid) WHERE n = t GROUP BY qid, doc_id),
""" + _expression_score(
    "SELECT qid, term AS expr_id, 0.8 / t AS w FROM topics JOIN sz USING (qid) UNION ALL SELECT a.qid, '#od4(' || a.term || ' ' || b.term || ')', 0.1 / (t - 1) FROM topics a JOIN topics b ON a.qid = b.qid AND b.idx = a.idx + 1 JOIN sz ON sz.qid = a.qid UNION ALL SELECT qid, '#uw17 ' || CAST(qid AS VARCHAR), 0.1 FROM sz",
    _WORD_TF + " UNION ALL SELECT '#od4(' || expr_id || ')', doc_id, count(*) FROM od GROUP BY expr_id, doc_id UNION ALL SELECT '#uw17 ' || CAST(qid AS VARCHAR), doc_id, tf FROM wide",
)
_HOP = "hop AS (SELECT qid, concept FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, concept) AS r FROM (SELECT t.qid, e.dst AS concept, max(e.weight) AS score FROM topics t JOIN edges e ON e.src = t.term WHERE (t.qid, e.dst) NOT IN (SELECT (qid, term) FROM topics) GROUP BY t.qid, e.dst)) WHERE r <= 2), " + SQL["edge"].replace("edges AS", "edges2 AS").replace("s.term IN (SELECT term FROM topics)", "s.term IN (SELECT concept FROM hop)")
_POINTS = ", ".join(str((k, *map(float, v))) for k, v in enumerate(tune.drawn(len(features.FEATURES), *DRAWS)))
_RANDOM = f"normed AS (SELECT qid, concept, {_ONE} FROM feats WINDOW g AS (PARTITION BY qid)), points AS (SELECT * FROM (VALUES {_POINTS}) AS v(point, {', '.join(f'w{k}' for k in range(len(features.FEATURES)))})), mixed AS (SELECT CAST(point AS BIGINT) AS point, qid, concept, round({' + '.join(['CAST(0.0 AS DOUBLE)', *(f'CAST(n.\"{f}\" AS DOUBLE) * CAST(w{k} AS DOUBLE)' for k, f in enumerate(features.FEATURES))])}, 10) AS score FROM normed n, points) SELECT point, qid, concept, score FROM (SELECT *, row_number() OVER (PARTITION BY point, qid ORDER BY score DESC, concept DESC) AS r FROM mixed) WHERE r = 1"
_CLAUSE = "'1.0 #weight(0.8 #combine(' || {0} || ') 0.1 #combine(' || {1} || ') 0.1 #uw17(' || {0} || '))'"
_LAYERED3 = f"""{_SCORED}, parts AS (
SELECT qid, 0 AS layer, '0.95 #combine(' || string_agg(term, ' ' ORDER BY idx) || ')' AS part FROM topics GROUP BY qid
UNION ALL SELECT qid, 1, '0.05 #weight(' || string_agg({_CLAUSE.format('c', "'#od4(' || c || ')'")}, ' ' ORDER BY idx) || ')' FROM (SELECT a.qid, a.idx, a.term || ' ' || b.term AS c FROM topics a JOIN topics b ON a.qid = b.qid AND b.idx = a.idx + 1) WHERE length(c) >= 4 GROUP BY qid
UNION ALL SELECT qid, 2, '0.01 #weight(' || string_agg({_CLAUSE.format('concept', 'concept')}, ' ' ORDER BY rank) || ')' FROM ranked WHERE rank <= 3 AND length(concept) >= 4 GROUP BY qid)
SELECT qid, '#weight(' || string_agg(part, ' ' ORDER BY layer) || ')' AS text FROM parts GROUP BY qid"""
_STRATEGIES = f"""{_FEATS}, normed AS (SELECT qid, concept, {_ONE} FROM feats WINDOW g AS (PARTITION BY qid)), heavy AS (SELECT t.qid, e.dst AS concept, max(e.weight) AS weight FROM topics t JOIN edges e ON e.src = t.term GROUP BY t.qid, e.dst), both_ AS (SELECT * FROM normed JOIN heavy USING (qid, concept))
SELECT qid, concept, round({_SUM}, 10) AS score, 'features' AS method FROM both_ UNION ALL SELECT qid, concept, round(weight, 10), 'association' FROM both_ UNION ALL SELECT qid, concept, round(weight * "conIdf", 10), 'association_idf' FROM both_"""
ORACLES = {
    "dirichlet_topk": _ranked(_TITLE.format("1.0")),
    "weight_query_topk": _ranked(_TITLE.format("0.7") + " UNION ALL SELECT qid, term, 0.3 FROM topics WHERE idx = 1"),
    "nested_weight_topk": _ranked(_TITLE.format("0.2") + " UNION ALL SELECT qid, term, 0.56 FROM topics WHERE idx = 1 UNION ALL SELECT qid, arg_max(term, idx), 0.24 FROM topics GROUP BY qid"),
    "two_stage_topk": _ranked(_TITLE.format("1.0"), "ln(0.6 * (coalesce(tf.tf, 0) + 2500.0 * coalesce(p.p, 0.5 / n_tokens)) / (l.len + 2500.0) + 0.4 * coalesce(p.p, 0.5 / n_tokens))"),
    "working_set_rank": _ranked(_TITLE.format("1.0"), where="c.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "ordered_window_count": sql("top tok", f"{_PAIR}, {_OD4} SELECT expr_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM od GROUP BY expr_id"),
    "unordered_window_count": sql("top tok", f"{_PAIR}, {_UW17} SELECT expr_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM uw GROUP BY expr_id"),
    "expression_extents": sql("top tok", f"{_PAIR}, {_OD4}, {_UW17} SELECT 'od4' AS kind, expr_id, doc_id, b AS begin, e AS \"end\" FROM od UNION ALL SELECT 'uw17', expr_id, doc_id, b, e FROM uw"),
    "nested_window_extents": sql("top tok", f"{_TREES} SELECT expr_id, doc_id, b AS begin, e AS \"end\" FROM trees"),
    "document_expression_counts": sql("top tok", f"{_TREES} SELECT expr_id, expr_id || ':' || CAST(count(*) AS VARCHAR) AS line, count(DISTINCT doc_id) AS docs FROM trees GROUP BY expr_id"),
    "nested_window_rank": sql("top tf len tot", f"{_TREES}, " + _expression_score("SELECT qid, term AS expr_id, 0.6 / count(*) OVER (PARTITION BY qid) AS w FROM topics WHERE qid IN (SELECT qid FROM quads) UNION ALL SELECT qid, expr_id, 0.4 FROM quads", _WORD_TF + " UNION ALL SELECT expr_id, doc_id, count(*) FROM trees GROUP BY expr_id, doc_id")),
    "phrase_template": sql("top tf len tot", _TEMPLATE),
    "feedback_rank": sql("run", _FEEDBACK + ", " + _LEAVES.format("SELECT qid, term, 0.5 / count(*) OVER (PARTITION BY qid) AS w FROM topics UNION ALL SELECT qid, term, 0.5 * weight / sum(weight) OVER (PARTITION BY qid) FROM fb") + f", s AS (SELECT c.qid, c.doc_id, round(sum(v.w * {_BELIEF}), 6) AS score FROM cands c JOIN leaves v ON v.qid = c.qid LEFT JOIN prob p ON p.term = v.term JOIN lens l ON l.doc_id = c.doc_id LEFT JOIN tf ON tf.term = v.term AND tf.doc_id = c.doc_id, tot GROUP BY c.qid, c.doc_id) {_SCORE}"),
    "expression_documents": sql("top tok", f"{_PAIR}, {_OD4} SELECT expr_id, string_agg('D' || CAST(doc_id AS VARCHAR), ',' ORDER BY 'D' || CAST(doc_id AS VARCHAR)) AS docnos FROM od GROUP BY expr_id"),
    "brief_expression_lists": sql("run", f"{_PAIR}, {_UW17}, own AS (SELECT a.qid, CAST(a.qid AS VARCHAR) || ':' || a.term || ' ' || b.term AS expr_id, a.term || ' ' || b.term AS pair FROM topics a JOIN topics b ON a.qid = b.qid AND b.idx = a.idx + 1) SELECT o.expr_id, count(*) AS n, coalesce(string_agg('D' || CAST(r.doc_id AS VARCHAR), ',' ORDER BY 'D' || CAST(r.doc_id AS VARCHAR)), '') AS docnos FROM own o JOIN uw u ON u.expr_id = o.pair LEFT JOIN run r ON r.qid = o.qid AND r.doc_id = u.doc_id AND r.rank <= 10 GROUP BY o.expr_id"),
    "run_lists": sql("run", "SELECT qid, string_agg('D' || CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS docnos FROM run WHERE rank <= 10 GROUP BY qid"),
    "phrase_concept_features": sql("run", f"{_FEATURES.format(_PHRASES, _ROUNDED)} SELECT * FROM feats"),
    "second_hop": sql("edge tf", f"{_HOP} SELECT DISTINCT h.qid, h.concept AS seed, e.dst AS concept FROM hop h JOIN edges2 e ON e.src = h.concept"),
    "additive_scores": sql("edge", "SELECT t.qid, e.dst AS concept, round(sum(e.weight), 6) AS score FROM topics t JOIN edges e ON e.src = t.term GROUP BY t.qid, e.dst"),
    "strategy_scores": sql("edge run", _STRATEGIES),
    "concept_layer_texts": sql("edge run", _LAYERED3),
    "random_search": sql("edge run", f"{_FEATS}, {_RANDOM}"),
    "weight_sweep": _SWEEP + " SELECT c1, map FROM sums",
    "cooccurrence_doc_count": sql("top tf", f"{_PAIR} SELECT expr_id, CAST(sum(least(x.tf, y.tf)) AS BIGINT) AS n, count(*) AS docs FROM pairs p JOIN tf x ON x.term = p.a JOIN tf y ON y.term = p.b AND y.doc_id = x.doc_id GROUP BY expr_id"),
    "feedback_terms": sql("run", "best AS (SELECT r.qid, r.doc_id, exp(score) / sum(exp(score)) OVER (PARTITION BY qid) AS share, len FROM run r JOIN lens l USING (doc_id) WHERE rank <= 28), w AS (SELECT qid, term, round(sum(share * tf / len), 8) AS weight FROM best JOIN tf USING (doc_id) GROUP BY qid, term) SELECT qid, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS r FROM w) WHERE r <= 30"),
    "assoc_graph_pmi": sql("edge", "SELECT src, dst, df_both, weight FROM edges"),
    "graph_neighbours": sql("edge", "SELECT DISTINCT t.qid, t.term, e.dst AS concept FROM topics t JOIN edges e ON e.src = t.term"),
    "two_hop_neighbours": sql("edge", "h1 AS (SELECT DISTINCT t.qid, e.dst AS concept FROM topics t JOIN edges e ON e.src = t.term WHERE (t.qid, e.dst) NOT IN (SELECT (qid, term) FROM topics)), h2 AS (SELECT DISTINCT t.qid, e.dst AS concept FROM h1 t JOIN edges e ON e.src = t.concept WHERE (t.qid, e.dst) NOT IN (SELECT (qid, term) FROM topics) AND (t.qid, e.dst) NOT IN (SELECT (qid, concept) FROM h1)) SELECT DISTINCT qid, term AS concept, CAST(0 AS BIGINT) AS layer FROM topics UNION ALL SELECT qid, concept, 1 FROM h1 UNION ALL SELECT qid, concept, 2 FROM h2"),
    "term_pairs": sql("top", "SELECT a.qid, a.term AS a, b.term AS b FROM topics a JOIN topics b ON a.qid = b.qid AND a.idx > b.idx"),
    "concept_features": sql("edge run", f"{_FEATS} SELECT * FROM feats"),
    "feature_normalize": sql("edge run", f"{_FEATS} SELECT qid, concept, {_ONE} FROM feats WINDOW g AS (PARTITION BY qid)"),
    "minmax_normalize": sql("edge run", f"{_FEATS} SELECT qid, concept, {_MM} FROM feats WINDOW g AS (PARTITION BY qid)"),
    "weighted_combine": sql("edge run", f"{_SCORED} SELECT qid, concept, score FROM scored2"),
    "select_top_concepts": sql("edge run", f"{_SCORED} SELECT qid, concept, score, rank FROM ranked WHERE rank <= 5"),
    "threshold_concepts": sql("edge run", f"{_SCORED} SELECT qid, concept, score, rank FROM ranked WHERE rank <= 20 AND score >= 0.05"),
    "layered_query": sql("edge run", f"{_LAYERS} SELECT qid, CAST(layer AS BIGINT) AS layer, CAST(weight AS DOUBLE) AS weight, words FROM layers"),
    "expanded_query_text": sql("edge run", f"{_LAYERS} SELECT qid, '#weight(' || string_agg(CASE WHEN layer = 0 THEN '0.70' ELSE '0.30' END || ' #combine(' || words || ')', ' ' ORDER BY layer) || ')' AS text FROM layers GROUP BY qid"),
    "expanded_rank": sql("edge run", _CHOSEN + ", " + _LEAVES.format("SELECT qid, term, CASE WHEN qid IN (SELECT qid FROM chosen) THEN 0.7 ELSE 1.0 END / count(*) OVER (PARTITION BY qid) AS w FROM topics UNION ALL SELECT qid, concept, 0.3 / count(*) OVER (PARTITION BY qid) FROM chosen") + ", s AS (SELECT c.qid, c.doc_id, round(sum(v.w * " + _BELIEF + "), 6) AS score FROM cands c JOIN leaves v ON v.qid = c.qid LEFT JOIN prob p ON p.term = v.term JOIN lens l ON l.doc_id = c.doc_id LEFT JOIN tf ON tf.term = v.term AND tf.doc_id = c.doc_id, tot GROUP BY c.qid, c.doc_id) SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"),
    "per_topic_metrics": sql("qrel", _per_topic("run", "r.qid") + " SELECT * FROM per"),
    "metric_summary": sql("qrel", _per_topic("run", "r.qid") + f" SELECT {_SUMMARY} FROM per"),
    "hard_topics": sql("qrel", _per_topic("run", "r.qid") + " SELECT qid, map FROM per WHERE map < 0.5"),
    "grid_eval": _GRID + " SELECT * FROM sums",
    "weight_argmax": _GRID + " SELECT point, c0, c1, map FROM sums ORDER BY map DESC, point LIMIT 1",
    "set_ops_terms": sql("tok", "en AS (SELECT DISTINCT term FROM tok JOIN documents USING (doc_id) WHERE lang = 'en'), other AS (SELECT DISTINCT term FROM tok JOIN documents USING (doc_id) WHERE lang IS NULL OR lang <> 'en') SELECT 'both' AS op, count(*) AS n FROM (SELECT term FROM en INTERSECT SELECT term FROM other) UNION ALL SELECT 'first only', count(*) FROM (SELECT term FROM en EXCEPT SELECT term FROM other) UNION ALL SELECT 'either', count(*) FROM (SELECT term FROM en UNION SELECT term FROM other)"),
    "ablation_cumulative": "WITH l AS (SELECT p_brand AS feature, round(CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / 100, 4) AS loss FROM part GROUP BY p_brand), s AS (SELECT feature, row_number() OVER (ORDER BY feature) AS position, loss * 0.1723 / (SELECT sum(loss) FROM l) AS share FROM l) SELECT feature, position, round(share, 6) AS norm_loss, round(sum(share) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING), 6) AS cum_loss, round(0.2963 - sum(share) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING), 6) AS reduced FROM s",
    "shift_align": "WITH c AS (SELECT event_type, CAST(hour(ts) AS BIGINT) AS x, round(avg(value), 4) AS y FROM events GROUP BY 1, 2) SELECT event_type, x, round(y + 100.0 - max(y) OVER (PARTITION BY event_type), 6) AS y FROM c",
    "layer_rank_regions": "SELECT CAST(s_nationkey AS BIGINT) AS level, s_suppkey AS concept, round(s_acctbal, 2) AS q, row_number() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal, 2) DESC, s_suppkey) AS in_layer, row_number() OVER (ORDER BY round(s_acctbal, 2) DESC, s_suppkey) AS overall, CASE WHEN round(s_acctbal, 2) >= 6000 THEN 'selection' WHEN round(s_acctbal, 2) < 2000 THEN 'rejection' ELSE 'uncertainty' END AS region FROM supplier",
}
