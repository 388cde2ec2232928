"""The driver's tables as a collection: documents, topics, judgments and an association graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.operators import graph, index, query, rank, windows
from termloom.operators.settle import settled, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str) -> index.Index:
    """The written index of documents, built by the first query that asks for it and opened by all others."""
    return index.stored(spark, f"{sf_dir}/documents.parquet", {"id": "doc_id", "text": "text"})


def parsed(spark: SparkSession, sf_dir: str) -> index.Index:
    """The documents of the collection, for listings that need no table of the index."""
    return index.parsed(spark, f"{sf_dir}/documents.parquet", {"id": "doc_id", "text": "text"})


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of statistics of the collection, made by the first query of the session that needs it and read by the others."""
    key = (spark.sparkContext.applicationId, index.mark(spark, f"{sf_dir}/documents.parquet"), index.mark(spark, f"{sf_dir}/benchmark.parquet"), name)
    if key not in _KEPT:
        _KEPT[key] = settled(make())
    return _KEPT[key]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, title: an item's first sentence, up to a full stop or the line's end."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.regexp_extract("text", "^[^.\n]*", 0).alias("title"))


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, idx from 1, term: all words of the titles in order, each once, however many documents hold them."""
    words = titles(spark, sf_dir).select("qid", F.posexplode(F.array_distinct(tx.tokens(F.col("title")))).alias("pos", "term"))
    return small(words.select("qid", (F.col("pos") + 1).cast("long").alias("idx"), "term"))


def title_leaves(terms: DataFrame, weight: float = 1.0) -> DataFrame:
    """Leaves of #combine(title), weights summing to `weight`."""
    return query.term_leaves(terms, F.lit(weight) / F.count("*").over(Window.partitionBy("qid")))


def title_run(ix: index.Index, terms: DataFrame, count: int = 10) -> DataFrame:
    return rank.rank(ix, title_leaves(terms), count)


def judgments(spark: SparkSession, sf_dir: str, ix: index.Index, run: DataFrame) -> DataFrame:
    """qid, doc_id, rel: documents that hold the item's fifth to tenth term in a row are relevant; all others of the
    run's best 100 by topic are judged not relevant."""
    words = tx.tokens(F.col("text"))
    items = table(spark, sf_dir, "benchmark").where(F.size(words) >= 10).select(F.col("item_id").cast("string").alias("expr_id"), F.slice(words, 5, 6).alias("terms"))
    hits = settled(windows.ordered_window(ix, items, 1).select(F.col("expr_id").cast("long").alias("qid"), "doc_id", F.lit(1).alias("rel")))
    others = run.where("rank <= 100").select("qid", "doc_id").join(hits, ["qid", "doc_id"], "left_anti")
    return settled(hits.unionByName(others.withColumn("rel", F.lit(0))))


def edges(ix: index.Index, terms: DataFrame) -> DataFrame:
    return graph.association(ix, terms, 3, 5, 0.1, 20)


def topic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The association graph out of all title words."""
    return kept(spark, sf_dir, "edges", lambda: edges(collection(spark, sf_dir), topic_terms(spark, sf_dir)))


def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title run's best 1000 a topic."""
    return kept(spark, sf_dir, "run", lambda: title_run(collection(spark, sf_dir), topic_terms(spark, sf_dir), 1000))


# The same tables in SQL. Each entry may use those before it.
_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_BELIEF = "ln((coalesce(tf.tf, 0) + 1600.0 * coalesce(p.p, 0.5 / n_tokens)) / (l.len + 1600.0))"
SQL = {
    "tok": f"tok AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS term FROM (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS t FROM documents))",
    "len": "lens AS (SELECT d.doc_id, count(k.pos) AS len FROM documents d LEFT JOIN tok k ON k.doc_id = d.doc_id GROUP BY d.doc_id)",
    "tf": "tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id)",
    "voc": "voc AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term)",
    "tot": "tot AS (SELECT count(*) AS n_docs, CAST(sum(len) AS BIGINT) AS n_tokens FROM lens)",
    "top": f"topics AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS idx, term FROM (SELECT qid, term, min(pos) AS pos FROM (SELECT qid, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS term FROM (SELECT item_id AS qid, {_WORDS.format("regexp_extract(text, '^[^.' || chr(10) || ']*')")} AS t FROM benchmark)) GROUP BY qid, term))",
    "p": "prob AS (SELECT term, CAST(cf AS DOUBLE) / n_tokens AS p FROM voc, tot)",
    "cand": "cand AS (SELECT DISTINCT qid, doc_id FROM topics JOIN tf USING (term))",
    "sc": f"scored AS (SELECT c.qid, c.doc_id, round(avg({_BELIEF}), 6) AS score FROM cand c JOIN topics t ON t.qid = c.qid LEFT JOIN prob p ON p.term = t.term JOIN lens l ON l.doc_id = c.doc_id LEFT JOIN tf ON tf.term = t.term AND tf.doc_id = c.doc_id, tot GROUP BY c.qid, c.doc_id)",
    "run": "run AS (SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 1000)",
    "good": "good AS (SELECT term, df FROM voc, tot WHERE df >= 5 AND df <= n_docs * 0.1)",
    "edge": "edges AS (SELECT src, dst, df_both, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM (SELECT b.src, b.dst, b.df_both, round(ln(CAST(b.df_both AS DOUBLE) * n_docs / (CAST(x.df AS DOUBLE) * y.df)), 6) AS weight FROM (SELECT s.term AS src, d.term AS dst, count(*) AS df_both FROM tf s JOIN tf d ON s.doc_id = d.doc_id WHERE s.term <> d.term AND s.term IN (SELECT term FROM topics) AND s.term IN (SELECT term FROM good) AND d.term IN (SELECT term FROM good WHERE length(term) >= 4) GROUP BY s.term, d.term HAVING count(*) >= 3) b JOIN voc x ON x.term = b.src JOIN voc y ON y.term = b.dst, tot)) WHERE r <= 20)",
    "qrel": f"line AS (SELECT doc_id, ' ' || string_agg(term, ' ' ORDER BY pos) || ' ' AS line FROM tok GROUP BY doc_id), phrase AS (SELECT item_id AS qid, ' ' || array_to_string(t[5:10], ' ') || ' ' AS phrase FROM (SELECT item_id, {_WORDS.format('text')} AS t FROM benchmark) WHERE len(t) >= 10), hits AS (SELECT qid, doc_id FROM phrase, line WHERE contains(line, phrase)), qrels AS (SELECT qid, doc_id, 1 AS rel FROM hits UNION ALL SELECT qid, doc_id, 0 AS rel FROM run WHERE rank <= 100 AND (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM hits))",
}
_NEEDS = {"len": ["tok"], "tf": ["tok"], "voc": ["tf"], "tot": ["len"], "p": ["voc", "tot"], "cand": ["top", "tf"], "sc": ["cand", "p", "len"], "run": ["sc"], "good": ["voc", "tot"], "edge": ["top", "good"], "qrel": ["run", "tok"]}


def sql(tables: str, rest: str) -> str:
    """A statement over the named tables (and what they need), `rest` being further tables and the final SELECT."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in tables.split():
        need(name)
    return "WITH " + ",\n".join(SQL[n] for n in order) + ("\n" if rest.lstrip().upper().startswith("SELECT") else ",\n") + rest
