"""Readers and writers of topics, graphs, vocabularies, runs, judgments, metrics and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _trimmed(value, pattern: str):
    return F.regexp_replace(F.regexp_extract(value, pattern, 1), r"^\s+|\s+$", "")


def sgml_topics(spark: SparkSession, path: str) -> DataFrame:
    """qid, title of <top> records whose <num> and <title> are not closed."""
    rows = spark.read.option("lineSep", "</top>").text(path)
    return rows.select(_trimmed("value", r"<num>\s*Number:\s*([^\n<]*)").alias("qid"), _trimmed("value", r"<title>\s*([^\n<]*)").alias("title")).where("qid <> ''")


def doc_topics(spark: SparkSession, path: str) -> DataFrame:
    """qid, title of <DOC><DOCNO>..</DOCNO><TEXT>..</TEXT></DOC> records, closing tags optional."""
    rows = spark.read.option("lineSep", "</DOC>").text(path)
    return rows.select(_trimmed("value", r"<DOCNO>\s*([^\n<]*)").alias("qid"), _trimmed("value", r"(?s)<TEXT>\s*([^<]*)").alias("title")).where("qid <> ''")


def xml_topics(spark: SparkSession, path: str) -> DataFrame:
    """qid, title of <topic number=".."><summary>..</summary></topic> records."""
    schema = T.StructType([T.StructField("_number", T.StringType()), T.StructField("summary", T.StringType())])
    return spark.read.format("xml").option("rowTag", "topic").schema(schema).load(path).select(F.col("_number").alias("qid"), F.trim("summary").alias("title"))


def colon_topics(spark: SparkSession, path: str) -> DataFrame:
    """qid, title of "id:text" lines."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(parts[0]).alias("qid"), F.trim(parts[1]).alias("title"))


def query_parameters(spark: SparkSession, path: str) -> DataFrame:
    """number, text of the queries of a parameter file."""
    return spark.read.format("xml").option("rowTag", "query").schema("number STRING, text STRING").load(path).select(F.trim("number").alias("number"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def _pipes(spark: SparkSession, path: str, places: dict[str, int], trim: bool = False) -> DataFrame:
    parts = F.split("value", r"\|")
    pick = lambda k: F.trim(parts[k]) if trim else parts[k]
    return spark.read.text(path).where(F.size(parts) > max(places.values())).select(*[pick(k).alias(c) for c, k in places.items()])


# Columns of the vocabulary files, by place.
def relations(spark: SparkSession, path: str) -> DataFrame:
    """Distinct cui1, cui2 of a relation file."""
    return _pipes(spark, path, {"cui1": 0, "cui2": 4}).distinct()


def semantic_types(spark: SparkSession, path: str) -> DataFrame:
    return _pipes(spark, path, {"cui": 0, "tui": 1}).groupBy("cui").agg(F.sort_array(F.collect_set("tui")).alias("tuis"))


def concept_names(spark: SparkSession, path: str) -> DataFrame:
    return _pipes(spark, path, {"cui": 0, "lat": 1, "ts": 2, "stt": 4, "ispref": 6, "name": 14})


def type_table(spark: SparkSession, path: str) -> DataFrame:
    return _pipes(spark, path, {"abbr": 0, "tui": 1, "name": 2}, trim=True)


def concept_edges(spark: SparkSession, path: str) -> DataFrame:
    """rel, src, dst and line of a comma-separated edge file; line orders rows by file, part of the file and place in the part."""
    rows = spark.read.csv(path, schema="rel STRING, src STRING, dst STRING", sep=",")
    return rows.select("rel", "src", "dst", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("line"))


def document_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="doc_id BIGINT, docno STRING", sep=" ")


def expression_counts(spark: SparkSession, path: str) -> DataFrame:
    """expr, n of a tab-separated cache; counts may be written as decimals. A missing file gives no rows."""
    try:
        rows = spark.read.csv(path, schema="expr STRING, n DOUBLE", sep="\t")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "expr string, n bigint")
    return rows.where("expr <> ''").select("expr", F.col("n").cast("bigint").alias("n"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """qid, docno, rank, score of six-field run lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 5).select(parts[0].alias("qid"), parts[2].alias("docno"), parts[3].cast("long").alias("rank"), parts[4].cast("double").alias("score"))


def judgments(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 4).select(parts[0].alias("qid"), parts[2].alias("docno"), parts[3].cast("int").alias("rel"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """metric, qid, value of tab-separated metric lines without blanks and the row that names the run."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 3).select(parts[0].alias("metric"), parts[1].alias("qid"), parts[2].alias("value")).where("metric <> 'runid' and metric <> ''").withColumn("value", F.col("value").cast("double"))


def metric_value(table: DataFrame, metric: str = "map", qid: str = "all") -> DataFrame:
    return table.where((F.col("metric") == metric) & (F.col("qid") == qid)).select("value")


def expression_lists(spark: SparkSession, path: str) -> DataFrame:
    """expr, n, docs of "expr:n,doc,doc,:rest" lines; docs without empty ones."""
    parts = F.split("value", ":")
    items = F.filter(F.split(parts[1], ","), lambda x: x != "")
    return spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("expr"), F.get(items, F.lit(0)).cast("bigint").alias("n"), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))).alias("docs"))


def similar_terms(rows: DataFrame, column: str, language: str = "/c/en/") -> DataFrame:
    """(uri, weight) of {"similar": [[uri, weight], ..]} documents in a string column, for one language."""
    pair = F.explode(F.from_json(column, "similar array<array<string>>")["similar"])
    return rows.select(pair.alias("p")).select(F.col("p")[0].alias("uri"), F.col("p")[1].cast("double").alias("weight")).where(F.col("uri").contains(language))


def annotations(rows: DataFrame) -> DataFrame:
    """(qid, cui, name, sty) of annotator lines(qid, line): every three kept lines name a concept, its id and its types."""
    kept = F.filter("lines", lambda x: F.split(x, ":")[0].isin("Concept Name", "Concept Id", "Semantic Types"))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    grouped = rows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]).alias("lines")).select("qid", kept.alias("kept"))
    each = grouped.select("qid", "kept", F.explode(F.sequence(F.lit(0), F.size("kept") - 3, F.lit(3))).alias("k")).where(F.size("kept") >= 3)
    return each.select("qid", value(F.get("kept", F.col("k") + 1)).alias("cui"), value(F.get("kept", F.col("k"))).alias("name"), F.trim(F.translate(value(F.get("kept", F.col("k") + 2)), "[]", "")).alias("sty"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines that are not empty, repeated ones as often as they occur."""
    return spark.read.text(path).where("value <> ''")


def distinct_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).distinct()


def curves(spark: SparkSession, path: str, names: list[str], header: bool) -> DataFrame:
    """Comma-separated doubles with or without a header line, columns named by `names`; blanks and words are null."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, schema=schema, header=header, enforceSchema=True)
    return rows.select(*[F.col(n).try_cast("double").alias(n) for n in names])


def write_lines(lines_: DataFrame, path: str) -> None:
    """The column value as text, one part a task."""
    lines_.select("value").write.mode("overwrite").text(path)


def write_ordered(lines_: DataFrame, path: str) -> None:
    """lines_(at, value) as text in order of `at`: parts by ranges of it, so that the parts in order of name are one file."""
    lines_.repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def expression_batch(exprs: DataFrame, command: str) -> DataFrame:
    """value: a batch file's lines for a command over exprs(text): each distinct expression once, odd characters blanked."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\w#(),:\-\s]+", " "), r"\s+", " "))
    return exprs.select(F.concat(F.lit(f"{command} "), clean).alias("value")).distinct()


def expression_list_lines(brief: DataFrame) -> DataFrame:
    """value: "expr:n,doc,doc,:asked" lines of brief(expr_id, n, docnos, asked)."""
    docs = F.array_join(F.transform("docnos", lambda x: F.concat(x, F.lit(","))), "")
    return brief.select(F.concat("expr_id", F.lit(":"), F.col("n").cast("string"), F.lit(","), docs, F.lit(":"), "asked").alias("value"))


def write_run(run: DataFrame, path: str, tag: str = "termloom") -> None:
    """Run lines of run(qid, docno, rank, score), one file a task, sorted within."""
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "docno", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag))
    run.repartition("qid").sortWithinPartitions("qid", "rank").select(line.alias("value")).write.mode("overwrite").text(path)


def write_metrics(table: DataFrame, path: str) -> None:
    """Metric lines of table(metric, qid, value), the name padded as the usual evaluators do."""
    table.select(F.concat_ws("\t", F.rpad("metric", 22, " "), "qid", F.format_string("%.4f", F.col("value"))).alias("value")).write.mode("overwrite").text(path)
