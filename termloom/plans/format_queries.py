"""Sources, sinks and text functions over the driver's tables: each format is written from a table and read back."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import beliefs
from termloom.functions import text as tx
from termloom.operators import analytics, evaluate, graph, index, query
from termloom.operators.settle import remove_at_exit, shared_folder
from termloom.plans.collection import collection, full_run, judgments, sql, table, titles, topic_terms
from termloom.sources import formats


def _place(spark: SparkSession, suffix: str = "") -> str:
    return f"{shared_folder(spark)}/exchange/{uuid.uuid4().hex}{suffix}"


def _written(lines: DataFrame) -> str:
    """A path under which the lines of lines(value), or of lines(at, value) in order, stand as text until the session ends."""
    path = _place(lines.sparkSession)
    (formats.write_ordered if "at" in lines.columns else formats.write_lines)(lines, path)
    remove_at_exit(lines.sparkSession, path)
    return path


def sgml_topics(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("<top>\n<num> Number: %d \n<title> %s \n\n<desc> Description:\nnothing\n</top>\n", "qid", "title")
    return formats.sgml_topics(spark, _written(titles(spark, d).select(text.alias("value"))))


def doc_topics(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("<DOC>\n<DOCNO>%d</DOCNO>\n<TEXT>\n%s\n</TEXT>\n</DOC>", "qid", "title")
    return formats.doc_topics(spark, _written(titles(spark, d).select(text.alias("value"))))


def xml_topics(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string('<topic number="%d"><summary>%s</summary></topic>', "qid", "title")
    whole = titles(spark, d).agg(F.array_join(F.collect_list(text), "\n").alias("t"))  # a stated list of topics
    return formats.xml_topics(spark, _written(whole.select(F.concat(F.lit("<topics>\n"), F.col("t"), F.lit("\n</topics>")).alias("value"))))


def colon_topics(spark: SparkSession, d: str) -> DataFrame:
    return formats.colon_topics(spark, _written(titles(spark, d).select(F.format_string("wt-%d:%s: more", "qid", "title").alias("value"))))


def rrf_relations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as concepts related to their nations, each line twice."""
    line = F.format_string("S%d|AUI|SCUI|RO|N%d|", "s_suppkey", "s_nationkey")
    rows = table(spark, d, "supplier").select(line.alias("value"))
    return formats.relations(spark, _written(rows.unionAll(rows)))


def semantic_type_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.format_string("C%s|T%d|", "p_brand", F.pmod("p_size", F.lit(7))).alias("value"))
    return formats.semantic_types(spark, _written(rows)).select("cui", F.array_join("tuis", ",").alias("tuis"))


def preferred_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of a vocabulary file: preferred English ones of one plain word, brackets taken off before."""
    name = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.regexp_extract("p_type", "([A-Z]+)$", 1)).otherwise(F.concat(F.regexp_extract("p_type", "([A-Z]+)$", 1), F.lit("[x]")))
    line = F.concat_ws("|", F.format_string("C%d", "p_partkey"), F.when(F.col("p_size") < 40, "ENG").otherwise("SPA"), F.when(F.col("p_size") > 25, "P").otherwise("S"), F.lit("L"), F.lit("PF"), F.lit("S"), F.lit("Y"), *[F.lit("x")] * 7, name, F.lit(""))
    return graph.names_table(formats.concept_names(spark, _written(table(spark, d, "part").select(line.alias("value")))))


def type_file(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.format_string("n%d| T%d | %s ", "n_nationkey", "n_regionkey", "n_name").alias("value"))
    return formats.type_table(spark, _written(rows))


def edge_file(spark: SparkSession, d: str) -> DataFrame:
    """A graph read from an edge file; of several relations between the same ends that of the last line counts."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("at"), F.concat_ws(",", F.concat(F.lit("/r/"), F.col("event_type")), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.get_json_object("props", "$.k")).alias("value"))
    return graph.last_wins(formats.concept_edges(spark, _written(rows)), "line")


def document_name_file(spark: SparkSession, d: str) -> DataFrame:
    rows = index.document_map(table(spark, d, "documents")).select(F.format_string("%d %s", "doc_id", "docno").alias("value"))
    return formats.document_names(spark, _written(rows))


def expression_count_file(spark: SparkSession, d: str) -> DataFrame:
    """A cache of counts written and read; one that is not there gives no rows."""
    counts = index.term_counts(collection(spark, d), topic_terms(spark, d)).select("term", "cf").distinct()
    cache = formats.expression_counts(spark, _written(counts.select(F.format_string("%s\t%d.0", "term", "cf").alias("value"))))
    return cache.unionByName(formats.expression_counts(spark, _place(spark)))


def run_file(spark: SparkSession, d: str) -> DataFrame:
    """The title run's best ten as run lines, written and read."""
    run = full_run(spark, d).where("rank <= 10").join(index.document_map(table(spark, d, "documents")), "doc_id").select(F.col("qid").cast("string").alias("qid"), "docno", "rank", "score")
    path = _place(spark)
    formats.write_run(run, path)
    remove_at_exit(spark, path)
    return formats.runs(spark, path)


def judgment_file(spark: SparkSession, d: str) -> DataFrame:
    judged = judgments(spark, d, collection(spark, d), full_run(spark, d))
    return formats.judgments(spark, _written(judged.select(F.format_string("%d 0 D%d %d", "qid", "doc_id", "rel").alias("value"))))


def metric_file(spark: SparkSession, d: str) -> DataFrame:
    """Metric lines of the title run, a topic at a time and in summary, written and read."""
    topics = evaluate.per_topic(full_run(spark, d), judgments(spark, d, collection(spark, d), full_run(spark, d)))
    path = _place(spark)
    formats.write_metrics(evaluate.long_form(topics).unionByName(evaluate.long_form(evaluate.summary(topics))), path)
    remove_at_exit(spark, path)
    return formats.metrics(spark, path).where("metric in ('map', 'P_5', 'num_rel')")


def expression_list_file(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each title word among the topic's first ten, as list lines with the documents asked for, written and read."""
    best = full_run(spark, d).where("rank <= 10").select("qid", "doc_id", F.format_string("D%d", "doc_id").alias("docno"))
    terms = topic_terms(spark, d).where("idx = 1")
    asked = best.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list("docno")), ",").alias("asked"))
    found = index.for_terms(collection(spark, d), terms).select("term", "doc_id", "tf").join(terms, "term")
    total = found.groupBy("qid", "term").agg(F.sum("tf").alias("n"))
    near = found.join(best, ["qid", "doc_id"]).groupBy("qid", "term").agg(F.sort_array(F.collect_list("docno")).alias("docnos"))
    rows = total.join(near, ["qid", "term"]).join(asked, "qid").select(F.format_string("%s %d", "term", "qid").alias("expr_id"), "n", "docnos", "asked")
    return formats.expression_lists(spark, _written(formats.expression_list_lines(rows))).select("expr", "n", F.array_join("docs", ",").alias("docs"))


def expression_batch_file(spark: SparkSession, d: str) -> DataFrame:
    """A batch of commands for the titles as windows; each distinct one once."""
    text = F.concat(F.lit("#uw17( "), F.col("title"), F.lit(" )"))
    batch = formats.expression_batch(titles(spark, d).select(text.alias("text")), "fx")
    return formats.distinct_lines(spark, _written(batch.unionAll(batch)))


def parameter_file(spark: SparkSession, d: str) -> DataFrame:
    """Queries over two layers with feedback and working sets as an XML parameter file, written in order and read."""
    words = topic_terms(spark, d).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "term"))), lambda s: s["term"]).alias("words"))
    texts = query.layered_text(words.select("qid", F.lit(0).alias("layer"), F.lit(0.7).alias("weight"), "words").unionByName(words.select("qid", F.lit(1).alias("layer"), F.lit(0.3).alias("weight"), F.slice("words", 1, 2).alias("words"))))
    docs = full_run(spark, d).where("rank <= 2").select("qid", F.format_string("D%d", "doc_id").alias("docno"))
    lines = query.parameter_lines(texts, "/index", "method:dir,mu:1600", feedback=(28, 30), working_set=docs)
    return formats.query_parameters(spark, _written(lines))


def similar_term_json(spark: SparkSession, d: str) -> DataFrame:
    """Association lists as JSON, read for one language; addresses of concepts are brought to one form."""
    near = table(spark, d, "part").select("p_brand", F.array(tx.concept_uri(F.col("p_name")), F.round(F.col("p_size") / 50, 2).cast("string")).alias("pair"), F.array(tx.concept_uri(F.col("p_type"), "fr"), F.lit("0.5")).alias("other"))
    rows = near.groupBy("p_brand").agg(F.to_json(F.struct(F.flatten(F.collect_list(F.array("pair", "other"))).alias("similar"))).alias("body"))
    return formats.similar_terms(rows, "body").select("uri", "weight", tx.uri_leaf(F.col("uri")).alias("leaf"))


def _annotate(text: str) -> list[str]:
    """A stand-in for an annotator: the first words as concepts, with a line that is noise between them."""
    out = []
    for k, word in enumerate(text.lower().split()[:3]):
        out += [f"Concept Name: {word}", "Score: 7", f"Concept Id: C{k}", f"Semantic Types: [t{k},word]"]
    return out


def annotated_topics(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that an external annotator finds in the titles."""
    return formats.annotations(analytics.annotated(titles(spark, d), _annotate, "qid", "title"))


def kept_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their repetitions, counted: market segments as a list of expressions."""
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("value"))
    return formats.lines(spark, _written(rows)).groupBy(F.col("value").alias("expr")).agg(F.count("*").alias("n"))


def single_lines(spark: SparkSession, d: str) -> DataFrame:
    return formats.distinct_lines(spark, _written(table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")))).withColumnRenamed("value", "expr")


def curve_files(spark: SparkSession, d: str) -> DataFrame:
    """A curve with a header line and one without."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("x"), F.round("s_acctbal", 2).alias("y"))
    out = None
    for header in (True, False):
        path = _place(spark)
        rows.write.csv(path, header=header)
        remove_at_exit(spark, path)
        read = formats.curves(spark, path, ["level", "q"], header).withColumn("header", F.lit(header))
        out = read if out is None else out.unionByName(read)
    return out


def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source by their metadata, internal keys left out, with name and language."""
    fields = {"docno": F.concat(F.lit("D"), F.col("doc_id").cast("string")), "#base": F.lit("x"), "source": F.col("source"), "lang": F.col("lang")}
    found = index.metadata(table(spark, d, "documents"), fields)
    some = spark.createDataFrame([("web",), ("en",)], "value string")
    hits = index.by_metadata(found, "lang", some).select("doc_id")
    return found.join(hits, "doc_id", "left_semi")


def documents_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Whole records of the labelled documents by their external names."""
    names = table(spark, d, "labels").select(F.format_string("D%d", "doc_id").alias("docno"))
    return index.named(table(spark, d, "documents"), names).select("docno", "doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))


def named_fields(spark: SparkSession, d: str) -> DataFrame:
    """Token places of titles, paragraphs and first headings of pages."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return index.tagged_fields(pages, ("title", "p", "h1")).select("doc_id", "field", *[F.col(c).cast("long").alias(c) for c in ("number", "begin", "end")])


def word_forms(spark: SparkSession, d: str) -> DataFrame:
    """Words with marks off, digits off, capitalised; maps turned round and merged."""
    words = table(spark, d, "part").select("p_partkey", F.concat(F.lit("("), F.col("p_name"), F.lit("'s), o'"), F.col("p_brand")).alias("w"))
    here = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y"))
    there = F.create_map(F.lit("b"), F.col("p_brand"), F.lit("c"), F.lit("x"))
    merged = tx.merged_map(here, there)
    return words.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").select(
        "p_partkey", tx.without_marks(F.col("w")).alias("bare"), tx.without_digits(F.col("p_brand")).alias("letters"), tx.capitalised(F.col("p_brand")).alias("capital"),
        merged["b"].alias("b"), merged["c"].alias("c"), tx.inverted_map(merged)["x"].alias("of_x"),
    )


def vocabulary_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the titles' words and of the parts' names."""
    words = topic_terms(spark, d).select("term").union(table(spark, d, "part").select(F.explode(tx.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("term")))
    english = spark.createDataFrame([(w,) for w in ENGLISH], "term string")
    return words.union(english).distinct().select("term", tx.stem(F.col("term")).alias("stem"))


# English words whose stems pass through every rule.
ENGLISH = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll yes toy saying yellowing".split()


def title_bigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = titles(spark, d).select("qid", F.posexplode(tx.bigrams(tx.tokens(F.col("title")))).alias("number", "bigram"))
    return rows.select("qid", F.col("number").cast("long").alias("number"), "bigram")


def related_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts related to customers' nations by their smallest name; related ones without a name are left out."""
    concepts = table(spark, d, "customer").select(F.col("c_mktsegment").alias("qid"), F.format_string("N%d", "c_nationkey").alias("cui")).distinct()
    relations = table(spark, d, "supplier").select(F.format_string("N%d", "s_nationkey").alias("cui1"), F.format_string("S%d", "s_suppkey").alias("cui2"))
    names = table(spark, d, "supplier").where("s_acctbal > 0").select(F.format_string("S%d", "s_suppkey").alias("cui"), F.explode(F.array("s_name", F.reverse("s_name"))).alias("name"))
    return graph.related(concepts, relations, names)


def sampled_metric(spark: SparkSession, d: str) -> DataFrame:
    """Sampled gain of the title run against its judgments, of which relevant ones stand for one document and others for four."""
    judged = judgments(spark, d, collection(spark, d), full_run(spark, d)).withColumn("rate", F.when(F.col("rel") > 0, 1.0).otherwise(0.25))
    return evaluate.sampled_ndcg(full_run(spark, d), judged, 100)


def belief_functions(spark: SparkSession, d: str) -> DataFrame:
    """Both smoothings as SQL functions over the counts of title words."""
    beliefs.register(spark)
    counts = index.term_counts(collection(spark, d), topic_terms(spark, d))
    p = "cf / cast(total as double)"
    return counts.selectExpr("term", "doc_id", f"round(dirichlet_belief(tf, len, {p}, 1600), 6) as dirichlet", f"round(two_stage_belief(tf, len, {p}, 2500, 0.4), 6) as two_stage")


def stemmed_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of stems: the vocabulary is stemmed, not the tokens."""
    return index.stemmed_vocabulary(collection(spark, d))


def index_compact(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary and totals of the index written anew without documents that are marked toxic."""
    path = _place(spark)
    left = index.compact(index.delete(collection(spark, d), table(spark, d, "labels").where("toxic = 1")), path)
    remove_at_exit(spark, path)
    return index.vocabulary_listing(left)


QUERIES = [
    index_compact,
    sgml_topics, doc_topics, xml_topics, colon_topics, rrf_relations, semantic_type_sets, preferred_names, type_file, edge_file, document_name_file, expression_count_file, run_file, judgment_file, metric_file,
    expression_list_file, expression_batch_file, parameter_file, similar_term_json, annotated_topics, kept_lines, single_lines, curve_files, metadata_lookup, documents_by_name, named_fields, word_forms,
    vocabulary_stems, title_bigrams, related_concepts, sampled_metric, belief_functions, stemmed_vocabulary,
]

# --- oracles ----------------------------------------------------------------------------------------------------


class _Text:
    """The stemmer's steps as SQL text."""

    _names = itertools.count()
    text = staticmethod(lambda v: "'" + v + "'")
    test = staticmethod(lambda x, pattern: f"regexp_matches({x}, '{pattern}')")
    group = staticmethod(lambda x, pattern, k: f"regexp_extract({x}, '{pattern}', {k})")
    join = staticmethod(lambda *parts: f"({' || '.join(parts)})")
    last = staticmethod(lambda x, k: f"substr({x}, length({x}) - {k - 1}, 1)")
    less = staticmethod(lambda x, k: f"substr({x}, 1, length({x}) - {k})")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    neither = staticmethod(lambda a: f"(NOT {a})")
    same = staticmethod(lambda a, b: f"({a} = {b})")

    @classmethod
    def let(cls, x, body):
        name = f"v{next(cls._names)}"
        return f"list_transform([{x}], lambda {name}: {body(name)})[1]"

    @staticmethod
    def case(pairs, default):
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


_TITLES = "t AS (SELECT item_id AS qid, regexp_extract(text, '^[^.' || chr(10) || ']*') AS title FROM benchmark)"
_TOPICS = f"WITH {_TITLES} SELECT CAST(qid AS VARCHAR) AS qid, trim(title) AS title FROM t"
_TOKENS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_BEST = "best AS (SELECT qid, doc_id, 'D' || CAST(doc_id AS VARCHAR) AS docno FROM run WHERE rank <= 10)"
_URI = "'/c/{1}/' || array_to_string(list_filter(string_split_regex(lower(trim({0})), '[\\s/\\-\"_]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), '_')"
_BARE = "len(list_filter(string_split_regex(lower(regexp_replace({}, '<[^>]*>', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))"


def _fields(tag: str) -> str:
    parts = f"SELECT page_id, unnest(range(0, len(s))) AS number, unnest(s) AS part FROM (SELECT page_id, string_split_regex(html, '(?i)<{tag}(?:\\s[^>]*)?>') AS s FROM pages)"
    sized = f"SELECT page_id, number, {_BARE.format('part')} AS n, {_BARE.format(f'''string_split_regex(part, '(?i)</{tag}\\s*>')[1]''')} AS own FROM ({parts})"
    return f"SELECT page_id AS doc_id, '{tag}' AS field, number - 1 AS number, CAST(before + 1 AS BIGINT) AS begin, CAST(before + 1 + own AS BIGINT) AS \"end\" FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({sized})) WHERE number > 0"


def _metric(name: str, value: str, digits: int = 4) -> str:
    return f"SELECT '{name}' AS metric, CAST(qid AS VARCHAR) AS qid, round(CAST({value} AS DOUBLE), {digits}) AS value FROM per"


_PER = "judged AS (SELECT qid, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS num_rel FROM qrels GROUP BY qid), walked AS (SELECT r.qid, r.rank, j.num_rel, CASE WHEN q.rel > 0 THEN 1 ELSE 0 END AS hit, sum(CASE WHEN q.rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.qid ORDER BY r.rank ROWS UNBOUNDED PRECEDING) AS hits FROM run r JOIN judged j ON j.qid = r.qid AND j.num_rel > 0 LEFT JOIN qrels q ON q.qid = r.qid AND q.doc_id = r.doc_id), per AS (SELECT qid, CAST(first(num_rel) AS BIGINT) AS num_rel, round(sum(CASE WHEN hit = 1 THEN CAST(hits AS DOUBLE) / rank ELSE 0.0 END) / first(num_rel), 6) AS map, round(CAST(sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS DOUBLE) / 5, 6) AS p5 FROM walked GROUP BY qid)"
_STEM = tx.porter("term", _Text)
ORACLES = {
    "index_compact": sql("tf len", "gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY term UNION ALL SELECT 'TOTAL', CAST(sum(len) AS BIGINT), count(*) FROM lens WHERE doc_id NOT IN (SELECT doc_id FROM gone)"),
    "sgml_topics": _TOPICS,
    "doc_topics": _TOPICS,
    "xml_topics": _TOPICS,
    "colon_topics": f"WITH {_TITLES} SELECT 'wt-' || CAST(qid AS VARCHAR) AS qid, trim(title) || ': more' AS title FROM t",
    "rrf_relations": "SELECT DISTINCT 'S' || CAST(s_suppkey AS VARCHAR) AS cui1, 'N' || CAST(s_nationkey AS VARCHAR) AS cui2 FROM supplier",
    "semantic_type_sets": "SELECT cui, string_agg(tui, ',' ORDER BY tui) AS tuis FROM (SELECT DISTINCT 'C' || p_brand AS cui, 'T' || CAST(p_size % 7 AS VARCHAR) AS tui FROM part) GROUP BY cui",
    "preferred_names": "SELECT DISTINCT 'C' || CAST(p_partkey AS VARCHAR) AS cui, lower(regexp_extract(p_type, '([A-Z]+)$', 1)) AS name FROM part WHERE p_size > 25 AND p_size < 40 AND regexp_matches(regexp_extract(p_type, '([A-Z]+)$', 1), '^[A-Za-z]+$')",
    "type_file": "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS abbr, 'T' || CAST(n_regionkey AS VARCHAR) AS tui, trim(n_name) AS name FROM nation",
    "edge_file": "SELECT src, dst, arg_max(rel, event_id) AS rel FROM (SELECT 'u' || CAST(user_id AS VARCHAR) AS src, json_extract_string(props, '$.k') AS dst, '/r/' || event_type AS rel, event_id FROM events) WHERE trim(dst) <> '' GROUP BY src, dst",
    "document_name_file": "SELECT doc_id, 'D' || CAST(doc_id AS VARCHAR) AS docno FROM documents",
    "expression_count_file": sql("top voc", "SELECT DISTINCT term AS expr, cf AS n FROM topics JOIN voc USING (term)"),
    "run_file": sql("run", "SELECT CAST(qid AS VARCHAR) AS qid, 'D' || CAST(doc_id AS VARCHAR) AS docno, rank, score FROM run WHERE rank <= 10"),
    "judgment_file": sql("qrel", "SELECT CAST(qid AS VARCHAR) AS qid, 'D' || CAST(doc_id AS VARCHAR) AS docno, rel FROM qrels"),
    "metric_file": sql("qrel", f"{_PER} {_metric('map', 'map')} UNION ALL {_metric('P_5', 'p5')} UNION ALL {_metric('num_rel', 'num_rel')} UNION ALL SELECT 'map', 'all', round(round(avg(map), 6), 4) FROM per UNION ALL SELECT 'P_5', 'all', round(round(avg(p5), 6), 4) FROM per UNION ALL SELECT 'num_rel', 'all', CAST(sum(num_rel) AS DOUBLE) FROM per"),
    "expression_list_file": sql("run", f"{_BEST}, f AS (SELECT t.qid, t.term, x.doc_id, x.tf FROM topics t JOIN tf x USING (term) WHERE idx = 1) SELECT f.term || ' ' || CAST(f.qid AS VARCHAR) AS expr, CAST(sum(tf) AS BIGINT) AS n, string_agg(b.docno, ',' ORDER BY b.docno) AS docs FROM f LEFT JOIN best b ON b.qid = f.qid AND b.doc_id = f.doc_id GROUP BY f.qid, f.term HAVING count(b.docno) > 0"),
    "expression_batch_file": f"WITH {_TITLES} SELECT DISTINCT 'fx ' || trim(regexp_replace(regexp_replace('#uw17( ' || title || ' )', '[^\\p{{L}}\\p{{N}}_#(),:\\-\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS value FROM t".replace("\\p{L}\\p{N}_", "\\w"),
    "parameter_file": sql("top", "SELECT CAST(qid AS VARCHAR) AS number, '#weight(0.70 #combine(' || string_agg(term, ' ' ORDER BY idx) || ') 0.30 #combine(' || string_agg(term, ' ' ORDER BY idx) FILTER (idx <= 2) || '))' AS text FROM topics GROUP BY qid"),
    "similar_term_json": f"SELECT uri, weight, string_split(uri, '/')[-1] AS leaf FROM (SELECT {_URI.format('p_name', 'en')} AS uri, round(p_size / CAST(50 AS DOUBLE), 2) AS weight FROM part)",
    "annotated_topics": f"WITH {_TITLES}, w AS (SELECT qid, list_filter(string_split_regex(lower(title), '\\s+'), lambda x: x <> '')[1:3] AS w FROM t) SELECT qid, 'C' || CAST(k AS VARCHAR) AS cui, name, 't' || CAST(k AS VARCHAR) || ',word' AS sty FROM (SELECT qid, unnest(range(0, len(w))) AS k, unnest(w) AS name FROM w)",
    "kept_lines": "SELECT c_mktsegment AS expr, count(*) AS n FROM customer GROUP BY 1",
    "single_lines": "SELECT DISTINCT c_mktsegment AS expr FROM customer",
    "curve_files": "SELECT CAST(s_suppkey AS DOUBLE) AS level, round(s_acctbal, 2) AS q, header FROM supplier, (SELECT unnest([TRUE, FALSE]) AS header)",
    "metadata_lookup": "SELECT doc_id, unnest(['docno', 'source', 'lang']) AS key, unnest(['D' || CAST(doc_id AS VARCHAR), source, lang]) AS value FROM documents WHERE lang IN ('web', 'en')".join(["SELECT * FROM (", ") WHERE value IS NOT NULL"]),
    "documents_by_name": "SELECT 'D' || CAST(doc_id AS VARCHAR) AS docno, doc_id, source, coalesce(length(text), 0) AS size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "named_fields": " UNION ALL ".join(map(_fields, ("title", "p", "h1"))),
    "word_forms": "SELECT p_partkey, regexp_replace(regexp_replace('(' || p_name || '''s), o''' || p_brand, '\\(|\\)|''s|,', '', 'g'), '''', '', 'g') AS bare, translate(p_brand, '0123456789', '') AS letters, upper(p_brand[1]) || lower(p_brand[2:]) AS capital, p_brand AS b, 'x' AS c, 'c' AS of_x FROM part",
    "vocabulary_stems": sql("top", f"w AS (SELECT DISTINCT term FROM topics UNION SELECT unnest({_TOKENS.format(chr(112) + '_name || chr(32) || p_type')}) FROM part UNION SELECT unnest({ENGLISH}))") + f" SELECT term, {_STEM} AS stem FROM w",
    "title_bigrams": f"WITH {_TITLES}, w AS (SELECT qid, {_TOKENS.format('title')} AS w FROM t) SELECT qid, k AS number, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k + 1] || ' ' || w[k + 2] END AS bigram FROM (SELECT qid, w, unnest(range(0, greatest(len(w) - 1, 1))) AS k FROM w WHERE len(w) > 0)",
    "related_concepts": "WITH c AS (SELECT DISTINCT c_mktsegment AS qid, c_nationkey AS n FROM customer) SELECT qid, 'N' || CAST(n AS VARCHAR) AS cui1, 'S' || CAST(s_suppkey AS VARCHAR) AS cui, least(s_name, reverse(s_name)) AS name FROM c JOIN supplier ON s_nationkey = n WHERE s_acctbal > 0",
    "sampled_metric": sql("qrel", "g AS (SELECT *, (pow(2, greatest(rel, 0)) - 1) / CASE WHEN rel > 0 THEN 1.0 ELSE 0.25 END AS gain FROM qrels), i AS (SELECT qid, sum(gain / log2(k + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS k FROM g) WHERE k <= 100 GROUP BY qid), x AS (SELECT r.qid, sum(gain / log2(rank + 1)) AS dcg FROM run r JOIN g ON g.qid = r.qid AND g.doc_id = r.doc_id WHERE rank <= 100 GROUP BY r.qid) SELECT i.qid, round(coalesce(dcg, 0.0) / best, 6) AS infndcg FROM i LEFT JOIN x ON x.qid = i.qid WHERE best > 0"),
    "belief_functions": sql("top voc tot len", "SELECT t.term, t.doc_id, round(ln((t.tf + 1600.0 * (v.cf / CAST(n_tokens AS DOUBLE))) / (l.len + 1600.0)), 6) AS dirichlet, round(ln(0.6 * (t.tf + 2500.0 * (v.cf / CAST(n_tokens AS DOUBLE))) / (l.len + 2500.0) + 0.4 * (v.cf / CAST(n_tokens AS DOUBLE))), 6) AS two_stage FROM tf t JOIN voc v ON v.term = t.term JOIN lens l ON l.doc_id = t.doc_id, tot WHERE t.term IN (SELECT term FROM topics)"),
    "stemmed_vocabulary": sql("voc", f"SELECT stem, CAST(sum(cf) AS BIGINT) AS cf, count(*) AS n_terms FROM (SELECT cf, {_STEM} AS stem FROM voc) GROUP BY stem"),
}
