"""Small fixtures for the retrieval operators and format readers."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from termloom.functions import beliefs
from termloom.functions import text as tx
from termloom.operators import analytics, evaluate, features, graph, index, query, rank, settle, tune, windows
from termloom.operators.settle import Side, restricted
from termloom.sources import formats


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Apple pie, apple tart."), (2, "pie crust apple"), (3, None), (4, "")], "doc_id long, text string")


def test_index_tables(docs):
    ix = index.build(docs)
    assert rows(ix.vocabulary()) == [("apple", 3, 2), ("crust", 1, 1), ("pie", 2, 2), ("tart", 1, 1)]
    assert rows(ix.lengths) == [(1, 4), (2, 3), (3, 0), (4, 0)]
    assert ("apple", 1, 2, 4, [1, 3]) in rows(ix.postings())
    assert index.repository_stats(ix).first() == (4, 4, 7)
    assert index.validate(ix).first() == (4, 0, 0)


def test_delete_merge_and_load(docs, spark, tmp_path):
    ix = index.build(docs)
    left = index.delete(ix, spark.createDataFrame([(1,)], "doc_id long"))
    assert rows(left.vocabulary()) == [("apple", 1, 1), ("crust", 1, 1), ("pie", 1, 1)]
    both = index.merge(ix, ix)
    assert both.lengths.count() == 8 and rows(both.vocabulary())[0] == ("apple", 6, 4)
    ix.save(str(tmp_path / "ix"))
    assert rows(index.load(spark, str(tmp_path / "ix")).vocabulary()) == rows(ix.vocabulary())


def test_stop_words_and_vectors(docs):
    ix = index.build(docs, stop=("pie",))
    assert rows(index.document_vectors(ix)) == [(1, "apple [OOV] apple tart"), (2, "[OOV] crust apple")]
    assert rows(index.document_vectors(ix, keep_oov=False)) == [(1, "apple apple tart"), (2, "crust apple")]


def test_windows(docs, spark):
    ix = index.build(docs)
    exprs = spark.createDataFrame([("pa", ["pie", "apple"]), ("at", ["apple", "tart"])], "expr_id string, terms array<string>")
    key = ("expr_id", "doc_id", "tf")
    assert rows(windows.ordered_window(ix, exprs, 1), *key) == [("at", 1, 1), ("pa", 1, 1)]
    assert rows(windows.ordered_window(ix, exprs, 2), *key) == [("at", 1, 1), ("pa", 1, 1), ("pa", 2, 1)]
    assert rows(windows.unordered_window(ix, exprs, 2), *key) == [("at", 1, 1), ("pa", 1, 2)]
    assert rows(windows.whole_document(ix, exprs), *key) == [("at", 1, 1), ("pa", 1, 1), ("pa", 2, 1)]
    assert rows(windows.extents(windows.ordered_window(ix, exprs, 2))) == [("at", 1, 3, 5), ("pa", 1, 2, 4), ("pa", 2, 1, 4)]


def windows_by_loop(words, node):
    """All extents of a window by trying every begin and end: the least end for each begin."""
    if node.op == "term":
        return [(k, k + 1) for k, w in enumerate(words, 1) if w == node.term]
    parts = [windows_by_loop(words, p) for p in node.parts]
    if node.op == "uw" and not node.width:
        return [(min(p[k][0] for p in parts), max(p[k][1] for p in parts)) for k in range(min(map(len, parts)))]
    out = {}
    if node.op == "uw":
        for begin in {b for p in parts for b, _ in p}:
            ends = [min((e for b, e in p if b >= begin), default=None) for p in parts]
            if None not in ends and max(ends) - begin <= node.width:
                out[begin] = max(ends)
    else:
        chains = [(b, e, b) for b, e in parts[0]]
        for part in parts[1:]:
            chains = [(b2, e2, start) for _, e, start in chains for b2, e2 in part if e <= b2 < e + (node.width or 10**6)]
        for _, e, start in chains:
            out[start] = min(e, out.get(start, e))
    return sorted(out.items())


def test_windows_against_loops(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    ix = index.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    expressions = ["#od2(a b)", "#od(a b c)", "#3(a b a)", "#uw4(a b c)", "#uw(a #od2(b c))", "#uw9(#od2(a b) #uw3(c d))", "#od5(#uw3(a b) #od1(c d) e)", "#uw6(#4( a ) b)", "#od1(z a)"]
    got = {}
    for r in windows.extents(windows.trees(ix, expressions)).collect():
        got.setdefault((r.expr_id, r.doc_id), []).append((r.begin, r.end))
    want = {(x, d): found for x in expressions for d, t in enumerate(texts) if (found := windows_by_loop(t.split(), query.parse(x)))}
    assert {k: sorted(v) for k, v in got.items()} == want
    flat = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["b", "d"]), ("none", ["a", "z"])], "expr_id string, terms array<string>")
    for name, found, op, n in (("od", windows.ordered_window(ix, flat, 3), "od", 3), ("uw", windows.unordered_window(ix, flat, 5), "uw", 5), ("all", windows.whole_document(ix, flat), "uw", 0)):
        for r in windows.extents(found).groupBy("expr_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("s")).collect():
            terms = {"x": "abc", "y": "bd"}[r.expr_id]
            assert [tuple(s) for s in r.s] == windows_by_loop(texts[r.doc_id].split(), query.Node(op, n, parts=[query.Node("term", term=t) for t in terms])), name
    with pytest.raises(ValueError):
        windows.trees(ix, ["#od4(a #combine(b c))"])


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(1, "a b a"), (2, None)], "key long, body string").write.parquet(path)
    first = index.stored(spark, path, {"id": "key", "text": "body"})
    assert rows(first.vocabulary()) == [("a", 2, 1), ("b", 1, 1)] and first.totals().first() == (2, 3)
    assert index.stored(spark, path, {"id": "key", "text": "body"}).postings().inputFiles() == first.postings().inputFiles()
    spark.createDataFrame([(3, "c")], "key long, body string").write.mode("append").parquet(path)
    assert rows(index.stored(spark, path, {"id": "key", "text": "body"}).vocabulary()) == [("a", 2, 1), ("b", 1, 1), ("c", 1, 1)]
    plan = index.for_terms(first, spark.createDataFrame([("a",)], "term string"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [a])]" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term,a)]" in plan


def test_sides(spark):
    table = spark.createDataFrame([("it's",), ("back\\slash",), ("c",), (None,)], "k string")
    some = spark.createDataFrame([("it's",), ("back\\slash",), ("c",), ("c",), (None,)], "k string").where("k <> 'c'")
    assert rows(restricted(table, "k", some)) == [("back\\slash",), ("it's",)]
    assert restricted(table, "k", some.limit(0)).count() == 0 and Side(some.union(some)).frame.count() == 2


def test_query_parsing():
    text = "#weight(0.2 #combine(a b) 0.8 #combine(#weight(0.5 c 0.5 #od4(d e))))"
    got = query.flatten(query.parse(text))
    assert [(k, t) for k, _, t, _ in got] == [("term", ["a"]), ("term", ["b"]), ("term", ["c"]), ("od", ["d", "e"])]
    assert [w for *_, w in got] == pytest.approx([0.1, 0.1, 0.4, 0.4])
    assert query.flatten(query.parse("#weight(0.0 a 0.0 b)"))[0][3] == 0
    assert query.flatten(query.parse("a b"))[0][3] == 0.5
    for bad in ("#combine(a", "#weight(0.1)", "#foo(a)", ")"):
        with pytest.raises(ValueError):
            query.parse(bad)


def test_phrase_template_and_parameters():
    assert query.phrase_template(["a"]) == "#combine(a)"
    assert "#od4(a b)" in query.phrase_template(["a", "b"]) and "#uw17(a b)" in query.phrase_template(["a", "b"])
    text = query.parameter_file({"1": "#combine(a & b)"}, "/ix", "method:dir,mu:1600", feedback=(28, 30), working_set={"1": ["D1"]})
    assert "a &amp; b" in text and "<fbDocs>28</fbDocs>" in text and "<workingSetDocno>D1</workingSetDocno>" in text


@pytest.mark.parametrize("smoothing", [rank.Smoothing(10.0), rank.Smoothing(10.0, 0.4)])
def test_scores_against_loops(docs, spark, smoothing):
    ix = index.build(docs)
    leaves = query.leaves(spark, {"q": "#weight(0.7 #combine(apple crust) 0.3 #uw2(pie apple))"})
    got = {r.doc_id: r.score for r in rank.scores(ix, leaves, smoothing, kinds=(("term", 0), ("uw", 2))).collect()}
    assert rank.scores(ix, leaves, smoothing, kinds=None).count() == len(got)
    tf = {1: (2, 0, 2), 2: (1, 1, 0)}
    cf, length = (3, 1, 2), {1: 4, 2: 3}
    for d, counts in tf.items():
        total = 0
        for w, t, c in zip((0.35, 0.35, 0.3), counts, cf):
            p = c / 7
            dirichlet = (t + 10 * p) / (length[d] + 10)
            total += w * math.log(dirichlet if smoothing.lam is None else 0.6 * dirichlet + 0.4 * p)
        assert got[d] == pytest.approx(total, abs=2e-6)


def test_unseen_expression_and_registered_functions(docs, spark):
    ix = index.build(docs)
    got = rank.scores(ix, query.leaves(spark, {"q": "apple zebra"}), rank.Smoothing(10.0)).collect()
    assert {r.doc_id for r in got} == {1, 2}
    beliefs.register(spark)
    assert spark.sql("SELECT dirichlet_belief(2, 4, 0.5, 10)").first()[0] == pytest.approx(math.log(7 / 14))


def test_feedback(docs, spark):
    ix = index.build(docs)
    leaves = query.leaves(spark, {"q": "crust"})
    terms = rank.feedback_terms(ix, rank.rank(ix, leaves, 10), 1, 2)
    assert rows(terms, "term") == [("apple",), ("crust",)]
    assert rank.with_feedback(leaves, terms).agg(F.sum("weight")).first()[0] == pytest.approx(1)


def test_normalise_and_combine(spark):
    values = [("q", "a", 1.0, 6.0), ("q", "b", 2.0, 3.0), ("q", "c", 3.0, 1.0)]
    frame = spark.createDataFrame(values, "qid string, concept string, two double, four double")
    normed = features.sum_to_one(frame, ("two", "four"))
    got = {r.concept: r.score for r in features.combined(normed, {"two": 0.3, "four": 0.7}).collect()}
    assert got == pytest.approx({"a": 0.3 / 6 + 0.42, "b": 0.1 + 0.21, "c": 0.15 + 0.07}, abs=1e-7)
    assert rows(features.min_max(frame, ("two",)), "two") == [(0.0,), (0.5,), (1.0,)]
    zero = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 0.0)], "qid string, concept string, two double")
    assert rows(features.sum_to_one(zero, ("two",)), "two") == [(0.0,), (0.0,)] == rows(features.min_max(zero, ("two",)), "two")


def test_selection_counts_skipped_ranks(spark):
    scored = spark.createDataFrame([("q", c, s) for c, s in (("a", 3.0), ("b☃", 2.0), ("c", 1.0), ("d", 0.5))], "qid string, concept string, score double")
    original = spark.createDataFrame([("q", "a")], "qid string, term string")
    assert rows(features.best_concepts(scored, 3, original=original), "concept") == [("c",)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "x", 1), ("a", "b", "y", 2), ("b", "c", "x", 3), (" ", "c", "x", 4), ("c", "é", "x", 5)], "src string, dst string, rel string, n int")
    good = graph.last_wins(edges, "n")
    assert rows(good) == [("a", "b", "y"), ("b", "c", "x")]
    terms = spark.createDataFrame([("q", "a")], "qid string, term string")
    assert rows(graph.hops(terms, good, 2)) == [("q", "a", 0), ("q", "b", 1), ("q", "c", 2)]
    concepts = spark.createDataFrame([("k", "dsyn,sosy"), ("m", "zzzz")], "cui string, sty string")
    types = spark.createDataFrame([("dsyn", "T047", "Disease"), ("sosy", "T184", "Sign")], "abbr string, tui string, name string")
    assert rows(graph.of_types(concepts, types, types.select("name")), "cui", "tui") == [("k", "T047"), ("k", "T184")]
    relations = spark.createDataFrame([("k", "r"), ("k", "r"), ("k", "s")], "cui1 string, cui2 string")
    names = spark.createDataFrame([("r", "zeta"), ("r", "alpha")], "cui string, name string")
    assert rows(graph.related(concepts.select(F.lit("q").alias("qid"), "cui"), relations, names), "qid", "cui1", "cui", "name") == [("q", "k", "r", "alpha")]


def test_metrics_against_hand_values(spark):
    run = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate([10, 11, 12, 13])] + [(2, 10, 1)], "qid long, doc_id long, rank long")
    judged = spark.createDataFrame([(1, 10, 1), (1, 11, 0), (1, 12, 1), (1, 99, 1), (3, 5, 1), (2, 10, 0)], "qid long, doc_id long, rel int")
    topic = evaluate.per_topic(run, judged)
    assert topic.count() == 1
    r = topic.first()
    assert (r.num_ret, r.num_rel, r.num_rel_ret) == (4, 3, 2)
    assert r.map == pytest.approx((1 + 2 / 3) / 3, abs=1e-6) and r.Rprec == pytest.approx(2 / 3, abs=1e-6) and r.recip_rank == 1
    assert r.bpref == pytest.approx((1 + 0) / 3, abs=1e-6) and r.P_5 == 0.4 and r.iprec_at_recall_1_00 == 0
    total = evaluate.summary(topic).first()
    assert total.num_q == 1 and total.gm_map == pytest.approx(r.map, abs=1e-6)
    assert evaluate.long_form(topic).where("metric = 'map'").first().value == pytest.approx(0.5556)
    whole = judged.withColumn("rate", F.lit(1.0))
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert evaluate.sampled_ndcg(run, whole).where("qid = 1").first().infndcg == pytest.approx((1 + 0.5) / ideal, abs=1e-6)


def test_search(spark):
    assert tune.grid(spark, {"a": (1, 2), "b": (3, 4)}).count() == 4
    peak = lambda batch: [-((w["a"] - 0.6) ** 2) - (w["b"] + 0.2) ** 2 for w in batch]
    found, _ = tune.coordinate_ascent({"a": 0.0, "b": 0.0}, peak)
    assert found == pytest.approx({"a": 0.6, "b": -0.2})
    assert max(tune.sweep({"a": 0.0, "b": -0.2}, "a", (0.0, 0.5, 1.0), peak), key=lambda p: p[1])[0] == 0.5
    assert tune.draws(spark, ("a", "b"), 3).selectExpr("round(a + b, 9)").distinct().first()[0] == 1


def test_analytics(spark):
    table = analytics.ablation(spark.createDataFrame([("f", 1.0, 1), ("g", 3.0, 2)], "feature string, loss double, position long"), 0.4, 1.0)
    assert [(r.cum_loss, r.reduced) for r in table.orderBy("position").collect()] == [(0.1, 0.9), (0.4, 0.6)]
    ranks = analytics.layer_ranks(spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.1), (2, 3, 0.2)], "level int, concept int, q double"), 0.25, 0.15)
    assert rows(ranks, "concept", "in_layer", "overall", "region") == [(1, 1, 1, "selection"), (2, 2, 3, "rejection"), (3, 1, 2, "uncertainty")]
    line = spark.createDataFrame([("c", float(x), 2.0 * x + 1) for x in range(9)], "curve string, x double, y double")
    assert all(abs(r.smooth - r.y) < 1e-8 for r in analytics.local_regression(line, "curve", 0.6).collect())


def test_text(spark):
    one = lambda expr, value: spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]
    assert one(tx.plain_name, "Foo [x]") is None and one(tx.plain_name, "Foo") == "foo" and one(tx.plain_name, "two words") is None
    assert one(tx.normalised, 'A/b-"c"_d, e') == "a b c d e"
    assert one(lambda v: tx.bigrams(F.split(v, " ")), "a b c") == ["a b", "b c"] and one(lambda v: tx.bigrams(F.split(v, " ")), "a") == ["a"]


def test_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    top = put("t", "<top>\n<num> Number: 351 \n<title> Falkland petroleum \n\n<desc> x\n</top>\n<top>\n<num> Number: 352\n<title>Tunnel\n</top>\n")
    assert rows(formats.sgml_topics(spark, top)) == [("351", "Falkland petroleum"), ("352", "Tunnel")]
    doc = put("d", "<DOC>\n<DOCNO>1</DOCNO>\n<TEXT>\nmining gold\n</TEXT>\n</DOC>\n")
    assert rows(formats.doc_topics(spark, doc)) == [("1", "mining gold")]
    xml = put("x.xml", '<topics><topic number="1"><summary>chest pain</summary></topic><topic number="2"><summary>b</summary></topic></topics>')
    assert rows(formats.xml_topics(spark, xml)) == [("1", "chest pain"), ("2", "b")]
    assert rows(formats.colon_topics(spark, put("c", "wt09-1:obama: tree\n"))) == [("wt09-1", "obama: tree")]
    parameters = put("p.xml", query.parameter_file({"7": "#weight(0.7 #combine(a b)\n0.3 c)"}, "/i", "r"))
    assert rows(formats.query_parameters(spark, parameters)) == [("7", "#weight(0.7 #combine(a b) 0.3 c)")]
    assert rows(formats.runs(spark, put("r", "1 Q0 D7 1 -5.5 tag\n"))) == [("1", "D7", 1, -5.5)]
    assert rows(formats.judgments(spark, put("j", "1 0 D7 1\n"))) == [("1", "D7", 1)]
    table = formats.metrics(spark, put("m", "runid                 \tall\tx\nmap                   \tall\t0.1982\n\nnum_q \tall\t100\n"))
    assert formats.metric_value(table).first()[0] == 0.1982 and table.count() == 2
    assert rows(formats.relations(spark, put("rel", "C1|a|b|c|C2|\nC1|x|y|z|C2|\n"))) == [("C1", "C2")]
    assert rows(formats.type_table(spark, put("sty", "dsyn|T047| Disease\n"))) == [("dsyn", "T047", "Disease")]
    assert rows(formats.expression_counts(spark, put("e", "#od4(a b)\t3.0\n"))) == [("#od4(a b)", 3)]
    assert formats.expression_counts(spark, str(tmp_path / "none")).count() == 0
    assert rows(formats.expression_lists(spark, put("l", "a b:2,D1,D2,:\n"))) == [("a b", 2, ["D1", "D2"])]
    names = put("con", "C1|ENG|P|L|PF|S|Y|a|b|c|d|e|f|g|Pain|\nC2|ENG|P|L|PF|S|Y|a|b|c|d|e|f|g|Chest pain|\n")
    assert rows(graph.names_table(formats.concept_names(spark, names))) == [("C1", "pain")]
    lines = spark.createDataFrame([("q", 0, "Concept Id: C1"), ("q", 1, "noise"), ("q", 2, "Concept Name: Pain"), ("q", 3, "Semantic Types: [sosy]")], "qid string, at int, line string")
    lines = lines.withColumn("at", F.when(F.col("line").startswith("Concept Name"), -1).otherwise(F.col("at")))
    assert rows(formats.annotations(lines)) == [("q", "C1", "Pain", "sosy")]
    similar = spark.createDataFrame([('{"similar": [["/c/en/dog", "0.9"], ["/c/fr/chien", "0.8"]]}',)], "v string")
    assert rows(formats.similar_terms(similar, "v")) == [("/c/en/dog", 0.9)]
    formats.write_run(spark.createDataFrame([("1", "D7", 1, -5.5)], "qid string, docno string, rank long, score double"), str(tmp_path / "out"))
    assert rows(formats.runs(spark, str(tmp_path / "out"))) == [("1", "D7", 1, -5.5)]


def test_stems(spark):
    want = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "allowance": "allow", "replacement": "replac", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "toy": "toi", "4x4s": "4x4s"}
    got = dict(map(tuple, spark.createDataFrame([(w,) for w in want], "w string").select("w", tx.stem(F.col("w"))).collect()))
    assert got == want


def test_word_functions(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(tx.without_marks(F.lit("(dog's), o'neil"))) == "dog oneil" and one(tx.without_digits(F.lit("assoc2"))) == "assoc" and one(tx.capitalised(F.lit("gOV"))) == "Gov"
    assert one(tx.concept_uri(F.lit("The United-States"))) == "/c/en/united_states"
    there = F.create_map(F.lit("b"), F.lit("z"))
    assert one(tx.merged_map(F.create_map(F.lit("a"), F.lit("z"), F.lit("b"), F.lit("y")), there)) == {"a": "z", "b": "z"}
    assert one(tx.inverted_map(F.create_map(F.lit("a"), F.lit("z"), F.lit("b"), F.lit("z"), F.lit("c"), F.lit("y")))) == {"z": "b", "y": "c"}


def features_by_loop(texts, title, concepts, top, scores, width):
    """The features by their definitions, with phrases in order."""
    words = [re.findall("[a-z0-9]+", t) for t in texts]

    def tf(concept, d):
        return len(windows_by_loop(words[d], query.Node("od", width, parts=[query.Node("term", term=w) for w in concept.split()])))

    out, n = {}, range(len(texts))
    for c in concepts:
        held = [tf(c, d) for d in n]
        own = [d for d in top if held[d]]
        met = [[min(held[d], *(tf(t, d) for t in p)) for d in n] for p in [(t,) for t in title]]
        pairs = [[min(held[d], *(tf(t, d) for t in p)) for d in n] for p in [(a, b) for k, a in enumerate(title) for b in title[:k]]]
        four = lambda ms: [sum(map(sum, ms)) / len(ms), max(map(sum, ms)), sum(sum(m[d] > 0 for d in top) for m in ms) / len(ms), max(sum(m[d] > 0 for d in top) for m in ms)] if ms else [0] * 4
        mean, most = (sum(scores[d] for d in own) / len(own), max(scores[d] for d in own)) if own else (0, 0)
        a, p = four(met), four(pairs)
        out[c] = [abs(x) for x in (scores[top[0]], sum(held[d] for d in top) / sum(len(words[d]) for d in top), len(own), mean, most, math.log(len(texts) / max(sum(held), 1)), *a, p[0], p[1], p[2], p[3])]
    return out


def test_features_against_loops(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 25))) for _ in range(20)]
    ix = index.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    title, concepts, top = ["a", "b", "zz"], ["c", "d e", "f g", "nowhere"], [3, 7, 11]
    scores = {3: -1.5, 7: -2.0, 11: -2.5}
    terms = spark.createDataFrame([(1, k, t) for k, t in enumerate(title, 1)], "qid long, idx long, term string")
    run = spark.createDataFrame([(1, d, k, scores[d]) for k, d in enumerate(top, 1)], "qid long, doc_id long, rank long, score double")
    table = spark.createDataFrame([(1, c) for c in concepts], "qid long, concept string")
    got = {r.concept: r for r in features.concept_features(ix, terms, table, run, 10, 2).collect()}
    want = features_by_loop(texts, title, concepts, top, scores, 2)
    order = ("expTDocScore", "topTermFrac", "numCanDocs", "avgCDocScore", "maxCDocScore", "conIdf", "avgColCor", "maxColCor", "avgTopColCor", "maxTopColCor", "avgColPCor", "maxColPCor", "avgTopColPCor", "maxTopColPCor")
    for c in concepts:
        assert [got[c][f] for f in order] == pytest.approx(want[c], abs=1e-8), c


def test_overall_rank_and_loess(spark):
    rng = random.Random(2)
    values = [(k, round(rng.random(), 2)) for k in range(200)]
    ranked = analytics.overall_rank(spark.createDataFrame(values, "k long, q double").repartition(5), [F.desc("q"), F.col("k")], "place")
    assert [r.k for r in ranked.orderBy("place").collect()] == [k for k, _ in sorted(values, key=lambda v: (-v[1], v[0]))] and ranked.agg(F.max("place")).first()[0] == 200
    x = [0.0, 1.0, 2.0, 4.0, 7.0, 11.0]
    y = [rng.random() for _ in x]
    line = spark.createDataFrame([("c", a, b) for a, b in zip(x, y)], "curve string, x double, y double")
    got = {r.x: r.smooth for r in analytics.local_regression(line, "curve", 0.7, 1).collect()}
    for at in x:
        reach = sorted(abs(a - at) for a in x)[4]
        w = [max(0.0, 1 - (abs(a - at) / (reach * 1.0000001)) ** 3) ** 3 for a in x]
        total, mx, my = sum(w), sum(a * b for a, b in zip(w, x)) / sum(w), sum(a * b for a, b in zip(w, y)) / sum(w)
        slope = sum(a * (b - mx) * (c - my) for a, b, c in zip(w, x, y)) / sum(a * (b - mx) ** 2 for a, b in zip(w, x))
        assert total and got[at] == pytest.approx(my + slope * (at - mx), abs=1e-6)


def test_concept_layers(spark):
    titles = spark.createDataFrame([("1", 0.95, ["a", "b"]), ("2", 0.95, ["c"])], "qid string, weight double, words array<string>")
    layers = spark.createDataFrame([("1", 1, 0.05, 1, "civil war"), ("1", 2, 0.01, 1, "peace"), ("1", 2, 0.01, 2, "abc"), ("2", 1, 0.05, 1, "--- ")], "qid string, layer int, weight double, concept_rank int, concept string")
    got = dict(map(tuple, query.concept_layers(titles, layers).collect()))
    assert got["1"] == "#weight(0.95 #combine(a b) 0.05 #weight(1.0 #weight(0.8 #combine(civil war) 0.1 #combine(#od4(civil war)) 0.1 #uw17(civil war))) 0.01 #weight(1.0 #weight(0.8 #combine(peace) 0.1 #combine(peace) 0.1 #uw17(peace))))"
    assert got["2"] == "#weight(0.95 #combine(c))" and query.flatten(query.parse(got["1"]))


def test_empty_collection(spark):
    ix = index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert ix.vocabulary().count() == 0 and index.repository_stats(ix).first() == (0, 0, 0)
    assert rank.rank(ix, query.leaves(spark, {"q": "a"})).count() == 0


@pytest.mark.parametrize("cell, sources, batch", [(1 << 24, 4096, 10000), (6, 2, 3)])
def test_association_deals_no_pair(spark, cell, sources, batch, monkeypatch):
    """The best edges of a loop over documents, for cells of any size; documents meet no document by id, so that no pair is a row."""
    monkeypatch.setattr(graph, "CELL", cell, raising=False)
    monkeypatch.setattr(graph, "SOURCES", sources, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["alpha", "bravo", "delta", "gamma", "omega", "sigma", "kappa", "pi", "theta"]) for _ in range(5)) for _ in range(60)]
    ix = index.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = graph.association(ix, spark.createDataFrame([("alpha",), ("bravo",), ("pi",), ("none",), ("theta",)], "term string"), 3, 5, 0.7, 4)
    got = rows(found)
    assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "doc_id" in line]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for k, t in enumerate(texts):
        for w in t.split():
            held.setdefault(w, set()).add(k)
    want = []
    for a in ("alpha", "bravo", "pi", "theta"):
        ends = [(-round(math.log(len(held[a] & held[b]) * 60 / (len(held[a]) * len(held[b]))), 6), b, len(held[a] & held[b])) for b in held if b != a and len(b) > 3 and len(held[a] & held[b]) > 2]
        want += [(a, b, n, -w) for w, b, n in sorted(ends)[:4]]
    assert got == sorted(want)


def test_stored_index_builds_what_is_asked_for(spark, tmp_path):
    """Listings of documents build nothing, other queries the tables they read; a file of postings holds sorted runs of whole documents."""
    path, columns = str(tmp_path / "docs.parquet"), {"id": "key", "text": "body"}
    spark.createDataFrame([(k, f"z{k % 3} b a{k} b") for k in range(40)], "key long, body string").write.parquet(path)
    assert rows(index.parsed(spark, path, columns).lengths) == [(k, 4) for k in range(40)]
    ix = index.stored(spark, path, columns)
    folder = ix.documents.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file:")
    assert sorted(os.listdir(folder)) == ["documents"]
    assert rows(ix.vocabulary(), "term", "df")[-1] == ("z2", 13) and sorted(os.listdir(folder)) == ["documents", "postings", "vocabulary"]
    where = {}
    for r in ix.postings().select("doc_id", "term", F.input_file_name().alias("file")).collect():
        where.setdefault(r.file, []).append(r)
    assert all([r.term for r in held] == sorted(r.term for r in held) for held in where.values())
    assert len(where) > 1 and sum(len({r.doc_id for r in held}) for held in where.values()) == 40


@pytest.fixture(scope="module")
def drawn_index(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(12))) for _ in range(150)]
    return index.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


@pytest.mark.parametrize("kind", ["ordered_window", "unordered_window", "whole_document"])
def test_windows_meet_where_documents_are_read(spark, drawn_index, kind, monkeypatch):
    """No places are shuffled; expressions too many to be told to every task give the same matches by a shuffle."""
    exprs = spark.createDataFrame([("ab", ["a", "b"]), ("aba", ["a", "b", "a"]), ("cdz", ["c", "z"]), ("c", ["c"])], "expr_id string, terms array<string>")
    find = lambda: getattr(windows, kind)(drawn_index, exprs, *([] if kind == "whole_document" else [4]))
    found = find()
    assert not re.search(r"\b(Join|Aggregate)\b", found._jdf.queryExecution().optimizedPlan().toString())
    got = rows(found)
    assert len({r[0] for r in got}) == 3
    monkeypatch.setattr(settle, "LOCAL_ROWS", 1)
    assert rows(find()) == got


def test_ranks_where_documents_are_read(spark, drawn_index, monkeypatch):
    """A task passes on its best documents only: no row a match is shuffled, and ranks are those of all scores."""
    leaves = query.term_leaves(spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "zz"), ("2", "c"), ("2", "c"), (None, "d")], "qid string, term string"), F.lit(0.5))
    monkeypatch.setattr(rank, "POOL", 5)
    for smoothing in (rank.Smoothing(), rank.Smoothing(2500.0, 0.4)):
        found = rank.rank(drawn_index, leaves, 4, smoothing=smoothing)
        assert not re.search(r"\b(Join|Aggregate)\b", found._jdf.queryExecution().optimizedPlan().toString())
        assert rows(found, "qid", "doc_id", "score", "rank") == rows(rank.top(rank.scores(drawn_index, leaves, smoothing), 4), "qid", "doc_id", "score", "rank")
