"""Structured queries: parsing, flattening to weighted leaves, and their text form.

#combine and #weight are linear in their parts' beliefs, so a query of any depth is a weighted sum over its leaves:
terms, ordered windows #odN or #N, unordered windows #uwN, and whole-document windows #uw. Windows hold terms or other
windows; one that holds windows is a leaf of kind "tree", named by its text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAVES = "qid string, expr_id string, kind string, width int, terms array<string>, weight double"
_TOKEN = re.compile(r"#[a-z]*\d*\s*\(|\)|[^\s()]+", re.I)


@dataclass
class Node:
    """op: combine, weight, od, uw or term; parts of a weight carry their weights."""

    op: str
    width: int = 0
    term: str = ""
    weights: list[float] = field(default_factory=list)
    parts: list[Node] = field(default_factory=list)


def parse(text: str) -> Node:
    """The tree of a query; bare terms without an operator combine. Raises ValueError on unmatched parentheses or weights."""
    tokens, at = _TOKEN.findall(text), 0

    def node() -> Node:
        nonlocal at
        token = tokens[at]
        at += 1
        if not token.startswith("#") or not token.endswith("("):
            if token == ")":
                raise ValueError("unexpected )")
            return Node("term", term=token.lower())
        name, width = re.match(r"#([a-z]*)(\d*)", token.lower()).groups()
        out = Node({"": "od", "od": "od", "uw": "uw"}.get(name, name), int(width or 0))
        if out.op not in ("combine", "weight", "od", "uw"):
            raise ValueError(f"unknown operator #{name}")
        while True:
            if at >= len(tokens):
                raise ValueError("missing )")
            if tokens[at] == ")":
                at += 1
                return out
            if out.op == "weight":
                out.weights.append(float(tokens[at]))
                at += 1
                if at >= len(tokens) or tokens[at] == ")":
                    raise ValueError("a weight without its part")
            out.parts.append(node())

    parts = []
    while at < len(tokens):
        parts.append(node())
    return parts[0] if len(parts) == 1 else Node("combine", parts=parts)


def window_key(node: Node) -> str:
    """The text of a term or window. Raises ValueError where another operator stands inside a window."""
    if node.op == "term":
        return node.term
    if node.op not in ("od", "uw") or not node.parts:
        raise ValueError(f"#{node.op} has no extents")
    return f"#{node.op}{node.width or ''}({' '.join(map(window_key, node.parts))})"


def flatten(node: Node, share: float = 1.0) -> list[tuple[str, int, list[str], float]]:
    """(kind, width, terms, weight) of each leaf, weights summing to share; parts of zero weight stay with 0."""
    if node.op == "term":
        return [("term", 0, [node.term], share)]
    if node.op in ("od", "uw"):
        if not node.parts:
            return []
        if any(p.op != "term" for p in node.parts):
            return [("tree", 0, [window_key(node)], share)]
        terms = [p.term for p in node.parts]
        return [("term", 0, terms, share)] if len(terms) == 1 else [(node.op, node.width, terms, share)]
    weights = node.weights or [1.0] * len(node.parts)
    total = sum(weights)
    return [leaf for w, p in zip(weights, node.parts) for leaf in flatten(p, share * w / total if total else 0.0)]


def expr_key(kind: str, width: int, terms: list[str]) -> str:
    return " ".join(terms) if kind in ("term", "tree") else f"#{kind}{width or ''}({' '.join(terms)})"


def leaves(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    """LEAVES of query texts by id."""
    rows = [(q, expr_key(k, w, t), k, w, t, weight) for q, text in queries.items() for k, w, t, weight in flatten(parse(text))]
    return spark.createDataFrame(rows, LEAVES)


def term_leaves(terms: DataFrame, weight: Column) -> DataFrame:
    """LEAVES of terms(qid, term, ...)."""
    return terms.select("qid", F.col("term").alias("expr_id"), F.lit("term").alias("kind"), F.lit(0).alias("width"), F.array("term").alias("terms"), weight.alias("weight"))


def clause(op: str, words: Column, width: int = 0) -> Column:
    """#combine(a b) or a window over an array of words."""
    return F.concat(F.lit(f"#{op}{width or ''}("), F.array_join(words, " "), F.lit(")"))


def layered_text(layers: DataFrame) -> DataFrame:
    """(qid, text): #weight over layers(qid, layer, weight, words); empty layers are left out, words keep their first place."""
    part = F.concat(F.format_string("%.2f ", F.col("weight")), clause("combine", F.array_distinct("words")))
    return weighted_parts(layers.where(F.size("words") > 0).select("qid", "layer", part.alias("part")))


def weighted_parts(parts: DataFrame) -> DataFrame:
    """(qid, text): #weight over parts(qid, layer, part) in order of layer; a query's layers are few."""
    inside = F.transform(F.sort_array(F.collect_list(F.struct("layer", "part"))), lambda s: s["part"])
    return parts.groupBy("qid").agg(F.concat(F.lit("#weight("), F.array_join(inside, " "), F.lit(")")).alias("text"))


def phrase_clause(words: Column, near: int = 4, wide: int = 17, weights: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> Column:
    """The phrase template over an array of words: terms, neighbouring pairs in order, all near each other; one word pairs with none."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat(F.lit(f"#od{near}("), F.element_at(words, i), F.lit(" "), F.try_element_at(words, i + 1), F.lit(")")))
    inner = F.when(F.size(words) > 1, F.array_join(pairs, " ")).otherwise(F.array_join(words, " "))
    a, b, c = (f"{w} " for w in weights)
    return F.concat(F.lit(f"#weight({a}"), clause("combine", words), F.lit(f" {b}#combine("), inner, F.lit(f") {c}"), clause("uw", words, wide), F.lit(")"))


def concept_layers(titles: DataFrame, layers: DataFrame, least_letters: int = 4) -> DataFrame:
    """(qid, text) of titles(qid, weight, words) and layers(qid, layer from 1, weight, concept_rank, concept).

    The title comes first as #combine; each further layer is a #weight over the phrase templates of its concepts, in order
    of rank. Concepts shorter than `least_letters` are left out, as are layers without concepts.
    """
    words = F.filter(F.split(F.regexp_replace("concept", r"[!-/:-@\[-`{-~]", " "), " +"), lambda w: w != "")
    usable = layers.where(F.length("concept") >= least_letters).withColumn("words", words).where(F.size("words") > 0)
    each = usable.select("qid", "layer", "weight", F.struct("concept_rank", F.concat(F.lit("1.0 "), phrase_clause(F.col("words"))).alias("t")).alias("s"))
    inside = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), " ")
    parts = each.groupBy("qid", "layer", "weight").agg(F.concat(F.format_string("%.2f #weight(", F.col("weight")), inside, F.lit(")")).alias("part"))
    first = titles.select("qid", F.lit(0).alias("layer"), F.concat(F.format_string("%.2f ", F.col("weight")), clause("combine", F.col("words"))).alias("part"))
    return weighted_parts(first.unionByName(parts.select("qid", "layer", "part")))


def parameter_lines(texts: DataFrame, index: str, rule: str, count: int = 1000, threads: int = 32, feedback: tuple[int, int] | None = None, working_set: DataFrame | None = None) -> DataFrame:
    """at, value: the lines of an XML parameter file for texts(qid, text), in order of `at`; no row is gathered by the driver.

    working_set(qid, docno) restricts a query to documents. The queries stand in order of qid between head and tail.
    """
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<query>\n<number>"), safe(F.col("qid").cast("string")), F.lit("</number>\n<text>"), safe(F.col("text")), F.lit("</text>\n"))
    if working_set is not None:
        docs = working_set.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_set("docno")), lambda d: F.concat(F.lit("<workingSetDocno>"), safe(d), F.lit("</workingSetDocno>\n"))), "").alias("docs"))
        texts = texts.join(docs, "qid", "left")
        body = F.concat(body, F.coalesce("docs", F.lit("")))
    tail = [f"<rule>{rule}</rule>", f"<threads>{threads}</threads>", f"<count>{count}</count>", "<trecFormat>true</trecFormat>"]
    tail += [f"<fbDocs>{feedback[0]}</fbDocs>", f"<fbTerms>{feedback[1]}</fbTerms>"] if feedback else []
    spark = texts.sparkSession
    ends = spark.createDataFrame([(0, "", f"<parameters>\n<index>{index}</index>"), (2, "", "\n".join([*tail, "</parameters>"]))], "part int, qid string, value string")
    rows = texts.select(F.lit(1).alias("part"), F.col("qid").cast("string").alias("qid"), F.concat(body, F.lit("</query>")).alias("value")).unionByName(ends)
    return rows.select(F.struct("part", F.length("qid").alias("n"), "qid").alias("at"), "value")


def phrase_template(words: list[str], near: int = 4, wide: int = 17, weights: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> str:
    """Terms, neighbouring pairs in order and all words near each other; a single word is the term alone."""
    if len(words) < 2:
        return f"#combine({' '.join(words)})"
    pairs = " ".join(f"#od{near}({a} {b})" for a, b in zip(words, words[1:]))
    a, b, c = weights
    return f"#weight({a} #combine({' '.join(words)}) {b} #combine({pairs}) {c} #uw{wide}({' '.join(words)}))"


def parameter_file(queries: dict[str, str], index: str, rule: str, count: int = 1000, threads: int = 32, feedback: tuple[int, int] | None = None, working_set: dict[str, list[str]] | None = None) -> str:
    """The XML parameter file of a batch of queries."""
    from xml.sax.saxutils import escape

    out = ["<parameters>", f"<index>{escape(index)}</index>"]
    for number, text in queries.items():
        out += ["<query>", f"<number>{escape(number)}</number>", f"<text>{escape(text)}</text>"]
        out += [f"<workingSetDocno>{escape(d)}</workingSetDocno>" for d in (working_set or {}).get(number, [])]
        out.append("</query>")
    out += [f"<rule>{escape(rule)}</rule>", f"<threads>{threads}</threads>", f"<count>{count}</count>", "<trecFormat>true</trecFormat>"]
    if feedback:
        out += [f"<fbDocs>{feedback[0]}</fbDocs>", f"<fbTerms>{feedback[1]}</fbTerms>"]
    return "\n".join([*out, "</parameters>"])
