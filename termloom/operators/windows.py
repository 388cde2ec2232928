"""Matches of proximity expressions as extents: ordered windows, unordered windows and whole-document co-occurrence.

An extent is a stretch of token places, begin inclusive and end exclusive. Flat expressions are exprs(expr_id, terms
array<string>); nested ones are trees, solved from the terms up, each level's extents being the next one's words. All of a
document's places of an expression meet in one row and are matched by merging sorted places, a batch of rows at a time.
A match is counted once for each place where its first (ordered) or earliest (unordered) part begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.operators import query
from termloom.operators.index import TOKENS, Index, portions
from termloom.operators.settle import Side, settled, small

#: Further than any place in a document.
FAR = 1 << 40
#: Places of matches that are passed on at once.
PLACES = 2_000_000


def _placed(batches: Iterator[pa.RecordBatch], asked) -> Iterator[pa.RecordBatch]:
    """_parts of a task's documents: a document's words stand in its row, so that its places meet without a shuffle."""
    terms, exprs, names = asked.value
    places = pa.list_(pa.list_(pa.int32()))
    for batch in batches:
        ids, lengths, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "len", "words"))
        sizes = np.diff(np.asarray(lists.offsets))
        for lo, hi in portions(sizes, TOKENS):
            coded = lists.slice(lo, hi - lo).flatten().dictionary_encode()
            if not len(coded):
                continue
            width, n = hi - lo, sizes[lo:hi]
            term = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms.cast(coded.dictionary.type)), -1).to_numpy().astype(np.int64)[np.asarray(coded.indices)]
            own = np.flatnonzero(term >= 0)
            doc = np.repeat(np.arange(width), n)[own]
            place = (own - np.repeat(np.cumsum(n) - n, n)[own] + 1).astype(np.int32)
            key = term[own] * width + doc
            order = np.argsort(key, kind="stable")
            place, (key, start, many) = place[order], np.unique(key[order], return_index=True, return_counts=True)
            bounds = np.searchsorted(key, np.arange(len(terms) + 1) * width)
            held, rows = [], 0

            def packed() -> pa.RecordBatch:
                group = np.concatenate([g.ravel() for _, _, g in held])
                inner = many[group]
                at = np.arange(inner.sum()) + np.repeat(start[group] - np.cumsum(inner) + inner, inner)
                outer = np.concatenate([np.full(len(g), g.shape[1]) for _, _, g in held])
                offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
                begins = pa.ListArray.from_arrays(offsets(outer), pa.ListArray.from_arrays(offsets(inner), pa.array(place[at])))
                who = pa.array(np.concatenate([d for _, d, _ in held]) + lo)
                expr = pa.array(np.concatenate([np.full(len(d), e) for e, d, _ in held]))
                return pa.RecordBatch.from_arrays([names.take(expr), ids.take(who), lengths.take(who), begins.cast(places)], names=["expr_id", "doc_id", "len", "begins"])

            for e, codes in enumerate(exprs):
                with_it = sorted((key[bounds[c] : bounds[c + 1]] - c * width for c in set(codes)), key=len)
                docs = with_it[0]
                for other in with_it[1:]:
                    docs = docs[np.isin(docs, other, assume_unique=True)] if len(docs) else docs
                if not len(docs):
                    continue
                group = np.searchsorted(key, np.array(codes)[None, :] * width + docs[:, None])
                held.append((e, docs, group))
                rows += int(many[group].sum())
                if rows >= PLACES:
                    yield packed()
                    held, rows = [], 0
            if held:
                yield packed()


def _parts(index: Index, exprs: DataFrame) -> DataFrame:
    """expr_id, doc_id, len and begins[k]: the sorted places of the k-th term, for documents that hold all terms.

    Expressions that every task can know are looked for where documents are read; more of them meet postings by a shuffle.
    """
    exprs = exprs.select("expr_id", "terms").where(F.size("terms") > 0).dropDuplicates(["expr_id"])
    side = Side(exprs)
    if not side.few:
        return _joined_parts(index, exprs)
    rows = [r for r in side.rows if None not in r["terms"] and r["expr_id"] is not None]
    terms = sorted({t for r in rows for t in r["terms"]})
    place = {t: k for k, t in enumerate(terms)}
    arrow = side.frame.select("expr_id").limit(0).toArrow().schema.field("expr_id").type
    asked = (pa.array(terms, pa.string()), [[place[t] for t in r["terms"]] for r in rows], pa.array([r["expr_id"] for r in rows], arrow))
    asked = exprs.sparkSession.sparkContext.broadcast(asked)
    fields = [T.StructField("expr_id", exprs.schema["expr_id"].dataType), *(index.documents.schema[c] for c in ("doc_id", "len")), T.StructField("begins", T.ArrayType(T.ArrayType(T.IntegerType())))]
    return index.documents.select("doc_id", "len", "words").mapInArrow(lambda batches: _placed(batches, asked), T.StructType(fields))


def _joined_parts(index: Index, exprs: DataFrame) -> DataFrame:
    """expr_id, doc_id, len and begins[k]: the sorted places of the k-th term, for documents that hold all terms.

    Postings of the terms are shuffled once, by document; an expression visits the documents of its rarest term only.
    """
    each = exprs.select("expr_id", F.explode(F.array_distinct("terms")).alias("term"))
    asked = Side(each)
    df = asked.restrict(index.vocabulary(), "term").select("term", "df")
    rare = asked.frame.join(df, "term", "left").groupBy("expr_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("rare"))
    held = asked.restrict(index.postings(), "term")
    visits = held.select(F.col("term").alias("rare"), "doc_id").join(exprs.join(rare, "expr_id"), "rare").drop("rare")
    # dealt by document once: a document has one entry a term, also where its id is repeated
    entries = held.select("doc_id", "len", "term", "positions").repartition("doc_id").dropDuplicates(["doc_id", "term"])
    docs = entries.groupBy("doc_id").agg(F.first("len").alias("len"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    found = F.transform("terms", lambda t: F.try_element_at("at", t))
    return visits.join(docs, "doc_id").select("expr_id", "doc_id", "len", found.alias("begins")).where(F.forall("begins", lambda p: p.isNotNull()))


def _ordered(begins: list, ends: list, rows: list, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, begins and least ends of chains in which each next part begins within `width` places after the one before."""
    row, begin, last = rows[-1], begins[-1], ends[-1]
    for k in range(len(begins) - 2, -1, -1):
        key = row * FAR + begin
        lo = np.searchsorted(key, rows[k] * FAR + ends[k], side="left")
        hi = np.searchsorted(key, rows[k] * FAR + np.minimum(ends[k] + width[rows[k]], FAR - 1), side="left")
        best = np.full(len(lo), FAR)
        while (open_ := lo < hi).any():
            best[open_] = np.minimum(best[open_], last[lo[open_]])
            lo += open_
        keep = best < FAR
        row, begin, last = rows[k][keep], begins[k][keep], best[keep]
    return row, begin, last


def _unordered(begins: list, ends: list, rows: list, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, begins and least ends of stretches of `width` places at most that hold an extent of every part."""
    starts = np.unique(np.concatenate([r * FAR + b for r, b in zip(rows, begins)]))
    row, place = np.divmod(starts, FAR)
    end = np.zeros(len(starts), np.int64)
    for r, b, e in zip(rows, begins, ends):
        least = np.append(np.minimum.accumulate((r * FAR + e)[::-1])[::-1], np.iinfo(np.int64).max)
        at = np.searchsorted(r * FAR + b, starts, side="left")
        own = np.append(r, -1)[at] == row
        end = np.maximum(end, np.where(own, least[at] - row * FAR, FAR))
    keep = end - place <= width[row]
    return row[keep], place[keep], end[keep]


def _whole(begins: list, ends: list, rows: list, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As many matches as the rarest part has; the k-th spans the k-th extents of all parts."""
    n = np.min([np.bincount(r, minlength=len(width)) for r in rows], axis=0)
    row = np.repeat(np.arange(len(width)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = [np.searchsorted(r, row, side="left") + k for r in rows]
    return row, np.min([b[f] for b, f in zip(begins, first)], axis=0), np.max([e[f] for e, f in zip(ends, first)], axis=0)


def _match(batches: Iterator[pa.RecordBatch], kind: str, width: int) -> Iterator[pa.RecordBatch]:
    solve = {"od": _ordered, "uw": _unordered, "all": _whole}[kind]
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("begins"))
        outer = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0] if len(lists) else np.zeros(1, np.int64)
        inner = lists.flatten()
        bounds = np.asarray(inner.offsets).astype(np.int64)
        begin = inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        shift = batch.schema.get_field_index("ends")
        end = begin + 1 if shift < 0 else batch.column(shift).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = bounds - bounds[0] if len(bounds) else bounds
        found: list[tuple] = []
        sizes = np.diff(outer)
        for parts in np.unique(sizes[sizes > 0]):
            own = np.flatnonzero(sizes == parts)
            begins, ends, rows = [], [], []
            for k in range(parts):
                lo, n = bounds[outer[own] + k], np.diff(bounds)[outer[own] + k]
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows.append(np.repeat(np.arange(len(own)), n))
                begins.append(begin[at])
                ends.append(end[at])
            row, b, e = solve(begins, ends, rows, np.full(len(own), width or FAR))
            found.append((own[row], b, e))
        if not found:
            continue
        row, b, e = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((b, row))
        row, b, e = row[order], b[order], e[order]
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        cuts = pa.array(np.append(at, len(row)).astype(np.int32))
        owner = pa.array(row[at])
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (b, e)]
        fixed = [batch.column(batch.schema.get_field_index(c)).take(owner) for c in ("expr_id", "doc_id", "len")]
        yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.diff(np.append(at, len(row))).astype(np.int64)), *lists], names=["expr_id", "doc_id", "len", "tf", "begins", "ends"])


def _solved(parts: DataFrame, kind: str, width: int) -> DataFrame:
    """expr_id, doc_id, len, tf, begins, ends of the rows that match."""
    places = T.ArrayType(T.IntegerType())
    schema = T.StructType([parts.schema[c] for c in ("expr_id", "doc_id", "len")] + [T.StructField("tf", T.LongType()), T.StructField("begins", places), T.StructField("ends", places)])
    return parts.mapInArrow(lambda batches: _match(batches, kind, width), schema)


def ordered_window(index: Index, exprs: DataFrame, n: int) -> DataFrame:
    """expr_id, doc_id, len, tf, begins, ends of #odN: terms in order, each next at most n places later; n = 0: however far."""
    return _solved(_parts(index, exprs), "od", n)


def unordered_window(index: Index, exprs: DataFrame, n: int) -> DataFrame:
    """expr_id, doc_id, len, tf, begins, ends of #uwN: all terms within n places, counted by the place of the earliest."""
    return _solved(_parts(index, exprs), "uw", n)


def whole_document(index: Index, exprs: DataFrame) -> DataFrame:
    """expr_id, doc_id, len, tf, begins, ends of #uw without a width: as often as the rarest term occurs."""
    return _solved(_parts(index, exprs.withColumn("terms", F.array_distinct("terms"))), "all", 0)


def single_terms(index: Index, exprs: DataFrame) -> DataFrame:
    """expr_id, doc_id, len, tf, begins, ends of one-word expressions."""
    asked = Side(exprs.select("expr_id", F.get("terms", F.lit(0)).alias("term")))
    found = asked.restrict(index.postings(), "term").join(asked.frame, "term")
    return found.select("expr_id", "doc_id", "len", "tf", F.col("positions").alias("begins"), F.transform("positions", lambda p: p + 1).alias("ends"))


def trees(index: Index, expressions: list[str]) -> DataFrame:
    """expr_id (the expression's text), doc_id, len, tf, begins, ends of window expressions of any depth.

    The expressions are a stated list. Raises ValueError where an operator that has no extents stands in a window.
    """
    spark = index.documents.sparkSession
    nodes: dict[str, query.Node] = {}
    level: dict[str, int] = {}

    def place(node: query.Node) -> str:
        key = query.window_key(node)
        if key not in nodes:
            below = [place(p) for p in node.parts]
            nodes[key], level[key] = node, 1 + max((level[b] for b in below), default=-1)
        return key

    roots = {text: place(query.parse(text)) for text in expressions}
    flat = "expr_id string, terms array<string>"
    # windows of terms alone read documents; terms by themselves are roots or stand beside windows
    bare = {k for k in roots.values() if not level[k]} | {query.window_key(p) for k, n in nodes.items() if level[k] > 1 for p in n.parts if p.op == "term"}
    done = single_terms(index, spark.createDataFrame([(k, [nodes[k].term]) for k in sorted(bare)], flat)) if bare or not nodes else None
    for depth in range(1, max(level.values(), default=0) + 1):
        found = None
        shape = {k: ("all" if n.op == "uw" and not n.width else n.op, n.width) for k, n in nodes.items() if level[k] == depth}
        for kind, width in sorted(set(shape.values())):
            own = [(k, nodes[k]) for k, s in shape.items() if s == (kind, width)]
            if depth == 1:
                solved = _solved(_parts(index, spark.createDataFrame([(k, [p.term for p in n.parts]) for k, n in own], flat)), kind, width)
                found = solved if found is None else found.unionByName(solved)
                continue
            links = [(k, i, len(n.parts), query.window_key(p)) for k, n in own for i, p in enumerate(n.parts)]
            links = small(spark.createDataFrame(links, "parent string, k int, size int, expr_id string"))
            met = done.join(links, "expr_id").groupBy("parent", "size", "doc_id").agg(F.first("len").alias("len"), F.sort_array(F.collect_list(F.struct("k", "begins", "ends"))).alias("all"))
            met = met.where(F.size("all") == F.col("size")).select(F.col("parent").alias("expr_id"), "doc_id", "len", F.transform("all", lambda s: s["begins"]).alias("begins"), F.transform("all", lambda s: s["ends"]).alias("ends"))
            solved = _solved(met, kind, width)
            found = solved if found is None else found.unionByName(solved)
        done = settled(found if done is None else done.unionByName(found))
    names = small(spark.createDataFrame([(t, k) for t, k in roots.items()], "text string, expr_id string"))
    return done.join(names, "expr_id").drop("expr_id").withColumnRenamed("text", "expr_id").select("expr_id", "doc_id", "len", "tf", "begins", "ends")


def extents(matches: DataFrame) -> DataFrame:
    """expr_id, doc_id, begin, end of each match."""
    rows = matches.select("expr_id", "doc_id", F.explode(F.arrays_zip("begins", "ends")).alias("s"))
    return rows.select("expr_id", "doc_id", F.col("s.begins").alias("begin"), F.col("s.ends").alias("end"))


def collection_counts(matches: DataFrame) -> DataFrame:
    """expr_id, n (all matches), docs (documents with one)."""
    return matches.groupBy("expr_id").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


def listed(matches: DataFrame, names: DataFrame) -> DataFrame:
    """expr_id, docnos: the external names, by names(doc_id, docno), of all matches' documents, once a match, in order."""
    each = matches.join(names, "doc_id").select("expr_id", F.struct("docno", "tf").alias("s"))
    lists = each.groupBy("expr_id").agg(F.sort_array(F.collect_list("s")).alias("all"))
    return lists.select("expr_id", F.flatten(F.transform("all", lambda s: F.array_repeat(s["docno"], s["tf"].cast("int")))).alias("docnos"))


def restricted_to(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Matches in the documents of docs(expr_id, doc_id) only."""
    return matches.join(docs.select("expr_id", "doc_id").distinct(), ["expr_id", "doc_id"], "left_semi")


def brief_list(matches: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """expr_id, n (all matches in the collection) and docnos of those in the feedback documents docs(expr_id, doc_id)."""
    matches = settled(matches.select("expr_id", "doc_id", "tf"))  # read twice
    near = listed(restricted_to(matches, docs), names)
    return collection_counts(matches).select("expr_id", "n").join(near, "expr_id", "left").withColumn("docnos", F.coalesce("docnos", F.array().cast("array<string>")))
