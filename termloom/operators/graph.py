"""Concept graphs: association edges from a collection, relation tables, neighbours, typed filters and layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions import beliefs
from termloom.functions import text as tx
from termloom.operators.index import Index
from termloom.operators.settle import restricted, settled

#: Counts of pairs that a task holds at once, and sources among them at most.
CELL, SOURCES = 1 << 24, 4096
#: Tasks that the pairs are dealt to at least.
CELLS = 24
#: Bits of the sieves that tell which words may be ends.
SIEVE = 1 << 23
#: Pairs of a document's words that are added up at once.
PAIRS = 4_000_000


def last_wins(edges: DataFrame, order: str) -> DataFrame:
    """(src, dst, rel) with one relation for each pair of ends, that of the last row; blank or unprintable ends are dropped."""
    good = edges.where((F.trim("src") != "") & (F.trim("dst") != "") & (F.trim("rel") != "") & tx.printable(F.col("src")) & tx.printable(F.col("dst")) & tx.printable(F.col("rel")))
    return good.groupBy("src", "dst").agg(F.max_by("rel", order).alias("rel"))


def _sieve(ends: DataFrame) -> np.ndarray:
    """SIEVE bits, set for the keys of ends(key); the driver gathers SIEVE / 64 rows at most."""
    place = F.pmod("key", F.lit(SIEVE).cast("long"))
    words = ends.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(SIEVE // 64, 1), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _may(keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    place = np.mod(keys, SIEVE)
    return (sieve[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


_DEALT = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _deal(batches: Iterator[pa.RecordBatch], sieves, cells: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """For each cell (block of sources, block of targets) one row a batch of documents: both ends' keys and, document by
    document, the places of its ends among them."""
    sources, targets = sieves.value
    for batch in batches:
        lists = batch.column(0)
        keys = lists.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        sides = []
        for sieve, blocks in ((sources, cells[0]), (targets, cells[1])):
            may = _may(keys, sieve)
            own, code = np.unique(keys[may], return_inverse=True)
            block = np.mod(own >> 23, blocks)[code]  # bits that the sieve has not used
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1))
            sides.append((own, code[order], doc[may][order], cuts))
        rows = []
        for s in range(cells[0]):
            for t in range(cells[1]):
                packed = []
                for (own, code, at, cuts), k in zip(sides, (s, t)):
                    some, place = np.unique(code[cuts[k] : cuts[k + 1]], return_inverse=True)
                    packed += [own[some].tobytes(), np.stack([at[cuts[k] : cuts[k + 1]], place]).astype(np.int32).tobytes()]
                if packed[1] and packed[3]:
                    rows.append((s * cells[1] + t, 2, *packed))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _DEALT)], schema=_DEALT)


def _ends(batches: Iterator[pa.RecordBatch], cells: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The keys of sources (kind 0) and targets (kind 1, with their documents) for all cells they belong to."""
    for batch in batches:
        key, df, source, target = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "df", "source", "target"))
        rows = []
        for s in range(cells[0]):
            for t in range(cells[1]):
                for kind, own in ((0, source & (np.mod(key >> 23, cells[0]) == s)), (1, target & (np.mod(key >> 23, cells[1]) == t))):
                    if own.any():
                        rows.append((s * cells[1] + t, kind, key[own].tobytes(), df[own].tobytes(), None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _DEALT)], schema=_DEALT)


_MET = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("df_both", pa.int64())])


def _add(total: np.ndarray, row: np.ndarray, start: np.ndarray, sizes: np.ndarray, columns: np.ndarray) -> None:
    """Adds one to total[row[k], columns[start[k]:start[k] + sizes[k]]] for each k, about PAIRS at a time."""
    flat, width = total.reshape(-1), total.shape[1]
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = sizes[lo:hi]
        at = np.arange(n.sum()) + np.repeat(start[lo:hi] - np.cumsum(n) + n, n)
        np.add.at(flat, np.repeat(row[lo:hi] * width, n) + columns[at], np.int32(1))
        lo = hi


def _counted(held: dict, least_both: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell in `least_both` documents and more; of each source those that may be among its best `most`."""
    if "total" not in held:
        return
    for k, key in enumerate(held[0]):
        n = held["total"][k]
        good = np.flatnonzero(n >= least_both)
        good = good[held[1][good] != key]
        share = np.log(n[good] / held["df"][good])
        if len(good) > most:  # the weight grows with the share alone; what rounding may bring level stays
            good = good[share >= np.partition(share, len(share) - most)[len(share) - most] - 1e-5]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), key)), pa.array(held[1][good]), pa.array(n[good].astype(np.int64))], schema=_MET)


def _meet(batches: Iterator[pa.RecordBatch], least_both: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell and kind: a cell's ends first, then its documents. One cell's counts are held at a time."""
    held: dict = {}
    now = None
    for batch in batches:
        for cell, kind, a, b, c, d in zip(*(batch.column(batch.schema.get_field_index(f.name)).to_pylist() for f in _DEALT)):
            if cell != now:
                yield from _counted(held, least_both, most)
                held, now = {0: np.zeros(0, np.int64), 1: np.zeros(0, np.int64), "df": np.zeros(0, np.int64)}, cell
            if kind < 2:
                held[kind] = np.append(held[kind], np.frombuffer(a, np.int64))
                if kind:
                    held["df"] = np.append(held["df"], np.frombuffer(b, np.int64))
                continue
            if "total" not in held:
                order = np.argsort(held[1])
                held[0], held[1], held["df"] = np.sort(held[0]), held[1][order], held["df"][order]
                held["total"] = np.zeros((len(held[0]), len(held[1])), np.int32)
            if not held["total"].size:
                continue
            sides = []
            for own, packed, ends in ((a, b, held[0]), (c, d, held[1])):
                own, (doc, code) = np.frombuffer(own, np.int64), np.frombuffer(packed, np.int32).reshape(2, -1)
                place = np.minimum(np.searchsorted(ends, own), len(ends) - 1)
                real = (ends[place] == own)[code]
                sides.append((doc[real], place[code[real]]))
            (doc, row), (other, column) = sides
            order = np.argsort(other, kind="stable")
            other, column = other[order], column[order]
            by = np.argsort(row, kind="stable")  # a source's counts stand together
            doc, row = doc[by], row[by]
            start, end = np.searchsorted(other, doc, side="left"), np.searchsorted(other, doc, side="right")
            _add(held["total"], row, start, end - start, column)
    yield from _counted(held, least_both, most)


def association(index: Index, sources: DataFrame, least_both: int = 3, low: int = 5, share: float = 0.1, most: int = 20) -> DataFrame:
    """(src, dst, df_both, weight): the best `most` terms of each source term by pointwise mutual information of documents.

    Ends are terms in `low` documents and more, in no more than `share` of all documents (a word of most documents tells
    nothing); targets have four letters or more. Documents travel as numbers of their ends, once for each block of targets
    and of sources; a task adds up the pairs of two blocks in one table of bounded size, so that no pair of a document is a row.
    """
    spark = index.documents.sparkSession
    totals = index.totals().select("n_docs")
    good = index.vocabulary().join(totals).where((F.col("df") >= low) & (F.col("df") <= F.col("n_docs") * F.lit(share)))
    good = settled(good.select("term", "df", "n_docs", (F.length("term") >= 4).alias("target"), F.xxhash64("term").alias("key")))
    src = settled(restricted(good, "term", sources).select(F.col("term").alias("src"), F.col("df").alias("a"), F.col("key").alias("i")))
    n_sources, n_targets = src.count(), good.where("target").count()
    blocks = max(1, -(-n_sources // SOURCES))
    cells = blocks, max(-(-CELLS // blocks), -(-(min(n_sources, SOURCES) * n_targets) // CELL))
    width = min(cells[0] * cells[1], max(CELLS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sieves = spark.sparkContext.broadcast((_sieve(src.select(F.col("i").alias("key"))), _sieve(good.where("target").select("key"))))
    schema = "cell int, kind int, a binary, b binary, c binary, d binary"
    words = index.documents.select(F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)).alias("keys"))
    dealt = words.mapInArrow(lambda batches: _deal(batches, sieves, cells), schema)
    ends = good.join(src.select(F.col("i").alias("key"), F.lit(True).alias("source")), "key", "left").select("key", "df", F.coalesce("source", F.lit(False)).alias("source"), "target")
    dealt = dealt.unionByName(ends.mapInArrow(lambda batches: _ends(batches, cells), schema))
    met = dealt.repartition(width, "cell").sortWithinPartitions("cell", "kind").mapInArrow(lambda batches: _meet(batches, least_both, most), T.StructType([T.StructField(c, T.LongType()) for c in ("i", "j", "df_both")]))
    named = met.join(good.select(F.col("key").alias("j"), F.col("term").alias("dst"), F.col("df").alias("b"), "n_docs"), "j").join(src, "i")
    weighed = named.select("src", "dst", "df_both", F.round(beliefs.pmi(F.col("df_both"), F.col("a"), F.col("b"), F.col("n_docs")), 6).alias("weight"))
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return weighed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def neighbours(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, term, concept for the edges out of terms(qid, term)."""
    return terms.select("qid", "term").join(edges.select(F.col("src").alias("term"), F.col("dst").alias("concept")), "term").select("qid", "term", "concept").distinct()


def hops(terms: DataFrame, edges: DataFrame, layers: int) -> DataFrame:
    """qid, concept, layer: concepts by the fewest edges from a query term, up to `layers`; query terms are layer 0."""
    seen = terms.select("qid", F.col("term").alias("concept"), F.lit(0).alias("layer")).distinct()
    front = seen
    for layer in range(1, layers + 1):
        near = neighbours(front.select("qid", F.col("concept").alias("term")), edges).select("qid", "concept").distinct()
        front = near.join(seen, ["qid", "concept"], "left_anti").withColumn("layer", F.lit(layer))
        seen = seen.unionByName(front)
    return seen


def seeds(scored: DataFrame, count: int) -> DataFrame:
    """qid, term: the first `count` concepts of each query by scored(qid, concept, score), ties by concept; they seed the next hop."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "concept")
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count).select("qid", F.col("concept").alias("term"))


def related(concepts: DataFrame, relations: DataFrame, names: DataFrame) -> DataFrame:
    """Concepts of relations(cui1, cui2) out of concepts(qid, cui), with their smallest name; those without a name go."""
    named = names.groupBy("cui").agg(F.min("name").alias("name"))
    return concepts.select("qid", F.col("cui").alias("cui1")).join(relations.distinct(), "cui1").select("qid", "cui1", F.col("cui2").alias("cui")).join(named, "cui")


def of_types(concepts: DataFrame, types: DataFrame, wanted: DataFrame) -> DataFrame:
    """concepts(..., sty comma-joined abbreviations) once for each of their types in wanted(name), by types(abbr, tui, name)."""
    good = types.join(wanted.select("name").distinct(), "name", "left_semi").select(F.col("abbr"), "tui")
    return concepts.withColumn("abbr", F.explode(F.split("sty", ","))).join(good, "abbr")


def frequent(values: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Groups that occur more than `limit` times, once each with their count."""
    return values.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def names_table(rows: DataFrame) -> DataFrame:
    """cui, name of preferred English names: rows(cui, lat, ts, stt, ispref, name) whose bare name is letters only."""
    keep = rows.where("lat = 'ENG' and ts = 'P' and stt = 'PF' and ispref = 'Y'")
    return keep.select("cui", tx.plain_name(F.col("name")).alias("name")).where("name is not null").distinct()


def term_pairs(terms: DataFrame, order: Column) -> DataFrame:
    """qid, a, b: unordered pairs of a query's terms, the later one first."""
    numbered = terms.withColumn("_k", order)
    left, right = numbered.select("qid", F.col("term").alias("a"), F.col("_k").alias("i")), numbered.select("qid", F.col("term").alias("b"), F.col("_k").alias("j"))
    return left.join(right, "qid").where("i > j").select("qid", "a", "b")
