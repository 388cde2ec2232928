"""Benchmark decontamination: n-gram seeds find passages near test items, Smith-Waterman alignment scores them.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased. Every n-gram of a test item is a seed, however many documents
hold it, so that no repeated passage loses its seeds. What the words of a document and an item allow at most is
reckoned before they are aligned; only pairs that cannot reach the score are left out by that. Test items go in blocks
of bounded size, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, batch_of, column, cut, plain_text, runs, slices, small, split_words

#: Bytes of test items that are searched for at once.
BLOCK_BYTES = 8 * 1024 * 1024
#: Pairs of hit and item that are worked on at once (those of one document at least).
PAIRS = 1 << 20
MATCH, MISMATCH, GAP = 2, 1, 1


class Items:
    """Test items of a block as word numbers, with their n-grams."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        self.n, self.ids = n, np.array(ids, dtype=np.int64)
        words, self.first = split_words(plain_text(pa.array(texts, type=pa.large_string())))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.words = np.asarray(coded.indices).astype(np.int64) + 1
        #: Items of fewer words than an n-gram, by their words: only a text of the same words is a copy of them.
        self.short: dict[tuple, list[int]] = {}
        for k in np.flatnonzero((np.diff(self.first) > 0) & (np.diff(self.first) < n)).tolist():
            self.short.setdefault(tuple(self.words[self.first[k] : self.first[k + 1]].tolist()), []).append(k)
        size = np.maximum(np.diff(self.first) - n + 1, 0)
        self.item = np.repeat(np.arange(len(ids)), size)
        self.place = np.arange(len(self.item)) - np.repeat(np.cumsum(size) - size, size)
        code = self._codes(self.words, self.first[:-1][self.item] + self.place)
        self.codes, self.seed = np.unique(code, return_inverse=True)
        # places of each seed: rows seed_first[s]:seed_first[s+1] of seed_item and seed_place
        order = np.argsort(self.seed, kind="stable")
        self.seed_item, self.seed_place = self.item[order], self.place[order]
        self.seed_first = np.searchsorted(self.seed[order], np.arange(len(self.codes) + 1))

    def _codes(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One number for the n words from each place: hashed pairwise, so that any vocabulary fits."""
        out = np.zeros(len(at), np.uint64)
        for k in range(self.n):
            out = (out ^ numbers[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def words_of(self, items: np.ndarray) -> np.ndarray:
        """Words of the items, one item after another."""
        size = (self.first[1:] - self.first[:-1])[items]
        return self.words[np.repeat(self.first[:-1][items] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of the texts as numbers (0: in no item), first words, and document, word place and seed of each hit."""
        words, first = split_words(plain_text(texts))
        coded = words.dictionary_encode()
        numbers = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1)).astype(np.int64) + 1
        numbers = numbers[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
        known = numbers > 0
        start = known[: max(len(known) - self.n + 1, 0)].copy()
        for k in range(1, self.n):
            start &= known[k : len(known) - self.n + 1 + k]
        at = np.flatnonzero(start)
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at + self.n <= first[doc + 1] if len(at) else np.zeros(0, bool)
        at, doc = at[inside], doc[inside]
        code = self._codes(numbers, at)
        seed = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        found = (self.codes[seed] == code) if len(self.codes) else np.zeros(len(code), bool)
        return numbers, first, doc[found], at[found], seed[found]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of the item with words: score and the end (exclusive) in words and in item.

    MATCH for equal words, -MISMATCH for others, -GAP for each word left out. A row at a time; gaps along the row come
    from a running maximum.
    """
    slope = GAP * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    best, end, item_end = 0, 0, 0
    for i, w in enumerate(item):
        up = np.maximum(row - GAP, 0)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(words == w, MATCH, -MISMATCH))
        row = np.maximum.accumulate(up + slope) - slope
        j = int(np.argmax(row))
        if row[j] > best:
            best, end, item_end = int(row[j]), j, i + 1
    return best, end, item_end


def windows(starts: np.ndarray, length: int, limit: int) -> list[tuple[int, int]]:
    """Stretches of a document around diagonals, merged where they touch."""
    slack = length // 2 + 8
    out: list[list[int]] = []
    for s in np.unique(starts):
        lo, hi = max(0, int(s) - slack), min(limit, int(s) + length + slack)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def item_bounds(known: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The most that an alignment of each item can score: its best stretch, with MATCH for words the document has, else less.

    known: for all words of the items, one item after another, whether the document has the word; sizes: words of each
    item, one at least. A word left over costs the smaller of a mismatch and a gap.
    """
    first = np.cumsum(sizes) - sizes
    total = np.cumsum(np.where(known, MATCH, -min(MISMATCH, GAP)))
    before = np.concatenate([[0], total[:-1]])
    apart = np.repeat(np.arange(len(sizes)) * ((MATCH + MISMATCH + GAP) * (len(known) + 1)), sizes)  # no item sees one before it
    return np.maximum(np.maximum.reduceat(total - (np.minimum.accumulate(before - apart) + apart), first), 0)


def _parts(pairs: np.ndarray, doc: np.ndarray) -> Iterator[slice]:
    """Slices of the hits, whole documents each, with about PAIRS pairs."""
    if not len(doc):
        return
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    total = np.cumsum(pairs)[ends - 1]
    lo = done = 0
    while lo < len(doc):
        k = max(int(np.searchsorted(total, done + PAIRS, side="right")) - 1, int(np.searchsorted(ends, lo, side="right")))
        yield slice(lo, int(ends[k]))
        lo, done = int(ends[k]), int(total[k])


def _search(batches: Iterator[pa.RecordBatch], shared, least: float, floor_words: int) -> Iterator[pa.RecordBatch]:
    items: Items = shared.value
    known = np.zeros(len(items.vocabulary) + 1, bool)
    length = np.diff(items.first)
    enough = np.maximum(least * MATCH * length, np.minimum(MATCH * floor_words, 0.8 * MATCH * length))
    for batch, texts in slices(batches):
        ids = column(batch, "id").to_numpy()
        numbers, first, docs, ats, seeds = items.hits(texts)
        wides = items.seed_first[seeds + 1] - items.seed_first[seeds] if len(seeds) else np.zeros(0, np.int64)
        found = []
        if items.short:
            for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < items.n)).tolist():
                for i in items.short.get(tuple(numbers[first[d] : first[d + 1]].tolist()), []):
                    found.append((int(ids[d]), int(items.ids[i]), 1.0, 0, int(first[d + 1] - first[d]) - 1))
        for part in _parts(wides, docs):
            doc, at, seed, wide = docs[part], ats[part], seeds[part], wides[part]
            hit = np.repeat(np.arange(len(seed)), wide)
            row = items.seed_first[seed][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(wide) - wide, wide)
            item, start = items.seed_item[row], at[hit] - items.seed_place[row]
            pair = doc[hit] * len(items.ids) + item
            order = np.argsort(pair, kind="stable")
            cuts = runs(pair[order])
            ends = np.append(cuts[1:], len(order))
            of_doc, of_item = np.divmod(pair[order][cuts], len(items.ids))
            many = np.append(runs(of_doc), len(cuts))
            for x, y in zip(many[:-1], many[1:]):
                d, candidates = int(of_doc[x]), of_item[x:y]
                own = numbers[first[d] : first[d + 1]]
                known[own] = True
                known[0] = False
                bound = item_bounds(known[items.words_of(candidates)], length[candidates])
                known[own] = False
                for k in x + np.flatnonzero(bound >= enough[candidates]):
                    i = int(of_item[k])
                    want = items.words[items.first[i] : items.first[i + 1]]
                    known[want] = True
                    best = (0, 0, 0)
                    for a, b in windows(start[order[cuts[k] : ends[k]]] - first[d], len(want), len(own)):
                        if item_bounds(known[own[a:b]], np.array([b - a]))[0] < enough[i]:
                            continue
                        score, end, item_end = align(want, own[a:b])
                        if score > best[0]:
                            begin = align(want[:item_end][::-1], own[a : a + end][::-1])[1]
                            best = (score, a + end - begin, a + end)
                    known[want] = False
                    if best[0] >= enough[i]:
                        found.append((int(ids[d]), int(items.ids[i]), best[0] / (MATCH * len(want)), best[1], best[2] - 1))
        if found:
            yield batch_of(_LEAKS, *map(list, zip(*found)))


def leaks(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.4, floor_words: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a test item or an edited copy: doc_id, item_id, score, first_word, last_word.

    score is the best local alignment's share of the item's own score, `least` or more; the alignment must also be worth
    floor_words equal words, or four fifths of an item too short for that. first_word and last_word are its
    stretch in the document, words from 0; of several best ones the first. Null or wordless texts match nothing; items of
    under n words match documents of the same words alone; items or documents of equal text each give their rows. Rows with null ids are dropped. Empty
    tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    items = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    blocks = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id", "text").collect()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast(Items([r.id for r in rows], [r.text for r in rows], n))
        found = arrow_map(docs, partial(_search, shared=shared, least=least, floor_words=floor_words), "doc_id long, item_id long, score double, first_word long, last_word long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that leaks() names; rows with null ids stay."""
    id_col = options.get("id_col", "doc_id")
    bad = small(cut(leaks(docs, items, **options).select("doc_id").distinct()), 16)
    return docs.join(bad, docs[id_col].cast("long") == bad["doc_id"], "left_anti")
