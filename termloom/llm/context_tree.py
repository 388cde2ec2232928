"""Language-model scoring by context-tree weighting over byte contexts, beside an add-one unigram base.

Every byte is eight binary decisions. A node stands for a context of 0 to DEPTH previous bytes and the bits of the byte
decided so far; it holds how often a 0 and a 1 followed. Its Krichevsky-Trofimov probability Pe and the product of its
children's Pw mix half and half into Pw, from the deepest contexts to the root. The weights so learned mix the nodes'
estimates along the path of a new byte: the log probability of a text is the sum over its bytes and a final end mark.
A path stops at the deepest context that was seen. Counts cover all training texts, and the tree holds every context of
them: it is dealt out by the last ROOT bytes, whose subtree is whole in one place, and what the subtrees weigh meets in
the nodes above them. Tasks that score hold the log probabilities of frequent sequences and ask for all others by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ODD, arrow_map, batch_of, column, crc_fold, cut, hash_words, mix, one_row_an_id, runs, slices, small, split_words, text_bytes, text_offsets

#: Bytes of context.
DEPTH = 5
#: Bytes of context by which the tree is dealt out; above them are at most 256 ** (ROOT - 1) contexts.
ROOT = 2
#: Byte sequences (context and next byte) whose log probabilities every task holds; all others are looked up by a shuffle.
LEAVES = 1 << 20
#: Frequent words whose counts every task holds; all others are looked up by a shuffle.
HEAD = 1 << 17
#: Stands before and after each text; no UTF-8 text holds it.
MARK = 0xFF
_SLOTS = 21
_EMPTY = np.uint64(2**64 - 1)
_NONE = -1
#: Distinct sequences, on average, whose subtrees a task holds at once.
SHARD = 1 << 18
#: Text bytes whose sequences are held at once.
PORTION = 1024 * 1024
#: Places of words and sequences whose requests are answered at once.
ASKED = 1 << 21


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end mark the last DEPTH bytes and itself as one number, with len(texts)+1 offsets."""
    data, offsets = text_bytes(texts)
    length = np.diff(offsets)
    gap = DEPTH + 1
    full = np.full(len(data) + gap * len(length), MARK, np.uint8)
    full[np.arange(len(data)) + np.repeat(np.arange(len(length)) * gap + DEPTH, length)] = data
    g = np.zeros(len(full), np.uint64)
    for k in range(DEPTH, -1, -1):
        g <<= np.uint64(8)
        g[k:] |= full[: len(full) - k]
    keep = np.ones(len(full), bool)
    starts = offsets[:-1] + np.arange(len(length)) * gap
    for k in range(DEPTH):
        keep[starts + k] = False
    return g[keep], offsets + np.arange(len(offsets))


def shard(g: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each sequence, by the last ROOT bytes of its context. Shards modulo the number of buckets, which divides theirs, are buckets."""
    return (mix((g >> np.uint64(8)) & np.uint64((1 << 8 * ROOT) - 1)) % np.uint64(shards)).astype(np.int32)


def shortened(g: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences with `depth` bytes of context, and their counts."""
    low, place = np.unique(g & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
    sums = np.zeros(len(low), np.int64)
    np.add.at(sums, place, n)
    return low, sums


# --- counting ---------------------------------------------------------------------------------------------------

_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_COUNTED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("size", pa.int64()), ("total", pa.int64()), ("head", pa.binary()), ("head_counts", pa.binary())])


def _joined(words: pa.Array) -> bytes:
    return "\n".join(words.to_pylist()).encode()


def _parted(blob: bytes) -> pa.Array:
    return pa.array(blob.decode().split("\n") if blob else [], type=pa.large_string())


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of a slice's words (kind 0) and byte sequences (kind 1), packed by bucket."""
    for _, texts in slices(batches, most=8 * 1024 * 1024):
        texts = pc.ascii_lower(texts)
        words, _ = split_words(texts)
        coded = words.dictionary_encode()
        names, counts = coded.dictionary, np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)).astype(np.int64)
        bucket = (mix(hash_words(names)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        names, counts, bucket = names.take(pa.array(order)), counts[order], bucket[order]
        at = runs(bucket)
        for lo, hi in zip(at, np.append(at[1:], len(bucket))):
            yield batch_of(_PACKED, [bucket[lo]], [0], [_joined(names.slice(lo, hi - lo))], [counts[lo:hi].tobytes()])
        g, counts = _gram_counts(texts)
        bucket = shard(g, buckets)
        order = np.argsort(bucket, kind="stable")
        g, counts, bucket = g[order], counts[order], bucket[order]
        at = runs(bucket)
        for lo, hi in zip(at, np.append(at[1:], len(bucket))):
            yield batch_of(_PACKED, [bucket[lo]], [1], [g[lo:hi].tobytes()], [counts[lo:hi].astype(np.int64).tobytes()])


def _gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte sequences of the texts and their counts, a few MB of text at a time."""
    keys, counts = [], []
    for part in portions(texts):
        g = grams(part)[0]
        g.sort()
        at = runs(g)
        keys.append(g[at])
        counts.append(np.diff(np.append(at, len(g))))
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def portions(texts: pa.Array, most: int = PORTION) -> Iterator[pa.Array]:
    """Consecutive slices of about `most` bytes, one text at least."""
    ends, lo = text_offsets(texts), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends[1:], ends[lo] + most, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def _by_bucket(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[tuple, list[tuple]]:
    held: dict[tuple, list[tuple]] = {}
    for batch in batches:
        for bucket, kind, *row in zip(*(column(batch, c).to_pylist() for c in ["bucket", "kind", *names])):
            held.setdefault((bucket, kind), []).append(tuple(row))
    return held


def _total(batches: Iterator[pa.RecordBatch], head: int) -> Iterator[pa.RecordBatch]:
    """One row a bucket and kind with the summed counts, and its most frequent words."""
    held = _by_bucket(batches, ["keys", "counts"])
    for bucket, kind in sorted(held):
        rows = held.pop((bucket, kind))
        counts = np.concatenate([np.frombuffer(c, np.int64) for _, c in rows])
        if kind == 0:
            coded = pa.concat_arrays([_parted(k) for k, _ in rows]).dictionary_encode()
            sums = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(sums, np.asarray(coded.indices), counts)
            order = np.argsort(-sums, kind="stable")[:head]
            top = _joined(coded.dictionary.take(pa.array(order)))
            yield batch_of(_COUNTED, [bucket], [0], [_joined(coded.dictionary)], [sums.tobytes()], [len(sums)], [int(sums.sum())], [top], [sums[order].tobytes()])
        else:
            keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in rows])
            keys, place = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, counts)
            yield batch_of(_COUNTED, [bucket], [1], [keys.tobytes()], [sums.tobytes()], [len(sums)], [int(sums.sum())], [None], [None])


def _depths(batches: Iterator[pa.RecordBatch], depths: Sequence[int]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("depth", pa.int32()), ("g", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for keys, counts in zip(column(batch, "keys").to_pylist(), column(batch, "counts").to_pylist()):
            g, n = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
            for d in depths:
                low, sums = shortened(g, n, d)
                yield batch_of(schema, np.full(len(low), d, np.int32), low.astype(np.int64), sums)


def kept_sequences(counted: DataFrame, most: int = LEAVES, depths: Sequence[int] = range(DEPTH + 1)) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the depths the byte sequences and counts of the most frequent contexts, at most `most` of them."""
    rows = cut(arrow_map(counted.where("kind = 1").select("keys", "counts"), partial(_depths, depths=depths), "depth int, g long, n long").groupBy("depth", "g").agg(F.sum("n").alias("n")))
    contexts = cut(rows.groupBy("depth", F.shiftright("g", 8).alias("context")).agg(F.sum("n").alias("times"), F.count("*").alias("wide")))
    level = F.floor(F.log2("times")).cast("int")
    sizes: dict[int, list[tuple[int, int]]] = {}
    for depth, at, wide in contexts.groupBy("depth", level.alias("at")).agg(F.sum("wide")).collect():  # at most 64 levels a depth
        sizes.setdefault(depth, []).append((at, wide))
    floor = {}
    for depth, levels in sizes.items():
        left, floor[depth] = most, 63
        for at, wide in sorted(levels, reverse=True):
            if wide > left:
                break
            left, floor[depth] = left - wide, at
    keep = F.lit(False)
    for depth, at in floor.items():
        keep |= (F.col("depth") == depth) & (level >= at)
    some = contexts.where(keep).select("depth", "context")
    table = rows.withColumn("context", F.shiftright("g", 8)).join(small(some, 20), ["depth", "context"]).select("depth", "g", "n").toArrow()
    depth, g, n = (table[c].to_numpy() for c in ("depth", "g", "n"))
    out = []
    for d in depths:
        own = depth == d
        order = np.argsort(g[own])
        out.append((g[own][order].astype(np.uint64), n[own][order]))
    return out


# --- the tree ---------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0 (Stirling's series after seven steps up)."""
    y = x + 7
    shift = np.zeros_like(y)
    for k in range(7):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones in any fixed order."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def nodes(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth, sorted by (context, bits so far), and how often a 0 and a 1 followed."""
    symbol = g & np.uint64(255)
    context = (g >> np.uint64(8)) << np.uint64(8)
    parts = []
    for j in range(8):  # prefixes of different lengths never meet
        keys = context | np.uint64(1 << j) | (symbol >> np.uint64(8 - j))
        one = ((symbol >> np.uint64(7 - j)) & np.uint64(1)) == 1
        unique, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, weights=n, minlength=len(unique))
        ones = np.bincount(place, weights=n * one, minlength=len(unique))
        parts.append((unique, total - ones, ones))
    keys, zeros, ones = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys)
    return keys[order], zeros[order], ones[order]


def parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """The parent of each node of a depth: the same bits under a context without its oldest byte."""
    return keys & np.uint64((1 << 8 * depth) - 1)


def gathered(keys: np.ndarray, depth: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The parents of a depth's nodes, and sums of the nodes' values."""
    up, place = np.unique(parents(keys, depth), return_inverse=True)
    return up, *(np.bincount(place, weights=v, minlength=len(up)) for v in values)


def weigh(levels: list[tuple], first: int, below: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """For each node of depths from `first` on the share of its own estimate, Pe / 2 / Pw, and log Pw of the first depth's nodes.

    below: log of the product of Pw over the children of the last depth's nodes, which are leaves without it.
    """
    weights: list[np.ndarray] = []
    total = np.zeros(0)
    for d in range(first + len(levels) - 1, first - 1, -1):
        keys, zeros, ones = levels[d - first]
        own = kt_log(zeros, ones)
        if below is None:
            total, share = own, np.ones(len(keys))
        else:
            total = np.logaddexp(own, below) - np.log(2)
            share = np.exp(own - np.log(2) - total)
        weights.append(share)
        if d > first:
            below = gathered(keys, d, total)[1]
    return weights[::-1], total


class Tree:
    """Nodes of each depth, sorted by (context, bits so far), with the mixed probability of a 1.

    kept: sequences and counts of the depths up to DEPTH, from 0 on or from the one below the last depth of the tree `above`.
    """

    def __init__(self, kept: list[tuple[np.ndarray, np.ndarray]], above: Tree | None = None):
        levels = [nodes(g, n) for g, n in kept]
        self._mix(levels, weigh(levels, DEPTH + 1 - len(kept))[0], above)

    @classmethod
    def top(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Tree:
        """The depths under ROOT, from the nodes of the last of them and the log Pw of all that is below each."""
        levels = [(keys, zeros, ones)]
        for d in range(ROOT - 1, 0, -1):
            levels.insert(0, gathered(levels[0][0], d, *levels[0][1:]))
        self = cls.__new__(cls)
        self._mix(levels, weigh(levels, 0, below)[0], None)
        return self

    def _mix(self, levels: list[tuple], weights: list[np.ndarray], above: Tree | None) -> None:
        self.keys, self.ones = ([*above.keys], [*above.ones]) if above else ([], [])
        done, rest = (above.done, above.rest) if above else (np.zeros(0), np.zeros(0))
        for (keys, zeros, ones), w in zip(levels, weights):
            est = (ones + 0.5) / (zeros + ones + 1.0)
            if not self.keys:
                before, left = np.zeros(len(keys)), np.ones(len(keys))
            else:  # all parents are there
                up = np.searchsorted(self.keys[-1], parents(keys, len(self.keys)))
                before, left = done[up], rest[up]
            self.keys.append(keys)
            self.ones.append(before + left * est)
            done, rest = before + left * w * est, left * (1 - w)
        self.done, self.rest = done, rest

    def score(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each sequence after the others."""
        g, place = np.unique(g, return_inverse=True)
        symbol = g & np.uint64(255)
        out = np.zeros(len(g))
        for j in range(8):
            bits = np.uint64(1 << j) | (symbol >> np.uint64(8 - j))
            p, open_ = np.full(len(g), 0.5), np.ones(len(g), bool)
            for d in range(len(self.keys) - 1, -1, -1):
                keys = self.keys[d]
                if not len(keys) or not open_.any():
                    continue
                rest = np.flatnonzero(open_)
                want = ((g[rest] >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | bits[rest]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                p[rest[hit]] = self.ones[d][at[hit]]
                open_[rest[hit]] = False
            one = ((symbol >> np.uint64(7 - j)) & np.uint64(1)) == 1
            out += np.log10(np.where(one, p, 1 - p))
        return out.astype(np.float32).astype(np.float64)[place]  # as precise as what tasks hold


def _subtree(g: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences and counts of the depths from ROOT on."""
    return [shortened(g, n, d) for d in range(ROOT, DEPTH)] + [(g, n)]


def _shards(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The sequences and counts of each shard of buckets."""
    for batch in batches:
        for keys, counts in zip(column(batch, "keys").to_pylist(), column(batch, "counts").to_pylist()):
            g, n = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
            own = shard(g, shards)
            order = np.argsort(own, kind="stable")
            g, n, own = g[order], n[order], own[order]
            at = runs(own)
            for lo, hi in zip(at, np.append(at[1:], len(own))):
                yield int(own[lo]), g[lo:hi], n[lo:hi]


def _split(batches: Iterator[pa.RecordBatch], shards: int, buckets: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    for own, g, n in _shards(batches, shards):
        yield batch_of(schema, [own % buckets], [own], [1], [g.tobytes()], [n.tobytes()])


def _roots(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """For each shard the nodes right above its subtrees: their counts and the log of the product of Pw below them."""
    schema = pa.schema([("node", pa.int64()), ("shard", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64()), ("below", pa.float64())])
    for own, g, n in _shards(batches, shards):
        levels = [nodes(*kept) for kept in _subtree(g, n)]
        node, zeros, ones, below = gathered(levels[0][0], ROOT, *levels[0][1:], weigh(levels, ROOT)[1])
        yield batch_of(schema, node.astype(np.int64), np.full(len(node), own, np.int32), zeros.astype(np.int64), ones.astype(np.int64), below)


def top_tree(sequences: DataFrame, shards: int) -> Tree:
    """The tree of the depths under ROOT. Sums are taken in the order of shards, so that tasks' order changes nothing."""
    rows = arrow_map(sequences, partial(_roots, shards=shards), "node long, shard int, zeros long, ones long, below double")
    below = F.aggregate(F.array_sort(F.collect_list(F.struct("shard", "below"))), F.lit(0.0), lambda done, x: done + x["below"])
    table = rows.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), below.alias("below")).orderBy("node").toArrow()  # 256 ** ROOT rows at most
    return Tree.top(*(table[c].to_numpy().astype(t) for c, t in (("node", np.uint64), ("zeros", np.float64), ("ones", np.float64), ("below", np.float64))))


def _held_logs(batches: Iterator[pa.RecordBatch], above, frequent, shards: int) -> Iterator[pa.RecordBatch]:
    """log10 of those of the shards' sequences that tasks are to hold."""
    schema = pa.schema([("keys", pa.binary()), ("logs", pa.binary())])
    for _, g, n in _shards(batches, shards):
        own = g[np.isin(g, frequent.value, assume_unique=True)]
        if len(own):
            yield batch_of(schema, [own.tobytes()], [Tree(_subtree(g, n), above.value).score(own).astype(np.float32).tobytes()])


class Held:
    """log10 of the sequences that every task holds, in a table of open addressing; an empty slot holds all ones, which no sequence of DEPTH + 1 bytes is."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.__setstate__((keys, logs))

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, self.values

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.keys, self.values = state
        self.slots, self.logs = np.full(1 << _SLOTS, _EMPTY), np.zeros(1 << _SLOTS, np.float32)
        left, at = np.arange(len(self.keys)), (self.keys * ODD) >> np.uint64(64 - _SLOTS)
        while len(left):
            _, first = np.unique(at, return_index=True)
            free = first[self.slots[at[first]] == _EMPTY]
            self.slots[at[free]], self.logs[at[free]] = self.keys[left[free]], self.values[left[free]]
            rest = np.ones(len(left), bool)
            rest[free] = False
            left, at = left[rest], (at[rest] + np.uint64(1)) & np.uint64((1 << _SLOTS) - 1)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each sequence, 0 for those that are not held, and the places of these."""
        at = (g * ODD) >> np.uint64(64 - _SLOTS)
        there = self.slots[at]
        out = self.logs[at].astype(np.float64)
        miss = np.flatnonzero(there != g)
        out[miss] = 0
        unheld = [miss[there[miss] == _EMPTY]]
        miss = miss[there[miss] != _EMPTY]
        where = at[miss]
        while len(miss):
            where = (where + np.uint64(1)) & np.uint64((1 << _SLOTS) - 1)
            there = self.slots[where]
            hit = there == g[miss]
            out[miss[hit]] = self.logs[where[hit]]
            unheld.append(miss[there == _EMPTY])
            stay = ~hit & (there != _EMPTY)
            miss, where = miss[stay], where[stay]
        return out, np.concatenate(unheld)


class Model:
    """What every scoring task holds: log probabilities of frequent sequences and counts of frequent words. Its size is bounded by LEAVES and HEAD."""

    def __init__(self, held: Held, head: dict[str, int]):
        self.held, self.head = held, head


# --- scoring ----------------------------------------------------------------------------------------------------

_SCORED = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
_SUMS = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
_PARTS = pa.schema([("bucket", pa.int32()), ("source", pa.int32()), *((f.name, pa.binary()) for f in _SUMS)])


def _doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _parts(source: int, buckets: int, *sums: np.ndarray) -> pa.RecordBatch:
    """Columns of _SUMS packed by the documents' buckets."""
    bucket = _doc_bucket(sums[0], buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, sums = bucket[order], [v[order] for v in sums]
    at = runs(bucket)
    ends = np.append(at[1:], len(bucket))
    return batch_of(_PARTS, bucket[at], np.full(len(at), source, np.int32), *([v[lo:hi].tobytes() for lo, hi in zip(at, ends)] for v in sums))


def _requests(dealt: np.ndarray, place: np.ndarray, doc: np.ndarray, packed: Callable[[np.ndarray], bytes]) -> Iterator[tuple]:
    """For each bucket or shard its names packed, and the document and the name's place among them of all places. dealt: where each name goes; place: the name at each place."""
    order = np.argsort(dealt, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[place]
    by = np.argsort(place, kind="stable")
    place, doc, dealt = place[by], doc[by], dealt[order]
    at = runs(dealt)
    for lo, hi in zip(at, np.append(at[1:], len(dealt))):
        a, b = np.searchsorted(place, (lo, hi))
        yield int(dealt[lo]), packed(order[lo:hi]), doc[a:b].tobytes(), (place[a:b] - lo).astype(np.int32).tobytes()


def _score(batches: Iterator[pa.RecordBatch], shared, shards: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row a document with what its frequent words and sequences give (kind 2), and requests for its other words (kind 3) and sequences (kind 4)."""
    model: Model = shared.value
    for batch, texts in slices(batches):
        ids = column(batch, "id").to_numpy()
        texts = pc.ascii_lower(texts)
        score, size, unheld, holder = [], [], [], []
        done = 0
        for part in portions(texts):
            g, offsets = grams(part)
            logs, miss = model.held.find(g)
            score.append(np.add.reduceat(logs, offsets[:-1]))
            size.append(np.diff(offsets))
            unheld.append(g[miss])
            holder.append(done + np.searchsorted(offsets, miss, side="right") - 1)
            done += len(part)
        score, size, unheld, holder = (np.concatenate(c) for c in (score, size, unheld, holder))
        words, first = split_words(texts)
        tokens = np.diff(first)
        coded = words.dictionary_encode()
        names, place = coded.dictionary, np.asarray(coded.indices)
        found = np.fromiter((model.head.get(w, 0) for w in names.to_pylist()), np.int64, len(names))
        doc = np.repeat(np.arange(len(ids)), tokens)
        count = found[place] if len(place) else np.zeros(0, np.int64)
        known = np.bincount(doc, weights=count > 0, minlength=len(ids)).astype(np.int64)
        sums = np.bincount(doc, weights=np.log10(count + 1.0), minlength=len(ids))
        m = len(ids)
        none = [None] * m
        yield batch_of(_SCORED, _doc_bucket(ids, buckets), [_NONE] * m, [2] * m, none, none, none, none, ids, tokens, known, sums, score, size)
        rare = np.flatnonzero(found == 0)
        rank = np.full(len(names), -1, np.int64)
        rank[rare] = np.arange(len(rare))
        place = rank[place] if len(place) else np.zeros(0, np.int64)
        doc, place = doc[place >= 0], place[place >= 0]
        bucket = (mix(hash_words(names.take(pa.array(rare)))) % np.uint64(buckets)).astype(np.int32)
        rows = [(b, _NONE, 3, *row) for b, *row in _requests(bucket, place, ids[doc], lambda some: _joined(names.take(pa.array(rare[some]))))]
        keys, place = np.unique(unheld, return_inverse=True)
        rows += [(own % buckets, own, 4, *row) for own, *row in _requests(shard(keys, shards), place, ids[holder], lambda some: keys[some].tobytes())]
        if rows:
            bucket, own, kind, packed, docs, places = zip(*rows)
            none = [None] * len(rows)
            yield batch_of(_SCORED, bucket, own, kind, packed, none, docs, places, none, none, none, none, none, none)


class _Known:
    """A bucket's counted words, or a shard's subtrees, and the requests for them that wait."""

    def __init__(self, above: Tree):
        self.above = above
        self.names, self.counts = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.g, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tree: Tree | None = None
        self.words: list[tuple] = []
        self.sequences: list[tuple] = []
        self.waiting = 0

    def take(self, kind: int, keys: bytes, counts: bytes, docs: bytes, places: bytes) -> None:
        if kind == 0:
            self.names, self.counts = _parted(keys), np.frombuffer(counts, np.int64)
        elif kind == 1:
            self.g, self.n = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
        else:
            keys = _parted(keys) if kind == 3 else np.frombuffer(keys, np.uint64)
            (self.words if kind == 3 else self.sequences).append((keys, np.frombuffer(docs, np.int64), np.frombuffer(places, np.int32)))
            self.waiting += len(places) // 4

    def answers(self) -> list[list[np.ndarray]]:
        """What the requests give to the documents that asked, if any."""
        asked, self.words, self.sequences, self.waiting = (self.words, self.sequences), [], [], 0
        if not any(asked):
            return []
        docs = np.concatenate([r[1] for rows in asked for r in rows])
        count, logs = np.zeros(0, np.int64), np.zeros(0)
        if asked[0]:
            at = np.asarray(pc.fill_null(pc.index_in(pa.concat_arrays([r[0] for r in asked[0]]), value_set=self.names), -1))
            found = np.append(self.counts, 0)[at]
            count = self._spread(found, asked[0])
        if asked[1]:
            self.tree = self.tree or Tree(_subtree(self.g, self.n), self.above)
            logs = self._spread(self.tree.score(np.concatenate([r[0] for r in asked[1]])), asked[1])
        ids, place = np.unique(docs, return_inverse=True)
        words, rest = place[: len(count)], place[len(count) :]
        known = np.bincount(words, weights=count > 0, minlength=len(ids)).astype(np.int64)
        sums = np.bincount(words, weights=np.log10(count + 1.0), minlength=len(ids))
        score = np.bincount(rest, weights=logs, minlength=len(ids))
        none = np.zeros(len(ids), np.int64)
        return [[ids, none, known, sums, score, none]]

    @staticmethod
    def _spread(values: np.ndarray, rows: list[tuple]) -> np.ndarray:
        """The value of the name at each place of the requests."""
        base = np.cumsum([0, *(len(r[0]) for r in rows)])
        return np.concatenate([values[b + r[2]] for b, r in zip(base, rows)])


def _answer(batches: Iterator[pa.RecordBatch], above, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """Passes on the documents' rows and adds what the requested words and sequences give. Rows come by bucket and shard, what was counted before its requests."""
    now, own, parts = (-1, _NONE), _Known(above.value), []
    for batch in batches:
        kinds = np.asarray(column(batch, "kind"))
        passed = batch.filter(pa.array(kinds == 2))
        if passed.num_rows:
            yield _parts(-1, buckets, *(column(passed, f.name).to_numpy() for f in _SUMS))
        rest = batch.filter(pa.array(kinds != 2))
        for *at, kind, keys, counts, docs, places in zip(*(column(rest, c).to_pylist() for c in ("bucket", "shard", "kind", "keys", "counts", "docs", "places"))):
            if tuple(at) != now or own.waiting >= most:
                parts += own.answers()
                if parts and (at[0] != now[0] or sum(len(p[0]) for p in parts) >= most):
                    yield _parts(now[0], buckets, *_merged(parts))
                    parts = []
                if tuple(at) != now:
                    now, own = tuple(at), _Known(above.value)
            own.take(kind, keys, counts, docs, places)
    parts += own.answers()
    if parts:
        yield _parts(now[0], buckets, *_merged(parts))


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """A row a document; sums are taken in the order of the parts."""
    ids, *values = (np.concatenate(c) for c in zip(*parts))
    ids, place = np.unique(ids, return_inverse=True)
    return [ids, *(np.bincount(place, weights=v, minlength=len(ids)).astype(v.dtype) for v in values)]


def _sums(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A row a document with the sums of its parts, which come by bucket and source."""
    now, parts, waiting = None, [], 0
    for batch in batches:
        for bucket, *row in zip(*(column(batch, c).to_pylist() for c in ("bucket", *_SUMS.names))):
            if bucket != now and parts:
                yield batch_of(_SUMS, *_merged(parts))
                parts, waiting = [], 0
            now = bucket
            parts.append([np.frombuffer(v, f.type.to_pandas_dtype()) for v, f in zip(row, _SUMS)])
            waiting += len(parts[-1][0])
            if waiting >= most:
                parts, waiting = [_merged(parts)], 0
    if parts:
        yield batch_of(_SUMS, *_merged(parts))


def context_tree_scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by a context tree and by unigrams, both learned where crc32(id as text) mod folds is not `held`.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens, base_score
    (log10 of add-one unigrams), score (log10 probability of the lower-cased bytes and the end under the tree) and
    bits_per_byte (code length over bytes and end mark). A null text is empty: one token, the end. Rows with a null
    id are dropped; rows that repeat an id are one document, of the smallest of their texts. An empty table gives no rows; with no training rows all estimates are uniform.
    Other columns are not read.
    """
    spark = docs.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    docs = one_row_an_id(docs)
    train = docs.where(crc_fold("id", folds) != held)
    packed = arrow_map(train.select("text"), partial(_count, buckets=width), "bucket int, kind int, keys binary, counts binary")
    counted = cut(arrow_map(packed.repartitionById(width, F.col("bucket")), partial(_total, head=max(1, HEAD // width)), "bucket int, kind int, keys binary, counts binary, size long, total long, head binary, head_counts binary"))
    ends = train.count()
    sized = {r.kind: r for r in counted.groupBy("kind").agg(F.sum("size").alias("size"), F.sum("total").alias("total")).collect()}
    size, total = (sized[0].size, sized[0].total) if 0 in sized else (0, 0)
    shards = width * -(-sized[1].size // (width * SHARD)) if 1 in sized else width
    tokens, distinct = total + ends, size + (ends > 0)
    head: dict[str, int] = {}
    for row in counted.where("kind = 0").select("head", "head_counts").toLocalIterator():  # HEAD words in all
        head.update(zip(row.head.decode().split("\n"), np.frombuffer(row.head_counts, np.int64).tolist()))
    sequences = counted.where("kind = 1").select("keys", "counts")
    above = spark.sparkContext.broadcast(top_tree(sequences, shards))
    frequent = spark.sparkContext.broadcast(kept_sequences(counted, LEAVES, [DEPTH])[0][0])
    keys, logs = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
    for row in arrow_map(sequences, partial(_held_logs, above=above, frequent=frequent, shards=shards), "keys binary, logs binary").toLocalIterator():  # LEAVES sequences in all
        keys.append(np.frombuffer(row.keys, np.uint64))
        logs.append(np.frombuffer(row.logs, np.float32))
    shared = spark.sparkContext.broadcast(Model(Held(np.concatenate(keys), np.concatenate(logs)), head))
    scored = arrow_map(docs, partial(_score, shared=shared, shards=shards, buckets=width), "bucket int, shard int, kind int, keys binary, counts binary, docs binary, places binary, id long, n_tokens long, known long, logs double, score double, n_bytes long")
    words = counted.where("kind = 0").select("bucket", F.lit(_NONE).alias("shard"), "kind", "keys", "counts")
    subtrees = arrow_map(sequences, partial(_split, shards=shards, buckets=width), "bucket int, shard int, kind int, keys binary, counts binary")
    asked = scored.unionByName(words.unionByName(subtrees), allowMissingColumns=True).repartitionById(width, F.col("bucket")).sortWithinPartitions("bucket", "shard", "kind")
    parts = arrow_map(asked, partial(_answer, above=above, buckets=width, most=ASKED), "bucket int, source int, id binary, n_tokens binary, known binary, logs binary, score binary, n_bytes binary")
    parts = parts.repartitionById(width, F.col("bucket")).sortWithinPartitions("bucket", "source")
    each = arrow_map(parts, partial(_sums, most=ASKED), "id long, n_tokens long, known long, logs double, score double, n_bytes long")
    end_log = float(np.log10(ends + 1))
    denominator = float(np.log10(tokens + distinct + 1))
    return each.select(
        F.col("id").alias("doc_id"),
        (crc_fold("id", folds) == held).alias("held_out"),
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end_log) - (F.col("n_tokens") + 1) * F.lit(denominator)).alias("base_score"),
        "score",
        (F.col("score") * F.lit(-float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
