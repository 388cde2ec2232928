"""Quality scores by a generalised additive model with pairwise interactions.

Shallow regression trees are boosted cyclically: each round gives every feature in turn a small tree on the gradient of
the log loss, added into that feature's lookup table over its bins. Then the pairs that explain most of the remaining
gradient get tables of their own in the same way. A score is the sum of table entries: bins are looked up and added.
Features are measures of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, batch_of, column, crc_fold, cut, mix, runs, slices, small, split_words, text_bytes

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "exclaim", "pipe", "punctuation", "high_bytes", "lines", "distinct", "commonest", "repeated_triples", "repeated_lines", "alphabetic_words", "long_words")
#: Labelled rows that a model is fitted on at most.
SAMPLE = 20_000
BINS, PAIR_BINS = 64, 12

_UPPER, _LOWER, _DIGIT, _SYMBOL, _EXCLAIM, _PIPE, _PUNCT, _HIGH, _LINE = range(9)
_KIND = np.full(256, 9, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:192], _KIND[192:] = _UPPER, _LOWER, _DIGIT, 10, _HIGH
_KIND[[ord(c) for c in "#*$%&<>"]] = _SYMBOL
_KIND[ord("!")], _KIND[ord("|")], _KIND[10] = _EXCLAIM, _PIPE, _LINE
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = _PUNCT


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty text gives zeros."""
    n = len(texts)
    data, offsets = text_bytes(texts)
    kind = _KIND[data]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    count = np.bincount(doc * 11 + kind, minlength=11 * n).reshape(n, 11).astype(np.float64)
    chars = np.maximum(count.sum(axis=1) - count[:, 10], 1)
    words, first = split_words(pc.ascii_lower(texts))
    tokens = np.diff(first)
    some = np.maximum(tokens, 1)
    owner = np.repeat(np.arange(n, dtype=np.int64), tokens)
    length = np.asarray(pc.utf8_length(words)).astype(np.float64)
    total = np.bincount(owner, weights=length, minlength=n)
    coded = words.dictionary_encode()
    place, size = np.asarray(coded.indices).astype(np.int64), max(len(coded.dictionary), 1)
    plain = np.asarray(pc.match_substring_regex(coded.dictionary, r"^\pL+[.,;:?]*$"))
    pairs, times = np.unique(owner * size + place, return_counts=True)
    distinct = np.bincount(pairs // size, minlength=n)
    commonest = np.zeros(n)
    np.maximum.at(commonest, pairs // size, times)
    triple = np.zeros(n)
    if len(place) >= 3:
        inner = owner[2:] == owner[:-2]
        key = mix(mix(mix(place[:-2].astype(np.uint64) + np.uint64(1)) + place[1:-1].astype(np.uint64)) + place[2:].astype(np.uint64))[inner]
        who = owner[2:][inner]
        key = np.sort(mix(key ^ mix(who.astype(np.uint64))) >> np.uint64(20) | (who.astype(np.uint64) << np.uint64(44)))
        at = runs(key)
        kinds = np.bincount((key[at] >> np.uint64(44)).astype(np.int64), minlength=n)
        triple = 1 - kinds / np.maximum(tokens - 2, 1)
        triple[tokens < 3] = 0
    lists = pc.split_pattern(texts, "\n")
    line_first = np.asarray(lists.offsets, dtype=np.int64)
    line_first = line_first - line_first[0]
    line = lists.flatten().dictionary_encode()
    line_doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(line_first))
    kinds = np.bincount(np.unique(line_doc * max(len(line.dictionary), 1) + np.asarray(line.indices)) // max(len(line.dictionary), 1), minlength=n)
    lines = np.maximum(np.diff(line_first), 1)
    out = np.column_stack(
        [
            np.log1p(tokens),
            total / some,
            count[:, _UPPER] / np.maximum(count[:, _UPPER] + count[:, _LOWER], 1),
            count[:, _DIGIT] / chars,
            count[:, _SYMBOL] / chars,
            count[:, _EXCLAIM] / chars,
            count[:, _PIPE] / some,
            count[:, _PUNCT] / some,
            count[:, _HIGH] / chars,
            count[:, _LINE] / some,
            distinct / some,
            commonest / some,
            triple,
            1 - kinds / lines,
            np.bincount(owner, weights=plain[place] if len(place) else None, minlength=n) / some,
            np.bincount(owner, weights=(length > 14).astype(float), minlength=n) / some,
        ]
    )
    out[tokens == 0] = 0
    return out


@dataclass
class Additive:
    """Bin edges and a table a feature, and tables of feature pairs over coarser bins; scores are logits until squashed."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, coarse: bool = False) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.coarse if coarse else self.edges)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        fine, out = self.bins(x), np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            out += t[fine[:, k]]
        if self.pairs:
            rough = self.bins(x, True)
            for (i, j), grid in zip(self.pairs, self.grids):
                out += grid[rough[:, i], rough[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -50, 50)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _newton(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, splits: int) -> np.ndarray:
    """Leaf values per bin of a tree that cuts an ordered axis `splits` times, best gain first."""
    leaves = [(0, len(g))]
    for _ in range(splits):
        best = (1e-9, None, None)
        for at, (lo, hi) in enumerate(leaves):
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            left_g, left_h = cg[:-1], ch[:-1]
            gain = left_g**2 / (left_h + 1) + (cg[-1] - left_g) ** 2 / (ch[-1] - left_h + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], at, lo + k + 1)
        if best[1] is None:
            break
        lo, hi = leaves.pop(best[1])
        leaves += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = _newton(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts a grid once along each axis (four leaves)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    q = [
        (cg, ch),
        (cg[:, -1:] - cg, ch[:, -1:] - ch),
        (cg[-1:, :] - cg, ch[-1:, :] - ch),
        (total_g - cg[:, -1:] - cg[-1:, :] + cg, total_h - ch[:, -1:] - ch[-1:, :] + ch),
    ]
    gain = sum(a**2 / (np.maximum(b, 0) + 1) for a, b in q) - total_g**2 / (total_h + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for (a, b), part in zip(q, ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[part] = _newton(a[i, j], max(b[i, j], 0.0))
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.15, splits: int = 3) -> Additive:
    """Fits the additive model; with one class only, every score is that class's smoothed share."""
    model = Additive([_edges(x[:, k], BINS) for k in range(x.shape[1])], [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])])
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    fine, rough = model.bins(x), model.bins(x, True)
    width = [len(e) + 1 for e in model.edges]
    coarse = [len(e) + 1 for e in model.coarse]
    model.tables = [np.zeros(w) for w in width]
    logit = np.full(len(y), model.base)
    for _ in range(rounds):
        for k in range(x.shape[1]):
            p = 1 / (1 + np.exp(-logit))
            g = np.bincount(fine[:, k], weights=y - p, minlength=width[k])
            h = np.bincount(fine[:, k], weights=p * (1 - p), minlength=width[k])
            step = rate * _tree(g, h, splits)
            model.tables[k] += step
            logit += step[fine[:, k]]
    p = 1 / (1 + np.exp(-logit))
    flat = {(i, j): rough[:, i] * coarse[j] + rough[:, j] for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])}

    def grid(pair: tuple[int, int], weights: np.ndarray) -> np.ndarray:
        i, j = pair
        return np.bincount(flat[pair], weights=weights, minlength=coarse[i] * coarse[j]).reshape(coarse[i], coarse[j])

    ranked = sorted(flat, key=lambda q: (-_cross(grid(q, y - p), grid(q, p * (1 - p)))[0], q))
    model.pairs = ranked[:pairs]
    model.grids = [np.zeros((coarse[i], coarse[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, pair in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-logit))
            step = rate * _cross(grid(pair, y - p), grid(pair, p * (1 - p)))[1]
            model.grids[k] += step
            logit += step.ravel()[flat[pair]]
    return model


_SAMPLED = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.float64()))])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        yield batch_of(_SAMPLED, column(batch, "label").to_numpy(), features(texts).tolist())


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        score = shared.value.score(features(texts))
        yield batch_of(_SCORED, column(batch, "id").to_numpy(), np.asarray(column(batch, "held_out").to_numpy(zero_copy_only=False), bool), score, (score >= threshold).astype(np.int32))


def train(docs: DataFrame, labels: DataFrame, folds: int, held: int, label_col: str, sample: int, id_col: str, text_col: str) -> Additive:
    """A model from labelled rows outside the held fold; of more than `sample` rows, those with the smallest hashes of their id."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(crc_fold("id", folds) != held).groupBy("id").agg(F.max("label").alias("label"))
    known = cut(known)
    rows = known.count()
    if rows > sample:
        share = sample / rows
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        rows = sample
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = arrow_map(docs.join(small(known, 16, rows), "id").select("label", "text"), _measure, "label int, features array<double>").toArrow()
    if not measured.num_rows:
        return Additive([np.zeros(0)] * len(FEATURES), [np.zeros(0)] * len(FEATURES), 0.0, [np.zeros(1)] * len(FEATURES))
    x = np.array(measured["features"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = measured["label"].to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order])


def quality_scores(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) of every text.

    The model learns from labels 0 and 1 of rows whose crc32(id as text) mod folds is not `held`, from `sample` rows at
    most in expectation; other labels are ignored, of repeated labels the largest counts. Null texts count as empty and
    are scored like any other. Rows with a null id are dropped. Without labelled rows every score is 0.5. An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, folds, held, label_col, sample, id_col, text_col))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    docs = docs.withColumn("held_out", crc_fold("id", folds) == held)
    return arrow_map(docs, partial(_score, shared=shared, threshold=threshold), "doc_id long, held_out boolean, score double, predicted int")


def _accept(batches: Iterator[pa.RecordBatch], shared, threshold: float, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, text_col):
        yield batch.filter(pa.array(shared.value.score(features(texts)) >= threshold))


def accepted(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs, all columns, whose score is threshold or more; rows with a null id or text are scored like others."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held, label_col, sample, id_col, text_col))
    return arrow_map(docs, partial(_accept, shared=shared, threshold=threshold, text_col=text_col), docs.schema)
