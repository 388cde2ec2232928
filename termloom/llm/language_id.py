"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a binary classifier on hashed byte trigrams tells the languages with a 1 from
those with a 0. Decoding gives the language whose codeword has the least logistic loss over the bits, each weighted by
how well its classifier does on that language in training; a runner-up that is nearly as close flags ambiguity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, batch_of, column, crc_fold, slices, text_bytes

#: Hash buckets of trigrams, as a power of two.
BITS = 15
#: Training rows of a language, at most in expectation; of them one in GRADING tells how far a bit is to be trusted, the others fit it.
SAMPLE, GRADING = 5_000, 4
#: Languages that are learned, those of the most rows.
MOST = 1_000
#: A document's mean log-odds times this is a bit's margin.
SHARPNESS = 5.0
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams centred on a letter byte (blanks stand around each text), and len(texts)+1 offsets."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    full = np.full(len(data) + 2 * n, 32, np.uint8)
    full[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))] = _LETTERS[data]
    middle = np.flatnonzero(full[1:-1] != 32) + 1
    code = full[middle - 1].astype(np.uint32) << 16 | full[middle].astype(np.uint32) << 8 | full[middle + 1]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(middle, offsets + 2 * np.arange(n + 1))


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of bits a language: all distinct splits up to 7 languages, else the best of 200 random codes."""
    if languages <= 7:
        splits = [s for s in range(1, 1 << max(languages - 1, 0))]
        return np.array([[s >> k & 1 for s in splits] for k in range(languages)], dtype=np.int8).reshape(languages, len(splits))
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(languages)))
    best, code = -1, np.zeros((languages, width), np.int8)
    for _ in range(200):
        draw = rng.integers(0, 2, (languages, width), dtype=np.int8)
        if (draw.min(axis=0) == draw.max(axis=0)).any():
            continue
        signed = 2.0 * draw - 1
        apart = (width - signed @ signed.T) / 2 + width * np.eye(languages)
        if apart.min() > best:
            best, code = apart.min(), draw
    return code


@dataclass
class Decoder:
    """Bounded by the number of languages times 2 ** BITS."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bit, bucket
    trust: np.ndarray  # language, bit

    def margins(self, texts: pa.Array) -> np.ndarray:
        buckets, first = trigrams(texts)
        count = np.diff(first)
        out = np.zeros((len(count), len(self.weights)))
        for b, w in enumerate(self.weights):
            total = np.concatenate([[0.0], np.cumsum(w[buckets], dtype=np.float64)])
            out[:, b] = SHARPNESS * (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1)
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        signed = 2.0 * self.code - 1
        return np.stack([(np.logaddexp(0, -signed[k] * margins) * self.trust[k]).sum(axis=1) for k in range(len(self.languages))], axis=1)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in a task."""
    total: dict[str, np.ndarray] = {}
    for batch, texts in slices(batches):
        buckets, first = trigrams(texts)
        langs = column(batch, "lang").dictionary_encode()
        owner = np.repeat(np.asarray(langs.indices).astype(np.int64), np.diff(first))
        grid = np.bincount(owner << BITS | buckets, minlength=len(langs.dictionary) << BITS).reshape(len(langs.dictionary), 1 << BITS)
        for lang, row in zip(langs.dictionary.to_pylist(), grid):
            total[lang] = total.get(lang, 0) + row
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    for lang, row in total.items():
        some = np.flatnonzero(row)
        yield batch_of(schema, [lang] * len(some), some.astype(np.int32), row[some])


def _grade(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """How many training texts of a language each bit's classifier gets right."""
    decoder: Decoder = shared.value
    place = {lang: k for k, lang in enumerate(decoder.languages)}
    right = np.zeros(decoder.code.shape, np.int64)
    seen = np.zeros(len(place), np.int64)
    for batch, texts in slices(batches):
        margins = decoder.margins(texts)
        row = np.array([place[x] for x in column(batch, "lang").to_pylist()])
        np.add.at(right, row, (margins > 0) == (decoder.code[row] > 0))
        seen += np.bincount(row, minlength=len(place))
    schema = pa.schema([("lang", pa.int32()), ("bit", pa.int32()), ("right", pa.int64()), ("seen", pa.int64())])
    k, b = np.meshgrid(np.arange(right.shape[0]), np.arange(right.shape[1]), indexing="ij")
    yield batch_of(schema, k.ravel().astype(np.int32), b.ravel().astype(np.int32), right.ravel(), np.repeat(seen, right.shape[1]))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Decoder | None:
    """labelled(id, text, lang), lang not null. Of a language with more rows than `sample`, a share by hash of the id; of more than
    MOST languages those of the most rows, ties by name. Bits are graded on rows that did not fit them."""
    spark = labelled.sparkSession
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, sample / n) * (1 << 30)))])
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")])
    grading = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(GRADING)) == 0
    tally = arrow_map(chosen.where(~grading).select("text", "lang"), _tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages times 2 ** BITS rows
    languages = sorted(counts)
    place = {lang: k for k, lang in enumerate(languages)}
    grid = np.full((len(languages), 1 << BITS), 0.5)
    grid[[place[x] for x in tally["lang"].to_pylist()], tally["bucket"].to_numpy()] += tally["n"].to_numpy()
    grid /= grid.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.array([np.log(grid[code[:, b] == 1].mean(axis=0)) - np.log(grid[code[:, b] == 0].mean(axis=0)) for b in range(code.shape[1])], dtype=np.float32).reshape(code.shape[1], 1 << BITS)
    decoder = Decoder(languages, code, weights, np.ones(code.shape))
    if code.shape[1]:
        grades = arrow_map(chosen.where(grading).select("text", "lang"), partial(_grade, shared=spark.sparkContext.broadcast(decoder)), "lang int, bit int, right long, seen long").groupBy("lang", "bit").agg(F.sum("right").alias("right"), F.sum("seen").alias("seen")).collect()
        for r in grades:
            decoder.trust[r.lang, r.bit] = (r.right + 1) / (r.seen + 2)
        decoder.trust /= decoder.trust.mean(axis=1, keepdims=True)
    return decoder


_FOUND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def _predict(batches: Iterator[pa.RecordBatch], shared, narrow: float) -> Iterator[pa.RecordBatch]:
    decoder: Decoder | None = shared.value
    for batch, texts in slices(batches):
        n = len(texts)
        letters = np.asarray(pc.match_substring_regex(texts, r"\pL"))
        best, score, close = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
        if decoder is not None:
            loss = decoder.losses(decoder.margins(texts))
            best = loss.argmin(axis=1)
            likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
            score = 1 / likely.sum(axis=1)
            order = np.sort(loss, axis=1)
            close = order[:, 1] - order[:, 0] < narrow if loss.shape[1] > 1 else np.zeros(n, bool)
        else:
            letters[:] = False
        names = np.array([*(decoder.languages if decoder else []), "und"], dtype=object)
        yield batch_of(_FOUND, column(batch, "id").to_numpy(), column(batch, "held_out"), pa.array(names[np.where(letters, best, len(names) - 1)], type=pa.string()), np.where(letters, score, 0.0), np.where(letters, close, False))


def languages(docs: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE, narrow: float = 1.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and ambiguous of every whole text.

    Learns from text and non-null lang of rows whose crc32(id as text) mod folds is not `held`, `sample` rows a language
    at most in expectation. Null texts and texts without a letter are "und" with score 0; so is every text if nothing can
    be learned. ambiguous: the runner-up's loss is less than `narrow` above the best. Rows with a null id are dropped. An
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null")
    docs = docs.withColumn("held_out", crc_fold("id", folds) == held)
    decoder = train(docs.where("not held_out and lang is not null").select("id", "text", "lang"), sample)
    return arrow_map(docs.select("id", "text", "held_out"), partial(_predict, shared=spark.sparkContext.broadcast(decoder), narrow=narrow), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
