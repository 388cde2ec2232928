"""Quality rules as a short-circuit cascade, ordered by rejections per second as measured on a sample.

Every rule looks at the texts that all rules before it passed. Their order is set for the corpus at hand: each rule runs
on a sample of documents, which gives its cost a text and which texts it rejects; the next rule is always the one that
rejects most of what the rules before it leave, by cost. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, batch_of, column, runs, segment_sum, slices, split_words, text_bytes

#: Documents that costs and selectivities are measured on, at most in expectation.
SAMPLE = 2_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_letter_words", "n_lines", "n_dup_lines", "n_repeat_words")


class Texts:
    """Measures of some texts, made when a rule first asks for them."""

    def __init__(self, texts: pa.Array):
        self.texts, self.n = texts, len(texts)

    def only(self, rows: np.ndarray) -> Texts:
        """Some of the texts. What was measured or split before is cut, not made again."""
        out, done = Texts(self.texts.take(pa.array(rows))), self.__dict__
        for name in MEASURES:
            if name in done:
                out.__dict__[name] = done[name][rows]
        if "_words" in done:
            flat, first = self._words
            n = np.diff(first)[rows]
            ends = np.cumsum(n)
            at = pa.array(np.repeat(first[:-1][rows] - ends + n, n) + np.arange(n.sum()))
            out.__dict__["_words"] = flat.take(at), np.concatenate([[0], ends])
            if "_coded" in done:
                out.__dict__["_coded"] = pa.DictionaryArray.from_arrays(self._coded.indices.take(at), self._coded.dictionary)
        return out

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return text_bytes(self.texts)

    @cached_property
    def _words(self) -> tuple[pa.Array, np.ndarray]:
        return split_words(self.texts)

    @cached_property
    def _coded(self) -> pa.DictionaryArray:
        return self._words[0].dictionary_encode()

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[1])

    @cached_property
    def word_chars(self) -> np.ndarray:
        length = np.asarray(pc.utf8_length(self._coded.dictionary)).astype(np.int64)
        return segment_sum(length[np.asarray(self._coded.indices)], self._words[1])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        data, offsets = self._bytes
        return segment_sum(_SYMBOL[data].astype(np.int64), offsets)

    @cached_property
    def n_exclaims(self) -> np.ndarray:
        data, offsets = self._bytes
        return segment_sum((data == ord("!")).astype(np.int64), offsets)

    @cached_property
    def n_letter_words(self) -> np.ndarray:
        """Words with a letter A-Z, a-z or a code point of 128 or more."""
        data, offsets = text_bytes(self._coded.dictionary)
        lettered = segment_sum(_LETTER[data].astype(np.int64), offsets) > 0
        return segment_sum(lettered[np.asarray(self._coded.indices)].astype(np.int64), self._words[1])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(self.texts, "\n")
        first = np.asarray(lists.offsets, dtype=np.int64)
        first = first - first[0]
        coded = lists.flatten().dictionary_encode()
        worded = np.diff(split_words(coded.dictionary)[1]) > 0
        return np.asarray(coded.indices).astype(np.int64), first, worded

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        place, first, worded = self._lines
        return segment_sum(worded[place].astype(np.int64), first) if len(place) else np.zeros(self.n, np.int64)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        place, first, worded = self._lines
        size = max(len(worded), 1)
        owner = np.repeat(np.arange(self.n), np.diff(first))
        kinds = np.unique(owner * size + place)
        kinds = kinds[worded[kinds % size]] if len(kinds) else kinds
        return self.n_lines - np.bincount(kinds // size, minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside 3-word windows that a text holds twice or more; windows are compared exactly."""
        place, first = np.asarray(self._coded.indices).astype(np.int64), self._words[1]
        m = len(place)
        if m < 3:
            return np.zeros(self.n, np.int64)
        owner = np.repeat(np.arange(self.n), np.diff(first))
        start = np.flatnonzero(owner[2:] == owner[:-2])
        size = len(self._coded.dictionary)
        _, pair = np.unique(place[start] * size + place[start + 1], return_inverse=True)
        _, triple = np.unique(pair * size + place[start + 2], return_inverse=True)
        key = triple * self.n + owner[start]
        order = np.argsort(key)
        at = runs(key[order])
        count = np.empty(len(key), np.int64)
        count[order] = np.repeat(np.diff(np.append(at, len(key))), np.diff(np.append(at, len(key))))
        twice = start[count > 1]
        covered = np.zeros(m, bool)
        for k in range(3):
            covered[twice + k] = True
        return segment_sum(covered.astype(np.int64), first)


@dataclass(frozen=True)
class Rule:
    """rejects(texts) tells for each text whether the rule rejects it."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _few_words(t: Texts) -> np.ndarray:
    return t.n_words < 50


def _repeats(t: Texts) -> np.ndarray:
    return 100 * t.n_repeat_words > 50 * t.n_words


def _word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)


def _symbols(t: Texts) -> np.ndarray:
    return 10 * t.n_symbols > 4 * t.n_words


def _exclaims(t: Texts) -> np.ndarray:
    return 10 * t.n_exclaims > 5 * t.n_words


def _letters(t: Texts) -> np.ndarray:
    return 10 * t.n_letter_words < 4 * t.n_words


def _dup_lines(t: Texts) -> np.ndarray:
    return 10 * t.n_dup_lines > 5 * t.n_lines


BASE = (Rule("few_words", _few_words), Rule("repeats", _repeats))
RULES = (Rule("word_length", _word_length), Rule("symbols", _symbols), Rule("exclaims", _exclaims), Rule("letters", _letters), Rule("dup_lines", _dup_lines))


def run_cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Texts that every rule passes; a rule sees only those that all before it passed."""
    out, alive = np.zeros(texts.n, bool), np.arange(texts.n)
    for rule in rules:
        if not len(alive):
            break
        stay = np.flatnonzero(~rule.rejects(texts))
        if len(stay) < texts.n:
            alive, texts = alive[stay], texts.only(stay)
    out[alive] = True
    return out


def _probe(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], base: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """kind 0: texts by the set of rules that reject them (bits); kind 1: a rule's seconds over so many texts, measured on its own."""
    schema = pa.schema([("kind", pa.int32()), ("what", pa.int64()), ("texts", pa.int64()), ("seconds", pa.float64())])
    for _, texts in slices(batches):
        if base:
            texts = texts.filter(pa.array(run_cascade(Texts(texts), base)))
        sets = np.zeros(len(texts), np.int64)
        for k, rule in enumerate(rules):
            began = time.thread_time()
            sets |= rule.rejects(Texts(texts)).astype(np.int64) << k
            yield batch_of(schema, [1], [k], [len(texts)], [time.thread_time() - began])
        values, n = np.unique(sets, return_counts=True)
        yield batch_of(schema, np.zeros(len(values), np.int32), values, n, np.zeros(len(values)))


def ordered(docs: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE, base: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """Rules in cascade order, by about `sample` documents(id, text) of which those that a base rule rejects are left out.

    Each place goes to the rule of most rejections, among texts that no rule before it rejects, per second a text; ties to the
    first given.
    """
    rows = docs.count()
    if not rows:
        return rules
    some = docs.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, sample / rows) * (1 << 30)))
    seen = arrow_map(some.select("text"), partial(_probe, rules=rules, base=base), "kind int, what long, texts long, seconds double").groupBy("kind", "what").agg(F.sum("texts").alias("texts"), F.sum("seconds").alias("seconds")).collect()  # a row a rule and a set of rules
    cost = {r.what: r.seconds / max(r.texts, 1) for r in seen if r.kind == 1}
    sets = {r.what: r.texts for r in seen if r.kind == 0}
    left, out = list(range(len(rules))), []
    while left:
        rate = {k: sum(n for s, n in sets.items() if s >> k & 1) / max(cost.get(k, 0.0), 1e-12) for k in left}
        best = min(left, key=lambda k: (-rate[k], k))
        out.append(rules[best])
        left.remove(best)
        sets = {s: n for s, n in sets.items() if not s >> best & 1}
    return tuple(out)


_JUDGED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def _judge(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        t = Texts(texts)
        failed = _few_words(t) | _repeats(t)
        measured = t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words  # asked for of every text
        kept = np.zeros(len(texts), bool)
        rest = np.flatnonzero(~failed)
        kept[rest] = run_cascade(t.only(rest), rules)
        yield batch_of(_JUDGED, column(batch, "id").to_numpy(), *measured, failed, kept)


def _filter(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.bool_())])
    for batch, texts in slices(batches):
        yield batch_of(schema, column(batch, "id").to_numpy(), run_cascade(Texts(texts), rules))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and kept: whether a document passes all rules. Only what the cascade needs is measured.

    A null text has no words. Rows with a null id are dropped; an empty table gives no rows. Other columns are not read.
    """
    docs = _documents(docs, id_col, text_col)
    return arrow_map(docs, partial(_filter, rules=ordered(docs, rules, sample)), "doc_id long, kept boolean")


def measured_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every document.

    base_failed: under 50 words, or more than half of them in repeated 3-word windows; such documents skip the cascade
    and are not kept. The other cases are as in verdicts().
    """
    docs = _documents(docs, id_col, text_col)
    return arrow_map(docs, partial(_judge, rules=ordered(docs, rules, sample, BASE)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ws AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, text FROM d
),
base AS (
  SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words
  FROM ws
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
flat AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM ws
),
tri AS (
  SELECT doc_id, pos, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
  FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
twice AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL
  ) WHERE n > 1
),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, pos AS p FROM twice UNION ALL SELECT doc_id, pos + 1 FROM twice UNION ALL SELECT doc_id, pos + 2 FROM twice)
  GROUP BY doc_id
),
m AS (
  SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words, b.n_exclaims, b.n_letter_words, coalesce(l.n_lines, 0) AS n_lines
  FROM base b LEFT JOIN lines l USING (doc_id) LEFT JOIN rep r USING (doc_id)
),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= 4 * n_words
    AND 10 * n_exclaims <= 5 * n_words AND 10 * n_letter_words >= 4 * n_words AND 10 * n_dup_lines <= 5 * n_lines AS kept
FROM j
"""
