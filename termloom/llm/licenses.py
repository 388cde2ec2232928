"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased. Phrases are found among the words; the tag is found in the
text itself, and the rest of its line is an expression of licence identifiers with AND, OR, WITH and parentheses.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, batch_of, column, plain_text, slices, split_words

# Phrases that the base counts, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further phrases of notices, and their labels.
NOTICES = {
    "apache license version 2 0": "apache-2.0", "apache 2 0 license": "apache-2.0", "licensed under the apache license": "apache", "apache software license": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "released under mit": "mit", "licensed under mit": "mit", "the mit licence": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc", "isc license": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd", "bsd license": "bsd", "bsd style license": "bsd",
    "bsd 2 clause license": "bsd-2-clause", "2 clause bsd license": "bsd-2-clause", "simplified bsd license": "bsd-2-clause", "bsd 3 clause license": "bsd-3-clause", "3 clause bsd license": "bsd-3-clause", "new bsd license": "bsd-3-clause",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd-3-clause",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0", "general public license v2": "gpl-2.0", "general public license v3": "gpl-3.0",
    "gnu gpl": "gpl", "gpl v2": "gpl-2.0", "gplv2": "gpl-2.0", "gpl version 2": "gpl-2.0", "gpl v3": "gpl-3.0", "gplv3": "gpl-3.0", "gpl version 3": "gpl-3.0",
    "lesser general public license": "lgpl", "library general public license": "lgpl", "gnu lgpl": "lgpl", "lgpl v2 1": "lgpl-2.1", "lgplv2 1": "lgpl-2.1", "lgpl v3": "lgpl-3.0", "lgplv3": "lgpl-3.0",
    "affero general public license": "agpl", "gnu agpl": "agpl", "agpl v3": "agpl-3.0", "agplv3": "agpl-3.0", "affero gpl": "agpl",
    "mozilla public license": "mpl", "mozilla public license version 2 0": "mpl-2.0", "mpl 2 0": "mpl-2.0", "eclipse public license": "epl", "eclipse public license version 2 0": "epl-2.0",
    "boost software license": "bsl", "zlib license": "zlib", "the unlicense": "unlicense", "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain", "dedicated to the public domain": "public-domain", "in the public domain": "public-domain", "public domain dedication": "public-domain",
    "cc0 1 0": "cc0-1.0", "creative commons zero": "cc0-1.0", "cc0 universal": "cc0-1.0",
    "creative commons attribution license": "cc-by", "creative commons attribution 4 0": "cc-by-4.0", "creative commons attribution 3 0": "cc-by-3.0", "cc by 4 0": "cc-by-4.0", "cc by 3 0": "cc-by-3.0",
    "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa", "cc by sa 4 0": "cc-by-sa-4.0", "cc by sa 3 0": "cc-by-sa-3.0", "cc by sa": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "cc by nc 4 0": "cc-by-nc-4.0", "cc by nc": "cc-by-nc", "cc by nc sa 4 0": "cc-by-nc-sa-4.0", "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "creative commons attribution noderivatives": "cc-by-nd", "creative commons attribution no derivatives": "cc-by-nd", "cc by nd 4 0": "cc-by-nd-4.0", "cc by nd": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx-license-identifier:"
# How freely text under a label may be used, by the label's first letters; the longest that fits counts.
FREEDOM = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "zlib": 1.0, "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "all-rights-reserved": 0.0}
UNKNOWN = 0.1
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+\-:]*")


def freedom(label: str) -> float:
    fits = [k for k in FREEDOM if label.startswith(k)]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: WITH binds closest, then AND, then OR; None if parentheses or operands don't match."""
    out, stack, operand = [], [], True  # operand: one is due next
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


@lru_cache(maxsize=4096)
def expression(line: str) -> tuple[tuple[str, ...], float]:
    """Identifiers of a licence expression and its freedom: OR lets choose the freest part, AND binds to the strictest,
    WITH names an exception, which is no label and lifts a licence under one half to that. Tokens are read up to the
    longest start that parses; without one there are no labels."""
    tokens = _TOKEN.findall(line)
    for end in range(len(tokens), 0, -1):
        postfix = to_postfix(tokens[:end])
        if postfix is not None:
            break
    else:
        return (), 0.0
    stack: list[tuple[frozenset, float]] = []
    for t in postfix:
        if t not in _RANK:
            stack.append((frozenset([t]), freedom(t)))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            stack.append((left[0], max(left[1], 0.5)))
        else:
            stack.append((left[0] | right[0], (max if t == "or" else min)(left[1], right[1])))
    return tuple(sorted(stack[0][0])), stack[0][1]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**BASE, **NOTICES}.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def tags() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word(TAG, len(TAG))
    found.make_automaton()
    return found


def scan_words(words: list[str]) -> tuple[list[int], set[str], set[str]]:
    """Word places of base phrases, base labels and all labels."""
    text = " " + " ".join(words) + " "
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    places, base, labels = [], set(), set()
    for end, (size, label, basic) in automaton().iter(text):
        labels.add(label)
        if basic:
            places.append(bisect_right(starts, end - size + 1) - 1)
            base.add(label)
    return places, base, labels


def scan_tags(text: str) -> list[tuple[tuple[str, ...], float]]:
    """Labels and freedom of each tag's expression."""
    low = text.lower()
    return [expression(low[end + 1 :].split("\n", 1)[0]) for end, _ in tags().iter(low)]


@lru_cache(maxsize=1)
def openings() -> tuple[dict[str, int], np.ndarray]:
    """The first two words of each phrase as numbers, and the sorted pairs of them that begin a phrase."""
    number: dict[str, int] = {}
    pairs = []
    for phrase in {**BASE, **NOTICES}:
        a, b, *_ = [*phrase.split(), ""]
        pairs.append((number.setdefault(a, len(number) + 1) << 20) | (number.setdefault(b, len(number) + 1) if b else 0))
    return number, np.unique(np.array(pairs, np.int64))


def candidates(words: pa.Array, first: np.ndarray, tagged: np.ndarray) -> list[int]:
    """Texts that have a tag or the first two words of a phrase (its only word): all others hold no phrase."""
    number, pairs = openings()
    if not len(words):
        return np.flatnonzero(tagged).tolist()
    coded = words.dictionary_encode()
    names = list(number)
    at = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=pa.array(names, type=pa.large_string())), -1)).astype(np.int64)
    known = np.array([number[w] for w in names] + [0], np.int64)[at][np.asarray(coded.indices)]
    begin = np.flatnonzero(known)
    after = np.append(known, 0)[begin + 1]
    opens = np.isin(known[begin] << 20 | after, pairs) | np.isin(known[begin] << 20, pairs)
    hit = np.zeros(len(first) - 1, bool)
    hit[np.searchsorted(first, begin[opens], side="right") - 1] = True
    return np.flatnonzero(hit | tagged).tolist()


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        words, first = split_words(plain_text(texts))
        n = len(texts)
        tagged = np.asarray(pc.match_substring(texts, TAG, ignore_case=True))
        count, low, high = np.zeros(n, np.int64), [None] * n, [None] * n
        base_labels, labels, score = [""] * n, [""] * n, np.zeros(n)
        for d in candidates(words, first, tagged):
            places, base, all_ = scan_words(words.slice(first[d], first[d + 1] - first[d]).to_pylist())
            free = [freedom(x) for x in all_]
            if tagged[d]:
                for found, value in scan_tags(texts[d].as_py()):
                    if found:
                        all_ |= set(found)
                        free.append(value)
            if places:
                count[d], low[d], high[d] = len(places), min(places), max(places)
            base_labels[d], labels[d] = ",".join(sorted(base)), ",".join(sorted(all_))
            score[d] = min(free, default=0.0)
        yield batch_of(_FOUND, column(batch, "id").to_numpy(), np.diff(first), count, low, high, base_labels, labels, score)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every whole text.

    n_base counts places of base phrases, first_word and last_word are the smallest and largest of them (words from 0,
    null without any); labels add those of other phrases and of tagged expressions. Labels are distinct, sorted and
    joined by commas, empty if there are none. score is how freely the text may be used: the strictest of its phrases and
    expressions, 0 without any. A null text is empty. Rows with a null id are dropped; an empty table gives no rows.
    Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return arrow_map(docs, _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
