"""Vector best-fit packing of tokenised documents into sequences of bounded tokens, documents and attention cost.

The attention cost of a piece is the square of its length in blocks of ATTENTION tokens, as attention inside documents is
computed. A piece that alone exceeds the cost capacity has a sequence for itself.

Pieces are dealt out evenly before they are packed, so that every task packs a sample of all lengths however the table
is stored. A piece goes to the open sequence in which it fits under all three capacities and leaves the smallest weighted
residual norm (or has the largest weighted dot product with the residual). All sequences that are not nearly full are
taken apart, dealt anew and packed again, until one window holds them or a round saves next to none of them.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, batch_of, column, cut, slices, split_words

#: Stands after each document's ids.
END_ID = 1
#: Pieces that are packed together in a task.
WINDOW = 20_000
#: Sequences under this share of their tokens are packed again, as long as a round saves this share of them.
FILLED, SAVED = 0.95, 0.01
#: The first round has a task for so many pieces, as far as there are cores.
DEALT = 1_000
#: Tokens of an attention block; cost is counted in squared blocks.
ATTENTION = 128
_CACHE_WORDS = 200_000


class WordCoder:
    """Ids of texts whose pre-tokenizer never joins across ASCII white space: each distinct word is encoded once.

    A word of plain letters with a full stop or comma is two pieces for the pre-tokenizer, so the letters are looked up
    alone. New words of plain letters are encoded together, as a text with blanks, and parted where a piece ends. The
    ids of up to 400,000 distinct words are held, then all are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parted = bool(self.ends.any())
        self.lowers = "Lowercase" in json.dumps(json.loads(self.coder.to_str()).get("normalizer"))
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(_CACHE_WORDS * 2, np.int64), np.zeros(_CACHE_WORDS * 2, np.int64)

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, slots = self.used, len(self.slot)
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if slots + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(max(len(x), len(words)), np.int64)]) for x in (self.start, self.size))
        self.flat[at : at + len(ids)] = ids
        self.start[slots : slots + len(words)] = at + np.cumsum(sizes) - sizes
        self.size[slots : slots + len(words)] = sizes
        self.slot.update(zip(words, range(slots, slots + len(words))))
        self.used = at + len(ids)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.parted and w.isalpha() and max(w) < "\u0180"]
        for lo in range(0, len(plain), 5000):
            some = plain[lo : lo + 5000]
            ids = np.array(self.coder.encode(" ".join(some), add_special_tokens=False).ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some) or len(ids) != last[-1] + 1:
                words = [*words, *some]  # not one piece a word: encoded alone below
                continue
            self._keep(some, ids, np.diff(last, prepend=-1))
        rest = [w for w in dict.fromkeys(words) if w not in self.slot]
        if rest:
            found = [e.ids for e in self.coder.encode_batch_fast(rest, add_special_tokens=False)]
            self._keep(rest, np.array([i for f in found for i in f], dtype=np.uint32), np.array([len(f) for f in found], dtype=np.int64))

    def slots_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words, and of the full stops and commas taken off them (0: none)."""
        if len(self.slot) > 2 * _CACHE_WORDS:
            self._forget()
        # a coder that lowers does so after composing, so only ASCII may be lowered before
        words = [w.lower() if w.isascii() else w for w in words] if self.lowers else words
        tail = [w[-1] if w[-1] in ".," and w[:-1].isalpha() and max(w) < "\u0180" else "" for w in words]
        head = [w[:-1] if t else w for w, t in zip(words, tail)]
        slot = self.slot
        self._learn([w for w in dict.fromkeys([*head, ".", ","]) if w not in slot])
        n = len(words)
        return np.fromiter(map(slot.__getitem__, head), np.int64, n), np.fromiter(map(slot.__getitem__, tail), np.int64, n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END_ID after each, and len(texts)+1 offsets."""
        words, first = split_words(texts)
        coded = words.dictionary_encode()
        known = len(coded.dictionary)
        head, tail = self.slots_of(coded.dictionary.to_pylist())
        pieces = np.column_stack([head, tail]).ravel()
        table = np.append(ragged(self.flat, self.start[pieces], self.size[pieces]), np.uint32(END_ID))
        sizes = np.append(self.size[head] + self.size[tail], 1)
        starts = np.cumsum(sizes) - sizes
        place = np.insert(np.asarray(coded.indices), first[1:], known)
        length = sizes[place]
        ids = ragged(table, starts[place], length)
        ends = np.concatenate([[0], np.cumsum(length)])
        return ids, ends[np.concatenate([[0], first[1:] + np.arange(1, len(first))])]


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i]:starts[i]+sizes[i]], one after another."""
    ends = np.cumsum(sizes)
    at = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def attention_cost(length: np.ndarray) -> np.ndarray:
    """Squared blocks of pieces."""
    return (-(-np.asarray(length) // ATTENTION)) ** 2


def best_fit(length: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its offset there; sequences are numbered from 0. Longest pieces first, ties by place.

    capacity: tokens, pieces and attention cost of a sequence; a piece over the cost capacity stands alone.

    rule "norm" takes the sequence of least weighted residual norm after placing, "dot" that of the largest weighted
    dot product of demand and residual. All amounts are shares of their capacity.
    """
    n = len(length)
    tokens, documents, cost = capacity
    costs = np.minimum(attention_cost(length), cost)
    order = np.argsort(-length, kind="stable")
    seq, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((3, n), np.float64)
    number = np.empty(n, np.int64)
    filled = np.empty(n, np.int64)
    open_, made, at = 0, 0, 0
    smallest, least = (int(length.min()), float(costs.min()) / cost) if n else (0, 0.0)
    weight = np.asarray(weights, np.float64)
    while at < n:
        k = order[at]
        at += 1
        size = int(length[k])
        demand = (size / tokens, 1 / documents, costs[k] / cost)
        spot = -1
        if open_ and size < tokens:
            t, d, c = left[0, :open_], left[1, :open_], left[2, :open_]
            fits = (t >= demand[0] - 1e-12) & (d >= demand[1] - 1e-12) & (c >= demand[2] - 1e-12)
            if rule == "norm":
                value = weight[0] * (t - demand[0]) ** 2 + weight[1] * (d - demand[1]) ** 2 + weight[2] * (c - demand[2]) ** 2
            else:
                value = -(weight[0] * t * demand[0] + weight[1] * d * demand[1] + weight[2] * c * demand[2])
            value = np.where(fits, value, np.inf)
            best = int(np.argmin(value))
            if value[best] < np.inf:
                spot = best
        if spot < 0:
            spot = open_
            open_ += 1
            left[:, spot] = 1.0
            number[spot], filled[spot] = made, 0
            made += 1
        seq[k], offset[k] = number[spot], filled[spot]
        left[:, spot] -= demand
        filled[spot] += size
        if filled[spot] + smallest > tokens or left[1, spot] < 1 / documents - 1e-12 or left[2, spot] < least - 1e-12:
            open_ -= 1
            left[:, spot], number[spot], filled[spot] = left[:, open_], number[open_], filled[open_]
    return seq, offset


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut_ids(batches: Iterator[pa.RecordBatch], path: str, tokens: int, with_ids: bool) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc, ids or None) arrays of a slice."""
    encode = coder(path).encode
    for batch, texts in slices(batches):
        doc = column(batch, "id")
        ids, first = encode(texts)
        size = np.diff(first)
        count = -(-size // tokens)
        row = np.repeat(np.arange(len(doc)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * tokens
        length = np.minimum(tokens, size[row] - start)
        low = first[:-1][row] + start
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(low.tolist(), length.tolist())), np.int64, len(row))
        yield doc.take(pa.array(row)), piece.astype(np.int32), start, length, crc, [ids[a : a + b] for a, b in zip(low, length)] if with_ids else None


def _tokens(batches: Iterator[pa.RecordBatch], path: str, tokens: int) -> Iterator[pa.RecordBatch]:
    schema = _SCHEMA.append(pa.field("ids", pa.list_(pa.int64())))
    for *columns, ids in _cut_ids(batches, path, tokens, True):
        yield batch_of(schema, *columns, pa.array([x.astype(np.int64) for x in ids], type=pa.list_(pa.int64())))


_PLACED = _SCHEMA.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64())).append(pa.field("handed", pa.bool_()))


def _place(held: list[tuple], base: int, capacity: tuple, weights: tuple, rule: str, last: bool) -> tuple[pa.RecordBatch, int]:
    docs, *columns = zip(*held)
    columns = [pa.concat_arrays(docs), *map(np.concatenate, columns)]  # ids may be null
    length = columns[3]
    seq, offset = best_fit(length, capacity, weights, rule)
    made = int(seq.max()) + 1
    fill = np.bincount(seq, weights=length, minlength=made)
    handed = np.zeros(made, bool)
    if not last:
        handed = fill < FILLED * capacity[0]
    return batch_of(_PLACED, *columns, base + seq, offset, handed[seq]), made


def _pack(slices_: Iterator[tuple], round_: int, capacity: tuple, weights: tuple, rule: str, last: bool) -> Iterator[pa.RecordBatch]:
    base = (round_ << 54) + (TaskContext.get().partitionId() << 32)
    held: list[tuple] = []
    for columns in slices_:
        held.append(columns)
        if sum(len(c[0]) for c in held) >= WINDOW:
            out, made = _place(held, base, capacity, weights, rule, last)
            yield out
            held, base = [], base + made
    if held:
        yield _place(held, base, capacity, weights, rule, last)[0]


def _first(batches: Iterator[pa.RecordBatch], path: str, tokens: int) -> Iterator[pa.RecordBatch]:
    for *columns, _ in _cut_ids(batches, path, tokens, False):
        yield batch_of(_SCHEMA, *columns)


def _again(batches: Iterator[pa.RecordBatch], round_: int, capacity: tuple, weights: tuple, rule: str, last: bool) -> Iterator[pa.RecordBatch]:
    rows = ((column(b, "doc_id"), *(np.asarray(column(b, f.name)) for f in list(_SCHEMA)[1:])) for b in batches if b.num_rows)
    return _pack(rows, round_, capacity, weights, rule, last)


_PLACED_SQL = f"{_PIECES}, sequence_id long, offset long, handed boolean"


def token_pieces(docs: DataFrame, path: str, tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the ids themselves, of each document's pieces. Same rules as pack()."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(docs, partial(_tokens, path=path, tokens=tokens), f"{_PIECES}, ids array<long>")


def pack(
    docs: DataFrame,
    path: str,
    tokens: int = 4096,
    documents: int = 4096,
    cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6),
    rule: str = "norm",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their sequence and offset there: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its word ids, then END_ID; only documents over `tokens` ids are cut, into pieces of `tokens` and a
    rest. A sequence holds `tokens` tokens, `documents` pieces and a cost of `cost` squared attention blocks at most (default: as
    many as one whole piece has and a block a piece, which binds no sequence that the first capacity allows); a piece
    over that cost stands alone. A null text is empty: one piece of END_ID. Equal documents are packed as often as they occur. Pieces
    of a null id have a null doc_id. An empty table gives no rows. Other columns are not read.
    """
    cost = int(attention_cost(np.array(tokens))) + documents if cost is None else cost
    if cost < 1 or tokens < 1 or documents < 1:
        raise ValueError("capacities are positive")
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    capacity = (tokens, documents, cost)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rest = cut(arrow_map(docs, partial(_first, path=path, tokens=tokens), _PIECES))
    done, before, round_ = None, None, 0
    pieces = rest.count()
    tasks = max(-(-pieces // WINDOW), min(docs.sparkSession.sparkContext.defaultParallelism, -(-pieces // DEALT)), 1)
    while True:
        dealt = rest.coalesce(1) if tasks == 1 else rest.repartition(tasks)
        placed = cut(arrow_map(dealt, partial(_again, round_=round_, capacity=capacity, weights=weights, rule=rule, last=tasks == 1), _PLACED_SQL))
        full = placed.where("not handed")
        made, kept, pieces = placed.select(F.count_distinct("sequence_id"), F.count_distinct(F.when(~F.col("handed"), F.col("sequence_id"))), F.count_if("handed")).first()
        if tasks == 1 or pieces == 0 or (before is not None and made > (1 - SAVED) * before):
            last = placed if before is None or made <= before else earlier
            return (last if done is None else done.unionByName(last)).drop("handed")
        done = full if done is None else done.unionByName(full)
        earlier, before = placed.where("handed"), made - kept
        rest = earlier.drop("sequence_id", "offset", "handed")
        tasks, round_ = -(-pieces // WINDOW), round_ + 1
