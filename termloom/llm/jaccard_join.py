"""N-gram Jaccard join by PartEnum signatures, with exact verification inside candidate clusters.

A document is the set of its distinct n-word shingles. Set sizes are cut into bands, band i being [l, l / similarity].
For sets of two neighbouring bands that reach the similarity the Hamming distance is at most k. Every pair of neighbouring
bands hashes the feature domain into n1 = k + 1 + m partitions, m half of k + 1, and the subsets enumerated are single
partitions: sets within distance k agree in m + 1 partitions at least. A set signs with its k + 1 most telling partitions
only. Of the m + 1 that two such sets share, the most telling one stands above m others in both, so both sign with it.
A partition tells as much as it holds shingles that are not among the most frequent; partitions without any, which
unrelated sets share, are so left out. Documents that share signatures form candidate clusters; each cluster is verified
exactly, block against block, and only links that reach the similarity count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ODD, arrow_map, batch_of, column, cut, hash_words, mix, one_row_an_id, runs, shuffled, sifted, slices, split_words
from termloom.llm.components import components, forest

#: Documents, and shingles, of a cluster that are compared as one block at most; clusters of less are dealt out in blocks of FEW or more.
BLOCK, HELD, FEW = 1024, 4_000_000, 256
#: Shingles in the columns of one product.
WIDTH = 4096
#: Buckets of signatures that a task meets one after another.
BUCKETS = 8
#: Frequent shingles that every task knows.
COMMON = 1 << 16


def shingle_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted inside a text, and len(texts)+1 offsets.

    Texts with fewer than n words give their whole word sequence as one shingle; texts without words give none.
    """
    words, first = split_words(pc.ascii_lower(texts))
    count = np.diff(first)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    coded = words.dictionary_encode()
    h = hash_words(coded.dictionary)[np.asarray(coded.indices)]
    sizes = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    at = np.arange(starts[-1]) - starts[doc] + first[:-1][doc]
    length = np.minimum(count, n)[doc]
    x = length.astype(np.uint64) * ODD
    for k in range(n):
        here = h[np.minimum(at + k, len(h) - 1)]
        x = np.where(k < length, mix(x ^ here), x)
    by_hash = np.argsort(x)
    kind = np.uint16 if len(texts) <= 65535 else np.int32
    order = by_hash[np.argsort(doc[by_hash].astype(kind), kind="stable")]
    x, doc = x[order], doc[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    return x, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Upper ends of the size bands up to one beyond that of the largest size."""
    ends, low = [], 1
    while not ends or len(ends) < 2 or ends[-2] < largest:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return np.array(ends, dtype=np.int64)


def signatures(x: np.ndarray, first: np.ndarray, num: int, den: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of the sets x[first[i]:first[i+1]] and the set of each; common: sorted shingles that tell little."""
    size = np.diff(first)
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = bands(int(size.max()), num, den)
    band = np.searchsorted(ends, size[full], side="left")
    owner = np.repeat(np.arange(len(full)), size[full])
    telling = np.ones(len(x), bool)
    if len(common):
        telling = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] != x
    out, sets = [], []
    for instance in (band, band + 1):
        need = (den - num) * 2 * ends[instance] // (den + num) + 1
        parts = need + need // 2
        base = np.concatenate([[0], np.cumsum(parts)])
        seed = mix(instance.astype(np.uint64) * ODD + np.uint64(1))
        cell = base[owner] + (mix(x ^ seed[owner]) % parts.astype(np.uint64)[owner]).astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, cell, mix(x + ODD))
        row = np.repeat(np.arange(len(full)), parts)
        place = np.arange(len(row)) - base[row]
        sig = mix(sums + mix(seed[row] + place.astype(np.uint64) * ODD))
        weight = np.bincount(cell, weights=telling, minlength=base[-1]) * 4096 + (mix(sig) >> np.uint64(52)).astype(np.float64)
        order = np.lexsort((-weight, row))
        best = order[np.arange(len(order)) - base[row[order]] < need[row[order]]]
        out.append(sig[best])
        sets.append(full[row[best]])
    return np.concatenate(out), np.concatenate(sets)


_SEEN = pa.schema([("shingle", pa.int64()), ("sets", pa.int64())])


def _frequent(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Shingles that three texts of a slice or more hold."""
    for _, texts in slices(batches):
        values, count = np.unique(shingle_hashes(texts, n)[0], return_counts=True)
        often = count > 2
        yield batch_of(_SEEN, values[often].view(np.int64), count[often])


def common_shingles(docs: DataFrame, n: int, most: int = COMMON) -> np.ndarray:
    """The `most` most frequent shingles of docs(text) among those that repeat within a task's slices, sorted."""
    seen = arrow_map(docs.select("text"), partial(_frequent, n=n), "shingle long, sets long").groupBy("shingle").agg(F.sum("sets").alias("sets"))
    return np.sort(np.array(seen.orderBy(F.desc("sets"), "shingle").limit(most).select("shingle").toArrow()["shingle"].to_numpy(), dtype=np.int64).view(np.uint64))


_SIGNED = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("more", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _grouped(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by signature, run starts, and for each row in that order the smallest id of its run."""
    order = np.argsort(sig)
    at = runs(sig[order])
    least = np.minimum.reduceat(ids[order], at) if len(at) else ids[:0]
    return order, at, np.repeat(least, np.diff(np.append(at, len(sig))))


def _sign(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, buckets: int, common) -> Iterator[pa.RecordBatch]:
    """Packed rows: a document's set hash, size and second hash, and one row a bucket of signatures with ids.

    Equal sets of a slice sign once. Signatures that several sets of a slice share go out once, with the smallest id;
    the link to it travels as two rows under a signature of its own, so that no shared signature gathers many rows.
    """
    for batch, texts in slices(batches):
        ids = column(batch, "id").to_numpy()
        x, first = shingle_hashes(texts, n)
        size = np.diff(first)
        h1, h2 = (np.concatenate([[np.uint64(0)], np.cumsum(mix(x * np.uint64(m)), dtype=np.uint64)]) for m in (3, 5))
        h1, h2 = mix(h1[first[1:]] - h1[first[:-1]]), h2[first[1:]] - h2[first[:-1]]
        _, unique = np.unique(h1, return_index=True)
        unique = np.sort(unique[size[unique] > 0])
        keep = np.zeros(len(size), bool)
        keep[unique] = True
        sig, owner = signatures(x[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[unique])]), num, den, common.value)
        owner = ids[unique][owner]
        order, at, pivot = _grouped(sig, owner)
        sig, owner = sig[order], owner[order]
        apart = owner != pivot
        a, b = forest(owner[apart], pivot[apart])
        own = mix(mix(a.astype(np.uint64) + ODD) ^ b.astype(np.uint64))
        sig, owner = np.concatenate([sig[at], own, own]), np.concatenate([pivot[at], a, b])
        for s, i, extra in ((sig, owner, None), (h1, ids, (size, h2))):
            bucket = (s % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            s, i, bucket = s[by], i[by], bucket[by]
            cuts = runs(bucket)
            ends = np.append(cuts[1:], len(bucket))
            more = [e[by] for e in extra] if extra else None
            yield batch_of(
                _SIGNED,
                bucket[cuts],
                [s[lo:hi].tobytes() for lo, hi in zip(cuts, ends)],
                [i[lo:hi].tobytes() for lo, hi in zip(cuts, ends)],
                [more[0][lo:hi].tobytes() if more else None for lo, hi in zip(cuts, ends)],
                [more[1][lo:hi].tobytes() if more else None for lo, hi in zip(cuts, ends)],
            )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: candidate links, folded; kind 1: a document and the smallest one with the same set; kind 2: sizes.

    Rows come sorted by bucket; one bucket is held at a time. Buckets outnumber a document's signatures, so that its links
    are about as many as its shared signatures, however many tasks there are.
    """
    kept: dict[bool, list] = {False: [], True: []}
    now = None
    for batch in batches:
        for bucket, sigs, ids, sizes, more in zip(*(column(batch, c).to_pylist() for c in ("bucket", "sigs", "ids", "sizes", "more"))):
            if bucket != now and now is not None:
                yield from _met(kept)
                kept = {False: [], True: []}
            now = bucket
            row = [np.frombuffer(sigs, np.uint64), np.frombuffer(ids, np.int64)]
            if sizes is not None:
                row += [np.frombuffer(sizes, np.int64), np.frombuffer(more, np.uint64)]
            kept[sizes is not None].append(row)
    yield from _met(kept)


def _met(kept: dict[bool, list]) -> Iterator[pa.RecordBatch]:
    if kept[False]:
        sig, ids = (np.concatenate(c) for c in zip(*kept.pop(False)))
        order, _, pivot = _grouped(sig, ids)
        ids = ids[order]
        apart = ids != pivot
        a, b = forest(ids[apart], pivot[apart])
        yield batch_of(_FOUND, np.zeros(len(a), np.int32), a, b, np.zeros(len(a), np.int64))
    if kept[True]:
        h1, ids, size, h2 = (np.concatenate(c) for c in zip(*kept.pop(True)))
        yield batch_of(_FOUND, np.full(len(ids), 2, np.int32), ids, ids, size)
        full = size > 0
        h1, ids, size, h2 = h1[full], ids[full], size[full], h2[full]
        order = np.lexsort((ids, size, h2, h1))
        h1, ids, size, h2 = h1[order], ids[order], size[order], h2[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (size[1:] != size[:-1])
        lead = ids[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(ids) else ids
        again = lead != ids
        yield batch_of(_FOUND, np.ones(again.sum(), np.int32), ids[again], lead[again], np.zeros(again.sum(), np.int64))


_BLOCKS = pa.schema([("cluster", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("block", pa.int64()), ("id", pa.int64()), ("copies", pa.int64()), ("shingles", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _deal(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Each member's shingles, once for every pair of blocks that its block takes part in."""
    for batch, texts in slices(batches):
        x, first = shingle_hashes(texts, n)
        ids, cluster, blocks, copies = (column(batch, c).to_numpy() for c in ("id", "cluster", "blocks", "copies"))
        block = (mix(ids.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), blocks)
        other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        packed = [x[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:])]
        for lo in range(0, len(row), 2000):
            r, o = row[lo : lo + 2000], other[lo : lo + 2000]
            yield batch_of(_BLOCKS, cluster[r], np.minimum(block[r], o), np.maximum(block[r], o), block[r], ids[r], copies[r], [packed[k] for k in r])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 columns of the shingles that two sets or more have."""
    m = len(sets)
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(m), [len(s) for s in sets])[shared[place]]
    place = rank[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((m, m), np.float32)
    for lo in range(0, int(shared.sum()), WIDTH):
        a, b = np.searchsorted(place, (lo, lo + WIDTH))
        grid = np.zeros((m, WIDTH), np.float32)
        grid[owner[a:b], place[a:b] - lo] = 1
        total += grid @ grid.T
    return total


def _verify_group(rows: list[tuple], num: int, den: int) -> pa.RecordBatch:
    i, j = rows[0][1], rows[0][2]
    block, ids, copies = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4, 5))
    sets = [np.frombuffer(r[6], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = overlaps(sets).astype(np.float64)
    linked = den * both >= num * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= block[:, None] != block[None, :]
    degree = (linked * copies[None, :]).sum(axis=1)
    a, b = np.nonzero(np.triu(linked))
    a, b = forest(ids[a], ids[b])
    some = degree > 0
    return batch_of(
        _LINKS,
        np.concatenate([a, ids[some]]),
        pa.array(np.concatenate([b, np.zeros(some.sum(), np.int64)]), mask=np.arange(len(a) + some.sum()) >= len(a)),
        np.concatenate([np.zeros(len(a), np.int64), degree[some]]),
    )


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cluster, i, j); a group holds two blocks at most."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(column(batch, f.name).to_pylist() for f in _BLOCKS)):
            if held and row[:3] != held[0][:3]:
                if len(held) > 1:
                    yield _verify_group(held, num, den)
                held = []
            held.append(row)
    if len(held) > 1:
        yield _verify_group(held, num, den)


def shingle_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components and links of documents whose shingle sets have a Jaccard similarity of num/den or more.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; a set holds the distinct n-word shingles, or the
    whole sequence where there are fewer words. Returns one row an id: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links, itself included), n_links (documents that it links with). Null and wordless texts have an
    empty set and no link. Rows with a null id are dropped, since no link can name them; rows that
    repeat an id are one document, of the smallest of their texts. Columns
    other than id and text are not read, so their names cannot clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    docs = one_row_an_id(docs)
    common = spark.sparkContext.broadcast(common_shingles(docs, n))  # COMMON numbers
    signed = arrow_map(docs, partial(_sign, n=n, num=num, den=den, buckets=BUCKETS * width, common=common), "bucket int, sigs binary, ids binary, sizes binary, more binary")
    found = cut(arrow_map(signed.repartition(width, "bucket").sortWithinPartitions("bucket"), _meet, "kind int, a long, b long, n long"))
    same = found.where("kind = 1").select("a", "b")
    clusters = components(found.where("kind < 2").select("a", "b"))
    grown = same.groupBy(F.col("b").alias("id")).agg((F.count("*") + 1).alias("copies"))
    leads = clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")).join(shuffled(same.select(F.col("a").alias("id"))), "id", "left_anti").join(shuffled(grown), "id", "left").select("id", "cluster", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    leads = cut(leads)
    sets = found.where("kind = 2").select(F.col("a").alias("id"), F.col("n").alias("held"))
    sizes = leads.join(shuffled(sets), "id").groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("held").alias("held")).where("rows > 1")
    # as few blocks as hold a cluster; up to so many that their pairs are a task each, while they keep FEW documents
    spread = F.least(F.ceil(F.col("rows") / F.lit(FEW)), F.lit(int(np.ceil(np.sqrt(2 * width)))))
    blocks = cut(sizes.select("cluster", F.greatest(F.ceil(F.col("rows") / F.lit(BLOCK)), F.ceil(F.col("held") / F.lit(HELD)), spread).cast("long").alias("blocks")))
    members = cut(leads.join(shuffled(blocks), "cluster"))
    maybe, _ = sifted(docs, "id", members)
    dealt = arrow_map(maybe.join(shuffled(members), "id").select("id", "text", "cluster", "blocks", "copies"), partial(_deal, n=n), "cluster long, i long, j long, block long, id long, copies long, shingles binary")
    checked = cut(arrow_map(dealt.repartition(width, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), partial(_verify, num=num, den=den), "a long, b long, links long"))
    roots = cut(components(checked.where("b is not null").select("a", "b").union(same)))
    degree = checked.where("b is null").groupBy(F.col("a").alias("lead")).agg(F.sum("links").alias("near"))
    copies = leads.where("copies > 1").select(F.col("id").alias("lead"), (F.col("copies") - 1).alias("same"))
    counts = cut(degree.join(shuffled(copies), "lead", "full").select("lead", (F.coalesce("near", F.lit(0)) + F.coalesce("same", F.lit(0))).alias("n_links")))
    # what is known of an id meets by shuffle: these tables grow with the documents, so none of them is broadcast
    facts = (
        found.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles")),
        roots.select(F.col("node").alias("doc_id"), "root"),
        counts.select(F.col("lead").alias("doc_id"), "n_links"),
        same.join(shuffled(counts), same["b"] == counts["lead"]).select(F.col("a").alias("doc_id"), "n_links"),
    )
    return (
        reduce(partial(DataFrame.unionByName, allowMissingColumns=True), facts)
        .groupBy("doc_id")
        .agg(F.max("n_shingles").alias("n_shingles"), F.max("root").alias("root"), F.max("n_links").alias("n_links"))
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose component has a smaller id; rows with a null id stay."""
    classes = shingle_join(docs, n, num, den, id_col, text_col)
    again = cut(classes.where("component_id <> doc_id").select(F.col("doc_id").alias("id")))
    maybe, rest = sifted(docs, id_col, again)
    return rest.union(maybe.join(shuffled(again), maybe[id_col].cast("long") == again["id"], "left_anti"))
