"""What the training-data operators share: tables, lineage cuts, size-checked broadcasts and Arrow text kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast up to this many rows times bytes a row; beyond it a shuffled join is planned.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Text bytes that a kernel works on at once.
CHUNK_BYTES = 4 * 1024 * 1024
#: Bits of a sieve, however many ids it stands for.
SIEVE = 1 << 23
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine serves only where all tasks run on it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
        found = spark.sparkContext.getCheckpointDir()
        _file_system(spark, found)[0].deleteOnExit(_file_system(spark, found)[1])
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a lineage cut that outlives lost executors, computed once.

    The files go with drop_cut(), or else when the driver's JVM ends: plans may read them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a cut() that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        system, where = _file_system(df.sparkSession, name)
        system.delete(where, True)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted size is under BROADCAST_BYTES, else df. df should be cheap to count, such as a cut()."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side that a join sorts and shuffles. Without the hint Spark broadcasts a written table of under 10 MB of parquet,
    which packed ids make millions of rows and a multiple of that in the driver, several at once."""
    return df.hint("merge")


def sifted(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df's rows whose key may be among ids(id), and those whose key is not.

    The ids' hashes go out as a set of SIEVE bits, so that the driver holds SIEVE / 64 rows at most; what may be among the ids
    is for a shuffled join to tell, which moves few other rows.
    """

    def place(column):
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(SIEVE).cast("long"))

    places = ids.select(place(F.col("id")).alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    words = F.broadcast(places.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    own = place(df[key])
    bit = F.call_function("shiftright", words["bits"], own.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    there = (F.shiftright(own, 6) == words["word"]) & (bit == 1)
    return df.join(words, there, "left_semi"), df.join(words, there, "left_anti")


def one_row_an_id(docs: DataFrame) -> DataFrame:
    """docs(id, text) with one row an id: of rows that repeat an id the one of the smallest text, null first. Only those rows are shuffled."""
    again = docs.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id")
    if again.isEmpty():
        return docs
    again = cut(again)
    maybe, rest = sifted(docs, "id", again)
    some = maybe.join(shuffled(again), "id", "left_semi").groupBy("id").agg(F.min(F.struct("text")).alias("s")).select("id", "s.text")
    return rest.unionByName(maybe.join(shuffled(again), "id", "left_anti")).unionByName(some)


def crc_fold(column: str, folds: int):
    """crc32 of the id written as text, modulo folds."""
    return F.crc32(F.col(column).cast("string")) % F.lit(folds)


def arrow_map(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """mapInArrow. Spark ends a batch at maxRecordsPerBatch rows or, where it knows the setting, at maxBytesPerBatch bytes; the kernels slice further by bytes."""
    return df.mapInArrow(fn, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column without nulls (null: empty), as 64-bit offsets so that no batch overflows."""
    a = column(batch, name)
    if a.type != pa.large_string():
        a = a.cast(pa.large_string())
    return pc.fill_null(a, "") if a.null_count else a


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches sliced to about `most` text bytes (one row at least), with their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = texts_of(batch, name)
        ends = text_offsets(texts)[1:]
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else ends[0] - (ends[0] - text_offsets(texts)[0])
            hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)
            lo = hi


def text_offsets(texts: pa.Array) -> np.ndarray:
    """Offsets into the data buffer, one more than texts."""
    return np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and len(texts)+1 offsets into them."""
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts, flat, and for each text its first word's place (len(texts)+1)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets.astype(np.int64)


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]; empty segments give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[c for c in range(128) if not chr(c).isalnum()]] = 32


def plain_text(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and every other ASCII byte but letters and digits turned into a blank."""
    data, offsets = text_bytes(texts)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_FOLDED[data])])
