"""What the operators share: Arrow plumbing, prefix polynomial hashes, packed arrays and chunks.

Hashes are polynomials modulo 2**64 with an odd base and a random value per symbol, so that prefix
sums give the hash of any span: ``(C[end] - C[start]) * R**-start``. Wherever equality decides
about data, the operator compares the symbols themselves afterwards.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 5  # odd: it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)


def scramble(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of x over the result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = scramble((np.arange(1, 257, dtype=U64)) * U64(0x9E3779B97F4A7C15))
_powers = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """R**0 .. R**(n-1), or of R's inverse; kept and grown by doubling."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024, 0 if have is None else 2 * len(have)), U64(_R_INV if inverse else _R))
        steps[0] = U64(1)
        have = _powers[inverse] = np.cumprod(steps, dtype=U64)
    return have[:n]


def prefix_sums(values: np.ndarray, local: np.ndarray | None = None) -> np.ndarray:
    """C with C[i] the sum of values[j] * R**local[j] for j < i; local defaults to j."""
    out = np.zeros(len(values) + 1, U64)
    weights = powers(len(values)) if local is None else powers(int(local.max(initial=0)) + 1)[local]
    np.cumsum(values * weights, dtype=U64, out=out[1:])
    return out


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive symbols."""
    if len(values) < k:
        return np.zeros(0, U64)
    c = prefix_sums(values)
    return scramble((c[k:] - c[:-k]) * powers(len(values) - k + 1, inverse=True))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive entries, by doubling."""
    m, size = x, 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == w else np.minimum(m[: len(x) - w + 1], m[w - size : w - size + len(x) - w + 1])


_KINDS = ("u1", "u2", "u4", "u8", "i4", "i8", "f8")
_HEAD = struct.Struct("<BII")  # kind (16 more: stored as it is), entries, bytes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob; bytes of equal significance lie together and are compressed where that helps."""
    squeeze, parts = zstandard.ZstdCompressor(level=1, write_content_size=False), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        flat = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if a.dtype.itemsize > 1 else a
        raw = np.ascontiguousarray(flat).tobytes()
        data = squeeze.compress(raw) if len(raw) > 64 else raw
        kind = _KINDS.index(a.dtype.str[1:])
        if len(data) >= len(raw):
            kind, data = kind | 16, raw
        parts += (_HEAD.pack(kind, len(a), len(data)), data)
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of pack()."""
    expand, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(blob):
        kind, n, size = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        dtype, data = np.dtype(_KINDS[kind & 15]), blob[at : at + size]
        raw = np.frombuffer(data if kind & 16 else expand.decompress(data, max_output_size=n * dtype.itemsize), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if dtype.itemsize > 1 else raw.view(dtype))
        at += size
    return out


def deltas(keys: np.ndarray) -> np.ndarray:
    """Sorted unsigned keys as differences, which pack() stores in fewer bytes."""
    return np.diff(keys, prepend=U64(0))


def undeltas(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=U64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of lengths[i] entries each, one after another."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    if total:
        ends = np.cumsum(n)
        out[0] = s[0]
        out[ends[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def texts_as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, to bound what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as ``id`` (long) and ``text``; other columns may have any name."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))


def text_bytes(rows: DataFrame) -> int:
    """The UTF-8 bytes of all texts: one number, from which partition counts follow."""
    return int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def chunked(rows: DataFrame, total_bytes: int, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Rows (id, text) with a hash ``chunk``, of about chunk_bytes of text each; the number of chunks.

    The chunk depends on the row alone, so that later phases and lost executors find the same one; on its
    text too, so that rows with a null or frequent id spread.
    """
    n = max(1, -(-total_bytes // chunk_bytes))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n


class Chunk:
    """The texts of a chunk, in an order that any phase repeats, as one buffer.

    ``column`` holds the ids with their nulls; in ``ids``, where ``named`` is false, a null is 0.
    """

    def __init__(self, table: pa.Table):
        pa.default_memory_pool().release_unused()
        table = table.select(["id", "text"])
        table = table.set_column(1, "text", pc.fill_null(table["text"], "").cast(pa.large_binary()))
        order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")])
        table = table.take(order).combine_chunks()
        self.column = table["id"].cast(pa.int64()).combine_chunks()
        self.ids, self.named = pc.fill_null(self.column, 0).to_numpy(), pc.is_valid(self.column).to_numpy(zero_copy_only=False)
        texts = table["text"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts
        if len(self.ids):
            self.ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
            data = texts.buffers()[2]
            self.bytes = np.frombuffer(data, np.uint8)[self.ends[0] : self.ends[-1]] if data else np.zeros(0, np.uint8)
            self.ends = self.ends - self.ends[0]
        else:
            self.ends, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.uint8)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from the session's settings.

    Where none is set, a new one of its own, but only in a local session: elsewhere executors couldn't see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(rows: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder, so that no later job makes them again."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words (runs of bytes other than ASCII white space), and documents' ends in words."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.r_[True, ~inside[:-1]])) if len(data) else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (edge[1:] | np.r_[~inside[1:], True])) + 1 if len(data) else starts
    return starts, stops, np.searchsorted(starts, ends)


#: Longer words are hashed by XXH64: there, polynomials modulo 2**64 have collisions by construction.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """The hash of each word, by prefix sums over the words' own bytes; of long words, XXH64."""
    out = np.zeros(len(starts), U64)
    for at in range(0, len(starts), block):
        s, n = starts[at : at + block], stops[at : at + block] - starts[at : at + block]
        short = np.where(n > LONG_WORD, 0, n)
        first = np.cumsum(short) - short
        local = ranges(np.zeros(len(n), np.int64), short)
        sums = prefix_sums(BYTE_VALUES[data[local + np.repeat(s, short)]], local)
        out[at : at + block] = sums[first + short] - sums[first]
    out = scramble(out)
    for i in np.flatnonzero(stops - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes(), 7)
    return out
