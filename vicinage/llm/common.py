"""Array helpers shared by the corpus operators: text buffers, rolling hashes, minimiser pieces.

A *piece* is a run of consecutive windows of one document that share the same minimiser (the smallest of the window's
k-gram hashes, leftmost on ties). Which minimiser a window has depends on its content only, so equal windows always
carry the same key, at the same offset from the minimiser. Pieces split every window of a document once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.session import fresh_path

NULL_ID = -(1 << 63)          # stands for a null id: before every other one
BLOCK_BYTES = 1 << 21         # text bytes hashed at a time
BLOCK_WORDS = 1 << 19         # word hashes windowed at a time
PACK_MOST = (1 << 16) - 1     # windows of a piece, and the offset of its minimiser
_POSITION = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(_d, _tag, text): id without nulls, a hash that keeps rows of one id with different texts apart, text without nulls.

    Rows of one id and one text are the same row to all that joins on (_d, _tag).
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_d"),
                       F.xxhash64(text).alias("_tag"), text.alias("text"))


def kept_rows(batch: pa.RecordBatch, keep: list[bool], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch that stay, in small messages, so that whole texts don't pile up on either side of the pipe."""
    kept = batch.filter(pa.array(keep, type=pa.bool_()))
    for i in range(0, kept.num_rows, rows):
        yield kept.slice(i, rows)
    del kept
    pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, dtype=np.uint64)
    up = np.cumprod(np.concatenate([one, np.full(size, _BASE, dtype=np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([one, np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)]), dtype=np.uint64)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(22, int(n + 1).bit_length()))


class Rolling:
    """Hashes of any slice of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def leftmost_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of each w neighbours; the leftmost of those that agree in the leading 40 bits."""
    y = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    span, n = 1, len(h) - w + 1
    while 2 * span <= w:
        y = np.minimum(y[:len(y) - span], y[span:])
        span *= 2
    return (np.minimum(y[:n], y[w - span:w - span + n]) & _POSITION).astype(np.int64)


def pieces(values: np.ndarray, of: np.ndarray, length: int, k: int):
    """Pieces of a block: (key, piece hash, first window, windows, offset of the minimiser).

    `of` numbers the document of every value; windows of `length` values never cross documents.
    """
    n = len(values)
    if n < length:
        return None
    starts = np.flatnonzero(of[length - 1:] == of[:n - length + 1])
    if not len(starts):
        return None
    rolling = Rolling(values)
    grams = rolling.grams(k)
    at = leftmost_minimum(grams, length - k + 1)[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin, anchor = starts[first], at[first]
    shape = (count.astype(np.uint64) << np.uint64(32)) | (anchor - begin).astype(np.uint64)
    piece = mix(rolling.of(begin, begin + count + length - 1) ^ mix(shape))
    return grams[anchor].view(np.int64), piece.view(np.int64), begin, count, anchor - begin


class Ragged:
    """Rows of numbers of unequal lengths, one after the other."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.begins = flat, sizes, np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, rows: list[list[int]]) -> Ragged:
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        return cls(np.fromiter(chain.from_iterable(rows), dtype="<u4", count=int(sizes.sum())), sizes)

    def take(self, rows: np.ndarray) -> Ragged:
        sizes = self.sizes[rows]
        shift = np.repeat(self.begins[rows] - (np.cumsum(sizes) - sizes), sizes)
        return Ragged(self.flat[shift + np.arange(len(shift))], sizes)

    @staticmethod
    def joined(left: Ragged, right: Ragged) -> Ragged:
        """Row by row the numbers of both."""
        n = len(left.sizes)
        both = Ragged(np.concatenate([left.flat, right.flat]), np.concatenate([left.sizes, right.sizes]))
        return Ragged(both.take(np.arange(2 * n).reshape(2, n).T.ravel()).flat, left.sizes + right.sizes)


def byte_symbols() -> dict[int, str]:
    """The sign for each byte in a byte-level vocabulary: printable Latin-1 is itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column of a batch, and where each row starts (one entry more than rows)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of a buffer; a row's end also ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    black = ~_WHITE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start, end = black.copy(), black.copy()
    start[1:] &= ~black[:-1] | edge[1:n]
    end[:-1] &= ~black[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, made block by block of the buffer."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK_BYTES, side="right")))
        low = start[i]
        rolling = Rolling(byte_values(data[low:end[j - 1]]))
        out[i:j] = rolling.of(start[i:j] - low, end[i:j] - low)
        i = j
    return mix(out)


def text_blocks(offsets: np.ndarray, size: int, overlap: int):
    """(low, high, first row, last row + 1) stretches of a buffer: whole rows together up to `size`, longer rows cut.

    The cuts of a row overlap, so every slice of `overlap` + 1 values lies in one block; its starts do not repeat.
    """
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        if j == i + 1 and high - low > size + overlap:
            while low < high - overlap:
                yield low, min(low + size + overlap, high), i, j
                low += size
        else:
            yield low, high, i, j
        i = j


def pieces_of(values: np.ndarray, offsets: np.ndarray, d: np.ndarray, tag: np.ndarray, length: int, k: int, size: int,
              values_of=lambda v: v):
    """Columns (key, piece, d, tag, pack) of all pieces of a batch, block by block, and the anchors.

    pack holds the first window's place in its row, the number of windows, and the minimiser's offset.
    """
    if length - k + 1 > PACK_MOST:
        raise ValueError(f"a window may hold {PACK_MOST} grams at most, not {length - k + 1}")
    for low, high, i, j in text_blocks(offsets, size, length - 1):
        edges = np.clip(offsets[i:j + 1], low, high) - low
        of = np.repeat(np.arange(i, j), np.diff(edges))
        found = pieces(values_of(values[low:high]), of, length, k)
        if found is None:
            continue
        key, piece, begin, count, anchor = found
        row = of[begin]
        start = begin + low - offsets[row]
        yield key, piece, d[row], tag[row], (start << 32) | (count << 16) | anchor, begin + anchor + low


def pack_start(pack: np.ndarray) -> np.ndarray:
    return pack >> 32


def pack_count(pack: np.ndarray) -> np.ndarray:
    return (pack >> 16) & PACK_MOST


def span_of(length: int) -> list[str]:
    """SQL of (d, tag, a, b): what the windows of a piece cover."""
    return ["d", "tag", "shiftright(pack, 32) AS a", f"shiftright(pack, 32) + (shiftright(pack, 16) & {PACK_MOST}) + {length - 1} AS b"]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals, as maximal ones in order; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Scratch:
    """Tables of one run in the shared folder, each dropped as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        self.paths[name] = fresh_path(self.spark, name)
        rows.write.option("compression", "zstd").parquet(self.paths[name])
        return self.spark.read.schema(rows.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, self.paths.pop(name))


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch table of this run."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
