"""Best-fit decreasing packing of tokenised documents into sequences, over counts of lengths.

Documents of one length are interchangeable, so best-fit decreasing needs no more than how many documents have each
length: at most `size` numbers, whatever the corpus. The plan is made from those with a segment tree over remaining
capacities that finds the tightest open bin; equal bins are filled as one range, so the plan is short as well (see
`plan`). Every document then finds its place from its rank among those of its length, a distributed prefix sum.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.common import Ragged, byte_symbols
from vicinage.session import fresh_path

SIZE = 2048                   # tokens of a sequence
END = 0                       # the id that ends a document
BLOCK_BYTES = 1 << 24         # bytes of text tokenised at a time
# letters whose lower case and normal form are plain, then signs that are one run to a tokenizer; no apostrophe, which may begin a run of its own
PLAIN_WORD = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<stops>[!-&(-/:-@\[-`{-~]*)$"
WORD_END = "\ue000"           # stands for the end of a word between runs, in which it can't occur
_RANK_BITS = 44


class Run(NamedTuple):
    """`items` documents of one length, from rank `rank` on: `per_bin` in each bin from `bin` on, beginning at `offset`."""

    length: int
    rank: int
    items: int
    bin: int
    per_bin: int
    offset: int


class OpenBins:
    """Ranges of equally filled bins by remaining capacity, under a segment tree of which capacities are there."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.ranges: list[deque[tuple[int, int]]] = [deque() for _ in range(self.width)]
        self.held = [0] * (2 * self.width)           # ranges below each node

    def _count(self, capacity: int, change: int) -> None:
        node = capacity + self.width
        while node:
            self.held[node] += change
            node >>= 1

    def put(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.ranges[capacity].append((first, count))
            self._count(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.ranges[capacity].popleft()

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is `least` or more."""
        node = least + self.width
        while not self.held[node]:
            while node & 1:                          # a right child: everything below its parent is too small
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if self.held[2 * node] else 2 * node + 1
        return node - self.width


def plan(counts: dict[int, int], size: int = SIZE) -> list[Run]:
    """Best-fit decreasing of `counts[length]` documents of each length into bins of `size`.

    The same bins as placing documents one by one, the longest first, each into the fullest bin that takes it: the
    tightest bin stays the tightest until it takes no more of that length. A length splits at most two ranges, and a range
    it fills keeps less than half of its capacity, so there are at most about 3 * size * log2(size) runs.
    """
    bins, used, runs = OpenBins(size), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = bins.tightest(length)
            if capacity is None:                     # as many new bins as these documents fill
                capacity = size
                first, count = used, -(-left // (size // length))
                used += count
            else:
                first, count = bins.take(capacity)
            per_bin = capacity // length
            full = min(count, left // per_bin)
            if full:
                runs.append(Run(length, rank, full * per_bin, first, per_bin, size - capacity))
                bins.put(capacity - per_bin * length, first, full)
                rank, left = rank + full * per_bin, left - full * per_bin
            if full < count and left:                # less than one bin takes
                runs.append(Run(length, rank, left, first + full, left, size - capacity))
                bins.put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            bins.put(capacity, first + full, count - full)
    return runs


class WordIds:
    """Ids of whole texts, from those of their different words.

    Exact for byte-level tokenizers with word ends that lower case and drop white space before they merge: no token reaches over white space.
    A word of plain Latin letters and stops is what it is to every such tokenizer, one run of each. All runs of a block are
    merged in one call, by the vocabulary's merges as ranks, with a private character as the end of a word; any other word goes through
    the tokenizer itself.
    """

    def __init__(self, tokenizer: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(tokenizer)
        model = json.loads(tokenizer)["model"]
        shown = byte_symbols()
        of_symbol, vocab, suffix, mark = {c: bytes([b]) for b, c in shown.items()}, model["vocab"], model["end_of_word_suffix"], WORD_END.encode()

        def spelt(token: str) -> bytes:
            ends = token.endswith(suffix)
            return b"".join(of_symbol[c] for c in (token[:-len(suffix)] if ends else token)) + mark * ends

        steps = [bytes([b]) for b in range(256)] + [mark[:2], mark] + [bytes([b]) + mark for b in range(256)]
        steps += [spelt(a) + spelt(b) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        ranks: dict[bytes, int] = {}
        for step in steps:
            ranks.setdefault(step, len(ranks))
        self.merger = tiktoken.Encoding("runs", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
        self.id_of, self.ends = np.zeros(len(ranks), dtype="<u4"), np.zeros(len(ranks), dtype=bool)
        for token, i in vocab.items():
            if set(token.removesuffix(suffix)) <= of_symbol.keys() and (rank := ranks.get(spelt(token))) is not None:
                self.id_of[rank], self.ends[rank] = i, token.endswith(suffix)

    def _runs(self, column: pa.Array) -> Ragged:
        """Ids of runs of lower-case letters or of stops, each merged once; an empty one has none."""
        coded = column.dictionary_encode()
        runs = coded.dictionary.to_pylist()
        full = np.array([bool(r) for r in runs], dtype=bool)
        found = np.array(self.merger.encode_ordinary("".join(r + WORD_END for r in runs if r)), dtype=np.int64)
        sizes = np.zeros(len(runs), dtype=np.int64)
        sizes[full] = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
        return Ragged(self.id_of[found], sizes).take(coded.indices.to_numpy())

    def of(self, texts: pa.Array) -> Ragged:
        """Per text its ids; nulls are empty."""
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        parted = pc.extract_regex(words, PLAIN_WORD)
        plain = parted.is_valid().to_numpy(zero_copy_only=False)
        letters, stops = (pc.fill_null(parted.field(k), "") for k in ("letters", "stops"))
        made = Ragged.joined(self._runs(pc.utf8_lower(letters)), self._runs(stops))
        odd = words.filter(pa.array(~plain)).to_pylist()
        other = Ragged.of([e.ids for e in self.encoder.encode_batch_fast(odd, add_special_tokens=False)])
        row = np.arange(len(words))
        row[~plain] = len(words) + np.arange(len(odd))
        every = Ragged(np.concatenate([made.flat, other.flat]), np.concatenate([made.sizes, other.sizes])).take(row)
        whole = every.take(coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(whole.sizes)])
        return Ragged(whole.flat, np.diff(ends[split.offsets.to_numpy() - split.offsets[0].as_py()]))


def blocks_of(column: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) stretches of a string column, of about so many bytes or one longer text."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, side="right")))
        yield low, column.slice(low, high - low)
        low = high


_PIECES = "id long, piece int, start long, length long, ids_crc32 long, part long, slot long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, *, size: int = SIZE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, slot, ids): the ids of every whole text and an end id, cut at `size`.

    part numbers the task and slot the pieces of one length in it, so both hold only for rows that were written once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_content(tokenizer))
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part, slots = WordIds(sent.value), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            for first, texts in blocks_of(batch.column(1), BLOCK_BYTES):
                rows, whole = [], words.of(texts)
                data, at = whole.flat.tobytes(), 0
                for i, size_ in enumerate(whole.sizes.tolist()):
                    ids = data[4 * at:4 * (at + size_)] + end
                    at += size_
                    for piece, low in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[low:low + 4 * size]
                        length = len(own) // 4
                        rows.append((first + i, piece, low // 4, length, zlib.crc32(own), slots[length], own))
                        slots[length] += 1
                row, piece, start, length, crc, slot, own = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()),
                     *(pa.array(x, type=pa.int64()) for x in (start, length, crc)), pa.array([part] * len(rows), type=pa.int64()),
                     pa.array(slot, type=pa.int64()), pa.array(own, type=pa.binary())],
                    ["id", "piece", "start", "length", "ids_crc32", "part", "slot", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, _PIECES)


def _content(tokenizer: str) -> str:
    """A tokenizer's file, some megabytes by nature: read once and sent to all tasks."""
    with open(tokenizer, encoding="utf-8") as file:
        return file.read()


def pack(docs: DataFrame, tokenizer: str, *, size: int = SIZE, text: str = "text", id_col: str = "doc_id",
         path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, ids) for every piece of every row of `docs`.

    A document is the ids that the tokenizer (a file's path) gives its whole text, then id 0; one longer than `size` is
    cut into pieces of `size`, the last of which may be shorter. Pieces share sequences of at most `size` ids by best-fit
    decreasing, gapless from offset 0. Null and empty texts are documents of the end id alone; every repeated row is a
    document of its own; null ids stay null. Empty table: empty result. Other columns are not looked at.

    The pieces are written below the shared folder, or to `path`, and belong to the result: keep them while it is read.
    What reaches the driver is the number of pieces per length; what is broadcast is the plan made of that. Both are
    bounded by `size`.
    """
    if not 1 <= size < 1 << 18:
        raise ValueError("a sequence has 1 to 262,143 tokens")
    spark = docs.sparkSession
    path = path or fresh_path(spark, "packing")
    pieces(docs, tokenizer, size=size, text=text, id_col=id_col).write.option("compression", "zstd").parquet(path)
    made = spark.read.parquet(path)
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, len(Run._fields))
    sent = spark.sparkContext.broadcast((table, (table[:, 0] << _RANK_BITS) | table[:, 1]))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = (x.to_numpy(zero_copy_only=False) for x in (length, rank))
        rows, keys = sent.value
        own = rows[np.searchsorted(keys, (length << _RANK_BITS) | rank, side="right") - 1]
        at = rank - own[:, 1]
        return pa.StructArray.from_arrays([pa.array(own[:, 3] + at // own[:, 4]), pa.array(own[:, 5] + at % own[:, 4] * length)],
                                          ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = made.join(first, ["part", "length"]).withColumn("at", place("length", F.col("first") + F.col("slot")))
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence of `pack`, one after the other; at most `size` in a group."""
    laid = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), laid.alias("_laid")).select(
        "sequence_id", "n_tokens", F.aggregate("_laid", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"))
