"""Substring dedup over a logarithmic family of sparse suffix arrays.

Every window of 400 bytes holds a minimiser, so a suffix array of the suffixes that begin at minimisers misses no long
match: equal windows have equal minimisers at equal offsets. A batch's suffixes are sorted by their heads (8 bytes, then
the hash of 128), merge-scanned against the levels, and levels of equal size are merged into one of twice the size.
Suffixes whose head occurs again are compared on all their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm import common
from vicinage.llm.common import NULL_ID, Rolling, Scratch, discard, keyed, merged, mix, span_of
from vicinage.session import cut, fresh_path

LENGTH = 400                  # bytes of a match
HEAD = 128                    # bytes of a suffix's head
BATCHES = 4                   # arrivals a whole table is split into
HOT = 4_096                   # different surroundings of one head that a task compares; more are compared by shuffle
_BODY_BYTES = 1 << 22         # bytes compared at a time


def _first_eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number that sorts like them."""
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(8):
        value = (value << np.uint64(8)) | data[at + j].astype(np.uint64)
    return (value ^ np.uint64(1 << 63)).view(np.int64)


def sampled_suffixes(docs: DataFrame, length: int, head: int) -> DataFrame:
    """(key, piece, d, tag, pack, head) of every piece of every text; docs: (_d, _tag, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffer_of(batch.column(2))
            d, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for *columns, anchor in common.pieces_of(data, offsets, d, tag, length, head, common.BLOCK_BYTES, common.byte_values):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, _first_eight(data, anchor))],
                                                 ["key", "piece", "d", "tag", "pack", "head"])

    return docs.mapInArrow(run, "key long, piece long, d long, tag long, pack long, head long")


class SuffixIndex:
    """Suffix arrays of distinct heads with their numbers of holders, in levels of 1, 2, 4 ... batches.

    `add` sorts a batch, scans it against every level and returns the keys that now have a second holder; old and new
    ones alike. Levels live as sorted tables in the shared folder and are dropped when they were merged.
    """

    def __init__(self, spark):
        self.spark, self.levels = spark, []

    def _write(self, rows: DataFrame) -> str:
        path = fresh_path(self.spark, "suffixes")
        rows.repartitionByRange("head", "key").sortWithinPartitions("head", "key").write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: (head, key) per suffix. Returns (key) with repeats."""
        path = self._write(batch.groupBy("head", "key").agg(F.count("*").alias("n")))
        array = self.spark.read.parquet(path)
        repeated = array.where("n > 1").select("key")
        for held in self.levels:
            if held:
                level = self.spark.read.parquet(held)
                repeated = repeated.unionByName(array.hint("merge").join(level, ["head", "key"]).select("key"))
        repeated = cut(repeated.distinct())
        at = 0
        while at < len(self.levels) and self.levels[at]:
            level = self.levels[at]
            both = self.spark.read.parquet(path).unionByName(self.spark.read.parquet(level))
            grown = self._write(both.groupBy("head", "key").agg(F.sum("n").alias("n")))
            discard(self.spark, path)
            discard(self.spark, level)
            path, self.levels[at] = grown, None
            at += 1
        self.levels[at:at + 1] = [path]
        return repeated

    def drop(self) -> None:
        for path in filter(None, self.levels):
            discard(self.spark, path)
        self.levels = []


def _windows(bodies: list[bytes], keys: np.ndarray, count: np.ndarray, length: int):
    """(row, window, hash) of all windows of all bodies, the hash mixed with the row's key."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]]).astype(np.int64)
    row = np.repeat(np.arange(len(bodies)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[row] + j
    return row, j, mix(Rolling(common.byte_values(data)).of(at, at + length) ^ mix(keys.view(np.uint64))[row])


def _repeated(h: np.ndarray) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _compared(bodies: DataFrame, length: int) -> DataFrame:
    """(d, tag, a, b) covered by windows that two bodies of one key share. bodies: (key, d, tag, pack, n, body), sorted by key."""
    def matches(key, d, tag, pack, n, body):
        key, d, tag, pack, n = (np.array(x, dtype=np.int64) for x in (key, d, tag, pack, n))
        row, j, h = _windows(body, key, common.pack_count(pack), length)
        hit = _repeated(h) & (n[row] == 1)
        row, j = row[hit], j[hit]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)])) if len(row) else row
        last = np.append(first[1:], len(row)) - 1
        r, start = row[first], common.pack_start(pack)[row[first]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[r], tag[r], start + j[first], start + j[last] + length)],
                                          ["d", "tag", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = tuple([] for _ in range(6)), 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if size > _BODY_BYTES and values[0] != held[0][-1]:
                    yield matches(*held)
                    held, size = tuple([] for _ in range(6)), 0
                for part, v in zip(held, values):
                    part.append(v)
                size += len(values[5])
        if held[0]:
            yield matches(*held)

    return bodies.mapInArrow(run, "d long, tag long, a long, b long")


def _exploded(bodies: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many bodies: one row per window, counted by shuffle with partial sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                key, d, tag, pack, n = (batch.column(k).slice(i, 1024).to_numpy(zero_copy_only=False) for k in range(5))
                row, j, h = _windows(batch.column(5).slice(i, 1024).to_pylist(), key, common.pack_count(pack), length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), d[row], tag[row], common.pack_start(pack)[row] + j, n[row])],
                                                 ["h", "d", "tag", "a", "n"])

    windows = bodies.mapInArrow(run, "h long, d long, tag long, a long, n long")
    often = windows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    return windows.where("n = 1").join(often, "h").select("d", "tag", "a", (F.col("a") + length).alias("b"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, head: int = HEAD, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """(d, tag, a, b): stretches of bytes covered by a `length`-byte string that starts anywhere else too.

    docs: as `common.keyed` makes it. Stretches of a document may overlap; their union is what is covered.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    arrival = F.pmod(F.xxhash64("d"), F.lit(batches)).cast("int").alias("batch")
    parts = scratch.keep("pieces", sampled_suffixes(docs, length, head).select("*", arrival))
    index, keys = SuffixIndex(spark), None
    for i in range(batches):
        found = index.add(parts.where(F.col("batch") == i).select("head", "key"))
        keys = found if keys is None else keys.unionByName(found)
    index.drop()
    # joins follow written tables, not aggregations, so that adaptive execution can split a hot key
    again = scratch.keep("again", parts.select("key", "piece", "d", "tag", "pack").join(cut(keys.distinct()), "key"))
    scratch.drop("pieces")
    groups = scratch.keep("groups", again.groupBy("key", "piece").agg(F.count("*").alias("n"), F.min(F.struct("d", "tag", "pack")).alias("first")))
    copies = scratch.keep("copies", again.join(groups.where("n > 1").select("key", "piece"), ["key", "piece"]).selectExpr(*span_of(length)))
    scratch.drop("again")
    varied = cut(groups.groupBy("key").agg(F.count("*").alias("v")).where("v > 1"))
    shown = groups.join(varied, "key").selectExpr("key", "v", "n", "first.d AS d", "first.tag AS tag", "first.pack AS pack")
    per_doc = shown.groupBy("d", "tag").agg(F.collect_list(F.struct("key", "v", "n", "pack")).alias("want"))

    def extract(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            data, offsets = common.buffer_of(batch.column(2))
            want = batch.column(3)
            item = want.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(want.offsets.to_numpy()))
            pack = item.field("pack").to_numpy()
            begin = offsets[row] + common.pack_start(pack)
            end = begin + common.pack_count(pack) + length - 1
            body = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
            d, tag = (batch.column(i).take(pa.array(row)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([item.field("key"), d, tag, item.field("pack"), item.field("n"), pa.array(body, type=pa.binary()), item.field("v")],
                                             ["key", "d", "tag", "pack", "n", "body", "v"])

    texts = docs.join(per_doc, (F.col("_d") == F.col("d")) & (F.col("_tag") == F.col("tag"))).select("d", "tag", "text", "want")
    bodies = scratch.keep("bodies", texts.mapInArrow(extract, "key long, d long, tag long, pack long, n long, body binary, v long"))
    scratch.drop("groups")
    own = ["key", "d", "tag", "pack", "n", "body"]
    few = bodies.where(F.col("v") <= hot).select(*own).repartition("key").sortWithinPartitions("key")
    many = bodies.where(F.col("v") > hot).select(*own)
    found = cut(copies.unionByName(_compared(few, length)).unionByName(_exploded(many, length)))
    scratch.drop("copies", "bodies")
    return found


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept_sha256) for every row of `docs` (doc_id, text).

    Removes every byte that lies in a string of `length` UTF-8 bytes which also starts anywhere else, in the same or in
    another document; strings are judged on the input. spans lists the maximal removed runs as [start, end). Null text
    is empty. A repeated row is one more place where its strings start, so long ones lose all. A null id is an id of
    its own. Empty table: empty result. Other columns are not looked at.
    """
    base = keyed(docs)
    spans = repeated_spans(base, **options).groupBy("d", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = base.join(spans, (F.col("_d") == F.col("d")) & (F.col("_tag") == F.col("tag")), "left").select("_d", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffer_of(batch.column(1))
            out = []
            for i, found in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                cuts, at, kept = merged([(s["a"], s["b"]) for s in found or ()]), 0, hashlib.sha256()
                for a, b in cuts:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in cuts), len(cuts), [list(c) for c in cuts], kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds))],
                                             ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    made = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string")
    return made.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
