"""SimHash near-duplicates, searched through per-segment bit counts.

A fingerprint is mapped to the bit counts of its segments. A flipped bit moves one count by one, so the Manhattan
distance of two count vectors never exceeds the Hamming distance of the fingerprints. Every occupied grid cell is
therefore joined with the cells at Manhattan distance <= 2 only, and the exact distance is part of the join condition:
candidates that fail it are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import NULL_ID
from vicinage.llm.components import components
from vicinage.session import cut

SEGMENTS = 8                  # 8 segments of 8 bits; 16 of 4 bits give finer cells for billions of fingerprints
_BLOCK = 1 << 16              # shingles hashed at a time


def _fingerprint(text: str, size: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    line, size = b" ".join(words), min(size, n)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n - size + 1].tolist()
    stops = ends[size - 1:].tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), _BLOCK):
        made = [digest(line[a:b], 42) for a, b in zip(starts[i:i + _BLOCK], stops[i:i + _BLOCK])]
        octets = np.array(made, dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(set_bits * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp long): SimHash of the word shingles of every whole text, XXH64 with seed 42, repeats counted.

    A-Z is lowered first. Fewer words than a shingle: the whole sequence is one shingle. Null, empty or blank text:
    fingerprint 0. A bit is set if it is set in more than half of the hashes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_fingerprint(t.as_py() or "", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, "id long, fp long")


def _lane(fp: Column, i: int, segments: int) -> Column:
    width = 64 // segments
    bits = F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.bit_count(bits).cast("long")


def cell(fp: Column, segments: int = SEGMENTS) -> Column:
    """The counts of all segments as one number, a lane of 64 / segments bits each.

    All lanes but the top one are raised by 2, so none borrows when a neighbour lies one or two below zero.
    """
    lanes = [F.shiftleft(_lane(fp, i, segments) + (2 if i < segments - 1 else 0), i * (64 // segments))
             for i in range(segments)]
    total = lanes[0]
    for lane in lanes[1:]:
        total = total.bitwiseOR(lane)
    return total


def half_ball(segments: int = SEGMENTS, radius: int = 2) -> list[int]:
    """Cell differences within a Manhattan radius, one of each pair of opposite ones, and zero."""
    width, found = 64 // segments, {(0,) * segments}
    for _ in range(radius):
        found |= {v[:i] + (v[i] + s,) + v[i + 1:] for v in found for i in range(segments) for s in (1, -1)}
    return sorted(sum(x << (i * width) for i, x in enumerate(v)) for v in found
                  if next((x for x in v if x), 1) > 0)


def links(prints: DataFrame, *, distance: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """(fp_a, fp_b): every pair of different fingerprints that differ in at most `distance` bits, once."""
    at = prints.select(F.col("fp").alias("fp_a"), cell(F.col("fp"), segments).alias("_cell"))
    steps = F.array(*[F.lit(v).cast("long") for v in half_ball(segments, distance)])
    near = at.select("fp_a", F.explode(steps).alias("_step"), F.col("_cell").alias("_home"))
    near = near.select("fp_a", (F.col("_home") + F.col("_step")).alias("_cell"), (F.col("_step") == 0).alias("_same"))
    other = at.select(F.col("fp_a").alias("fp_b"), F.col("_cell").alias("_cell_b"))
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance
    return near.join(other, (F.col("_cell") == F.col("_cell_b")) & close
                     & (~F.col("_same") | (F.col("fp_a") < F.col("fp_b")))).select("fp_a", "fp_b")


def classes(docs: DataFrame, *, shingle: int = 3, distance: int = 2, segments: int = SEGMENTS, text: str = "text",
            id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component): documents joined by chains of fingerprints at most `distance` bits apart.

    component is the smallest id that can be reached, nulls left out: null if all ids of a class are. Equal fingerprints
    are collapsed before the search, so a group of copies of any size costs one row there; all links between different
    fingerprints are found. Only fingerprints link: rows of one id, or of null ids, are rows of their own. Repeated rows
    stay. Empty table: empty result. Other columns are not looked at, whatever their names.
    """
    prints = cut(fingerprints(docs, shingle=shingle, text=text, id_col=id_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("id")))
    labels = _labelled(distinct, distance, segments)
    least = labels.groupBy("class").agg(F.min("id").alias("component"))
    return prints.join(cut(labels.join(least, "class").select("fp", "component")), "fp").select("id", "fp", "component")


def _labelled(distinct: DataFrame, distance: int, segments: int) -> DataFrame:
    """(class, id, fp) of distinct fingerprints; the class is the smallest fingerprint that can be reached."""
    pairs = links(distinct, distance=distance, segments=segments).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    return distinct.join(components(pairs), F.col("fp") == F.col("node"), "left").select(
        F.coalesce("component", "fp").alias("class"), "id", "fp")


def keep_one(docs: DataFrame, *, shingle: int = 3, distance: int = 2, segments: int = SEGMENTS, text: str = "text",
             id_col: str = "doc_id") -> DataFrame:
    """One row of `docs` for each class of fingerprints joined by chains: one with the class's smallest id, null first.

    Rows are told apart by id and fingerprint; that ids are equal or null links nothing.
    """
    node = F.coalesce(F.col("id"), F.lit(NULL_ID))
    distinct = cut(fingerprints(docs, shingle=shingle, text=text, id_col=id_col).groupBy("fp").agg(F.min(node).alias("id")))
    labels = _labelled(distinct, distance, segments)
    kept = labels.groupBy("class").agg(F.min(F.struct("id", "fp")).alias("row")).select(F.col("row.id").alias("_kept"), F.col("row.fp").alias("_kept_fp"))

    @F.arrow_udf("long")
    def print_of(texts: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(t.as_py() or "", shingle) for t in texts], type=pa.int64())

    held = docs.withColumns({"_held": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_fp": print_of(F.col(text).cast("string"))})
    first = held.join(kept, (F.col("_held") == F.col("_kept")) & (F.col("_fp") == F.col("_kept_fp")), "left_semi")
    return first.dropDuplicates(["_held", "_fp"]).select(*docs.columns)
