"""Alignment of two tokenizers' tokens over the same bytes, and how many documents link each pair of ids.

Per batch of documents, laid end to end, two pandas as-of merges keyed by document find for every token's start the other
side's token that covers it. Their union is all overlaps; overlaps with equal ends close the groups. Counts over the corpus
are made from the distinct pairs of chunks of documents: a chunk asks once for each of its pairs, however often its
documents hold it, so neither a frequent pair nor a repeated document weighs on the joins.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import Ragged, byte_symbols
from vicinage.session import cut, fresh_path

BLOCK_CHARS = 1 << 21         # characters of text aligned at a time
UNIT_CHARS = 1 << 19          # characters of one document aligned at a time; longer ones go by stretches
CHUNK_CHARS = 1 << 24         # characters of the documents that ask for counts together
PRODUCT = 1 << 22             # pairs of ids spread out at a time
_B_BITS = 24                  # of a pair's number, the second id
_CUT = re.compile(r"(?<=\S) (?! *\Z)")
_PARTED = re.compile(r"(?<=\S)(?= )(?! +\Z)")
_UNEVEN = re.compile(r"\s |\s\Z")


class Encoders:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        # a byte-level vocabulary lists its tokens in the order of their merges, so the ids are the ranks
        told, back = json.loads(byte_level), {c: b for b, c in byte_symbols().items()}
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        spelt = {i: t for t, i in ranks.items()}
        self.a_bytes = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.sizes = [np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (self.a_bytes, self.b_bytes)]

    def tokens(self, units: list[str]) -> tuple[list[Ragged], np.ndarray]:
        """Per unit the ids of both sides, and whether both give back its bytes. Each different word is encoded once.

        A word is what follows a space, see `split`; it is encoded as it would be there.
        """
        even = not any(map(_UNEVEN.search, (" " + u for u in units)))
        if even:
            parted = pc.split_pattern(pa.array(units, type=pa.large_string()), " ")
            counts, flat = np.diff(parted.offsets.to_numpy()), parted.flatten()
        else:
            lists = [split(u) for u in units]
            counts, flat = np.fromiter(map(len, lists), dtype=np.int64, count=len(units)), pa.array(list(chain.from_iterable(lists)), type=pa.large_string())
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        b = self.b.encode(words, num_threads=1)
        sizes = pc.binary_length(coded.dictionary).to_numpy() + 1
        sides = []
        for each in (self._a_of(words, sizes, even), Ragged.of(b)):
            taken = each.take(codes)
            sides.append(Ragged(taken.flat.astype(np.int64), np.add.reduceat(taken.sizes, np.cumsum(counts) - counts)))
        if (" " + " ".join(words)).encode() == b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(b))):
            return sides, np.ones(len(units), dtype=bool)
        same = np.array([(" " + w).encode() == b"".join(map(self.b_bytes.__getitem__, x)) for w, x in zip(words, b)])
        return sides, np.logical_and.reduceat(same[codes], np.cumsum(counts) - counts)

    def _a_of(self, words: list[str], sizes: np.ndarray, even: bool) -> Ragged:
        """Ids of each word with its space, `sizes` bytes; the byte-level side gives back whatever it gets.

        Words that end in other than white space are encoded in one text and told apart by their bytes.
        """
        plain = np.ones(len(words), dtype=bool) if even else np.array([bool(w) and not w[-1].isspace() for w in words])
        joined = words if even else [w for w, p in zip(words, plain) if p]
        ids = np.array(self.a.encode_ordinary(" " + " ".join(joined)) if joined else [], dtype=np.int64)
        at = np.searchsorted(np.cumsum(self.sizes[0][ids]), np.cumsum(sizes[plain])) + 1
        rest = Ragged.of([self.a.encode_ordinary(" " + w) for w, p in zip(words, plain) if not p])
        row = np.where(plain, np.cumsum(plain) - 1, len(joined) + np.cumsum(~plain) - 1)
        return Ragged(np.concatenate([ids, rest.flat.astype(np.int64)]), np.concatenate([np.diff(at, prepend=0), rest.sizes])).take(row)


def split(text: str) -> list[str]:
    """The words of a text: joined by spaces, they are the text. None ends in white space but the last, and none is empty if the text is not.

    At a space behind another character than white space both sides cut: neither a byte-level pattern nor a piece of the
    second vocabulary reaches over such a place.
    """
    spaced = " " + text
    return text.split(" ") if not _UNEVEN.search(spaced) else [w[1:] for w in _PARTED.split(spaced)]


def stretches(text: str, size: int) -> list[str]:
    """A text in stretches of about `size` characters, which spaces join.

    Each is encoded as the text would be there: cuts are made where `split` makes them.
    """
    out, low = [], 0
    while len(text) - low > size:
        cut_at = _CUT.search(text, low + size - 1)
        if cut_at is None:
            break
        out.append(text[low:cut_at.start()])
        low = cut_at.end()
    return [*out, text[low:]]


def _tokens(ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray) -> pd.DataFrame:
    end = np.cumsum(sizes[ids])
    return pd.DataFrame({"unit": unit, "start": end - sizes[ids], "end": end, "id": ids, "at": np.arange(len(ids))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of all pairs of tokens of the two sides that share bytes, once, in order.

    Both frames hold (unit, start), the units laid end to end and both sides covering the same bytes: the token that covers
    a start is the last of its unit to begin there or before.
    """
    under = pd.merge_asof(a[["unit", "start"]], b[["unit", "start", "at"]], on="start", by="unit")["at"].to_numpy(dtype=np.int64)
    over = pd.merge_asof(b[["unit", "start"]], a[["unit", "start", "at"]], on="start", by="unit")["at"].to_numpy(dtype=np.int64)
    n = len(b) + 1
    both = np.concatenate([np.arange(len(a)) * n + under, over * n + np.arange(len(b))])
    both.sort(kind="stable")                         # two sorted runs
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both // n, both % n


class Batch:
    """Groups of a batch of units; every unit's last tokens end together, so no group spans two."""

    def __init__(self, sizes: list[np.ndarray], tokens: list[Ragged]):
        self.a, self.b = (_tokens(t.flat, size, np.repeat(np.arange(len(t.sizes)), t.sizes)) for size, t in zip(sizes, tokens))
        left, right = overlaps(self.a, self.b)
        closing = self.a["end"].to_numpy()[left] == self.b["end"].to_numpy()[right]
        # tokens of each side up to and with every group's last
        self.a_ends, self.b_ends = left[closing] + 1, right[closing] + 1
        self.a_group = np.repeat(np.arange(len(self.a_ends)), np.diff(self.a_ends, prepend=0))
        self.b_group = np.repeat(np.arange(len(self.b_ends)), np.diff(self.b_ends, prepend=0))
        self.unit = self.a["unit"].to_numpy()[self.a_ends - 1]

    def spelt(self, a_words: list[str], b_words: list[str], units: int) -> list[str]:
        """Per unit its groups `a1,a2|b1;a3|b2`; the tables hold each id's number followed by `,` `|` `;` in turn."""
        a_at = np.arange(len(self.a)) + np.concatenate([[0], self.b_ends[:-1]])[self.a_group]
        b_at = np.arange(len(self.b)) + self.a_ends[self.b_group]
        codes = np.empty(len(self.a) + len(self.b), dtype=object)
        a_last, b_last = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        a_last[self.a_ends - 1], b_last[self.b_ends - 1] = 1, 2
        codes[a_at] = a_words[self.a["id"].to_numpy() * 3 + a_last]
        codes[b_at] = b_words[self.b["id"].to_numpy() * 3 + b_last]
        ends = np.searchsorted(self.a["unit"].to_numpy(), np.arange(units), side="right") + np.searchsorted(self.b["unit"].to_numpy(), np.arange(units), side="right")
        codes, out, low = codes.tolist(), [], 0
        for high in ends.tolist():
            out.append("".join(codes[low:high])[:-1])
            low = high
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, pair, n): how often each unit links each pair of ids, sorted. Equal ids of a group are counted before they are paired."""
        ids, groups, counts = [], [], []
        for frame, group in ((self.a, self.a_group), (self.b, self.b_group)):
            key, n = np.unique((group << _B_BITS) | frame["id"].to_numpy(), return_counts=True)
            ids.append(key & ((1 << _B_BITS) - 1))
            groups.append(key >> _B_BITS)
            counts.append(n)
        fan = np.bincount(groups[1], minlength=len(self.unit))
        first = np.cumsum(fan) - fan
        each = fan[groups[0]]
        stops = np.cumsum(each)
        made, low = [], 0
        while low < len(each):
            high = max(low + 1, int(np.searchsorted(stops, (stops[low - 1] if low else 0) + PRODUCT, side="right")))
            size = each[low:high]
            left = np.repeat(np.arange(low, high), size)
            right = np.repeat(first[groups[0][low:high]] - (np.cumsum(size) - size), size) + np.arange(len(left))
            made.append(_summed(self.unit[groups[0][left]], (ids[0][left] << _B_BITS) | ids[1][right], counts[0][left] * counts[1][right]))
            low = high
        return _summed(*(np.concatenate(x) for x in zip(*made))) if len(made) > 1 else made[0]


def _summed(unit: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, unit))
    unit, pair, n = unit[order], pair[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])]))
    return unit[first], pair[first], np.add.reduceat(n, first)


class _Document:
    """What the stretches of one document add up to."""

    def __init__(self):
        self.same, self.sizes, self.hash, self.spelt, self.pairs = True, np.zeros(4, dtype=np.int64), hashlib.sha256(), [], []

    def add(self, sizes, groups: str, pair: np.ndarray, n: np.ndarray, keep: bool) -> None:
        text = groups if not self.sizes[0] else ";" + groups
        self.sizes += sizes
        self.hash.update(text.encode())
        if keep:
            self.spelt.append(text)
        self.pairs.append((pair, n))

    def row(self, keep: bool) -> tuple:
        if not self.same or not self.sizes[0]:
            return 0, 0, 0, 0, "", "" if keep else None, b"", b""
        pair, n = (np.concatenate(x) for x in zip(*self.pairs))
        if len(self.pairs) > 1:
            _, pair, n = _summed(np.zeros(len(pair), dtype=np.int64), pair, n)
        return *self.sizes.tolist(), self.hash.hexdigest(), "".join(self.spelt) if keep else None, pair.astype("<i8").tobytes(), n.astype("<i8").tobytes()


_ALIGNED = "part long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, times binary"


def align(docs: DataFrame, byte_level: str, pieces: str, *, groups: bool = True, chunk_chars: int = CHUNK_CHARS, text: str = "text",
          id_col: str = "doc_id") -> DataFrame:
    """(part, id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, times) for every row of `docs`.

    byte_level and pieces are the files of tokenizer A (byte-level, given space and text) and B (pieces, which puts the
    space itself). groups: `a1,a2|b1;a3|b2,b3`, null unless asked for. pairs and times: the distinct pairs of ids that share a group, as
    64-bit numbers (a, then b in the low 24 bits), and how often. part numbers a chunk of about `chunk_chars` characters
    of one task. Texts that are null, empty, or that a side does not give back byte for byte have no tokens.
    """
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        sent = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))   # some megabytes by nature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoders = Encoders(*sent.value)
        tables = [np.array([f"{i}{end}" for i in range(len(side)) for end in ",|;"], dtype=object) for side in (encoders.a_bytes, encoders.b_bytes)]
        part, chars = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = batch.column(1)
            low = 0
            while low < len(texts):
                held, size, high = [], 0, low
                while high < len(texts) and (not held or size < BLOCK_CHARS):
                    held.append(texts[high].as_py() or "")
                    size += len(held[-1])
                    high += 1
                rows = _aligned(encoders, held, tables, groups)
                kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(held), type=pa.int64()), batch.column(0).slice(low, high - low),
                     *(pa.array(c, type=k) for c, k in zip(zip(*rows), kinds))],
                    ["part", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"])
                low, chars = high, chars + size
                if chars >= chunk_chars:
                    part, chars = part + 1, 0

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, _ALIGNED)


def _aligned(encoders: Encoders, texts: list[str], tables: list[np.ndarray], keep: bool) -> list[tuple]:
    """The rows of some documents; long ones by stretches, which end where both sides' tokens do."""
    found = [_Document() for _ in texts]
    queue = [(d, part) for d, t in enumerate(texts) if t for part in stretches(t, UNIT_CHARS)]
    while queue:
        size = now = 0
        while now < len(queue) and (not now or size < BLOCK_CHARS):
            size += len(queue[now][1])
            now += 1
        units, queue = queue[:now], queue[now:]
        sides, same = encoders.tokens([part for _, part in units])
        for (d, _), ok in zip(units, same):
            found[d].same &= bool(ok)
        rows = np.array([i for i, (d, _) in enumerate(units) if found[d].same], dtype=np.int64)
        if not len(rows):
            continue
        kept = [units[i] for i in rows]
        made = Batch(encoders.sizes, [side.take(rows) for side in sides])
        spelt = made.spelt(*tables, len(kept))
        unit, pair, n = made.links()
        edges = np.searchsorted(unit, np.arange(len(kept) + 1))
        fans = np.bincount(made.a_group) * np.bincount(made.b_group)
        sums = [np.bincount(u, minlength=len(kept)) for u in (made.a["unit"], made.b["unit"], made.unit)]
        sums.append(np.bincount(made.unit, weights=fans, minlength=len(kept)).astype(np.int64))
        for i, (d, _) in enumerate(kept):
            found[d].add(np.array([s[i] for s in sums]), spelt[i], pair[edges[i]:edges[i + 1]], n[edges[i]:edges[i + 1]], keep)
    return [d.row(keep) for d in found]


def _asked(aligned: DataFrame) -> DataFrame:
    """(part, pair, docs): the distinct pairs of each chunk, with the number of its documents that link them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        for batch in batches:
            for part, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part not in held and held:        # files keep chunks together; one that is cut is summed later
                    yield from told(held)
                held[part].append(np.frombuffer(pairs, dtype="<i8"))
        yield from told(held)

    def told(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for part, lists in held.items():
            pair, docs = np.unique(np.concatenate(lists), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), part)), pa.array(pair), pa.array(docs)], ["part", "pair", "docs"])
        held.clear()

    return aligned.select("part", "pairs").mapInArrow(run, "part long, pair long, docs long")


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair is linked, and if no pair of its first id is in more."""
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("count"))
    most = counts.groupBy(F.shiftright("pair", _B_BITS).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, F.shiftright(F.col("pair"), _B_BITS) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


_TOLD = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def link_statistics(docs: DataFrame, byte_level: str, pieces: str, **options) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs`.

    Links are all pairs of tokens of the two sides within a group; a pair of ids counts as many documents (rows) of the
    table as hold it linked. n_best counts the links whose count is the highest of their A id, ties included; count_sum adds the counts
    of all links. Documents without tokens (see `align`) have zeros and an empty hash. Repeated rows are documents of their own,
    null ids stay null. Empty table: empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "aligned")
    align(docs, byte_level, pieces, groups=False, **options).drop("groups").write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    asked = cut(_asked(aligned).groupBy("part", "pair").agg(F.sum("docs").alias("docs")))
    answers = asked.select("part", "pair").join(cut(pair_counts(asked)), "pair").select("part", "pair", "count", "best")

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("pair").to_numpy())
        pair, count, best = (told.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "count", "best"))
        sums = []
        for pairs, times in zip(rows.column("pairs"), rows.column("times")):
            pairs, times = (np.frombuffer(x.as_py(), dtype="<i8") for x in (pairs, times))
            at = np.searchsorted(pair, pairs)
            sums.append((int(times[best[at]].sum()), int((times * count[at]).sum())) if len(at) else (0, 0))
        n_best, count_sum = (pa.array([s[i] for s in sums], type=pa.int64()) for i in (0, 1))
        return pa.table([rows.column("id"), *(rows.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), n_best, count_sum, rows.column("groups_sha256")],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, _TOLD)
