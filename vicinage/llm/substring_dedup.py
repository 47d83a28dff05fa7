"""Substring dedup with suffix automata of reference shards, through which documents are streamed.

`match_reference` broadcasts the automata of an outside reference, shard by shard. When the documents are their own
reference, the shards can't be broadcast: they grow with the data, and every document would meet every shard. There each
shard is sent to where its documents are instead: a window of 20 words always has the same minimiser, so all windows that
could be equal meet in one shard, whose automaton is built as its earlier pieces have streamed past.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm import common
from vicinage.llm.common import NULL_ID, Rolling, Scratch, keyed, merged, span_of
from vicinage.session import cut

LENGTH = 20                   # words of a match
GRAM = 5                      # words of a minimiser
HOT = 4_096                   # different surroundings of one minimiser that an automaton holds; more go by shuffle
SHARD_WORDS = 200_000         # words of a broadcast automaton


class SuffixAutomaton:
    """All substrings of the sequences added so far. Sequences are kept apart: no substring spans two."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:                        # a sequence before this one went the same way
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][symbol]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, symbol, known)
        return new

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, symbol: int, known: int) -> int:
        twin = self._state(self.length[at] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = twin
        while at >= 0 and self.next[at].get(symbol) == known:
            self.next[at][symbol] = twin
            at = self.link[at]
        return twin

    def statistics(self, sequence) -> Iterator[int]:
        """Per position, the length of the longest stretch ending there that the automaton holds."""
        state = size = 0
        edges, link, length = self.next, self.link, self.length
        for symbol in sequence:
            while state and symbol not in edges[state]:
                state = link[state]
                size = length[state]
            if symbol in edges[state]:
                state, size = edges[state][symbol], size + 1
            yield size

    def covered(self, sequence, least: int) -> list[tuple[int, int]]:
        """Maximal spans of the sequence made of held stretches of at least `least` symbols."""
        return merged([(i + 1 - size, i + 1) for i, size in enumerate(self.statistics(sequence)) if size >= least])


def _hashed(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column, and where each row's begin."""
    data, offsets = common.buffer_of(texts)
    start, end = common.word_bounds(data, offsets)
    return common.word_hashes(data, start, end), np.searchsorted(start, offsets)


def match_reference(docs: DataFrame, reference: DataFrame, *, length: int = LENGTH, shard_words: int = SHARD_WORDS,
                    text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, spans): word spans of each row that consist of stretches of `length` words or more of the reference texts.

    The reference is cut into shards of at most `shard_words` words plus one text; each shard's automaton is broadcast and
    all documents stream through it. The work grows with documents times shards: meant for a bounded reference. Null
    texts match nothing; rows without a match have no spans; an empty reference gives no row a span.
    """
    spark = docs.sparkSession
    shards: list[SuffixAutomaton] = []
    size = shard_words
    for row in reference.select(F.col(text).alias("t")).where("t is not null").toLocalIterator():
        hashes, _ = _hashed(pa.array([row["t"]]))
        if size + len(hashes) > shard_words:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(hashes.tolist())
        size += len(hashes)
    sent = [spark.sparkContext.broadcast(s) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, at = _hashed(batch.column(1))
            spans = []
            for a, b in zip(at[:-1], at[1:]):
                row = hashes[a:b].tolist()
                spans.append([list(s) for s in merged([s for shard in sent for s in shard.value.covered(row, length)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=pa.list_(pa.list_(pa.int64())))], ["id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, "id long, spans array<array<long>>")


def word_pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, piece, d, tag, pack) of every piece of every text; docs: (_d, _tag, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            hashes, at = _hashed(batch.column(2))
            for made in common.pieces_of(hashes, at, d, tag, length, gram, common.BLOCK_WORDS):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made[:5]], ["key", "piece", "d", "tag", "pack"])

    return docs.mapInArrow(run, "key long, piece long, d long, tag long, pack long")


_SPANS = "d long, tag long, a long, b long"


def _streamed(bodies: DataFrame, length: int) -> DataFrame:
    """Spans of each body that occur in an earlier body of its key. bodies: (key, d, tag, pack, body) in that order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, seen = None, SuffixAutomaton(), None
        for batch in batches:
            out = []
            for k, d, tag, pack, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, d, tag, pack) == seen:        # a repeated row is the same place
                    continue
                seen = (k, d, tag, pack)
                words = np.frombuffer(body, dtype=np.int64).tolist()
                if k != key:
                    key, automaton = k, SuffixAutomaton()
                else:
                    start = common.pack_start(pack)
                    out += [(d, tag, start + a, start + b) for a, b in automaton.covered(words, length)]
                automaton.add(words)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.int64()) for i in range(4)], ["d", "tag", "a", "b"])

    return bodies.mapInArrow(run, _SPANS)


def _exploded(bodies: DataFrame, length: int) -> DataFrame:
    """The same for minimisers with very many bodies: the first place of every window, by partial minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, d, tag, pack = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            body = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint64)
            count = common.pack_count(pack)
            row = np.repeat(np.arange(len(key)), count)
            j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = (np.cumsum(count + length - 1) - (count + length - 1))[row] + j
            h = common.mix(Rolling(body).of(at, at + length) ^ common.mix(key.view(np.uint64))[row])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), d[row], tag[row], common.pack_start(pack)[row] + j)],
                                             ["h", "d", "tag", "a"])

    windows = bodies.mapInArrow(run, "h long, d long, tag long, a long")
    first = windows.groupBy("h").agg(F.min(F.struct("d", "tag", "a")).alias("first"), F.count("*").alias("c")).where("c > 1").select("h", "first")
    return windows.join(first, "h").where(F.struct("d", "tag", "a") > F.col("first")).select("d", "tag", "a", (F.col("a") + length).alias("b"))


def later_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(d, tag, a, b): stretches of words covered by windows of `length` words that also start earlier.

    docs: as `common.keyed` makes it. Earlier: a smaller id, or the same document and a smaller place. Rows of one id and
    one text are the same document; of rows of one id with different texts, that with the smaller hash of the text is the earlier one.
    """
    scratch = Scratch(docs.sparkSession)
    made = word_pieces(docs, length, gram)
    # joins follow written tables, not aggregations, so that adaptive execution can split a hot key
    often = cut(made.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    again = scratch.keep("again", made.join(often, "key"))
    groups = scratch.keep("groups", again.groupBy("key", "piece").agg(F.min(F.struct("d", "tag", "pack")).alias("first"), F.count("*").alias("n")))
    later = again.join(groups.where("n > 1").select("key", "piece", "first"), ["key", "piece"]).where(F.struct("d", "tag", "pack") > F.col("first"))
    copies = scratch.keep("copies", later.selectExpr(*span_of(length)))
    scratch.drop("again")
    varied = cut(groups.groupBy("key").agg(F.count("*").alias("v")).where("v > 1"))
    shown = groups.join(varied, "key").selectExpr("key", "v", "first.d AS d", "first.tag AS tag", "first.pack AS pack")
    per_doc = shown.groupBy("d", "tag").agg(F.collect_list(F.struct("key", "v", "pack")).alias("want"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, at = _hashed(batch.column(2))
            want = batch.column(3)
            item = want.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(want.offsets.to_numpy()))
            pack = item.field("pack").to_numpy()
            begin = at[row] + common.pack_start(pack)
            end = begin + common.pack_count(pack) + length - 1
            body = [hashes[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
            d, tag = (batch.column(i).take(pa.array(row)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([item.field("key"), d, tag, item.field("pack"), pa.array(body, type=pa.binary()), item.field("v")],
                                             ["key", "d", "tag", "pack", "body", "v"])

    texts = docs.join(per_doc, (F.col("_d") == F.col("d")) & (F.col("_tag") == F.col("tag"))).select("d", "tag", "text", "want")
    bodies = scratch.keep("bodies", texts.mapInArrow(extract, "key long, d long, tag long, pack long, body binary, v long"))
    scratch.drop("groups")
    own = ["key", "d", "tag", "pack", "body"]
    few = bodies.where(F.col("v") <= hot).select(*own).repartition("key").sortWithinPartitions(*own[:4])
    many = bodies.where(F.col("v") > hot).select(*own)
    found = cut(copies.unionByName(_streamed(few, length)).unionByName(_exploded(many, length)))
    scratch.drop("copies", "bodies")
    return found


def remove_later(docs: DataFrame, **options) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_sha256) for every row of `docs` (doc_id, text).

    Removes every word covered by a window of `length` words whose sequence also starts earlier: in a document of a
    smaller id, or earlier in the same one. Windows are judged on the input. spans lists the maximal removed runs of
    words as [start, end); the hash is that of the kept words joined by one space. Words are what spaces, tabs and line
    breaks part, unchanged. Null text has no words. A null id counts as the smallest. A repeated row loses what its first
    one loses. Empty table: empty result. Other columns are not looked at.
    """
    base = keyed(docs)
    spans = later_spans(base, **options).groupBy("d", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = base.join(spans, (F.col("_d") == F.col("d")) & (F.col("_tag") == F.col("tag")), "left").select("_d", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                words, kept, at = text.as_py().split(), [], 0
                cuts = merged([(s["a"], s["b"]) for s in found.as_py() or ()])
                for a, b in cuts:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), [list(c) for c in cuts], hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds))],
                                             ["id", "n_words", "n_removed", "spans", "kept_sha256"])

    made = joined.mapInArrow(run, "id long, n_words long, n_removed long, spans array<array<long>>, kept_sha256 string")
    return made.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
