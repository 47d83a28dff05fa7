"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks.

A distributed randomised SVD of the benchmark's TF-IDF passages gives the axes of a latent space. Every document is folded
into it, window by window, and a window whose cosine with a passage reaches COSINE is a candidate for the passage's
item. Words outside the benchmark's vocabulary have no place in that space, so they dilute nothing. Candidates are
confirmed on the words themselves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import kept_rows

RANK, OVERSAMPLE, POWER = 96, 16, 2
COSINE = 0.5                  # between a window and a passage, in the latent space
HELD = 0.4                    # share of a passage's length in that space that a window must reach in its direction
PART = 48                     # words of a benchmark passage at most; longer items have several of like length
SIZES = tuple(range(8, PART + 1, 8))  # passages are searched by the next of these: windows of one and a half times it, half of it apart
LCS = 0.8                     # share of an item's words found in order
PARAPHRASE, ANSWER = 0.6, 0.9  # a looser share, if the item's answer is there nearly word for word
COMMON, RARE = 0.1, 5         # words in more than that share of documents place nothing, but for passages of fewer rarer ones
STRETCH = 1 << 14             # words of a document searched at a time
BLOCK = 1 << 10               # windows compared at a time
BLOCK_CHARS, BLOCK_ROWS = 1 << 17, 1 << 8  # texts searched at a time
PASSAGES = 1_000              # passages of a model, about
SHARD = 400                   # items of a model; larger benchmarks have several
TOGETHER = 8                  # models that one pass over the documents searches: what is broadcast at a time
_WORD = re.compile(r"[^\W_]+")
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))  # ASCII signs become spaces
_SENTENCE = re.compile(r"[.!?]\s+|\n+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, lowered."""
    found = text.lower().encode().translate(_PLAIN).decode().split()
    if text.isascii() or all(map(str.isalnum, found)):
        return found
    return [w for part in found for w in _WORD.findall(part)]


def word_set(text: str) -> set[str]:
    """The different words of a text."""
    return set(words(text))


def blocks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, null ones empty, a bounded number of them and of their characters at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= BLOCK_CHARS or len(some) == BLOCK_ROWS:
            yield some
            some, size = [], 0
    if some:
        yield some


def parts(found: list[str]) -> list[list[str]]:
    """The passages of an item: all of it, or stretches of like length. One of them shares as much as the item does."""
    n = math.ceil(len(found) / PART)
    return [found[len(found) * i // n:len(found) * (i + 1) // n] for i in range(n)]


def answer_of(text: str) -> list[str]:
    """The words of the last sentence that has at least three."""
    for part in reversed(_SENTENCE.split(text)):
        found = words(part)
        if len(found) >= 3:
            return found
    return words(text)


class Pattern:
    """A sequence to be found: where each of its words stands, as bits."""

    def __init__(self, sequence: list[str]):
        self.size, self.where = len(sequence), {}
        for i, w in enumerate(sequence):
            self.where[w] = self.where.get(w, 0) | (1 << i)

    def lcs(self, other: list[str]) -> int:
        """Length of the longest common subsequence, with one machine integer of `size` bits per step."""
        full = (1 << self.size) - 1
        row, get = full, self.where.get
        for w in other:
            m = get(w)
            if m is not None:
                hit = row & m
                row = ((row + hit) | (row - hit)) & full
        return self.size - row.bit_count()


def lcs(a: list[str], b: list[str]) -> int:
    return Pattern(a).lcs(b)


def confirmed(item: Pattern, answer: Pattern, region: list[str]) -> tuple[float, bool] | None:
    """(share of the item found in order, answer found), if that makes the region a copy or a paraphrase."""
    share = item.lcs(region) / item.size
    if share < PARAPHRASE:
        return None
    has_answer = answer.lcs(region) >= ANSWER * answer.size
    return (share, has_answer) if share >= LCS or has_answer else None


def _document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each word of the vocabulary occurs, and how many documents there are: over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = Counter(), 0
        for batch in batches:
            for t in batch.column(0):
                held.update(shared.value.intersection(words(t.as_py() or "")))
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *held], type=pa.string()), pa.array([rows, *held.values()], type=pa.int64())], ["w", "n"])

    found = {r["w"]: r["n"] for r in docs.select("t").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def _summed(passages: DataFrame, step, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all passages of step(columns, values): each task adds up its own, one adds up theirs.

    A shard bounds the matrix. It travels as 32-bit numbers and reaches the driver once.
    """
    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], type=pa.binary())], ["m"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for cols, vals in zip(b.column("cols"), b.column("vals")):
                step(total, np.array(cols.as_py(), dtype=np.int64), np.array(vals.as_py()))
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_py(), dtype=np.float32).reshape(shape)
        yield packed(total)

    rows = passages.mapInArrow(partial, "m binary").repartition(1).mapInArrow(add, "m binary").collect()
    return np.frombuffer(rows[0]["m"], dtype=np.float32).reshape(shape).astype(float)


def latent_axes(passages: DataFrame, width: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (width x rank at most) of the sparse rows (cols, vals), by randomised subspace iteration."""
    size = min(width, rank + OVERSAMPLE)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((width, size)))[0]

    def gram(basis):
        sent = basis.astype(np.float32)

        def step(total, cols, vals):
            total[cols] += vals[:, None] * (vals @ sent[cols])
        return step

    for _ in range(POWER):
        basis = np.linalg.qr(_summed(passages, gram(basis), basis.shape))[0]
    image = _summed(passages, gram(basis), basis.shape)
    values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    keep = [i for i in np.argsort(values)[::-1][:rank] if values[i] > 1e-9 * max(values.max(), 1e-30)]
    return basis @ turn[:, keep]


class Index:
    """What is sent to the executors for one shard of the benchmark: vocabulary, axes and items, bounded by the shard."""

    def __init__(self, items: list[tuple[int, str]], idf: dict[str, float], axes: np.ndarray):
        self.column = {w: i for i, w in enumerate(idf)}
        weights = np.array([*idf.values()])
        # what a word adds to its window's place
        self.places = (weights[:, None] * axes).astype(np.float32)
        self.mass = (weights ** 2).astype(np.float32)
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.patterns = [(Pattern(w), Pattern(answer_of(t))) for w, (_, t) in zip(self.words, items)]
        held: dict[int, list[tuple[int, list[str]]]] = {}
        for i, w in enumerate(self.words):
            for p in parts(w):
                held.setdefault(next(s for s in SIZES if len(p) <= s), []).append((i, p))
        self.groups = [Group(size, found, self) for size, found in sorted(held.items())]

    def candidates(self, found: list[str]) -> set[tuple[int, int, int]]:
        """(item, first word, end) of the windows whose latent cosine with one of the item's passages reaches COSINE.

        Every stretch of a passage's length lies in one of its windows.
        """
        return self.candidates_of([found]).get(0, set())

    def candidates_of(self, held: list[list[str]]) -> dict[int, set[tuple[int, int, int]]]:
        """The same for the words of many texts: by the text's place, for those that have any."""
        begins = np.cumsum([0, *map(len, held)]).tolist()
        get, other = self.column.get, len(self.column)
        cols = np.fromiter(map(get, chain.from_iterable(held), repeat(other)), dtype=np.int64, count=begins[-1])
        rows = np.array([(d, a, at, min(at + STRETCH + 2 * PART, b)) for d, (a, b) in enumerate(zip(begins, begins[1:]))
                         for at in range(a, a + max(1, b - a - 2 * PART), STRETCH)], dtype=np.int64).reshape(-1, 4)
        out: dict[int, set[tuple[int, int, int]]] = {}
        for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(rows[:, 3] - rows[:, 2]) // STRETCH)) + 1):
            text, first, low, high = some.T
            if len(some):
                at, until = low[0], high[-1]
                for row, item, begin, end in self._near(cols[at:until], low - at, high - at):
                    shift = (at - first)[row]
                    for d, *candidate in zip(text[row].tolist(), item.tolist(), (begin + shift).tolist(), (end + shift).tolist()):
                        out.setdefault(d, set()).add(tuple(candidate))
        return out

    def _near(self, cols: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(stretch, item, begin, end) of the windows of the stretches low to high that are near an item's passage."""
        placed = np.flatnonzero(cols != len(self.column))
        if not len(placed):
            return
        upto = np.zeros(len(cols) + 1, dtype=np.int64)         # words with a place before each word
        upto[placed + 1] = 1
        np.cumsum(upto, out=upto)
        held = cols[placed]
        mass = _prefix(self.mass[held])
        for group in self.groups:
            window, apart = group.size * 3 // 2, group.size // 2
            count = -(-np.maximum(1, high - low - window + apart) // apart)
            row = np.repeat(np.arange(len(low)), count)
            begin = low[row] + apart * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            end = np.minimum(begin + window, high[row])
            a, b = upto[begin], upto[end]
            reach = _prefix(group.reach[held])
            some = np.flatnonzero((mass[b] - mass[a] >= group.least) & (reach[b] - reach[a] >= group.bar))
            for k in range(0, len(some), BLOCK):
                at = some[k:k + BLOCK]
                window_at, passage = group.near(self._places(held, a[at], b[at]))
                at = at[window_at]
                yield row[at], group.item_of[passage], begin[at], end[at]

    def _places(self, held: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of windows: the sums over their words a to b."""
        out = np.zeros((len(a), self.places.shape[1]), dtype=np.float32)
        full = np.flatnonzero(b > a)
        if len(full):
            size = (b - a)[full]
            begin = np.cumsum(size) - size
            word = np.arange(size.sum()) + np.repeat(a[full] - begin, size)
            out[full] = np.add.reduceat(self.places[held[word]], begin, axis=0)
        return out

    def hits(self, text: str | None) -> list[tuple[int, float, bool]]:
        """(item, share, answer found) of the items that a whole text holds, the best place of each."""
        found = words(text or "")
        return self.judged(found, self.candidates(found))

    def judged(self, found: list[str], candidates: set[tuple[int, int, int]]) -> list[tuple[int, float, bool]]:
        """(item, share, answer found) of the candidates of a text that are confirmed, the best place of each item.

        A candidate is judged with as many words before and after it as the item has, so one that begins within half of
        that after another adds nothing.
        """
        best: dict[int, tuple[float, bool]] = {}
        judged = (-1, 0)
        for i, at, end in sorted(candidates):
            size = len(self.words[i])
            if i == judged[0] and at <= judged[1] + size // 2:
                continue
            judged = (i, at)
            seen = confirmed(*self.patterns[i], found[max(0, at - size):end + size])
            if seen and seen > best.get(i, (0.0, False)):
                best[i] = seen
        return [(self.ids[i], *s) for i, s in sorted(best.items())]


def _prefix(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each one and, at the end, of all."""
    out = np.zeros(len(values) + 1)
    np.cumsum(values, out=out[1:])
    return out


def hits_of(indexes: list[Index], texts: pa.Array) -> Iterator[list[tuple[int, float, bool]]]:
    """The hits of each text in all indexes."""
    for some in blocks(texts):
        held = [words(t) for t in some]
        near = [(index, index.candidates_of(held)) for index in indexes]
        for d, found in enumerate(held):
            yield [h for index, candidates in near if d in candidates for h in index.judged(found, candidates[d])]


class Group:
    """The passages of like length, as directions in the latent space."""

    def __init__(self, size: int, found: list[tuple[int, list[str]]], index: Index):
        self.size, self.item_of, self.places = size, np.array([i for i, _ in found]), index.places
        latent, held, least = [], [], []
        for _, p in found:
            cols = np.array([index.column[x] for x in p if x in index.column], dtype=np.int64)
            z = index.places[cols].astype(float).sum(axis=0)
            held.append(HELD * np.linalg.norm(z))
            latent.append(z / (np.linalg.norm(z) or 1.0))
            # a confirmed copy lacks at most so many words, so it has the mass of the others at least
            missing = len(p) - math.ceil(PARAPHRASE * len(p) - 1e-9)
            least.append(np.sort(index.mass[cols])[:max(0, len(cols) - missing)].sum(dtype=float))
        self.latent = np.array(latent, dtype=np.float32).T
        self.held = np.maximum(np.array(held, dtype=np.float32), 1e-6)
        self.least = min(least) * (1 - 1e-6)

    @property
    def held(self) -> np.ndarray:
        """How far a window must reach in the direction of each passage."""
        return self._held

    @held.setter
    def held(self, held: np.ndarray) -> None:
        """Sets `reach` with it, the most of that way that each word goes for any passage: those of a near window go all of it."""
        self._held, known = held, (held > 0).all()
        self.reach = (self.places @ (self.latent / held)).max(axis=1).clip(0) if known else np.zeros(len(self.places))
        self.bar = 1 - 1e-3 if known else -math.inf

    def near(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, passage) of every pair whose cosine reaches COSINE, the window reaching HELD of the way to the passage.

        A place at the origin is near nothing.
        """
        size = np.sqrt(np.einsum("ij,ij->i", places, places))
        return np.nonzero(places @ self.latent >= np.maximum((COSINE * size)[:, None], self.held))


def _models(docs: DataFrame, benchmark: DataFrame, item_col: str, text: str) -> Iterator[list[Index]]:
    """The indexes of the benchmark's shards, TOGETHER at a time. Items without words are left out: nothing can hold them."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text).alias("t")).where("t is not null and item is not null")
    n, passages = items.agg(F.count("*"), F.sum(F.ceil(F.size(F.split("t", r"\s+")) / PART))).first()
    shards = max(1, math.ceil(n / SHARD), math.ceil((passages or 0) / PASSAGES))
    rows = docs.select(F.col(text).alias("t"))
    shard = F.pmod(F.xxhash64("item", "t"), F.lit(shards)).cast("int")
    for first in range(0, shards, TOGETHER):
        held: dict[int, list[tuple[int, str]]] = {}
        for r in items.withColumn("shard", shard).where(F.col("shard").between(first, first + TOGETHER - 1)).collect():
            if words(r["t"]):
                held.setdefault(r["shard"], []).append((r["item"], r["t"]))
        if not held:
            continue
        seen, total = _document_frequencies(rows, sorted({w for mine in held.values() for _, t in mine for w in words(t)}))
        yield [_index(spark, sorted(mine), seen, total) for _, mine in sorted(held.items())]


def weights(passages: list[list[str]], seen: dict[str, int], total: int) -> dict[str, float]:
    """The inverse document frequency of every word that has a place.

    Common words tell languages apart, not passages, and have none; a passage with hardly any other word keeps them all.
    """
    rarer = lambda w: seen.get(w, 0) <= COMMON * total
    kept: set[str] = set()
    for p in passages:
        rare = {w for w in p if rarer(w)}
        kept |= rare if len(rare) >= RARE else set(p)
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1e-3 for w in sorted(kept)}


def _index(spark, mine: list[tuple[int, str]], seen: dict[str, int], total: int) -> Index:
    """The model of one shard's items, given in how many documents each word occurs."""
    idf = weights([p for _, t in mine for p in parts(words(t))], seen, total)
    column = {w: i for i, w in enumerate(idf)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [Counter(w for w in p if w in column) for t in b.column(0) for p in parts(words(t.as_py()))]
            vals = [np.array([c * idf[w] for w, c in m.items()]) for m in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[column[w] for w in m] for m in made], type=pa.list_(pa.int32())),
                 pa.array([list(v / (np.linalg.norm(v) or 1.0)) for v in vals], type=pa.list_(pa.float64()))], ["cols", "vals"])

    passages = spark.createDataFrame([(t,) for _, t in mine], "t string").repartition(8).mapInArrow(sparse, "cols array<int>, vals array<double>")
    return Index(mine, idf, latent_axes(passages, len(idf)))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(id, item, share, answer): every pair of a document and a benchmark item that it holds, whole or reworded.

    share is the part of the item's words that the best place has in order: at least 0.8, or at least 0.6 where the
    answer (the item's last sentence) is there too. Null or empty texts hold nothing; null items and items without words
    can't be held. Items of equal text are all reported; repeated rows of a document are reported once each. Empty
    tables: empty result. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    out = None
    for indexes in _models(docs, benchmark, item_col, text):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [(i.as_py(), *h) for i, hits in zip(b.column(0), hits_of(shared.value, b.column(1))) for h in hits]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], type=t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["id", "item", "share", "answer"])

        part = rows.mapInArrow(run, "id long, item long, share double, answer boolean")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "id long, item long, share double, answer boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of `docs` that hold no benchmark item."""
    for indexes in _models(docs, benchmark, item_col, text):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.get_field_index(text)
                yield from kept_rows(b, [not hits for hits in hits_of(shared.value, b.column(at))])

        docs = docs.mapInArrow(run, docs.schema)
    return docs
