"""Language identification: words first, then ever shorter character n-grams for words that were never seen."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.session import cut

WORDS_PER_LANG = 50_000       # size of the model: most frequent words and n-grams of each language
LONGEST = 5                   # characters of the longest n-gram
MOST_LANGS = 256
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000
_CACHE = 100_000


def tokens(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    line = f"<{word}>"
    return [line[i:i + n] for i in range(len(line) - n + 1)]


def _rows(counts: dict[str, Counter]) -> pa.RecordBatch:
    flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                      ["lang", "item", "n"])


def _size(held: dict[str, Counter]) -> int:
    return sum(map(len, held.values()))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language, added up in the task before they are sent on; memory is bounded by the flush."""
    held: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            held.setdefault(lang.as_py(), Counter()).update(tokens(text.as_py()))
            if _size(held) > _FLUSH:
                yield _rows(held)
                held = {}
    yield _rows(held)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    for b in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
            counts = held.setdefault(lang, Counter())
            for k in range(1, LONGEST + 1):
                for g in grams(word, k):
                    counts[g] += n
            if len(counts) > _FLUSH:
                yield _rows(held)
                held = {}
    yield _rows(held)


class Model:
    """Log frequencies per language, one row per known word and per known n-gram."""

    def __init__(self, langs: list[str], words: list[tuple[str, str, int]], parts: list[tuple[str, str, int]],
                 totals: dict[str, int], longest: int = LONGEST):
        self.langs, self.longest = langs, longest
        self.words, self.word_rows = self._table(words, lambda lang, item: totals.get(lang, 0))
        sums: dict[tuple[str, int], int] = Counter()
        for lang, g, n in parts:
            sums[lang, len(g)] += n
        self.parts, self.part_rows = self._table(parts, lambda lang, item: sums[lang, len(item)])

    def _table(self, entries, total) -> tuple[dict[str, int], np.ndarray]:
        at = {item: i for i, item in enumerate(dict.fromkeys(e[1] for e in entries))}
        column = {lang: i for i, lang in enumerate(self.langs)}
        rows = np.array([[math.log(0.5 / (total(lang, item) + 1)) for lang in self.langs] for item in at],
                        dtype=np.float32).reshape(len(at), len(self.langs))
        for lang, item, n in entries:
            rows[at[item], column[lang]] = math.log((n + 0.5) / (total(lang, item) + 1))
        return at, rows

    def unseen(self, word: str) -> np.ndarray:
        """Mean of the longest known n-grams of a word."""
        for k in range(min(self.longest, len(word) + 2), 0, -1):
            found = [r for r in map(self.parts.get, grams(word, k)) if r is not None]
            if found:
                return self.part_rows[found].sum(axis=0) / len(found)
        return np.zeros(len(self.langs), dtype=np.float32)


class Reader:
    """Predictions of one task: the model's words, and a bounded memory of unseen ones behind them."""

    def __init__(self, model: Model, room: int = _CACHE):
        self.model, self.known, self.room = model, len(model.words), room
        self.rows = np.vstack([model.word_rows, np.zeros((room, len(model.langs)), dtype=np.float32)])
        self.memory: dict[str, int] = {}

    def _row(self, word: str) -> int:
        at = self.memory.get(word)
        if at is None:
            at = self.known + len(self.memory)
            self.memory[word] = at
            self.rows[at] = self.model.unseen(word)
        return at

    def _sum(self, found: list[str]) -> np.ndarray:
        get, total = self.model.words.get, np.zeros(len(self.model.langs))
        for i in range(0, len(found), self.room):
            part = found[i:i + self.room]
            if len(self.memory) + len(part) > self.room:
                self.memory = {}
            at = list(map(get, part))
            if None in at:
                at = [self._row(w) if a is None else a for w, a in zip(part, at)]
            total += self.rows[at].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        found, langs = tokens(text or ""), self.model.langs
        if not langs or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        line = self._sum(found) / len(found) * min(len(found), 24)       # longer texts don't push every score to 1
        odds = np.exp(line - line.max())
        best = int(np.argmax(line))
        return langs[best], float(odds[best] / odds.sum())


def _most(counts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(F.desc("n"), "item")
    return counts.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= limit).drop("_at")


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang", size: int = WORDS_PER_LANG) -> Model:
    """Counts all words and n-grams of the rows with text and language; keeps the `size` most frequent per language.

    The kept entries are what is broadcast: `size` words and `size` n-grams of each length at most, per language.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("t")).where("lang is not null and t is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    counts = cut(rows.mapInArrow(_count_words, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    parts = counts.mapInArrow(_count_grams, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = [tuple(r) for r in _most(counts.where("n > 1"), ["lang"], size).collect()]
    kept = _most(parts.where("n > 1").withColumn("_k", F.length("item")), ["lang", "_k"], size // LONGEST)
    return Model(langs, words, [tuple(r) for r in kept.select("lang", "item", "n").collect()], totals)


def identify(docs: DataFrame, model: Model, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) for every row: the language whose words fit best, and its share of the odds.

    Null text, or text without a letter: `und`, score 0; also if nothing was learnt. Equal fits: the first language by
    name. Repeated rows and null ids are rows like any other; other columns are not looked at. Empty table: empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            made = [reader.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], type=pa.string()),
                                              pa.array([m[1] for m in made], type=pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, "id long, lang_pred string, score double")
