"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.common import kept_rows
from vicinage.session import cut

# Insults by theme; each theme is one voter.
LEXICONS = {
    "wits": {"idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "clown"},
    "worth": {"loser", "losers", "worthless", "pathetic", "useless", "failure"},
    "filth": {"trash", "scum", "garbage", "disgusting", "filth", "filthy", "vermin", "pig"},
    "threat": {"kill", "hate", "die", "hurt", "shut", "damn", "hell"},
}
GROUPS = 6                    # voters made of mined terms, each of terms that keep company in toxic texts
TERMS = 2_000                 # mined terms at most: the classifier's width and what is broadcast
SAMPLE = 40_000               # rows the classifier is fitted on, at most, by hash: half of them labelled, half any
MINED_IDS = 100_000           # labelled ids whose texts terms are mined from, at most, by hashed id: what is broadcast there
PREFIXES = (4, 5, 6, 7)
MIN_TOXIC = 3
CONFIDENCE = 3.0              # standard errors by which a mined term's log odds must exceed zero
COMPANY = 0.5                 # share of a term's toxic texts that must hold terms of a group for it to join
CONTEXT, IN_CONTEXT = 12, 4   # ordinary words that tell where a group has a say, and how many of them a text must hold
CUTS = [2.0 ** (-k / 2) for k in range(2, 24)]   # shares of words that may part a group's sparse from its dense votes
ABSTAIN, SILENT, SPARSE, DENSE = range(4)
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}|\b[A-Z]{4,}!")
_FLUSH = 200_000
ROUNDS = 25
MODEL_ROWS = 4                # labelled rows that the label model's view of a pattern is worth


def terms(text: str, prefixes: tuple[int, ...] = PREFIXES) -> set[str]:
    """The words of a text and their beginnings (`lowe*`), each once."""
    words = set(_WORD.findall(text.lower()))
    made = {f"{w[:k]}*" for w in words for k in prefixes if len(w) > k}
    return words | made


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (Counter(), Counter())

    def out():
        names = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array([held[1][n] for n in names], type=pa.int64()),
                                           pa.array([held[0][n] for n in names], type=pa.int64())], ["term", "toxic", "clean"])
    for b in batches:
        for text, y in zip(b.column(0), b.column(1)):
            held[y.as_py()].update(terms(text.as_py()))
            if len(held[0]) + len(held[1]) > _FLUSH:
                yield out()
                held = (Counter(), Counter())
    yield out()


def mine_terms(labelled: DataFrame, limit: int = TERMS) -> list[tuple[str, float]]:
    """Terms that mark toxic rows, (term, lower bound of its log odds), strongest first. labelled: (t, y), no nulls.

    All rows given are counted; `limit` bounds the terms kept.
    """
    sizes = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = labelled.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") >= MIN_TOXIC)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    error = F.sqrt(1.0 / (F.col("a") + 0.5) + 1.0 / (F.col("b") + 0.5))
    strong = counts.select("term", (odds - CONFIDENCE * error).alias("low")).where("low > 0")
    return [tuple(r) for r in strong.orderBy(F.desc("low"), "term").limit(limit).collect()]


@dataclass
class Group:
    """A voter of mined terms: where it has a say, and from which share of a text's words on its vote is a dense one."""

    context: frozenset[str] = frozenset()
    cut: float = CUTS[0]


@dataclass
class Voters:
    """Lexicons and a pattern, which fire or abstain, and groups of mined terms, which also vote a text of theirs clean."""

    mined: dict[str, int]                              # term -> its column among the mined terms
    of: list[int] = field(default_factory=list)        # column -> its group
    groups: list[Group] = field(default_factory=list)

    def __post_init__(self):
        self._whole = {t: c for t, c in self.mined.items() if not t.endswith("*")}
        self._begun = [(k, {t[:-1]: c for t, c in self.mined.items() if t.endswith("*") and len(t) == k + 1}) for k in PREFIXES]

    @property
    def bits(self) -> list[int]:
        """Width of each voter's vote in a pattern."""
        return [1] * (len(LEXICONS) + 1) + [2] * len(self.groups)

    @property
    def names(self) -> list[str]:
        """A feature for every vote that is no abstention."""
        return [*LEXICONS, "shouting", *(f"group {g} {level}" for g in range(len(self.groups)) for level in ("silent", "sparse", "dense"))]

    def hits(self, text: str) -> tuple[list[str], set[str], list[int], list[set[str]]]:
        """(words, different words, columns of the terms met, the words that met them by group)."""
        words = _WORD.findall(text.lower())
        found = set(words)
        met = [(w, self._whole[w]) for w in self._whole.keys() & found]
        for k, begun in self._begun:
            begins = begun.keys() & {w[:k] for w in found if len(w) > k}
            if begins:
                met += [(w, begun[w[:k]]) for w in found if len(w) > k and w[:k] in begins]
        by_group: list[set[str]] = [set() for _ in self.groups]
        for word, column in met:
            if self.of:
                by_group[self.of[column]].add(word)
        return words, found, sorted({c for _, c in met}), by_group

    def read(self, text: str) -> tuple[int, list[int], list[int]]:
        """Votes as bits of one number, the features they set, and the columns of the mined terms that occur."""
        words, found, columns, by_group = self.hits(text)
        votes = [not found.isdisjoint(lexicon) for lexicon in LEXICONS.values()] + ["!" in text and bool(_SHOUT.search(text))]
        features, pattern, shift = [i for i, fired in enumerate(votes) if fired], sum(1 << i for i, fired in enumerate(votes) if fired), len(votes)
        for g, (group, met) in enumerate(zip(self.groups, by_group)):
            if met:
                vote = DENSE if share_of(words, met) >= group.cut else SPARSE
            else:
                vote = SILENT if len(found & group.context) >= IN_CONTEXT else ABSTAIN
            if vote:
                features.append(len(votes) + 3 * g + vote - 1)
            pattern |= vote << shift
            shift += 2
        return pattern, features, columns


def share_of(words: list[str], met: set[str]) -> float:
    return sum(w in met for w in words) / len(words)


def grouped(rows: list[list[int]], n_terms: int, most: int = GROUPS) -> list[int]:
    """The group of every term: from the commonest down, a term joins the group whose terms its toxic texts mostly hold, or founds one.

    rows: the terms of each toxic text. Once there are `most` groups, terms join the one they share most texts with.
    """
    where: list[set[int]] = [set() for _ in range(n_terms)]
    for i, columns in enumerate(rows):
        for c in columns:
            where[c].add(i)
    covered: list[set[int]] = []
    of = [0] * n_terms
    for c in sorted(range(n_terms), key=lambda c: (-len(where[c]), c)):
        texts = where[c]
        shared = [len(texts & own) for own in covered]
        best = max(range(len(covered)), key=shared.__getitem__, default=None)
        if best is None or (shared[best] < COMPANY * len(texts) and len(covered) < most):
            covered.append(set())
            best = len(covered) - 1
        covered[best] |= texts
        of[c] = best
    return of


class LabelModel:
    """Generative model of the votes: P(vote | toxic or not) per voter, by expectation maximisation over counts of vote patterns.

    Labelled rows keep their label in every round, and what the model believes of a pattern's other rows is weighed, as `MODEL_ROWS`
    labelled rows, against those labels. An abstention is no evidence. Voters that agree beyond what the class explains are correlated; their evidence is shared out instead of
    counted in full again. `bits`: each voter's width in a pattern, or the number of voters of one bit; `abstains`: if a voter's 0 is an
    abstention.
    """

    def __init__(self, bits: int | list[int], patterns: np.ndarray, seen: np.ndarray, toxic: np.ndarray, clean: np.ndarray, abstains: bool = False):
        self.bits, self.abstains = [1] * bits if isinstance(bits, int) else bits, abstains
        votes = self._votes(patterns)
        other = np.maximum(0, seen - toxic - clean)
        known = toxic + clean
        share = (toxic.sum() + 1) / (known.sum() + 2)
        belief = np.where(known > 0, (toxic + share) / (known + 1), np.where((votes > 0).any(axis=1), 0.5, 0.05))
        self.share = np.ones(len(self.bits))
        for _ in range(ROUNDS):
            weights = (clean + other * (1 - belief), toxic + other * belief)
            self.prior = float(np.clip(weights[1].sum() / max(1.0, seen.sum()), 1e-4, 0.9))
            self.rate = []
            for v, width in enumerate(self.bits):
                counts = np.stack([np.bincount(votes[:, v], w, minlength=1 << width) + 0.05 for w in weights])
                self.rate.append(np.clip(counts / counts.sum(axis=1, keepdims=True), 1e-6, 1 - 1e-6))
            self.share = 1.0 / (1.0 + self._correlation(self._evidence(votes), weights))
            belief = self.believed(patterns, toxic, clean)
        for_toxic = [r[1] > r[0] for r in self.rate]
        self.accuracy = np.array([self.prior * r[1][t].sum() + (1 - self.prior) * r[0][~t].sum() for r, t in zip(self.rate, for_toxic)])

    def believed(self, patterns: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """The posterior of patterns whose labelled rows are known."""
        return (toxic + MODEL_ROWS * self.posterior(patterns)) / (toxic + clean + MODEL_ROWS)

    def _votes(self, patterns: np.ndarray) -> np.ndarray:
        shifts = np.cumsum([0, *self.bits[:-1]])
        return (np.asarray(patterns)[:, None] >> shifts) & ((1 << np.array(self.bits)) - 1)

    def _evidence(self, votes: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of each vote."""
        out = np.stack([np.log(r[1] / r[0])[votes[:, v]] for v, r in enumerate(self.rate)], axis=1)
        return np.where((votes == ABSTAIN) & self.abstains, 0.0, out)

    def _correlation(self, evidence: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Per voter, the sum of the positive correlations of its evidence with the others', averaged over both classes."""
        total = np.zeros(evidence.shape[1])
        for w, of_class in zip(weights, (1 - self.prior, self.prior)):
            centred = evidence - (w @ evidence) / max(1e-9, w.sum())
            cov = (centred * w[:, None]).T @ centred / max(1e-9, w.sum())
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.clip(cov / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(corr, 0)
            total += of_class * corr.sum(axis=1)
        return total

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        z = math.log(self.prior / (1 - self.prior)) + self._evidence(self._votes(patterns)) @ self.share
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray       # votes, then mined terms
    bias: float

    def score(self, text: str | None) -> float:
        _, features, columns = self.voters.read(text or "")
        n = len(self.voters.names)
        z = self.bias + sum(self.weights[i] for i in features) + sum(self.weights[n + c] for c in columns)
        return 1.0 / (1.0 + math.exp(-min(40.0, max(-40.0, float(z)))))


def _fit_linear(rows: list[list[int]], target: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam; the rows are the features that are set."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], dtype=np.int64)
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    for step in range(1, 401):
        z = np.bincount(at, w[col], minlength=len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(rows)
        grad = np.append(np.bincount(col, error[at], minlength=width), error.sum()) + 1e-5 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = w - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w[:-1], float(w[-1])


def _tallies(labelled: DataFrame, voters: Voters) -> list:
    """(kind, group, key, y, n): of toxic texts the ordinary words by their strongest group, of all the shares of words that are a group's."""
    shared = labelled.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, found, _, by_group = shared.value.hits(text)
                shares = [share_of(words, met) if met else 0.0 for met in by_group]
                for g, x in enumerate(shares):
                    if x:
                        held["share", g, str(sum(x < c for c in CUTS)), y] += 1
                if y and any(shares):
                    g = max(range(len(shares)), key=shares.__getitem__)
                    held.update(("word", g, w, 1) for w in found - by_group[g])
            if len(held) > _FLUSH:
                yield made(held)
                held = Counter()
        yield made(held)

    def made(held: Counter) -> pa.RecordBatch:
        kind, group, key, y = zip(*held) if held else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kind, type=pa.string()), pa.array(group, type=pa.int32()), pa.array(key, type=pa.string()),
                                           pa.array(y, type=pa.int32()), pa.array(list(held.values()), type=pa.int64())], ["kind", "g", "key", "y", "n"])

    summed = labelled.mapInArrow(run, "kind string, g int, key string, y int, n long").groupBy("kind", "g", "key", "y").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("g").orderBy(F.desc("n"), "key")
    words = summed.where("kind = 'word'").withColumn("place", F.row_number().over(place)).where(F.col("place") <= CONTEXT).drop("place")
    return words.unionByName(summed.where("kind = 'share'")).collect()


def _voters(labelled: DataFrame, terms_kept: int) -> Voters:
    """Mine terms from labelled texts (t, y) and make voters of those that keep company."""
    found = mine_terms(labelled, terms_kept)
    plain = Voters({t: i for i, (t, _) in enumerate(found)})
    if not found:
        return plain
    shared = labelled.sparkSession.sparkContext.broadcast(plain)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.hits(t)[2] for t in b.column(0).to_pylist()], type=pa.list_(pa.int32()))], ["c"])

    toxic = [r["c"] for r in labelled.where("y = 1").select("t").mapInArrow(columns, "c array<int>").collect()]
    of = grouped(toxic, len(found))
    voters = Voters(plain.mined, of, [Group() for _ in range(max(of) + 1)])
    told = _tallies(labelled, voters)
    for g in range(len(voters.groups)):
        by_cut = np.zeros((2, len(CUTS) + 1))
        for r in told:
            if r["kind"] == "share" and r["g"] == g:
                by_cut[r["y"], int(r["key"])] += r["n"]
        dense = np.cumsum(by_cut, axis=1)[:, :-1]      # rows at or above each cut
        gain = dense[1] / max(1.0, by_cut[1].sum()) - dense[0] / max(1.0, by_cut[0].sum())
        voters.groups[g] = Group(frozenset(r["key"] for r in told if r["kind"] == "word" and r["g"] == g), CUTS[int(np.argmax(gain))])
    return voters


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
          terms_kept: int = TERMS, sample: int = SAMPLE, mined_ids: int = MINED_IDS) -> Classifier:
    """Learn from `docs` and the 0/1 `label` of `labels`, joined by id; rows with null ids, texts or labels don't teach.

    Terms are mined from the rows of at most `mined_ids` labelled ids, the smallest by hash; these ids are broadcast, so
    texts stay where they are, and the terms of their toxic texts are what is grouped on the driver. The label model is estimated from
    the vote patterns of all rows of `docs`, counted on the executors; there are at most 2 ** 17. The linear classifier is fitted to
    at most `sample` rows, the smallest by hashed id and text, half of them labelled: a labelled row's target is its
    label, any other's the posterior of its votes. Without labelled toxic rows the lexicons alone decide.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("t")).where("t is not null")
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("y"))
    here = known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    teachers = here.orderBy(F.xxhash64("_id"), "_id").limit(mined_ids)
    voters = _voters(cut(rows.join(F.broadcast(teachers), "_id").select("t", "y")), terms_kept)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value.names)
        for b in batches:
            made = [shared.value.read(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([m[0] for m in made], type=pa.int64()),
                                              pa.array([[*m[1], *(n + c for c in m[2])] for m in made], type=pa.list_(pa.int32()))],
                                             ["_id", "h", "votes", "features"])

    # votes meet the labels, not texts: no text moves between executors
    read_all = rows.select("_id", "t", F.xxhash64("_id", "t").alias("h")).mapInArrow(
        vote, f"_id {dict(rows.dtypes)['_id']}, h long, votes long, features array<int>")
    votes = cut(read_all.join(known, "_id", "left").select("h", "y", "votes", "features"))
    counts = votes.groupBy("votes").agg(F.count("*").alias("n"), F.count(F.when(F.col("y") == 1, 1)).alias("a"),
                                        F.count(F.when(F.col("y") == 0, 1)).alias("b")).collect()
    pattern, seen, a, b = (np.array([r[k] for r in counts], dtype=np.int64) for k in ("votes", "n", "a", "b"))
    if not len(pattern):
        pattern, seen, a, b = np.zeros(1, dtype=np.int64), np.ones(1), np.zeros(1), np.zeros(1)
    model = LabelModel(voters.bits, pattern, seen, a, b, abstains=True)
    first = lambda some: some.orderBy("h", "votes").limit(sample // 2).select("y", "votes", "features").collect()
    fitted = first(votes.where("y is not null")) + first(votes)
    belief = dict(zip(pattern.tolist(), model.believed(pattern, a, b)))
    target = np.array([belief[r["votes"]] for r in fitted] or [0.0])
    own = np.array([np.nan if r["y"] is None else r["y"] for r in fitted] or [np.nan], dtype=float)
    target = np.where(np.isnan(own), target, np.nan_to_num(own))
    weights, bias = _fit_linear([r["features"] for r in fitted] or [[]], target, len(voters.names) + len(voters.mined))
    return Classifier(voters, weights, bias)


def score(docs: DataFrame, model: Classifier, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted) for every row; the score reads the whole text only.

    Null and empty texts get the score of a text without any vote. Repeated rows and null ids are rows like any other.
    Empty table: empty result. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shared.value.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, type=pa.float64()),
                                              pa.array([int(s >= 0.5) for s in made], type=pa.int32())], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, "id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Classifier, *, text: str = "text") -> DataFrame:
    """The rows of `docs` that the classifier does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            yield from kept_rows(b, [shared.value.score(t.as_py()) < 0.5 for t in b.column(at)])

    return docs.mapInArrow(run, docs.schema)
