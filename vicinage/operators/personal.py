"""Ranking for profiles: scores per answer signature, similar-title collapse, slots under quotas.

A score depends on a listing only through its categories, ages, canton and price, and on a profile
only through its answers. So scores are computed per pair of distinct signatures, never per user and
listing: the number of signatures is set by the option tables and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import profiles as P
from ..config.regions import NEIGHBOURS
from ..functions import match
from ..session import cut
from .ranking import first_per

ANSWERS = ["persona", "interests", "child_age_groups", "preferred_cantons", "near_cantons", "budget"]
TRAITS = ["canton", "interest_hits", "age_hits", "price_step"]
FIRST_LOOK, WIDER = 256, 4   # rows a set of answers looks at first beyond those of its first cantons, and how many times as many next
PRICE_STEPS = [-1.0, 0.0, 15.0, 30.0, 1e9]


def answers_key() -> Column:
    """A profile's answers as one comparable text."""
    return F.to_json(F.struct(*ANSWERS))


def with_neighbours(profiles: DataFrame, neighbours: dict[str, list[str]] = NEIGHBOURS) -> DataFrame:
    """Profiles with the cantons that border the preferred ones, from the fixed adjacency."""
    return profiles.withColumn("near_cantons", match.neighbour_cantons(F.col("preferred_cantons"), neighbours))


def with_neighbours_from(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """The same from an adjacency table (src, dst)."""
    wanted = profiles.select(F.explode("preferred_cantons").alias("src")).distinct()
    beside = wanted.join(edges, "src").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))
    # Distinct answers, not users, meet the edges.
    sets = profiles.select("preferred_cantons").distinct()
    near = (sets.select("preferred_cantons", F.explode("preferred_cantons").alias("src")).join(beside, "src")
            .select("preferred_cantons", F.explode("dsts").alias("dst"))
            .groupBy("preferred_cantons").agg(F.array_sort(F.collect_set("dst")).alias("near_cantons")))
    none = F.array().cast("array<string>")
    return profiles.join(near, "preferred_cantons", "left").withColumn("near_cantons", F.coalesce("near_cantons", none))


def listing_traits() -> dict[str, Column]:
    """What a score can see of a listing: interests it serves, child ages it meets, its price step."""
    interests = F.array_compact(F.array(*[
        F.when(F.arrays_overlap("category", F.array(*[F.lit(c) for c in cats])), F.lit(name))
        for name, cats in P.INTEREST_CATEGORIES.items()]))
    ages = F.array_compact(F.array(*[
        F.when((F.coalesce("age_max", F.lit(99)) >= match.group_bounds(F.lit(g))["low"])
               & (F.coalesce("age_min", F.lit(0)) <= match.group_bounds(F.lit(g))["high"]), F.lit(g))
        for g in P.CHILD_AGE_GROUPS]))
    price = F.col("price_adult")
    step = F.when(price < 0, F.lit(PRICE_STEPS[0]))
    for limit in PRICE_STEPS[1:-1]:
        step = step.when(price <= limit, F.lit(limit))
    return {"interest_hits": interests, "age_hits": ages, "price_step": step.when(price.isNotNull(), F.lit(PRICE_STEPS[-1]))}


def listing_signatures(listings: DataFrame) -> DataFrame:
    """(signature, traits, n): the distinct signatures with a number that follows from the traits, and how many listings
    have each. Everything that scores works on these alone."""
    return listings.withColumns(listing_traits()).groupBy(*TRAITS).agg(F.count("*").alias("n")) \
        .withColumn("signature", F.xxhash64(*TRAITS))


def answer_sets(profiles: DataFrame) -> DataFrame:
    """Distinct sets of answers with a short id (`answers`); skipped profiles have none."""
    return cut(profiles.filter(match.has_profile(F.col("persona"))).select(*ANSWERS, answers_key().alias("_key"))
               .dropDuplicates(["_key"]).withColumn("answers", F.monotonically_increasing_id()))


def _profile_keys() -> Column:
    """Everything that earns a profile points, as (key, points)."""
    pair = lambda key, points: F.struct(key.alias("key"), points.cast("double").alias("points"))
    tagged = lambda letter, values, points: F.transform(
        F.array_distinct(values), lambda v: pair(F.concat(F.lit(letter + ":"), v.cast("string")), F.lit(points)))
    none = F.array().cast("array<string>")
    ages = F.when(F.col("persona") == "family", F.coalesce("child_age_groups", none)).otherwise(none)
    near = F.array_except("near_cantons", "preferred_cantons")
    prices = F.array_compact(F.array(*[
        F.when(F.col("budget") == name, pair(
            F.concat(F.lit("p:"), F.lit(step).cast("string")),
            F.lit(P.POINTS["free_wanted"] if name == "free" and step == 0 else P.POINTS["in_budget"])))
        for name, limit in P.BUDGET_LIMITS.items() for step in PRICE_STEPS if limit is None or step <= limit]))
    return F.concat(tagged("i", F.coalesce("interests", none), P.POINTS["interest"]),
                    tagged("a", ages, P.POINTS["age_group"]),
                    tagged("c", F.coalesce("preferred_cantons", none), P.POINTS["home_canton"]),
                    tagged("c", F.coalesce(near, none), P.POINTS["near_canton"]), prices)


def _signature_keys() -> Column:
    tagged = lambda letter, values: F.transform(values, lambda v: F.concat(F.lit(letter + ":"), v.cast("string")))
    return F.concat(tagged("i", F.col("interest_hits")), tagged("a", F.col("age_hits")),
                    tagged("c", F.array("canton")), tagged("p", F.array_compact(F.array("price_step"))))


def score_signatures(sets: DataFrame, signatures: DataFrame) -> DataFrame:
    """(answers, signature, home, score) for all pairs that can score above zero.

    Points are earned key by key (an interest, an age group, a canton, a price step), so a pair is
    found by an equi join on the key and its score is a sum; pairs without a shared key cannot score.
    Demotions (far canton, over budget) apply where a pair earned nothing for that part.
    """
    # Spread by set of answers: the join fans out in every task, and the sums need no second shuffle.
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    wants = sets.repartition(tasks, "answers").select(
        "answers", flag(F.size("preferred_cantons") > 0).alias("_picky"),
        flag(F.col("budget").isin(list(P.BUDGET_LIMITS))).alias("_budgeted"), F.inline(_profile_keys())) \
        .withColumns({"_canton": flag(F.col("key").startswith("c:")), "_price": flag(F.col("key").startswith("p:"))}) \
        .withColumn("_home", F.when(F.col("points") == P.POINTS["home_canton"], F.col("_canton")).otherwise(0))
    offers = signatures.select("signature", flag(F.col("price_step").isNotNull()).alias("_priced"),
                               F.explode(_signature_keys()).alias("key"))
    most = lambda name: F.max(name).alias(name)
    pairs = wants.join(offers, "key").groupBy("answers", "signature").agg(
        F.sum("points").alias("_earned"), *[most(n) for n in ("_canton", "_price", "_home", "_picky", "_budgeted", "_priced")])
    far = F.when((F.col("_picky") == 1) & (F.col("_canton") == 0), F.lit(P.POINTS["far_canton"])).otherwise(F.lit(0.0))
    dear = F.when((F.col("_budgeted") == 1) & (F.col("_priced") == 1) & (F.col("_price") == 0),
                  F.lit(P.POINTS["over_budget"])).otherwise(F.lit(0.0))
    return pairs.select("answers", "signature", (F.col("_home") == 1).alias("home"),
                        F.round(F.col("_earned") + far + dear, 6).alias("score")).filter(F.col("score") > 0)


def score_profiles(profiles: DataFrame, listings: DataFrame) -> DataFrame:
    """Per user: how many listings match (score above zero), the best score and the sum."""
    counts = cut(listing_signatures(listings))
    sets = answer_sets(profiles)
    scored = score_signatures(sets, counts).join(counts.select("signature", "n"), "signature")
    per = scored.groupBy("answers").agg(
        F.sum("n").alias("matches"), F.max("score").alias("best"), F.sum(F.col("n") * F.col("score")).alias("total"))
    users = profiles.select("user_id", answers_key().alias("_key"))
    return users.join(sets.select("_key", "answers"), "_key", "left").join(per, "answers", "left").select(
        "user_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("best", F.lit(0.0)).alias("best"),
        F.coalesce("total", F.lit(0.0)).alias("total"))


def for_you(scored: DataFrame, key: list, order: list, slots: int = P.SLOTS, home_slots: int = P.HOME_SLOTS,
            per_canton: int = P.PER_CANTON) -> DataFrame:
    """The picks of each key from scored candidates (key, id, canton, home, score, order columns).

    Home rows are reserved up to `home_slots`, no canton gives more than `per_canton`, the rest is by
    score. Both quotas keep the best of a group, so two ranks express them.
    """
    best = [F.col("score").desc(), *[F.col(c) if isinstance(c, str) else c for c in order]]
    capped = first_per(scored.filter(F.col("score") > 0), [*key, "canton"], best, per_canton)
    reserved = first_per(capped.withColumn("_home", F.col("home").cast("int")), [*key, "_home"], best,
                         slots, rank="_group_rank")
    flagged = reserved.withColumn("_reserved", F.when((F.col("_home") == 1) & (F.col("_group_rank") <= home_slots), 1)
                                  .otherwise(0))
    return first_per(flagged, key, [F.col("_reserved").desc(), *best], slots, rank="slot") \
        .drop("_home", "_group_rank", "_reserved")


def _telling(rows: DataFrame, per_canton: int) -> DataFrame:
    """The rows (signature, place, words, ...) that a walk may need, and the `step` of their signature they belong to.

    Rows of one signature have one score. Of those with equal words all behave as the first one: it shares a word with a kept row, or
    keeps the others out. Rows without words keep nothing out, and no canton gives more than `per_canton` of them. Steps
    hold 3, 12, 48 ... rows in the order of their places.
    """
    first = first_per(rows, ["signature", "words"], ["place"], per_canton, rank="_nth").filter((F.size("words") == 0) | (F.col("_nth") == 1))
    place = F.row_number().over(Window.partitionBy("signature").orderBy("place"))
    return first.withColumn("step", F.floor(F.log2(place) / 2).cast("int")).drop("_nth")


def _ranked(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """Steps of scored signatures, and how many rows lie before each for sure (`before`).

    That is all rows that score better and, of those that score the same, the steps that another one follows up to there.
    """
    steps = rows.groupBy("signature", "step").agg(F.count("*").alias("n"), F.min("place").alias("begin"), F.max("place").alias("end"))
    steps = cut(steps.withColumn("_over", F.coalesce(F.lag("n").over(Window.partitionBy("signature").orderBy("step")), F.lit(0))))
    each = Window.partitionBy("answers")
    scored = scored.withColumn("down", -F.round(F.col("score") * 1e6).cast("bigint"))   # whole millionths, as scores are rounded to them
    better = F.sum("n").over(each.orderBy("down").rangeBetween(Window.unboundedPreceding, -1))
    over = F.sum("_over").over(Window.partitionBy("answers", "down").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0))
    return scored.join(steps, "signature").withColumn("before", F.coalesce(better, F.lit(0)) + over).drop("_over", "n")


def _looks(ranked: DataFrame, cantons: int) -> DataFrame:
    """Per set of answers the number of cantons of its rows, and how many rows lie before the last of the first `cantons` ones."""
    per = ranked.groupBy("answers", F.coalesce("canton", F.lit("")).alias("canton")).agg(F.min("before").alias("before"))
    places = F.sort_array(F.collect_list("before"))
    return per.groupBy("answers").agg(F.count("*").cast("int").alias("cantons"),
                                      F.element_at(places, F.least(F.lit(cantons), F.size(places))).alias("ahead"))


def _candidates(ranked: DataFrame, rows: DataFrame, k: Column) -> DataFrame:
    """At least the first k rows of each set of answers by score, then place: (answers, score, place, id, canton, home, words, ...).

    They lie in the steps that have fewer than k rows before them, up to where the first of the other steps begins. `whole`: no
    step is left; `home_whole`: no home row is.
    """
    each = Window.partitionBy("answers")
    at = lambda place: F.struct("down", F.col(place).alias("place"))
    steps = ranked.withColumn("_upto", F.min(F.when(F.col("before") >= k, at("begin"))).over(each))
    steps = steps.withColumns({
        "whole": F.col("_upto").isNull(),
        "home_whole": F.max(F.when(F.col("home"), at("end"))).over(each) <= F.col("_upto")}) \
        .withColumn("home_whole", F.coalesce("home_whole", F.lit(True))).filter(F.col("before") < k).drop("begin", "end", "before", "ahead")
    return steps.join(rows, ["signature", "step"]).filter(F.col("whole") | (at("place") <= F.col("_upto")))


class _Picks:
    """One set of answers: rows in order, those left whose titles share no word with a kept one, and what the quotas take."""

    def __init__(self, slots: int, home_slots: int, per_canton: int):
        self.slots, self.home_slots, self.per_canton = slots, home_slots, per_canton
        self.words, self.kept, self.cantons, self.homes = set(), [], {}, 0

    def add(self, row: tuple) -> None:
        id_, canton, home, score, words = row
        if self.homes >= self.home_slots and len(self.kept) >= self.slots or not self.words.isdisjoint(words):
            return
        self.words.update(words)
        if self.cantons.get(canton, 0) < self.per_canton:
            self.cantons[canton] = self.cantons.get(canton, 0) + 1
            self.kept.append((id_, canton, home, score))
            self.homes += home

    def picks(self) -> list[tuple]:
        """Home rows up to their reserve, then the rest by place."""
        home = [r for r in self.kept if r[2]][:self.home_slots]
        return (home + [r for r in self.kept if r not in home])[:self.slots]

    def settled(self, whole: bool, home_whole: bool, cantons: int) -> bool:
        """Whether rows still to come could change nothing."""
        full = sum(n >= self.per_canton for n in self.cantons.values())
        enough = (self.homes >= self.home_slots or home_whole) and len(self.kept) >= self.slots
        return whole or full == cantons or enough


def _picked(rows: DataFrame, slots: int, home_slots: int, per_canton: int) -> DataFrame:
    """(answers, slot, id, canton, score, settled); a row without slot tells if a set of answers is settled."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answers, state, bounds = None, None, None

        def told() -> list[tuple]:
            done = state.settled(*bounds)
            out = [(answers, i + 1, r[0], r[1], r[3], done) for i, r in enumerate(state.picks())] if done else []
            return [*out, (answers, None, None, None, None, done)]

        for batch in batches:
            out = []
            for a, id_, canton, home, score, words, *limits in batch.itertuples(index=False, name=None):
                if a != answers:
                    if state is not None:
                        out += told()
                    answers, state, bounds = a, _Picks(slots, home_slots, per_canton), limits
                state.add((id_, canton, bool(home), score, words.tolist()))
            yield made(out)
        if state is not None:
            yield made(told())

    def made(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["answers", "slot", "id", "canton", "score", "settled"])
        return frame.astype({"slot": "Int32"})

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, "answers").sortWithinPartitions("answers", "down", "place")
    return ordered.select("answers", "id", "canton", "home", "score", "words", "whole", "home_whole", "cantons").mapInPandas(
        run, f"answers long, slot int, id {kinds['id']}, canton {kinds['canton']}, score double, settled boolean")


def for_you_all(profiles: DataFrame, listings: DataFrame, order: Column, title: Column | None = None, slots: int = P.SLOTS,
                home_slots: int = P.HOME_SLOTS, per_canton: int = P.PER_CANTON, first: int = FIRST_LOOK) -> DataFrame:
    """(user_id, slot, id, canton, score) for all users at once.

    Listings are walked by score, then `order`; one whose `title` shares a significant word with a kept one falls out, and
    the quotas choose among those kept. Picks are made per set of answers and then handed to its users. A set of answers
    sees its first rows only: those before enough cantons have come, `first` more, and WIDER times as many where they left
    slots open and more could fill them.
    """
    words = F.array_sort(F.transform(match.title_words(title), lambda w: F.xxhash64(w))) if title is not None else F.array().cast("array<bigint>")
    traits = listings.withColumns({**listing_traits(), "place": F.struct(order.alias("order"), "id"), "words": words}) \
        .select(F.xxhash64(*TRAITS).alias("signature"), "id", "place", "words")
    rows = cut(_telling(traits, per_canton))
    counts = cut(listing_signatures(listings))
    sets = answer_sets(profiles)
    scored = score_signatures(sets, counts).join(counts.select("signature", "canton"), "signature")
    ranked = cut(_ranked(scored, rows))
    ranked = cut(ranked.join(_looks(ranked, -(-slots // max(per_canton, 1))), "answers"))
    found, times = [], 1
    while True:
        told = cut(_picked(_candidates(ranked, rows, (F.col("ahead") + first) * times), slots, home_slots, per_canton))
        found.append(told.filter(F.col("slot").isNotNull()))
        if told.filter(~F.col("settled")).isEmpty():
            break
        ranked = ranked.join(told.filter(~F.col("settled")).select("answers").distinct(), "answers", "left_semi")
        times *= WIDER
    picks = reduce(lambda a, b: a.unionByName(b), found).drop("settled")
    users = profiles.select("user_id", answers_key().alias("_key")).join(sets.select("_key", "answers"), "_key")
    return users.join(picks, "answers").select("user_id", "slot", "id", "canton", "score")


def collapse_similar(df: DataFrame, key: list[str], order: list[str], title: str, row_id: str = "id") -> DataFrame:
    """Drop rows whose title shares a significant word with a better-placed kept row of the same key.

    The greedy walk in list order is computed in rounds: a row that comes first for each of its
    words stays, and takes the other rows of those words out. Each round works on (key, word) with
    partial minima, so no group is gathered and no pairs are formed. Rows without words always stay.
    """
    place = F.struct(*[F.col(c) for c in order], F.col(row_id))
    rows = df.withColumns({"_place": place, "_words": match.title_words(F.col(title))})
    undecided = cut(rows.filter(F.size("_words") > 0).select(*key, row_id, "_place", F.explode("_words").alias("_word")))
    kept: list[DataFrame] = []
    ident = [*key, row_id]
    while not undecided.isEmpty():
        heads = undecided.groupBy(*key, "_word").agg(F.min("_place").alias("_head"))
        marked = undecided.join(heads, [*key, "_word"])
        winners = cut(marked.groupBy(*ident).agg(F.bool_and(F.col("_place") == F.col("_head")).alias("_first"))
                      .filter("_first").select(*ident))
        kept.append(winners)
        taken = undecided.join(winners, ident, "left_semi").select(*key, "_word").distinct()
        losers = undecided.join(taken, [*key, "_word"], "left_semi").select(*ident).distinct()
        undecided = cut(undecided.join(losers, ident, "left_anti"))
    wordless = rows.filter(F.size("_words") == 0).select(*ident)
    survivors = reduce(lambda a, b: a.unionByName(b), kept, wordless)
    return df.join(survivors, ident, "left_semi")
