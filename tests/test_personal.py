"""For you: the walk over prefixes against the plain greedy walk over everything."""

import random

import pytest
from pyspark.sql import functions as F

from vicinage.functions import match
from vicinage.operators import personal

WORDS = ["museum", "concert", "marché", "theater", "famille", "randonnée", "brocante", "les", "spectacle", "kids", "atelier", "cirque"]
CANTONS = ["Mersch", "Wiltz", "Diekirch", "Echternach", "Remich", None]


def fixture(spark):
    rng = random.Random(12)
    listings = [(f"id{i}", i, [rng.choice(["Nature", "Culture", "Animals", "Food"])], rng.choice([0, 4, 12, None]), rng.choice([6, 14, 99, None]),
                 CANTONS[min(5, int(rng.expovariate(0.9)))], rng.choice([None, 0.0, 10.0, 20.0, 50.0]), " ".join(rng.sample(WORDS, rng.randint(0, 3)))) for i in range(400)]
    none = []
    near = lambda preferred: rng.choice([none, ["Diekirch"]]) if preferred else none  # noqa: E731 - neighbours are those of the preferred ones
    profiles = [(u, rng.choice(["family", "couple", "skipped"]), rng.sample(["nature", "culture", "animals", "food"], rng.randint(0, 2)),
                 rng.sample(["0-3", "4-8", "15+"], rng.randint(0, 2)), preferred, near(preferred),
                 rng.choice(["free", "cheap", "any", None])) for u in range(25) for preferred in [rng.choice([none, ["Wiltz"], ["Remich"], ["Mersch", "Diekirch"]])]]
    a = spark.createDataFrame(listings, "id string, key int, category array<string>, age_min int, age_max int, canton string, price_adult double, title string")
    b = spark.createDataFrame(profiles, "user_id int, persona string, interests array<string>, child_age_groups array<string>, preferred_cantons array<string>, "
                              "near_cantons array<string>, budget string")
    return a, b


def greedy(rows):
    """rows of one user by score, then place: (id, canton, home, score, words)."""
    seen, unique = [], []
    for r in rows:
        if r[4] and any(set(r[4]) & s for s in seen):
            continue
        if r[4]:
            seen.append(set(r[4]))
        unique.append(r)
    picked, count = [], {}

    def push(r):
        if len(picked) < 8 and count.get(r[1], 0) < 4:
            picked.append(r)
            count[r[1]] = count.get(r[1], 0) + 1

    for r in unique:
        if sum(p[2] for p in picked) >= 2:
            break
        if r[2]:
            push(r)
    for r in unique:
        if r not in picked:
            push(r)
    return [(r[0], r[3]) for r in picked]


@pytest.mark.parametrize("first", [2, 1000])
def test_for_you_equals_the_greedy_walk(spark, first):
    listings, profiles = fixture(spark)
    answers = {c: F.col(c) for c in personal.ANSWERS}
    listing = {"category": F.col("category"), "canton": F.col("canton"), "price_adult": F.col("price_adult"),
               "age_min": F.coalesce("age_min", F.lit(0)), "age_max": F.coalesce("age_max", F.lit(99))}
    scored = listings.crossJoin(profiles).withColumns({"score": F.round(match.match_score(answers, listing), 6), "words": match.title_words(F.col("title")),
                                                       "home": F.coalesce(F.array_contains("preferred_cantons", F.col("canton")), F.lit(False))})
    rows = {}
    for r in scored.filter("score > 0").orderBy(F.col("score").desc(), "key").collect():
        rows.setdefault(r.user_id, []).append((r.id, r.canton, r.home, r.score, r.words))
    want = {u: greedy(found) for u, found in rows.items()}
    got = {}
    for r in personal.for_you_all(profiles, listings, F.col("key"), F.col("title"), first=first).orderBy("user_id", "slot").collect():
        got.setdefault(r.user_id, []).append((r.id, r.score))
    assert got == want and len(want) > 10


def test_a_long_home_canton_is_not_walked_row_by_row(spark, monkeypatch):
    """Rows of one signature that say what an earlier one says stay out of the walk, and a look holds a few times the rows it asks for."""
    home = [(f"h{i}", i, ["Nature"], 0, 99, "Wiltz", 0.0, WORDS[i % 3] if i % 5 else "") for i in range(3000)]
    away = [(f"a{i}", 3000 + i, ["Nature"], 0, 99, c, 0.0, "") for i, c in enumerate(["Mersch", "Remich"] * 3)]
    listings = spark.createDataFrame(home + away, "id string, key int, category array<string>, age_min int, age_max int, canton string, price_adult double, title string")
    profiles = spark.createDataFrame([(1, "couple", ["nature"], [], ["Wiltz"], ["Mersch", "Remich"], "free")], "user_id int, persona string, interests array<string>, "
                                     "child_age_groups array<string>, preferred_cantons array<string>, near_cantons array<string>, budget string")
    walked, picked = [], personal._picked
    monkeypatch.setattr(personal, "_picked", lambda rows, *a: (walked.append(rows.count()), picked(rows, *a))[1])
    got = [r.id for r in personal.for_you_all(profiles, listings, F.col("key"), F.col("title"), first=8).orderBy("slot").collect()]
    assert got == ["h0", "h1", "h2", "h3", "a0", "a1", "a2", "a3"]
    assert sum(walked) < 100
