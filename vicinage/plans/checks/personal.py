"""Ranking for profiles."""

from pyspark.sql import functions as F

from ...functions import match
from ...operators import personal as ops
from .base import check


def edges(t):
    """Adjacency of cantons: nations of one region border each other."""
    a = t.nation.select(F.col("n_name").alias("src"), "n_regionkey")
    b = t.nation.select(F.col("n_name").alias("dst"), "n_regionkey")
    return a.join(b, "n_regionkey").filter("src <> dst").select("src", "dst")


def profiles(t):
    return ops.with_neighbours_from(t.profiles, edges(t))


NEAR = "near AS (SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name)"
AFFINITY = "CASE WHEN l.canton = p.preferred_canton THEN 3.0 WHEN (p.preferred_canton, l.canton) IN (SELECT (src, dst) FROM near) THEN 1.0 ELSE -0.5 END"
BASE_SCORE = """CASE WHEN p.persona = 'skipped' THEN 0.0 ELSE
    CASE WHEN l.category_1 = CASE p.interest_1 WHEN 'nature' THEN 'Nature' WHEN 'playgrounds' THEN 'Playgrounds' ELSE 'Culture' END THEN 1.0 ELSE 0.0 END
    + CASE WHEN p.persona = 'family' THEN CASE WHEN coalesce(l.age_max, 99) >= 4 AND coalesce(l.age_min, 0) <= 8 THEN 0.5 ELSE 0 END
        + CASE WHEN coalesce(l.age_max, 99) >= 15 AND coalesce(l.age_min, 0) <= 18 THEN 0.5 ELSE 0 END ELSE 0 END
    + CASE WHEN l.canton = p.preferred_canton THEN 3.0 WHEN n.dst IS NOT NULL THEN 1.0 ELSE -0.5 END
    + CASE WHEN l.price_adult IS NULL THEN 0.0 WHEN p.budget = 'any' THEN 0.3 WHEN p.budget = 'free' THEN CASE WHEN l.price_adult = 0 THEN 1.0 ELSE -0.5 END
        WHEN l.price_adult <= CASE p.budget WHEN 'cheap' THEN 15 ELSE 30 END THEN 0.3 ELSE -0.5 END END"""
# One row per distinct set of answers and listing; users are joined back by their answers.
SCORES = f"""{NEAR}, answers AS (SELECT DISTINCT persona, interest_1, preferred_canton, budget FROM profiles_v),
scores AS (SELECT p.*, l.id, l.canton, round(CAST({BASE_SCORE} AS DOUBLE), 6) AS score
  FROM answers p CROSS JOIN listings_v l LEFT JOIN near n ON n.src = p.preferred_canton AND n.dst = l.canton)"""
ANSWERS = "persona, interest_1, preferred_canton, budget"


@check("f29_match_score", f"""
WITH {NEAR} SELECT l.id, round(CAST({BASE_SCORE} AS DOUBLE), 6) AS score FROM listings_v l
JOIN profiles_v p ON p.user_id = l.id % (SELECT count(*) FROM customer) LEFT JOIN near n ON n.src = p.preferred_canton AND n.dst = l.canton""")
def score(t):
    n = t.customer.agg(F.count("*").alias("n"))
    p = profiles(t)
    paired = t.listings.join(n).withColumn("user_id", F.col("key") % F.col("n")).join(p, "user_id")
    listing = {c: F.col(c) for c in ("category", "canton", "price_adult")} | {
        "age_min": F.coalesce("age_min", F.lit(0)), "age_max": F.coalesce("age_max", F.lit(99))}
    return paired.select(F.col("key").alias("id"), F.round(match.match_score(
        {c: F.col(c) for c in ops.ANSWERS}, listing), 6).alias("score"))


@check("f30_needs_to_filters", """
SELECT user_id, persona <> 'skipped' AS wheelchair, false AS sensory, false AS free_parking FROM profiles_v""")
def needs(t):
    f = match.needs_to_filters(F.col("persona"), F.col("needs"))
    return t.profiles.select("user_id", f.alias("f")).select("user_id", "f.*")


@check("j16_canton_affinity", f"""
WITH {NEAR} SELECT o_orderkey AS id, CASE WHEN e.n_name = p.preferred_canton THEN 3.0 WHEN near.dst IS NOT NULL THEN 1.0 ELSE -0.5 END::DOUBLE AS affinity
FROM orders JOIN profiles_v p ON o_custkey = user_id JOIN nation e ON e.n_nationkey = o_orderkey % 25
LEFT JOIN near ON near.src = p.preferred_canton AND near.dst = e.n_name""")
def affinity(t):
    rows = t.orders.join(profiles(t), F.col("o_custkey") == F.col("user_id")) \
        .join(t.nation, F.col("n_nationkey") == F.col("o_orderkey") % 25)
    return rows.select(F.col("o_orderkey").alias("id"), match.canton_affinity(
        F.col("n_name"), F.col("preferred_cantons"), F.col("near_cantons")).alias("affinity"))


@check("j17_score_all", f"""
WITH {SCORES}, s AS (SELECT {ANSWERS}, count(*) AS matches, max(score) AS best, sum(score) AS total FROM scores WHERE score > 0 GROUP BY {ANSWERS})
SELECT user_id, coalesce(matches, 0) AS matches, coalesce(best, 0) AS best, round(coalesce(total, 0), 3) AS total
FROM profiles_v LEFT JOIN s USING ({ANSWERS})""")
def score_all(t):
    return ops.score_profiles(profiles(t), t.listings).select("user_id", "matches", "best", F.round("total", 3).alias("total"))


# Titles of one significant word each, shared across signatures, or of none: the greedy collapse keeps the first of each word.
WORD = "CASE WHEN id % 7 <> 0 THEN concat('thema', CAST(id * 7919 % 211 AS VARCHAR(9))) END"


@check("w05_for_you", f"""
WITH {SCORES}, kept AS (SELECT * FROM (SELECT *, {WORD} AS word FROM scores WHERE score > 0)
    QUALIFY word IS NULL OR row_number() OVER (PARTITION BY {ANSWERS}, word ORDER BY score DESC, id) = 1),
capped AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {ANSWERS}, canton ORDER BY score DESC, id) <= 4),
held AS (SELECT *, canton = preferred_canton AND row_number() OVER (PARTITION BY {ANSWERS}, canton = preferred_canton ORDER BY score DESC, id) <= 2 AS home FROM capped),
picks AS (SELECT *, row_number() OVER (PARTITION BY {ANSWERS} ORDER BY home DESC, score DESC, id) AS slot FROM held QUALIFY slot <= 8)
SELECT user_id, slot, CAST(id AS VARCHAR) AS id, score FROM profiles_v JOIN picks USING ({ANSWERS})""")
def for_you(t):
    word = F.when(F.col("key") % 7 != 0, F.concat(F.lit("Thema"), (F.col("key") * 7919 % 211).cast("string")))
    title = F.concat_ws(" ", F.lit("Les Spectacle -"), word)
    picks = ops.for_you_all(profiles(t), t.listings, F.col("key"), title)
    return picks.select("user_id", F.col("slot").cast("bigint").alias("slot"), "id", "score")


@check("w04_collapse_similar", """
WITH RECURSIVE r AS (SELECT p_size, p_partkey AS id, list_filter(list_distinct(string_split(p_name, ' ')), lambda w: length(w) >= 5) AS words,
    row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part),
g AS (SELECT p_size, id, pos, words AS seen, true AS kept FROM r WHERE pos = 1
  UNION ALL SELECT r.p_size, r.id, r.pos, CASE WHEN list_has_any(g.seen, r.words) THEN g.seen ELSE list_concat(g.seen, r.words) END,
    NOT list_has_any(g.seen, r.words) FROM g JOIN r ON r.p_size = g.p_size AND r.pos = g.pos + 1)
SELECT id, p_size FROM g WHERE kept""")
def collapse(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), "p_size", "p_name", (-F.col("p_retailprice")).alias("rank"))
    return ops.collapse_similar(rows, ["p_size"], ["rank"], "p_name").select("id", "p_size")
