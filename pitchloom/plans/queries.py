"""Registered queries over the match view, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchloom.functions import columns as C
from pitchloom.operators import challenger, contracts, goals, identity, intake, live, market, matches, ratings, rules, scoring
from pitchloom.sources import digests, documents, lines, scans, sinks, work

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The match view in SQL.
VIEW = """
WITH RECURSIVE lines AS (
  SELECT l_orderkey, min(l_suppkey) AS suppkey, CAST(count(*) FILTER (l_returnflag = 'R') AS INTEGER) AS home_score,
         CAST(count(*) FILTER (l_returnflag = 'A') AS INTEGER) AS away_score
  FROM lineitem GROUP BY 1),
m AS (
  SELECT 'M' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS match_id, CAST(o_orderdate AS DATE) AS date,
         regexp_replace(lower(h.n_name), '[^a-z0-9]+', '-', 'g') AS home_team_id, regexp_replace(lower(a.n_name), '[^a-z0-9]+', '-', 'g') AS away_team_id,
         home_score, away_score, (6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) * 10 + 10 AS k_factor,
         h.n_regionkey AS home_region, a.n_regionkey AS away_region, h.n_regionkey <> a.n_regionkey AS neutral,
         home_score = away_score AND o_orderstatus = 'P' AS after_extra_time,
         CASE WHEN home_score = away_score THEN 1 WHEN home_score > away_score THEN 0 ELSE 2 END AS outcome
  FROM orders JOIN lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON suppkey = s_suppkey
  JOIN nation h ON c_nationkey = h.n_nationkey JOIN nation a ON s_nationkey = a.n_nationkey
  WHERE c_nationkey <> s_nationkey),
sides AS (
  SELECT match_id, date, home_team_id AS team_id, away_team_id AS opponent_id, home_score AS scored, away_score AS conceded, true AS is_home, home_region, away_region FROM m
  UNION ALL SELECT match_id, date, away_team_id, home_team_id, away_score, home_score, false, home_region, away_region FROM m),
p AS (SELECT *, CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END AS points FROM sides),
preds AS (
  SELECT match_id, date, year(date) AS season, outcome, neutral,
         h / (h + d + a) AS p_home, d / (h + d + a) AS p_draw, a / (h + d + a) AS p_away
  FROM (SELECT *, 1.0 + (k_factor % 3) + CASE WHEN neutral THEN 0.0 ELSE 0.5 END AS h, 1.25 AS d, 1.0 + CAST(substr(match_id, 10, 1) AS INTEGER) / 5.0 AS a FROM m)),
q AS (
  SELECT 'M' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS match_id, l_suppkey % 8 AS bookmaker, l_linenumber AS line,
         CAST(l_shipdate AS TIMESTAMP) AS captured_at, 1.2 + l_quantity / 25 AS price_home, 2.5 + 10 * l_discount AS price_draw, 1.5 + 20 * l_tax AS price_away
  FROM lineitem),
dm AS (
  SELECT *, (1 / price_home) / s AS prob_home, (1 / price_draw) / s AS prob_draw, (1 / price_away) / s AS prob_away, s - 1 AS overround
  FROM (SELECT *, 1 / price_home + 1 / price_draw + 1 / price_away AS s FROM q))
"""


def query(sql: str | None = None):
    """Register a query, with the SQL that follows the view."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = VIEW + sql
        return f

    return add


def predictions(m: DataFrame) -> DataFrame:
    """Forecasts made from columns of the match view alone, so that both engines have the same ones."""
    h = 1.0 + F.col("k_factor") % 3 + F.when(F.col("neutral"), 0.0).otherwise(0.5)
    a = 1.0 + F.substring("match_id", 10, 1).cast("int") / 5.0
    parts = C.normalized(h, F.lit(1.25), a)
    return m.select("match_id", "date", F.year("date").alias("season"), "outcome", "neutral", *[p.alias(n) for p, n in zip(parts, scoring.P, strict=True)])


@query("SELECT match_id, date, home_team_id, away_team_id, home_score, away_score, k_factor, neutral, after_extra_time, outcome FROM m")
def match_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.matches(spark, sf_dir).drop("home_region", "away_region")


@query("SELECT match_id, date, team_id, opponent_id, scored, conceded, is_home, points FROM p")
def team_perspectives(spark, sf_dir):
    return matches.perspectives(scans.matches(spark, sf_dir)).select("match_id", "date", "team_id", "opponent_id", "scored", "conceded", "is_home", "points")


def _group_matches(spark, sf_dir):
    return scans.matches(spark, sf_dir).where("home_region = away_region").withColumn("group", F.col("home_region"))


STANDINGS = """, st AS (
  SELECT home_region AS "group", team_id, count(*) AS played, sum(points) AS points, sum(scored - conceded) AS goal_difference,
         sum(scored) AS goals_for, sum(conceded) AS goals_against FROM p WHERE home_region = away_region GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY points DESC, goal_difference DESC, goals_for DESC, team_id) AS position FROM st)
"""
STANDING_COLUMNS = """ "group", team_id, CAST(played AS BIGINT) AS played, CAST(points AS BIGINT) AS points, CAST(goal_difference AS BIGINT) AS goal_difference,
  CAST(goals_for AS BIGINT) AS goals_for, CAST(goals_against AS BIGINT) AS goals_against, CAST(position AS INTEGER) AS position """


@query(STANDINGS + f"SELECT {STANDING_COLUMNS} FROM rk")
def group_standings(spark, sf_dir):
    return rules.ranked(rules.standings(_group_matches(spark, sf_dir), ["group"]), ["group"])


@query(STANDINGS + f"SELECT {STANDING_COLUMNS}, CAST(o AS INTEGER) AS \"order\", o <= 3 AS qualified FROM (SELECT *, row_number() OVER (ORDER BY points DESC, goal_difference DESC, goals_for DESC, \"group\") AS o FROM rk WHERE position = 3)")
def best_thirds(spark, sf_dir):
    table = rules.ranked(rules.standings(_group_matches(spark, sf_dir), ["group"]), ["group"])
    return rules.best_of_position(table, 3, 3, [], "group")


@query(STANDINGS + """, b AS (SELECT "group", team_id, points // 30 AS block FROM st),
inner_matches AS (SELECT m.*, x.block FROM m JOIN b x ON home_region = x."group" AND home_team_id = x.team_id JOIN b y ON home_region = y."group" AND away_team_id = y.team_id
  WHERE home_region = away_region AND x.block = y.block)
SELECT home_region AS "group", team_id, CAST(sum(CASE WHEN s > c THEN 3 WHEN s = c THEN 1 ELSE 0 END) AS BIGINT) AS h_points, CAST(sum(s - c) AS BIGINT) AS h_difference, CAST(sum(s) AS BIGINT) AS h_goals
FROM (SELECT home_region, home_team_id AS team_id, home_score AS s, away_score AS c FROM inner_matches UNION ALL SELECT home_region, away_team_id, away_score, home_score FROM inner_matches) GROUP BY 1, 2""")
def head_to_head(spark, sf_dir):
    games = _group_matches(spark, sf_dir)
    blocks = rules.standings(games, ["group"]).select("group", "team_id", F.floor(F.col("points") / 30).alias("block"))
    return rules.head_to_head(games, blocks, ["group"])


@query(STANDINGS + """, th AS (SELECT *, -(points % 3) AS conduct, goals_for % 2 AS place FROM rk WHERE position = 3)
SELECT "group", team_id, CAST(points AS BIGINT) AS points, row_number() OVER (ORDER BY points // 100 DESC, conduct DESC, place, team_id) AS o0, count(*) OVER (PARTITION BY points // 100, conduct, place) > 1 AS tied FROM th""".replace("row_number() OVER (ORDER BY points // 100 DESC, conduct DESC, place, team_id) AS o0", "CAST(row_number() OVER (ORDER BY points // 100 DESC, conduct DESC, place, team_id) AS INTEGER) AS \"order\", row_number() OVER (ORDER BY points // 100 DESC, conduct DESC, place, team_id) <= 2 AS qualified"))
def best_thirds_cascade(spark, sf_dir):
    """Points in steps of 100 and no goals, so that conduct and ranking editions decide."""
    table = rules.ranked(rules.standings(_group_matches(spark, sf_dir), ["group"]), ["group"]).where("position = 3")
    coarse = table.select("group", "team_id", F.col("points").alias("all"), F.floor(F.col("points") / 100).alias("points"), F.lit(0).alias("goal_difference"), F.lit(0).alias("goals_for"), (-(F.col("points") % 3)).alias("conduct"), F.array(F.col("goals_for") % 2).alias("places"))
    return rules.best_thirds(coarse, 2, []).select("group", "team_id", F.col("all").alias("points"), "order", "qualified", "tied")


@query("""SELECT match_id, home_region, CAST(CASE home_region WHEN 0 THEN 60 WHEN 1 THEN 50 WHEN 2 THEN 40 WHEN 3 THEN 30 ELSE 20 END AS INTEGER) AS k_factor FROM m""")
def k_factor_lookup(spark, sf_dir):
    """Regions as tournaments: exact names to reviewed factors."""
    table = spark.createDataFrame([(f"t{i}", c, k) for i, (c, k) in enumerate(ratings.K_CATEGORIES.items())], "tournament string, k_category string, k_factor int")
    m = scans.matches(spark, sf_dir).withColumn("tournament", F.concat(F.lit("t"), F.col("home_region").cast("string")))
    return ratings.k_factors(m, table).select("match_id", "home_region", "k_factor")


@query(""", fx AS (SELECT match_id, CASE WHEN home_region = away_region THEN 'group' ELSE 'r32' END AS stage, home_team_id, away_team_id FROM m WHERE k_factor <> 20),
rs AS (SELECT match_id, CASE WHEN k_factor = 30 THEN 'nobody' ELSE home_team_id END AS a, CASE WHEN k_factor = 40 AND home_score > 2 THEN home_team_id ELSE away_team_id END AS b, home_score, away_score,
  CASE WHEN outcome = 0 AND k_factor = 60 THEN home_team_id END AS adv FROM m),
j AS (SELECT rs.*, stage, home_team_id AS h, away_team_id AS w FROM rs LEFT JOIN fx USING (match_id))
SELECT match_id, 'unknown_match' AS rule FROM j WHERE stage IS NULL UNION ALL SELECT match_id, 'unknown_team' FROM j WHERE a = 'nobody' UNION ALL SELECT match_id, 'wrong_teams' FROM j WHERE h IS NOT NULL AND NOT ((a = h AND b = w) OR (a = w AND b = h))
UNION ALL SELECT match_id, 'advanced_in_group' FROM j WHERE stage = 'group' AND adv IS NOT NULL UNION ALL SELECT match_id, 'drawn_knockout' FROM j WHERE stage <> 'group' AND home_score = away_score AND adv IS NULL""")
def state_errors(spark, sf_dir):
    """Results with planted faults against their fixture."""
    m = scans.matches(spark, sf_dir)
    fixture = m.where("k_factor <> 20").select("match_id", F.when(F.col("home_region") == F.col("away_region"), "group").otherwise("r32").alias("stage"), "home_team_id", "away_team_id")
    a = F.when(F.col("k_factor") == 30, "nobody").otherwise(F.col("home_team_id")).alias("team_a")
    b = F.when((F.col("k_factor") == 40) & (F.col("home_score") > 2), F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_b")
    advanced = F.when((F.col("outcome") == 0) & (F.col("k_factor") == 60), F.col("home_team_id")).alias("advanced_team")
    return rules.state_errors(m.select("match_id", a, b, F.col("home_score").alias("goals_a"), F.col("away_score").alias("goals_b"), advanced), fixture)


@query()
def tie_break_cascade(spark, sf_dir):
    """Seasons as groups of matches: shorter tables tie more often."""
    games = _group_matches(spark, sf_dir).withColumn("season", F.year("date"))
    return rules.cascade(games, ["group", "season"])


@query("SELECT match_id, exp(-0.00095 * (DATE '2000-01-01' - date)) AS weight FROM m WHERE date < DATE '2000-01-01' AND exp(-0.00095 * (DATE '2000-01-01' - date)) >= 1e-4")
def decay_weights(spark, sf_dir):
    return matches.weighted(scans.matches(spark, sf_dir), F.lit("2000-01-01").cast("date"), 0.00095).select("match_id", "weight")


@query("SELECT match_id, date, outcome FROM m WHERE year(date) = 2000 AND k_factor = 60")
def holdout_selection(spark, sf_dir):
    return matches.holdout(scans.matches(spark, sf_dir), 2000, F.col("k_factor") == 60).select("match_id", "date", "outcome")


@query("""SELECT match_id, date, team_id, is_home, coalesce(avg(points) OVER w, 0) AS form_points, coalesce(avg(scored) OVER w, 0) AS form_scored,
  coalesce(avg(conceded) OVER w, 0) AS form_conceded, coalesce(avg(scored - conceded) OVER w, 0) AS form_difference,
  count(*) OVER a AS n_prior, count(*) OVER a >= 5 AS eligible, CAST(date - lag(date) OVER o AS INTEGER) AS rest_days FROM p
WINDOW o AS (PARTITION BY team_id ORDER BY date, match_id), w AS (PARTITION BY team_id ORDER BY date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  a AS (PARTITION BY team_id ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rolling_form(spark, sf_dir):
    return matches.rolling_form(matches.perspectives(scans.matches(spark, sf_dir)))


@query(""", h AS (SELECT team_id, date, CAST(sum(scored) AS DOUBLE) AS goals FROM p GROUP BY 1, 2)
SELECT e.match_id, coalesce(h.goals, 0.0) AS goals FROM m e ASOF LEFT JOIN h ON h.team_id = e.home_team_id AND e.date > h.date""")
def as_of_goals(spark, sf_dir):
    m = scans.matches(spark, sf_dir)
    history = matches.perspectives(m).groupBy("team_id", "date").agg(F.sum("scored").alias("goals"))
    events = m.select("match_id", F.col("home_team_id").alias("team_id"), "date")
    return matches.as_of(events, history, "team_id", "date", "goals", 0.0).select("match_id", "goals")


@query("""SELECT team_id, rating, CAST(dense_rank() OVER (ORDER BY rating DESC) AS INTEGER) AS rank FROM
  (SELECT team_id, arg_max(CAST(scored AS DOUBLE), date::VARCHAR || match_id) AS rating FROM p GROUP BY 1)""")
def leaderboard_of_last(spark, sf_dir):
    rated = matches.perspectives(scans.matches(spark, sf_dir)).withColumn("rating_post", F.col("scored").cast("double"))
    return ratings.leaderboard(rated)


#: One chain of ratings for each pool: a step of the recursion is the next match of every pool.
CHAIN = """, t AS (SELECT team_id, row_number() OVER (ORDER BY team_id) AS x FROM (SELECT DISTINCT team_id FROM sides)),
o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY date, match_id) AS i FROM g),
o2 AS (SELECT o.*, h.x, w.x AS y FROM o JOIN t h ON h.team_id = home_team_id JOIN t w ON w.team_id = away_team_id),
e AS (
  SELECT DISTINCT pool, 0::BIGINT AS i, list_transform(range(30), lambda j: 1000.0::DOUBLE) AS r, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS gain FROM o
  UNION ALL
  SELECT pool, i, list_transform(r, lambda v, j: v + CASE WHEN j = x THEN gain WHEN j = y THEN -gain ELSE 0 END), a, b, gain FROM (
    SELECT *, k_factor * CASE WHEN margin = 0 THEN 1 ELSE ln(abs(margin) + 1) * 2.2 / (sign(margin) * (a - b) * 0.001 + 2.2) END
      * ((sign(margin) + 1) / 2 - 1 / (pow(10, -(a - b + CASE WHEN neutral THEN 0 ELSE 100 END) / 400) + 1)) AS gain
    FROM (SELECT o2.pool, o2.i, x, y, k_factor, neutral, r, r[x] AS a, r[y] AS b, CASE WHEN after_extra_time THEN 0 ELSE home_score - away_score END AS margin FROM e JOIN o2 ON o2.pool = e.pool AND o2.i = e.i + 1))),
hs AS (SELECT CAST(o2.pool AS VARCHAR) AS pool, match_id, date, home_team_id AS team_id, away_team_id AS opponent_id, e.a AS rating_pre, e.a + e.gain AS rating_post, k_factor FROM o2 JOIN e USING (pool, i)
  UNION ALL SELECT CAST(o2.pool AS VARCHAR), match_id, date, away_team_id, home_team_id, e.b, e.b - e.gain, k_factor FROM o2 JOIN e USING (pool, i))
"""
WHOLE = ", g AS (SELECT 'all' AS pool, * FROM m)" + CHAIN


@query(WHOLE + "SELECT match_id, date, team_id, opponent_id, rating_pre, rating_post, k_factor FROM hs")
def elo_history(spark, sf_dir):
    return ratings.history(scans.matches(spark, sf_dir)).drop("pool")


@query(", g AS (SELECT home_region AS pool, * FROM m WHERE home_region = away_region)" + CHAIN + "SELECT * FROM hs")
def elo_by_region(spark, sf_dir):
    """Regions as pools."""
    return ratings.history(scans.matches(spark, sf_dir).where("home_region = away_region"), pool="home_region")


@query(WHOLE + "SELECT team_id, rating, CAST(dense_rank() OVER (ORDER BY rating DESC) AS INTEGER) AS rank FROM (SELECT team_id, arg_max(rating_post, date::VARCHAR || match_id) AS rating FROM hs GROUP BY 1)")
def elo_leaderboard(spark, sf_dir):
    return ratings.leaderboard(ratings.history(scans.matches(spark, sf_dir)))


@query(WHOLE + """SELECT x.match_id, x.rating_pre AS home_rating, y.rating_pre AS away_rating, x.rating_pre + CASE WHEN neutral THEN 0 ELSE 100 END - y.rating_pre AS rating_difference
FROM m JOIN hs x ON x.match_id = m.match_id AND x.team_id = home_team_id JOIN hs y ON y.match_id = m.match_id AND y.team_id = away_team_id""")
def match_ratings(spark, sf_dir):
    """Both ratings before each match and their difference."""
    m = scans.matches(spark, sf_dir)
    return ratings.with_ratings(m, ratings.history(m)).select("match_id", "home_rating", "away_rating", "rating_difference")


@query(WHOLE + """, d AS (SELECT DISTINCT team_id, make_date(y, 1, 1) AS day FROM sides, (SELECT DISTINCT year(date)::BIGINT AS y FROM m) WHERE true),
l AS (SELECT team_id, date, arg_max(rating_post, match_id) AS rating FROM hs GROUP BY 1, 2)
SELECT d.team_id, d.day, coalesce(l.rating, 1000.0) AS rating FROM d ASOF LEFT JOIN l ON d.team_id = l.team_id AND d.day > l.date""")
def ratings_before(spark, sf_dir):
    """Every team's rating before the first day of each year."""
    m = scans.matches(spark, sf_dir)
    years = m.select(F.year("date").alias("y")).distinct().agg(F.collect_set("y").alias("years"))  # calendar years
    teams = matches.perspectives(m).select("team_id").distinct()
    days = teams.join(F.broadcast(years)).select("team_id", F.explode("years").alias("y")).select("team_id", F.make_date("y", F.lit(1), F.lit(1)).alias("day"))
    return ratings.before(ratings.history(m), days, "day")


@query("""SELECT home_region, match_id, b || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS row_id FROM
  (SELECT home_region, match_id, b, row_number() OVER (PARTITION BY b ORDER BY match_id) AS n FROM (SELECT home_region, match_id, date || '-' || home_team_id || '-' || away_team_id AS b FROM m))""")
def collision_free_ids(spark, sf_dir):
    base = F.concat_ws("-", F.col("date").cast("string"), "home_team_id", "away_team_id")
    return identity.numbered_ids(scans.matches(spark, sf_dir).select("home_region", "match_id", "date", "home_team_id", "away_team_id"), base, ["match_id"]).select("home_region", "match_id", "row_id")


ALIASES = """, al AS (
  SELECT 'orders' AS source, lower(n_name) AS source_name, 'early-' || n_nationkey AS team_id, DATE '1900-01-01' AS valid_from, DATE '1997-12-31' AS valid_to FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT 'orders', lower(n_name), 'late-' || n_nationkey, DATE '1998-01-01' - CAST(n_nationkey % 3 = 0 AS INTEGER) * 100, NULL FROM nation WHERE n_nationkey % 5 <> 3),
named AS (SELECT match_id, date, 'orders' AS source, replace(home_team_id, '-', '_') AS source_name FROM m)"""


def _aliases(spark, sf_dir):
    n = scans.parquet(spark, sf_dir, "nation")
    day = lambda d: F.lit(d).cast("date")
    early = n.where("n_nationkey % 5 <> 4").select(F.lit("orders").alias("source"), F.lower("n_name").alias("source_name"), F.concat(F.lit("early-"), F.col("n_nationkey").cast("string")).alias("team_id"), day("1900-01-01").alias("valid_from"), day("1997-12-31").alias("valid_to"))
    start = F.date_sub(day("1998-01-01"), F.when(F.col("n_nationkey") % 3 == 0, 100).otherwise(0))
    late = n.where("n_nationkey % 5 <> 3").select(F.lit("orders").alias("source"), F.lower("n_name").alias("source_name"), F.concat(F.lit("late-"), F.col("n_nationkey").cast("string")).alias("team_id"), start.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return early.unionByName(late)


def _named(spark, sf_dir):
    return scans.matches(spark, sf_dir).select("match_id", "date", F.lit("orders").alias("source"), F.replace("home_team_id", F.lit("-"), F.lit("_")).alias("source_name"))


@query(ALIASES + """SELECT r.match_id, any_value(r.date) AS date, any_value(r.source) AS source, any_value(r.source_name) AS source_name, CAST(count(a.team_id) AS INTEGER) AS n_aliases,
  CASE WHEN count(a.team_id) = 1 THEN min(a.team_id) END AS team_id FROM named r LEFT JOIN al a ON r.source = a.source AND r.source_name = a.source_name AND r.date BETWEEN a.valid_from AND coalesce(a.valid_to, DATE '9999-12-31') GROUP BY 1""")
def temporal_aliases(spark, sf_dir):
    return identity.resolve(_named(spark, sf_dir), _aliases(spark, sf_dir), ["match_id"])


@query(ALIASES + """SELECT source, source_name, min(date) AS first_seen, max(date) AS last_seen, count(*) AS rows FROM named r WHERE NOT EXISTS
  (SELECT 1 FROM al a WHERE r.source = a.source AND r.source_name = a.source_name AND r.date BETWEEN a.valid_from AND coalesce(a.valid_to, DATE '9999-12-31')) GROUP BY 1, 2""")
def unresolved_names(spark, sf_dir):
    return identity.unresolved(_named(spark, sf_dir), _aliases(spark, sf_dir))


@query(ALIASES + """SELECT s.source, t.team_id, arg_min(a.source_name, a.valid_from) AS source_name, count(a.source_name) > 0 AS resolved FROM (SELECT DISTINCT team_id FROM al) t, (SELECT 'orders' AS source UNION ALL SELECT 'events') s
  LEFT JOIN al a ON a.source = s.source AND a.team_id = t.team_id GROUP BY 1, 2""")
def alias_coverage(spark, sf_dir):
    al = _aliases(spark, sf_dir)
    sources = spark.createDataFrame([("orders",), ("events",)], "source string")
    return identity.coverage(al.select("team_id").distinct(), sources, al)


@query("""SELECT date, home_team_id, away_team_id, match_id, shootout_winner_team_id, shootout_winner_team_id IS NOT NULL AS after_extra_time FROM
  (SELECT m.date, m.home_team_id, m.away_team_id, match_id, w AS shootout_winner_team_id FROM m LEFT JOIN
    (SELECT date, home_team_id, away_team_id, min(home_team_id) AS w FROM m WHERE outcome = 1 AND k_factor >= 50 GROUP BY 1, 2, 3) s USING (date, home_team_id, away_team_id))""")
def shootout_join(spark, sf_dir):
    m = scans.matches(spark, sf_dir)
    shootouts = m.where("outcome = 1 and k_factor >= 50").groupBy("date", "home_team_id", "away_team_id").agg(F.min("home_team_id").alias("winner"))
    return matches.with_shootouts(m.select("date", "home_team_id", "away_team_id", "match_id"), shootouts)


QUOTED = """, fx AS (SELECT match_id, CAST(date AS TIMESTAMP) + INTERVAL 18 HOUR AS kickoff, home_team_id, away_team_id FROM m),
qs AS (SELECT match_id AS event_id, away_team_id AS home_team_id, home_team_id AS away_team_id, CAST(date AS TIMESTAMP) + INTERVAL 18 HOUR + (k_factor - 20) * INTERVAL 20 MINUTE AS commence_time FROM m)"""


@query(QUOTED + """SELECT event_id, any_value(qs.home_team_id) AS home_team_id, any_value(qs.away_team_id) AS away_team_id, any_value(commence_time) AS commence_time, CAST(count(match_id) AS INTEGER) AS n_fixtures,
  CASE WHEN count(match_id) = 1 THEN min(match_id) END AS match_id, CASE WHEN count(match_id) = 1 THEN bool_and(fx.home_team_id <> qs.home_team_id) END AS swapped
FROM qs LEFT JOIN fx ON least(qs.home_team_id, qs.away_team_id) = least(fx.home_team_id, fx.away_team_id) AND greatest(qs.home_team_id, qs.away_team_id) = greatest(fx.home_team_id, fx.away_team_id)
  AND abs(epoch_us(kickoff) - epoch_us(commence_time)) <= 43200000000 GROUP BY 1""")
def quote_fixture_link(spark, sf_dir):
    m = scans.matches(spark, sf_dir).withColumn("kickoff", F.to_timestamp("date") + F.expr("interval 18 hours"))
    fixture = m.select("match_id", "kickoff", "home_team_id", "away_team_id")
    quotes = m.select(F.col("match_id").alias("event_id"), F.col("away_team_id").alias("home_team_id"), F.col("home_team_id").alias("away_team_id"), (F.col("kickoff") + F.make_dt_interval(mins=(F.col("k_factor") - 20) * 20)).alias("commence_time"))
    return market.linked(quotes, fixture, ["event_id"])


@query("SELECT match_id, bookmaker, line, prob_home, prob_draw, prob_away, overround FROM dm")
def demargined_quotes(spark, sf_dir):
    return market.demargined(scans.quotes(spark, sf_dir)).select("match_id", "bookmaker", "line", "prob_home", "prob_draw", "prob_away", "overround")


CONSENSUS = """, cs AS (SELECT match_id, h / (h + d + a) AS prob_home, d / (h + d + a) AS prob_draw, a / (h + d + a) AS prob_away, prob_home_mean, prob_draw_mean, prob_away_mean, n_bookmakers FROM
  (SELECT match_id, median(prob_home) AS h, median(prob_draw) AS d, median(prob_away) AS a, avg(prob_home) AS prob_home_mean, avg(prob_draw) AS prob_draw_mean, avg(prob_away) AS prob_away_mean, count(DISTINCT bookmaker) AS n_bookmakers FROM dm GROUP BY 1))"""


@query(CONSENSUS + "SELECT * FROM cs")
def market_consensus(spark, sf_dir):
    return market.consensus(market.demargined(scans.quotes(spark, sf_dir)), ["match_id"])


@query(CONSENSUS + "SELECT preds.match_id, date, season, neutral, p_home, p_draw, p_away, cs.prob_home AS market_home, cs.prob_draw AS market_draw, cs.prob_away AS market_away, CASE WHEN season < 2001 THEN outcome END AS outcome FROM preds JOIN cs USING (match_id)")
def ledger(spark, sf_dir):
    m = scans.matches(spark, sf_dir)
    book = market.consensus(market.demargined(scans.quotes(spark, sf_dir)), ["match_id"])
    return market.ledger_rows(predictions(m).drop("outcome"), book, m.where("year(date) < 2001"))


@query("SELECT match_id, bookmaker, line, captured_at FROM q WHERE captured_at BETWEEN TIMESTAMP '1999-12-31 00:00:00' AND TIMESTAMP '2000-01-01 00:00:00'")
def fresh_quotes(spark, sf_dir):
    return market.fresh(scans.quotes(spark, sf_dir), F.lit("2000-01-01").cast("timestamp")).select("match_id", "bookmaker", "line", "captured_at")


LOSSES = """, ls AS (SELECT *, -ln(least(greatest(CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END / (p_home + p_draw + p_away), 2.220446049250313e-16), 1 - 2.220446049250313e-16)) AS log_loss,
  pow(p_home - CAST(outcome = 0 AS INTEGER), 2) + pow(p_draw - CAST(outcome = 1 AS INTEGER), 2) + pow(p_away - CAST(outcome = 2 AS INTEGER), 2) AS brier,
  (pow(p_home - CAST(outcome = 0 AS INTEGER), 2) + pow(p_home + p_draw - CAST(outcome <= 1 AS INTEGER), 2)) / 2 AS rps FROM preds)"""


@query(LOSSES + "SELECT season, count(*) AS n, avg(log_loss) AS log_loss, avg(brier) AS brier, avg(rps) AS rps FROM ls GROUP BY 1")
def forecast_scores(spark, sf_dir):
    return scoring.scores(predictions(scans.matches(spark, sf_dir)), ["season"])


@query(LOSSES + "SELECT season, CAST(sum(c) OVER w AS BIGINT) AS n, sum(a) OVER w / sum(c) OVER w AS log_loss, sum(b) OVER w / sum(c) OVER w AS brier, sum(r) OVER w / sum(c) OVER w AS rps FROM (SELECT season, count(*) AS c, sum(log_loss) AS a, sum(brier) AS b, sum(rps) AS r FROM ls GROUP BY 1) WINDOW w AS (ORDER BY season ROWS UNBOUNDED PRECEDING)")
def cumulative_scores(spark, sf_dir):
    return scoring.cumulative(predictions(scans.matches(spark, sf_dir)), "season")


MODELS = LOSSES + """, tb AS (SELECT season AS holdout, 'baseline' AS model, avg(log_loss) AS log_loss FROM ls WHERE season BETWEEN 1997 AND 2000 GROUP BY 1
  UNION ALL SELECT season, 'uniform', ln(3.0) FROM ls WHERE season BETWEEN 1997 AND 2000 GROUP BY 1)"""


def _models(spark, sf_dir):
    scored = scoring.scores(predictions(scans.matches(spark, sf_dir)), ["season"]).where("season between 1997 and 2000").select(F.col("season").alias("holdout"), F.lit("baseline").alias("model"), "log_loss")
    return scored.unionByName(scored.select("holdout", F.lit("uniform").alias("model"), F.log(F.lit(3.0)).alias("log_loss")))


@query(MODELS + "SELECT c.model, avg(c.log_loss) AS mean_loss, bool_and(c.log_loss < b.log_loss) AS passed FROM tb c JOIN tb b ON c.holdout = b.holdout AND b.model = 'baseline' WHERE c.model = 'uniform' GROUP BY 1")
def promotion_gate(spark, sf_dir):
    return scoring.gate(_models(spark, sf_dir), "baseline", ["uniform"])


@query(MODELS + "SELECT arg_min(model, mean_loss) AS model, min(mean_loss) AS mean_loss FROM (SELECT model, avg(log_loss) AS mean_loss FROM tb GROUP BY 1)")
def best_model(spark, sf_dir):
    return scoring.best_parameter(_models(spark, sf_dir), "model")


@query(MODELS + "SELECT CASE WHEN bool_and(c.log_loss < b.log_loss) THEN 'uniform' ELSE 'baseline' END AS winner FROM tb c JOIN tb b ON c.holdout = b.holdout AND b.model = 'baseline' WHERE c.model = 'uniform'")
def promotion_winner(spark, sf_dir):
    return scoring.winner(scoring.gate(_models(spark, sf_dir), "baseline", ["uniform"]), "baseline", ["uniform"])


@query("""SELECT attacker, defender, CAST(home AS INTEGER) AS home, sum(w) AS weight, sum(w * g) AS goals FROM
  (SELECT home_team_id AS attacker, away_team_id AS defender, CASE WHEN neutral THEN 0 ELSE 1 END AS home, home_score AS g, exp(-0.00095 * (DATE '2000-01-01' - date)) AS w FROM m WHERE date < DATE '2000-01-01'
   UNION ALL SELECT away_team_id, home_team_id, 0, away_score, exp(-0.00095 * (DATE '2000-01-01' - date)) FROM m WHERE date < DATE '2000-01-01') WHERE w >= 1e-4 GROUP BY 1, 2, 3""")
def goal_statistics(spark, sf_dir):
    return goals.cells(matches.weighted(scans.matches(spark, sf_dir), F.lit("2000-01-01").cast("date"), 0.00095))


@query("""SELECT CAST(cutoff AS VARCHAR) AS cutoff, xi, home_team_id, away_team_id, neutral, sum(w) AS w, sum(w * home_score) AS x, sum(w * away_score) AS y, sum(CASE WHEN home_score = 0 AND away_score = 0 THEN w ELSE 0 END) AS w00,
  sum(CASE WHEN home_score = 0 AND away_score = 1 THEN w ELSE 0 END) AS w01, sum(CASE WHEN home_score = 1 AND away_score = 0 THEN w ELSE 0 END) AS w10, sum(CASE WHEN home_score = 1 AND away_score = 1 THEN w ELSE 0 END) AS w11
FROM (SELECT m.*, cutoff, xi, exp(-xi * (cutoff - date)) AS w FROM m, (SELECT unnest([DATE '1997-07-01', DATE '1999-01-01', DATE '2000-01-01']) AS cutoff), (SELECT unnest([0.00095::DOUBLE, 0.0018, 0.01]) AS xi) WHERE date < cutoff)
WHERE w >= 1e-4 GROUP BY 1, 2, 3, 4, 5""")
def decayed_statistics(spark, sf_dir):
    """Sums for nine fits, three cutoffs and three decays, from one scan; the last decay reaches 921 days back."""
    return goals.decayed_sums(scans.matches(spark, sf_dir), ["1997-07-01", "1999-01-01", "2000-01-01"], [0.00095, 0.0018, 0.01])


@query()
def decay_search(spark, sf_dir):
    """Three yearly holdouts, three decays."""
    from pitchloom.plans import validation

    holdouts = [validation.Holdout(str(y), y, "k_factor = 60", f"{y}-01-01") for y in (1998, 1999, 2000)]
    return validation.decay_search(scans.matches(spark, sf_dir), holdouts, (0.00095, 0.0018, 0.01))


PMF = """, r AS (SELECT match_id, 0.8 + k_factor / 50.0 AS x, 0.6 + CAST(substr(match_id, 10, 1) AS INTEGER) / 10.0 AS y FROM m),
g AS (SELECT match_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, exp(-x) * pow(x, a) / factorial(CAST(a AS INTEGER)) * exp(-y) * pow(y, b) / factorial(CAST(b AS INTEGER))
  * CASE WHEN a = 0 AND b = 0 THEN 1 - x * y * -0.05 WHEN a = 0 AND b = 1 THEN 1 + x * -0.05 WHEN a = 1 AND b = 0 THEN 1 + y * -0.05 WHEN a = 1 AND b = 1 THEN 1 - -0.05 ELSE 1 END AS p
  FROM r, range(0, 11) ra(a), range(0, 11) rb(b))"""


def _rated(spark, sf_dir):
    return scans.matches(spark, sf_dir).select("match_id", (0.8 + F.col("k_factor") / 50.0).alias("rate_home"), (0.6 + F.substring("match_id", 10, 1).cast("int") / 10.0).alias("rate_away"))


@query(PMF + "SELECT match_id, x AS rate_home, y AS rate_away, sum(p) FILTER (a > b) / sum(p) AS p_home, sum(p) FILTER (a = b) / sum(p) AS p_draw, sum(p) FILTER (a < b) / sum(p) AS p_away FROM g JOIN r USING (match_id) GROUP BY 1, 2, 3")
def outcome_probabilities(spark, sf_dir):
    return goals.with_outcomes(_rated(spark, sf_dir), -0.05)


@query(PMF + "SELECT match_id, a AS home_goals, b AS away_goals, p / sum(p) OVER (PARTITION BY match_id) AS p FROM g")
def score_matrix(spark, sf_dir):
    return goals.score_matrix(_rated(spark, sf_dir), -0.05).select("match_id", "home_goals", "away_goals", "p")


@query("SELECT match_id, h + d * CASE WHEN h + a > 0 THEN h / (h + a) ELSE 0.5 END AS advance FROM (SELECT match_id, p_home AS h, p_draw AS d, p_away AS a FROM preds)")
def advance_probability(spark, sf_dir):
    p = predictions(scans.matches(spark, sf_dir))
    return p.select("match_id", C.advance_probability(F.col("p_home"), F.col("p_draw"), F.col("p_away")).alias("advance"))


@query("SELECT match_id, CAST('0x' || substr(md5('123|' || match_id || '|' || draw), 1, 13) AS BIGINT) / pow(2, 52) AS u, CAST(draw AS INTEGER) AS draw FROM m, range(0, 3) d(draw)")
def keyed_uniforms(spark, sf_dir):
    m = scans.matches(spark, sf_dir).select("match_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("draw"))
    return m.select("match_id", "draw", C.keyed_uniform(123, F.col("match_id"), F.col("draw")).alias("u"))


@query(""", d AS (SELECT match_id, 0.8 + k_factor / 50.0 AS x, CAST('0x' || substr(md5('7|' || match_id), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM m),
c AS (SELECT match_id, u, k, sum(exp(-x) * pow(x, k) / factorial(CAST(k AS INTEGER))) OVER (PARTITION BY match_id ORDER BY k) AS cdf FROM d, range(0, 30) r(k))
SELECT match_id, CAST(count(*) FILTER (cdf <= u) AS INTEGER) AS goals FROM c GROUP BY 1""")
def poisson_goals(spark, sf_dir):
    m = scans.matches(spark, sf_dir)
    return m.select("match_id", C.poisson_draw(0.8 + F.col("k_factor") / 50.0, C.keyed_uniform(7, F.col("match_id"))).alias("goals"))


@query("""SELECT match_id, date, date > bound OR (date = bound AND match_id >= bid) AS recent FROM m, (SELECT date AS bound, match_id AS bid FROM m ORDER BY date DESC, match_id DESC LIMIT 1 OFFSET
  (SELECT CAST(round_even(count(*) * 0.25, 0) AS BIGINT) - 1 FROM m))""")
def latest_quarter(spark, sf_dir):
    return matches.latest_fraction(scans.matches(spark, sf_dir).select("match_id", "date"), 0.25, ["date", "match_id"])


@query("SELECT match_id, home_team_id, away_team_id FROM m WHERE home_region = away_region AND date >= DATE '2000-06-01'")
def upcoming_matches(spark, sf_dir):
    m = scans.matches(spark, sf_dir)
    fixture = m.select("match_id", F.when(F.col("home_region") == F.col("away_region"), "group").otherwise("knockout").alias("stage"), "home_team_id", "away_team_id")
    return matches.upcoming(fixture, m.where("date < date '2000-06-01'")).select("match_id", "home_team_id", "away_team_id")


@query("SELECT match_id, CAST(date AS TIMESTAMP) AS kickoff FROM m WHERE CAST(date AS TIMESTAMP) <= TIMESTAMP '2000-01-01 00:00:00' AND k_factor = 20")
def overdue_matches(spark, sf_dir):
    fixture = scans.matches(spark, sf_dir).withColumn("kickoff", F.to_timestamp("date"))
    return matches.overdue(fixture, fixture.where("k_factor > 20"), F.lit("2000-01-01").cast("timestamp")).select("match_id", "kickoff")


@query("""SELECT coalesce(min(k) FILTER (o AND k > TIMESTAMP '2000-01-01 00:00:00'), max(k) FILTER (o), max(k)) AS boundary FROM (SELECT CAST(date AS TIMESTAMP) AS k, k_factor <> 20 AS o FROM m)""")
def kickoff_boundary(spark, sf_dir):
    fixture = scans.matches(spark, sf_dir).withColumn("kickoff", F.to_timestamp("date"))
    return matches.kickoff_boundary(fixture, fixture.where("k_factor = 20"), F.lit("2000-01-01").cast("timestamp"))


@query(""", se AS (SELECT season, CAST(outcome AS VARCHAR) AS team_id, avg(p_home) AS p FROM preds GROUP BY 1, 2)
SELECT season, team_id, p, p - coalesce(lag(p) OVER w, p) AS to_previous, p - first_value(p) OVER w AS to_first FROM se WINDOW w AS (PARTITION BY team_id ORDER BY season)""")
def snapshot_deltas(spark, sf_dir):
    series = predictions(scans.matches(spark, sf_dir)).groupBy("season", F.col("outcome").cast("string").alias("team_id")).agg(F.avg("p_home").alias("p"))
    return market.deltas(series, "season", "team_id", "p")


@query("""SELECT match_id, date, season, outcome, neutral, CASE WHEN f IS NULL THEN 1 / 3.0 ELSE p_home END AS p_home, CASE WHEN f IS NULL THEN 1 / 3.0 ELSE p_draw END AS p_draw, CASE WHEN f IS NULL THEN 1 / 3.0 ELSE p_away END AS p_away,
  f AS fallback_reason, CASE WHEN f IS NULL THEN 'challenger' ELSE 'baseline' END AS published_family FROM (SELECT *, CASE WHEN season < 1997 THEN 'ineligible' WHEN neutral THEN 'no_prediction' END AS f FROM preds)""")
def dual_publication(spark, sf_dir):
    p = predictions(scans.matches(spark, sf_dir))
    third = F.lit(1 / 3.0)
    challenger = p.where("not neutral").select("match_id", third.alias("p_home"), third.alias("p_draw"), third.alias("p_away"))
    return market.publication(p, p.select("match_id", (F.col("season") >= 1997).alias("eligible")), challenger, True)


@query("SELECT f AS fallback_reason, count(*) AS rows FROM (SELECT CASE WHEN season < 1997 THEN 'ineligible' WHEN neutral THEN 'no_prediction' END AS f FROM preds) GROUP BY 1")
def fallback_counts(spark, sf_dir):
    return dual_publication(spark, sf_dir).groupBy("fallback_reason").agg(F.count("*").alias("rows"))


@query("""SELECT CASE WHEN k_factor IN (30, 40) THEN NULL ELSE match_id END AS event_id, CASE WHEN k_factor = 20 OR (k_factor > 40 AND home_score <> 1) THEN 'book' END AS bookmaker,
  CASE WHEN k_factor = 20 THEN 1.5 + home_score WHEN k_factor = 60 AND home_score <> 1 THEN 1.5 + home_score END AS price_home,
  CASE k_factor WHEN 30 THEN 'not JSON' WHEN 40 THEN 'event lacks id, teams or time' WHEN 20 THEN CASE WHEN home_score = 2 THEN 'not three-way' END
    WHEN 50 THEN CASE WHEN home_score = 1 THEN 'event without quotes' ELSE 'no h2h market' END ELSE CASE WHEN home_score = 1 THEN 'event without quotes' END END AS verdict,
  match_id || CASE k_factor WHEN 30 THEN '' WHEN 40 THEN '/0' WHEN 50 THEN CASE WHEN home_score = 1 THEN '/0' ELSE '/0/0' END WHEN 60 THEN CASE WHEN home_score = 1 THEN '/0' ELSE '/0/0/0' END ELSE '/0/0/0' END AS place FROM m""")
def json_quote_records(spark, sf_dir):
    """A payload for each match, with planted faults: one cut off, one without an id, a market of other names, one of another kind, an event without bookmakers."""
    k, goals_ = F.col("k_factor"), F.col("home_score")
    result = lambda name, price: F.struct(name.alias("name"), price.alias("price"))
    draw = F.when((k == 20) & (goals_ == 2), "Tie").otherwise("Draw")
    outcomes = F.array(result(F.col("home_team_id"), (1.5 + goals_).cast("double")), result(draw, F.lit(3.25)), result(F.col("away_team_id"), F.lit(4.5)))
    market = F.struct(F.when(k == 50, "lay").otherwise("h2h").alias("key"), outcomes.alias("outcomes"))
    book = F.struct(F.lit("book").alias("key"), F.concat(F.col("date").cast("string"), F.lit("T10:00:00Z")).alias("last_update"), F.array(market).alias("markets"))
    event = F.struct(F.when(k != 40, F.col("match_id")).alias("id"), F.concat(F.col("date").cast("string"), F.lit("T18:00:00Z")).alias("commence_time"), F.col("home_team_id").alias("home_team"), F.col("away_team_id").alias("away_team"), F.when(~k.isin(50, 60) | (goals_ != 1), F.when(k != 40, F.array(book))).alias("bookmakers"))
    text = F.to_json(F.array(event))
    payloads = scans.matches(spark, sf_dir).withColumn("t", text).select("match_id", F.when(k == 30, F.expr("substr(t, 1, length(t) - 9)")).otherwise(F.col("t")).alias("payload"))
    return documents.quote_records(payloads, source=F.col("match_id")).select("event_id", "bookmaker", "price_home", "verdict", "place")


@query("""SELECT match_id, home_score <> (home_score + CAST(k_factor = 60 AS INTEGER)) AS goals_differ, k_factor = 50 AS teams_differ FROM m WHERE k_factor IN (50, 60)""")
def result_disagreements(spark, sf_dir):
    m = scans.matches(spark, sf_dir)
    ours = m.select("match_id", F.col("home_team_id").alias("team_a"), F.col("away_team_id").alias("team_b"), F.col("home_score").alias("goals_a"), F.col("away_score").alias("goals_b"))
    theirs = m.select("match_id", F.when(F.col("k_factor") == 50, "other").otherwise(F.col("away_team_id")).alias("team_a"), F.col("home_team_id").alias("team_b"), (F.col("home_score") + F.when(F.col("k_factor") == 60, 1).otherwise(0)).alias("goals_a"), F.col("away_score").alias("goals_b"))
    return market.disagreements(ours, theirs)


@query("SELECT team_id, count(*) AS n, count(DISTINCT match_id) AS matches, count(DISTINCT opponent_id) AS opponents, min(date) AS first_date, max(date) AS last_date FROM p GROUP BY 1")
def team_counts(spark, sf_dir):
    return matches.perspectives(scans.matches(spark, sf_dir)).groupBy("team_id").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("matches"), F.count_distinct("opponent_id").alias("opponents"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("SELECT team_id, CAST(sum(points) AS BIGINT) AS points FROM p GROUP BY 1 ORDER BY points DESC, team_id LIMIT 8")
def top_teams(spark, sf_dir):
    return matches.perspectives(scans.matches(spark, sf_dir)).groupBy("team_id").agg(F.sum("points").alias("points")).orderBy(F.desc("points"), "team_id").limit(8)


@query("""SELECT least(home_team_id, away_team_id) AS first, greatest(home_team_id, away_team_id) AS second, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_pairs(spark, sf_dir):
    return contracts.repeated_pairs(scans.matches(spark, sf_dir), "home_team_id", "away_team_id")


@query("""SELECT 'scores' AS rule, count(*) FILTER (home_score > 3) AS rows FROM m UNION ALL SELECT 'regions', count(*) FILTER (neutral) FROM m
UNION ALL SELECT 'after_extra_time is not null', 0 UNION ALL SELECT 'home_score is not null', 0 UNION ALL SELECT 'match_id is not null', 0 UNION ALL SELECT 'neutral is not null', 0
UNION ALL SELECT 'unique match_id', 0 UNION ALL SELECT 'unique home_score, neutral', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM m GROUP BY home_score, neutral HAVING count(*) > 1)""")
def contract_report(spark, sf_dir):
    spec = contracts.Contract({"match_id": "string", "home_score": "int", "neutral": "boolean", "after_extra_time": "boolean"}, frozenset(), {"scores": "home_score <= 3", "regions": "not neutral"}, (("match_id",), ("home_score", "neutral")))
    df = scans.matches(spark, sf_dir)
    return contracts.violations(contracts.cast(df.select(*spec.columns), spec), spec)


@query("SELECT home_team_id FROM m WHERE year(date) < 2000 AND home_region <> 2 AND home_team_id NOT IN (SELECT away_team_id FROM m WHERE home_region = 2) GROUP BY 1")
def unmatched_teams(spark, sf_dir):
    m = scans.matches(spark, sf_dir)
    return contracts.unmatched(m.where("year(date) < 2000 and home_region <> 2"), m.where("home_region = 2").select(F.col("away_team_id").alias("home_team_id")), ["home_team_id"])


@query("SELECT match_id, sha256('[\"' || match_id || '\",\"' || date || '\"]') AS row_id FROM m")
def row_ids(spark, sf_dir):
    return scans.matches(spark, sf_dir).select("match_id", F.sha2(F.to_json(F.array("match_id", F.col("date").cast("string"))), 256).alias("row_id"))


#: The tree of the match view: as many digits as leave 1 000 rows for each range, then sixteen children for each node.
TREE = """, x AS (SELECT substr(sha256('{"match_id":"' || match_id || '"}'), 1, w) AS r, sha256('{"match_id":"' || match_id || '","date":"' || date || '","home_team_id":"' || home_team_id || '","away_team_id":"' || away_team_id
    || '","home_score":' || home_score || ',"away_score":' || away_score || ',"k_factor":' || k_factor || ',"home_region":' || home_region || ',"away_region":' || away_region
    || ',"neutral":' || CAST(neutral AS VARCHAR) || ',"after_extra_time":' || CAST(after_extra_time AS VARCHAR) || ',"outcome":' || outcome || '}') AS d
  FROM m, (SELECT CAST(greatest(0, ceil(ln(count(*) / 1000.0) / ln(16) - 1e-12)) AS INTEGER) AS w FROM m)),
ranges AS (SELECT r AS "range", sha256(string_agg(d, '' ORDER BY d)) AS digest, count(*) AS rows FROM x GROUP BY 1),
node AS (
  SELECT "range", digest, rows FROM ranges
  UNION ALL
  SELECT left("range", length("range") - 1), sha256(string_agg("range" || ':' || digest || ':' || rows || chr(10), '' ORDER BY "range")), CAST(sum(rows) AS BIGINT) FROM node WHERE length("range") > 0 GROUP BY 1)
"""


@query(TREE + """SELECT digest, rows FROM node WHERE length("range") = 0""")
def table_digest(spark, sf_dir):
    return digests.content_hash(scans.matches(spark, sf_dir), ["match_id"])


@query(TREE + """SELECT "range", digest, rows FROM ranges""")
def table_ranges(spark, sf_dir):
    return digests.ranges(scans.matches(spark, sf_dir), ["match_id"])


@query("SELECT team_id, printf('%.1f%%', 100 * w) AS share, printf('%+.1f pp', 100 * (w - 0.4)) AS delta FROM (SELECT team_id, avg(CAST(points = 3 AS INTEGER)) AS w FROM p GROUP BY 1)")
def presentation(spark, sf_dir):
    shares = matches.perspectives(scans.matches(spark, sf_dir)).groupBy("team_id").agg(F.avg((F.col("points") == 3).cast("int")).alias("w"))
    return shares.select("team_id", C.percent(F.col("w")).alias("share"), C.signed_points(F.col("w") - 0.4).alias("delta"))


@query("""SELECT CASE WHEN s LIKE 'W%' THEN 'winner' WHEN s LIKE 'L%' THEN 'loser' WHEN s LIKE '3%' THEN 'third' ELSE 'group' END AS slot_kind, CASE WHEN s[1] IN ('1', '2', '3') THEN CAST(s[1] AS INTEGER) END AS slot_place, substr(s, 2) AS slot_reference, match_id
FROM (SELECT match_id, CASE k_factor WHEN 20 THEN '1A' WHEN 30 THEN '2B' WHEN 40 THEN '3CDF' WHEN 50 THEN 'W74' ELSE 'L101' END AS s FROM m)""")
def slot_tokens(spark, sf_dir):
    k = F.col("k_factor")
    token = F.when(k == 20, "1A").when(k == 30, "2B").when(k == 40, "3CDF").when(k == 50, "W74").otherwise("L101")
    return rules.slots(scans.matches(spark, sf_dir).select("match_id", token.alias("slot")), "slot").drop("slot")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark, sf_dir):
    return scans.parquet(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query()
def goal_model_predictions(spark, sf_dir):
    """Fit before 2000, forecast 2000."""
    m = scans.matches(spark, sf_dir)
    cutoff = F.lit("2000-01-01").cast("date")
    model = goals.fit(matches.weighted(m, cutoff, 0.00095).select("home_team_id", "away_team_id", "home_score", "away_score", "neutral", "weight"), 0.00095, "2000-01-01")
    return goals.with_outcomes(goals.rates(m.where("year(date) = 2000"), model), model.rho).select("match_id", "outcome", "rate_home", "rate_away", "p_home", "p_draw", "p_away")


@query()
def ordered_logit_predictions(spark, sf_dir):
    m = scans.matches(spark, sf_dir)
    rated = work.written(ratings.rated(m).select("match_id", "date", "outcome", F.col("rating_difference").alias("dr")), "gaps")
    c1, c2, scale = goals.fit_ordered_logit(rated.where("year(date) < 2000"))
    p = goals.ordered_logit(F.col("dr"), c1, c2, scale)
    return rated.where("year(date) = 2000").select("match_id", "outcome", *[x.alias(n) for x, n in zip(p, scoring.P, strict=True)])


@query("""SELECT CASE WHEN bookmaker = 3 THEN 'missing bookmaker' WHEN bookmaker = 5 THEN 'no number price_home' ELSE 'good' END AS verdict,
  count(*) AS n, count(DISTINCT match_id) AS matches, round(sum(CASE WHEN bookmaker <> 5 THEN price_home END), 3) AS price_home FROM q GROUP BY 1""")
def quote_lines(spark, sf_dir):
    """All quotes as CSV files, those of two bookmakers with faults, read back with a verdict for each line."""
    at = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    values = {
        "provider": F.lit("manual"), "bookmaker": F.when(F.col("bookmaker") != 3, F.concat(F.lit("b"), "bookmaker")), "event_id": F.concat_ws("-", "match_id", "line"), "match_id": F.col("match_id"),
        "commence_time_utc": at, "provider_update_utc": F.when(F.col("line") % 2 == 0, at), "home_team": F.lit("Home, first"), "away_team": F.lit("Away"),
        "price_home": F.when(F.col("bookmaker") == 5, "many").otherwise(F.col("price_home").cast("string")), "price_draw": F.col("price_draw"), "price_away": F.col("price_away"),
    }
    path = f"{work.shared_dir(spark)}/quotes-{uuid.uuid4().hex}"
    scans.quotes(spark, sf_dir).select(*[values[c].alias(c) for c in lines.QUOTES]).write.option("header", True).csv(path)
    rows = lines.manual_quotes(spark, path).groupBy(F.coalesce("verdict", F.lit("good")).alias("verdict"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), F.round(F.sum("price_home"), 3).alias("price_home"))


@query("SELECT match_id, p_home, p_draw, p_away FROM preds")
def ledger_batches(spark, sf_dir):
    """All forecasts, appended to a ledger in a batch for each half of the months, read back."""
    p = predictions(scans.matches(spark, sf_dir)).select("match_id", "date", "p_home", "p_draw", "p_away")
    path = f"{work.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    for half in (0, 1):
        sinks.append_rows(p.where(F.month("date") % 2 == half).drop("date"), path, ["match_id"])
    return sinks.ledger(spark, path)


@query("""SELECT i / 10.0 AS weight, avg(-ln(least(greatest(i / 10.0 * (1 / 3.0) + (1 - i / 10.0) * CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss
FROM preds, range(0, 11) r(i) GROUP BY 1""")
def ensemble_mix(spark, sf_dir):
    p = predictions(scans.matches(spark, sf_dir))
    return challenger.mix_losses(p.withColumns({f"q{c[1:]}": F.lit(1 / 3.0) for c in scoring.P}))


@query()
def validation_report(spark, sf_dir):
    """Two yearly holdouts, three models."""
    from pitchloom.plans import validation

    holdouts = [validation.Holdout(str(y), y, "k_factor = 60", f"{y}-01-01") for y in (1999, 2000)]
    return validation.report(scans.matches(spark, sf_dir), holdouts, 0.00095)


@query()
def challenger_forecasts(spark, sf_dir):
    from pitchloom.plans import validation

    return validation.compare(scans.matches(spark, sf_dir), validation.Holdout("2000", 2000, "k_factor = 60", "2000-01-01"), 0.00095, "logistic")


@query()
def boosted_forecasts(spark, sf_dir):
    """The same holdout with boosted trees: 20 rounds at a rate of 0.2."""
    from pitchloom.plans import validation

    return validation.compare(scans.matches(spark, sf_dir), validation.Holdout("2000", 2000, "k_factor = 60", "2000-01-01"), 0.00095, "trees", rounds=20, rate=0.2)


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, sf_dir):
    from pitchloom.streaming import live

    return live.event_counts(scans.parquet(spark, sf_dir, "events"))


def _world_rates(spark, sf_dir):
    """Goal rates of the synthetic tournament's teams: each takes what one nation scores and concedes at home or away."""
    from pitchloom.plans import world

    sides = matches.perspectives(scans.matches(spark, sf_dir))
    form = sides.groupBy("team_id", "is_home").agg(F.avg("scored").alias("a"), F.avg("conceded").alias("d")).orderBy("team_id", "is_home").collect()  # two rows for each nation
    mean = sides.agg(F.avg("scored")).first()[0]
    return world.rates(spark, [(r["a"], r["d"]) for r in form], mean)


@query()
def tournament(spark, sf_dir):
    """10 000 tournaments of the synthetic world, with goal rates from the match view."""
    from pitchloom.operators.simulate import advancement, simulate
    from pitchloom.plans import world

    fixture = world.fixture(spark)
    return advancement(spark, simulate(spark, fixture, _world_rates(spark, sf_dir), world.mapping(spark), 10_000, 20260613), fixture, 10_000)


@query()
def tournament_cascade(spark, sf_dir):
    """The same with the full tie-break cascade in groups; the order of team numbers stands for conduct and ranking editions."""
    from pitchloom.operators.simulate import advancement, simulate
    from pitchloom.plans import world

    fixture, tail = world.fixture(spark), {t: i for i, t in enumerate(world.teams())}
    return advancement(spark, simulate(spark, fixture, _world_rates(spark, sf_dir), world.mapping(spark), 10_000, 20260613, rule="cascade", tail=tail, unbroken="raise"), fixture, 10_000)


#: 1 000 simulations of the group stage, replayed: goals from keyed uniforms, tables, order of the table rule.
REPLAY = """, f AS (SELECT *, row_number() OVER (ORDER BY team_id, is_home) - 1 AS i, count(*) OVER () AS c FROM (SELECT team_id, is_home, avg(scored) AS a, avg(conceded) AS d FROM sides GROUP BY 1, 2)),
tm AS (SELECT t, a, d FROM range(0, 48) r(t) JOIN f ON i = t % c),
k AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS n, unnest([0, 2, 0, 3, 3, 1]) AS x, unnest([1, 3, 2, 1, 0, 2]) AS y),
fix AS (SELECT lpad(CAST(6 * g + n + 1 AS VARCHAR), 3, '0') AS id, g, 4 * g + x AS h, 4 * g + y AS w FROM range(0, 12) r(g), k),
side AS (
  SELECT id, g, 'home' AS side, h AS own, w AS other, x.a * y.d / (SELECT avg(scored) FROM sides) AS rate FROM fix JOIN tm x ON x.t = h JOIN tm y ON y.t = w
  UNION ALL SELECT id, g, 'away', w, h, x.a * y.d / (SELECT avg(scored) FROM sides) FROM fix JOIN tm x ON x.t = w JOIN tm y ON y.t = h),
cdf AS (SELECT id, side, sum(exp(-rate) * pow(rate, n) / factorial(CAST(n AS INTEGER))) OVER (PARTITION BY id, side ORDER BY n) AS v FROM side, range(0, 25) r(n)),
draw AS (SELECT sim, id, g, side, own, CAST('0x' || substr(md5('20260613|' || id || '|' || sim || '|' || side), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM side, range(0, 1000) r(sim)),
goal AS (SELECT sim, id, g, side, own, (SELECT count(*) FROM cdf WHERE cdf.id = draw.id AND cdf.side = draw.side AND v <= u) AS goals FROM draw),
tab AS (SELECT x.sim, x.g, x.own, sum(CASE WHEN x.goals > y.goals THEN 3 WHEN x.goals = y.goals THEN 1 ELSE 0 END) AS points, sum(x.goals - y.goals) AS difference, sum(x.goals) AS goals
  FROM goal x JOIN goal y ON x.sim = y.sim AND x.id = y.id AND x.side <> y.side GROUP BY 1, 2, 3),
ord AS (SELECT *, row_number() OVER (PARTITION BY sim, g ORDER BY points DESC, difference DESC, goals DESC, own) AS place FROM tab)
SELECT sim, chr(CAST(65 + g AS INTEGER)) AS "group", CAST(max(own) FILTER (place = 1) AS INTEGER) AS first, CAST(max(own) FILTER (place = 2) AS INTEGER) AS second, CAST(max(own) FILTER (place = 3) AS INTEGER) AS third,
  CAST(max(own) FILTER (place = 4) AS INTEGER) AS fourth, CAST(max(points) FILTER (place = 3) AS BIGINT) AS third_points FROM ord GROUP BY 1, 2"""


def _group_stage(spark, sf_dir, n, rule="table"):
    from pitchloom.operators import simulate
    from pitchloom.plans import world

    rated = {(r["home_team_id"], r["away_team_id"]): r for r in _world_rates(spark, sf_dir).collect()}  # pairs of 48 teams
    number = {t: i for i, t in enumerate(world.teams())}
    games = [{"match_id": r[0], "group": r[2], "home": number[r[5]], "away": number[r[6]], "rate_home": rated[r[5:7]]["rate_home"], "rate_away": rated[r[5:7]]["rate_away"], "home_score": None, "away_score": None} for r in world.fixture_rows() if r[1] == "group"]
    groups, length = simulate.group_frame(spark, games)
    return simulate.group_tables(simulate.group_goals(groups, length, spark.range(n).withColumnRenamed("id", "sim"), 20260613), rule)


@query(REPLAY)
def simulated_groups(spark, sf_dir):
    from pitchloom.operators.simulate import POINTS

    third = F.shiftright(F.col("k3") + POINTS // 2, 40).alias("third_points")
    return _group_stage(spark, sf_dir, 1_000).select("sim", "group", "first", "second", "third", "fourth", third)


@query()
def group_place_shares(spark, sf_dir):
    """The share of 10 000 simulations in which each team takes each place of its group."""
    from pitchloom.operators.simulate import group_positions
    from pitchloom.plans import world

    return group_positions(spark, _group_stage(spark, sf_dir, 10_000, "cascade"), world.teams(), 10_000)


def _training_set(spark, sf_dir):
    """All matches: those before a day as history, the later ones as live results in canonical form. The view is written once, as its parts are checked one by one."""
    m = work.written(scans.matches(spark, sf_dir), "matches")
    text = lambda x: F.lit(x)
    history = m.where("date < date '2000-06-01'").select("*", F.col("after_extra_time").alias("result_after_extra_time"), F.upper("home_team_id").alias("home_team_source_name"), F.upper("away_team_id").alias("away_team_source_name"), F.when(F.col("after_extra_time"), F.col("home_team_id")).alias("shootout_winner_team_id"), text("").alias("city"), F.col("home_region").cast("string").alias("country"), text("history").alias("tournament"), text("view").alias("source"), text("v1").alias("source_version"))
    fixture = m.select("match_id", F.timestamp_micros(F.unix_date("date").cast("long") * live.DAY + live.DAY // 2).alias("kickoff"), F.col("home_region").alias("host_country"))
    advanced = F.when(F.col("after_extra_time"), F.col("away_team_id")).when(F.col("neutral") & (F.col("home_score") > F.col("away_score")), F.col("home_team_id"))
    results = m.where("date >= date '2000-06-01'").select("match_id", F.col("home_team_id").alias("team_a"), F.col("away_team_id").alias("team_b"), F.col("home_score").alias("goals_a"), F.col("away_score").alias("goals_b"), advanced.alias("advanced_team"))
    return live.training_set(history, live.canonical(results, fixture, F.lit("2000-06-01").cast("date"), "v1", "cup"))


@query("""SELECT match_id, date, home_team_id, away_team_id, CASE WHEN date < DATE '2000-06-01' THEN upper(home_team_id) ELSE home_team_id END AS home_team_source_name,
CASE WHEN date < DATE '2000-06-01' THEN upper(away_team_id) ELSE away_team_id END AS away_team_source_name, home_score, away_score, CASE WHEN date < DATE '2000-06-01' THEN neutral ELSE true END AS neutral,
CASE WHEN date < DATE '2000-06-01' AND after_extra_time THEN home_team_id END AS shootout_winner_team_id, after_extra_time AS result_after_extra_time, '' AS city, CAST(home_region AS VARCHAR) AS country,
CASE WHEN date < DATE '2000-06-01' THEN 'history' ELSE 'cup' END AS tournament, CASE WHEN date < DATE '2000-06-01' THEN 'view' ELSE 'live' END AS source, 'v1' AS source_version FROM m""")
def live_training_set(spark, sf_dir):
    return _training_set(spark, sf_dir)


@query(""", g AS (SELECT 'all' AS pool, match_id, date, home_team_id, away_team_id, home_score, away_score, CASE WHEN date < DATE '2000-06-01' THEN 40 ELSE 60 END AS k_factor,
  CASE WHEN date < DATE '2000-06-01' THEN neutral ELSE true END AS neutral, after_extra_time FROM m)""" + CHAIN + """SELECT team_id, rating, CAST(dense_rank() OVER (ORDER BY rating DESC) AS INTEGER) AS rank FROM
  (SELECT team_id, arg_max(rating_post, date::VARCHAR || match_id) AS rating FROM hs GROUP BY 1)""")
def live_ratings(spark, sf_dir):
    """Ratings after history and live results: training set, K-factors of its tournaments, one chain."""
    factors = spark.createDataFrame([("history", "qualifier_major", 40), ("cup", "wc", 60)], "tournament string, k_category string, k_factor int")
    return ratings.ranked(ratings.latest(live.trainable(_training_set(spark, sf_dir), factors)))


@query("""SELECT match_id, 'outside_fixture' AS rule FROM m WHERE home_region = 4
UNION ALL SELECT match_id, 'wrong_margin' FROM m WHERE home_score < away_score AND neutral
UNION ALL SELECT match_id, 'repeated' FROM m WHERE away_region = 2""")
def live_result_errors(spark, sf_dir):
    """Live results with planted faults: no fixture for one region, the home team always advances on neutral ground, one region is sent twice."""
    m = scans.matches(spark, sf_dir)
    advanced = F.when(F.col("neutral"), F.col("home_team_id"))
    results = m.select("match_id", F.col("home_team_id").alias("team_a"), F.col("away_team_id").alias("team_b"), F.col("home_score").alias("goals_a"), F.col("away_score").alias("goals_b"), advanced.alias("advanced_team"), "away_region")
    return live.canonical_errors(results.union(results.where("away_region = 2")), m.where("home_region <> 4"))


@query("""SELECT count(*) FILTER (date < DATE '2000-06-01') AS rows, count(*) FILTER (date < DATE '2000-06-01') AS completed, count(*) FILTER (date >= DATE '2000-06-01') AS unplayed,
0::BIGINT AS one_sided, 0::BIGINT AS unversioned, 0::BIGINT AS other_sources, (SELECT count(DISTINCT team_id) FROM sides) AS teams,
(SELECT count(DISTINCT team_id) FROM sides WHERE team_id LIKE 'united%') AS unresolved, 1::BIGINT AS versions, (SELECT count(*) FROM sides WHERE team_id LIKE 'united%') = 0 AS passed FROM m""")
def materialization_audit(spark, sf_dir):
    """The matches before a day against a raw table in which later ones are not played, with some names unknown."""
    m = scans.matches(spark, sf_dir)
    played = F.col("date") < F.lit("2000-06-01").cast("date")
    raw = m.select(F.col("home_team_id").alias("home_team"), F.col("away_team_id").alias("away_team"), F.when(played, F.col("home_score")).alias("home_score"), F.when(played, F.col("away_score")).alias("away_score"))
    names = m.select(F.explode(F.array("home_team_id", "away_team_id")).alias("source_name")).where("source_name not like 'united%'").distinct()
    return live.audit(m.where(played).select(F.lit("view").alias("source"), F.lit("v1").alias("source_version")), raw, names, "view")


@query(ALIASES + """, res AS (SELECT *, replace(home_team_id, '-', '_') AS h, replace(away_team_id, '-', '_') AS a, CASE WHEN k_factor = 20 AND home_score = 0 THEN NULL ELSE home_score END AS hs,
  CASE WHEN (k_factor = 20 AND home_score = 0) OR (k_factor = 60 AND home_score = 1) THEN NULL ELSE away_score END AS aws FROM m),
shot AS (SELECT date, h, a, count(*) AS n FROM (SELECT date, h, a FROM res WHERE outcome = 1 AND k_factor >= 50 UNION ALL SELECT date, h, a FROM res WHERE outcome = 1 AND k_factor = 60 AND neutral) GROUP BY 1, 2, 3),
nm AS (SELECT name, date, count(*) AS n, min(team_id) AS t FROM (SELECT h AS name, date FROM res UNION SELECT a, date FROM res) JOIN al ON name = source_name AND date BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31') GROUP BY 1, 2),
j AS (SELECT r.*, coalesce(x.n, 0) AS nh, CASE WHEN x.n = 1 THEN x.t END AS th, coalesce(y.n, 0) AS na, CASE WHEN y.n = 1 THEN y.t END AS ta, s.n IS NOT NULL AS beyond
  FROM res r LEFT JOIN nm x ON x.name = h AND x.date = r.date LEFT JOIN nm y ON y.name = a AND y.date = r.date LEFT JOIN shot s ON s.date = r.date AND s.h = r.h AND s.a = r.a AND s.n = 1 WHERE hs IS NOT NULL OR aws IS NOT NULL),
v AS (SELECT *, CASE WHEN hs IS NULL OR aws IS NULL THEN 'one score' WHEN nh = 0 OR na = 0 THEN 'unknown name' WHEN nh > 1 OR na > 1 THEN 'ambiguous name' END AS verdict FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY date, h, a, verdict IS NULL ORDER BY match_id) AS c FROM v)
SELECT CASE WHEN verdict IS NULL THEN date || '-' || home_team_id || '-' || away_team_id || CASE WHEN c > 1 THEN '-' || c ELSE '' END END AS match_id, date, th AS home_team_id, ta AS away_team_id, h AS home_team_source_name, a AS away_team_source_name,
  hs AS home_score, aws AS away_score, neutral, CASE WHEN beyond THEN th END AS shootout_winner_team_id, beyond AS result_after_extra_time, verdict, date || ' ' || h || ' ' || a AS place FROM o
UNION ALL SELECT NULL, date, NULL, NULL, h, a, NULL, NULL, NULL, NULL, NULL, 'several shoot-outs', date || ' ' || h || ' ' || a FROM shot WHERE n > 1""")
def match_records(spark, sf_dir):
    """Results as a file has them, with names, some not played, some with one score, shoot-outs that are sent twice and names of several teams or none."""
    m = scans.matches(spark, sf_dir)
    name = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    blank, half = (F.col("k_factor") == 20) & (F.col("home_score") == 0), (F.col("k_factor") == 60) & (F.col("home_score") == 1)
    raw = m.select(
        F.col("match_id").alias("line"), "date", name("home_team_id").alias("home_team"), name("away_team_id").alias("away_team"), F.when(~blank, F.col("home_score")).alias("home_score"),
        F.when(~(blank | half), F.col("away_score")).alias("away_score"), F.lit("cup").alias("tournament"), F.lit("").alias("city"), F.lit("").alias("country"), "neutral",
    )
    shot = m.where("outcome = 1 and k_factor >= 50").select("date", name("home_team_id").alias("home_team"), name("away_team_id").alias("away_team"), name("home_team_id").alias("winner"), "k_factor", "neutral")
    shot = shot.union(shot.where("k_factor = 60 and neutral"))
    found = intake.match_records(raw, shot, _aliases(spark, sf_dir), "orders", "v1", ["line"])
    return found.drop("tournament", "city", "country", "source", "source_version")


@query(""", fx AS (SELECT CASE WHEN k_factor = 30 AND home_region = 3 THEN 'MX' ELSE match_id END AS id, CASE WHEN home_region = away_region THEN 'group' WHEN k_factor = 60 THEN 'friendly' ELSE 'final' END AS stage,
  CASE WHEN home_region = away_region THEN chr(CAST(65 + home_region AS INTEGER)) END AS grp, CASE WHEN NOT (k_factor = 40 AND home_score = 0) THEN home_team_id || year(date) END AS hs, away_team_id || year(date) AS aws,
  CASE WHEN NOT (k_factor = 50 AND home_score = 0) THEN home_team_id END AS h, away_team_id AS a, k_factor = 20 AND home_score = 2 AS local, home_region = 2 AND k_factor = 30 AS elsewhere FROM m),
tm AS (SELECT lower(replace(n_name, '_', '-')) AS t, n_regionkey <> 3 AS part FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'nobody', true),
pl AS (SELECT t AS own, count(*) AS all_rows, count(*) FILTER (stage = 'group') AS n FROM (SELECT h AS t, stage FROM fx UNION ALL SELECT a, stage FROM fx) WHERE t IS NOT NULL GROUP BY 1),
tp AS (SELECT *, coalesce(part, false) AS takes, coalesce(n, 0) AS games FROM pl FULL JOIN tm ON own = t),
gr AS (SELECT coalesce(w, grp) AS g, w, coalesce(n, 0) AS n FROM (SELECT grp, count(*) AS n FROM fx WHERE stage = 'group' GROUP BY 1) FULL JOIN (SELECT unnest(['A', 'B', 'C', 'D', 'F']) AS w) ON grp = w)
SELECT 'unsupported stage' AS rule, id AS subject, count(*) AS rows FROM fx WHERE stage = 'friendly' GROUP BY 2
UNION ALL SELECT 'unsupported host country', id, count(*) FROM fx WHERE elsewhere GROUP BY 2
UNION ALL SELECT 'kickoff is not UTC', id, count(*) FROM fx WHERE local GROUP BY 2
UNION ALL SELECT 'group match without teams', id, count(*) FROM fx WHERE stage = 'group' AND h IS NULL GROUP BY 2
UNION ALL SELECT 'knockout match without slots', id, count(*) FROM fx WHERE stage <> 'group' AND hs IS NULL GROUP BY 2
UNION ALL SELECT 'repeated match_id', id, count(*) FROM fx GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'repeated pairing', least(hs, aws) || '::' || greatest(hs, aws), count(*) FROM fx WHERE hs IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'number of matches', 'fixture', count(*) FROM fx HAVING count(*) <> 104
UNION ALL SELECT CASE WHEN w IS NULL THEN 'unsupported group' ELSE 'matches of a group' END, g, n FROM gr WHERE w IS NULL OR n <> 6
UNION ALL SELECT 'unknown team', own, all_rows FROM tp WHERE t IS NULL
UNION ALL SELECT 'participant without group matches', t, games FROM tp WHERE takes AND games = 0
UNION ALL SELECT 'team of a group match is no participant', t, games FROM tp WHERE t IS NOT NULL AND NOT takes AND games > 0
UNION ALL SELECT 'group appearances', t, games FROM tp WHERE takes AND games NOT IN (0, 3)""")
def fixture_faults(spark, sf_dir):
    """The match view as the fixture of a tournament that it is not, with planted faults of every kind."""
    m = scans.matches(spark, sf_dir)
    k, goals_, group = F.col("k_factor"), F.col("home_score"), F.col("home_region") == F.col("away_region")
    fixture = m.select(
        F.when((k == 30) & (F.col("home_region") == 3), "MX").otherwise(F.col("match_id")).alias("match_id"), F.when(group, "group").when(k == 60, "friendly").otherwise("final").alias("stage"),
        F.when(group, F.char(65 + F.col("home_region"))).alias("group"), F.when(~((k == 40) & (goals_ == 0)), F.concat("home_team_id", F.year("date").cast("string"))).alias("home_slot"), F.concat("away_team_id", F.year("date").cast("string")).alias("away_slot"),
        F.when(~((k == 50) & (goals_ == 0)), F.col("home_team_id")).alias("home_team_id"), "away_team_id", F.concat(F.col("date").cast("string"), F.lit("T18:00:00"), F.when((k == 20) & (goals_ == 2), "").otherwise("Z")).alias("kickoff_utc"),
        F.when((F.col("home_region") == 2) & (k == 30), "BRA").otherwise("CAN").alias("host_country"),
    )
    teams = scans.parquet(spark, sf_dir, "nation").where("n_nationkey <> 7").select(F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")).alias("team_id"), (F.col("n_regionkey") != 3).alias("participates"))
    teams = teams.union(spark.createDataFrame([("nobody", True)], "team_id string, participates boolean"))
    return intake.fixture_faults(fixture, teams, intake.Structure(groups=("A", "B", "C", "D", "F")))


@query(""", c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS code, c_acctbal AS bal, CASE WHEN c_custkey % 17 = 0 THEN 'shared-' || c_custkey // 34 ELSE c_name END AS name FROM customer),
li AS (SELECT code, CAST(k AS INTEGER) AS rank, CASE WHEN k % 11 <> 0 THEN bal END AS rating FROM c WHERE k % 7 <> 0),
nm AS (SELECT code, name FROM c WHERE k % 13 <> 0),
al2 AS (SELECT CASE WHEN k % 29 = 0 THEN 'common-' || k // 58 ELSE name END AS source_name, code AS team_id FROM c WHERE k % 19 <> 0 UNION ALL SELECT name || ' II', code FROM c WHERE k % 23 = 0),
mine AS (SELECT code AS team_id FROM c WHERE k % 5 <> 0),
us AS (SELECT DISTINCT a.* FROM al2 a JOIN mine USING (team_id)),
ta AS (SELECT team_id, count(*) AS n_aliases, min(source_name) AS source_name FROM us GROUP BY 1),
na AS (SELECT source_name, count(*) AS n_teams FROM us GROUP BY 1),
en AS (SELECT name, count(*) AS n_codes, min({'code': code, 'rank': rank, 'rating': rating}) AS e FROM li JOIN nm USING (code) GROUP BY 1)
SELECT team_id, source_name, e.code AS code, e.rank AS rank, e.rating AS rating, CASE WHEN source_name IS NULL THEN 'no alias' WHEN n_aliases > 1 THEN 'several aliases' WHEN n_teams > 1 THEN 'alias of several teams' WHEN e IS NULL THEN 'no rating'
  WHEN n_codes > 1 THEN 'name of several codes' WHEN e.rating IS NULL THEN 'rating is no number' END AS verdict, team_id AS place
FROM mine LEFT JOIN ta USING (team_id) LEFT JOIN na USING (source_name) LEFT JOIN en ON source_name = name
UNION ALL SELECT NULL, NULL, code, rank, rating, 'code without a name', code FROM li WHERE code NOT IN (SELECT code FROM nm)""")
def rating_records(spark, sf_dir):
    """Customers as teams: a list of codes, names of codes and aliases, each with gaps and repetitions."""
    k = F.col("k")
    c = scans.parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("code"), F.col("c_acctbal").alias("rating"), F.when(F.col("c_custkey") % 17 == 0, F.expr("'shared-' || (c_custkey div 34)")).otherwise(F.col("c_name")).alias("name"))
    listed = c.where("k % 7 <> 0").select("code", k.cast("int").alias("rank"), F.when(k % 11 != 0, F.col("rating")).alias("rating"))
    aliases = c.where("k % 19 <> 0").select(F.when(k % 29 == 0, F.expr("'common-' || (k div 58)")).otherwise(F.col("name")).alias("source_name"), F.col("code").alias("team_id"))
    aliases = aliases.union(c.where("k % 23 = 0").select(F.concat("name", F.lit(" II")), "code"))
    return intake.rating_records(listed, c.where("k % 13 <> 0").select("code", "name"), aliases, c.where("k % 5 <> 0").select(F.col("code").alias("team_id")))


BENCHMARK = """, fx AS (SELECT match_id, CAST(date AS TIMESTAMP) + INTERVAL 18 HOUR AS kickoff, home_team_id AS h, away_team_id AS a, k_factor AS k FROM m),
raw AS (SELECT match_id AS event_id, line, k, CASE WHEN k = 50 AND line = 2 THEN '1' ELSE CAST(line AS VARCHAR) END AS bookmaker, line % 2 = 0 AS turned, CASE WHEN k = 40 AND line = 3 THEN NULL WHEN line % 2 = 0 THEN a ELSE h END AS qh, CASE WHEN line % 2 = 0 THEN h ELSE a END AS qa,
  kickoff + (k - 20) * INTERVAL 20 MINUTE AS commence, line * 5 > 24 AS late, CASE WHEN line = 3 THEN CASE WHEN k = 30 THEN 'M0' ELSE match_id END END AS declared, CASE WHEN k = 40 AND line = 4 THEN 1.0 ELSE price_home END AS x, price_draw AS y, price_away AS z FROM q JOIN fx USING (match_id)),
ln AS (SELECT event_id, line, count(fx.match_id) AS n, min(fx.match_id) AS match_id, bool_and(fx.h <> qh) AS swapped FROM (SELECT DISTINCT event_id, line, qh, qa, commence FROM raw) LEFT JOIN fx ON least(qh, qa) = least(fx.h, fx.a) AND greatest(qh, qa) = greatest(fx.h, fx.a) AND qh IS NOT NULL AND abs(epoch_us(kickoff) - epoch_us(commence)) <= 43200000000 GROUP BY 1, 2),
jn AS (SELECT event_id, bookmaker, qh, qa, declared, late, n, CASE WHEN n = 1 THEN match_id END AS match_id, n = 1 AND swapped AS sw, x, y, z FROM raw JOIN ln USING (event_id, line)),
ori AS (SELECT *, CASE WHEN sw THEN qa ELSE qh END AS home_team_id, CASE WHEN sw THEN qh ELSE qa END AS away_team_id, CASE WHEN sw THEN z ELSE x END AS price_home, y AS price_draw, CASE WHEN sw THEN x ELSE z END AS price_away FROM jn),
jud AS (SELECT *, CASE WHEN qh IS NULL THEN 'unknown team' WHEN n = 0 THEN 'no fixture' WHEN n > 1 THEN 'several fixtures' WHEN declared <> match_id THEN 'another match declared' WHEN late THEN 'stale' WHEN least(x, y, z) <= 1 THEN 'price not above 1' END AS v,
  1 / price_home + 1 / price_draw + 1 / price_away AS s FROM ori),
bm AS (SELECT event_id, match_id, bookmaker, home_team_id, away_team_id, price_home, price_draw, price_away, CASE WHEN least(x, y, z) > 1 THEN 1 / price_home / s END AS prob_home, CASE WHEN least(x, y, z) > 1 THEN 1 / price_draw / s END AS prob_draw,
  CASE WHEN least(x, y, z) > 1 THEN 1 / price_away / s END AS prob_away, CASE WHEN least(x, y, z) > 1 THEN s - 1 END AS overround, coalesce(v, CASE WHEN count(*) FILTER (v IS NULL) OVER (PARTITION BY match_id, bookmaker) > 1 THEN 'repeated quote' END) AS verdict, event_id || '/' || bookmaker AS place FROM jud)
"""


@query(BENCHMARK + "SELECT * FROM bm")
def benchmark_records(spark, sf_dir):
    """Quotes of which every second one has the sides the other way round, some off in time, stale, unpriced, repeated or of another match."""
    m = scans.matches(spark, sf_dir).select("match_id", (F.to_timestamp("date") + F.expr("interval 18 hours")).alias("kickoff"), "home_team_id", "away_team_id", "k_factor")
    k, line, turned = F.col("k_factor"), F.col("line"), F.col("line") % 2 == 0
    rows = scans.quotes(spark, sf_dir).drop("bookmaker").join(m, "match_id").select(
        F.col("match_id").alias("event_id"), F.when((k == 50) & (line == 2), "1").otherwise(line.cast("string")).alias("bookmaker"),
        F.when((k == 40) & (line == 3), None).when(turned, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("home_team_id"), F.when(turned, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("away_team_id"),
        (F.col("kickoff") + F.make_dt_interval(mins=(k - 20) * 20)).alias("commence_time"), (F.lit("2000-01-01").cast("timestamp") - F.make_dt_interval(hours=line * 5)).alias("updated_at"),
        F.when(line == 3, F.when(k == 30, "M0").otherwise(F.col("match_id"))).alias("declared_match_id"), F.when((k == 40) & (line == 4), 1.0).otherwise(F.col("price_home")).alias("price_home"), "price_draw", "price_away",
    )
    return intake.benchmark_records(rows, m.drop("k_factor"), F.lit("2000-01-01").cast("timestamp"))


@query(BENCHMARK + """, md AS (SELECT match_id, median(prob_home) AS h, median(prob_draw) AS d, median(prob_away) AS a, avg(prob_home) AS prob_home_mean, avg(prob_draw) AS prob_draw_mean, avg(prob_away) AS prob_away_mean, count(DISTINCT bookmaker) AS n_bookmakers FROM bm WHERE verdict IS NULL GROUP BY 1)
SELECT match_id, '2000-01-01T00:00:00Z' AS captured_at_utc, h / (h + d + a) AS prob_home, d / (h + d + a) AS prob_draw, a / (h + d + a) AS prob_away, prob_home_mean, prob_draw_mean, prob_away_mean, n_bookmakers FROM md""")
def frozen_benchmark(spark, sf_dir):
    """The consensus of the good quotes."""
    good = benchmark_records(spark, sf_dir).where("verdict is null")
    return intake.freeze(good, F.make_timestamp_ltz(*[F.lit(x) for x in (2000, 1, 1, 0, 0)], F.lit(0).cast("decimal(8,6)"), F.lit("UTC")))


@query("""SELECT * FROM (SELECT 'results' AS "table", 'conduct' AS rule, count(*) FILTER (k_factor = 20) AS rows FROM m
UNION ALL SELECT 'results', 'advanced team plays', count(*) FILTER (k_factor = 30) FROM m
UNION ALL SELECT 'results', 'advanced team won', count(*) FILTER (home_score <> away_score AND (k_factor = 30 OR (k_factor = 40 AND home_score > away_score))) FROM m
UNION ALL SELECT 'results', 'unique match_id', 2 * count(*) FILTER (k_factor = 50) FROM m
UNION ALL SELECT 'upcoming', 'sum', count(*) FILTER (neutral) FROM preds UNION ALL SELECT 'upcoming', 'team_b is not null', count(*) FILTER (outcome = 2) FROM preds
UNION ALL SELECT 'upcoming', 'shares', count(*) FILTER (season = 1995) FROM preds
UNION ALL SELECT 'frozen_benchmark', 'captured is UTC', count(*) FILTER (season > 1996) FROM preds UNION ALL SELECT 'frozen_benchmark', 'n_bookmakers is not null', count(*) FILTER (outcome = 0) FROM preds
UNION ALL SELECT 'ledger', 'outcome', count(*) FILTER (season = 1994) FROM preds UNION ALL SELECT 'ledger', 'model_version is not null', count(*) FILTER (neutral) + count(*) FILTER (neutral AND season = 1997) FROM preds
UNION ALL SELECT 'ledger', 'unique match_id, snapshot_id', 2 * count(*) FILTER (season = 1997) FROM preds) WHERE rows > 0""")
def publication_report(spark, sf_dir):
    """The tables of a snapshot against their contracts, with planted faults."""
    m = scans.matches(spark, sf_dir)
    p, k, neutral, season = predictions(m), F.col("k_factor"), F.col("neutral"), F.col("season")
    advanced = F.when(k == 30, "nobody").when(k == 40, F.col("away_team_id"))
    results = m.select("match_id", F.col("home_team_id").alias("team_a"), F.col("away_team_id").alias("team_b"), F.col("home_score").alias("goals_a"), F.col("away_score").alias("goals_b"), F.when(k == 20, 1).otherwise(-1).alias("fair_play_a"), F.lit(None).alias("fair_play_b"), advanced.alias("advanced_team"))
    results = results.union(results.join(m.where(k == 50).select("match_id"), "match_id", "left_semi"))
    off = F.when(season == 1995, 2.0).otherwise(0.0)
    upcoming = p.select("match_id", F.lit("a").alias("team_a"), F.when(F.col("outcome") != 2, "b").alias("team_b"), (F.col("p_home") + off).alias("prob_a"), (F.col("p_draw") - off).alias("prob_draw"), (F.col("p_away") + F.when(neutral, 0.01).otherwise(0.0)).alias("prob_b"))
    means = [F.col(f"p_{s}").alias(f"prob_{s}{end}") for end in ("", "_mean") for s in ("home", "draw", "away")]
    frozen = p.select("match_id", F.when(season > 1996, "2000-01-01").otherwise("2000-01-01T00:00:00Z").alias("captured_at_utc"), *means, F.when(F.col("outcome") != 0, 3).alias("n_bookmakers"))
    ledger_ = p.select("match_id", season.cast("string").alias("snapshot_id"), F.when(~neutral, "v1").alias("model_version"), F.col("p_home").alias("prob_a"), F.col("p_draw").alias("prob_draw"), F.col("p_away").alias("prob_b"), F.when(season == 1994, 3).otherwise(F.col("outcome")).alias("outcome_idx"))
    ledger_ = ledger_.union(ledger_.where("snapshot_id = '1997'"))
    return contracts.publication_report({"results": results, "upcoming": upcoming, "frozen_benchmark": frozen, "ledger": ledger_}).where("rows > 0")
