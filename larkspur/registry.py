"""Registration of queries with their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under a name, with the DuckDB form of its result."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# Views of the driver tables as the interaction data that the operators work on, in SQL. The
# DataFrame forms are in sources/adapters.py.
RATINGS = """ratings AS (
  SELECT user_id, CAST(props->>'$.k' AS BIGINT) AS movie_id, value AS rating, ts, epoch_us(ts) / 1e6 AS ts_s, event_id
  FROM events)"""
STARS = """stars AS (
  SELECT user_id, movie_id, least(5.0, 0.5 + 0.5 * floor(rating / 20)) AS rating, ts, ts_s, event_id FROM ratings)"""
MOVIES = """movies AS (
  SELECT p_partkey AS movie_id,
         CASE WHEN p_size % 7 = 0 THEN p_name ELSE p_name || ' (' || (1950 + p_size) || ')' END AS raw_title,
         concat_ws('|', p_type, replace(p_name, ' ', '|')) AS genres_text, p_size, p_brand, p_retailprice
  FROM part)"""
ZSCORED = RATINGS + """,
m AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS std, count(*) AS n FROM ratings GROUP BY user_id),
positives AS (
  SELECT r.*, (r.rating - mean) / (std + 1e-8) AS z,
         row_number() OVER (PARTITION BY r.user_id ORDER BY r.ts, r.movie_id, r.event_id) - 1 AS event_idx,
         r.movie_id % 10 <> 7 AS known
  FROM ratings r JOIN m USING (user_id) WHERE (r.rating - mean) / (std + 1e-8) > 0)"""
