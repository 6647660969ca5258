"""What registered queries share: rounding, fixed test vectors, and the SQL of the derived matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

#: A constant forecast for queries on the market: with implied probabilities all three expected values are equal.
FORECAST = (0.45, 0.27, 0.28)
#: Days that split the derived matches: a cutoff for fixtures, and "today".
CUTOFF, TODAY = "1999-03-01", "2001-08-15"
#: Candidates' features where a query fits models.
KEYS = "league, date, home, away"


class Book:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the function under its name; sql is its counterpart, if there is one."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded, as sums in another order differ in the last digits; negative zero becomes zero.

    As SQL does it, by the double's product with a power of ten: 641 / 640 is 1.001562 so, and 1.001563 by its decimal digits.
    """
    scale = F.lit(10.0**digits)
    return df.select(*[(F.round(F.col(c.name) * scale) / scale + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema])


def number(name: str | Column) -> Column:
    """The number in a derived team name such as NATION_12."""
    return F.substring(name, 8, 20).cast("int")


def with_forecast(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(p) for c, p in zip(("p_home", "p_draw", "p_away"), FORECAST)})


MATCHES_SQL = """
m0 AS (SELECT r_name AS league, CAST(o_orderdate AS DATE) AS date, h.n_name AS home, a.n_name AS away,
              CAST(l_partkey % 4 AS BIGINT) AS ft_home_goals, CAST(l_suppkey % 3 AS BIGINT) AS ft_away_goals,
              row_number() OVER (PARTITION BY r_name, CAST(o_orderdate AS DATE), h.n_name, a.n_name
                  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN customer ON o_custkey = c_custkey JOIN nation h ON s_nationkey = h.n_nationkey
       JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON h.n_regionkey = r_regionkey
       WHERE h.n_regionkey = a.n_regionkey AND h.n_name <> a.n_name),
m1 AS (SELECT *, year(date) * 7 + month(date) * 31 + day(date) * 3 + length(home) * 5
                 + 13 * CAST(substr(home, 8) AS INT) + 19 * CAST(substr(away, 8) AS INT) AS k
       FROM m0 WHERE rn = 1),
m AS (SELECT league, date, home, away, ft_home_goals, ft_away_goals,
             CASE WHEN ft_home_goals > ft_away_goals THEN 'H' WHEN ft_home_goals < ft_away_goals THEN 'A' ELSE 'D' END AS result,
             CASE WHEN k % 11 <> 0 THEN CAST(120 + 10 * (k % 29) AS DOUBLE) / 100 END AS odds_home,
             CASE WHEN k % 11 <> 0 THEN CAST(240 + 10 * (k % 13) AS DOUBLE) / 100 END AS odds_draw,
             CASE WHEN k % 17 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(130 + 10 * (k % 37) AS DOUBLE) / 100 END AS odds_away,
             'football-data' AS source
      FROM m1)"""

SEASON_SQL = "lpad(CAST((year({d}) - CASE WHEN month({d}) < 7 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year({d}) - CASE WHEN month({d}) < 7 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0')"


def season_sql(day: str = "date") -> str:
    return SEASON_SQL.format(d=day)


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """A statement over m (the derived matches) and further common tables."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([MATCHES_SQL, *ctes]) + "\n" + body


#: Rows with usable odds and the probabilities they imply.
USABLE_SQL = """u AS (SELECT *, (1 / odds_home) / v AS p_home, (1 / odds_draw) / v AS p_draw, (1 / odds_away) / v AS p_away
      FROM (SELECT *, 1 / odds_home + 1 / odds_draw + 1 / odds_away AS v FROM m
            WHERE odds_home > 1 AND odds_draw > 1 AND odds_away > 1))"""
