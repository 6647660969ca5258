"""Queries on ingestion, validation, summaries and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.outcomes import decode, elo_score, encode, points
from ..functions.seasons import recent_seasons_of
from ..functions.seasons import season_code as code
from ..functions.seasons import season_of as season
from ..functions.seasons import start_year
from ..operators import matches as ops
from ..operators.features import unknown_teams
from ..schema import KEY, MATCHES
from ..sources import matches as source
from ..sources.shared import materialised, released, shared_folder
from ..sources.warehouse import matches, raw_matches, table, with_odds
from .base import CUTOFF, KEYS, Book, number, rounded, season_sql, sql

BOOK = Book()
_ALL = ", ".join(MATCHES.fieldNames())


# --- raw rows as files would hold them -----------------------------------------------------------------------------

#: q varies from match to match; it decides what is wrong or missing in a raw row.
RAW_SQL = """raw AS (SELECT *, (k * 7 + ft_home_goals * 5 + ft_away_goals * 3) % 1000 AS q FROM (SELECT m.*, m1.k FROM m JOIN m1 USING (league, date, home, away)))"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as strings with damage: missing goals and results, spaces, old team names, odds in several columns."""
    k = F.year("date") * 7 + F.month("date") * 31 + F.day("date") * 3 + F.length("home") * 5 + number("home") * 13 + number("away") * 19
    m = matches(spark, sf_dir).withColumn("q", (k * 7 + F.col("ft_home_goals") * 5 + F.col("ft_away_goals") * 3) % 1000)
    every = lambda n, of: F.col("q") % n == of
    text = lambda c: F.col(c).cast("string")
    return m.select(
        "league",
        F.when(every(3, 0), F.date_format("date", "dd/MM/yyyy")).when(every(3, 1), F.date_format("date", "dd/MM/yy")).when(every(29, 5), F.lit("soon")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("Date"),
        F.when(every(4, 0), F.concat(F.lit("Old "), "home")).otherwise(F.concat(F.lit(" "), "home", F.lit(" "))).alias("HomeTeam"),
        F.concat(F.lit(" "), "away").alias("AwayTeam"),
        F.when(~every(13, 0), text("ft_home_goals")).alias("FTHG"),
        F.when(~every(19, 0), F.concat(text("ft_away_goals"), F.lit(".0"))).alias("FTAG"),
        F.when(every(17, 0), "").otherwise(F.concat(F.lit(" "), "result", F.lit(" "))).alias("FTR"),
        F.when(every(5, 0), text("odds_home")).alias("PSCH"),
        F.when(every(5, 0), text("odds_draw")).alias("PSCD"),
        F.when(every(5, 0), text("odds_away")).alias("PSCA"),
        F.when(every(7, 0), "n/a").otherwise(text("odds_home")).alias("B365H"),
        F.lit("3.4").alias("B365D"),
        F.lit("2.1").alias("B365A"),
        F.lit("derived").alias("file"),
        F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), "league", "home", "away").alias("row"),
        F.col("q"),
    )


def _aliases(m: DataFrame) -> DataFrame:
    return ops.teams(m).select(F.concat(F.lit("Old "), "team").alias("alias"), "team").distinct()


_COMPLETE = "NOT (q % 3 = 2 AND q % 29 = 5) AND q % 13 <> 0 AND q % 19 <> 0 AND q % 17 <> 0"


@BOOK.add("SELECT DISTINCT y AS start_year, lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season FROM (SELECT CAST(year(o_orderdate) AS INT) AS y FROM orders)")
def season_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("start_year")).distinct()
    return years.select("start_year", code(F.col("start_year")).alias("season"))


@BOOK.add(sql("SELECT CAST(y AS INT) AS start_year, lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season FROM (SELECT unnest(range(s - 9, s + 1)) AS y FROM (SELECT year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END AS s FROM (SELECT max(date) AS d FROM m)))"))
def recent_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten seasons up to the one of the latest match."""
    return recent_seasons_of(matches(spark, sf_dir), 10)


#: Lines of a league's season as its file holds them; seasons that begin in an odd year have no closing odds.
_FILES_SQL = """lines AS (SELECT replace(league, ' ', '-') AS division, league, date, home, away, {season} AS season,
      (year(date) - CASE WHEN month(date) < 7 THEN 1 ELSE 0 END) % 2 = 0 AS closing, concat_ws(',',
      CASE WHEN q % 3 = 0 THEN strftime(date, '%d/%m/%Y') WHEN q % 3 = 1 THEN strftime(date, '%d/%m/%y') WHEN q % 29 = 5 THEN 'soon' ELSE strftime(date, '%Y-%m-%d') END,
      CASE WHEN q % 4 = 0 THEN 'Old ' || home ELSE ' ' || home || ' ' END, ' ' || away,
      CASE WHEN q % 13 <> 0 THEN CAST(ft_home_goals AS VARCHAR) ELSE '' END, CASE WHEN q % 19 <> 0 THEN ft_away_goals || '.0' ELSE '' END,
      CASE WHEN q % 17 = 0 THEN '' ELSE ' ' || result || ' ' END, CASE WHEN q % 7 = 0 THEN 'n/a' ELSE coalesce(CAST(odds_home AS VARCHAR), '') END, '3.4', '2.1') AS line,
      CASE WHEN q % 5 = 0 THEN ',' || coalesce(CAST(odds_home AS VARCHAR), '') || ',' || coalesce(CAST(odds_draw AS VARCHAR), '') || ',' || coalesce(CAST(odds_away AS VARCHAR), '') ELSE ',,,' END AS odds FROM raw),
files AS (SELECT league, division, season, division || '_' || season || '.csv' AS filename, count(*) AS rows,
      'Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365H,B365D,B365A' || CASE WHEN any_value(closing) THEN ',PSCH,PSCD,PSCA' ELSE '' END || chr(10)
      || string_agg(line || CASE WHEN closing THEN odds ELSE '' END, chr(10) ORDER BY date, home, away) || chr(10) AS content
      FROM lines GROUP BY league, division, season)""".format(season=season_sql())
_BASE = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "B365H", "B365D", "B365A")


def _raw_files(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    """Folder of raw files, one for each league and season, and their divisions.

    A file has at most a league's pairings on a season's days, as matches are distinct by day and teams.
    """
    place = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    part = lambda n: F.split_part("row", F.lit("|"), F.lit(n))
    day = F.to_date(part(1))
    raw = materialised(_raw(spark, sf_dir).withColumns({"division": F.replace("league", F.lit(" "), F.lit("-")), "season": season(day), "closing": start_year(day) % 2 == 0}), "raw_rows")
    for closing, columns in ((True, (*_BASE, "PSCH", "PSCD", "PSCA")), (False, _BASE)):
        rows = raw.where(F.col("closing") == closing).repartition("division", "season").sortWithinPartitions("division", "season", part(1), part(3), part(4)).select(*columns, "division", "season")
        written = f"{place}/parts-{closing}"
        rows.write.partitionBy("division", "season").options(header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(written)
        # Spark names files itself: each league and season has one, which takes the name that such files have.
        for f in system.globStatus(path(f"{written}/division=*/season=*/part-*")) or []:
            division, year = (f.getPath().getParent().getParent().getName()[9:], f.getPath().getParent().getName()[7:])
            system.rename(f.getPath(), path(f"{place}/{division}_{year}.csv"))
        system.delete(path(written), True)
    released(raw)
    return place, {r["r_name"].replace(" ", "-"): r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").distinct().collect()}


def _of_files(spark: SparkSession, place: str, result: DataFrame, name: str) -> DataFrame:
    """The result, written, after which its raw files go."""
    out = materialised(result, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


@BOOK.add(sql("SELECT league, division, season, filename, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS bytes FROM files", RAW_SQL, _FILES_SQL))
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of the raw file of every league and season."""
    place, divisions = _raw_files(spark, sf_dir)
    return _of_files(spark, place, source.file_manifest(spark, place, divisions), "manifest")


@BOOK.add(sql("SELECT l.league, season, division || '_' || season || '.csv' AS filename, count(*) AS rows, count(CASE WHEN q % 13 <> 0 THEN 1 END) AS with_goals, count(CASE WHEN closing AND q % 5 = 0 THEN odds_home END) AS with_closing_odds, count(DISTINCT home) AS hosts FROM lines l JOIN raw r USING (league, date, home, away) GROUP BY ALL", RAW_SQL, _FILES_SQL))
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw files hold when they are found in their folder and scanned by their two headers."""
    place, divisions = _raw_files(spark, sf_dir)
    raw = source.scan_folder(spark, place, divisions)
    name = F.element_at(F.split("file", "/"), -1)
    host = F.trim(F.regexp_replace("HomeTeam", "^Old ", ""))
    found = raw.groupBy("league", F.regexp_extract(name, r"_(\d{4})\.csv$", 1).alias("season"), name.alias("filename"))
    found = found.agg(F.count(F.lit(1)).alias("rows"), F.count("FTHG").alias("with_goals"), F.count("PSCH").alias("with_closing_odds"), F.count_distinct(host).alias("hosts"))
    return _of_files(spark, place, found, "scanned")


@BOOK.add(sql(f"SELECT {_ALL} FROM m"))
def scan_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir)


@BOOK.add(sql("SELECT league, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM m GROUP BY league"))
def matches_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.matches_meta(matches(spark, sf_dir))


@BOOK.add(sql("SELECT league, string_agg(team, ',' ORDER BY team) AS teams FROM (SELECT league, home AS team FROM m UNION SELECT league, away FROM m) GROUP BY league"))
def team_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.team_registry(matches(spark, sf_dir)).select("league", F.array_join("teams", ",").alias("teams"))


@BOOK.add(sql("SELECT CASE WHEN q % 3 = 0 THEN strftime(date, '%d/%m/%Y') WHEN q % 3 = 1 THEN strftime(date, '%d/%m/%y') WHEN q % 29 = 5 THEN 'soon' ELSE strftime(date, '%Y-%m-%d') END AS text, CASE WHEN q % 3 = 2 AND q % 29 = 5 THEN NULL ELSE date END AS parsed, count(*) AS n FROM raw GROUP BY ALL", RAW_SQL))
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select(F.col("Date").alias("text"))
    return ops.counts(raw.withColumn("parsed", source.parse_date(F.col("text"))), "text", "parsed")


@BOOK.add(sql(f"SELECT league, count(*) AS n FROM raw WHERE {_COMPLETE} GROUP BY league", RAW_SQL))
def completed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(_raw(spark, sf_dir).where(source.is_complete()), "league")


@BOOK.add(sql("SELECT league, CASE WHEN q % 4 = 0 THEN 'Old ' || home ELSE ' ' || home || ' ' END AS raw_name, home AS team, count(*) AS n FROM raw GROUP BY ALL", RAW_SQL))
def normalize_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    raw = _raw(spark, sf_dir).select("league", F.col("HomeTeam").alias("raw_name"), F.col("HomeTeam").alias("team"))
    return ops.counts(source.normalised(raw, _aliases(m), ("team",)), "league", "raw_name", "team")


@BOOK.add(sql("""SELECT league, date, home, away,
    CASE WHEN p THEN odds_home WHEN b THEN odds_home END AS odds_home, CASE WHEN p THEN odds_draw WHEN b THEN 3.4::DOUBLE END AS odds_draw, CASE WHEN p THEN odds_away WHEN b THEN 2.1::DOUBLE END AS odds_away
    FROM (SELECT *, coalesce(q % 5 = 0 AND odds_home > 1 AND odds_draw > 1 AND odds_away > 1, FALSE) AS p, coalesce(q % 7 <> 0 AND odds_home > 1, FALSE) AS b FROM raw)""", RAW_SQL))
def odds_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    parts = F.split("row", r"\|")
    found = raw.select(F.get(parts, F.lit(1)).alias("league"), F.get(parts, F.lit(0)).cast("date").alias("date"), F.get(parts, F.lit(2)).alias("home"), F.get(parts, F.lit(3)).alias("away"), source.best_odds(raw.columns).alias("o"))
    return found.select("league", "date", "home", "away", "o.*")


@BOOK.add(sql(f"""SELECT league, date, home, away, ft_home_goals, ft_away_goals, result,
    CASE WHEN p THEN odds_home WHEN b THEN odds_home END AS odds_home, CASE WHEN p THEN odds_draw WHEN b THEN 3.4::DOUBLE END AS odds_draw, CASE WHEN p THEN odds_away WHEN b THEN 2.1::DOUBLE END AS odds_away, source
    FROM (SELECT *, coalesce(q % 5 = 0 AND odds_home > 1 AND odds_draw > 1 AND odds_away > 1, FALSE) AS p, coalesce(q % 7 <> 0 AND odds_home > 1, FALSE) AS b FROM raw WHERE {_COMPLETE})""", RAW_SQL))
def build_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from damaged string rows to the master table."""
    m = matches(spark, sf_dir)
    return source.build_matches(_raw(spark, sf_dir), ops.teams(m), _aliases(m)).matches


BROKEN_SQL = """broken AS (SELECT league, CASE WHEN q % 31 = 1 THEN DATE '1980-01-01' ELSE date END AS date, CASE WHEN q % 11 = 1 THEN '' ELSE home END AS home,
    CASE WHEN q % 37 = 1 THEN home ELSE away END AS away, CASE WHEN q % 23 = 1 THEN -1 ELSE ft_home_goals END AS ft_home_goals, ft_away_goals,
    CASE WHEN q % 41 = 1 THEN 'X' WHEN q % 43 = 1 THEN 'D' ELSE result END AS result, odds_home, odds_draw, odds_away, CASE WHEN q % 47 = 1 THEN 'hearsay' ELSE source END AS source FROM raw)"""
JUDGED_SQL = """judged AS (SELECT *, CASE WHEN home = '' THEN 'empty_home' WHEN away = '' THEN 'empty_away' WHEN date < DATE '1990-01-01' THEN 'date' WHEN least(ft_home_goals, ft_away_goals) < 0 THEN 'goals'
    WHEN result NOT IN ('H', 'D', 'A') THEN 'result_value' WHEN least(odds_home, odds_draw, odds_away) <= 1 THEN 'odds' WHEN source NOT IN ('football-data', 'openfootball') THEN 'source'
    WHEN home = away THEN 'same_team' WHEN result <> CASE WHEN ft_home_goals > ft_away_goals THEN 'H' WHEN ft_home_goals < ft_away_goals THEN 'A' ELSE 'D' END THEN 'score' END AS reason FROM broken)"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.year("date") * 7 + F.month("date") * 31 + F.day("date") * 3 + F.length("home") * 5 + number("home") * 13 + number("away") * 19
    q = (k * 7 + F.col("ft_home_goals") * 5 + F.col("ft_away_goals") * 3) % 1000
    m = matches(spark, sf_dir).withColumn("q", q)
    hit = lambda n: F.col("q") % n == 1
    changed = {
        "date": F.when(hit(31), F.lit("1980-01-01").cast("date")).otherwise(F.col("date")),
        "home": F.when(hit(11), "").otherwise(F.col("home")),
        "away": F.when(hit(37), F.col("home")).otherwise(F.col("away")),
        "ft_home_goals": F.when(hit(23), F.lit(-1).cast("long")).otherwise(F.col("ft_home_goals")),
        "result": F.when(hit(41), "X").when(hit(43), "D").otherwise(F.col("result")),
        "source": F.when(hit(47), "hearsay").otherwise(F.col("source")),
    }
    return m.withColumns(changed).drop("q")


@BOOK.add(sql(f"SELECT {_ALL} FROM judged WHERE reason IS NULL", RAW_SQL, BROKEN_SQL, JUDGED_SQL))
def validate_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.validated(_broken(spark, sf_dir))[0]


@BOOK.add(sql("SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason", RAW_SQL, BROKEN_SQL, JUDGED_SQL))
def validation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(ops.validated(_broken(spark, sf_dir))[1], "reason")


@BOOK.add(sql(f"SELECT DISTINCT date, {season_sql()} AS season FROM m"))
def season_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("date", season(F.col("date")).alias("season")).distinct()


@BOOK.add(sql(f"SELECT {KEYS}, CASE result WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END::BIGINT AS home_points, CASE result WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END::BIGINT AS away_points, CASE result WHEN 'H' THEN 1 WHEN 'D' THEN 0.5 ELSE 0 END::DOUBLE AS score FROM m"))
def result_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("result")
    return matches(spark, sf_dir).select(*KEY, points(r, "home").alias("home_points"), points(r, "away").alias("away_points"), elo_score(r).alias("score"))


@BOOK.add(sql("SELECT result, CAST(list_position(['H', 'D', 'A'], result) - 1 AS INT) AS label, result AS decoded, count(*) AS n FROM m GROUP BY ALL"))
def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ops.counts(matches(spark, sf_dir), "result").withColumn("label", encode(F.col("result")))
    return by.select("result", "label", decode(F.col("label")).alias("decoded"), "n")


# --- joins on the registry -------------------------------------------------------------------------------------------


def _registry(m: DataFrame) -> DataFrame:
    """Teams that played before the cutoff at home, without those whose number divides by 9."""
    return m.where(F.col("date") < F.lit(CUTOFF).cast("date")).select("league", F.col("home").alias("team")).distinct().where(number("team") % 9 != 0)


REGISTRY_SQL = f"reg AS (SELECT DISTINCT league, home AS team FROM m WHERE date < DATE '{CUTOFF}' AND CAST(substr(home, 8) AS INT) % 9 <> 0)"


@BOOK.add(sql("SELECT league, home, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.league = m.league AND team = home) GROUP BY ALL", REGISTRY_SQL))
def registry_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return ops.counts(m.join(_registry(m).withColumnRenamed("team", "home"), ["league", "home"], "left_anti"), "league", "home")


@BOOK.add(sql("SELECT league, home, count(*) AS n FROM m WHERE EXISTS (SELECT 1 FROM reg WHERE reg.league = m.league AND team = home) GROUP BY ALL", REGISTRY_SQL))
def registry_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return ops.counts(m.join(_registry(m).withColumnRenamed("team", "home"), ["league", "home"], "left_semi"), "league", "home")


@BOOK.add(sql("SELECT league, team FROM (SELECT league, home AS team FROM m UNION SELECT league, away FROM m) WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.league = league AND reg.team = team)".replace("reg.league = league AND reg.team = team", "reg.league = x.league AND reg.team = x.team").replace("FROM m) WHERE", "FROM m) x WHERE"), REGISTRY_SQL))
def unknown_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return unknown_teams(m, _registry(m))


@BOOK.add(sql("SELECT league, home AS team FROM m UNION SELECT league, away FROM m EXCEPT SELECT league, team FROM reg", REGISTRY_SQL))
def unknown_teams_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return ops.teams(m).exceptAll(_registry(m)).distinct()


@BOOK.add("SELECT d.league, count(*) AS n FROM (SELECT 'D' || CAST(n_regionkey AS VARCHAR) AS division FROM nation) f JOIN (VALUES ('D0', 'zero'), ('D1', 'one'), ('D3', 'three')) d(division, league) USING (division) GROUP BY d.league")
def division_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File divisions to leagues; unknown divisions drop out."""
    known = spark.createDataFrame([("D0", "zero"), ("D1", "one"), ("D3", "three")], "division string, league string")
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("division"))
    return ops.counts(files.join(F.broadcast(known), "division"), "league")


# --- deduplication, summaries, sets ----------------------------------------------------------------------------------


@BOOK.add(sql(f"SELECT {KEYS}, ft_home_goals, ft_away_goals FROM m"))
def dedupe_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return ops.keep_first(raw_matches(spark, sf_dir), order).select(*KEY, "ft_home_goals", "ft_away_goals")


@BOOK.add(sql("SELECT league, count(*) AS n FROM m GROUP BY league ORDER BY n DESC, league"))
def league_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(matches(spark, sf_dir), "league").orderBy(F.col("n").desc(), "league")


@BOOK.add(sql("SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT league) AS leagues FROM m"))
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.profile(matches(spark, sf_dir))


_LEAGUES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@BOOK.add(sql(f"SELECT {season_sql()} AS season, " + ", ".join(f"count(*) FILTER (WHERE league = '{n}') AS \"{n}\"" for n in _LEAGUES) + " FROM m GROUP BY 1"))
def season_league_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.season_by_league(matches(spark, sf_dir), list(_LEAGUES))


@BOOK.add(sql("SELECT result, round(count(*)::DOUBLE / (SELECT count(*) FROM m), 3) AS share FROM m GROUP BY result"))
def outcome_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.outcome_share(matches(spark, sf_dir))


@BOOK.add(sql("SELECT " + ", ".join(f"round(avg(({c} IS NULL)::INT), 6) AS {c}" for c in ("odds_home", "odds_draw", "odds_away")) + " FROM m"))
def missing_odds_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matches(spark, sf_dir).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in ("odds_home", "odds_draw", "odds_away")]))


@BOOK.add(sql("SELECT round(avg(ft_home_goals), 6) AS home_goals, round(avg(ft_away_goals), 6) AS away_goals FROM m"))
def mean_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matches(spark, sf_dir).agg(F.avg("ft_home_goals").alias("home_goals"), F.avg("ft_away_goals").alias("away_goals")))


@BOOK.add(sql("SELECT ft_home_goals + ft_away_goals AS goals, count(*) AS n FROM m GROUP BY goals ORDER BY goals"))
def goal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).select((F.col("ft_home_goals") + F.col("ft_away_goals")).alias("goals"))
    return ops.counts(m, "goals").orderBy("goals")


@BOOK.add(sql(f"SELECT {_ALL} FROM m ORDER BY date, league, home, away LIMIT 5"))
def head_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).orderBy("date", "league", "home", "away").limit(5)


@BOOK.add(sql("SELECT league, count(*) AS n, count(odds_home) AS with_odds FROM (SELECT league, odds_home FROM m UNION ALL SELECT league, NULL FROM m0) GROUP BY league"))
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with and without columns of odds, one after the other."""
    both = source.union_sources(matches(spark, sf_dir), raw_matches(spark, sf_dir).select("league", "date", "home", "away"))
    return both.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.count("odds_home").alias("with_odds"))


@BOOK.add(sql("SELECT league, home AS team FROM m UNION SELECT league, away FROM m"))
def distinct_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.teams(matches(spark, sf_dir))


@BOOK.add(sql("SELECT count(*) AS n FROM m WHERE year(date) - CASE WHEN month(date) < 7 THEN 1 ELSE 0 END = 1998 AND odds_home > 2"))
def pruned_season_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of one season at long odds: filters and columns reach the scans."""
    m = with_odds(matches(spark, sf_dir).drop("odds_home", "odds_draw", "odds_away"))
    return m.where((start_year(F.col("date")) == 1998) & (F.col("odds_home") > 2)).agg(F.count(F.lit(1)).alias("n"))
