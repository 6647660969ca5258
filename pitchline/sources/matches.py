"""Raw result files to the master table, and the master table's files.

Headers differ from file to file, so the files of each header are read as strings and then united by name. A row must
be complete before its teams are looked up; an unknown team in a complete row stops the build; rows that break a rule
are kept apart with the reason.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matches import keep_first, validated
from ..schema import GOALS, MATCHES, ODDS

#: Divisions as they begin file names, and their leagues.
DIVISIONS = {
    "E0": "English Premier League",
    "SP1": "Spanish La Liga",
    "I1": "Italian Serie A",
    "D1": "German Bundesliga",
    "F1": "French Ligue 1",
    "G1": "Greek Super League",
}
#: Columns of odds (home, draw, away), closing prices first, in order of preference.
ODDS_COLUMNS = (
    ("PSCH", "PSCD", "PSCA"),
    ("B365CH", "B365CD", "B365CA"),
    ("AvgCH", "AvgCD", "AvgCA"),
    ("PSH", "PSD", "PSA"),
    ("B365H", "B365D", "B365A"),
    ("AvgH", "AvgD", "AvgA"),
)
SOURCE = "football-data"
#: Files up to this size are hashed as one value; longer ones are read in chunks of the second size.
WHOLE, CHUNK = 1 << 26, 1 << 23


class UnknownTeam(ValueError):
    """A complete row names a team that its league's registry lacks."""


def parse_date(text: Column) -> Column:
    """Day-first dates with four- or two-digit years (69 to 99: 19..), or ISO dates; anything else is null."""
    t = F.trim(text)
    long_, short, iso = (F.try_to_date(t, fmt) for fmt in ("d/M/yyyy", "d/M/yy", "yyyy-MM-dd"))
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    year = F.length(F.element_at(F.split(t, "/"), -1))
    return F.when(F.contains(t, F.lit("/")), F.when(year == 2, short).when(year == 4, long_)).otherwise(iso)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """CSV files in a folder of any file system that Spark knows, sorted by name."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(str(f.getPath()) for f in found if f.getPath().getName().endswith(".csv"))


def division_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/_]+)(?:_[^/]*)?\.csv$", 1)


def _path() -> Column:
    """The path of a row's file; Spark's own column is percent-encoded."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def _opened(path: str) -> pa.NativeFile:
    """A stream of the file at a path as Spark writes it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def _streams(folder: str) -> bool:
    """Whether pyarrow knows the file system of this folder."""
    try:
        return folder.startswith(("file:", "/")) or bool(fs.FileSystem.from_uri(folder))
    except (pa.ArrowException, OSError):
        return False


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each file; nothing is read beyond the chunk that ends it."""
    for batch in batches:
        lines = []
        for path in batch["path"].to_pylist():
            with _opened(path) as stream:
                line = b""
                while b"\n" not in line and (chunk := stream.read(1 << 16)):
                    line += chunk
            lines.append(line.split(b"\n")[0].decode("latin-1"))
        yield pa.record_batch([batch["path"], pa.array(lines, pa.string())], ["path", "header"])


def _by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The paths grouped by the first line of their files, in order of each group's first path.

    One job reads the first lines only; on a file system that pyarrow doesn't know, it passes over the texts.
    """
    if _streams(paths[0]):
        tasks = min(len(paths), spark.sparkContext.defaultParallelism * 4)
        first = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInArrow(_first_lines, "path string, header string")
    else:
        text = spark.read.option("encoding", "ISO-8859-1").text(paths)
        rows = text.select(_path().alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"), "value")
        first = rows.where("place.block = 0").groupBy("path").agg(F.min_by("value", "place").alias("header"))
    groups = first.where("header != ''").groupBy(F.rtrim("header", F.lit("\r ")).alias("header")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return sorted(r["paths"] for r in groups.collect())


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one header, all columns as strings, with file (its path) and row (rises within a file)."""
    df = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(paths)
    return df.select("*", _path().alias("file"), F.monotonically_increasing_id().alias("row"))


def scan_folder(spark: SparkSession, folder: str, divisions: dict[str, str] = DIVISIONS) -> DataFrame | None:
    """All files of known divisions that have a Date column, united by column name; league by file name.

    There is one scan for each distinct header, however many files share it. Files without a line, and those whose
    header lacks Date, are left out; None if nothing is left.
    """
    paths = [p for p in list_files(spark, folder) if p.rsplit("/", 1)[-1].removesuffix(".csv").split("_")[0] in divisions]
    league = F.create_map(*[F.lit(x) for pair in divisions.items() for x in pair])
    groups = [read_raw(spark, group) for group in (_by_header(spark, paths) if paths else [])]
    frames = [df.withColumn("league", league[division_of(F.col("file"))]) for df in groups if "Date" in df.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


_FILE = "path string, filename string, bytes long, modified timestamp, sha256 string"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files too long for a row, read chunk by chunk."""
    for batch in batches:
        found = []
        for path in batch["path"].to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "sha256"])


def file_digests(spark: SparkSession, folder: str, pattern: str = "*.csv", known: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """path, filename, bytes, modified, sha256 of all files of that name pattern below a folder.

    Files that known (the same columns) lists with the same path, length and time keep the digest they have there, and
    aren't read. Spark hashes files of at most `whole` bytes as they are; longer ones are hashed in chunks, a file a
    row, from any file system that pyarrow knows.
    """
    source = lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    own = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    listed = source().load(folder).select(*own)
    same = ["path", "bytes", "modified"]
    fresh = listed if known is None else listed.join(known, same, "left_anti").select(*listed.columns)
    # The paths of a listing are on the driver anyway, as Spark lists files there.
    short = [r["path"] for r in fresh.where(F.col("bytes") <= whole).select("path").collect()]
    found = fresh.where(F.col("bytes") > whole).repartition("path").mapInArrow(_streamed, _FILE)
    if short:
        found = found.unionByName(source().load(short).select(*own, F.sha2("content", 256).alias("sha256")))
    return found if known is None else found.unionByName(listed.join(known.select(*same, "sha256"), same))


def _manifest(files: DataFrame, divisions: dict[str, str]) -> DataFrame:
    division, known = division_of(F.col("path")), F.create_map(*[F.lit(x) for pair in divisions.items() for x in pair])
    season = F.regexp_extract("filename", r"_(\d{4})\.csv$", 1)
    rows = files.select(known[division].alias("league"), division.alias("division"), season.alias("season"), "filename", "sha256", "bytes")
    return rows.where("league is not null")


def file_manifest(spark: SparkSession, folder: str, divisions: dict[str, str] = DIVISIONS) -> DataFrame:
    """league, division, season, filename, sha256, bytes of the CSV files of known divisions."""
    return _manifest(file_digests(spark, folder), divisions)


def refreshed_manifest(spark: SparkSession, folder: str, place: str, divisions: dict[str, str] = DIVISIONS, force: bool = False) -> DataFrame:
    """The manifest of a folder, kept at `place`: only files that are new or changed since the last call are read.

    Each call writes a version of its own and reads the last complete one, so a call that fails leaves that one as it
    is; older versions go. Files that went away leave the manifest. With force all files are read again.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    held = [f.getPath() for f in system.listStatus(path(place))] if system.exists(path(place)) else []
    held = sorted((p for p in held if p.getName().startswith("v-")), key=lambda p: int(p.getName()[2:]))
    whole = [p for p in held if system.exists(path(p, "_SUCCESS"))]
    known = spark.read.schema(_FILE).parquet(str(whole[-1])) if whole and not force else None
    target = f"{place}/v-{int(held[-1].getName()[2:]) + 1 if held else 0}"
    file_digests(spark, folder, known=known).write.parquet(target)
    for old in held:
        if not whole or str(old) != str(whole[-1]):
            system.delete(old, True)
    return _manifest(spark.read.schema(_FILE).parquet(target), divisions)


def is_complete() -> Column:
    """Date, both goals and a result of H, D or A are there."""
    number = lambda c: F.col(c).try_cast("double").isNotNull()
    return parse_date(F.col("Date")).isNotNull() & number("FTHG") & number("FTAG") & F.coalesce(F.trim("FTR").isin("H", "D", "A"), F.lit(False))


def best_odds(columns: list[str], triples: tuple[tuple[str, str, str], ...] = ODDS_COLUMNS) -> Column:
    """The first triple whose three odds are there, numbers and above 1, as a struct; null if there is none."""
    found = []
    for triple in triples:
        if set(triple) <= set(columns):
            values = [F.col(c).try_cast("double") for c in triple]
            good = (values[0] > 1.0) & (values[1] > 1.0) & (values[2] > 1.0) & ~F.isnan(values[0]) & ~F.isnan(values[1]) & ~F.isnan(values[2])
            found.append(F.when(good, F.struct(*[v.alias(o) for v, o in zip(values, ODDS)])))
    kind = "struct<odds_home:double,odds_draw:double,odds_away:double>"
    return F.coalesce(*found, F.lit(None).cast(kind)) if found else F.lit(None).cast(kind)


def normalised(df: DataFrame, aliases: DataFrame | None = None, columns: tuple[str, ...] = ("home", "away")) -> DataFrame:
    """df with team names trimmed and aliases (alias, team) replaced; Spark broadcasts these if their size allows it."""
    for c in columns:
        df = df.withColumn(c, F.trim(c))
        if aliases is not None:
            own = aliases.select(F.col("alias").alias("__alias"), F.col("team").alias("__team"))
            df = df.join(own, F.col(c) == F.col("__alias"), "left").withColumn(c, F.coalesce("__team", c)).drop("__alias", "__team")
    return df


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(league, team) from a JSON object of leagues and their teams."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("league", "teams"))
    return parsed.select("league", F.explode("teams").alias("team")).distinct()


@dataclass(frozen=True)
class Build:
    matches: DataFrame
    rejects: DataFrame


def build_matches(raw: DataFrame, registry: DataFrame | None = None, aliases: DataFrame | None = None) -> Build:
    """Raw rows to the master table: complete rows with known teams that keep all rules, the first of each key.

    "First" is by file name, then by order in the file.
    """
    rows = raw.where(is_complete()).select("league", parse_date(F.col("Date")).alias("date"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"), F.col("FTHG").try_cast("double").cast("long").alias(GOALS[0]), F.col("FTAG").try_cast("double").cast("long").alias(GOALS[1]), F.trim("FTR").alias("result"), best_odds(raw.columns).alias("__odds"), F.lit(SOURCE).alias("source"), "file", "row")
    rows = normalised(rows.select(*[c for c in rows.columns if c != "__odds"], *[F.col("__odds")[o].alias(o) for o in ODDS]), aliases)
    if registry is not None:
        from ..operators.features import unknown_teams

        odd = unknown_teams(rows, registry).orderBy("league", "team").limit(20).collect()
        if odd:
            raise UnknownTeam(", ".join(f"{r['team']} ({r['league']})" for r in odd))
    good, bad = validated(rows)
    first = keep_first(good, ["file", "row"])
    return Build(first.select(*MATCHES.fieldNames()), bad.select(*MATCHES.fieldNames(), "reason"))


def write_table(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """Parquet, sorted by date within files so that a cutoff skips row groups, with a JSON note beside it."""
    df.repartitionByRange("date").sortWithinPartitions(*[c for c in ("date", "league", "home", "away") if c in df.columns]).write.mode("overwrite").parquet(path)
    if meta is not None:
        import json

        df.sparkSession.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def matches_meta(df: DataFrame) -> DataFrame:
    """league, rows, first_date, last_date: what the note beside the master table holds."""
    return df.groupBy("league").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


