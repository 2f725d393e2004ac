"""The star as stored tables in loads, and SQL over them."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbraid.operators.star import Star, label_sets
from trialbraid.schema import STAR_SCHEMAS
from trialbraid.sources import commits
from trialbraid.sources.commits import Commit, Files
from trialbraid.sources.folders import work_folder as work_folder

#: Keys that a word of 64 bits of a sidecar stands for on average, and bits a key sets.
KEYS_PER_WORD, BITS_PER_KEY = 4, 4
KEYS, PROFILE, LABELS, AGAIN = "keys", "profile", "labels", "again"
_LABELS = "study_id bigint, areas int, continents int"
_PROFILE = "table_name string, column_name string, n_rows bigint, missing bigint"


def _load_path(folder: str, table: str, load: str) -> str:
    return f"{folder}/{table}/load={load}"


def reset_tables(spark: SparkSession, folder: str) -> Star:
    """Make every earlier load invisible in one step; the schemas stay."""
    while True:
        known = commits.read_commits(spark, folder)
        number = known[-1].number + 1 if known else 0
        if commits.claim(spark, folder, Commit(number)):
            return read_star(spark, folder)


# --- Key sidecars ----------------------------------------------------------------
# A sidecar tells which keys a load may hold: a filter of one row per word of 64
# bits. A key has a word and a few bits of it, so building it is one bit_or by
# word, and a look-up is a join by word. Numbers of words are powers of two.


def _hashed(keys: DataFrame) -> DataFrame:
    bits = " | ".join(
        f"shiftleft(1L, cast(shiftrightunsigned(h, {40 + 6 * j}) & 63 AS int))" for j in range(BITS_PER_KEY)
    )
    return keys.selectExpr("study_id", "xxhash64(study_id) AS h").selectExpr("*", f"{bits} AS bits")


def _slots_for(n_keys: int) -> int:
    return 1 << max(0, (max(n_keys, 1) // KEYS_PER_WORD).bit_length())


def write_sidecar(keys: DataFrame, path: str, number: int, load: str) -> Commit:
    """Store the filter of the keys; returns the commit that describes it."""
    n, least, largest = keys.selectExpr("count(*)", "min(study_id)", "max(study_id)").first()
    slots = _slots_for(n)
    words = _hashed(keys).groupBy(F.expr(f"h & {slots - 1}L").alias("slot"))
    words.agg(F.bit_or("bits").alias("word")).write.mode("overwrite").parquet(path)
    return Commit(number, load, n, least, largest, slots)


def loads_that_may_hold(keys: DataFrame, own: Commit, folder: str, among: list[Commit]) -> list[Commit]:
    """The loads among some whose range and filter let one of the keys be there."""
    spark = keys.sparkSession
    near = [
        c for c in among
        if c.n_keys and own.n_keys and c.least <= own.largest and own.least <= c.largest
    ]
    if not near:
        return []
    words = []
    for slots in sorted({c.slots for c in near}):
        paths = [_load_path(folder, KEYS, c.load) for c in near if c.slots == slots]
        filters = spark.read.schema("slot bigint, word bigint, load string").option("basePath", f"{folder}/{KEYS}")
        words.append(filters.parquet(*paths).withColumn("slots", F.lit(slots)))
    mine = _hashed(keys).withColumn("slots", F.explode(F.array(*[F.lit(s) for s in {c.slots for c in near}])))
    mine = mine.selectExpr("slots", "h & (slots - 1L) AS slot", "bits")
    met = reduce(DataFrame.unionByName, words).join(mine, ["slots", "slot"])
    names = {r.load for r in met.where("word & bits = bits").select("load").distinct().collect()}
    return [c for c in near if c.load in names]


def _stored_already(studies: DataFrame, own: Commit, folder: str, among: list[Commit]) -> DataFrame | None:
    """Keys of the studies that are in one of the loads; only loads that may hold one are read.

    Two numbers with one key are an error.
    """
    spark = studies.sparkSession
    near = loads_that_may_hold(studies, own, folder, among)
    if not near:
        return None
    paths = [_load_path(folder, "studies", c.load) for c in near]
    known = spark.read.schema(STAR_SCHEMAS["studies"]).parquet(*paths)
    known = known.selectExpr("study_id", "nct_id AS known_id")
    met = studies.select("study_id", "nct_id").join(known, "study_id")
    clash = "raise_error('study key of two numbers: ' || nct_id || ', ' || known_id)"
    met = met.filter(f"if(nct_id = known_id, true, cast({clash} AS boolean))").select("study_id").distinct()
    path = _load_path(folder, AGAIN, own.load)
    met.write.mode("overwrite").parquet(path)
    met = spark.read.schema("study_id bigint").parquet(path)
    return None if met.isEmpty() else met


# --- Loads -------------------------------------------------------------------------
def append_tables(
    star: Star, folder: str, repeated: str = "refuse", load: str | None = None
) -> str | None:
    """Append the seven tables of a load; returns its name.

    The tables go into folders of the load and become visible together by the
    last step, a numbered commit that one writer can create. A failure before
    it leaves nothing to be seen. Study numbers are unique over all loads: one
    that is stored already is an error by default; ``repeated="skip"`` leaves
    such studies and their children out. A writer that loses the race for a
    number checks its studies against the loads that won, and tries the next.

    The star is built once. Its studies are compared with earlier loads by
    sidecars of keys, and only loads that may hold one of them are read.
    """
    if repeated not in ("refuse", "skip"):
        raise ValueError("repeated is 'refuse' or 'skip'")
    tables = star.tables()
    spark = tables["studies"].sparkSession
    load = load or uuid.uuid4().hex
    name, steps, written = load, 0, ["studies"]
    _write({"studies": tables["studies"]}, folder, name)
    known = commits.read_commits(spark, folder)
    newer = commits.visible(known)
    while True:
        number = known[-1].number + 1 if known else 0
        studies = _read(spark, folder, "studies", [name])
        commit = write_sidecar(studies, _load_path(folder, KEYS, name), number, name)
        again = _stored_already(studies, commit, folder, newer)
        if again is not None:
            if repeated == "refuse":
                raise ValueError("the load holds studies that are stored already")
            # What is written already is read from its files, the rest comes from the source.
            own = {t: _read(spark, folder, t, [name]) for t in written}
            tables = {t: df.join(again, "study_id", "left_anti") for t, df in (tables | own).items()}
            steps += 1
            name, newer = f"{load}-{steps}", []
            _write({t: tables[t] for t in written}, folder, name)
            continue
        rest = {t: df for t, df in tables.items() if t not in written}
        _write(rest, folder, name)
        written = list(tables)
        _write_profile(spark, folder, name)
        written_star = Star(lambda table, own=name: _read(spark, folder, table, [own]))
        label_sets(written_star).write.mode("overwrite").parquet(_load_path(folder, LABELS, name))
        if commits.claim(spark, folder, commit):
            return name
        known = commits.read_commits(spark, folder)
        newer = [c for c in commits.visible(known) if c.number >= number]


def _write(tables: dict[str, DataFrame], folder: str, load: str) -> None:
    for name, df in tables.items():
        df.select(STAR_SCHEMAS[name].names).write.mode("overwrite").parquet(_load_path(folder, name, load))


def _read(spark: SparkSession, folder: str, table: str, loads: list[str]) -> DataFrame:
    paths = [_load_path(folder, table, load) for load in loads]
    return spark.read.schema(STAR_SCHEMAS[table]).parquet(*paths)


def finished_loads(spark: SparkSession, folder: str) -> list[str]:
    """Names of the visible loads, oldest first; a folder without commits has none."""
    return [c.load for c in commits.visible(commits.read_commits(spark, folder))]


def read_star(spark: SparkSession, folder: str) -> Star:
    """The tables of all visible loads; the schema is fixed, so no file is opened to infer it.

    Questions on areas and continents read the label sets that every load keeps,
    one row per study, and merge them; the number of studies is that of the commits.
    """
    shown = commits.visible(commits.read_commits(spark, folder))
    loads = [c.load for c in shown]

    def make(name: str) -> DataFrame:
        if not loads:
            return spark.createDataFrame([], STAR_SCHEMAS[name])
        return _read(spark, folder, name, loads)

    def count() -> DataFrame:
        return spark.range(1).select(F.lit(sum(c.n_keys for c in shown)).cast("bigint"))

    def labels() -> DataFrame:
        if not loads:
            return spark.createDataFrame([], _LABELS)
        return spark.read.schema(_LABELS).parquet(*[_load_path(folder, LABELS, load) for load in loads])

    return Star(make, count, labels)


def reclaim(spark: SparkSession, folder: str, retention_hours: float) -> list[str]:
    """Remove the files of loads that no list shows; returns the names of the loads.

    A load goes if it was hidden, or left unfinished, longer ago than the
    retention. A reader that holds an older list keeps whole tables for that
    time; after it, reading a removed load is an error and never a part of it.
    """
    known = commits.read_commits(spark, folder)
    shown = {c.load for c in commits.visible(known)}
    files = Files(spark, folder)
    oldest = (time.time() - retention_hours * 3600) * 1000
    times = files.folders(f"{folder}/commits")
    numbers = {c.load: c.number for c in known if c.load}
    resets = [(c.number, times[f"{c.number:020d}"]) for c in known if c.load is None]
    gone = []
    for entry, changed in sorted(files.folders(f"{folder}/studies").items()):
        load = entry.removeprefix("load=")
        if load in shown or not entry.startswith("load="):
            continue
        if load in numbers:
            changed = min(t for n, t in resets if n > numbers[load])
        if changed < oldest:
            # The studies go last, so a removal that was cut short is taken up again.
            for table in [*list(STAR_SCHEMAS)[1:], KEYS, PROFILE, LABELS, AGAIN, "studies"]:
                files.remove(_load_path(folder, table, load))
            gone.append(load)
    return gone


# --- Profiles of loads -------------------------------------------------------------
def _write_profile(spark: SparkSession, folder: str, load: str) -> None:
    """Rows and missing values of every column of a load, counted once over its files."""
    parts = []
    for table, schema in STAR_SCHEMAS.items():
        df = _read(spark, folder, table, [load])
        counts = df.agg(
            F.count("*").alias("n_rows"), *[F.expr(f"count_if({c} IS NULL)").alias(c) for c in schema.names]
        )
        rows = counts.unpivot("n_rows", schema.names, "column_name", "missing")
        parts.append(rows.select(F.lit(table).alias("table_name"), "column_name", "n_rows", "missing"))
    path = _load_path(folder, PROFILE, load)
    reduce(DataFrame.union, parts).coalesce(1).write.mode("overwrite").parquet(path)


def load_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """(number, table_name, column_name, n_rows, missing) of every visible load."""
    shown = commits.visible(commits.read_commits(spark, folder))
    if not shown:
        return spark.createDataFrame([], f"number bigint, {_PROFILE}")
    numbers = spark.createDataFrame([(c.load, c.number) for c in shown], "load string, number bigint")
    paths = [_load_path(folder, PROFILE, c.load) for c in shown]
    rows = spark.read.schema(f"{_PROFILE}, load string").option("basePath", f"{folder}/{PROFILE}").parquet(*paths)
    return rows.join(F.broadcast(numbers), "load").select("number", *[c.split()[0] for c in _PROFILE.split(", ")])


def save_bucketed(star: Star, database: str, buckets: int) -> None:
    """Save the tables bucketed by study, so joins by study need no shuffle."""
    for name, df in star.tables().items():
        (
            df.write.mode("overwrite")
            .bucketBy(buckets, "study_id")
            .sortBy("study_id")
            .saveAsTable(f"{database}.{name}")
        )


def query(star: Star, sql: str) -> DataFrame:
    """Run SQL text over the star; its tables stand in braces, as in ``FROM {studies}``.

    The frames are arguments of the text, so no view is left behind.
    """
    tables = star.tables()
    used = {n: df for n, df in tables.items() if f"{{{n}}}" in sql}
    return next(iter(tables.values())).sparkSession.sql(sql, **used)
