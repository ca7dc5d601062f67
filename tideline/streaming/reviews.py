"""Continuous loading: a file stream of landing pages into a review log, and daily counts.

The log is append-only: each micro-batch of whole pages lands in its own folder, a delta named by the run (the id that Spark
gives a checkpoint) and the batch, so replaying a batch after a failure replaces that folder and nothing else, and a run with
a fresh checkpoint adds folders of its own. ``compact`` turns the deltas landed so far into one row a review, the base, and
notes up to which batch of each run it goes; readers take the newest base that is complete and the deltas behind it,
so a batch may land meanwhile. Reading the log resolves first-value and newest-value columns per review, whatever order
the pages arrived in; stored reviews are never rewritten for a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.functions.numbers import KEY_TYPE
from tideline.operators.facts import IMMUTABLE, MUTABLE, review_facts, upsert_languages
from tideline.sources.raw import RAW_SCHEMAS, explode_reviews

def raw_stream(spark: SparkSession, path: str, kind: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMAS[kind])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """Id that a checkpoint has kept since its first start; a fresh checkpoint has another one."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def typed_batch(pages: DataFrame, dim: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Landing pages -> newest copy of each review as a fact row with all its dimension keys.

    A language that ``languages`` lacks has the key that ``upsert_languages`` will give it.
    """
    reviews = explode_reviews(pages)
    if languages is None:
        languages = reviews.sparkSession.createDataFrame([], f"language_sk {KEY_TYPE}, language_code string")
    known = languages.select(F.col("language_sk").cast(KEY_TYPE).alias("language_sk"), "language_code")
    return review_facts(reviews, dim, upsert_languages(known, reviews))


def stream_review_merge(pages: DataFrame, dim: DataFrame, log: str, checkpoint: str, languages: DataFrame | None = None) -> StreamingQuery:
    """Loads all waiting pages into the review log, each page exactly once."""

    def land(batch: DataFrame, batch_id: int) -> None:
        run = run_id(batch.sparkSession, checkpoint)
        landed = typed_batch(batch, dim, languages).withColumn("landed_at", F.current_timestamp())
        landed.write.mode("overwrite").parquet(f"{log}/deltas/run={run}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


KEY = "recommendation_id"
FIRST_VALUE = IMMUTABLE
NEWEST_VALUE = (*MUTABLE, "review_body")


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, wherever Spark reads them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return [f.getPath().toString() for f in found or ()]


def landed(spark: SparkSession, log: str) -> set[tuple[str, int]]:
    """(run, batch) of the deltas that are there as a whole."""
    done = _found(spark, f"{log}/deltas/run=*/batch=*/_SUCCESS")
    return {(m[1], int(m[2])) for p in done if (m := re.search(r"/run=([^/]+)/batch=(\d+)/_SUCCESS$", p))}


def newest_base(spark: SparkSession, log: str) -> tuple[int, dict[str, int]]:
    """Number of the newest complete base, -1 if there is none, and the last batch of each run that it holds."""
    done = [int(m[1]) for p in _found(spark, f"{log}/base/gen=*/covers/_SUCCESS") if (m := re.search(r"/gen=(\d+)/", p))]
    if not done:
        return -1, {}
    number = max(done)
    return number, {r.run: r.upto for r in spark.read.parquet(f"{log}/base/gen={number}/covers").collect()}


def read_log(spark: SparkSession, log: str, batches: set[tuple[str, int]] | None = None) -> DataFrame:
    """The newest base and the deltas behind it, of ``batches`` or of all that landed.

    ``opened`` and ``batch`` order the loads, of whatever run: that of a review's first copy and that of the row's own. A log
    without one of the columns of a fact fails.
    """
    number, covers = newest_base(spark, log)
    fresh = sorted((r, b) for r, b in (landed(spark, log) if batches is None else batches) if b > covers.get(r, -1))
    parts = []
    wanted = [KEY, *FIRST_VALUE, *NEWEST_VALUE]
    if number >= 0:
        parts.append(spark.read.parquet(f"{log}/base/gen={number}/rows").select(*wanted, "opened", "batch", F.lit(True).alias("in_base")))
    if fresh or not parts:
        paths = [f"{log}/deltas/run={r}/batch={b}" for r, b in fresh] or [f"{log}/deltas"]
        deltas = spark.read.option("basePath", f"{log}/deltas").parquet(*paths)
        stamp = F.struct("landed_at", F.col("run").cast("string").alias("run"), F.col("batch").cast("bigint").alias("batch"))
        parts.append(deltas.select(*wanted, stamp.alias("opened"), stamp.alias("batch"), F.lit(False).alias("in_base")))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _resolved(log: DataFrame, key: str, first: list[str], last: list[str]) -> DataFrame:
    """One row a review: its first and newest values, with the stamps of both.

    Ids and stamps decide, in a partial aggregate without bodies; only the first and the newest row of a review go on.
    """
    rows = log if "opened" in log.columns else log.withColumn("opened", F.col("batch"))
    rows = rows.withColumn("_newest", F.struct("loaded_from", "batch"))
    stamps = rows.groupBy(key).agg(F.min("opened").alias("_first_at"), F.max("_newest").alias("_last_at"))
    won = rows.join(stamps, key).where(F.col("opened").eqNullSafe(F.col("_first_at")) | F.col("_newest").eqNullSafe(F.col("_last_at")))
    return won.groupBy(key).agg(
        F.min_by(F.struct(*first), "opened").alias("_first"), F.max_by(F.struct(*last), "_newest").alias("_last"),
        F.min("opened").alias("opened"), F.max("_newest")["batch"].alias("batch"),
    ).select(key, *[f"_first.{c}" for c in first], *[f"_last.{c}" for c in last], "opened", "batch")


def current_rows(log: DataFrame, key: str = KEY) -> DataFrame:
    """One row a review with its stamps; rows of the base that no delta touches pass through as they are."""
    first, last = ([c for c in names if c in log.columns] for names in (FIRST_VALUE, NEWEST_VALUE))
    if "in_base" not in log.columns:
        return _resolved(log, key, first, last)
    base, deltas = log.where("in_base"), log.where("not in_base")
    touched = deltas.select(key).distinct()
    busy = base.join(touched, key, "left_semi").unionByName(deltas)
    quiet = base.join(touched, key, "left_anti").select(key, *first, *last, "opened", "batch")
    return quiet.unionByName(_resolved(busy, key, first, last))


def current_reviews(log: DataFrame, key: str = KEY) -> DataFrame:
    """State of each review: immutable columns of its first load, mutable ones of its newest page."""
    return current_rows(log, key).drop("opened", "batch")


def compact(spark: SparkSession, log: str, batches: set[tuple[str, int]] | None = None) -> int:
    """Makes the next base of the newest one and the deltas of ``batches``, or of all that landed; returns its number.

    The base counts from the moment that its list of covered batches is there, which is written last; what lands meanwhile
    stays a delta. One compaction runs at a time; a second one of the same number fails.
    """
    batches = landed(spark, log) if batches is None else batches
    number, covers = newest_base(spark, log)
    folder = f"{log}/base/gen={number + 1}"
    current_rows(read_log(spark, log, batches)).write.mode("errorifexists").parquet(f"{folder}/rows")
    for run, batch in batches:
        covers[run] = max(batch, covers.get(run, -1))
    spark.createDataFrame(list(covers.items()), "run string, upto bigint").coalesce(1).write.parquet(f"{folder}/covers")
    return number + 1


def sweep(spark: SparkSession, log: str) -> None:
    """Removes the deltas that the newest base holds, and older bases. Readers planned before have to be through."""
    number, covers = newest_base(spark, log)
    gone = [f"{log}/deltas/run={r}/batch={b}" for r, b in landed(spark, log) if b <= covers.get(r, -1)]
    gone += [p for p in _found(spark, f"{log}/base/gen=*") if int(p.rpartition("=")[2]) < number]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: a day's reviews are dealt over so many states, so that none holds all of a busy day
STATES = 16
#: the newest vote of each review of a state, by rising id: three arrays of numbers
_VOTES = "ids binary, fetched binary, votes binary"
_VOTE = "recommendation_id bigint, app_id int, day date, voted_up boolean, fetched_at timestamp"
_CORRECTION = f"app_id int, day date, review_count bigint, positive_count bigint, {_VOTES}"


def _newest(ids: np.ndarray, fetched: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, ...]:
    """One vote a review, the one fetched last; of several fetched at once a positive one."""
    order = np.lexsort((votes, fetched, ids))
    last = np.append(ids[order[1:]] != ids[order[:-1]], True) if order.size else np.zeros(0, bool)
    return tuple(x[order[last]] for x in (ids, fetched, votes))


def _packed(ids: np.ndarray, fetched: np.ndarray, votes: np.ndarray) -> tuple[bytes, ...]:
    return ids.astype("<i8").tobytes(), fetched.astype("<i8").tobytes(), votes.astype("u1").tobytes()


def _unpacked(ids: bytes, fetched: bytes, votes: bytes) -> tuple[np.ndarray, ...]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(fetched, "<i8"), np.frombuffer(votes, "u1").astype(bool)


def correct(known: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], int, int]:
    """Votes after newer copies came, the votes that are new or changed, and what reviews and positive ones they add."""
    place = np.searchsorted(known[0], new[0])
    at = np.minimum(place, max(known[0].size - 1, 0))
    old = (known[0][at] == new[0]) if known[0].size else np.zeros(new[0].size, bool)
    taken = ~old
    taken[old] = new[1][old] >= known[1][at[old]]
    positive = int(new[2][taken].sum()) - int(known[2][at[taken & old]].sum())
    new = tuple(x[taken] for x in new)
    kept = np.ones(known[0].size, bool)
    kept[at[taken & old]] = False
    after = tuple(np.concatenate([k[kept], n]) for k, n in zip(known, new))
    order = np.argsort(after[0], kind="stable")
    return tuple(x[order] for x in after), new, int((taken & ~old).sum()), positive


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Brings one state up to date; leaves what its day gains or loses, and the votes behind it."""
    rows = pd.concat(list(frames))
    known = _unpacked(*state.get) if state.exists else _unpacked(b"", b"", b"")
    fetched = rows["fetched_at"].to_numpy().astype("datetime64[us]").astype(np.int64)
    columns = (rows["recommendation_id"].to_numpy().astype(np.int64), fetched, rows["voted_up"].to_numpy().astype(bool))
    seed = rows["seeded"].to_numpy().astype(bool)
    # what earlier runs have counted is known, and not counted again
    known = correct(known, _newest(*(c[seed] for c in columns)))[0]
    known, changed, reviews, positive = correct(known, _newest(*(c[~seed] for c in columns)))
    state.update(_packed(*known))
    if changed[0].size:
        yield pd.DataFrame([(key[0], key[1], reviews, positive, *_packed(*changed))], columns=["app_id", "day", "review_count", "positive_count", "ids", "fetched", "votes"])


def stream_review_daily(reviews: DataFrame, log: str, target: str, checkpoint: str, states: int = STATES) -> StreamingQuery:
    """Keeps daily counts of a stream of reviews right, however late, repeated or out of order they come.

    ``reviews`` has recommendation_id, app_id, created_at, voted_up and fetched_at, and a review stays on its day. The newest
    votes are Spark's keyed state, ``states`` keys a product and day; a batch meets the states of its own reviews and
    adds the corrections to their days, so it reads nothing of the batches before it. Corrections are logged with the votes
    behind them: a run with a fresh checkpoint begins with the votes that earlier runs have logged.
    """
    spark = reviews.sparkSession
    votes = reviews.select(
        "recommendation_id", F.col("app_id").cast("int"), F.to_date("created_at").alias("day"), "voted_up", F.col("fetched_at").cast("timestamp"), F.lit(False).alias("seeded"))
    seed = f"{checkpoint.rstrip('/')}.seed"
    if not _known(spark, f"{checkpoint}/metadata"):
        _logged_votes(spark, log).write.mode("overwrite").parquet(seed)
    seeded = spark.readStream.schema(_VOTE).parquet(seed).withColumn("seeded", F.lit(True))
    rows = votes.unionByName(seeded).where("day is not null").withColumn("part", F.pmod(F.hash("recommendation_id"), F.lit(states)))
    corrections = rows.groupBy("app_id", "day", "part").applyInPandasWithState(_follow, _CORRECTION, _VOTES, "update", GroupStateTimeout.NoTimeout)
    runs: list[str] = []

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # the id of a checkpoint stays, so it is read once
        runs[:] = runs or [run_id(session, checkpoint)]
        folder = f"run={runs[0]}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{log}/{folder}")
        sums = session.read.schema(_CORRECTION).parquet(f"{log}/{folder}").select("app_id", "day", "review_count", "positive_count")
        sums.write.mode("overwrite").parquet(f"{target}/{folder}")

    return (
        corrections.writeStream.foreachBatch(land)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _known(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, wherever Spark reads it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _logged_votes(spark: SparkSession, log: str) -> DataFrame:
    """Newest vote of each review in the logs of all runs."""
    if not _known(spark, log):
        return spark.createDataFrame([], _VOTE)

    def votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for app, day, *block in zip(*(frame[c] for c in ("app_id", "day", "ids", "fetched", "votes"))):
                ids, fetched, up = _unpacked(*block)
                yield pd.DataFrame({"recommendation_id": ids, "app_id": app, "day": day, "voted_up": up, "fetched_at": fetched.astype("datetime64[us]")})

    logged = spark.read.parquet(log).select("app_id", "day", "ids", "fetched", "votes").mapInPandas(votes, _VOTE)
    newest = F.max_by("voted_up", F.struct("fetched_at", "voted_up"))
    return logged.groupBy("recommendation_id", "app_id", "day").agg(newest.alias("voted_up"), F.max("fetched_at").alias("fetched_at"))


def read_daily(spark: SparkSession, target: str) -> DataFrame:
    """Counts of each day that has reviews: the sums of all corrections."""
    return spark.read.parquet(target).groupBy("app_id", "day").agg(
        F.sum("review_count").alias("review_count"), F.sum("positive_count").alias("positive_count")).where("review_count > 0")
