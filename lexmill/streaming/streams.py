"""Four stateful jobs as Structured Streaming queries.

All sinks are tables of ``run=<state>/batch=<n>`` folders: a repeated micro-batch
rewrites its own folder and no other, so a restart neither loses nor repeats
rows, and a second run with new state never touches the rows of the first.
State and tables live in the shared scratch folder.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import chunking
from ..schemas import CHUNKS, DOCUMENTS, EVENTS
from ..session import parallelism, scratch_path
from ..sources.store import newest_text, write_text
from ..sources.tables import materialize


def file_stream(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of one table as a stream; the schema is fixed, never inferred.

    The table is files ``name*.parquet`` in the folder, or folders of that name with files in them.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}*.parquet")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, state: str) -> list:
    """Process what is there and stop; returns the progress reports."""
    query = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", state).foreachBatch(sink).start()
    )
    query.awaitTermination()
    return list(query.recentProgress)


def run_id(state: str) -> str:
    """Name of the run that owns a state folder."""
    return "r" + hashlib.sha256(state.encode()).hexdigest()[:12]


def batch_folder(table: str, run: str, batch: int) -> str:
    return f"{table}/run={run}/batch={batch}"


def read_batches(spark: SparkSession, table: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, run STRING, batch BIGINT").option("basePath", table).parquet(table)


def new_table(spark: SparkSession, table: str, schema: str | StructType) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(batch_folder(table, "new", -1))


# ---------------------------------------------------------------- chunks

CHUNK_COLUMNS = ["chunk_uuid", "doc_id", "chunk_index", "source_title", "content", "content_hash"]
CHUNK_ROWS = ", ".join(p.strip() for p in CHUNKS.split(",") if p.split()[0] in CHUNK_COLUMNS)


def ingest_chunks(spark: SparkSession, folder: str, table: str, state: str) -> list:
    """Clean, cut and filter; insert the chunks of each owner that are not stored yet."""
    run = run_id(state)

    def insert(batch: DataFrame, n: int) -> None:
        batch = batch.repartition(parallelism(spark), "doc_id")
        fresh = chunking.build_chunks(batch).select(*CHUNK_COLUMNS)
        # the batch's own folder may hold rows of an attempt that is being repeated
        stored = read_batches(spark, table, CHUNK_ROWS).where(
            ~((F.col("run") == run) & (F.col("batch") == n))).select("chunk_uuid", "doc_id")
        fresh.join(stored, ["chunk_uuid", "doc_id"], "left_anti").write.mode("overwrite").parquet(batch_folder(table, run, n))

    return run_available(file_stream(spark, folder, "documents", DOCUMENTS), insert, "append", state)


def stored_chunks(spark: SparkSession, table: str) -> DataFrame:
    """The chunk table: of equal chunks the one with the smallest owner, whatever arrived first.

    The winners are found on narrow rows and joined back by chunk and owner.
    """
    rows = read_batches(spark, table, CHUNK_ROWS).select(*CHUNK_COLUMNS)
    owner = rows.groupBy("chunk_uuid").agg(F.min(F.struct("doc_id", "chunk_index")).alias("o"))
    return rows.join(owner.select("chunk_uuid", "o.doc_id", "o.chunk_index"), ["chunk_uuid", "doc_id", "chunk_index"]).select(*CHUNK_COLUMNS)


def stream_ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Ingest every file that is there into a new chunk table."""
    table = scratch_path(spark, "stream-chunks")
    new_table(spark, table, CHUNK_ROWS)
    ingest_chunks(spark, folder, table, scratch_path(spark, "state"))
    return stored_chunks(spark, table)


# ---------------------------------------------------------------- windowed aggregates

class AdditiveTable:
    """Counters that lose nothing: every micro-batch is aggregated by itself, and read back summed.

    A batch writes its delta under its own number, so a repeated batch changes nothing, and a late
    row adds to its own key however late it is: there is no watermark and no state to expire.
    ``sums`` are added up; ``extremes`` are (min or max, column).  With ``event_time``, every batch also counts its rows
    by how many days they lie behind the newest day of the batches before it.
    """

    def __init__(self, spark: SparkSession, schema: StructType, keys: dict[str, Column], sums: dict[str, Column],
                 extremes: dict[str, tuple[str, str]] | None = None, event_time: str | None = None):
        self.spark, self.keys, self.sums, self.extremes, self.event_time = spark, keys, sums, extremes or {}, event_time
        self.table, self.state = scratch_path(spark, "stream-agg"), scratch_path(spark, "state")
        self.run = run_id(self.state)
        rows = self.delta(spark.createDataFrame([], schema)).schema
        self.rows = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.fields)
        new_table(spark, self.table, rows)
        if event_time:
            new_table(spark, f"{self.table}-late", self.LATE)

    LATE = "days_late INT, n BIGINT, newest DATE"

    def merged(self, rows: DataFrame, keys: list) -> DataFrame:
        merge = {"min": F.min, "max": F.max}
        return rows.groupBy(*keys).agg(
            *[F.sum(k).alias(k) for k in self.sums], *[merge[how](k).alias(k) for k, (how, _) in self.extremes.items()])

    def delta(self, rows: DataFrame) -> DataFrame:
        named = rows.select(*[c.alias(k) for k, c in self.keys.items()], *[c.alias(k) for k, c in self.sums.items()],
                            *[F.col(c).alias(k) for k, (_, c) in self.extremes.items()])
        return self.merged(named, list(self.keys))

    def save(self, batch: DataFrame, n: int) -> None:
        self.delta(batch).write.mode("overwrite").parquet(batch_folder(self.table, self.run, n))
        if self.event_time:
            before = self.batches(f"{self.table}-late", self.LATE).where(F.col("batch") < n).agg(F.max("newest")).first()[0]
            day = F.to_date(self.event_time)
            behind = F.greatest(F.datediff(F.lit(before).cast("date"), day), F.lit(0)) if before else F.lit(0)
            batch.groupBy(behind.cast("int").alias("days_late")).agg(F.count("*").alias("n"), F.max(day).alias("newest")).write.mode(
                "overwrite").parquet(batch_folder(f"{self.table}-late", self.run, n))

    def batches(self, table: str, schema: str) -> DataFrame:
        return read_batches(self.spark, table, schema).where(F.col("run") == self.run)

    def consume(self, stream: DataFrame) -> list:
        return run_available(stream, self.save, "append", self.state)

    def base(self) -> dict:
        """The newest published base: its folder and the last batch in it."""
        body = newest_text(self.spark, f"{self.table}-base")
        return json.loads(body) if body else {"data": None, "upto": -1}

    def totals(self) -> DataFrame:
        return self.totals_upto(1 << 62)

    def late_rows(self) -> DataFrame:
        """(batch, days_late, n) of rows behind the newest day before their batch."""
        return self.batches(f"{self.table}-late", self.LATE).where("days_late > 0").groupBy("batch", "days_late").agg(F.sum("n").alias("n"))

    def compact(self) -> int:
        """Merges the deltas so far into a new base and publishes it; returns the last batch in it.

        A batch in the base that is repeated writes its delta again, which is then not read.
        """
        last = self.batches(self.table, self.rows).agg(F.max("batch")).first()[0]
        if last is None or last <= self.base()["upto"]:
            return self.base()["upto"]
        folder = f"{self.table}-base"
        data = f"{folder}/data-{uuid.uuid4().hex}"
        self.totals_upto(last).write.parquet(data)
        write_text(self.spark, f"{folder}/base-{last:012d}.json", json.dumps({"data": data, "upto": last}))
        return self.base()["upto"]

    def totals_upto(self, last: int) -> DataFrame:
        base = self.base()
        rows = self.batches(self.table, self.rows).where(F.col("batch").between(base["upto"] + 1, last)).drop("run", "batch")
        if base["data"]:
            rows = rows.unionByName(self.spark.read.schema(self.rows).parquet(base["data"]))
        return self.merged(rows, list(self.keys))


def additive_aggregate(
    spark: SparkSession, stream: DataFrame, keys: dict[str, Column], sums: dict[str, Column],
    extremes: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Totals of a whole stream, see AdditiveTable."""
    held = AdditiveTable(spark, stream.schema, keys, sums, extremes)
    held.consume(stream)
    return held.totals()


def usage_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    events = file_stream(spark, folder, "events", EVENTS, files_per_batch)
    k = F.from_json("props", "k BIGINT")["k"]
    surface = F.element_at(F.array(F.lit("chat"), F.lit("eval"), F.lit("ingest")), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    provider = F.when(F.col("event_type").isin("click", "view", "error"), "groq").otherwise("gemini")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), provider.alias("provider"), surface.alias("surface"), "event_type", "value",
        (k * 10).alias("prompt_tokens"), k.alias("completion_tokens"), (F.col("event_type") == "error").cast("bigint").alias("fallback"))


def usage_table(spark: SparkSession, schema: StructType) -> AdditiveTable:
    """Counters per UTC day, provider and surface, with late rows counted beside them."""
    keys = {"day": F.to_date("ts"), "provider": F.col("provider"), "surface": F.col("surface")}
    sums = {"requests": F.lit(1), "prompt_tokens": F.col("prompt_tokens"), "completion_tokens": F.col("completion_tokens"),
            "fallbacks": F.col("fallback")}
    return AdditiveTable(spark, schema, keys, sums, event_time="ts")


def stream_usage_daily(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Additive counters per UTC day; a late delta still adds to its own day."""
    stream = usage_stream(spark, folder, files_per_batch)
    held = usage_table(spark, stream.schema)
    held.consume(stream)
    return held.totals()


def stream_latency_windows(
    spark: SparkSession, folder: str, width: str = "12 hours", slide: str = "6 hours", files_per_batch: int | None = None,
) -> DataFrame:
    """Tumbling and sliding windows over span times, per span name; means are kept as sum and count."""
    parts = []
    for kind, step in (("tumbling", width), ("sliding", slide)):
        spans = usage_stream(spark, folder, files_per_batch).select(F.window("ts", width, step).alias("w"), "event_type", "value")
        keys = {"window_start": F.date_format("w.start", "yyyy-MM-dd HH:mm"), "name": F.col("event_type")}
        rows = additive_aggregate(
            spark, spans, keys, {"n": F.lit(1), "total": F.col("value"), "valued": F.col("value").isNotNull().cast("int")},
            {"min": ("min", "value"), "max": ("max", "value")})
        parts.append(rows.select(
            F.lit(kind).alias("kind"), "window_start", "name", "n",
            F.round(F.col("total") / F.nullif("valued", F.lit(0)), 6).alias("avg"), "min", "max"))
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- dimension refresh

class RefreshedDimension:
    """A dimension that is read again after ``ttl`` seconds; an empty or failed read keeps the old one.

    ``ttl`` of zero or less never reads again.  Every good read is written to a folder of its own,
    so that the rows outlive the source; the first read must succeed.
    """

    def __init__(self, load: Callable[[], DataFrame], ttl: float, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl, self.clock = load, ttl, clock
        self.rows: DataFrame | None = None
        self.loaded_at = 0.0
        self.reads = 0

    def current(self) -> DataFrame:
        due = self.rows is None or (self.ttl > 0 and self.clock() - self.loaded_at >= self.ttl)
        if due:
            self.loaded_at = self.clock()
            try:
                fresh = materialize(self.load(), "dimension")
            except (PySparkException, Py4JJavaError):
                if self.rows is None:
                    raise
                fresh = None
            self.reads += 1
            if self.rows is None or (fresh is not None and not fresh.isEmpty()):
                self.rows = fresh
        return self.rows


def enrich_stream(spark: SparkSession, stream: DataFrame, dim: RefreshedDimension, key: str, columns: list[str], schema: str) -> DataFrame:
    """Left join every micro-batch to the dimension as it is at that time."""
    table, state = scratch_path(spark, "stream-enriched"), scratch_path(spark, "state")

    def save(batch: DataFrame, n: int) -> None:
        batch.join(dim.current(), key, "left").select(*columns).write.mode("overwrite").parquet(
            batch_folder(table, run_id(state), n))

    run_available(stream, save, "append", state)
    return read_batches(spark, table, schema).select(*columns)


def stream_dim_refresh(spark: SparkSession, folder: str, ttl: float = 900.0) -> DataFrame:
    events = file_stream(spark, folder, "events", EVENTS)
    keyed = events.select("event_id", "event_type", F.from_json("props", "k BIGINT")["k"].alias("p_partkey"))

    def load() -> DataFrame:
        return spark.read.parquet(f"{folder}/part.parquet").where("p_size > 10").select("p_partkey", "p_name")

    return enrich_stream(spark, keyed, RefreshedDimension(load, ttl), "p_partkey",
                         ["event_id", "event_type", "p_partkey", "p_name"], "event_id BIGINT, event_type STRING, p_partkey BIGINT, p_name STRING")
