"""The detection job: JSON spans in; window aggregates, metrics, anomalies, late spans and dead
letters out, by one streaming query.

Every micro-batch goes through the batch operators in the order dedup, watermark, late drop, then
windows and detector, so its rows are exactly those of one batch over everything so far; only a late
span whose id was forgotten may be told as late where one batch would call it a duplicate.  What a
batch leaves for the next is a few tables, written under the job's folder by batch:

    ids      first-seen time of each span id that could still refuse a duplicate
    top      the latest time seen over all services, from which lateness is counted
    open     the spans of windows that nothing has closed, and where these windows begin
    history  the spans that a service's next z-score could look back to
    last     when each service was last evaluated

A batch reads the tables of the one before, replaces its own partition of every output, and then
writes its own.  So a batch that was cut off and is run again by the checkpoint starts from the
same state and leaves its rows once.  State of two batches back is removed.

Spans must come in order: `arrival_seq`, from 0, rises from batch to batch.  Ghost rows of number
-1 carry an anchor into the chains; they are no spans and are counted nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, EngineConfig
from ..operators import tumbling, zscore
from ..operators.chain import greedy_chain
from ..operators.numbering import running_max
from ..operators.watermark import with_watermark
from ..sinks.tables import batch_folder
from ..sources.normalize import parse_json

ORDER = "arrival_seq"
OUTPUTS = ("aggregates", "metrics", "anomalies", "late", "dead_letters")


@dataclass(frozen=True)
class State:
    """Tables that a batch leaves; empty ones before the first."""

    ids: DataFrame
    top: int | None
    open: DataFrame
    history: DataFrame
    last: DataFrame


def _spans(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def step(events: DataFrame, state: State, config: EngineConfig = DEFAULTS) -> tuple[dict[str, DataFrame], dict[str, DataFrame], list[DataFrame]]:
    """(outputs, next state, persisted tables) of canonical events (with arrival_seq) after `state`.

    A late first copy still marks its id as seen, and duplicates never advance the watermark."""
    ghost = lambda df, flag: df.withColumn("_ghost", F.lit(flag))
    # Persisted tables are a batch's own and its state; what is lost of them is computed again.
    known = ghost(state.ids.withColumn(ORDER, F.lit(-1).cast("long")), True)
    chained = greedy_chain(ghost(events, False).unionByName(known, allowMissingColumns=True), "span_id", ORDER, "timestamp_ms", config.dedup_ttl_ms, strict=True).where("fired").persist()
    admitted = with_watermark(chained.where("not _ghost").select(*events.columns), ORDER, "timestamp_ms", config.lag_ms, top_ms=state.top)
    admitted = admitted.persist()
    on_time = admitted.where("timestamp_ms >= watermark_ms").drop("watermark_ms")
    newest = admitted.agg(F.max("timestamp_ms")).first()[0]
    top = max((x for x in (newest, state.top) if x is not None), default=None)

    # Windows: rows of open ones come again, after the ghost of the row that closed the last.
    rows = greedy_chain(ghost(on_time, False).unionByName(state.open), "service_id", ORDER, "timestamp_ms", config.tumbling_ms, out="closes").persist()
    closing = F.when(tumbling.is_closing(), F.struct("closes_no", "timestamp_ms"))
    edge = rows.groupBy("service_id").agg(F.max(closing).alias("edge")).where("edge is not null").select(F.col("service_id").alias("_service"), "edge.*")
    edge = edge.withColumnsRenamed({"closes_no": "_no", "timestamp_ms": "_at"})
    aggregates = tumbling.closed(rows.where("not _ghost")).persist()
    still = rows.join(edge, rows["service_id"] == edge["_service"], "left").where("_no is null or closes_no > _no").select(*on_time.columns, "_ghost")
    anchors = edge.select(F.col("_service").alias("service_id"), F.col("_at").alias("timestamp_ms"), F.lit(-1).cast("long").alias(ORDER), F.lit(True).alias("_ghost"))
    held = still.unionByName(anchors, allowMissingColumns=True)

    # Detector: z-scores look back into the history; only new rows are evaluated.
    line = ghost(on_time, False).unionByName(ghost(state.history, True))
    scored = zscore.history_z(line, config.sliding_ms, config.min_history).where("not _ghost").persist()
    marks = state.last.withColumns({ORDER: F.lit(-1).cast("long"), "_ghost": F.lit(True)})
    fired = greedy_chain(scored.unionByName(marks, allowMissingColumns=True), "service_id", ORDER, "timestamp_ms", config.slide_ms).where("fired").persist()
    found = zscore.anomalies(fired.where("not _ghost"), config.z_threshold)
    latest = line.groupBy(F.col("service_id").alias("_service")).agg(F.max("timestamp_ms").alias("_latest"))
    kept = running_max(line, "service_id", ORDER, "timestamp_ms", "_top").join(latest, F.col("service_id") == F.col("_service"))

    outputs = {
        "aggregates": aggregates,
        "metrics": tumbling.unpivoted(aggregates),
        "anomalies": zscore.identified(found),
        "late": admitted.where("timestamp_ms < watermark_ms"),
    }
    ids = chained.groupBy("span_id").agg(F.max("timestamp_ms").alias("timestamp_ms"))
    if top is not None:  # what is older can refuse only spans that are late themselves
        ids = ids.where(F.col("timestamp_ms") >= top - config.lag_ms - 2 * config.dedup_ttl_ms)
    nexts = {
        "ids": ids,
        "top": events.sparkSession.createDataFrame([(top,)], "top long"),
        "open": held,
        "history": kept.where(F.col("_top") >= F.col("_latest") - config.sliding_ms).select(*on_time.columns),
        "last": fired.groupBy("service_id").agg(F.max("timestamp_ms").alias("timestamp_ms")),
    }
    return outputs, nexts, [chained, admitted, rows, aggregates, scored, fired]


class DetectionJob:
    """The job over a folder that all executors share; `name` tells queries apart that write to it."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = DEFAULTS, name: str = "detection"):
        self.spark, self.folder, self.config, self.name = spark, folder.rstrip("/"), config, name

    def _state_path(self, batch_id: int) -> str:
        return batch_folder(f"{self.folder}/state", batch_id, self.name)

    def _state(self, batch_id: int, schema) -> State:
        if batch_id < 0:
            event, ghosts = _spans(self.spark, schema), _spans(self.spark, "service_id string, timestamp_ms long")
            return State(_spans(self.spark, "span_id string, timestamp_ms long"), None, event.withColumn("_ghost", F.lit(False)), event, ghosts)
        read = lambda name: self.spark.read.parquet(f"{self._state_path(batch_id)}/{name}")
        return State(read("ids"), read("top").first()[0], read("open"), read("history"), read("last"))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of (value: JSON span, arrival_seq), as foreachBatch gives it."""
        batch = batch.persist()
        events, dead = parse_json(batch, "value", keep=(ORDER,))
        outputs, state, used = step(events, self._state(batch_id - 1, events.schema), self.config)
        for table, rows in (outputs | {"dead_letters": dead}).items():
            rows.write.mode("overwrite").parquet(batch_folder(f"{self.folder}/{table}", batch_id, self.name))
        for table, rows in state.items():
            rows.write.mode("overwrite").parquet(f"{self._state_path(batch_id)}/{table}")
        self._remove(self._state_path(batch_id - 2))
        for df in (batch, *used):
            df.unpersist()

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def start(self, spans: DataFrame, checkpoint: str | None = None, **trigger) -> StreamingQuery:
        """Run on a stream of (value, arrival_seq); trigger as DataStreamWriter.trigger takes it."""
        writer = spans.select(F.col("value").cast("string").alias("value"), F.col(ORDER).cast("long").alias(ORDER)).writeStream
        writer = writer.foreachBatch(self.process).option("checkpointLocation", checkpoint or f"{self.folder}/checkpoint/{self.name}")
        return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()

    def read(self, table: str) -> DataFrame:
        """An output's rows so far."""
        return self.spark.read.parquet(f"{self.folder}/{table}/query={self.name}").drop("batch_id")
