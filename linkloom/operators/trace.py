"""The audit trail: append-only tables of a linking run, and their replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table schemas. Status changes are rows of their own; a run's present status is its latest row.
TABLES = {
    "pipeline_run": "run_id string, task_name string, status string, ts timestamp, actor string, metadata string",
    "pipeline_step": "id long, run_id string, stage_name string, status string, message string, payload string, ts timestamp",
    "mention": "id long, run_id string, doc_id string, mention_text string, start_idx int, end_idx int, mention_norm string, context string, ts timestamp",
    "candidate": "id long, mention_id long, run_id string, candidate_entity_id string, candidate_name string, score double, metadata string",
    "link_result": "id long, mention_id long, run_id string, linked_entity_id string, linked_entity_name string, is_nil boolean, score double, decision_reason string, evidence string, model_version string, actor string, ts timestamp",
    "audit_log": "id long, mention_id long, run_id string, link_result_id long, field string, old_value string, new_value string, reason string, actor string, ts timestamp",
    "model_registry": "model_name string, model_version string, provider string, description string, ts timestamp, metadata string",
}
STAGES = ("pipeline_start", "ner", "mention_filter", "candidate_generation", "disambiguation", "nil_decision", "coreference", "pipeline_finish")


class TraceStore:
    """Parquet tables under one folder; run_id partitions what belongs to a run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        """One job, committed as a whole."""
        names = [f.split(" ")[0] for f in TABLES[table].split(", ")]
        out = rows.select(*names)
        (out.write.partitionBy("run_id") if "run_id" in names else out.write).mode("append").parquet(f"{self.folder}/{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{table}")

    def trace(self, run_id: str) -> dict[str, DataFrame]:
        """A run's tables in order; audit rows need no mention."""
        own = {t: self.read(t).where(F.col("run_id") == run_id) for t in TABLES if t != "model_registry"}
        own["pipeline_run"] = latest_runs(own["pipeline_run"])
        return own | {t: own[t].orderBy("id") for t in own if t != "pipeline_run"}

    def runs(self, limit: int = 20, status: str | None = None) -> DataFrame:
        rows = latest_runs(self.read("pipeline_run"))
        return list_runs(rows if status is None else rows.where(F.col("status") == status), limit)


def with_mentions(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidates or link results (mention_id, ...) with their mention's text and place; rows of unknown mentions go."""
    m = mentions.select(F.col("id").alias("_m"), "mention_text", "start_idx", "end_idx", "doc_id")
    return rows.join(m, F.col("mention_id") == F.col("_m")).drop("_m")


def audit_of_run(audit: DataFrame, mentions: DataFrame, run_id: str) -> DataFrame:
    """Audit rows of a run, or of its mentions, with the mention's text where there is one."""
    own = mentions.where(F.col("run_id") == run_id).select(F.col("id").alias("_o")).distinct().withColumn("_own", F.lit(True))
    text = mentions.groupBy(F.col("id").alias("_m")).agg(F.min("mention_text").alias("mention_text"))
    rows = audit.join(own, F.col("mention_id") == F.col("_o"), "left").where((F.col("run_id") == run_id) | F.col("_own"))
    return rows.join(text, F.col("mention_id") == F.col("_m"), "left").drop("_o", "_own", "_m")


def latest_runs(events: DataFrame) -> DataFrame:
    """run_id, status, start_ts, end_ts: the latest status by time."""
    return events.groupBy("run_id").agg(F.max_by("status", "ts").alias("status"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def list_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs."""
    return runs.orderBy(F.desc("start_ts"), F.desc("run_id")).limit(limit)


def audit_rows(results: DataFrame) -> DataFrame:
    """Two audit rows for each decision: what the mention became, and whether it is NIL."""
    pair = F.array(
        F.struct(F.lit("link_result").alias("field"), F.col("mention").alias("old_value"), F.coalesce("entity_id", F.lit("NIL")).alias("new_value")),
        F.struct(F.lit("is_nil").alias("field"), F.lit("").alias("old_value"), F.col("is_nil").cast("string").alias("new_value")),
    )
    return results.select("*", F.explode(pair).alias("_a")).select(*results.columns, "_a.field", "_a.old_value", "_a.new_value")


def stage_log(run_id: str, counts: dict[str, DataFrame]) -> DataFrame:
    """run_id, stage_name, status, payload: one row a stage, its payload the JSON of a one-row count table."""
    out = None
    for stage, table in counts.items():
        row = table.limit(1).select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage_name"), F.lit("success").alias("status"), F.to_json(F.struct(*table.columns)).alias("payload"))
        out = row if out is None else out.unionByName(row)
    return out


def newest_answers(cache: DataFrame, keep: int = 500, ttl_seconds: int | None = None, now=None) -> DataFrame:
    """cache(key, result, ts): the newest row of each key, unexpired, the newest ``keep`` of them (a top-k, no global sort)."""
    rows = cache.groupBy("key").agg(F.max_by("result", "ts").alias("result"), F.max("ts").alias("ts"))
    if ttl_seconds is not None:
        rows = rows.where(F.col("ts") >= (now if now is not None else F.current_timestamp()) - F.make_interval(secs=F.lit(ttl_seconds)))
    return rows.orderBy(F.desc("ts"), F.desc("key")).limit(keep)
