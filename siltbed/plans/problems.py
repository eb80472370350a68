"""The queries of the general problems p1 and p3-p5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.operators.change_store import apply_changes
from siltbed.operators.consolidate import Consolidation
from siltbed.operators.heavy_keys import aggregate_by_key, versions_not_rising
from siltbed.operators.incremental import pending_changes
from siltbed.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "kv_log", "log_id", "key", "commit_ts", "mod_revision", "is_deleted")
    return apply_changes(log, "log_id").select("key", "mod_revision")


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "kv_log", "log_id", "key", "version", "commit_ts", "mod_revision", "is_deleted", "value")
    state = apply_changes(log, "log_id")
    return state.select("key", F.coalesce("version", F.lit(-1)).alias("version"), "commit_ts", "mod_revision", "value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pending_changes(table(spark, d, "kv_log", "key", "mod_revision", "memtable_id"), table(spark, d, "load_runs"))


def _consolidation(spark: SparkSession, d: str) -> Consolidation:
    log = table(spark, d, "kv_log", "log_id", "key", "version", "commit_ts", "value", "mod_revision", "is_deleted", "memtable_id")
    return Consolidation(table(spark, d, "manifest"), table(spark, d, "sst_files"), log)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated files and the rest of the plan, which has no records to merge."""
    return _consolidation(spark, d).files().select("sst_id")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each planned file lie in the outputs."""
    return _consolidation(spark, d).files().select("sst_id", "records", "merged")


def p4_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _consolidation(spark, d).outputs.drop("file", "sources")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Records and bytes of all outputs together; equal to those of the inputs."""
    return _consolidation(spark, d).outputs.agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


def p4_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of 256 KiB: how many are larger by more than a record may be, and how many meet the one before."""
    log = table(spark, d, "kv_log", "log_id", "key", "version", "commit_ts", "value", "mod_revision", "is_deleted", "memtable_id")
    o = Consolidation(table(spark, d, "manifest"), table(spark, d, "sst_files"), log, target=256 << 10).outputs
    before = F.lag("last_key").over(Window.orderBy("output"))  # one row an output
    return o.withColumn("before", before).agg(
        F.sum("records").alias("records"),
        F.count_if(F.col("bytes") > (320 << 10)).alias("too_large"),
        F.count_if(F.col("first_key") < F.col("before")).alias("overlaps"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return versions_not_rising(table(spark, d, "kv_log", "key", "version", "commit_ts", "mod_revision"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "kv_log", "key", "is_deleted", "commit_ts", "value")
    return aggregate_by_key(
        log,
        "key",
        [
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.coalesce("is_deleted", F.lit(False))).alias("deletes"),
            F.max("commit_ts").alias("last_ts"),
            F.sum(F.coalesce(F.length("value"), F.lit(0)).cast("bigint")).alias("chars"),
        ],
        [F.sum("n").alias("n"), F.sum("deletes").alias("deletes"), F.max("last_ts").alias("last_ts"), F.sum("chars").alias("chars")],
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p3_found, p4_found, p4_files, p4_outputs, p4_ranges, p4_totals, p5_found, p5_totals)}

_SMALL = """
WITH made AS (
  SELECT record_no, flush_id AS id, type FROM manifest WHERE type = 'flush'
  UNION ALL SELECT record_no, unnest(produced_ssts), type FROM manifest WHERE type IN ('flush', 'compaction')
  UNION ALL SELECT record_no, unnest(compaction_task.output_ids), type FROM manifest WHERE type = 'compaction'),
produced AS (SELECT DISTINCT record_no, id, type FROM made WHERE id IS NOT NULL),
took AS (
  SELECT record_no, unnest(compaction_task.upper_ids) AS id FROM manifest WHERE type = 'compaction'
  UNION ALL SELECT record_no, unnest(compaction_task.lower_ids) FROM manifest WHERE type = 'compaction'),
consumed AS (
  SELECT DISTINCT t.id FROM took t WHERE t.record_no IN (SELECT record_no FROM produced)
  AND NOT EXISTS (SELECT 1 FROM produced p WHERE p.record_no = t.record_no AND p.id = t.id)),
small AS (
  SELECT sst_id FROM sst_files WHERE sst_id IN (SELECT id FROM produced)
  AND NOT EXISTS (SELECT 1 FROM consumed c WHERE c.id = sst_id)
  GROUP BY sst_id HAVING max(size_bytes) < 32768)
"""
_NEWEST = """
SELECT {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, mod_revision DESC) AS rn
  FROM kv_log WHERE key IS NOT NULL AND key <> '') t
WHERE rn = 1 AND NOT coalesce(is_deleted, false)
"""
ORACLE = {
    "p1_found": _NEWEST.format(cols="key, mod_revision"),
    "p1_state": _NEWEST.format(cols="key, coalesce(version, -1) AS version, commit_ts, mod_revision, value"),
    "p3_found": """
WITH runs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY reported_at DESC, report_id DESC) AS rn FROM load_runs) t
  WHERE rn = 1 AND status = 'succeeded'),
mem AS (SELECT DISTINCT memtable_id FROM kv_log),
cover AS (SELECT memtable_id, max(to_revision) AS upto FROM mem JOIN runs ON memtable_id BETWEEN first_memtable_id AND last_memtable_id GROUP BY 1)
SELECT key, mod_revision FROM kv_log LEFT JOIN cover USING (memtable_id)
WHERE key IS NOT NULL AND key <> ''
GROUP BY 1, 2 HAVING max(CASE WHEN mod_revision <= upto THEN 1 ELSE 0 END) = 0""",
    "p4_found": _SMALL + "SELECT sst_id FROM small",
    "p4_totals": _SMALL
    + """SELECT count(*) AS records,
  CAST(sum(coalesce(octet_length(encode(key)), 0) + coalesce(octet_length(encode(value)), 0) + 22) AS BIGINT) AS bytes
FROM kv_log WHERE memtable_id IN (SELECT sst_id FROM small) AND key IS NOT NULL AND key <> ''""",
    "p4_files": _SMALL
    + """SELECT sst_id, count(key) AS records, count(key) > 0 AS merged
FROM small LEFT JOIN (SELECT memtable_id, key FROM kv_log WHERE key <> '') k ON memtable_id = sst_id GROUP BY sst_id""",
    "p4_ranges": _SMALL
    + """SELECT count(*) AS records, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS overlaps
FROM kv_log WHERE memtable_id IN (SELECT sst_id FROM small) AND key IS NOT NULL AND key <> ''""",
    "p5_found": """
WITH c AS (SELECT DISTINCT key, mod_revision, commit_ts, version FROM kv_log WHERE version IS NOT NULL AND key IS NOT NULL AND key <> '')
SELECT key, mod_revision FROM (
  SELECT *, lag(version) OVER (PARTITION BY key ORDER BY commit_ts, mod_revision) AS prev FROM c) t WHERE version <= prev""",
    "p5_totals": """
SELECT key, count(*) AS n, count(*) FILTER (coalesce(is_deleted, false)) AS deletes, max(commit_ts) AS last_ts,
  CAST(sum(coalesce(length(value), 0)) AS BIGINT) AS chars
FROM kv_log WHERE key IS NOT NULL AND key <> '' GROUP BY key""",
}
