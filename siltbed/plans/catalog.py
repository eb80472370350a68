"""The queries of the engine's own operators over the test tables, and their SQL.

The log of most queries is made of the events: a key for each user, the event number as commit timestamp, errors as
deletes, ten events a transaction, a thousand a run; older runs lie in deeper levels. Where runs must have separate
key ranges, the orders serve.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions import bloom, codec, metrics
from siltbed.operators import compaction, merge, pruning, reads, txn
from siltbed.session import local_rows, shared_path, written
from siltbed.sources import manifest as mf
from siltbed.sources.tables import table

#: After so many rows a query that writes a log waits for it: the queue holds no more, however many rows there are.
SYNC_ROWS = 9_000

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def event_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    run = F.floor(F.col("event_id") / 1000).cast("bigint")
    return e.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"),
        F.lit(0).cast("bigint").alias("version"),
        F.col("event_id").alias("commit_ts"),
        F.col("event_type").alias("value"),
        (F.col("event_type") == "error").alias("is_deleted"),
        F.floor(F.col("event_id") / 10).cast("bigint").alias("txn_id"),
        run.alias("run_id"),
        F.when(run >= 6, 0).when(run >= 3, 1).otherwise(2).cast("int").alias("level"),
    )


_LOG = """WITH kv AS (
  SELECT concat('u', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS key, CAST(0 AS BIGINT) AS version, event_id AS commit_ts,
    event_type AS value, event_type = 'error' AS is_deleted, event_id // 10 AS txn_id, event_id // 1000 AS run_id,
    CAST(CASE WHEN event_id // 1000 >= 6 THEN 0 WHEN event_id // 1000 >= 3 THEN 1 ELSE 2 END AS INTEGER) AS level
  FROM events)"""


def _newest(where: str = "true", cols: str = "key, value", tail: str = "NOT is_deleted", order: str = "commit_ts DESC") -> str:
    return f"""{_LOG}
SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM kv WHERE {where}) t
WHERE rn = 1 AND {tail}"""


# -- reads


@query(_newest("commit_ts <= 6000"))
def kv_snapshot_scan(spark, d):
    return reads.snapshot(event_log(spark, d), 6000).select("key", "value")


@query(_newest())
def kv_latest(spark, d):
    return reads.snapshot(event_log(spark, d)).select("key", "value")


@query(_newest("key = 'u00000042'"))
def kv_get(spark, d):
    return reads.get(event_log(spark, d), "u00000042").select("key", "value")


@query(_newest("key = 'nobody'"))
def kv_get_missing(spark, d):
    return reads.get(event_log(spark, d), "nobody").select("key", "value")


@query(_newest(tail="is_deleted", cols="key"))
def kv_get_deleted(spark, d):
    """The keys whose get says deleted."""
    return reads.tombstones(event_log(spark, d)).select("key")


@query(_newest("key IN ('u00000003', 'u00000007', 'u00000011', 'zzz')"))
def kv_multi_get(spark, d):
    return reads.multi_get(event_log(spark, d), ["u00000003", "u00000007", "u00000011", "zzz"]).select("key", "value")


@query(_newest("key IN (SELECT concat('u', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) FROM customer WHERE c_acctbal > 0)"))
def kv_multi_get_table(spark, d):
    keys = table(spark, d, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0").select(
        F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("key")
    )
    return reads.multi_get(event_log(spark, d), keys).select("key", "value")


@query(_newest("key = 'u00000042' AND commit_ts <= 5000"))
def kv_snapshot_get(spark, d):
    return reads.get(event_log(spark, d), "u00000042", 5000).select("key", "value")


@query(_newest("key >= 'u00000010' AND key < 'u00000050'"))
def kv_scan_range(spark, d):
    return reads.scan(event_log(spark, d), "u00000010", "u00000050").select("key", "value")


@query(_newest("key >= 'u00000010'") + " ORDER BY key LIMIT 10")
def kv_scan_limit(spark, d):
    return reads.scan(event_log(spark, d), "u00000010", None, 10).select("key", "value")


@query(_newest("key < 'u00000050'"))
def kv_scan_open_start(spark, d):
    return reads.scan(event_log(spark, d), None, "u00000050").select("key", "value")


@query(_newest("key >= 'u00000100'"))
def kv_scan_open_end(spark, d):
    return reads.scan(event_log(spark, d), "u00000100").select("key", "value")


@query(_newest("key LIKE 'u0000010%'"))
def kv_scan_prefix(spark, d):
    return reads.scan_prefix(event_log(spark, d), "u0000010").select("key", "value")


@query(_newest("key >= 'u00000033x'") + " ORDER BY key LIMIT 1")
def kv_seek(spark, d):
    return reads.seek(event_log(spark, d), "u00000033x").select("key", "value")


@query(f"{_LOG} SELECT key, commit_ts, value, is_deleted FROM kv WHERE key >= 'u00000020' AND key < 'u00000030'")
def kv_history(spark, d):
    return reads.history(event_log(spark, d), "u00000020", "u00000030").select("key", "commit_ts", "value", "is_deleted")


@query(_newest(tail="is_deleted", cols="key, commit_ts"))
def kv_tombstones(spark, d):
    return reads.tombstones(event_log(spark, d)).select("key", "commit_ts")


@query(
    f"""{_LOG} SELECT key, max(commit_ts) AS max_ts, count(*) AS versions, CAST(count(*) FILTER (is_deleted) AS BIGINT) AS deletes
FROM kv WHERE run_id = (SELECT max(run_id) FROM kv) GROUP BY key"""
)
def kv_memtable(spark, d):
    """The newest run as a memtable: versions of each key in it."""
    log = event_log(spark, d)
    last = log.agg(F.max("run_id")).first()[0]
    active = log.filter(F.col("run_id") == F.lit(last))
    return active.groupBy("key").agg(F.max("commit_ts").alias("max_ts"), F.count(F.lit(1)).alias("versions"), F.count_if("is_deleted").alias("deletes"))


# -- merges


@query(_newest(order="run_id DESC, commit_ts DESC", tail="true", cols="key, value, commit_ts"))
def kv_merge_runs(spark, d):
    return reads.versions_at(event_log(spark, d)).select("key", "value", "commit_ts")


@query(
    f"""{_LOG}, f AS (SELECT *, CASE run_id % 3 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS age FROM kv)
SELECT key, value, commit_ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY age, commit_ts DESC) AS rn FROM f) t WHERE rn = 1"""
)
def kv_k_way(spark, d):
    log = event_log(spark, d)
    return merge.k_way([log.filter(F.col("run_id") % 3 == r) for r in (2, 1, 0)]).select("key", "value", "commit_ts")


@query(
    f"""{_LOG}, u AS (SELECT key, max(commit_ts) AS commit_ts FROM kv WHERE run_id % 2 = 0 GROUP BY key),
l AS (SELECT key, max(commit_ts) AS commit_ts FROM kv WHERE run_id % 2 = 1 GROUP BY key)
SELECT key, commit_ts FROM u UNION ALL SELECT key, commit_ts FROM l WHERE key NOT IN (SELECT key FROM u)"""
)
def kv_two_merge(spark, d):
    log = event_log(spark, d)
    best = lambda x: x.groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))
    return merge.two_way(best(log.filter("run_id % 2 = 0")), best(log.filter("run_id % 2 = 1")))


def order_runs(spark, d):
    """Runs with separate key ranges: a thousand order keys each."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"),
        F.col("o_custkey").alias("commit_ts"),
        F.col("o_orderstatus").alias("value"),
        F.lit(0).cast("bigint").alias("version"),
        F.lit(False).alias("is_deleted"),
        F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("run_id"),
    )


_ORD = """WITH r AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_custkey AS commit_ts, o_orderstatus AS value,
  CAST(0 AS BIGINT) AS version, o_orderkey // 1000 AS run_id FROM orders)"""


def _all_order_runs(spark, d) -> list[DataFrame]:
    """All runs, in three groups."""
    r = order_runs(spark, d)
    return [r.filter(F.col("run_id") % 3 == i) for i in range(3)]


@query(f"{_ORD} SELECT key, value FROM r")
def kv_concat_runs(spark, d):
    return merge.concat(_all_order_runs(spark, d)).select("key", "value")


@query(f"{_ORD} SELECT key, value FROM r WHERE key >= '0000000700'")
def kv_concat_seek(spark, d):
    return merge.concat_from(_all_order_runs(spark, d), "0000000700").select("key", "value")


@query("SELECT key, coalesce(version, -1) AS version, commit_ts, count(*) AS n FROM (SELECT DISTINCT key, version, commit_ts FROM kv_log) t GROUP BY ALL")
def kv_merge_exact(spark, d):
    log = table(spark, d, "kv_log", "key", "version", "commit_ts", "memtable_id")
    odd, even = log.filter("memtable_id % 2 = 1"), log.filter("memtable_id % 2 = 0")
    once = merge.exact([odd, even]).groupBy("key", "version", "commit_ts").agg(F.count(F.lit(1)).alias("n"))
    return once.withColumn("version", F.coalesce("version", F.lit(-1)))


# -- metadata and pruning

_SIZE = "strlen(key) + strlen(value) + 6"


@query(f"{_ORD} SELECT run_id, count(*) AS rows, min(key) AS first_key, max(key) AS last_key, max(commit_ts) AS max_ts, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM r GROUP BY run_id")
def kv_run_meta(spark, d):
    return pruning.run_meta(order_runs(spark, d))


@query(f"{_LOG} SELECT run_id, count(*) AS rows, min(key) AS first_key, max(key) AS last_key, max(commit_ts) AS max_ts, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM kv GROUP BY run_id")
def kv_run_meta_events(spark, d):
    return pruning.run_meta(event_log(spark, d))


@query(
    f"""{_ORD}, b AS (SELECT run_id, key, (row_number() OVER (PARTITION BY run_id ORDER BY key, commit_ts DESC) - 1) // 64 AS block_no FROM r)
SELECT run_id, block_no, count(*) AS rows, min(key) AS first_key, max(key) AS last_key FROM b GROUP BY run_id, block_no"""
)
def kv_block_index(spark, d):
    return pruning.block_index(order_runs(spark, d), 64, "run_id")


@query(f"{_ORD} SELECT run_id FROM r GROUP BY run_id HAVING min(key) <= '0000007200' AND max(key) >= '0000004500'")
def kv_run_prune(spark, d):
    return pruning.runs_for_range(pruning.run_meta(order_runs(spark, d)), "0000004500", "0000007200").select("run_id")


@query(f"{_ORD} SELECT run_id FROM r GROUP BY run_id HAVING min(key) <= '0000004321' AND max(key) >= '0000004321'")
def kv_may_contain(spark, d):
    return pruning.may_contain(pruning.run_meta(order_runs(spark, d)), "0000004321").select("run_id")


@query(
    f"""{_ORD}, b AS (SELECT run_id, key, (row_number() OVER (PARTITION BY run_id ORDER BY key, commit_ts DESC) - 1) // ((4096 - 2) // 17) AS block_no FROM r)
SELECT run_id, block_no, count(*) AS rows, 2 + 17 * count(*) AS bytes, min(key) AS first_key, max(key) AS last_key FROM b GROUP BY run_id, block_no"""
)
def kv_packed_blocks(spark, d):
    """All entries have ten bytes of key, one of value and six more here, so SQL can count them off."""
    return pruning.packed_blocks(order_runs(spark, d))


@query(
    """SELECT requested, CAST(greatest(4096, ceil(requested / 4096.0) * 4096) AS INTEGER) AS aligned
FROM (SELECT DISTINCT CAST(l_partkey AS INTEGER) AS requested FROM lineitem) t"""
)
def kv_block_align(spark, d):
    p = table(spark, d, "lineitem", "l_partkey").select(F.col("l_partkey").cast("int").alias("requested")).distinct()
    return p.select("requested", pruning.aligned(F.col("requested")).alias("aligned"))


@query(
    """SELECT n, p, CAST(ceil(-n * ln(p) / power(ln(2), 2)) AS BIGINT) AS bits,
CAST(greatest(1, round(ceil(-n * ln(p) / power(ln(2), 2)) / n * ln(2))) AS INTEGER) AS hashes
FROM (VALUES (100, 0.01::DOUBLE), (1000, 0.001::DOUBLE), (10000, 0.0001::DOUBLE)) t(n, p)"""
)
def kv_bloom_sizing(spark, d):
    t = spark.createDataFrame([(100, 0.01), (1000, 0.001), (10000, 0.0001)], "n int, p double")
    return t.select("n", "p", bloom.bits_for(F.col("n"), F.col("p")).alias("bits"), bloom.hashes_for(F.col("n"), F.col("p")).alias("hashes"))


@query()
def kv_bloom_probe(spark, d):
    """All keys, and an absent neighbour of each, against the filters of the runs whose range of keys holds them."""
    log = order_runs(spark, d)
    runs = log.groupBy("run_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    own = log.select("run_id", "key").distinct()
    near = own.select("run_id", F.concat("key", F.lit("x")).alias("key")).join(runs, "run_id").filter("key <= last_key").select("run_id", "key")
    return bloom.probe_keys(bloom.run_filters(log), own.unionByName(near))


@query(
    f"""{_ORD}, b AS (SELECT run_id, key, (row_number() OVER (PARTITION BY run_id ORDER BY key, commit_ts DESC) - 1) // 64 AS block_no FROM r),
i AS (SELECT run_id, block_no, max(key) AS last_key FROM b GROUP BY run_id, block_no)
SELECT run_id, min(block_no) AS block_no FROM i WHERE last_key >= '0000004321' GROUP BY run_id"""
)
def kv_find_block(spark, d):
    """In each run that doesn't end before a key, the block to begin at."""
    return pruning.find_block(pruning.block_index(order_runs(spark, d), 64, "run_id"), "0000004321", "run_id")


@query("SELECT doc_id, octet_length(encode(message_id)) AS key_bytes, octet_length(encode(text)) AS value_bytes FROM documents WHERE octet_length(encode(message_id)) > 65535 OR octet_length(encode(text)) > 65535")
def kv_value_sizes(spark, d):
    """The messages that a block can't hold, by message id."""
    log = table(spark, d, "documents", "doc_id", F.col("message_id").alias("key"), F.col("text").alias("value"))
    return pruning.too_large(log).select("doc_id", F.octet_length("key").cast("bigint").alias("key_bytes"), F.octet_length("value").cast("bigint").alias("value_bytes"))


@query(f"{_ORD} SELECT run_id, count(DISTINCT key) AS keys, CAST(0 AS BIGINT) AS missed FROM r GROUP BY run_id")
def kv_bloom_complete(spark, d):
    """How many of each run's own keys its filter denies."""
    own = order_runs(spark, d).select("run_id", "key").distinct()
    asked = bloom.probe_keys(bloom.run_filters(order_runs(spark, d)), own)
    return asked.groupBy("run_id").agg(F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("maybe")).alias("missed"))


# -- compaction

_RUNS = "runs AS (SELECT DISTINCT level, run_id FROM kv)"


@query(
    f"""{_LOG}, {_RUNS} SELECT CAST(l AS INTEGER) AS level, (SELECT count(*) FROM runs WHERE level = l) AS files FROM range(0, 8) t(l)"""
)
def kv_level_counts(spark, d):
    return compaction.level_counts(event_log(spark, d).select("level", "run_id").distinct())


@query(
    f"""{_LOG}, {_RUNS}, c AS (SELECT l AS level, (SELECT count(*) FROM runs WHERE level = l) AS files FROM range(0, 8) t(l)),
p AS (SELECT level, level + 1 AS lower_level, files, lead(files) OVER (ORDER BY level) AS lower FROM c)
SELECT CAST(level AS INTEGER) AS upper_level, CAST(lower_level AS INTEGER) AS lower_level, lower_level = 7 AS bottom,
  CASE WHEN level = 0 THEN 'level 0 is full' WHEN lower = 0 THEN 'lower level is empty' ELSE 'lower level is small' END AS reason
FROM p WHERE lower IS NOT NULL AND ((level = 0 AND files >= 4) OR (level > 0 AND lower = 0 AND files >= 4)
  OR (level > 0 AND lower > 0 AND files > 0 AND floor(lower * 100 / files) < 200))
ORDER BY level LIMIT 1"""
)
def kv_compact_pick(spark, d):
    return compaction.pick(event_log(spark, d).select("level", "run_id").distinct())


@query(
    f"""{_LOG}, {_RUNS} SELECT level, run_id FROM runs WHERE level NOT IN (0, 1)
UNION ALL SELECT CAST(1 AS INTEGER), CAST(v AS BIGINT) FROM (VALUES (1000001), (1000002)) t(v)"""
)
def kv_compact_apply(spark, d):
    runs = event_log(spark, d).select("level", "run_id").distinct()
    return compaction.apply_result(runs, 0, 1, spark.createDataFrame([(1000001,), (1000002,)], "run_id bigint"))


@query(f"{_LOG} SELECT DISTINCT key, version, commit_ts, value, is_deleted, CAST(1 AS INTEGER) AS level FROM kv WHERE level IN (0, 1)")
def kv_compact_l0(spark, d):
    return compaction.merged(event_log(spark, d), 0, 1).select("key", "version", "commit_ts", "value", "is_deleted", "level")


@query(f"{_LOG} SELECT DISTINCT key, version, commit_ts, value, is_deleted, CAST(2 AS INTEGER) AS level FROM kv WHERE level IN (1, 2)")
def kv_compact_level(spark, d):
    return compaction.merged(event_log(spark, d), 1, 2).select("key", "version", "commit_ts", "value", "is_deleted", "level")


@query(f"{_LOG} SELECT count(*) AS rows, count(DISTINCT key) AS keys FROM kv")
def kv_compact_outputs(spark, d):
    """Rows and keys in the output files of a full rewrite."""
    log = event_log(spark, d)
    files = compaction.output_files(log, compaction.target_files(log, 64 << 10))
    return files.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count("key").alias("keys"))


@query(
    f"""{_LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY key, commit_ts <= 6000 ORDER BY commit_ts DESC) AS rn FROM kv)
SELECT key, commit_ts, value FROM w WHERE commit_ts > 6000 OR (rn = 1 AND NOT is_deleted)"""
)
def kv_gc_versions(spark, d):
    return compaction.drop_old_versions(event_log(spark, d), 6000).select("key", "commit_ts", "value")


# -- transactions


@query(f"{_LOG} SELECT txn_id, key, max(commit_ts) AS seq, max_by(value, commit_ts) AS value FROM kv GROUP BY txn_id, key")
def kv_txn_collapse(spark, d):
    w = event_log(spark, d).select("txn_id", "key", F.col("commit_ts").alias("seq"), "value")
    return txn.collapse(w)


@query(f"{_LOG} SELECT txn_id, CAST(500 + dense_rank() OVER (ORDER BY txn_id) AS BIGINT) AS commit_ts FROM (SELECT DISTINCT txn_id FROM kv) t")
def kv_commit_ts(spark, d):
    return txn.commit_timestamps(event_log(spark, d), 500)


@query(
    f"""{_LOG}, w AS (SELECT DISTINCT txn_id, key, (txn_id - 3) * 10 AS read_ts, txn_id * 10 + 9 AS commit_ts FROM kv)
SELECT DISTINCT a.txn_id FROM w a JOIN w b ON a.key = b.key AND b.txn_id <> a.txn_id AND b.commit_ts > a.read_ts AND b.commit_ts < a.commit_ts"""
)
def kv_conflicts_between(spark, d):
    """Transactions that began while the three before them were open."""
    w = event_log(spark, d).select(
        "txn_id", "key", ((F.col("txn_id") - 3) * 10).alias("read_ts"), (F.col("txn_id") * 10 + 9).alias("commit_ts")
    )
    return txn.conflicts_between(w)


@query(
    f"""{_LOG}, w AS (SELECT DISTINCT txn_id, key, txn_id * 10 + 9 AS read_ts FROM kv)
SELECT txn_id, key FROM w WHERE EXISTS (SELECT 1 FROM kv WHERE kv.key = w.key AND kv.commit_ts > w.read_ts)"""
)
def kv_conflicts(spark, d):
    """All transactions tried again, each on the snapshot that followed its first try."""
    log = event_log(spark, d)
    w = log.select("txn_id", "key").distinct().withColumn("read_ts", F.col("txn_id") * 10 + 9)
    return txn.conflicts(w, log).select("txn_id", "key")


@query(
    f"""{_LOG}, last AS (SELECT key, max(txn_id) AS last_txn FROM kv GROUP BY key)
SELECT DISTINCT txn_id FROM kv JOIN last USING (key) WHERE last_txn > txn_id"""
)
def kv_hash_conflicts(spark, d):
    """Retries that share a key hash with a later transaction."""
    log = event_log(spark, d).withColumn("h", codec.polynomial_hash(F.col("key")))
    done = log.groupBy("txn_id").agg(F.max("commit_ts").alias("commit_ts"), F.collect_set("h").alias("key_hashes"))
    again = done.select("txn_id", (F.col("txn_id") * 10 + 9).alias("read_ts"), "key_hashes")
    return txn.hash_conflicts(done.select("commit_ts", "key_hashes"), again)


@query(f"{_LOG} SELECT min(commit_ts) AS low_water_mark FROM kv WHERE txn_id >= 400")
def kv_low_water_mark(spark, d):
    return txn.low_water_mark(event_log(spark, d).filter("txn_id >= 400").select(F.col("commit_ts").alias("read_ts")))


@query("SELECT max(event_id) AS recovered_ts FROM events")
def kv_recover_ts(spark, d):
    return txn.recovered_timestamp(event_log(spark, d))


# -- manifest

_EFFECTS = """WITH made AS (
  SELECT record_no, flush_id AS id, 0 AS level FROM manifest WHERE type = 'flush' AND flush_id IS NOT NULL
  UNION SELECT record_no, unnest(produced_ssts), CASE WHEN type = 'flush' THEN 0 ELSE coalesce(compaction_task.lower_level, 1) END FROM manifest WHERE type IN ('flush', 'compaction')
  UNION SELECT record_no, unnest(compaction_task.output_ids), coalesce(compaction_task.lower_level, 1) FROM manifest WHERE type = 'compaction'),
produced AS (SELECT * FROM made WHERE id IS NOT NULL),
took AS (
  SELECT record_no, unnest(compaction_task.upper_ids) AS id FROM manifest WHERE type = 'compaction'
  UNION SELECT record_no, unnest(compaction_task.lower_ids) FROM manifest WHERE type = 'compaction'),
consumed AS (
  SELECT t.* FROM took t WHERE t.id IS NOT NULL AND t.record_no IN (SELECT record_no FROM produced)
  AND NOT EXISTS (SELECT 1 FROM produced p WHERE p.record_no = t.record_no AND p.id = t.id)),
ev AS (SELECT record_no, id, 1 AS made, level FROM produced UNION ALL SELECT record_no, id, 0, NULL FROM consumed)"""


@query(
    f"""{_EFFECTS} SELECT id AS sst_id, CAST(level AS INTEGER) AS level FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_no DESC, made DESC, level DESC) AS rn FROM ev) t WHERE rn = 1 AND made = 1"""
)
def kv_manifest_replay(spark, d):
    return mf.replay(table(spark, d, "manifest"))


@query(f"{_EFFECTS} SELECT DISTINCT memtable_id FROM manifest WHERE type = 'memtable' AND memtable_id IS NOT NULL AND memtable_id NOT IN (SELECT id FROM produced)")
def kv_manifest_unflushed(spark, d):
    return mf.memtables_to_replay(table(spark, d, "manifest"))


@query("SELECT type, count(*) AS n FROM manifest WHERE type IS NOT NULL AND record_no % 10 <> 3 GROUP BY type")
def kv_manifest_valid(spark, d):
    """The manifest written as checksummed lines, a tenth of them damaged, and read back: the valid ones by type."""
    m = table(spark, d, "manifest")
    body = F.to_json(F.struct("type", F.col("flush_id").alias("flushID"), F.col("memtable_id").alias("memtableID"), F.lit(0).alias("checksum")))
    crc = F.crc32(body.cast("binary")) + F.when(F.col("record_no") % 10 == 3, 1).otherwise(0)
    lines = m.select(F.regexp_replace(body, r'"checksum":0\}$', F.concat(F.lit('"checksum":'), crc.cast("string"), F.lit("}"))).alias("value"))
    return mf.parse(lines).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# -- scalar functions


def _hex(c: Column) -> Column:
    return F.hex(c)


@query(
    """SELECT o_orderkey, concat(hex(lpad(CAST(o_orderkey AS VARCHAR), 10, '0')), lpad(upper(to_hex(o_custkey)), 16, '0'),
  upper(to_hex(xor(CAST(o_orderkey AS BIGINT), CAST(-1 AS BIGINT))))) AS encoded FROM orders"""
)
def kv_key_encode(spark, d):
    o = order_runs(spark, d)
    e = codec.encode_key(F.col("key"), F.col("commit_ts"), F.col("key").cast("bigint"))
    return o.select(F.col("key").cast("bigint").alias("o_orderkey"), _hex(e).alias("encoded"))


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_custkey AS version, o_orderkey AS commit_ts FROM orders")
def kv_key_decode(spark, d):
    o = order_runs(spark, d)
    e = codec.decode_key(codec.encode_key(F.col("key"), F.col("commit_ts"), F.col("key").cast("bigint")))
    return o.select(e.alias("x")).select(F.col("x.key").cast("string").alias("key"), "x.version", "x.commit_ts")


@query("SELECT log_id, CAST(octet_length(encode(key)) + 16 AS BIGINT) AS size FROM kv_log WHERE key IS NOT NULL")
def kv_element_size(spark, d):
    log = table(spark, d, "kv_log", "log_id", "key").filter("key is not null")
    return log.select("log_id", codec.element_size(F.col("key")).alias("size"))


_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, b: (h * 31 + b) % 4294967296)"


@query(f"{_ORD} SELECT key, CAST({_HASH} AS BIGINT) AS h FROM r")
def kv_hash31(spark, d):
    return order_runs(spark, d).select("key", codec.polynomial_hash(F.col("key")).alias("h"))


# CRC-32 bit by bit: eight steps for each byte (the keys are ASCII here).
_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))), "
    "lambda h, b: list_reduce(list_prepend(xor(h, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)


@query(f"{_ORD} SELECT key, CAST({_CRC} AS BIGINT) AS crc FROM r")
def kv_crc32(spark, d):
    return order_runs(spark, d).select("key", codec.checksum(F.col("key")).alias("crc"))


@query(f"{_LOG} SELECT DISTINCT concat(run_id, '_', commit_ts // 100) AS cache_key FROM kv")
def kv_cache_key(spark, d):
    log = event_log(spark, d)
    return log.select(codec.cache_key(F.col("run_id"), F.floor(F.col("commit_ts") / 100)).alias("cache_key")).distinct()


@query("SELECT CAST(t AS INTEGER) AS t, CASE t WHEN 0 THEN 'Leveled' WHEN 1 THEN 'Tiered' WHEN 2 THEN 'Simple' WHEN 3 THEN 'NoCompaction' ELSE 'Unknown' END AS name FROM range(0, 6) r(t)")
def kv_task_names(spark, d):
    return spark.range(6).select(F.col("id").cast("int").alias("t")).withColumn("name", codec.task_name(F.col("t")))


@query("SELECT record_no, coalesce(list_max(produced_ssts), 0) AS greatest FROM manifest")
def kv_array_max(spark, d):
    return table(spark, d, "manifest", "record_no", "produced_ssts").select("record_no", codec.array_max_or_zero(F.col("produced_ssts")).alias("greatest"))


# -- log, metrics, streams


@query("SELECT memtable_id, count(*) AS rows, min(log_id) AS first_index, max(log_id) AS last_index, CAST(sum(coalesce(octet_length(encode(key)), 0) + 16 + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS bytes FROM kv_log GROUP BY memtable_id")
def kv_wal_index(spark, d):
    """First and last index and size of each memtable's log."""
    log = table(spark, d, "kv_log", "memtable_id", "log_id", "key", "value")
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + 16 + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.groupBy("memtable_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("log_id").alias("first_index"), F.max("log_id").alias("last_index"), F.sum(size.cast("bigint")).alias("bytes")
    )


@query("SELECT event_type AS op, count(*) AS n, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS without_value FROM events GROUP BY event_type")
def kv_op_counts(spark, d):
    return table(spark, d, "events", "event_type", "value").groupBy(F.col("event_type").alias("op")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("without_value"))


@query(
    """WITH b AS (SELECT i, 0.0001 * power(2, i) AS le FROM range(0, 10) t(i)), v AS (SELECT value / 10000 AS v FROM events WHERE value IS NOT NULL)
SELECT CAST(i AS INTEGER) AS bucket, (SELECT count(*) FROM v WHERE v <= le) AS n FROM b UNION ALL SELECT 10, (SELECT count(*) FROM v)"""
)
def kv_latency_histogram(spark, d):
    e = table(spark, d, "events", "value").select((F.col("value") / 10000).alias("v"))
    h = metrics.histogram(e, "v")
    at = F.when(F.col("le") == float("inf"), 10).otherwise(F.round(F.log2(F.col("le") / metrics.START))).cast("int")
    return h.select(at.alias("bucket"), "n")


@query(_newest(tail="true", cols="key, commit_ts, value, is_deleted"))
def kv_stream_latest(spark, d):
    """The latest version of each key, from the events as a stream of files, drained."""
    from siltbed.streaming.ingest import latest_by_key

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if d.endswith("/") else "*").parquet(_stream_folder(spark, d))
    key = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    log = s.select(key.alias("key"), F.col("event_id").alias("commit_ts"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("is_deleted"))
    out, done = shared_path(spark, "latest"), shared_path(spark, "latest-checkpoint")

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = latest_by_key(log).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", done).trigger(availableNow=True).start()
    q.awaitTermination()
    batches = spark.read.parquet(out)
    last = batches.agg(F.max("batch")).first()[0]
    return batches.filter(F.col("batch") == F.lit(last)).select("key", "commit_ts", "value", "is_deleted")


def _stream_folder(spark, d):
    """A folder with nothing but the events, for the file source: written to the shared folder in eight files."""
    path = shared_path(spark, "events-stream")
    spark.read.parquet(f"{d}/events.parquet").repartition(8, "event_id").write.parquet(path)
    return path


@query("SELECT key, mod_revision FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, mod_revision DESC) AS rn FROM kv_log WHERE key IS NOT NULL AND key <> '') t WHERE rn = 1 AND NOT coalesce(is_deleted, false)")
def kv_stream_ingest(spark, d):
    """The change log as a stream into a store of runs, six batches with compactions between, then the current state."""
    from siltbed.operators.change_store import ChangeStore
    from siltbed.streaming.ingest import ingest, read_changes

    cols = ["key", "commit_ts", "mod_revision", "is_deleted"]
    src = shared_path(spark, "stream-source")
    table(spark, d, "kv_log", *cols).repartition(12).write.parquet(src)
    store = ChangeStore(spark, shared_path(spark, "stream-store"))
    ingest(read_changes(spark, src, "key string, commit_ts bigint, mod_revision bigint, is_deleted boolean", 2), store, shared_path(spark, "stream-checkpoint")).awaitTermination()
    return store.read().select("key", "mod_revision")


def _filled_engine(spark, d, batches: int = 6, **options):
    """An engine with all events: each event is a commit of its own, imported in batches by number, then two single
    writes. Small runs, so that there are several."""
    from siltbed.engine import Engine, Options

    e = Engine(spark, shared_path(spark, "engine"), Options(**{"target_run_bytes": 1 << 20, **options}))
    log = event_log(spark, d).select("key", "value", "is_deleted", "commit_ts")
    lo, hi = log.agg(F.min("commit_ts"), F.max("commit_ts")).first()
    step = max(1, -(-((hi or 0) - (lo or 0) + 1) // batches))
    for a in range(lo or 0, (hi or 0) + 1, step):
        e.write_batch(log.filter((F.col("commit_ts") >= a) & (F.col("commit_ts") < a + step)), order="commit_ts")
    e.put("u-extra", "x")
    e.delete("u-extra")
    e.flush()
    return e


@query(_newest())
def kv_engine(spark, d):
    """The whole engine: all versions of all events imported, single writes, flushed, compacted on the way and at last
    as a whole, then scanned."""
    e = _filled_engine(spark, d)
    e.compact(full=True)
    return e.scan()


@query(f"{_LOG} SELECT count(*) + 2 AS rows, count(DISTINCT key) + 1 AS keys, CAST(0 AS BIGINT) AS overlaps, true AS settled FROM kv")
def kv_engine_levels(spark, d):
    """After compactions: rows and keys over all levels, runs of a level below 0 that reach past the first key of the
    next one (a key with many versions may end one run and begin the next), and whether nothing more is due."""
    e = _filled_engine(spark, d, target_run_bytes=256 << 10)
    meta = e.runs_table().filter("level > 0")  # one row a run
    following = F.lead("first_key").over(Window.partitionBy("level").orderBy("first_key", "last_key"))
    overlaps = meta.withColumn("following", following).filter("following < last_key").count()
    due = compaction.pick(e.runs_table()).count() + (0 if compaction.due(e.counts()) is None else 1)
    log = e.log().groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count("key").alias("keys"))
    return log.withColumn("overlaps", F.lit(overlaps).cast("bigint")).withColumn("settled", F.lit(due == 0))


@query(_newest(tail="true", cols="key, value, is_deleted"))
def kv_engine_recover(spark, d):
    """A process that is gone without closing: its logs and its manifest are read by the next one. Half of the events are
    in runs, the others only in logs that were written in batches."""
    from siltbed.engine import Engine, Options
    from siltbed.sources.wal import WalOptions

    path = shared_path(spark, "engine")
    log = event_log(spark, d).select("key", "value", "is_deleted", "commit_ts")
    top = log.agg(F.max("commit_ts")).first()[0] or 0
    first = Engine(spark, path, Options(sync_wal=False, memtable_bytes=64 << 20, wal=WalOptions(queue_rows=1 << 30)))
    first.write_batch(log.filter(F.col("commit_ts") <= top // 2), order="commit_ts")
    for n, (key, value, gone, _) in enumerate(local_rows(log.filter(F.col("commit_ts") > top // 2).orderBy("commit_ts")), 1):
        first.delete(key) if gone else first.put(key, value)
        if n % SYNC_ROWS == 0:
            first.wal.sync()
    first.wal.close()
    found = Engine(spark, path)
    # A delete has no value of its own in the engine.
    kept = reads.versions_at(found.log()).select("key", "value", "is_deleted")
    return kept.withColumn("value", F.when(F.col("is_deleted"), F.lit("error")).otherwise(F.col("value")))


@query(
    f"""{_LOG} SELECT DISTINCT a.txn_id FROM kv a JOIN kv b ON a.key = b.key AND b.txn_id = a.txn_id - 1 WHERE a.txn_id % 2 = 1"""
)
def kv_engine_txn(spark, d):
    """All transactions in pairs, the second begun before the first commits: the ones that the engine rejects."""
    from siltbed.engine import Conflict, Engine, Options
    from siltbed.sources.wal import WalOptions

    e = Engine(spark, shared_path(spark, "engine"), Options(sync_wal=False, memtable_bytes=64 << 20, wal=WalOptions(queue_rows=1 << 30)))
    rows = local_rows(event_log(spark, d).orderBy("commit_ts").select("txn_id", "key", "value", "is_deleted"))
    lost, open_, n = [], {}, 0
    for pair, members in groupby(rows, lambda r: r[0] // 2):
        open_ = {i: e.write_txn() for i in (2 * pair, 2 * pair + 1)}
        for txn_id, key, value, gone in members:
            t = open_[txn_id]
            t.delete(key) if gone else t.put(key, value)
            n += 1
        for i, t in open_.items():
            try:
                t.commit()
            except Conflict:
                lost.append((i,))
        if n >= SYNC_ROWS:
            e.wal.sync()
            n = 0
    e.close()
    return spark.createDataFrame(lost, "txn_id bigint")


@query("SELECT event_id AS commit_ts, event_type AS value FROM events")
def kv_wal_replay(spark, d):
    """All events through the batched log of a memtable, and read again from its files."""
    from siltbed.sources import runs
    from siltbed.sources.wal import WalBatcher, WalOptions

    root = shared_path(spark, "wal")
    wal = WalBatcher(spark, root, WalOptions(queue_rows=1 << 30))
    for n, (key, ts, value, gone) in enumerate(local_rows(event_log(spark, d).select("key", "commit_ts", "value", "is_deleted")), 1):
        wal.submit(1, [(key, 0, ts, value, gone, None, None, None)])
        if n % SYNC_ROWS == 0:
            wal.sync()
    wal.close()
    return runs.read_wal(spark, root).select("commit_ts", "value")


def _manifest_files(spark, d):
    """The manifest table as the files of a store that lost its manifest: a backup, and a side log with the last lines.
    It returns the folder."""
    from siltbed.session import write_bytes

    m = table(spark, d, "manifest").orderBy("record_no")
    lines = []
    for r in m.toLocalIterator():
        x = r.asDict(recursive=True)
        task = {"compactionTask": x["compaction_task"]} if x["compaction_task"] else {}
        lines.append(mf.line({"type": x["type"], "flushID": x["flush_id"], "memtableID": x["memtable_id"], **task, "producedSsts": x["produced_ssts"], "timestamp": x["record_no"]}))
    folder = shared_path(spark, "manifest")
    cut = max(0, len(lines) - mf.SIDE_LINES // 2)
    for name, some in (("MANIFEST.bak", lines[:cut]), ("MANIFEST.wal", lines[cut:])):
        write_bytes(spark, f"{folder}/{name}", ("\n".join(some) + "\n").encode())
    return folder


_REPLAYED = f"""{_EFFECTS} SELECT id AS sst_id, CAST(level AS INTEGER) AS level FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_no DESC, made DESC, level DESC) AS rn FROM ev) t WHERE rn = 1 AND made = 1"""


@query(_REPLAYED)
def kv_manifest_recover(spark, d):
    """Recovery where the manifest is lost: backup and side log together are the whole state."""
    return mf.replay(mf.ManifestFile(spark, _manifest_files(spark, d)).table())


@query(f"SELECT sst_id FROM ({_REPLAYED}) r")
def kv_manifest_compacted(spark, d):
    """The same files after the manifest was rewritten without what later records made void, and opened again."""
    folder = _manifest_files(spark, d)
    mf.ManifestFile(spark, folder).compact()
    return mf.replay(mf.ManifestFile(spark, folder).table()).select("sst_id")


# -- the remaining small operators


@query(
    f"""{_LOG} SELECT run_id, key, commit_ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY key, commit_ts DESC) AS rn FROM kv) t WHERE rn = 18"""
)
def kv_entry_at(spark, d):
    return pruning.entry_at(event_log(spark, d), 17).select("run_id", "key", "commit_ts", "value")


_META = "m AS (SELECT level, run_id, min(key) AS first_key, max(key) AS last_key FROM kv GROUP BY ALL)"


@query(f"{_LOG}, {_META} SELECT level, array_to_string(list(run_id ORDER BY first_key, run_id), ',') AS runs FROM m GROUP BY level")
def kv_sorted_runs(spark, d):
    meta = event_log(spark, d).groupBy("level", "run_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    return pruning.sorted_runs(meta).select("level", F.array_join(F.col("runs").cast("array<string>"), ",").alias("runs"))


@query(
    f"""{_LOG}, {_META} SELECT level, run_id, coalesce(lead(first_key) OVER (PARTITION BY level ORDER BY first_key, run_id) <= last_key, false) AS overlaps_next FROM m"""
)
def kv_overlaps(spark, d):
    meta = event_log(spark, d).groupBy("level", "run_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    return pruning.overlapping_pairs(meta)


@query("SELECT memtable_id, CAST(sum(octet_length(encode(key)) + 16 + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS bytes FROM kv_log WHERE key IS NOT NULL GROUP BY memtable_id")
def kv_memtable_size(spark, d):
    return pruning.estimated_size(table(spark, d, "kv_log", "memtable_id", "key", "value"), "memtable_id")


@query(f"{_LOG} SELECT o_orderkey AS commit_ts FROM orders WHERE o_orderkey IN (SELECT commit_ts FROM kv)")
def kv_is_committed(spark, d):
    """The order numbers that are timestamps at which something was committed."""
    return txn.committed(table(spark, d, "orders", F.col("o_orderkey").alias("commit_ts")), event_log(spark, d))


@query(
    f"""{_LOG} SELECT o_orderkey AS txn_id, CASE WHEN o_orderkey % 7 = 0 THEN 'aborted' WHEN o_orderkey IN (SELECT txn_id FROM kv) THEN 'committed' ELSE 'pending' END AS state FROM (SELECT DISTINCT o_orderkey FROM orders) t"""
)
def kv_txn_states(spark, d):
    ids = table(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("txn_id"))
    return txn.outcomes(ids, event_log(spark, d), ids.filter("txn_id % 7 = 0"))


@query(f"{_LOG} SELECT CAST(floor(least((SELECT max(commit_ts) FROM kv), 4000) * 0.7) AS BIGINT) AS horizon")
def kv_discard_horizon(spark, d):
    mark = txn.recovered_timestamp(event_log(spark, d)).first()[0]
    return spark.createDataFrame([(compaction.discard_horizon(mark, 4000),)], "horizon bigint")


@query(f"{_LOG} SELECT CAST(max(run_id) + 1 AS BIGINT) AS next_run_id FROM kv")
def kv_next_run_id(spark, d):
    return event_log(spark, d).agg((F.max("run_id") + 1).alias("next_run_id"))


@query("SELECT record_no, CAST(list_sum(produced_ssts) AS BIGINT) AS total FROM manifest WHERE len(produced_ssts) > 0")
def kv_widen(spark, d):
    m = table(spark, d, "manifest", "record_no", "produced_ssts").filter(F.size("produced_ssts") > 0)
    wide = codec.widen(F.col("produced_ssts").cast("array<int>"))
    return m.select("record_no", F.aggregate(F.filter(wide, lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_custkey) AS BIGINT) AS id FROM customer")
def kv_sequence(spark, d):
    return txn.numbered(table(spark, d, "customer", "c_custkey"), "c_custkey", 0, "id")


@query(_newest("key >= 'u00000010' AND key < 'u00000050'", order="commit_ts DESC") + " AND key > 'u00000020'")
def kv_cached_scan(spark, d):
    """Runs kept in memory up to a capacity: the second, narrower scan of a store reads them from there."""
    e = _filled_engine(spark, d, cache_bytes=256 << 20)
    e.scan("u00000010", "u00000050").count()
    return e.scan("u00000010", "u00000050").filter("key > 'u00000020'")


@query("SELECT key, coalesce(version, -1) AS version, commit_ts, value, coalesce(is_deleted, false) AS is_deleted FROM kv_log")
def kv_log_batches(spark, d):
    """Records collected into batches, one for each transaction and memtable, and flattened again."""
    return _batched(_batch_log(spark, d))


def _batch_log(spark, d):
    return table(spark, d, "kv_log", "key", "version", "commit_ts", "value", "is_deleted", "memtable_id", "txn_id")


def _batched(log: DataFrame) -> DataFrame:
    rec = F.struct("key", F.coalesce("version", F.lit(-1)).alias("version"), "commit_ts", "value", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"))
    batches = log.groupBy("memtable_id", "txn_id").agg(F.collect_list(rec).alias("records"))
    return batches.select(F.explode("records").alias("r")).select("r.*")
