"""The queries of the problems of training data, p2 and p6-p8, with SQL where it can express them; tests hold the others
against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.packing import CAPACITY, pack, packed
from siltbed.llm.seen_keys import seen_before, wrong_answers
from siltbed.llm.stuffing import measures, stuffed_pages
from siltbed.llm.tokens import encode
from siltbed.sources.tables import table


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str, str]:
    return table(spark, d, "kv_log", "key", "log_id"), table(spark, d, "key_probe", "key", "probe_id"), "log_id", "probe_id"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen_before(*_records(spark, d))


def p2_wrong_rate(spark: SparkSession, d: str) -> DataFrame:
    return wrong_answers(*_records(spark, d))


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """The distinct keys in the filters of each sealed batch."""
    return wrong_answers(*_records(spark, d)).select("gen", "n_keys")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents", "doc_id", "text"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(encode(table(spark, d, "documents", "doc_id", "text"), count_only=True))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The divided documents: those with a piece after the first."""
    return p7_containers(spark, d).filter("piece = 1").select("doc_id")


def p7_sums(spark: SparkSession, d: str) -> DataFrame:
    """Documents, those whose pieces don't add up to their tokens or aren't numbered without gaps, containers too full."""
    sizes = encode(table(spark, d, "documents", "doc_id", "text"), count_only=True)
    placed = pack(sizes)
    each = placed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"))
    wrong = ~(F.col("size").eqNullSafe(F.col("n")) & (F.col("pieces") == F.col("last") + 1))
    docs = sizes.join(each, "doc_id", "left").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("wrong"))
    full = placed.groupBy("container").agg(F.sum("size").alias("size")).agg(F.count_if(F.col("size") > CAPACITY).alias("too_full"))
    one = F.lit(1).alias("one")
    return docs.select("*", one).join(full.select("*", one), "one").drop("one")


def p7_evolution(spark: SparkSession, d: str) -> DataFrame:
    """What evolution did: blocks, containers used and needed at least, blocks above that, children, by level and round."""
    report = packed(encode(table(spark, d, "documents", "doc_id", "text"), count_only=True))[1]
    columns = ("level", "round", "blocks", "used", "least", "open_blocks", "children")
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in report], ", ".join(f"{c} bigint" for c in columns))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(table(spark, d, "documents", "doc_id", "text", "lang"))


def p8_curves(spark: SparkSession, d: str) -> DataFrame:
    m = measures(table(spark, d, "documents", "doc_id", "text", "lang"))
    return m.select(F.col("id").alias("doc_id"), "n", "like", "slope", "residual", "unexplained", "stuffed")


QUERIES = {f.__name__: f for f in (p2_found, p2_wrong_rate, p2_batches, p6_ids, p7_found, p7_containers, p7_sums, p7_evolution, p8_found, p8_curves)}
_GEN = "CAST({base} + ({n} - min({n}) OVER ()) // greatest(1, (max({n}) OVER () - min({n}) OVER () + 4) // 4) AS INTEGER) AS gen"
ORACLE: dict[str, str] = {
    "p2_found": """
SELECT p.probe_id FROM (
  SELECT probe_id, key, min(probe_id) OVER (PARTITION BY key) AS first_id FROM key_probe WHERE key IS NOT NULL AND key <> '') p
WHERE p.probe_id > p.first_id OR p.key IN (SELECT key FROM kv_log WHERE key IS NOT NULL AND key <> '')""",
    "p7_sums": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS too_full FROM documents",
    "p2_batches": f"""
SELECT gen, count(DISTINCT key) AS n_keys FROM (
  SELECT key, {_GEN.format(base=0, n="log_id")} FROM kv_log WHERE key IS NOT NULL AND key <> ''
  UNION ALL SELECT key, {_GEN.format(base=4, n="probe_id")} FROM key_probe WHERE key IS NOT NULL AND key <> '') t GROUP BY gen""",
}
