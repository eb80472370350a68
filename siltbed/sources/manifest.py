"""The manifest: a log of JSON lines with checksums, from which the state of the files is replayed.

A line is a JSON object whose last field is checksum: the CRC32 of the same line with checksum 0. A line that is no
JSON or whose checksum is wrong is skipped; checksum 0 or none means unchecked. Appends go to a side log, which holds
the lines since the last checkpoint (at most SIDE_LINES); a checkpoint replaces first the manifest, then the backup by
all lines, and empties the side log last. So at any moment the manifest with the side log, and the backup with the
side log, each are the whole state, and an append costs the same however long the manifest is.
"""

from __future__ import annotations

import json
import time
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.operators.consolidate import manifest_effects
from siltbed.session import exists, read_bytes, remove, write_bytes

SCHEMA = (
    "type string, flushID bigint, memtableID bigint, "
    "compactionTask struct<upper_level:int, upper_ids:array<bigint>, lower_level:int, lower_ids:array<bigint>, bottom:boolean, output_ids:array<bigint>>, "
    "producedSsts array<bigint>, timestamp bigint, checksum bigint"
)
SIDE_LINES = 64
_TAIL = r'"checksum":\s*\d+\s*\}\s*$'
COMPACT_BYTES = 10 << 20


def line(record: dict) -> str:
    body = {k: v for k, v in record.items() if k != "checksum"} | {"checksum": 0}
    body["checksum"] = zlib.crc32(json.dumps(body, separators=(",", ":")).encode())
    return json.dumps(body, separators=(",", ":"))


def memtable_record(id_: int) -> dict:
    return {"type": "memtable", "memtableID": id_}


def freeze_record(id_: int) -> dict:
    return {"type": "freeze_memtable", "memtableID": id_}


def flush_record(id_: int | None, made: list[int] | None = None) -> dict:
    """A flush of memtable id_ into one run of the same number, or into the runs made."""
    return {"type": "flush", "flushID": id_, "producedSsts": [id_] if made is None else made}


def compaction_record(upper: int, upper_ids: list[int], lower: int, lower_ids: list[int], bottom: bool, outputs: list[int]) -> dict:
    task = {"upper_level": upper, "upper_ids": upper_ids, "lower_level": lower, "lower_ids": lower_ids, "bottom": bottom, "output_ids": outputs}
    return {"type": "compaction", "compactionTask": task, "producedSsts": outputs}


def valid_checksum(text: Column) -> Column:
    """Whether a line's checksum holds; a line without one, or with 0, isn't checked."""
    said = F.regexp_extract(text, r'"checksum":\s*(\d+)\s*\}\s*$', 1)
    made = F.crc32(F.regexp_replace(text, _TAIL, '"checksum":0}').cast("binary"))
    return (said == "") | (said == "0") | (made.cast("string") == said)


def parse(lines: DataFrame, text: str = "value") -> DataFrame:
    """The valid records of a table of lines, in the columns of SCHEMA. Null and blank lines are skipped."""
    rec = F.from_json(F.col(text), SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.col(text).isNotNull() & (F.trim(text) != "") & F.get_json_object(text, "$.type").isNotNull() & valid_checksum(F.col(text))
    carried = [c for c in lines.columns if c != text]
    return lines.filter(ok).select(*carried, rec.alias("r")).select(*carried, "r.*")


def as_table(records: DataFrame) -> DataFrame:
    """Records with the column names of the manifest table: record_no, type, flush_id, compaction_task, ..."""
    return records.select(
        "record_no", "type", F.col("flushID").alias("flush_id"), F.col("memtableID").alias("memtable_id"),
        F.col("compactionTask").alias("compaction_task"), F.col("producedSsts").alias("produced_ssts"),
    )


def replay(manifest: DataFrame) -> DataFrame:
    """(sst_id, level) of the live files: the last event of a file, by record_no, must be that it was produced.

    A flush produces into level 0, a compaction into its lower level (0 is unknown to it: then 1). Inside one record
    producing follows consuming. One group a file, however long the log is.
    """
    effects = manifest_effects(manifest)
    level = F.coalesce(F.when(F.col("type") == "flush", F.lit(0)), F.col("compaction_task.lower_level"), F.lit(1)).cast("int")
    levels = manifest.select("record_no", level.alias("level"))
    e = effects.join(levels, "record_no")
    made = e.select("record_no", F.explode("produced").alias("sst_id"), F.lit(1).alias("made"), "level")
    gone = e.select("record_no", F.explode("consumed").alias("sst_id"), F.lit(0).alias("made"), F.lit(None).cast("int").alias("level"))
    last = made.unionByName(gone).groupBy("sst_id").agg(F.max(F.struct("record_no", "made", "level")).alias("e"))
    return last.filter("e.made = 1").select("sst_id", F.col("e.level").alias("level"))


def memtables_to_replay(manifest: DataFrame) -> DataFrame:
    """(memtable_id) of memtables that were opened and never flushed: their logs are read again at recovery."""
    opened = manifest.filter("type = 'memtable' and memtable_id is not null").select("memtable_id").distinct()
    flushed = manifest_effects(manifest).select(F.explode("produced").alias("memtable_id"))
    return opened.join(flushed, "memtable_id", "left_anti")


class ManifestFile:
    """The manifest of one store, in a folder: MANIFEST, MANIFEST.bak and MANIFEST.wal, the lines since both were
    written."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.main, self.backup, self.side = (f"{folder}/MANIFEST{x}" for x in ("", ".bak", ".wal"))
        self.closed = False
        self.lines: list[str] = []
        self.recover()
        self.bytes = sum(len(x) + 1 for x in self.lines)

    def _read(self, path: str) -> list[str]:
        return read_bytes(self.spark, path).decode("utf-8", "replace").splitlines() if exists(self.spark, path) else []

    @staticmethod
    def _valid(text: str) -> bool:
        try:
            rec = json.loads(text)
        except ValueError:
            return False
        return isinstance(rec, dict) and "type" in rec and (not rec.get("checksum") or line(rec) == text.strip())

    def recover(self) -> None:
        """All valid lines of the manifest, or of the backup where the manifest is lost or has none, then those of the
        side log that aren't among them."""
        lines: list[str] = []
        for path in (self.main, self.backup):
            lines = lines or [x for x in self._read(path) if self._valid(x)]
        have = set(lines)
        lines += [x for x in self._read(self.side) if x not in have and self._valid(x)]
        self.lines = lines
        self.pending: list[str] = []
        if lines:
            self.checkpoint()

    def _write(self, path: str, lines: list[str]) -> None:
        write_bytes(self.spark, path, ("\n".join(lines) + "\n").encode())

    def checkpoint(self) -> None:
        """The order matters: until the backup is in place too, the side log must last."""
        self._write(self.main, self.lines)
        self._write(self.backup, self.lines)
        remove(self.spark, self.side)
        self.pending = []

    def append(self, record: dict) -> None:
        if self.closed:
            raise ValueError("the manifest is closed")
        text = line(record | {"timestamp": time.time_ns()})
        self._write(self.side, [*self.pending, text])
        self.pending.append(text)
        self.lines.append(text)
        self.bytes += len(text) + 1
        if self.bytes > COMPACT_BYTES:
            self.compact()
            self.bytes = sum(len(x) + 1 for x in self.lines)
        elif len(self.pending) >= SIDE_LINES:
            self.checkpoint()

    def compact(self) -> int:
        """Rewrite the manifest without what later records made void; returns how many lines went.

        A record keeps only those of its files that are still live, and goes if none is; memtables that were flushed
        go with their records. The state that the manifest replays to stays the same.
        """
        records = self.records()
        made: dict[int, int] = {}
        flushed: set[int] = set()
        produced: list[list[int]] = []
        for n, r in enumerate(records):
            task = r.get("compactionTask") or {}
            ids = [*(r.get("producedSsts") or []), *(task.get("output_ids") or [])]
            if r["type"] == "flush" and r.get("flushID") is not None:
                ids.append(r["flushID"])
            ids = list(dict.fromkeys(i for i in ids if i is not None)) if r["type"] in ("flush", "compaction") else []
            produced.append(ids)
            if r["type"] == "compaction" and (ids or "runs" in r):  # the engine's may have dropped every row
                for i in (*(task.get("upper_ids") or []), *(task.get("lower_ids") or [])):
                    made.pop(i, None)
            flushed.update(ids if r["type"] == "flush" else [])
            made.update((i, n) for i in ids)
        kept = []
        for n, (r, ids) in enumerate(zip(records, produced, strict=True)):
            live = [i for i in ids if made.get(i) == n]
            if r["type"] in ("memtable", "freeze_memtable"):
                if r["memtableID"] not in flushed:
                    kept.append(self.lines[n])
            elif live == ids:
                if ids:
                    kept.append(self.lines[n])
            elif live:
                new = {k: v for k, v in r.items() if k != "checksum"} | {"producedSsts": live}
                if "compactionTask" in r:
                    new["compactionTask"] = r["compactionTask"] | {"output_ids": live}
                elif new.get("flushID") not in live:
                    new["flushID"] = None
                kept.append(line(new))
        gone = len(self.lines) - len(kept)
        if gone:
            self.checkpoint()  # empties the side log, which would bring lines back
            self.lines = kept
            self._write(self.main, kept)
            self._write(self.backup, kept)
        return gone

    def records(self) -> list[dict]:
        return [json.loads(x) for x in self.lines]

    def table(self) -> DataFrame:
        rows = [(i, x) for i, x in enumerate(self.lines, 1)]
        df = self.spark.createDataFrame(rows, "record_no bigint, value string")
        return as_table(parse(df))

    def close(self) -> None:
        self.closed = True


def in_order(df: DataFrame, by: str = "record_no") -> DataFrame:
    """Records with repeats of a record_no reduced to one."""
    w = Window.partitionBy(by).orderBy(F.col("type").asc_nulls_last())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
