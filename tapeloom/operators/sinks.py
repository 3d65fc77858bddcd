"""Result tables with manifests: what was written, from what, and whether it is still what was written.

A table lies in a folder of its own kind and name.  Its manifest is one JSON text beside the data: columns, number of rows,
each part file with its length and sha256 (computed where the files are read, not on the driver), and the signature of what it
was made from.  Data go to a new folder each time and a manifest of a higher version is added last, so a reader sees the old
table or the new one, never a mixture, and a run that stopped half-way leaves the old one.  Writing again with an equal
signature is skipped.

Part files are kept below ``rows_per_file`` rows, so that hashing one fits a task.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relations import with_period

#: Kinds of tables.  fixed values
KINDS = ("factors", "factor_evaluations", "signals", "backtests", "portfolios", "universes", "reports", "scores")
ROWS_PER_FILE = 5_000_000


@dataclass(frozen=True)
class Manifest:
    kind: str
    name: str
    data: str
    columns: str
    rows: int
    signature: str
    parts: tuple[dict, ...]
    by: tuple[str, ...] = ()
    version: int = 1

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def signature(**source) -> str:
    """A digest of anything JSON can hold, the same for equal content in any order of keys."""
    return hashlib.sha256(json.dumps(source, sort_keys=True, default=str).encode()).hexdigest()


def _folder(root: str, kind: str, name: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    safe = re.sub(r"[^A-Za-z0-9._-]", "_", name)
    if not safe.strip("._"):
        raise ValueError("a table needs a name")
    return f"{root.rstrip('/')}/{kind}/{safe}"


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def part_hashes(spark: SparkSession, path: str) -> list[dict]:
    """Part files below a folder with length and sha256, hashed by the tasks that read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    inside = F.regexp_replace("path", "^.*/data-[0-9a-f]{32}/", "")
    rows = files.select(inside.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).collect()  # a row for each file
    return sorted((r.asDict() for r in rows), key=lambda r: r["file"])


def manifest(spark: SparkSession, root: str, kind: str, name: str) -> Manifest | None:
    """The newest manifest of a table; None if there is none."""
    at = f"{_folder(root, kind, name)}/manifests"
    if not _exists(spark, at):
        return None
    newest = spark.read.text(at, wholetext=True).orderBy(F.get_json_object("value", "$.version").cast("long").desc()).limit(1).collect()
    if not newest:
        return None
    held = json.loads(newest[0].value)
    return Manifest(**held | {"parts": tuple(held["parts"]), "by": tuple(held["by"])})


def write_table(df: DataFrame, root: str, kind: str, name: str, source: str = "", by: tuple[str, ...] = (), rows_per_file: int = ROWS_PER_FILE) -> tuple[Manifest, bool]:
    """Writes a table unless one with an equal (not empty) signature is there; the manifest, and whether it was written."""
    spark, base = df.sparkSession, _folder(root, kind, name)
    old = manifest(spark, root, kind, name)
    if old is not None and source and old.signature == source and _exists(spark, f"{base}/{old.data}"):
        return old, False
    data = f"data-{uuid.uuid4().hex}"
    out = df.hint("rebalance", *map(F.col, by)) if by else df
    writer = out.write.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).parquet(f"{base}/{data}")
    rows = spark.read.schema(df.schema).parquet(f"{base}/{data}").count()
    new = Manifest(kind, name, data, df.schema.json(), rows, source, tuple(part_hashes(spark, f"{base}/{data}")), by, 1 if old is None else old.version + 1)
    spark.createDataFrame([(new.text(),)], "value string").coalesce(1).write.mode("append").text(f"{base}/manifests")
    return new, True


def changed_parts(spark: SparkSession, root: str, kind: str, name: str) -> list[str]:
    """Part files that are missing, new or different from the manifest."""
    held = manifest(spark, root, kind, name)
    if held is None:
        raise FileNotFoundError(f"no manifest of {kind}/{name}")
    at = f"{_folder(root, kind, name)}/{held.data}"
    now = {p["file"]: p for p in part_hashes(spark, at)} if _exists(spark, at) else {}
    then = {p["file"]: p for p in held.parts}
    return sorted(f for f in now.keys() | then.keys() if now.get(f) != then.get(f))


def read_table(spark: SparkSession, root: str, kind: str, name: str, verify: bool = False) -> DataFrame:
    """The table that the manifest names; with ``verify``, ValueError if a part isn't what was written."""
    held = manifest(spark, root, kind, name)
    if held is None:
        raise FileNotFoundError(f"no manifest of {kind}/{name}")
    if verify and (bad := changed_parts(spark, root, kind, name)):
        raise ValueError(f"parts differ from the manifest: {bad[:5]}")
    schema = T.StructType.fromJson(json.loads(held.columns))
    return spark.read.schema(schema).parquet(f"{_folder(root, kind, name)}/{held.data}").select(*schema.names)


def write_scores(scores: DataFrame, root: str, name: str, source: str = "", time_col: str = "bar_time") -> tuple[Manifest, bool]:
    """Scores of several methods (column method) in folders by method and period; a large period is split into several files."""
    if "method" not in scores.columns:
        raise KeyError("missing fields: ['method']")
    return write_table(with_period(scores, time_col), root, "scores", name, source, ("method", "period"))
