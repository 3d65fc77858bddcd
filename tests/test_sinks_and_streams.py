"""Tables with manifests, SQL views and rolling features of a stream."""

import math
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import relations, sinks, views
from tapeloom.streaming import features as S

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/artifacts"


def _rows(spark, n=100, add=0):
    return spark.range(n).select((F.col("id") + add).alias("a"), F.concat(F.lit("2024-0"), F.col("id") % 3 + 1, F.lit("-05")).alias("bar_time"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("method"))


def test_table_is_written_once_per_signature(spark, root):
    one, new = sinks.write_table(_rows(spark), root, "factors", "a b/c", sinks.signature(p=1, q=[2]))
    assert new and one.rows == 100 and sum(p["bytes"] for p in one.parts) > 0 and one.version == 1
    again, new = sinks.write_table(_rows(spark, 5), root, "factors", "a b/c", sinks.signature(q=[2], p=1))
    assert not new and again == one
    other, new = sinks.write_table(_rows(spark, 7), root, "factors", "a b/c", sinks.signature(p=2))
    assert new and other.version == 2 and sinks.read_table(spark, root, "factors", "a b/c", verify=True).count() == 7
    assert sinks.write_table(_rows(spark, 9), root, "factors", "a b/c")[1] and sinks.write_table(_rows(spark, 9), root, "factors", "a b/c")[1]  # without one, always
    assert sorted(sinks.read_table(spark, root, "factors", "a b/c").columns) == ["a", "bar_time", "method"]


def test_changed_parts_are_named(spark, root, tmp_path):
    held, _ = sinks.write_table(_rows(spark).repartition(4), root, "reports", "r", "s")
    parts = sorted((tmp_path / "artifacts/reports/r" / held.data).glob("*.parquet"))
    assert [p["file"] for p in held.parts] == [p.name for p in parts] and not sinks.changed_parts(spark, root, "reports", "r")
    shutil.copy(parts[0], parts[1])
    (parts[1].parent / f".{parts[1].name}.crc").unlink(missing_ok=True)
    parts[2].unlink()
    assert sinks.changed_parts(spark, root, "reports", "r") == [parts[1].name, parts[2].name]
    with pytest.raises(ValueError):
        sinks.read_table(spark, root, "reports", "r", verify=True)


def test_interrupted_writing_leaves_the_old_table(spark, root):
    sinks.write_table(_rows(spark), root, "scores", "s", "one")
    failing = _rows(spark).withColumn("a", F.when(F.col("a") < 99, F.col("a")).otherwise(F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_table(failing, root, "scores", "s", "two")
    assert sinks.read_table(spark, root, "scores", "s", verify=True).count() == 100 and sinks.manifest(spark, root, "scores", "s").signature == "one"


def test_scores_by_method_and_period(spark, root, tmp_path):
    held, _ = sinks.write_scores(_rows(spark), root, "c")
    base = tmp_path / "artifacts/scores/c" / held.data
    assert sorted(p.relative_to(base).as_posix() for p in base.glob("*/*")) == [f"method={m}/period=2024_0{k}" for m in "xy" for k in (1, 2, 3)]
    out = sinks.read_table(spark, root, "scores", "c", verify=True).where("method = 'x' AND period = '2024_02'")
    assert out.count() == 16 and "PartitionFilters: [isnotnull(method" in out._jdf.queryExecution().toString()
    with pytest.raises(KeyError):
        sinks.write_scores(_rows(spark).drop("method"), root, "c")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, root, "scores", "none")
    for kind, name in (("nonsense", "a"), ("scores", "..")):
        with pytest.raises(ValueError):
            sinks.write_table(_rows(spark), root, kind, name)


def test_a_large_period_is_split(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(120_000).select(F.rand(1).alias("v"), F.rand(2).alias("w"), F.when(F.col("id") < 119_000, "2024-01-05").otherwise("2024-02-05").alias("bar_time"))
        relations.write_dataset(rows, f"file://{tmp_path}/d")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p: len(list((Path(tmp_path) / "d" / f"period={p}").glob("*.parquet"))) for p in ("2024_01", "2024_02")}
    assert files["2024_01"] >= 4 and files["2024_02"] == 1
    assert spark.read.parquet(f"file://{tmp_path}/d").count() == 120_000


def test_append_csv(spark, tmp_path):
    for add in (0, 10):
        relations.append_csv(_rows(spark, 3, add), f"file://{tmp_path}/c")
    assert sorted(int(r.a) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/c").collect()) == [0, 1, 2, 10, 11, 12]


def test_latest_version_and_sample(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, None, "d"), (None, 1, "e"), (None, 2, "f")], "k int, v int, x string")
    assert sorted(r.x for r in relations.latest_version(d, ["k"], [F.desc_nulls_last("v")]).collect()) == ["b", "d", "f"]
    rows = spark.range(500).withColumnRenamed("id", "k")
    one, two = (sorted(r.k for r in relations.sampled(rows.repartition(n), 40, ["k"]).collect()) for n in (1, 7))
    assert one == two and len(one) == 40 and one != sorted(r.k for r in relations.sampled(rows, 40, ["k"], 1).collect())


def test_views(spark):
    names = views.register(spark, DATA, ["momentum"])
    assert {"bars_daily", "bars_hourly", "research_panel", "feat_momentum"} <= set(names)
    got = spark.sql("SELECT count(*) AS n, count(DISTINCT instrument_id) AS k FROM feat_momentum").first()
    assert got.n > 0 and got.k > 1
    with pytest.raises(ValueError):
        views.register(spark, DATA, ["nonsense"])
    rows = spark.sql("SELECT * FROM ewm(TABLE(SELECT 'a' AS instrument_id, timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS bar_time, if(id = 2, NULL, CAST(id AS DOUBLE)) AS value FROM range(5)) PARTITION BY instrument_id ORDER BY (bar_time), 1)").collect()
    assert [r.ewm for r in sorted(rows, key=lambda r: r.bar_time)] == pytest.approx([0.0, 0.5, 0.5, (0.25 * 0.5 + 0.5 * 3) / 0.75, (0.5 * (0.25 * 0.5 + 1.5) / 0.75 + 2.0)])


def _run(spark, tmp_path, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.stream_features(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination(300)
    assert q.exception() is None


def test_stream_features_equal_the_batch(spark, tmp_path):
    """Files out of order within the watermark, one tick too late, and a restart in between."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        ticks = [(h * 3600 + m * 600 + k * 7, f"e{k}", float((h * 13 + m * 5 + k * 3) % 29 + 1)) for h in range(14) for m in range(6) for k in range(2) if (h + k) % 5]
        late = [(3600 * h + 1, "e0", 77.0) for h in (4, 8)]  # after ticks one hour and more ahead, within two hours
        dead = [(30, "e0", 999.0)]
        files = [[t for t in ticks if t[0] < 6 * 3600], late[:1] + [t for t in ticks if 6 * 3600 <= t[0] < 9.5 * 3600], dead + late[1:] + [t for t in ticks if t[0] >= 9.5 * 3600], [(40 * 3600, "e0", 1.0)], [(41 * 3600, "e1", 1.0)]]
        make = lambda rows: spark.createDataFrame(rows, "s long, event_type string, value double").select(F.timestamp_seconds("s").alias("ts"), "event_type", "value")
        for i, rows in enumerate(files):
            make(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if i in (1, 4):  # what has come so far is worked off; the second run starts from the checkpoint
                _run(spark, tmp_path, make(rows).schema)
        got = {(r.instrument_id, r.bar_time): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        want = {(r.instrument_id, r.bar_time): r for r in S.batch_features(make([t for rows in files[:3] for t in rows if t not in dead])).collect()}
        assert got.keys() == want.keys() and len(got) > 15
        for k, w in want.items():
            for c in w.asDict():
                a, b = got[k][c], w[c]
                assert a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12)) or (b is None and a != a), (k, c, a, b)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
