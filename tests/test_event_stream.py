"""Events of a stream against the batch fold: photos out of order, late ones, and a restart."""

import random

from pyspark.sql import functions as F

from mediacat.operators import events
from mediacat.streaming.event_groups import ROCKS, event_stream

SCHEMA = "id long, camera string, date_taken long, has_gps boolean, latitude double, longitude double, media_type string"


def photos(n, seed):
    rng, at, rows = random.Random(seed), 1_000_000, []
    for k in range(n):
        at += rng.choice([0, 60, 3000, 7200, 14_400, 14_401, 20_000])
        # One camera takes most photos.
        rows.append((k + 1, rng.choice(["a", "a", "a", "b", "c", None]), at, rng.random() < 0.5, 50.0 + rng.choice([0, 0, 0, 0.1, 0.5]), 8.0, "photo" if rng.random() < 0.9 else "video"))
    return rows


def test_stream_equals_the_batch_with_disorder_and_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rng, rows = random.Random(4), photos(400, 2)
    end = rows[-1][2]
    batches = [rows[k : k + 100] for k in range(0, 400, 100)]
    for k in range(3):  # some photos come a batch late, within the allowed delay
        moved = [r for r in batches[k][60:] if rng.random() < 0.3]
        batches[k] = [r for r in batches[k] if r not in moved]
        batches[k + 1] = [*moved, *batches[k + 1]]
    batches.append([(9001, "a", 5000, False, 0.0, 0.0, "photo")])  # far too late: dropped
    batches += [[(9002 + k, "z", end + 40_000_000 * (k + 1), False, 0.0, 0.0, "photo")] for k in range(2)]  # move the watermark past all
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k, b in enumerate(batches):
        rng.shuffle(b)
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        # Each batch is a run of its own, which ends and starts again from the checkpoint.
        stream = event_stream(spark.readStream.schema(SCHEMA).parquet(str(source)), "camera", "30 days")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120), k
    got = [(r.camera, r.id, r.event) for r in spark.read.schema("camera string, id long, event long").parquet(out).where("id < 9000").collect()]
    whole, want = spark.createDataFrame(rows, SCHEMA), []
    for camera in ("a", "b", "c", None):
        own = whole.where(F.col("camera").eqNullSafe(camera))
        want += [(camera, r.id, r.event) for r in events.event_members(own).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({e for _, _, e in want}) > 20


def test_stream_without_photos(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.createDataFrame([(1, "a", 0, False, 0.0, 0.0, "photo"), (2, "a", 5, False, 0.0, 0.0, "video")], SCHEMA).write.parquet(str(tmp_path / "in"))
    q = event_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "camera").writeStream.format("memory").queryName("no_photos").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("no_photos").isEmpty()
