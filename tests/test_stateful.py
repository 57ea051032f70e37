"""Appends as a stateful stream, against appends one by one."""

from __future__ import annotations

import random

from corvane.streaming import stateful

KIND = "tenant_id string, stream_id string, op_seq long, id string, data string, expected long"


def test_appends_over_batches(spark, tmp_path):
    r = random.Random(1)
    rows = [("t", r.choice("abc"), i, f"e{i}", "{}", r.choice([None, None, 0, 1, 2, 3, 5])) for i in range(60)]
    versions, want = {"a": 2}, {}
    for _, s, i, _, _, e in rows:
        now = versions.get(s, 0)
        ok = e is None or e == now
        versions[s] = now + ok
        want[i] = now + 1 if ok else None, None if ok else ("stream exists" if e == 0 else "wrong version")
    for k in range(3):  # three files, three micro-batches
        part = rows[k * 20 : k * 20 + 20]
        r.shuffle(part)
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start = spark.createDataFrame([("t", "a", 2), ("t", "zz", 9)], "tenant_id string, stream_id string, version long")
    out = stateful.judged(source, start)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 2
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {x["op_seq"]: (x["version"], x["reason"]) for x in got.collect()} == want
    assert stateful.accepted(got).count() + stateful.refused(got).count() == 60
    assert "reason" not in stateful.accepted(got).columns
