"""Scans, telemetry logs, diffs and streams on temporary files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarrylake.operators import rollup
from quarrylake.sources import events, files, patches
from quarrylake.streaming import telemetry


def tree(root, **texts):
    for name, text in texts.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_scan_leaves_out_the_usual(spark, tmp_path):
    root = tree(tmp_path, **{f"{d}/file.ts": "x" for d in files.IGNORED_DIRS}, **{"src/main.ts": "x", "src/a.min.js": "x", "Cargo.lock": "x", "b.map": "x", "bin.py": b"\x89\x00", ".env.py": "x", "service.ts": "y"})
    assert paths(files.scan_files(spark, root)) == ["service.ts", "src/main.ts"]


def test_scan_rules_and_sizes(spark, tmp_path):
    root = tree(tmp_path, **{"a.generated.ts": "x", "legacy/old.ts": "x", "keep/main.ts": "x", "big.py": "y" * 5000, "small.py": "z"})
    options = files.ScanOptions(max_bytes=1000, ignore_rules=("*.generated.ts", "legacy/", "# note"))
    assert paths(files.scan_files(spark, root, options)) == ["keep/main.ts", "small.py"]
    assert paths(files.scan_files(spark, root, options.with_(languages=("python",)))) == ["small.py"]
    again = options.with_(ignore_rules=("*.ts", "!main.ts"), ignored_files=("small*",))
    assert paths(files.scan_files(spark, root, again)) == ["keep/main.ts"]


EVENTS = [("typescript", 3410200, 492100, 85.57, "mcp_get_symbol_slice"), ("python", 1280000, 215000, 83.2, "mcp_get_symbol_slice"), ("go", 640000, 98000, 84.69, "cli_slice"), ("rust", 390000, 93710, 75.97, "cli_diff")]


def log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    lines = [json.dumps({"timestamp": f"2025-01-01T00:0{k}:00Z", "file_path": "f", "symbol": "s", "language": a, "raw_tokens": r, "sliced_tokens": s, "saved_tokens": r - s, "savings_percentage": p, "source": c}) for k, (a, r, s, p, c) in enumerate(EVENTS)]
    (folder / "a.json").write_text("\n".join([*lines, "", "{broken", json.dumps({"timestamp": "t", "symbol": "s"})]) + "\n")
    return str(folder)


def test_summary(spark, tmp_path):
    e = events.read_events(spark, log(tmp_path))
    t = rollup.totals(e).first()
    assert (t["requests"], t["raw_tokens"], t["sliced_tokens"], t["saved_tokens"], t["compression"]) == (4, 5720200, 898810, 4821390, 84.29)
    assert (t["cost_standard"], t["cost_frontier"], t["cost_economy"]) == (14.46, 72.32, 2.41)
    first = rollup.by_language(e).collect()
    assert len(first) == 4 and (first[0]["language"], first[0]["saved_tokens"]) == ("TypeScript", 2918100)
    assert rollup.by_source(e).count() == 3


def test_missing_and_empty_logs(spark, tmp_path):
    assert events.read_events(spark, str(tmp_path / "none")).count() == 0
    assert tuple(rollup.totals(spark.createDataFrame([], events.SCHEMA)).first())[:5] == (0, 0, 0, 0, 0.0)


def test_append_and_clear(spark, tmp_path):
    path = str(tmp_path / "log2")
    e = events.read_events(spark, log(tmp_path))
    events.append_events(e, path)
    events.append_events(e, path)
    assert events.read_events(spark, path).count() == 8
    events.clear_events(spark, path)
    assert events.read_events(spark, path).count() == 0


def test_changed_lines(spark):
    text = ["diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "@@ -1,0 +2,3 @@", "+a", "@@ -9,2 +12,0 @@", "+++ /dev/null", "@@ -1 +0,0 @@"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(text)], "patch long, line_no long, text string")
    assert sorted((r["file"], r["line"]) for r in patches.changed_lines(lines).collect()) == [("x.py", 2), ("x.py", 3), ("x.py", 4), ("x.py", 12)]


def test_stream_equals_batch(spark, tmp_path):
    folder = log(tmp_path)
    stream = telemetry.running_by_language(telemetry.read_stream(spark, folder))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("by_language").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = rollup.by_language(events.read_events(spark, folder)).select("language", "requests", "saved_tokens")
    assert sorted(map(tuple, spark.table("by_language").collect())) == sorted(map(tuple, batch.collect()))


def test_windows(spark, tmp_path):
    e = telemetry.windowed(telemetry.read_stream(spark, log(tmp_path)), "ts", "2 minutes", None, "1 minute")
    q = e.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 2


def test_stream_sink_appends_each_batch_once(spark, tmp_path):
    source, sink = log(tmp_path), str(tmp_path / "sink")
    for _ in range(2):  # the second run finds nothing new
        q = telemetry.write_log(telemetry.read_stream(spark, source), sink, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert events.read_events(spark, sink).count() == 4
    assert sorted(r["raw_tokens"] for r in events.read_events(spark, sink).collect()) == sorted(e[1] for e in EVENTS)
