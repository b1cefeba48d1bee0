import json
import os
from datetime import datetime

from estatelens.config import default_config
from estatelens.streaming import arrivals_per_window, classify_stream, stream_listing

SCHEMA = "full_path string, size bigint, last_modified string, owner string, source_system string, loaded_at timestamp"


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("full_path", "size", "last_modified", "owner", "source_system", "loaded_at"), r))) for r in rows))


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "1.json", [("\\s\\a\\invoice 1.pdf", 1, "2015-01-01", "x", "E", "2026-01-01 00:10:00"), ("\\s\\Thumbs.db", 1, None, None, "E", "2026-01-01 00:20:00")])
    write(folder, "2.json", [("/s/b/plan.dwg", 1, "2023-01-01", None, "F", "2026-01-01 01:10:00"), (None, 1, None, None, "F", "2026-01-01 01:20:00")])
    out = classify_stream(stream_listing(spark, str(folder), SCHEMA, max_files=1), default_config(), datetime(2024, 1, 1))
    q = out.writeStream.format("memory").queryName("classified").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["filename_stem"], r["inferred_type"], r["retention_status"]) for r in spark.sql("SELECT * FROM classified").collect()}
    assert got == {("invoice 1", "Invoice", "Expired"), ("plan", "Drawing", "Active")}
    batch = classify_stream(spark.read.schema(SCHEMA).json(str(folder)), default_config(), datetime(2024, 1, 1))
    assert {(r["filename_stem"], r["inferred_type"], r["retention_status"]) for r in batch.collect()} == got


def test_windows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "1.json", [("a", 1, None, None, "E", f"2026-01-01 {h:02}:10:00") for h in (0, 0, 1)])
    write(folder, "2.json", [("a", 1, None, None, "E", "2026-01-01 09:10:00")])
    write(folder, "3.json", [("a", 1, None, None, "E", "2026-01-01 10:10:00")])
    write(folder, "4.json", [("late", 1, None, None, "E", "2026-01-01 00:10:00"), ("a", 1, None, None, "E", "2026-01-01 20:10:00")])
    for i in (1, 2, 3, 4):  # the order of arrival
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    q = arrivals_per_window(stream_listing(spark, str(folder), SCHEMA, max_files=1)).writeStream.format("memory").queryName("arrivals").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n_files"] for r in spark.sql("SELECT * FROM arrivals WHERE window_start < TIMESTAMP '2026-01-01 02:00:00'").collect()) == [1, 2]
