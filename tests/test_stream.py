import datetime

from logsieve.streaming import stream
from tests.helpers import make_log


def write_log(spark, path, rows):
    schema = "query_id bigint, ts timestamp, user_id bigint, dialect string, sql string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_lints_and_windows_close(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    source = str(tmp_path / "log")
    write_log(spark, source, [(1, at(1), 1, "generic", "DELETE FROM t"), (2, at(2), 1, "generic", "SELECT 1"),
                              (3, at(3), 1, "generic", "DELETE FROM t"), (4, at(45), 1, "generic", "DROP TABLE t")])
    log = spark.readStream.schema(make_log(spark, []).schema).parquet(source)
    base = str(tmp_path / "work")
    windows = stream.run_rule_windows(spark, log, base)
    first = [(r.window_start.minute, r.rule_id, r.findings) for r in windows.collect()]
    assert first == [(0, "L002", 2)]
    # a row far behind the watermark is dropped; the open window closes once time moves on
    write_log(spark, source, [(5, at(1), 1, "generic", "DROP TABLE t"), (6, at(59), 1, "generic", "DROP TABLE t")])
    write_log(spark, source, [(7, at(59).replace(hour=3), 1, "generic", "DROP TABLE t")])
    log = spark.readStream.schema(make_log(spark, []).schema).parquet(source)
    windows = stream.run_rule_windows(spark, log, base)
    again = sorted((r.window_start.minute, r.rule_id, r.findings) for r in windows.collect())
    assert again == [(0, "L002", 2), (40, "L007", 1), (50, "L007", 1)]
