"""Registered queries against their SQL on tables with rows that the test data lack."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.values import number_text
from tidemark.operators import parts, retention
from tidemark.operators.scans import json_only
from tidemark.plans.queries import ORACLES, QUERIES
from tidemark.sources.lines import envelopes

START = datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar"


def table(folder, name: str, columns: str, rows: list[tuple]) -> str:
    """A folder of one table, as the queries read it."""
    con = duckdb.connect()
    con.sql(f"create table {name} ({columns})")
    con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    con.sql(f"copy {name} to '{folder}/{name}.parquet'")
    return str(folder)


def equals_sql(spark, folder: str, name: str, query: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    got, want = QUERIES[query](spark, folder).toPandas(), con.sql(ORACLES[query]).df()
    columns = sorted(want.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
    return got


def events(micros: list[int], users: list[int] | None = None) -> list[tuple]:
    users = users or [7] * len(micros)
    return [(i, START + timedelta(microseconds=m), u, "click", 1.5, '{"k": 5}') for i, (m, u) in enumerate(zip(micros, users, strict=True))]


def test_rates_between_records_of_one_time(spark, tmp_path):
    """A rise, no change and a fall within no time, and the next record after them."""
    folder = table(tmp_path, "events", EVENTS, events([0, 10, 10, 10, 10, 20], [5, 6, 8, 8, 2, 3]))
    got = equals_sql(spark, folder, "events", "counter_rates").set_index("event_id")["counter_per_sec"]
    assert got[2] == float("inf") and pd.isna(got[3]) and got[4] == 0 and got[5] == 100_000_000


def test_large_rates_round_as_in_sql(spark, tmp_path):
    folder = table(tmp_path, "events", EVENTS, events([k * (k + 1) for k in range(300)], [k * k * 37 % 4001 for k in range(300)]))
    equals_sql(spark, folder, "events", "counter_rates")


def test_tombstones_spare_other_records_of_their_time(spark, tmp_path):
    folder = table(tmp_path, "events", EVENTS, events([0, 1, 2, 3, 4, 4, 4, 5]))
    assert len(equals_sql(spark, folder, "events", "delete_tombstone")) == 7


DOCUMENTS = "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint"


def test_json_with_a_rest_behind_it_is_not_valid(spark, tmp_path):
    texts = ["8294 words", "8294", '{"a":1} x', '{"a":1,"a":[2]} ', "[1] [2]", "1]", "1,2", '"x"', "", None, "12 13", " true", '{"a":', "1" * 1500]
    folder = table(tmp_path, "documents", DOCUMENTS, [(3 * i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = equals_sql(spark, folder, "documents", "scan_json_valid_all")
    assert sorted(got["doc_id"] // 3) == [i for i, t in enumerate(texts) if t in ("8294", '{"a":1,"a":[2]} ', '"x"', " true", "1" * 1500)]


def test_a_text_cannot_close_the_check_around_it(spark):
    rows = [(t,) for t in ('1,"2"]', '1] , [2', "],[", "1,", '"a', "'a'", "NaN", "[1,]", "01", '{"a" 1}', "1 // c")]
    assert json_only(spark.createDataFrame(rows, "payload string")).count() == 0


def test_envelopes_with_a_rest_behind_them_are_refused(spark):
    lines = spark.createDataFrame([('{"timestamp":5,"data":{"v":1}} x',), ('{"timestamp":6,"data":{"v":1}}',)], "value string")
    assert [(r.ts_ns, r.error) for r in envelopes(lines, 1).orderBy("ts_ns").collect()][1:] == [(6, None)] and envelopes(lines, 1).where("error = 'invalid JSON'").count() == 1


def test_no_message_falls_out_of_the_store(spark, tmp_path):
    """More records than a ring of the default 1024 blocks of 4096 bytes holds."""
    con, n = duckdb.connect(), 200_000
    con.sql(f"create table events ({EVENTS})")
    con.sql(f"insert into events select i, timestamp '2024-01-01' + to_milliseconds(i), 1, 'click', 1.5, '{{}}' from range({n}) r(i)")
    con.sql(f"copy events to '{tmp_path}/events.parquet'")
    assert equals_sql(spark, str(tmp_path), "events", "store_messages")["stored"].count() > 1024 * 131


def test_parts_of_payloads_are_cut_by_bytes(spark, monkeypatch):
    """Long payloads in the second half of the keys: tasks carry some 20,000 bytes each and pack as one task does."""
    rows = [(k, "x" * (10 if k <= 1000 else 400 + k % 7), 10 if k <= 1000 else 400 + k % 7) for k in range(1, 2001)]
    df = spark.createDataFrame(rows, "ts_ns long, payload string, size long").repartition(3)
    monkeypatch.setattr(parts, "MOST_PARTS", 64)
    done = retention.packed(df, 512, part_bytes=20_000).withColumn("task", F.spark_partition_id())
    largest = done.groupBy("task").agg(F.sum("size").alias("bytes")).agg(F.count("*"), F.max("bytes")).first()
    assert largest[0] > 15 and largest[1] < 30_000
    places = [(r.block_seq, r.offset) for r in done.orderBy("ts_ns").collect()]
    blocks, offsets, *_ = retention.next_fit(np.array([r[2] for r in rows]) + retention.RECORD_HEADER, 512 - retention.BLOCK_HEADER, -1, 512 - retention.BLOCK_HEADER)
    assert places == list(zip(blocks.tolist(), offsets.tolist(), strict=True))


def test_text_of_a_number_is_made_once(spark):
    """An expression that stands in several branches is computed in each."""
    df = spark.createDataFrame([(0.1 + 0.2,), (-0.0,), (1e21,), (-1.5e-7,), (100.0,), (None,), (float("-inf"),)], "x double")
    shown = df.select(number_text(F.col("x")).alias("shown"))
    assert [r.shown for r in shown.collect()] == ["0.30000000000000004", "-0", "1e+21", "-1.5e-07", "100", None, "-Inf"]
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("format_string") <= 3
