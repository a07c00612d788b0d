"""Window aggregation: the known cases, a differential test against a small accumulator, and JSON records."""

import json
import random

import pytest
from pyspark.sql import types as T

from tidemark.operators.aggregate import AggSpec, aggregate, aggregate_json
from tidemark.plans.queries import rounded

M = 60 * 10**9


def windows(spark, rows, schema, spec, names):
    df = spark.createDataFrame(rows, "ts_ns long, " + schema)
    return sorted((r.asDict() for r in aggregate(df, spec, names).collect()), key=lambda r: r["window_end"])


@pytest.mark.parametrize(
    ("rows", "default", "want"),
    [
        ([(1, 10.0), (2, 20.0), (3, 30.0)], "avg", [(M, 3, True, 20.0)]),
        ([(1, 10.0), (2, 20.0), (3, 30.0)], "sum", [(M, 3, True, None)]),
        ([(1, 10.0), (2, 20.0), (M + 1, 5.0)], "sum", [(M, 2, False, 30.0), (2 * M, 1, True, None)]),
        ([(1, 1.0), (2, 2.0), (3, 3.0)], "count", [(M, 3, True, 3)]),
        ([(1, 10.0), (2, 20.0), (3, 30.0)], "last", [(M, 3, True, 30.0)]),
        ([(1, 10.0), (2, 20.0), (M + 1, 100.0), (M + 2, 200.0), (2 * M + 1, 50.0)], "avg", [(M, 2, False, 15.0), (2 * M, 2, False, 150.0), (3 * M, 1, True, 50.0)]),
        ([], "avg", []),
        ([(5, 10.0), (M + 5, 20.0)], "avg", [(M, 1, False, 10.0), (2 * M, 1, True, 20.0)]),
        ([(M - 1, 1.0), (M, 2.0)], "max", [(M, 1, False, 1.0), (2 * M, 1, True, 2.0)]),
    ],
)
def test_known_windows(spark, rows, default, want):
    got = windows(spark, rows, "val double", AggSpec.parse("1m", default=default), ["val"])
    assert [(r["window_end"], r["record_count"], r["partial"], r["val"]) for r in got] == want


def test_extremes_text_and_several_functions(spark):
    rows = [(1, 5.0, 3.0), (2, 15.0, 1.0), (3, 8.0, 7.0)]
    got = windows(spark, rows, "high double, low double", AggSpec.parse("1m", "high:max,low:min"), ["high", "low"])
    assert (got[0]["high"], got[0]["low"]) == (15.0, 1.0)
    got = windows(spark, [(1, 10.0, "first"), (2, 20.0, "second")], "val double, name string", AggSpec.parse("1m", default="avg"), ["val", "name"])
    assert (got[0]["val"], got[0]["name"]) == (15.0, "second")
    got = windows(spark, [(1, 10.0), (2, 20.0), (3, 30.0), (M + 1, 100.0)], "val double", AggSpec.parse("1m", default="avg,sum,min,max"), ["val"])
    assert {k: v for k, v in got[0].items() if k.startswith("val")} == {"val_avg": 20.0, "val_sum": 60.0, "val_min": 10.0, "val_max": 30.0}
    rows = [(1, 68.0, 5.0, "a"), (2, 72.0, 3.0, "b"), (3, 70.0, 2.0, "c"), (M + 1, 80.0, 1.0, "d")]
    got = windows(spark, rows, "temp double, count double, name string", AggSpec.parse("1m", "temp:avg+min+max,count:sum", "last"), ["temp", "count", "name"])
    assert [got[0][k] for k in ("temp_avg", "temp_min", "temp_max", "count", "name")] == [70.0, 68.0, 72.0, 10.0, "c"]


def test_specs():
    count = lambda s: len(AggSpec.parse("1m", s).fields)
    assert [count(s) for s in ("", "cpu:avg", "cpu:avg,mem:max", "cpu:avg, mem:max , disk:sum")] == [0, 1, 2, 3]
    assert AggSpec.parse("1m", "temp:avg + sum + min").fields == {"temp": ["avg", "sum", "min"]}
    assert AggSpec.parse("1m", "a:avg,a:max").fields == {"a": ["max"]} and AggSpec.parse("1m", "cpu.pct:avg").fields == {"cpu.pct": ["avg"]}
    for bad in ("bad", "cpu:bogus", "cpu:avg+bogus", ":avg"):
        with pytest.raises(ValueError):
            AggSpec.parse("1m", bad)
    for window, default in (("0s", ""), ("1m", "bogus"), ("-1m", "")):
        with pytest.raises(ValueError):
            AggSpec.parse(window, default=default)


def accumulate(records, width, spec):
    """A direct statement of the rules, one record at a time."""
    out, ends = {}, sorted({(t // width + 1) * width for t, _ in records})
    for end in ends:
        inside = [r for t, r in sorted(records, key=lambda x: x[0]) if (t // width + 1) * width == end]
        partial = end == ends[-1]
        for name in sorted({k for r in inside for k in r}):
            seen = [r[name] for r in inside if name in r]
            number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
            numbers = [float(v) for v in seen if number(v)]
            fns = spec.functions(name, number(seen[0]))
            for fn in fns:
                value = {
                    "sum": None if partial else (sum(numbers) if numbers else None), "avg": sum(numbers) / len(seen) if numbers else None,
                    "max": max(numbers, default=None), "min": min(numbers, default=None), "count": float(len(seen)), "last": None,
                }[fn]
                label = f"{name}_{fn}" if len(fns) > 1 else name
                out[end, label] = (len(inside), partial, None if value is None else round(value, 6), json.dumps(seen[-1]) if fn == "last" else None)
    return out


def test_json_records_equal_the_accumulator(spark):
    rng = random.Random(2)
    pool = [1, 2.5, -3, "x", "7", True, None, 1e3]
    records = []
    for t in sorted(rng.sample(range(1, 40 * M), 300)):
        records.append((t, {k: rng.choice(pool) for k in rng.sample(["a", "b", "c.d", "e"], rng.randint(0, 4))}))
    spec = AggSpec.parse("2m", "b:last,e:count+max", "avg,sum,min")
    rows = [(t, json.dumps(r)) for t, r in records] + [(41 * M, "[1]"), (42 * M, "5"), (43 * M, "no json"), (44 * M, None)]
    got = rounded(aggregate_json(spark.createDataFrame(rows, "ts_ns long, payload string"), spec), "number").collect()
    tidy = lambda v: None if v is None else json.dumps(json.loads(v))
    want = {k: (n, p, v, json.dumps(float(json.loads(j))) if j == "1000.0" else j) for k, (n, p, v, j) in accumulate(records, 2 * M, spec).items()}
    found = {(r.window_end, r.name): (r.record_count, r.partial, r.number, tidy(r.value)) for r in got}
    assert found.keys() == want.keys()
    for k, w in want.items():
        g = found[k]
        assert g[:3] == w[:3] and (g[3] == w[3] or float(g[3]) == float(w[3])), (k, g, w)


def test_null_json_is_an_empty_record_and_dotted_names_work(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "null"), (3, "{}"), (4, '{"a":null}')], "ts_ns long, payload string")
    got = aggregate_json(df, AggSpec.parse("1m", "a:avg+count+last")).collect()
    assert {r.name: (r.record_count, r.number, r.value) for r in got} == {"a_avg": (4, 0.5, None), "a_count": (4, 2.0, None), "a_last": (4, None, "null")}
    schema = T.StructType([T.StructField("ts_ns", T.LongType()), T.StructField("cpu.pct", T.IntegerType())])
    out = aggregate(spark.createDataFrame([(1, 4), (2, 6)], schema), AggSpec.parse("1m", "cpu.pct:avg+max"), ["cpu.pct"]).first()
    assert (out["cpu.pct_avg"], out["cpu.pct_max"]) == (5.0, 6.0)


def test_reserved_names_are_not_lost(spark):
    rows = [(1, 5.0, 1.0, 2.0), (2, 7.0, 3.0, 4.0)]
    got = windows(spark, rows, "partial double, record_count double, window_end double", AggSpec.parse("1m", default="max"), ["partial", "record_count", "window_end"])
    assert got == [{"window_end": M, "record_count": 2, "partial": True, "field_partial": 7.0, "field_record_count": 3.0, "field_window_end": 4.0}]
    with pytest.raises(ValueError):
        windows(spark, [(1, 5.0, 1.0)], "a double, a_max double", AggSpec.parse("1m", "a:avg+max", "max"), ["a", "a_max"])


def test_json_windows_read_the_payload_once(spark, tmp_path):
    spark.createDataFrame([(1, '{"a":1}')], "ts_ns long, payload string").write.parquet(str(tmp_path / "r"))
    out = aggregate_json(spark.read.parquet(str(tmp_path / "r")), AggSpec.parse("1m", default="avg"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange [window_end" in plan and "Join" not in plan


def test_json_window_limit(spark):
    rows = [(k * M + 1, json.dumps({"a": k})) for k in range(5)] + [(5 * M + 1, "{}")]
    got = aggregate_json(spark.createDataFrame(rows, "ts_ns long, payload string"), AggSpec.parse("1m", default="max"), limit=2).collect()
    assert sorted((r.window_end, r.number, r.partial) for r in got) == [(M, 0.0, False), (2 * M, 1.0, False)]
