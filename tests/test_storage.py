"""Sources, sinks and the daily job: rerun laws, rejects, pruning."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidemill.plans import daily
from tidemill.schemas import TABLES
from tidemill.sources import files
from tidemill.sources import ingest as ingest_module
from tidemill.sources.ingest import flatten_json, ingest
from tidemill.sources.tables import read_table

SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("at", T.TimestampNTZType()),
])


def test_ingest_csv(spark, tmp_path, as_rows):
    lines = ["id,name,at", '1,"a, b",2024-01-01T10:00:00', "x,bad id,2024-01-01T10:00:00", "2,,", "3,short",
             "4,c,2024-01-02T00:00:00,extra", "", "5,bad time,yesterday"]
    (tmp_path / "one.csv").write_text("\n".join(lines))
    (tmp_path / "two.csv").write_text("id,name,at\n6,d,2024-01-03T00:00:00\n")
    good, bad = ingest(spark, str(tmp_path), "csv", SCHEMA)
    assert as_rows(good) == sorted(
        [(1, "a, b", datetime(2024, 1, 1, 10)), (2, None, None), (6, "d", datetime(2024, 1, 3))], key=repr
    )
    assert as_rows(bad, "raw") == sorted((x,) for x in (lines[2], lines[4], lines[5], lines[7]))
    assert good.count() + bad.count() == 7
    assert all(r.source_file.endswith("one.csv") for r in bad.collect())


def test_ingest_json(spark, tmp_path, as_rows):
    lines = ['{"id": 1, "name": "a", "at": "2024-01-01T00:00:00"}', '{"id": 2}', '{"id": "x"}', "{broken"]
    (tmp_path / "f.json").write_text("\n".join(lines))
    good, bad = ingest(spark, str(tmp_path), "json", SCHEMA)
    assert as_rows(good, "id") == [(1,), (2,)]
    assert as_rows(bad, "raw") == sorted([('{"id": "x"}',), ("{broken",)])
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path), "xml", SCHEMA)


def test_ingest_parquet(spark, tmp_path):
    spark.createDataFrame([(1, "a", None)], SCHEMA).write.parquet(str(tmp_path / "p"))
    good, bad = ingest(spark, str(tmp_path / "p"), "parquet", SCHEMA)
    assert good.count() == 1 and bad.count() == 0


@pytest.mark.parametrize("split, told", [("128m", 10), ("200b", 1000), ("200b", 0)])
def test_ingest_csv_with_breaks_in_quotes(spark, tmp_path, split, told, monkeypatch):
    monkeypatch.setattr(ingest_module.quoted_records, "__defaults__", (told,))  # pieces told, or sorted
    rng, want, bad = random.Random(5), [], []
    for f in range(3):
        out = ["k,note"]
        for i in range(60):
            k = 1000 * f + i
            note = "\n".join("".join(rng.choices('ab ,"é', k=rng.randint(0, 30))) for _ in range(rng.choice([1, 1, 2, 3, 40])))
            if rng.random() < 0.1:
                out.append(f"x{k},plain")
                bad.append(f"x{k},plain")
            else:
                out.append(f'{k},"' + note.replace('"', '""') + 'z"')
                want.append((k, note + "z"))
        (tmp_path / f"{f}.csv").write_text("\n".join(out) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b" if split != "128m" else "4m")
    try:
        schema = T.StructType.fromDDL("k int, note string")
        good, rejects = ingest_module.ingest(spark, str(tmp_path), "csv", schema, quoted_breaks=True)
        if split != "128m":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted((r.k, r.note) for r in good.collect()) == sorted(want)
        assert sorted(r.raw for r in rejects.collect()) == sorted(bad)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_flatten_json_keeps_bad_text_as_nulls(spark, as_rows):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, "no json"), (3, None)], "id int, j string")
    assert as_rows(flatten_json(df, "j", T.StructType([T.StructField("k", T.IntegerType())]))) == [
        (1, 5),
        (2, None),
        (3, None),
    ]


def test_partitions_prune_and_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "p int, v string")
    files.write_partitioned(df, path, ["p"])
    files.write_partitioned(spark.createDataFrame([(2, "z")], "p int, v string"), path, ["p"], dynamic=True)
    back = spark.read.parquet(path)
    assert {(r.v, r.p) for r in back.collect()} == {("a", 1), ("z", 2)}
    plan = back.filter("p = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_incremental_loads(spark, tmp_path, as_rows):
    path, t0 = str(tmp_path / "t"), datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(hours=i)) for i in range(10)]
    src = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    files.load_incremental(src.filter("id < 4 AND id <> 2"), path, "ts")
    assert files.load_incremental(src, path, "ts").count() == 9  # row 2 came late and is missed
    assert files.load_incremental(src, path, "ts").count() == 9
    window = timedelta(hours=8)
    healed = files.load_incremental(src, path, "ts", keys=["id"], overlap=window)
    assert as_rows(healed) == as_rows(src)
    assert files.load_incremental(src, path, "ts", keys=["id"], overlap=window).count() == 10
    with pytest.raises(ValueError):
        files.load_incremental(src, path, "ts", overlap=window)


def test_compact(spark, tmp_path, as_rows):
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    spark.range(100).repartition(9).write.parquet(small)
    size = spark.read.parquet(small).select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0]
    assert as_rows(files.compact(spark, small, large, size // 2 + 1)) == [(i,) for i in sorted(range(100), key=lambda i: repr((i,)))]
    assert len(spark.read.parquet(large).inputFiles()) == 2


def test_daily_job_can_be_repeated(spark, tmp_path, sf_dir, as_rows):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    events = read_table(spark, sf_dir, "events").filter("ts < TIMESTAMP_NTZ '2024-01-03'")
    star = daily.customer_star(spark, sf_dir)
    daily.land(events, landing)
    daily.land(events.filter("event_type = 'view'"), landing)
    (tmp_path / "landing" / "day=2024-01-01" / "bad.txt").write_text("{broken\n")
    days = ["2024-01-01", "2024-01-02"]
    layers = ("checked", "events", "mart")

    def state():
        return {layer: as_rows(daily.read_layer(spark, out, layer)) for layer in layers}

    daily.run_daily(spark, landing, star, out, days)
    first = state()
    daily.run_daily(spark, landing, star, out, days)
    assert state() == first
    daily.run_daily(spark, landing, star, out, days[1:])
    assert state() == first
    checked = daily.read_layer(spark, out, "checked")
    assert [r.raw for r in checked.filter("outcome = 'malformed'").collect()] == ["{broken"]
    assert checked.filter("outcome = 'rejected' AND array_contains(reasons, 'value_over_one')").count() > 0
    assert checked.count() == events.count() + events.filter("event_type = 'view'").count() + 1
    accepted = events.filter("value > 1")
    assert len(first["events"]) == accepted.count()
    assert daily.read_layer(spark, out, "mart").agg(F.sum("n_events")).first()[0] == accepted.count()
    assert daily.read_layer(spark, out, "events").drop("day").columns == list(TABLES["events"].names)


def test_daily_job_takes_corrections(spark, tmp_path, sf_dir, as_rows):
    """Less, more and no valid input for a day: all layers equal those of a fresh run."""
    star = daily.customer_star(spark, sf_dir)
    users = [r[0] for r in star.select("c_custkey").limit(3).collect()]
    days = ["2024-01-01", "2024-01-02"]
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def rows(*items):
        made = [(i, None if d is None else datetime.fromisoformat(d), users[i % 3], "view", v, "{}") for i, d, v in items]
        return spark.createDataFrame(made, schema)

    one, two = days
    batches = [
        rows((1, one, 5.0), (2, one, 0.5), (3, two, 2.0), (4, None, 9.0)),
        rows((1, one, 0.1), (3, two, 2.0)),
        rows((1, one, 3.0), (5, one, 4.0), (6, one, 7.0), (3, two, 0.0)),
    ]
    for n, batch in enumerate(batches):
        landing, fresh = str(tmp_path / f"landing{n}"), str(tmp_path / f"fresh{n}")
        daily.land(batch, landing, day=one)
        daily.run_daily(spark, landing, star, str(tmp_path / "out"), days)
        daily.run_daily(spark, landing, star, fresh, days)
        for layer in ("checked", "events", "mart"):
            again = daily.read_layer(spark, str(tmp_path / "out"), layer)
            want = daily.read_layer(spark, fresh, layer)
            assert as_rows(again.drop("source_file")) == as_rows(want.drop("source_file"))
    first = daily.read_layer(spark, str(tmp_path / "fresh0"), "checked")
    assert [r.day.isoformat() for r in first.filter("outcome = 'malformed'").collect()] == [one]


def test_rows_without_a_time_are_treated_alike_on_every_load(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    src = spark.createDataFrame([(1, t0), (2, None), (3, t0 + timedelta(1))], "id int, ts timestamp_ntz")
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    for _ in range(2):
        with pytest.raises(Exception, match="has no ts"):
            files.load_incremental(src, path, "ts")
    files.load_incremental(src.filter("id < 3"), other, "ts", undated="skip")
    assert files.load_incremental(src, other, "ts", undated="skip").count() == 2
    with pytest.raises(ValueError):
        files.load_incremental(src, other, "ts", undated="maybe")
