"""Readers, SQLite, layers."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tablewright.operators import profile, profile_state
from tablewright.plans import prepare
from tablewright.sources import files, json_array, layers, load_profiles, path_table, quoted_csv, runs, sqlite


@pytest.fixture
def users(tmp_path):
    path = str(tmp_path / "users.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE users (id INTEGER, name TEXT, age INTEGER, score REAL)")
    con.executemany("INSERT INTO users VALUES (?, ?, ?, ?)", [(i, f"n{i}", None if i % 7 == 0 else i, i / 2) for i in range(100)])
    con.execute("CREATE TABLE empty (id INTEGER)")
    con.execute("CREATE TABLE pairs (a TEXT PRIMARY KEY, b TEXT) WITHOUT ROWID")
    con.execute("INSERT INTO pairs VALUES ('x', 'y')")
    con.commit()
    con.close()
    return path


def test_sqlite(spark, users):
    df = sqlite.read_sqlite(spark, users, "users", partitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert df.agg(F.count("*"), F.count("age"), F.sum("score")).first()[:] == (100, 85, 2475.0)
    assert [r["id"] for r in files.page(df, ["id"], 2, 1).collect()] == [1, 2]
    assert sqlite.read_sqlite(spark, users, "empty").count() == 0
    assert sqlite.read_sqlite(spark, users, "pairs").count() == 1
    assert files.read_source(spark, users, table="users").count() == 100


def test_sqlite_refuses(spark, users):
    with pytest.raises(Exception, match="no SQLite file"):
        sqlite.read_sqlite(spark, "/nowhere.db", "users").count()
    with pytest.raises(Exception, match="not a table name"):
        sqlite.read_sqlite(spark, users, "users; DROP TABLE users").count()


def test_csv_query(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('id,name,value\n1,"a, ""b""",100\n2,c,200\n3,d,300\n')
    df = files.read_source(spark, str(path))
    assert df.first()["name"] == 'a, "b"'
    assert files.query(df, "SELECT * FROM _src WHERE value > 150").count() == 2
    assert {r["column"]: r["type"] for r in files.describe(df).collect()} == {"id": "int", "name": "string", "value": "int"}
    with pytest.raises(ValueError):
        files.page(df, ["id"], -1)
    with pytest.raises(ValueError):
        files.page(df, [])


@pytest.mark.parametrize("text", [json.dumps([{"a": 1}, {"a": 2}]), json.dumps([{"a": 1}, {"a": 2}], indent=1), '{"a": 1}\n{"a": 2}\n'])
def test_json_shapes(spark, tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    assert sorted(r["a"] for r in files.read_source(spark, str(path)).collect()) == [1, 2]


def test_bronze(spark, lake):
    df = spark.createDataFrame([(True, 1.5), (False, 2.5)], "flag boolean, ratio double")
    receipt = layers.bronze_append(df, lake, "types", "2026-01-01").first()
    assert (receipt["rows"], receipt["partition"]) == (2, "ingest_date=2026-01-01")
    layers.bronze_append(df, lake, "types", "2026-01-01")
    assert layers.read_partition(spark, lake, "types", "2026-01-01").count() == 4
    assert layers.read_latest(spark, lake, "types").schema == df.schema
    empty = layers.bronze_append(df.where("false"), lake, "none", "2026-01-01").first()
    assert (empty["rows"], empty["path"]) == (0, "")
    assert [r[0] for r in layers.list_sources(spark, lake).collect()] == ["types"]
    with pytest.raises(FileNotFoundError):
        layers.read_partition(spark, lake, "types", "2020-01-01")
    with pytest.raises(FileNotFoundError):
        layers.read_latest(spark, lake, "none")
    with pytest.raises(ValueError):
        layers.bronze_append(df, lake, "../x")


def test_nothing_stored_yet(spark, lake):
    assert layers.list_sources(spark, lake).count() == 0
    assert layers.storage_status(spark, lake).count() == 0
    assert layers.list_gold(spark, lake).count() == 0
    assert layers.gold_read(spark, lake, "x") is None
    with pytest.raises(FileNotFoundError):
        layers.silver_read(spark, lake, "a", "b")


def test_silver_and_gold(spark, lake):
    orders = spark.createDataFrame([("North", 100), ("North", 200), ("South", 300)], "`re gion` string, `rev-enue` int")
    layers.silver_write(orders, lake, "sales", "orders")
    stored = layers.load(spark, lake, "silver:sales/orders")
    assert stored.columns == ["re_gion", "rev_enue"]
    assert [r["domain"] for r in layers.list_domains(spark, lake).collect()] == ["sales"]
    sql = "SELECT re_gion AS region, sum(rev_enue) AS total FROM silver_orders GROUP BY re_gion"
    layers.gold_from_sql(spark, sql, lake, "by_region", {"silver_orders": stored})
    assert sorted(tuple(r) for r in layers.load(spark, lake, "gold:by_region").collect()) == [("North", 300), ("South", 300)]
    layers.silver_write(orders.limit(1), lake, "sales", "orders")
    assert layers.silver_read(spark, lake, "sales", "orders").count() == 1


def test_unfinished_version_is_not_read(spark, lake, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    layers.silver_write(df, lake, "d", "t")
    unfinished = tmp_path / "lake" / "silver" / "d" / "t" / "version=99999999999999"
    unfinished.mkdir(parents=True)
    assert layers.silver_read(spark, lake, "d", "t").count() == 1


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; DELETE FROM x", "SELECT 1 -- x", "INSERT INTO x VALUES (1)", "SHOW TABLES", "WITH a AS (SELECT 1) DELETE FROM a"])
def test_only_select(sql):
    with pytest.raises(ValueError):
        layers.check_select(sql)


def test_with_is_allowed():
    layers.check_select("WITH a AS (SELECT 1 AS x) SELECT * FROM a")


def test_ingest_and_integrate(spark, lake, tmp_path):
    sales = tmp_path / "erp-Sales.csv"
    sales.write_text("customer,amount\n" + "".join(f"c{i},{i}\n" for i in range(250)))
    crm = tmp_path / "crm.csv"
    crm.write_text("customer,tier\nc1,gold\nc2,silver\nzz,gold\n")
    out = prepare.ingest(spark, str(sales), lake)
    assert out["receipt"].first()["rows"] == 250  # every row lands
    assert out["edges"].first()["target"] == "bronze:erp_sales"
    prepare.ingest(spark, str(crm), lake)
    prepare.integrate_to_silver(spark, lake, ["erp_sales", "crm"], "sales", "joined", "join", "customer")
    assert layers.load(spark, lake, "silver:sales/joined").count() == 2
    prepare.integrate_to_silver(spark, lake, ["erp_sales", "crm"], "sales", "all")
    assert layers.load(spark, lake, "silver:sales/all").count() == 253


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_dialects(spark, tmp_path, sep):
    path = tmp_path / "d.csv"
    path.write_text(sep.join(["id", "note", "n"]) + "\n" + sep.join(["1", f'"x\ny{sep}z"', "3"]) + "\n" + sep.join(["2", "plain", "4"]) + "\n")
    assert sorted(map(tuple, files.read_csv(spark, str(path)).collect())) == [(1, f"x\ny{sep}z", 3), (2, "plain", 4)]


def test_csv_cells_without_a_column_are_kept(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a,b\n1,x\n2,z,SURPLUS\n")
    df = files.read_csv(spark, str(path))
    assert df.columns == ["a", "b", "_corrupt_record"]
    assert sorted(r["_corrupt_record"] or "" for r in df.collect()) == ["", "2,z,SURPLUS"]
    assert files.read_csv(spark, str(path), surplus=False).columns == ["a", "b"]


def test_page_after_a_key(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(30)], "a int, b int")
    assert [r["b"] for r in files.page(df, ["a", "b"], 4, after={"a": 2, "b": 7}).collect()] == [8, 9, 10, 11]
    with pytest.raises(ValueError):
        files.page(df, ["a", "b"], 4, after={"a": 2})


def test_a_day_of_bronze_keeps_every_column(spark, lake):
    narrow = spark.createDataFrame([(1,)], "a int")
    wide = spark.createDataFrame([(2, "x", "y")], "a int, b string, ingest_date string")
    one = layers.bronze_append(narrow, lake, "s", "2026-01-01", {"from": "test"}).first()
    two = layers.bronze_append(narrow, lake, "s", "2026-01-01").first()
    assert one["size_bytes"] == two["size_bytes"] and one["metadata"] == {"from": "test"}
    assert [tuple(f) for f in one["schema"]] == [("a", "int")]
    layers.bronze_append(wide, lake, "s", "2026-01-01")
    rows = layers.read_partition(spark, lake, "s", "2026-01-01").select("a", "b", "ingest_date").collect()
    assert sorted(map(tuple, rows)) == [(1, None, None), (1, None, None), (2, "x", "y")]


def test_names_that_clash_and_empty_writes(spark, lake):
    with pytest.raises(ValueError, match="user name"):
        layers.silver_write(spark.createDataFrame([(1, 2)], "`user name` int, `user-name` int"), lake, "d", "t")
    df = spark.createDataFrame([(1,)], "a int")
    layers.gold_write(df, lake, "g")
    assert layers.gold_write(df.where("false"), lake, "g").first()["path"] == ""
    assert layers.gold_read(spark, lake, "g").count() == 1


def test_views_stay_as_they_were(spark):
    spark.range(3).createOrReplaceTempView("_src")
    assert files.query(spark.range(5), "SELECT count(*) AS n FROM _src").first()["n"] == 5
    assert spark.table("_src").count() == 3
    spark.catalog.dropTempView("_src")


def test_scratch_folder_is_named_on_a_cluster():
    from tablewright.session import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: Conf())
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def dirty_csv(path, rows, seed, end="\n"):
    """Cells with line ends, quotes, separators and blanks in one file; gives the number of its records."""
    draw = random.Random(seed)
    parts = ["plain", "a;b", 'q"q', "\n", end, ";", '"', "é", " ", "", "x" * 30, '\n"\n']

    def cell():
        text = "".join(draw.choices(parts, k=draw.randint(0, 5)))
        return '"' + text.replace('"', '""') + '"' if draw.random() < 0.7 or any(c in text for c in ';"\n\r') else text

    lines = ["id;note;more"] + [f"{i};{cell()};{cell()}" + (";surplus" if draw.random() < 0.02 else "") for i in range(rows)]
    if seed % 2:
        lines.insert(3, "")
    path.write_text(end.join(lines) + (end if seed % 3 else ""), encoding="utf-8", newline="")


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_csv_in_ranges(spark, tmp_path, small_ranges, seed):
    folder = tmp_path / "x.csv"
    folder.mkdir()
    for k in range(2):
        dirty_csv(folder / f"{k}.csv", 150, seed + 7 * k, "\r\n" if seed == 2 else "\n")
    path = str(folder)
    of_ranges = quoted_csv.ranges(spark, path).collect()
    assert len(of_ranges) > 10 and any(r["open"] for r in of_ranges) and any(r["odd"] for r in of_ranges)
    shape = "id int, note string, more string, _corrupt_record string"
    whole = spark.read.options(header=True, sep=";", quote='"', escape='"', multiLine=True, columnPruning=False).schema(shape).csv(path)
    ours = files.read_csv(spark, path, "id int, note string, more string", ";", surplus=True)
    clean = lambda df: sorted(((r["id"], r["note"], r["more"], r["_corrupt_record"] is not None) for r in df.collect()), key=str)
    assert clean(ours) == clean(whole) and len(clean(ours)) == 300
    assert ours.rdd.getNumPartitions() > 4


def test_types_of_quoted_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'i,l,d,x,day,ts,b,s,none,big\n1,3000000000,1.5,1e3,2024-01-02,2024-01-02 03:04:05,true,"a\nb",,123456789012345678901\n-2,4,2,.5,2024-12-31,2024-01-02,FALSE,7,,5\n'
    )
    ours = files.read_csv(spark, str(path))
    whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True, inferSchema=True).csv(str(path))
    assert [(f.name, f.dataType) for f in ours.schema] == [(f.name, f.dataType) for f in whole.schema]
    assert sorted(map(str, ours.collect())) == sorted(map(str, whole.collect()))


def test_quoted_csv_edges(spark, tmp_path):
    for k, text in enumerate(['a,b\n1,"x\ny"\n', 'a,b\n1,"x\ny"', 'a,b\r\n\r\n1,"x\r\ny"\r\n', '"a\nb",c\n"1\n2",3\n']):
        path = tmp_path / f"e{k}.csv"
        path.write_text(text, newline="")
        ours = files.read_csv(spark, str(path), multi_line=True)
        whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True, inferSchema=True).csv(str(path))
        assert [c.strip() for c in ours.columns if c != "_corrupt_record"] == [c.strip() for c in whole.columns]
        assert [tuple(r)[:2] for r in ours.collect()] == [tuple(r)[:2] for r in whole.collect()], text


def array_of(n, seed):
    """Objects with nested brackets, braces and quotes in their texts, no two layouts alike."""
    draw = random.Random(seed)
    signs = ["{", "}", "[", "]", '"', "\\", ",", ":", "é", "\n", "\\\\", '\\"', "x" * 20, "}{", '"}', "\\}"]

    def text():
        return "".join(draw.choices(signs, k=draw.randint(0, 6)))

    return [
        {"id": i, "note": text(), text() + "k" if draw.random() < 0.02 else "extra": draw.random(), "deep": {"list": [{"a": text()}, {"a": str(i)}], "more": {"b": draw.random() < 0.5}}}
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_json_array_in_ranges(spark, tmp_path, small_ranges, seed):
    folder = tmp_path / "x.json"
    folder.mkdir()
    shape = "id long, note string, extra double, deep struct<list: array<struct<a: string>>, more: struct<b: boolean>>"
    want = []
    for k in range(2):
        rows = array_of(120, seed + 5 * k)
        want += rows
        text = json.dumps(rows, indent=seed % 3 or None, ensure_ascii=seed % 2 == 0, separators=(",", ":") if seed == 3 else None)
        (folder / f"{k}.json").write_text(text + "\n" * (seed % 2))
    of_ranges = json_array.ranges(spark, str(folder)).collect()
    assert len(of_ranges) > 10 and any(r["depth"] > 2 for r in of_ranges) and any(r["open"] for r in of_ranges)
    ours = files.read_json(spark, str(folder), shape, lines=False)
    got = sorted((r["id"], r["note"], tuple(x["a"] for x in r["deep"]["list"]), r["deep"]["more"]["b"]) for r in ours.collect())
    assert got == sorted((r["id"], r["note"], tuple(x["a"] for x in r["deep"]["list"]), r["deep"]["more"]["b"]) for r in want)
    whole = spark.read.option("multiLine", True).schema(shape).json(str(folder))
    assert sorted(map(str, ours.collect())) == sorted(map(str, whole.collect()))
    assert ours.rdd.getNumPartitions() > 4


def test_schema_of_json_arrays(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"i": 1, "d": 1.5, "m": 1, "s": "x}", "b": true, "n": null, "l": [1, 2], "o": {"q r": 1}},\n {"i": 30000000000, "d": 2, "m": "t", "l": [], "z": [{"a": null}]}]')
    ours = files.read_json(spark, str(path))
    whole = spark.read.option("multiLine", True).json(str(path))
    assert ours.schema == whole.schema
    assert sorted(map(str, ours.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("text", ["[]", " [ ]\n", "[\n]"])
def test_json_arrays_without_objects(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    assert files.read_json(spark, str(path)).collect() == []
    assert files.read_json(spark, str(path), "a int").collect() == []


def test_broken_json_is_kept(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"a": 1}, {"a": oops}, {"a": 3}]')
    got = sorted(((r["a"], r["_corrupt_record"]) for r in files.read_json(spark, str(path)).collect()), key=str)
    assert got == [(1, None), (3, None), (None, '{"a": oops}')]


def test_torn_load_is_not_seen(spark, lake, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    layers.bronze_append(df, lake, "s", "2026-01-01")
    before = layers.bronze_stats(spark, lake).collect()
    # files without a record, a record without its success mark, a day and a source of nothing else
    df.write.parquet(f"{lake}/bronze/s/ingest_date=2026-01-01/load=9")
    (tmp_path / "lake" / "bronze" / "s" / "ingest_date=2026-01-01" / "commit=9").mkdir()
    df.write.parquet(f"{lake}/bronze/s/ingest_date=2026-01-02/load=9")
    df.write.parquet(f"{lake}/bronze/t/ingest_date=2026-01-02/load=9")
    assert layers.read_latest(spark, lake, "s").collect() == df.collect()
    assert layers.bronze_stats(spark, lake).collect() == before
    assert [r[0] for r in layers.list_sources(spark, lake).collect()] == ["s"]
    assert [r[0] for r in layers.list_partitions(spark, lake, "s").collect()] == ["2026-01-01"]
    with pytest.raises(FileNotFoundError):
        layers.read_latest(spark, lake, "t")


def test_record_of_a_load(spark, lake):
    df = spark.createDataFrame([(1, [1.5], {"k": None})], "a int, `b c` array<double>, m map<string,int>")
    receipt = layers.bronze_append(df.repartition(1), lake, "s", "2026-01-01", {"from": "here"}).first()
    record = layers.bronze_loads(spark, lake, "s").first()
    assert (record["rows"], record["files"], record["size_bytes"], record["metadata"]) == (1, 1, receipt["size_bytes"], {"from": "here"})
    assert layers.read_partition(spark, lake, "s", "2026-01-01").schema == df.schema
    assert layers.bronze_loads(spark, lake, "other").count() == 0


def test_clashing_types_of_loads(spark, lake):
    layers.bronze_append(spark.createDataFrame([(1,)], "a int"), lake, "s", "2026-01-01")
    layers.bronze_append(spark.createDataFrame([("x",)], "a string"), lake, "s", "2026-01-01")
    with pytest.raises(ValueError, match="'a' is int in one load and string in another"):
        layers.read_partition(spark, lake, "s", "2026-01-01")


def test_path_table_reads_each_format_in_one_scan(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    spark.range(6).selectExpr("id", "concat('n', id) AS name").repartition(2).write.parquet(at("a.parquet"))
    (tmp_path / "x y.csv").write_text("id,name\n1,one\n2,two\n")
    (tmp_path / "z%20.csv").write_text("id,name\n3,three\n")
    (tmp_path / "other.tsv").write_text("id\tsize\nx\t5\n")
    (tmp_path / "l.jsonl").write_text('{"id": 7, "deep": {"a": 1}}\n')
    (tmp_path / "arr.json").write_text('[{"id": 8},\n {"id": 9}]')
    names = ["a.parquet", "x y.csv", "z%20.csv", "other.tsv", "l.jsonl", "arr.json", "a.parquet"]
    table = spark.createDataFrame([(at(n),) for n in names] + [(None,)], "path string")
    found = path_table.read_paths(table)
    got = sorted((r["source_path"].rsplit("/", 1)[1], r["reader"], str(r["id"]), r["name"]) for r in found.collect())
    want = [("a.parquet", "parquet", str(i), f"n{i}") for i in range(6)]
    want += [("x y.csv", "csv", "1", "one"), ("x y.csv", "csv", "2", "two"), ("z%20.csv", "csv", "3", "three"), ("other.tsv", "csv", "x", None)]
    want += [("l.jsonl", "json", "7", None), ("arr.json", "json", "8", None), ("arr.json", "json", "9", None)]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3] or ""))
    assert dict(found.dtypes)["id"] == "string" and dict(found.dtypes)["size"] == "int"


def test_path_table_refuses_what_it_cannot_scan(spark):
    table = spark.createDataFrame([("https://example.com/a",), ("b.xlsx",)], "path string")
    with pytest.raises(ValueError, match="b.xlsx"):
        path_table.read_paths(table)
    assert path_table.read_paths(table.limit(0)).isEmpty()


def test_runs_are_compared_with_the_run_before(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert runs.read_runs(spark, path).isEmpty()
    row = lambda day, source, n, shape: (f"2026-01-0{day} 00:00:00", source, n, 0, shape, 2, "healthy")
    for batch in ([row(1, "a", 10, "s"), row(1, "b", 5, "s")], [row(3, "a", 8, "t")], [row(2, "a", 12, "s")]):
        made = spark.createDataFrame(batch, runs.RUN_SCHEMA.replace("ts timestamp", "ts string"))
        runs.append_run(made.withColumn("ts", F.col("ts").cast("timestamp")), path)
    (tmp_path / "runs" / "run=0torn").mkdir()
    (tmp_path / "runs" / "run=0torn" / "part-0.parquet").write_text("half")
    history = runs.read_runs(spark, path)
    changes = {(r["source"], r["ts"].day): (r["previous_rows"], r["row_change"], r["schema_changed"]) for r in runs.run_changes(history).collect()}
    assert changes == {("a", 1): (None, None, None), ("a", 2): (10, 2, False), ("a", 3): (12, -4, True), ("b", 1): (None, None, None)}
    as_of = {r["source"]: r["rows"] for r in runs.runs_as_of(history, "2026-01-02 12:00:00").collect()}
    assert as_of == {"a": 12, "b": 5}


def test_row_key_of_parquet_files(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 AS k").repartition(4).write.parquet(str(tmp_path / "t"))
    keyed = files.read_parquet(spark, str(tmp_path / "t"), "at")
    assert keyed.select("at").distinct().count() == 100
    with pytest.raises(ValueError):
        files.read_parquet(spark, str(tmp_path / "t"), "K")


EXACT = ["column", "dtype", "rows", "nulls", "null_pct", "lo", "hi", "lowest", "highest", "longest", "integer", "float", "boolean", "string"]


def mixed_rows(spark, n, seed=0):
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 7 != 0, F.rand(seed) * 100 - 50).alias("x"),
        F.when(F.col("id") % 11 != 0, F.expr("array('12', '1.5', 'true', '', ' word ')")[(F.col("id") % 5).cast("int")]).alias("t"),
        (F.col("id") % 3 == 0).alias("odd name.`b"),
        F.lit(None).cast("string").alias("nothing"),
        F.expr("date_add(DATE '2026-01-01', CAST(id % 40 AS INT))").alias("day"),
    )
    return df


def test_merged_state_is_the_state_of_the_whole(spark, tmp_path):
    mixed_rows(spark, 6000).write.parquet(str(tmp_path / "mixed"))
    df = spark.read.parquet(str(tmp_path / "mixed"))
    parts = [df.where("id < 10"), df.where("id >= 10 AND id < 4000"), df.where("id >= 4000"), df.where("id < 0")]
    states = [profile_state.profile_state(p, str(k)) for k, p in enumerate(parts)]
    inner = profile_state.merged_state(states[2].unionByName(states[3]))  # in two steps
    merged = profile_state.merged_state(states[1].unionByName(inner).unionByName(states[0]))
    whole = profile_state.state_profile(profile_state.profile_state(df)).orderBy("place").collect()
    ours = profile_state.state_profile(merged).orderBy("place").collect()
    assert [[r[c] for c in EXACT] for r in ours] == [[r[c] for c in EXACT] for r in whole]
    assert [r["column"] for r in ours] == df.columns
    plain = {r["column"]: r for r in profile.source_profile(df).collect()}
    assert all((r["rows"], r["nulls"], r["null_pct"], r["dtype"]) == tuple(plain[r["column"]][c] for c in ("rows", "nulls", "null_pct", "dtype")) for r in ours)
    by = {r["column"]: r for r in ours}
    for c in df.columns:
        exact = df.agg(F.count_distinct(F.col(f"`{c.replace('`', '``')}`"))).first()[0]
        assert abs(by[c]["distinct_estimate"] - exact) <= 0.08 * exact
    values = sorted(r["x"] for r in df.select("x").collect() if r["x"] is not None)
    for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        rank = sum(v < by["x"][name] for v in values) / len(values)
        assert abs(rank - q) < 0.01
    assert by["nothing"]["dtype"] == "null" and by["nothing"]["distinct_estimate"] == 0 and by["t"]["q1"] is None


def test_state_of_odd_values(spark):
    df = spark.createDataFrame([(float("nan"), ""), (float("inf"), ""), (-0.0, "2026-01-02"), (None, None), (0.0, "é" * 100)], "x double, t string")
    by = {r["column"]: r for r in profile_state.state_profile(profile_state.profile_state(df)).collect()}
    assert by["x"]["hi"] != by["x"]["hi"] and by["x"]["lo"] == 0.0 and by["x"]["distinct_estimate"] == 3 and by["x"]["median"] == 0.0
    assert by["t"]["distinct_estimate"] == 3 and by["t"]["highest"] == "é" * 64 and by["t"]["longest"] == 100 and by["t"]["dtype"] == "string"
    empty = {r["column"]: r for r in profile_state.state_profile(profile_state.profile_state(df.limit(0))).collect()}
    assert empty["x"]["rows"] == 0 and empty["x"]["null_pct"] is None and empty["x"]["median"] is None and empty["t"]["dtype"] == "null"


def test_profile_reads_new_loads_only(spark, lake, tmp_path):
    first, second = mixed_rows(spark, 300), mixed_rows(spark, 500).drop("x").withColumn("late", F.lit("2026-05-05"))
    layers.bronze_append(first, lake, "s", "2026-01-01")
    assert len(load_profiles.profile_loads(spark, lake, "s")) == 1
    day = next((tmp_path / "lake" / "bronze" / "s").glob("ingest_date=2026-01-01/load=*"))
    for f in day.glob("part-*"):
        f.write_bytes(b"no parquet any more")  # whoever reads the first load again fails
    layers.bronze_append(second, lake, "s", "2026-01-02")
    by = {r["column"]: r for r in load_profiles.source_profile(spark, lake, "s").collect()}
    assert by["x"]["rows"] == 800 and by["x"]["nulls"] == 543 and by["late"]["nulls"] == 300 and by["late"]["dtype"] == "datetime"
    assert load_profiles.profile_loads(spark, lake, "s") == []
    one = {r["column"]: r["rows"] for r in load_profiles.source_profile(spark, lake, "s", "2026-01-02").collect()}
    assert set(one.values()) == {500} and "x" not in one
    changes = {(r["column"], r["previous_rows"]): r["rows"] for r in load_profiles.profile_changes(spark, lake, "s").collect()}
    assert changes[("id", None)] == 300 and changes[("id", 300)] == 500 and changes[("late", None)] == 500
    assert load_profiles.source_profile(spark, lake, "unknown").count() == 0
    # a state whose write was cut short, and one whose load has no record, are not seen
    torn = tmp_path / "lake" / "bronze" / "s" / "ingest_date=2026-01-02" / "profile=x" / "state=y"
    torn.mkdir(parents=True)
    (torn / "_SUCCESS").write_text("")
    assert load_profiles.source_profile(spark, lake, "s").first()["rows"] == 800


def test_types_that_differ_between_loads(spark):
    a = profile_state.profile_state(spark.range(3), "a")
    b = profile_state.profile_state(spark.range(3).selectExpr("CAST(id AS STRING) AS id"), "b")
    with pytest.raises(Exception, match="column id is bigint in one part and string in another"):
        profile_state.merged_state(a.unionByName(b)).collect()
