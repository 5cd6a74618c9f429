"""Operators on small fixtures, against plain Python and against invariants."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import hints
from tablewright.operators import clean, govern, integrate, lineage, mask, pages, profile, quality, standardize
from tablewright.operators.joins import attach
from tablewright.operators import order_stats as stats_of
from tablewright.operators.order_stats import modes, order_stats
from tablewright.plans import chain, prepare
from tablewright.sources import files

DIRTY = [
    (1, "张三", "138-0000-1111", "A@X.COM", 100.0, "北京", "2026-01-01"),
    (2, "李四", "139 0000 2222", "b@x.com", 200.0, "上海", "2026/01/02"),
    (2, "李四", "139 0000 2222", "b@x.com", 200.0, "上海", "2026/01/02"),
    (3, None, "13700003333", None, 85000.0, None, "bad"),
    (4, "王五", None, "c@x.com", None, "广州", "20260104"),
    (5, "赵六", "123", "nope", -10.0, "深圳 ", "2026-01-05"),
    (6, "孙七", "13600006666", "d@x.com", 150.0, "北京", "2026-01-06"),
]
DIRTY_SCHEMA = "id int, name string, phone string, email string, amount double, city string, date string"


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(DIRTY, DIRTY_SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- order statistics --------------------------------------------------------

def python_stat(values, a, b, linear):
    s = sorted(values)
    if not linear:
        return s[len(s) * a // b]
    k = (len(s) - 1) * a / b
    f = int(k)
    return s[f] + (k - f) * (s[f + 1] - s[f]) if f + 1 < len(s) else s[f]


@pytest.mark.parametrize("method", ["values", "buckets", "brackets"])
def test_order_stats_are_exact(spark, method):
    rng = random.Random(7)
    columns = {
        "uniform": [rng.uniform(-1e6, 1e6) for _ in range(3000)],
        "third_is_one_value": [42.5] * 1000 + [rng.gauss(0, 1) for _ in range(2000)],
        "wide_range": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)],
        "whole": [float(rng.randint(0, 9)) for _ in range(3000)],
        "close_together": [1.0 + rng.randint(0, 2**30) * 2.0**-52 for _ in range(3000)],
        "with_nulls": [None if rng.random() < 0.4 else rng.random() for _ in range(3000)],
        "empty": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    stats = {"q1": (1, 4, False), "med": (1, 2, False), "q3": (3, 4, False), "l1": (1, 4, True), "l9": (9, 10, True)}
    got = order_stats(df, list(columns), stats, method).first().asDict()
    for i, (name, values) in enumerate(columns.items()):
        known = [v for v in values if v is not None]
        for stat, (a, b, linear) in stats.items():
            want = python_stat(known, a, b, linear) if known else None
            assert got[f"{stat}_{i}"] == (pytest.approx(want, rel=1e-12) if linear and known else want), (name, stat)


@pytest.mark.parametrize("method", ["values", "buckets", "brackets"])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_order_stats_of_few_rows(spark, method, n):
    values = [float(v) for v in (5, 1, 4, 2, 3)[:n]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    stats = {"q1": (1, 4, False), "med": (1, 2, False), "l3": (3, 4, True)}
    got = order_stats(df, ["x"], stats, method).first()
    assert list(got) == [python_stat(values, *s) for s in stats.values()]


@pytest.mark.parametrize("k", [4000, 8])
def test_brackets_that_miss_are_read_again(spark, monkeypatch, k):
    monkeypatch.setattr(stats_of, "_EXACT_BELOW", 10)
    monkeypatch.setattr(stats_of, "_KLL_K", k)
    monkeypatch.setattr(stats_of, "_BRACKET", 4.0)  # parts hold many values
    if k == 8:
        monkeypatch.setattr(stats_of, "_MARGIN", 0.0)  # a coarse sketch and no width: most ranks lie in gaps
    rng = random.Random(11)
    columns = {
        "wide_range": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)],
        "close_together": [1.0 + rng.randint(0, 2**30) * 2.0**-52 for _ in range(3000)],
        "third_is_one_value": [42.5] * 1000 + [rng.gauss(0, 1) for _ in range(2000)],
        "ends": [float("inf")] * 900 + [-float("inf")] * 900 + [rng.random() for _ in range(1200)],
        "no_finite": [float("inf")] * 3000,
        "empty": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    stats = {"q1": (1, 4, False), "med": (1, 2, False), "q9": (9, 10, False)}
    got = order_stats(df, list(columns), stats, "brackets").first().asDict()
    for i, (name, values) in enumerate(columns.items()):
        known = [v for v in values if v is not None]
        for stat, s in stats.items():
            assert got[f"{stat}_{i}"] == (python_stat(known, *s) if known else None), (name, stat)


def test_mode_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([(3.0, 1), (3.0, None), (1.0, 1), (1.0, 2), (9.0, 2)], "a double, b int")
    assert list(modes(df, ["a", "b"]).first()) == [1.0, 1.0]


# ---- cleaning ----------------------------------------------------------------

def test_fill_strategies(dirty):
    amounts = [r[4] for r in DIRTY if r[4] is not None]
    for strategy, want in (
        ("fill_median", sorted(amounts)[len(amounts) // 2]), ("fill_mean", sum(amounts) / len(amounts)), ("fill_mode", 200.0), ("none", None),
    ):
        filled = clean.fill_missing(dirty, strategy)
        assert filled.where("id = 4").first()["amount"] == (want if want is None else pytest.approx(want))
        assert filled.count() == 7


def test_outliers_become_null_and_empty_rows_go(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (2.0,), (1000.0,)], "x double")
    assert rows(clean.null_outliers(df)) == [(1.0,), (2.0,), (2.0,), (3.0,)]
    calm = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert clean.null_outliers(calm).count() == 3  # no outlier: the empty row stays
    assert clean.null_outliers(df, "zscore").count() == 5
    assert clean.drop_empty_rows(calm).count() == 2


def test_full_clean(spark, dirty):
    cleaned = {r["id"]: r for r in prepare.clean(dirty).collect()}
    assert len(cleaned) == 6
    assert cleaned[3]["amount"] is None and cleaned[5]["city"] == "深圳"
    report = {r["op"]: r["n"] for r in prepare.clean_report(dirty).collect()}
    assert report == {
        "rows_before": 7, "rows_after": 6, "rows_removed": 1, "fill_missing": 1, "remove_outliers": 2, "dedup": 1, "normalize_strings": 1,
    }


def test_clean_with_written_stages_gives_the_same(dirty):
    plain = rows(prepare.clean(dirty))
    assert rows(prepare.clean(dirty, prepare.CleanOptions(write_stages=True, method="buckets"))) == plain


def test_clean_and_assess(dirty):
    options = prepare.CleanOptions(semantic=True, text_columns=["name", "phone"], order_by=[F.col("id")], desensitize="mask")
    out = prepare.clean_and_assess(dirty, "crm", "2026-06-01", options)
    data = {r["id"]: r for r in out["data"].collect()}
    assert data[1]["phone"] == "138****1111" and data[2]["date"] == "2026-01-02"
    scores = {r["metric"]: r["score"] for r in out["scores"].collect()}
    assert all(0 <= s <= 100 for s in scores.values())
    assert out["snapshot"].first()["delta"] == -1
    assert any(r["op"] == "desensitize" for r in out["report"].collect())


@pytest.mark.parametrize("dedup", [True, False])
def test_report_counts_rows_that_bounding_empties(spark, dedup):
    some = [(float(i % 5),) for i in range(40)] + [(1e9,), (-1e9,), (1e9,), (None,)]
    df = spark.createDataFrame(some, "_copies double")  # a name of the chain's own
    options = prepare.CleanOptions(missing_strategy="none", dedup=dedup)
    report = {r["op"]: r["n"] for r in prepare.clean_report(df, options).collect()}
    assert report["rows_before"] == 44 and report["remove_outliers"] == 3
    assert report["rows_after"] == prepare.clean(df, options).count() == (5 if dedup else 40)
    assert report.get("dedup") == (35 if dedup else None)


def test_assessed_clean_reads_its_input_for_the_fits_only(spark, dirty, tmp_path):
    dirty.write.parquet(str(tmp_path / "dirty"))
    df = spark.read.parquet(str(tmp_path / "dirty"))
    options = prepare.CleanOptions(semantic=True, text_columns=["name", "phone"], order_by=[F.col("id")])
    out = prepare.clean_and_assess(df, "crm", "2026-06-01", options)
    for part in ("data", "report", "scores", "snapshot"):
        assert "parquet" not in out[part]._jdf.queryExecution().optimizedPlan().toString().lower(), part
    assert rows(out["data"]) == rows(prepare.clean(df, options))
    assert rows(out["report"]) == rows(prepare.clean_report(df, options))


def test_dedup_is_idempotent(dirty):
    once = clean.drop_duplicates(dirty)
    assert rows(clean.drop_duplicates(once)) == rows(once)


def test_near_text_dedup_keeps_first(spark):
    df = spark.createDataFrame([(2, "Acme Ltd"), (1, "ACME, Limited"), (3, "Other"), (4, None), (5, "")], "id int, firm string")
    kept = clean.near_text_dedup(df, ["firm"], [F.col("id")])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4]


def test_no_text_column_no_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "id int, c string")
    assert clean.text_column_names(df) == []
    assert clean.near_text_dedup(df).count() == 2


# ---- masking -----------------------------------------------------------------

PEOPLE = [
    (1, "张三", "13812345678", "zhang@x.com", "11010519491231002X", "6222021234567890123", "北京市朝阳区"),
    (2, "李小四", "13987654321", "li@x.com", "110105194912310021", "6222021234567890124", "广东省深圳市"),
    (3, "张三", "13812345678", None, " ", "", "杭州"),
]
PEOPLE_SCHEMA = "id int, name string, phone string, email string, id_card string, bank_card string, address string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, PEOPLE_SCHEMA)


def test_kinds_by_name(people):
    assert mask.personal_kinds(people) == {
        "name": hints.NAME, "phone": hints.PHONE, "email": hints.EMAIL, "id_card": hints.ID_CARD, "bank_card": hints.BANK_CARD, "address": hints.ADDRESS,
    }
    assert mask.personal_kinds(people, {"name": None, "id": hints.NAME})["id"] == hints.NAME


@pytest.mark.parametrize("strategy", ["mask", "full", "hash", "token", "null"])
def test_masks_hide_the_value(people, strategy):
    masked = {r["id"]: r for r in mask.desensitize(people, strategy, "salt").collect()}
    for row in PEOPLE:
        for name, value in zip(people.columns[1:], row[1:]):
            got = masked[row[0]][name]
            if strategy == "null":
                assert got == ""
            elif value is None or not value.strip():
                assert got == value
            else:
                assert got != value
    assert masked[1]["phone"] == masked[3]["phone"]  # equal values stay equal


def test_tokens_number_all_values_once(spark):
    df = spark.createDataFrame([(f"n{i % 50}", f"1380000{i % 30:04d}") for i in range(300)], "name string, phone string")
    kinds = mask.personal_kinds(df)
    tokens = mask.token_dictionary(df, kinds).orderBy("kind", "value").collect()
    assert [int(t["token"].split("_")[1]) for t in tokens] == list(range(1, 81))
    small = mask.tokenize(df, kinds)
    large = mask.tokenize(df, kinds, broadcast_bytes=0)
    assert rows(small) == rows(large)
    assert small.distinct().count() == df.distinct().count()


def test_mask_log_without_personal_columns(spark):
    df = spark.createDataFrame([("x", 1)], "product string, price int")
    assert rows(mask.mask_log(df)) == [("desensitize", "*", "detected", 0), ("desensitize", "*", "masked", 0)]
    assert mask.personal_columns(df).count() == 0


# ---- integration -------------------------------------------------------------

@pytest.fixture(scope="module")
def sources(spark):
    a = spark.createDataFrame([(1, "a", "n"), (2, "b", "s"), (3, "c", "e")], "cust_id int, name string, region string")
    b = spark.createDataFrame([(1, "p1", "gold"), (2, "p2", "silver"), (4, "p4", "gold")], "cust_id int, phone string, tier string")
    return a, b


def test_union_join_dedup_counts(sources):
    a, b = sources
    assert integrate.union_all([a, b]).count() == 6
    assert integrate.join_sources(a, b, "cust_id").count() == 2
    assert integrate.integrate({"a": a, "b": b}, "union", dedup_keys=["cust_id"]).count() == 4
    assert integrate.join_sources(a, b, "absent").count() == 6
    with pytest.raises(ValueError):
        integrate.integrate({"a": a}, "enrich", "cust_id")


def test_join_takes_last_right_row_and_null_keys_match(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (1, "z")], "k int, l string")
    right = spark.createDataFrame([("1", 1, "old"), ("1", 2, "new"), (None, 1, "null")], "k string, at int, r string")
    got = rows(integrate.join_sources(left, right, "k", [F.col("at")]).select("k", "l", "r"))
    assert got == sorted([("1", "x", "new"), ("1", "z", "new"), (None, "y", "null")], key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_any_other(spark, how):
    # one key holds a third of the left rows, null another share
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 900).alias("k"), "id"
    )
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.union(spark.sql("SELECT CAST(NULL AS BIGINT), -1L"))
    at = {r.k: r.v for r in right.collect()}
    want = [(r.k, r.id, at.get(r.k)) for r in left.collect() if how == "left" or r.k in at]
    assert rows(attach(left, right, "k", how)) == sorted(want, key=repr)


# ---- scores, grades, governance ----------------------------------------------

def test_levels(spark):
    df = spark.createDataFrame([(v,) for v in (96.0, 88.0, 75.0, 55.0, 30.0)], "s double")
    got = [r[0] for r in df.select(quality.maturity_level(F.col("s"))).collect()]
    assert got == ["优化级(5)", "量化管理级(4)", "稳健级(3)", "受管理级(2)", "初始级(1)"]


def test_quality_scores(dirty):
    got = {r["metric"]: r["score"] for r in quality.quality_scores(dirty, "2026-06-01").collect()}
    assert got["completeness"] == round((1 - 5 / 49) * 100, 1)
    assert got["uniqueness"] == round((1 - 1 / 7) * 100, 1)
    assert got["timeliness"] == round(6 / 7 * 100, 1)
    assert got["validity"] == round((2 + 5) / 14 * 100, 1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DIRTY_SCHEMA)
    assert quality.quality_scores(empty, "2026-06-01").where("metric = 'completeness'").first()["score"] is None
    assert profile.column_profile(empty).count() == 7
    assert profile.summary(empty).count() == 7
    assert quality.repair_tiers(empty).count() == 0
    assert standardize.format_issues(empty).count() == 0
    assert govern.audit(empty).count() == 0
    assert prepare.clean(empty).count() == 0
    assert prepare.clean_report(empty).count() == 7


def test_labels(spark):
    df = spark.createDataFrame([(True, 1.5, "2026-01-01", "x", None)], "flag boolean, ratio double, day string, s string, none int")
    assert rows(profile.dtype_labels(df)) == [("day", "datetime"), ("flag", "boolean"), ("none", "null"), ("ratio", "float"), ("s", "string")]


def test_standardise_fixture(spark):
    df = spark.createDataFrame(
        [("A1", "c", "138-0000-1111", 10, "2026-01-01", "ok"), ("A2", "d", "123", 20, "2026/02/20", "ok"), ("A3", "e", "13900002222", 30, "someday", "no")],
        "order_id string, customer string, phone string, amount int, create_date string, status string",
    )
    classes = {r["column"]: r["label"] for r in standardize.field_classes(df).collect()}
    assert (classes["order_id"], classes["amount"], classes["create_date"]) == ("标识类", "金额类", "时间类")
    assert {r["column"]: r["label"] for r in standardize.field_grades(df).collect()}["phone"] == "重要数据"
    assert {r["column"]: r["n"] for r in standardize.format_issues(df).collect()} == {"phone": 1, "create_date": 1}
    assert standardize.alignment_score(df).first()["score"] == 90.0
    assert standardize.industry(df, hint="金融").first()["standard"].startswith("JR/T")


def test_contract_and_sensitivity(people):
    assert {(r["column"], r["rule"]): r["n"] for r in govern.check_contract(people).collect()} == {
        ("id", "unique"): 0, ("id_card", "unique"): 0, ("phone", hints.CONTRACT_PHONE_RULE): 0,
    }
    labels = {r["column"]: r["label"] for r in govern.sensitivity(people).collect()}
    assert labels == {
        "id": "safe", "name": "safe", "phone": "medium_risk", "email": "medium_risk", "id_card": "high_risk", "bank_card": "safe", "address": "safe",
    }


def test_asset_grade(spark):
    df = spark.createDataFrame([(v,) for v in (90.0, 75.0, 60.0, 40.0, 39.9)], "s double")
    assert [r[0][0] for r in df.select(govern.asset_grade(F.col("s"))).collect()] == list("ABCDF")


# ---- lineage -----------------------------------------------------------------

@pytest.fixture(scope="module")
def edges(spark):
    pairs = [("bronze:a", "silver:b/t", "clean", 1), ("silver:b/t", "gold:c", "aggregate", 2), ("bronze:z", "silver:b/t", "integrate", 3), ("bronze:a", "silver:b/t", "clean", 4)]
    df = spark.createDataFrame(pairs, "source string, target string, operation string, at int")
    return lineage.table_edges(df.withColumn("ts", F.timestamp_seconds("at")).drop("at"))


def test_path_and_chart(spark, edges):
    assert lineage.full_path(edges, "gold:c").first()["path"] == "bronze:a → silver:b/t → gold:c"
    chart = lineage.mermaid_text(edges, "gold:c")
    assert chart.splitlines()[2] == "    silver_b_t[silver:b/t] -->|aggregat| gold_c[gold:c]"
    assert {r["metric"]: r["n"] for r in lineage.stats(edges, edges).collect()}["tables"] == 4


def test_cycle_and_long_paths_stop(spark):
    chain_edges = spark.range(1, 40).select(
        F.concat(F.lit("t"), F.col("id") - 1).alias("source"), F.concat(F.lit("t"), "id").alias("target"),
        F.lit("op").alias("operation"), F.lit("2026-01-01").cast("timestamp").alias("ts"),
    )
    tables = chain_edges.select(F.col("target").alias("table"))
    small = rows(lineage.full_paths(chain_edges, tables))
    assert max(r[2] for r in small) == 11
    assert {r[0]: r[3] for r in small} == {f"t{i}": i <= 10 for i in range(1, 40)}
    whole = {r[0]: (r[2], r[3]) for r in rows(lineage.full_paths(chain_edges, tables, 100))}
    assert whole == {f"t{i}": (i + 1, True) for i in range(1, 40)}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string").selectExpr("*", "'op' AS operation", "current_timestamp() AS ts")
    cut = lineage.full_path(loop, "a").first()
    assert cut["nodes"] == 11 and not cut["complete"]
    assert lineage.full_path(loop, "x").first()["path"] == "x"


def _chain(spark, pairs):
    return spark.createDataFrame([(s, t, "op", 0) for s, t in pairs], "source string, target string, operation string, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")


@pytest.mark.parametrize("most, window", [(1, 16), (2, 16), (3, 16), (5, 16), (9, 16), (10, 16), (7, 2), (10, 4), (11, 1), (40, 4)])
def test_paths_of_every_limit(spark, most, window, monkeypatch):
    monkeypatch.setattr(lineage, "WINDOW", window)
    pairs = [(f"t{i - 1}", f"t{i}") for i in range(1, 12)] + [("t3", "u"), ("a", "b"), ("b", "a"), ("b", "c"), (None, "n"), ("n", "m"), ("x", None)]
    up = {t: s for s, t in pairs if t is not None}

    def walked(table):
        path = [table]
        while len(path) < most and path[0] in up:
            path.insert(0, up[path[0]])
        return (table, " → ".join(p for p in path if p is not None), len(path), path[0] not in up)

    tables = [*up, "t5", "t5", "nowhere", None]
    got = lineage.full_paths(_chain(spark, pairs), spark.createDataFrame([(t,) for t in tables], "table string"), most)
    assert sorted(rows(got), key=repr) == sorted(map(walked, tables), key=repr)


def test_ended_paths_are_not_shuffled_again(spark):
    paths = lineage.full_paths(_chain(spark, [(f"t{i - 1}", f"t{i}") for i in range(1, 12)]), spark.range(12).selectExpr("concat('t', id) AS table"), 64)
    assert paths.count() == 12
    assert paths._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2


# ---- pages -------------------------------------------------------------------

PRODUCTS = """<html><body><div class="item big"><h2>One</h2><span class="price">10</span></div>
<div class="item"><h2>Two &amp; more</h2><span class="price">20</span><a href="/x">go</a></div><script>var h2 = "<h2>No</h2>";</script></body></html>"""


def test_extract_by_position_and_container(spark):
    df = spark.createDataFrame([(1, PRODUCTS)], "page_id int, html string")
    flat = [{"name": "title", "selector": "h2"}, {"name": "price", "selector": ".price"}, {"name": "link", "selector": "a", "attr": "href"}]
    assert rows(pages.extract_rows(df, flat).select("title", "price", "link")) == [("One", "10", "/x"), ("Two & more", "20", "")]
    boxed = [{"name": "title", "container": "div.item", "selector": "h2"}, *flat[1:]]
    assert rows(pages.extract_rows(df, boxed).select("title", "price", "link")) == [("One", "10", ""), ("Two & more", "20", "/x")]
    with pytest.raises(Exception, match="selector"):
        pages.extract_rows(df, [{"name": "x", "selector": "a > b"}]).collect()


def test_text_lines(spark):
    page = "<!DOCTYPE html><body><h1>Title</h1><!-- no --><p>Content\n here<br>more</p><style>p{}</style></body>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    assert [r["content"] for r in pages.text_lines(df).orderBy("line").collect()] == ["Title", "Content", "here", "more"]
    assert pages.crawl_tally(df).first().asDict() == {"total_pages": 3, "pages_ok": 1, "pages_fail": 2, "total_rows": 4}


def test_paged_urls(spark):
    df = spark.createDataFrame([("https://x.com/l?page={page}",), ("https://x.com/l",), ("https://x.com/l?a=1",)], "url string")
    got = [(r["url"][13:], r["page_url"][13:]) for r in pages.paged_urls(df, start=1, end=2).orderBy("url", "page_number").collect()]
    assert got == [
        ("/l", "/l?page=1"), ("/l", "/l?page=2"), ("/l?a=1", "/l?a=1&page=1"), ("/l?a=1", "/l?a=1&page=2"),
        ("/l?page={page}", "/l?page=1"), ("/l?page={page}", "/l?page=2"),
    ]


def test_payload_shapes(spark):
    payloads = ['{"data": 5, "items": [{"a": 1, "b": {"c": 2}}]}', '[{"a": 3}, 4]', '{"a": "x"}', "[]", "not json"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = {(r["i"], r["row"]): dict(r["record"]) for r in pages.payload_rows(df, "p").collect()}
    assert got[(0, 0)] == {"a": "1", "b": '{"c":2}'}
    assert got[(1, 0)] == {"a": "3"} and got[(1, 1)] == {"value": "4"}
    assert got[(2, 0)] == {"a": "x"}
    assert not any(i == 3 for i, _ in got)


# ---- chain -------------------------------------------------------------------

def test_chain(spark):
    df = spark.createDataFrame([(5,)], "n int")

    def fail(d):
        raise RuntimeError("no")

    steps = {"double": lambda d: d.selectExpr("n * 2 AS n"), "add_ten": lambda d: d.selectExpr("n + 10 AS n"), "fail": fail}
    assert chain.run_chain(df, ["double", "add_ten"], steps).first()["n"] == 20
    with pytest.raises(chain.ChainError) as e:
        chain.run_chain(df, ["double", "fail", "add_ten"], steps)
    assert (e.value.step, e.value.done) == ("fail", ["double"])
    with pytest.raises(chain.ChainError, match="unknown"):
        chain.run_chain(df, ["nothing"], steps)


def test_many_containers_take_linear_time():
    import time

    from tablewright.functions import html

    rules = [{"name": "a", "container": "li", "selector": "b.x", "attr": "text"}, {"name": "b", "selector": "ul b", "attr": "text"}]
    page = "<ul>" + "".join(f"<li><i>n</i><b class='x y'>{i}</b></li>" for i in range(4000)) + "</ul>"
    start = time.perf_counter()
    got = html.extract(page, rules)
    assert got == [[str(i), str(i)] for i in range(4000)]
    assert time.perf_counter() - start < 1.5


def test_plain_tags_are_read_as_any_others():
    from html.parser import HTMLParser

    from tablewright.functions import html

    class General(html.Page):
        parse_starttag = HTMLParser.parse_starttag

    def content(page):
        return [(e.tag, e.attrs, e.parent.at, e.first, e.end, e.at, e.last) for e in page.elements], page.texts and [t for t, _ in page.texts], page.lines()

    odd = ["<P CLASS='q'>a&lt;b<br/>c<img src=\"&amp;\" /></p x>d", '<i a="1"b="2">x<i a = "1">y</ i>', "<p\x0bclass=\"a b\">x</p><p", '<script>"<b>"</script><b c="">t', '<a href="x', "a<b<c></b><!-- <p> --><p>&am"]
    for page in [PRODUCTS, PRODUCTS[:150], *odd, "".join(odd)]:
        assert content(html.Page(page)) == content(General(page))


@pytest.mark.parametrize("of", [lambda df: pages.text_lines(df), lambda df: pages.extract_rows(df, [{"name": "a", "container": "p", "selector": "a", "attr": "href"}])])
def test_a_page_is_parsed_once(spark, of):
    df = of(spark.createDataFrame([(1, PRODUCTS), (2, None), (3, "")], "page_id int, html string"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_pages_are_parsed_in_portions():
    import pyarrow as pa

    at_once = list(pages._parsed(lambda p: [p or "none"], pa.list_(pa.string()))([pa.array(["x" * 300_000] * 8 + [None, "y" * 3_000_000] + ["z"] * 600)]))
    assert [v[0] for part in at_once for v in part.to_pylist()] == ["x" * 300_000] * 8 + ["none", "y" * 3_000_000] + ["z"] * 600
    assert all(len(part) <= 256 and (len(part) == 1 or sum(len(v[0]) for v in part.to_pylist()) <= 1 << 20) for part in at_once)


# ---- cleaning keeps types ----------------------------------------------------

def test_clean_keeps_wide_numbers(spark):
    big = 2**53
    df = spark.createDataFrame(
        [(big, "12345678901234567890.12", 1, 1.5), (big + 1, "12345678901234567890.13", None, None), (big + 2, None, 2, 2.5)], "id bigint, d string, i int, x double"
    ).withColumn("d", F.col("d").cast("decimal(38,2)"))
    for options in (prepare.CleanOptions(), prepare.CleanOptions(missing_strategy="none", outlier_method="none")):
        out = prepare.clean(df, options)
        assert out.count() == 3 and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        assert sorted(r["id"] for r in out.collect()) == [big, big + 1, big + 2]
    assert rows(prepare.clean(df, prepare.CleanOptions(missing_strategy="none", outlier_method="none"))) == rows(df)
    filled = clean.fill_missing(df, "fill_median")
    assert {str(r["d"]) for r in filled.collect()} <= {"12345678901234567890.12", "12345678901234567890.13"}


def test_mean_widens_only_where_it_must(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 3, 2), (None, None, 3)], "odd int, even int, full int")
    out = clean.fill_missing(df, "fill_mean")
    assert [f.dataType.simpleString() for f in out.schema] == ["double", "int", "int"]
    assert rows(out)[-1] == (2.0, 3, 2) and (1.5, 2, 3) in rows(out)


def test_three_sources_join(spark):
    a, b, c = (spark.createDataFrame([(1, n), (2, n)], f"k int, {n} string") for n in "abc")
    joined = integrate.integrate({"a": a, "b": b.where("k = 1"), "c": c}, "join", "k")
    assert rows(joined.select("k", "a", "b", "c")) == [(1, "a", "b", "c")]
    enriched = integrate.integrate({"a": a, "b": b.where("k = 1"), "c": c}, "enrich", "k", how="left")
    assert rows(enriched.select("k", "a", "b", "c")) == [(1, "a", "b", "c"), (2, "a", None, "c")]


def test_near_text_dedup_by_row_key(spark):
    df = spark.createDataFrame([(3, "Big Limited"), (1, "big ltd!"), (2, "other")], "id int, name string")
    assert rows(clean.near_text_dedup(df, ["name"], row_key="id")) == [(1, "big ltd!"), (2, "other")]
    plan = clean.near_text_dedup(df, ["name"], row_key="id")._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan


def test_clean_by_row_key(spark):
    rows = [(k, f"Text number {k % 7} !", f"user{k % 5}@mail.com", float(k % 9)) for k in range(200)] + [(10**9, "Text number 3 !", None, 2.0)]
    df = spark.createDataFrame(rows, "id long, note string, email string, x double")
    plain = prepare.CleanOptions(semantic=True, text_columns=["note"], order_by=[F.col("id")], outlier_method="none", desensitize="token", overrides={"id": None})
    keyed = prepare.CleanOptions(semantic=True, text_columns=["note"], row_key="id", desensitize="token", overrides={"id": None})
    got = prepare.clean(df, keyed)
    # the key is no number to bound, though one of them lies far outside
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, prepare.clean(df, plain).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_tokens_by_row_key(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"user{k % 5}@mail.com") for k in range(40)], "id long, email string")
    want = sorted(map(tuple, mask.desensitize(df, "token", overrides={"id": None}).collect()))
    monkeypatch.setattr(mask, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(mask.tokenize, "__defaults__", (0, None))
    assert sorted(map(tuple, mask.desensitize(df, "token", overrides={"id": None}, row_key="id").collect())) == want


def test_integration_by_row_key_groups_keys_only(spark, tmp_path):
    spark.range(60).selectExpr("CAST(id % 9 AS STRING) AS k", "id AS n", "repeat('x', 50) AS note").write.parquet(str(tmp_path / "a"))
    spark.range(60, 90).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 12 AS STRING) END AS k", "id AS n").write.parquet(str(tmp_path / "b"))
    a, b = (files.read_parquet(spark, str(tmp_path / f), "at") for f in "ab")
    order = [F.col("n")]
    for strategy, how in (("union", "inner"), ("join", "inner"), ("join", "left"), ("join", "outer")):
        plain = integrate.integrate({"a": a, "b": b}, strategy, "k", ["k"], order, how)
        keyed = integrate.integrate({"a": a, "b": b}, strategy, "k", ["k"], order, how, "at")
        assert rows(keyed) == rows(plain)
        grouped = [line for line in keyed._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line]
        assert grouped and not any("note" in line for line in grouped) or how == "outer"
    with pytest.raises(ValueError):
        integrate.integrate({"a": a, "b": b.drop("at")}, "union", row_key="at")


def test_payload_records_take_every_key_and_type(spark):
    texts = [
        (1, '{"data": [{"a": 1, "b": "x"}, {"a": 2.5, "c": {"d": [1, 2]}}, null]}'), (2, '[{"a": 3, "e": true}, 7]'),
        (3, '{"a": null, "b": 5}'), (4, "no json"), (5, None), (6, "[]"), (7, '"bare"'),
    ]
    found = pages.payload_records(spark.createDataFrame(texts, "id int, payload string"), "payload")
    kinds = dict((f.name, f.dataType.simpleString()) for f in found.schema["record"].dataType)
    assert kinds == {"a": "double", "b": "string", "c": "struct<d:array<bigint>>", "e": "boolean", "value": "string"}
    got = {(r["id"], r["row"]): r["record"].asDict(True) for r in found.collect()}
    none = dict.fromkeys(kinds)
    assert got == {
        (1, 0): {**none, "a": 1.0, "b": "x"}, (1, 1): {**none, "a": 2.5, "c": {"d": [1, 2]}}, (2, 0): {**none, "a": 3.0, "e": True},
        (2, 1): {**none, "value": "7"}, (3, 0): {**none, "b": "5"}, (7, 0): {**none, "value": "bare"},
    }
    assert pages.payload_records(spark.createDataFrame(texts[3:6], "id int, payload string"), "payload").isEmpty()
    with pytest.raises(ValueError):
        pages.payload_records(spark.createDataFrame([('{"a": 1, "A": 2}',)], "payload string"), "payload")
