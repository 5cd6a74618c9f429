import corpus_pipeline as p
from tablewright.llm import decontaminate, neardup, quality, secrets
from tablewright.llm.queries import ORACLES, QUERIES


def test_stages_take_effect(spark, sf_dir, given):
    docs = given("documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4]
    scored = {r.doc_id: r.predicted for r in quality.classify(given("documents"), given("labels")).collect()}
    assert kept[1] == sum(scored.values())
    assert {r.component_id == r.doc_id for r in neardup.near_duplicates(docs).collect()} == {True}
    assert decontaminate.find_leaks(docs, given("benchmark")).isEmpty()
    assert all(r.n_assign + r.n_access + r.n_hex + r.n_novel == 0 for r in secrets.scan_documents(docs).collect())


def test_run(spark, sf_dir):
    rows = p.run(spark, sf_dir)
    assert rows.count() > 0 and "bin_id" in rows.columns


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_twins(spark, sf_dir):
    from compare import connect, difference, oracle_rows, spark_rows

    for name, sql in ORACLES.items():
        assert difference(spark_rows(QUERIES[name](spark, sf_dir)), oracle_rows(connect(sf_dir), sql)) is None


def test_stages_on_odd_rows(spark, sf_dir, odd, table):
    docs = odd
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.schema.names == docs.schema.names, name
        if name == "near_duplicates":  # one of the equal texts; null, empty and blank ones have fingerprint zero
            texts = [r.text for r in out.collect()]
            assert texts.count("alpha beta gamma delta") <= 1 and sum(not (t or "").strip() for t in texts) <= 1
        if name in ("decontamination", "secrets"):  # nothing here is a benchmark item or a secret
            assert out.count() == docs.count()
        docs = out
    pieces = p.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.count() >= docs.count()
    # each stage by itself on all the odd rows, and on none
    for name, stage in p.STAGES:
        assert stage(spark, odd, sf_dir).count() > 0, name
        assert stage(spark, table([]), sf_dir).count() == 0, name
