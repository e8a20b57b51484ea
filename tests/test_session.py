"""Sessions, tables, projects, and the catalogue."""

import json

import pytest
from pyspark.sql import functions as F

from estimara import catalogue
from estimara.errors import StatError
from estimara.session import Project, Session


@pytest.fixture
def session(spark):
    rows = [(float(10 + 2 * i + (i % 3)), float(i), float(i % 4), float(i % 2), f"f{i % 5}") for i in range(20)]
    return Session(spark, spark.createDataFrame(rows, "wage double, education double, experience double, female double, firm string"))


def test_commands_and_tables(session, tmp_path):
    session.generate("lw", F.ln("wage"))
    session.regress("wage", ["education"])
    session.regress("lw", ["education", "experience"], vce="robust")
    session.xtreg("wage", ["education"], "firm", model="fe")
    session.glm("logit", "female", ["experience"])
    assert [r.id for r in session.estimates_list().collect()] == ["M1", "M2", "M3", "M4"]
    compared = session.compare("m1", "M2")
    assert compared.terms == ["_cons", "education", "experience"] and compared.to_df(session.spark).count() == 5
    md = session.export_table(f"{tmp_path}/t.md", "M1", "M2")
    assert md.startswith("| Term | M1 | M2 |") and "***" in md and "N = 20, R² = " in md
    assert "M1_coef,M1_se,M1_p" in session.export_table(f"{tmp_path}/t.csv")
    assert r"\_cons" in session.export_table(f"{tmp_path}/t.tex") and "<th>_cons</th>" in session.export_table(f"{tmp_path}/t.html")
    session.note("a remark")
    assert session.notes() == ["a remark"] and "regress" in session.help()
    assert session.profile("firm").columns[0] == "value" and session.profile("wage").columns[0] == "variable"
    assert session.preview(2, 5).count() == 5
    for wrong in (lambda: session.compare("M9"), lambda: session.export_table("x.pdf"), lambda: session.help("nope"), lambda: Session(session.spark).summarize(), lambda: Session(session.spark).compare(), lambda: session.xtreg("wage", ["education"], "firm", model="re")):
        with pytest.raises(StatError):
            wrong()


def test_long_plans_are_cut(session):
    for i in range(35):
        session.replace("wage", F.col("wage") + 1)
    assert session.summarize(["wage"]).first()["min"] == 45.0
    assert "Scan parquet" in session.df._jdf.queryExecution().toString() or "FileScan" in session.df._jdf.queryExecution().toString()


def test_replay_sees_changed_data(session, spark, tmp_path):
    project = session.project = Project.create(f"{tmp_path}/p", "wages")
    project.add_dataset(session.df, "wages")
    session.regress("wage", ["education"], vce="cluster", cluster="firm")
    session.summarize(["education", "wage"])
    session.anova("experience", "firm")
    session.glm("poisson", "experience", ["education"])
    project.add_script("a script", "x")
    assert project.add_note("n") == "note001.md" and len(project.records()) == 4
    again = Project.open(f"{tmp_path}/p")
    assert [r.reproduced for r in again.replay(spark).collect()] == [True] * 4
    again.add_dataset(session.df.withColumn("wage", F.col("wage") + F.when(F.col("education") == 3, 0.5).otherwise(0.0)), "changed")
    assert [r.reproduced for r in again.replay(spark).orderBy("step").collect()] == [False, False, True, True]
    assert json.loads((tmp_path / "p/project.json").read_text())["environment"]["spark"]
    with pytest.raises(StatError):
        Project.create(f"{tmp_path}/p", "again")
    with pytest.raises(StatError):
        Project.open(f"{tmp_path}/none")


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 4
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_an_empty_table_and_a_bad_record(spark, tmp_path):
    data = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(20)], "x double, y double")
    session = Session(spark, data)
    session.keep_if(F.col("x") > 100)
    with pytest.raises(StatError) as e:
        session.summarize()
    assert e.value.kind == "insufficient_data"
    data.write.parquet(f"{tmp_path}/data.parquet")
    project = Project.create(f"{tmp_path}/p", "p")
    project.add_dataset(data, "d")
    session = Session(spark, data, project=project)
    session.regress("y", ["x"])
    project.append(json.dumps({"command": "export_data", "arguments": {"path": f"{tmp_path}/stolen.csv"}}), {})
    project.append(json.dumps({"command": "regress", "arguments": {"nope": 1}}), {})
    rows = project.replay(spark).collect()
    assert [r.reproduced for r in rows] == [True, False, False] and not (tmp_path / "stolen.csv").exists()


def test_changes_are_replayed_from_the_raw_table(session, spark, tmp_path):
    project = session.project = Project.create(f"{tmp_path}/p", "wages")
    project.add_dataset(session.df, "raw")
    session.generate("lw", F.when(F.ln("wage") < float("inf"), F.ln("wage")))
    session.replace("education", F.col("education") + 1, F.col("firm") == "f1")
    session.summarize(["lw"])
    session.drop_if(F.col("female").isNull() | (F.col("experience") > 2.5))
    session.rename("lw", "log_wage")
    session.sort("log_wage", descending=True)
    session.label_variable("log_wage", "logarithm")
    session.keep_vars("log_wage", "education", "firm")
    fit = session.regress("log_wage", ["education"], vce="cluster", cluster="firm")
    assert {c for c, _, _ in fit.checks} >= {"sample_size", "reset_p", "influential_share"} and session.diagnostics(fit).count() == len(fit.checks)
    assert [r["command"] for r in project.replay(spark).where("not reproduced").collect()] == []
    # A record whose arguments were changed is told, and all that rests on it.
    records = project.records()
    i = [r.get("change") for r in records].index("drop_if")
    records[i]["arguments"]["where"] = records[i]["arguments"]["where"].replace("2.5", "1.5")
    changed = Project.create(f"{tmp_path}/q", "changed", project.about["data_uri"])
    changed.store.append("datasets", project.datasets()[0])
    for r in records:
        changed.store.append("registry", r)
    assert [r.reproduced for r in changed.replay(spark).orderBy("step").collect()] == [True] * 3 + [False] * (len(records) - 3)
    with pytest.raises(StatError):
        from pyspark.sql.functions import udf

        session.generate("u", udf(lambda x: x, "double")("log_wage"))


def test_two_sessions_append_at_once(session, spark, tmp_path):
    """No record is lost, and each session's own stay in order."""
    from concurrent.futures import ThreadPoolExecutor

    Project.create(f"{tmp_path}/p", "shared")

    def work(name):
        project = Project.open(f"{tmp_path}/p")
        for i in range(25):
            project.append(json.dumps({"command": "summarize", "arguments": {"names": [name, str(i)]}}), {})
        return project

    with ThreadPoolExecutor(4) as pool:
        projects = list(pool.map(work, "abcd"))
    got = [r["arguments"]["names"] for r in projects[0].records()]
    assert len(got) == 100 and all([int(i) for n, i in got if n == x] == list(range(25)) for x in "abcd")
    assert not [n for n in projects[0].store.names("registry") if not n.endswith(".json")]


def test_pages(session, spark):
    from estimara.sources.paged import PagedTable

    rows = [(float(i * 7919 % 1000), f"t{i % 3}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "v double, place string, file int").repartition(6)
    paged = PagedTable.of(df, [F.col("place").asc(), F.col("v").desc()])
    want = sorted(rows, key=lambda r: (r[1], -r[0]))
    for offset, limit in [(0, 10), (330, 10), (995, 50), (1000, 5), (0, 2000), (499, 1)]:
        assert [tuple(r) for r in paged.page(offset, limit).collect()] == want[offset : offset + limit]
    one = paged.page(500, 20)
    assert len(one.inputFiles()) == 0 or one._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [") >= 1
    plain = PagedTable.of(df)
    assert sorted(tuple(r) for i in range(0, 1000, 90) for r in plain.page(i, 90).collect()) == sorted(rows)
    s = Session(spark, df)
    s.sort("v")
    s.sort("place")
    s.generate("w", F.col("v") + 1)
    assert [tuple(r)[:3] for r in s.preview(100, 30).collect()] == sorted(rows, key=lambda r: (r[1], r[0]))[100:130]
    assert [tuple(r)[:3] for r in s.preview(0, 5).collect()] == sorted(rows, key=lambda r: (r[1], r[0]))[:5]
    assert PagedTable.of(df.limit(0)).page(0, 5).collect() == []
