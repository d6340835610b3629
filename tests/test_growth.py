"""Plans that must not grow faster than their tables: nothing large goes to the driver, no findings are sorted to be counted."""

import re

import pytest
from pyspark.sql import functions as F

from lectern import facts
from lectern.operators import analytics, audits, markdown
from lectern.plans import dims, rules
from lectern.storage import by_documents


@pytest.fixture
def broadcasting(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


FOUND = "doc long, type string, rule string, severity string, wcag string, fix string"


@pytest.mark.parametrize("name", ["folder_patterns", "criteria_across_types"])
def test_documents_of_folders_stay_with_the_tasks(spark, broadcasting, tmp_path, name):
    spark.createDataFrame([(1, "a/b/1.pdf"), (2, "/2.docx"), (3, "3.md")], "doc long, path string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = spark.createDataFrame([(1, "pdf", "R", "1.1.1"), (2, "docx", "R", "1.1.1"), (3, "md", "R", "1.1.1")], "doc long, type string, rule string, wcag string")
    got = getattr(analytics, name)(found, docs)
    assert not re.search(r"BroadcastHashJoin \[doc#", plan(got))
    rows = {tuple(r) for r in got.collect()}
    # a path that begins with a slash lies in two folders without a name
    assert rows == ({("", "R", 4, 4, "systemic"), ("a", "R", 1, 1, "isolated"), ("a/b", "R", 1, 1, "isolated")} if name == "folder_patterns" else {("", "1.1.1", "docx, md, pdf", 4)})


def test_remediation_rows_sort_no_findings(spark):
    rows = [(1, "pdf", "R", "Error", "1.1.1", "t"), (1, "pdf", "R", "Error", "1.1.1", "t"), (2, "docx", "R", "Error", "1.1.1", None), (2, "docx", "R", None, None, None), (None, None, "S", "Info", "2.4.2", None), (3, "md", "S", "Info", "2.4.2", None)]
    got = audits.csv_remediation(spark.createDataFrame(rows, FOUND), 4, dims.tier_dim(spark))
    assert not re.search(r"(Sort|ObjectHash)Aggregate\(keys?=\[[^\]]*doc#", plan(got))
    said = {(r.rule_id, r.severity): (r.file_type, r.affected_files, r.total_instances, r.wcag_criteria, r.fix_steps) for r in got.collect()}
    assert said == {("R", "Error"): ("DOCX, PDF", "2", "3", "1.1.1", "t"), ("R", ""): ("DOCX", "1", "1", "", "manual"), ("S", "Info"): ("MD", "1", "2", "2.4.2", "manual")}


def test_tier_badges_sort_no_findings(spark):
    rule = dims.tier_dim(spark).first()
    rows = [(d, "pdf", rule.rule, "Error", None, None) for d in (1, 1, 2, None)]
    got = audits.tier_badges(spark.createDataFrame(rows, FOUND), dims.tier_dim(spark), 4)
    assert not re.search(r"(Sort|ObjectHash)Aggregate\(keys?=\[[^\]]*doc#", plan(got))
    assert [r.badge.split(": ", 1)[1] for r in got.collect()] == [f"2 of 4 files: {rule.rule}"]


def test_rules_hand_no_fact_table_to_every_task(spark, sf_dir, broadcasting):
    tables = facts.tables(spark, sf_dir, rules.needed(("tags",)))
    with by_documents(spark):
        assert "BroadcastHashJoin [doc_id#" not in plan(rules.findings(spark, tables, ("tags",)))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "1g"


def test_picked_values_are_looked_up(spark):
    case = facts.pick("k + 1", ["it's", None, "", "c"])
    assert "CASE" not in facts.looked_up(case) and all("(CASE (" not in facts.looked_up(sql) for sql in facts._OF_TYPE.values())
    rows = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, -1, -2, -7, None)], "k long")
    for values in (["it's", None, "", "c"], [True, None, False], [0, 7]):
        case = facts.pick("k + 1", values)
        assert [r.a for r in rows.selectExpr(f"{case} AS a").collect()] == [r.a for r in rows.selectExpr(f"{facts.looked_up(case)} AS a").collect()]


def test_tables_follow_from_line_states_alone(spark):
    text = "| a |\n```\n| no |\n```\n| b |\nwords\n\n| c |\n| d |\n"
    state = markdown.line_states(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = markdown.tables(state.select("*", F.lit(1).alias("one")).drop("one"))
    assert [(r.line_no, r.cells) for r in got.orderBy("line_no").collect()] == [(1, ["a"]), (8, ["c"])]
    held = state.localCheckpoint()
    assert "Exchange" not in plan(markdown.tables(held))
