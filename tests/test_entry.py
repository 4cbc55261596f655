import pathlib
import re

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_only_the_entry_module_knows_the_corpus_operators():
    for path in (ROOT / "tandemframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), path


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50 and {r.call_rule for r in rows} <= {"homozygous", "heterozygous", "two_called_three_present_review", "triallelic_review", "no_data"}


def test_one_exchange_from_scan_to_genotype(spark):
    df = entry.queries()["q_genotype_profile"](spark, entry.SMOKE_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and plan.count("FileScan") == 1 and "ArrowEvalPython" not in plan


@pytest.mark.parametrize(("name", "most", "scans"), [("q_stutter_fit", 4, 1), ("q_concordance_rollup", 5, 2), ("q_reject_funnel", 2, 1)])
def test_exchanges_of_cohort_queries(spark, name, most, scans):
    plan = entry.queries()[name](spark, entry.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) <= most and plan.count("FileScan") == scans


@pytest.mark.parametrize(("name", "walks"), [("q_gate_windows", 1), ("q_gate_funnel", 1), ("q_run_clusters", 1), ("q_run_evidence", 2), ("q_run_loci", 2)])
def test_reads_are_walked_once(spark, name, walks):
    """Once for the repeats and once for the sex marker, each with its own reads;
    not again in the filters on the gate's reason or in the range join."""
    plan = entry.queries()[name](spark, entry.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[walked(") == walks and "aggregate(cigar" not in plan
    assert not re.search(r"\w+Join.*(walked|aggregate)\(", plan)


def test_sex_marker_meets_its_own_reads(spark):
    """Others are dropped by the scan's filter, and evidence comes from one run."""
    plan = entry.queries()["q_run_evidence"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if " Filter " in line and "l_partkey" in line and "IN (chrX,chrY)" in line]
    assert len(filters) == 1 and plan.count("of_locus(") == 1


@pytest.mark.parametrize("name", ["q_gate_windows", "q_run_clusters", "q_run_evidence", "q_run_loci"])
def test_generated_code_is_compiled(spark, name):
    """The JVM interprets methods of more than 8,000 bytes for ever."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        code = entry.queries()[name](spark, entry.SMOKE_DIR)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= 8000, sizes
