"""The registered queries: names, oracles, plans."""

import os
import re

import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert all(re.fullmatch(r"([a-z]|op)\d+_[a-z0-9_]+|pipeline", name) for name in E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:5] == ["campana", "tipo_estacion", "cliente", "año", "mediana_tpp"] and df.count() > 0


@pytest.mark.parametrize("name", ["a3_build_operations", "w1_dead_time", "a19_campaign_durations", "a11_box_difficulty", "x7_significance_stars"])
def test_no_python_rows_in_the_plan(spark, name):
    plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned_at_the_scan(spark):
    plan = E.queries()["a2_iqr_bounds"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan and "c_name" not in plan


def test_the_rest_works_without_the_corpus_package(tmp_path):
    """A copy without ``flowmetrics/llm``, with and without ``corpus_pipeline.py``, still registers every table query."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    tables = {n for n in E.queries() if not re.match(r"op\d+_|pipeline", n)}
    for _ in range(2):
        code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True)
        assert set(said.stdout.split()) == tables and len(tables) >= 90
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
