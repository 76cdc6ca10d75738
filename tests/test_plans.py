"""Plan-shape guards: the optimizer must not re-inline expensive expressions."""

import re

from conftest import SF001
from tessera.operators import notebooks as nbops
from tessera.operators import validation as val
from tessera.operators.corpus import domain_tags
from tessera.plans.fixtures import notebooks
from tessera.session import read_table


def _plan(df) -> str:
    """Formatted explain: every expression is listed once, at the node that computes it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_notebook_plans_parse_once(spark):
    nbs = notebooks(spark, SF001)
    for df in (nbops.explode_cells(nbs), val.notebook_verdicts(nbs),
               val.error_samples(val.notebook_verdicts(nbs)), nbops.explodable_notebooks(nbs)):
        assert _plan(df).count("parseJson") == 1


def test_domain_tags_one_tokenisation_no_shuffle(spark):
    plan = _plan(domain_tags(read_table(spark, SF001, "documents"), "doc_id", "text"))
    assert plan.count("split(") == 1
    assert "Exchange" not in plan


def test_euler_counts_pair_tasks_run_once(spark):
    from tessera.plans.q_topology import q_euler_counts
    plan = _plan(q_euler_counts(spark, SF001))
    assert len(re.findall(r"FlatMapGroupsInPandas", plan)) == 0      # read back from the checkpoint
