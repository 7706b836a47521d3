"""Figures that feedback means, over tables where many figures and much feedback say the same."""

import duckdb
import pytest

from concord.plans import catalog


def made(plan):
    """The most rows that a join of an executed plan gave."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return made(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return made(plan.plan())
    own = plan.metrics().get("numOutputRows") if "Join" in name else None
    rows = own.get().value() if own is not None and own.isDefined() else 0
    return max([rows] + [made(plan.children().apply(i)) for i in range(plan.children().size())])


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("relabels")
    con = duckdb.connect()
    # 3,000 figures: two names that many have, some of their own, none, an empty one, one of two rows
    con.sql("""CREATE TABLE part AS SELECT i AS p_partkey, CASE WHEN i % 100 = 7 THEN 'Red Bolt x' || i WHEN i % 100 = 8 THEN NULL WHEN i % 100 = 9 THEN '' WHEN i % 2 = 0 THEN 'red bolt' ELSE 'cold gear' END AS p_name FROM range(3000) t(i)
     UNION ALL SELECT 5000, unnest(['blue ring', 'blue plate']) UNION ALL SELECT 5001, 'old blue rod' UNION ALL SELECT 5002, 'blue rod' UNION ALL SELECT NULL, 'new anvil'""")
    con.sql("""CREATE TABLE lineitem AS SELECT i // 2 AS l_orderkey, 1 + i % 2 AS l_linenumber, i % 3000 AS l_partkey, 0 AS l_suppkey FROM range(4000) t(i)
     UNION ALL SELECT 9000, 1, 5001, 0 UNION ALL SELECT 9001, 1, 5002, 0 UNION ALL SELECT 9002, 1, 5000, 0 UNION ALL SELECT NULL, 1, 5001, 0""")
    for t in ("part", "lineitem"):
        con.sql(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return con, str(d)


def test_relabels_match_sql(spark, tables):
    con, d = tables
    got = sorted(map(tuple, catalog.QUERIES["ground_relabels"](spark, d).collect()), key=repr)
    assert got == sorted(con.sql(catalog.ORACLE["ground_relabels"]).fetchall(), key=repr)
    assert (9000, 5001, 3) in got and (None, 5001, 3) in got and (9002, 5000, 3) in got and len(got) > 20


def test_relabels_match_sets_and_not_rows(spark, tables):
    """Feedback and figures of the same words give one pair, where rows would give millions."""
    found = catalog.QUERIES["ground_relabels"](spark, tables[1])
    found.collect()
    assert 0 < made(found._jdf.queryExecution().executedPlan()) < 20_000
