"""What is dealt by article follows the table's rows, not the number of cores."""

from archivolt.plans import views as V
from archivolt.plans.catalogue import QUERIES


def test_tasks_follow_the_rows(spark, sf_dir):
    assert V.tasks(spark.range(1001), 10) == 101 and V.tasks(spark.range(0), 10) == spark.sparkContext.defaultParallelism
    lines = V.read(spark, sf_dir, "lineitem").count()
    for view in (V.article_author, V.article_subject):
        before, V.ROWS_A_TASK = V.ROWS_A_TASK, 100
        try:
            assert view(spark, sf_dir).rdd.getNumPartitions() == -(-lines // 100) > spark.sparkContext.defaultParallelism
        finally:
            V.ROWS_A_TASK = before


def test_articles_are_counted_before_the_semi_join(spark, sf_dir):
    """No join and no grouping set meets the articles again: what moves by author are cells, whose number doesn't follow the table."""
    plan = QUERIES["denominators_semi"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    expand = plan[plan.index("Expand") :]
    assert "Join LeftSemi" in expand and expand.index("Aggregate") > expand.index("Join LeftSemi")
    assert "Aggregate [section" in expand[: expand.index("RepartitionByExpression")]
