"""Blocks of lists ask for many comparisons of few bytes: adaptive execution, which goes by bytes, doesn't fold them into one task."""

from fathom.llm import jaccard


def test_blocks_are_dealt_to_all_tasks(spark):
    rows = [(x, k, 100 * x + k, 5, True, k) for x in range(40) for k in range(8)]
    made = jaccard.block_pairs(spark.createDataFrame(rows, "list long, k long, class long, n long, small boolean, comp long"))
    held = made.select("list").rdd.glom().map(len).collect()
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(held) > 0 and sum(held) == 40


def test_members_of_a_join(spark):
    """A join's size is taken for the product of its tables': it says nothing of the tasks."""
    rows = spark.createDataFrame([(1, k, k, 5, True, k) for k in range(8)], "list long, k long, class long, n long, small boolean, comp long")
    sketches = spark.range(20_000_000).selectExpr("id as class", "id as sketch").filter("class < 8").union(spark.range(0, 20_000_000, 10_000_000).selectExpr("id + 100", "id"))
    plan = jaccard.block_pairs(rows.join(sketches, "class"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [list" in plan and f"], {spark.conf.get('spark.sql.shuffle.partitions')}" in plan
