"""The order of a table by tasks of a set number of rows."""

from kmerspark.operators import sets


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Rows in order are few bytes on their way, so Spark put tens of millions of them in one task."""
    monkeypatch.setattr(sets, "BLOCK", 4)
    monkeypatch.setattr(sets, "TOGETHER", 2)
    table = spark.range(40).selectExpr("id AS pos", "IF(id = 21, 3, id) AS code")
    plan = sets._with_previous(table)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 5)" in plan
    assert tuple(sets.check_order(table).first()) == (40, False, 21)
    assert tuple(sets.check_order(table.where("pos < 20"), strict=True).first()) == (20, True, None)
    assert tuple(sets.check_order(table.where("false")).first()) == (0, True, None)
