"""The shared folder: the cluster's own, else the warehouse."""

from types import SimpleNamespace

from tideline import session


def fake(**settings):
    known = {name.replace("_", "."): value for name, value in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: known.get(name, default)))


def test_the_cluster_names_the_folder():
    assert session.shared_dir(fake(spark_checkpoint_dir="hdfs://shared/dir/", spark_sql_warehouse_dir="/w")) == "hdfs://shared/dir"


def test_the_warehouse_stands_in():
    assert session.shared_dir(fake(spark_sql_warehouse_dir="hdfs://warehouse/")) == "hdfs://warehouse"


def test_written_tables_keep_rows_and_types(spark):
    df = spark.sql("SELECT id, CAST(id AS DECIMAL(8,2)) AS d, array(id) AS a FROM range(5)")
    back = session.written(df, "test")
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())


def test_an_empty_result_can_be_written(spark):
    assert session.written(spark.range(5).filter("id > 9"), "empty").count() == 0


def test_tasks_are_bounded_by_size_and_not_by_number(spark):
    """A shuffle is dealt finely and merged up to a fixed size, so a task's part does not grow with the tables."""
    from tideline.session import LEAST_PARTITIONS

    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= LEAST_PARTITIONS
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_tags_are_counted_before_they_are_folded(spark):
    """The count over a review keeps the order of the join below it; above the fold it would need a sort of its own."""
    from tideline.operators.marts import review_aspect_tag

    tags = spark.sql("""SELECT 1 AS app_id, DATE'2020-01-01' AS day, 1 AS llm_config_sk, k AS labeling_sk, 'c' AS category_id, a AS aspect_id, s AS sentiment
        FROM VALUES (1, 'overall_impression', '+'), (2, 'overall_impression', '+'), (2, 'x', '-'), (3, 'x', '+'), (3, 'x', '-'),
                    (4, 'overall_impression', '+'), (4, 'overall_impression', '-') AS v(k, a, s)""")
    out = review_aspect_tag(tags)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Window")
    assert sorted((r.labeling_sk, r.aspect_id, r.sentiment) for r in out.collect()) == [(1, "overall_impression", "+"), (2, "x", "-"), (3, "x", "±")]


def test_a_task_reads_a_bounded_part_of_a_file(spark):
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "8m"
