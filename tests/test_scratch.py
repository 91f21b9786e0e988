from pyspark.sql import functions as F

from loomspark.operators import summaries
from loomspark.scratch import Scratch, spread


def test_counts_are_taken_while_a_table_is_written(spark):
    scratch = Scratch(spark, "observed")
    table, n = scratch.counted(spark.range(1000).repartition(7).where("id % 3 = 0"), "some")
    assert n == table.count() == 334
    _, seen = scratch.observed(spark.range(10).withColumn("even", F.expr("id % 2 = 0")), "more", even=F.count_if("even"), last=F.max("id"))
    assert seen == {"even": 5, "last": 9}


def test_counts_of_nothing(spark):
    """Plans that turn out to be empty, by their constants or while they run, count nothing and wait for nothing."""
    scratch = Scratch(spark, "observed")
    none = spark.createDataFrame([], "id long, level int")
    assert scratch.counted(none, "a")[1] == 0
    assert scratch.counted(spark.range(10).where("false"), "b")[1] == 0
    joined = spark.range(10).where("id > 100").repartition(3).join(spark.range(5), "id").groupBy("id").count()
    assert scratch.counted(joined, "c")[1] == 0
    assert scratch.observed(none, "d", n=F.count("*"), top=F.max("level"))[1] == {"n": 0, "top": None}


def test_dry_run_reads_chunks_once(spark):
    """Parsed chunks are costly: what makes them runs once for each row."""
    read = spark.sparkContext.accumulator(0)

    def run(frames):
        for pdf in frames:
            read.add(len(pdf))
            yield pdf

    rows = [(i, "code", "function", f"f{i}", f"call f{i + 1}") for i in range(6)] + [(9, "doc", "section", "s", "f1")]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_type string, kind string, name string, content string")
    got = summaries.dry_run(chunks.mapInPandas(run, chunks.schema), size=4)
    assert got == {"total_functions": 6, "levels": 6, "api_calls": 2}
    assert read.value == 7


def test_a_table_of_names_is_no_broadcast_of_its_own(spark):
    """Some MB of names in a file are some hundred MB in the driver."""
    Scratch(spark, "any")
    names = spark.range(400_000).selectExpr("sha2(cast(id as string), 256) AS name")
    names = Scratch(spark, "names").cut(names.coalesce(1).selectExpr("substring(name, 1, 12) AS name"), "names")
    plan = names.join(names.groupBy("name").count(), "name")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_rows_of_one_file_go_to_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert rows.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in rows.collect()) == list(range(1000))
