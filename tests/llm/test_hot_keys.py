"""A URL with most captures is read by many tasks."""

from pyspark.sql import functions as F

from glyphmill.llm import warc


def test_hot_keys_are_dealt_by_block(spark):
    pages = spark.range(6000).selectExpr("id as page_id", "case when id % 3 > 0 then 'http://hot.example/a' when id % 30 = 0 then null else concat('http://x', id % 50, '.example/') end as url", "concat('page ', id) as html")
    index = warc.CaptureIndex.build(warc.write_archives(pages), block_lines=50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = warc.look_up(index, pages).withColumn("task", F.spark_partition_id())
        sizes = [r.n for r in found.groupBy("key", "task").agg(F.count("*").alias("n")).where("key = 'example,hot)/a'").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and len(sizes) > 1 and max(sizes) < 2500
    assert sorted(r.id for r in found.select("id").collect()) == list(range(6000))
    one = warc.look_up(index, pages.where("page_id in (1, 30)"))
    assert one.count() == 4000 + 200
    assert sorted(x[1] for x in index.find("")) == [k for k in range(6000) if k % 30 == 0]
