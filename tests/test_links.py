"""Links of tags are made distinct in parts that hold whole items and follow the input."""

from pyspark.sql import functions as F

from mediacat.operators import facets, mutations, tables
from mediacat.sources import adapters

SF = "/root/testdata/sf0.001"


def test_links_are_dealt_by_item(spark):
    t = adapters.catalog(spark, SF)
    links = t["media_tags"].withColumn("part", F.spark_partition_id())
    assert links.agg(F.max("part")).first()[0] >= adapters.LINK_PARTS // 2
    assert links.groupBy("media_id").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    albums = t["album_media"].withColumn("part", F.spark_partition_id()).groupBy("media_id").agg(F.count_distinct("part").alias("n"))
    assert albums.where("n > 1").isEmpty()
    assert t["media_tags"].count() == t["media_tags"].distinct().count()


def test_coverage_and_added_tags(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, category string")
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 3), (12, 4), (12, 9)], "media_id long, tag_id long")
    got = facets.category_coverage({"tags": tags, "media_tags": links})
    assert got.columns == ["category", "tags", "links", "items"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2, 3, 2), ("b", 1, 1, 1), (None, 1, 1, 1)], key=str)
    media = spark.createDataFrame([(10,), (11,)], "id long")
    origin = spark.createDataFrame([], "media_id long, tag_id long, manual boolean, source string")
    out = mutations.add_tag({"media": media, "media_tags": links, "provenance": origin}, media.unionByName(media), 3)["media_tags"]
    assert sorted(map(tuple, out.collect())) == sorted([*map(tuple, links.collect()), (10, 3)])


def test_links_stay_dealt_by_item(spark):
    """What semi and anti joins by link leave, and united links, is where the links were dealt."""
    t = adapters.catalog(spark, SF)
    n = adapters.link_parts(t)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        updated = t["media"].withColumn("width", F.when(F.col("id") % 9 == 0, F.col("width") + 1).otherwise(F.col("width")))
        fewer = mutations.invalidate(t, updated)["media_tags"]
        merged = mutations.merge_media(t, t["media"].where("id % 3 = 0").select((F.col("id") - 1).alias("keeper"), "id"), n)["media_tags"]
        old = t["media"].where("id % 2 = 0")
        smart = mutations.replace_smart_tags(t, old, old.select(F.col("id").alias("media_id"), F.lit(1001).cast("long").alias("tag_id")))["provenance"]
        for out in (fewer, merged, smart):
            parts = out.withColumn("part", F.spark_partition_id())
            assert parts.agg(F.max("part").alias("most")).first().most >= n // 2
        plan = facets.tag_facets(t)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(media_id" in plan
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(media_id" in x and "tag_id" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_by_link(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, None), (None, 1)], "media_id long, tag_id long")
    right = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, None), (None, 1)], "media_id long, tag_id long")
    for how in ("left_semi", "left_anti"):
        assert sorted(map(str, tables.by_link(left, right, how).collect())) == sorted(map(str, left.join(right, ["media_id", "tag_id"], how).collect()))


def test_types_get_their_tags_in_shares(spark):
    """One type on all parts: its parts are dealt into shares, and lines are never dealt by type."""
    part = spark.range(2000).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 100 > 0, F.lit("LARGE")).alias("p_type"))
    part = part.unionByName(part.where("p_partkey < 3")).unionByName(spark.createDataFrame([(None, "LARGE")], "p_partkey long, p_type string"))
    tags = spark.createDataFrame([(1, "LARGE", "keyword"), (3001, "LARGE", "events"), (3002, "SMALL", "events")], "id long, name string, category string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = adapters.typed_parts(part, tags, 64)
        want = part.where("p_type IS NOT NULL").select("p_partkey", F.lit(3001).cast("long").alias("id"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        rows = [r.n for r in got.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
        assert len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(rows) < want.count() / 2
        plan = adapters.catalog(spark, SF)["media_tags"]._jdf.queryExecution().executedPlan().toString()
        by_type = [x for x in plan.splitlines() if "SortMergeJoin [p_type" in x]
        assert by_type and all("share" in x for x in by_type)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
