"""The driver's star-schema tables seen as a media catalog.

Each relation is a plain projection, written once in the SQL that Spark and DuckDB share, so
that a query and its SQL twin start from the same rows. ``{ts}`` is the one difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

RELATIONS = {
    "media": """
        SELECT o_orderkey + 1 AS id,
               CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN concat('Archive', chr(92), CAST(year(o_orderdate) AS STRING), chr(92))
                    WHEN o_orderkey % 13 = 0 THEN concat('/photos/Été_', CAST(year(o_orderdate) AS STRING), '/copy/')
                    ELSE concat('photos/', CAST(year(o_orderdate) AS STRING), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/') END
               || concat(CASE WHEN o_orderkey % 17 = 0 THEN 'IMG (1)%20' ELSE 'img_' END, CAST(o_orderkey + 1 AS STRING),
                         CASE o_custkey % 10 WHEN 8 THEN '.mp4' WHEN 9 THEN '.mp3' ELSE '.jpg' END) AS file_path,
               concat(CASE WHEN o_orderkey % 17 = 0 THEN 'IMG (1)%20' ELSE 'img_' END, CAST(o_orderkey + 1 AS STRING),
                      CASE o_custkey % 10 WHEN 8 THEN '.mp4' WHEN 9 THEN '.mp3' ELSE '.jpg' END) AS file_name,
               CAST(1000 + floor(o_orderkey / 3) % 7000 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS file_size,
               {ts} + 3600 AS file_modified_time,
               CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('h', CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING)) END AS content_hash,
               CAST(1000 + o_orderkey % 3 * 100 AS INT) AS width, CAST(800 + o_custkey % 2 * 100 AS INT) AS height,
               CASE WHEN o_orderkey % 97 = 0 THEN CAST(0 AS BIGINT) WHEN o_orderkey % 89 = 0 THEN -{ts} ELSE {ts} + o_orderkey % 24 * 3000 END AS date_taken,
               CAST(substring(o_orderpriority, 1, 1) AS INT) AS rating,
               CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS INT) AS flag,
               c_mktsegment AS camera_make, n_name AS camera_model, '' AS lens,
               o_custkey % 4 <> 0 AS has_gps,
               CAST(o_custkey % 170 - 84.75 AS DOUBLE) AS latitude, CAST(o_orderkey * 7 % 360 - 179.5 AS DOUBLE) AS longitude,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE {ts} + 86400 END AS created_at,
               CASE WHEN o_custkey % 6 = 0 THEN concat(' Fête ', CAST(o_orderkey % 20 AS STRING)) ELSE '' END AS caption,
               CASE o_custkey % 10 WHEN 8 THEN 'video' WHEN 9 THEN 'audio' ELSE 'photo' END AS media_type,
               CASE WHEN o_custkey % 10 >= 8 THEN CAST(o_orderkey % 600 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS duration,
               '' AS audio_artist, CASE WHEN o_custkey % 10 = 9 THEN concat('Title ', CAST(o_orderkey % 9 AS STRING)) ELSE '' END AS audio_title, '' AS audio_album, '' AS audio_genre
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "tags": """
        SELECT CAST(1 AS BIGINT) AS id, 'Last Imported' AS name, 'keyword' AS category
        UNION ALL SELECT DISTINCT CAST(1000 + TRY_CAST(substring(p_brand, 7) AS INT) AS BIGINT), p_brand, 'keyword' FROM {part}
        UNION ALL SELECT CAST(2000 + n_nationkey AS BIGINT), n_name, 'places' FROM {nation}
        UNION ALL SELECT CAST(3000 + row_number() OVER (ORDER BY p_type) AS BIGINT), p_type, 'events' FROM (SELECT DISTINCT p_type FROM {part}) x
        UNION ALL SELECT CAST(4000 + c_custkey AS BIGINT), c_name, 'people' FROM {customer} WHERE c_custkey < 20
        UNION ALL SELECT CAST(5000 AS BIGINT), 'Unused', 'Keyword'""",
    "media_tags": """
        SELECT DISTINCT l_orderkey + 1 AS media_id, CAST(1000 + TRY_CAST(substring(p_brand, 7) AS INT) AS BIGINT) AS tag_id
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        UNION SELECT DISTINCT l_orderkey + 1, t.id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {tags} t ON t.name = p_type AND t.category = 'events' WHERE l_linenumber = 2
        UNION SELECT o_orderkey + 1, CAST(2000 + c_nationkey AS BIGINT) FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0
        UNION SELECT o_orderkey + 1, 4000 + o_custkey % 20 FROM {orders} WHERE o_custkey % 50 < 20
        UNION SELECT o_orderkey + 1, CAST(1 AS BIGINT) FROM {orders} WHERE o_orderkey % 37 = 0""",
    "provenance": """
        SELECT media_id, tag_id, tag_id % 3 = 0 AS manual,
               CASE WHEN tag_id % 3 = 0 THEN 'manual' WHEN tag_id < 2000 THEN 'clip' WHEN tag_id < 3000 THEN 'gps' ELSE 'face' END AS source
        FROM {media_tags} WHERE (media_id + tag_id) % 5 <> 0""",
    "albums": "SELECT s_suppkey + 1 AS id, s_name AS name FROM {supplier}",
    "album_media": """
        SELECT l_suppkey + 1 AS album_id, l_orderkey + 1 AS media_id, CAST(min(l_linenumber) AS INT) AS position
        FROM {lineitem} WHERE l_suppkey % 10 <> 3 GROUP BY l_suppkey, l_orderkey""",
    "index": "SELECT vec_id + 1 AS media_id, embedding, label FROM {embeddings}",
    "faces": """
        SELECT vec_id + 1 AS id, vec_id * 7 % 300 + 1 AS media_id, embedding, vec_id % 13 = 0 AS dismissed,
               CASE WHEN vec_id % 2 = 0 THEN CAST(4000 + label AS BIGINT) END AS person_tag_id
        FROM {embeddings}""",
    "face_rejections": "SELECT vec_id + 1 AS face_id, CAST(4000 + label AS BIGINT) AS tag_id FROM {embeddings} WHERE vec_id % 6 = 1",
    "copies": """
        SELECT doc_id + 1 AS id, sha256(text) AS content_hash, n_chars AS file_size, CAST(doc_id % 3 - 1 AS INT) AS flag,
               CAST(doc_id % 4 * 10 AS INT) AS width, CAST(10 AS INT) AS height, source AS caption, '' AS audio_title, doc_id % 2 = 0 AS has_gps, doc_id % 5 AS date_taken,
               CASE WHEN doc_id % 2 = 0 THEN concat('export/copy (2)/', CAST(doc_id AS STRING)) ELSE concat('copyright/', CAST(doc_id AS STRING), '%20') END AS file_path
        FROM {documents}""",
    "dismissals": "SELECT a.media_id AS media_id_a, a.media_id + 1 AS media_id_b FROM {index} a WHERE a.media_id % 3 = 0",
    "gazetteer": """
        SELECT CAST(n_nationkey AS BIGINT) AS row_no, concat('City ', CAST(n_nationkey AS STRING)) AS name, CASE WHEN n_nationkey % 2 = 0 THEN concat('Region ', CAST(n_regionkey AS STRING)) ELSE '' END AS admin1,
               n_name AS country, CAST(n_nationkey * 7 - 84 AS DOUBLE) AS latitude, CAST(n_nationkey * 14 % 360 - 179 AS DOUBLE) AS longitude
        FROM {nation}""",
}


#: Parts that a read partition's links are dealt into.
LINK_PARTS = 16


def link_parts(tables: dict[str, DataFrame]) -> int:
    """Parts that links are dealt into: so many for each read partition."""
    return LINK_PARTS * tables["lineitem"].rdd.getNumPartitions()


_BY_TYPE = "{part} ON l_partkey = p_partkey JOIN {tags} t ON t.name = p_type AND t.category = 'events'"


def typed_parts(part: DataFrame, tags: DataFrame, shares: int) -> DataFrame:
    """``(p_partkey, id)``: parts with the tags of their types. Types are few, so a type's parts
    meet its tag in so many ``shares``, which should follow the input, and not in one task."""
    kinds = tags.where("category = 'events'").select("id", F.col("name").alias("p_type"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    share = F.pmod(F.hash("p_partkey"), F.lit(shares)).alias("share")
    return part.select("p_partkey", "p_type", share).join(kinds, ["p_type", "share"]).select("p_partkey", "id")


def _links(spark: SparkSession, text: str, used: dict[str, DataFrame]) -> DataFrame:
    """The distinct links of ``media_tags``, made distinct item by item: rows are dealt by item into
    parts whose number follows the input's partitions, so a part has a bounded number of rows,
    and not at first within whatever tasks the joins end in. Types get their tags part by part,
    since lines dealt by type would end in as many tasks as there are types."""
    if _BY_TYPE not in text:
        raise ValueError("media_tags no longer joins lines, parts and the tags of types as expected")
    text, n = text.replace(_BY_TYPE, "{typed} t ON l_partkey = p_partkey"), link_parts(used)
    used = {k: v for k, v in used.items() if k != "tags"} | {"typed": typed_parts(used["part"], used["tags"], n)}
    every = spark.sql(text.replace("SELECT DISTINCT l_orderkey", "SELECT l_orderkey").replace("UNION SELECT", "UNION ALL SELECT"), **used)
    return every.repartition(n, "media_id").distinct()


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All relations of a folder of driver tables. Nothing is read before a query asks for it."""
    known: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
    for name, text in RELATIONS.items():
        used = {k: v for k, v in known.items() if "{" + k + "}" in text}
        text = text.replace("{ts}", "unix_timestamp(CAST(o_orderdate AS TIMESTAMP))").replace("sha256(text)", "sha2(text, 256)")
        if name == "album_media":  # grouped where they are dealt, as links are
            used["lineitem"] = used["lineitem"].repartition(link_parts(used), "l_orderkey")
        known[name] = _links(spark, text, used) if name == "media_tags" else spark.sql(text, **used)
    return known


def with_clause() -> str:
    """The relations as the start of a DuckDB statement."""
    parts = []
    for name, text in RELATIONS.items():
        text = text.replace("{ts}", "CAST(epoch(o_orderdate) AS BIGINT)")
        for k in (*BASE, *RELATIONS):
            text = text.replace("{" + k + "}", f'"{k}"')
        parts.append(f'"{name}" AS ({text})')
    return "WITH RECURSIVE " + ",\n".join(parts)
