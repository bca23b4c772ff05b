"""Exact and visual duplicates, keepers, dismissals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.scalars import path_penalty
from mediacat.operators.graph import connected_components
from mediacat.operators.mutations import delete_media, merge_media
from mediacat.operators.tables import checkpointed, fold_sorted, numbered
from mediacat.operators.vectors import similar_links, similar_pairs

GROUP = ["content_hash", "file_size"]


def exact_members(media: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Rows that share a non-empty hash and a size with another, with ``n`` of their group.

    Counts are reduced before the shuffle and joined back, so a group of any size is split.
    """
    if scope is not None:
        media = media.join(scope.select("id").distinct(), "id", "left_semi")
    hashed = media.where("content_hash <> ''")
    groups = hashed.groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1")
    return hashed.join(groups, GROUP)


def exact_groups(media: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``(content_hash, file_size, n, ids)`` by group, ids ascending."""
    return exact_members(media, scope).groupBy(*GROUP).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def duplicate_count(media: DataFrame) -> DataFrame:
    """One row: how many groups there are."""
    return media.where("content_hash <> ''").groupBy(*GROUP).count().where("count > 1").agg(F.count("*").alias("groups"))


def completeness(tags: Column) -> Column:
    """How much is known of an item: title or caption, location, date, and tags."""
    return ((F.col("caption") != "") | (F.col("audio_title") != "")).cast("int") + F.col("has_gps").cast("int") + (F.col("date_taken") != 0).cast("int") + tags


def keeper_order(tags: Column | None = None) -> list[Column]:
    """The best copy first: flag, pixels, bytes, completeness, tidy path, smallest id."""
    return [F.desc("flag"), F.desc(F.col("width").cast("long") * F.col("height")), F.desc("file_size"), F.desc(completeness(tags if tags is not None else F.lit(0))), path_penalty("file_path").asc(), F.col("id").asc()]


def ranked(members: DataFrame, by: list[str], tags: Column | None = None) -> DataFrame:
    """Members with ``rank`` inside their group; 1 is the keeper."""
    return members.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keeper_order(tags))))


def reclaimable(ranked_members: DataFrame, by: list[str]) -> DataFrame:
    """By group: its keeper, members, and the bytes that all others take."""
    return ranked_members.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("keeper"), F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("file_size"))), F.lit(0).cast("long")).alias("bytes"))


def group_order(groups: DataFrame) -> DataFrame:
    """Exact groups ``(content_hash, file_size, n)`` with ``place``: most members first, then larger files, then hash."""
    return numbered(groups, [F.desc("n"), F.desc("file_size"), F.col("content_hash")], "place")


def resolve(tables: dict[str, DataFrame], reviewed: DataFrame, merge: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """``(tables, conflicts)`` after duplicates were reviewed: ``(keeper, id, content_hash)`` names
    each copy to delete, its keeper and the hash that the reviewer saw.

    A group is resolved while keeper and copies still have that hash; the copies of other groups
    are the conflicts, and nothing of theirs changes. What is known of copies goes to the keeper
    if ``merge``. Files on disk aren't touched.
    """
    now = tables["media"].select(F.col("id").alias("at"), F.col("content_hash").alias("hash"))
    seen = reviewed.join(now, F.col("id") == F.col("at"), "left").withColumn("ok", F.coalesce(F.col("hash") == F.col("content_hash"), F.lit(False))).drop("at", "hash")
    seen = seen.join(now, F.col("keeper") == F.col("at"), "left").withColumn("ok", F.col("ok") & F.coalesce(F.col("hash") == F.col("content_hash"), F.lit(False)))
    good = checkpointed(seen.groupBy("keeper").agg(F.min("ok").alias("ok")).where("ok").select("keeper"))
    pairs = checkpointed(reviewed.join(good, "keeper", "left_semi").select("keeper", "id"))
    out = tables | (merge_media(tables, pairs) if merge else {})
    return out | delete_media(out, pairs.select("id")), reviewed.join(good, "keeper", "left_anti")


def dismiss(dismissals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dismissals with more pairs ``(a, b)``, each stored once with the smaller id first."""
    new = pairs.where("a <> b").select(F.least("a", "b").alias("media_id_a"), F.greatest("a", "b").alias("media_id_b"))
    return dismissals.select("media_id_a", "media_id_b").unionByName(new).distinct()


def split_dismissed(members: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Exact members ``(..., id)`` with ``cluster``, the smallest id of theirs; clusters of one are left out.

    In id order a member joins the first cluster that holds none it was dismissed with.
    Only members that a dismissal names choose, so groups without one pass untouched, and
    of the others only those members and the group's least free id meet in a task.
    """
    keyed = members.select(*GROUP, "id")
    ids = keyed.select(F.col("id").alias("x"), F.struct(*GROUP).alias("g"))
    d = dismissals.select("media_id_a", "media_id_b")
    inside = d.join(ids.select(F.col("x").alias("media_id_a"), F.col("g").alias("ga")), "media_id_a").join(ids.select(F.col("x").alias("media_id_b"), F.col("g").alias("gb")), "media_id_b").where("ga = gb")
    # Each pair as seen by its later member, who is the one that has to give way.
    blocked = inside.groupBy(F.col("ga").alias("g"), F.col("media_id_b").alias("id")).agg(F.collect_set("media_id_a").alias("foes"))
    named = blocked.select("g", "id", "foes").unionByName(inside.select(F.col("ga").alias("g"), F.col("media_id_a").alias("id"), F.array().cast("array<bigint>").alias("foes")))
    named = named.groupBy("g", "id").agg(F.flatten(F.collect_list("foes")).alias("foes"))
    free = keyed.select(F.struct(*GROUP).alias("g"), "id").join(named.select("g").distinct(), "g", "left_semi").join(named.select("g", "id"), ["g", "id"], "left_anti")
    first_free = free.groupBy("g").agg(F.min("id").alias("id")).select("g", "id", F.array().cast("array<bigint>").alias("foes"))
    choosing = named.unionByName(first_free)

    def chooser():
        group, clusters = None, []

        def step(row: tuple) -> int:
            nonlocal group, clusters
            *own, member, foes = row
            if own != group:
                group, clusters = own, []
            home = next((c for c in clusters if c.isdisjoint(foes)), None)
            if home is None:
                clusters.append(home := set())
            home.add(member)
            return min(home)

        return step

    flat = choosing.select(F.col("g.content_hash").alias("content_hash"), F.col("g.file_size").alias("file_size"), "id", "foes")
    chosen = fold_sorted(flat, GROUP, ["id"], chooser, "cluster", "long", [*GROUP, "id"])
    # Members that no dismissal names all join the first cluster.
    first = chosen.groupBy(*GROUP).agg(F.min("cluster").alias("first"))
    least = keyed.groupBy(*GROUP).agg(F.min("id").alias("least"))
    placed = keyed.join(chosen.select("id", "cluster"), "id", "left").join(first, GROUP, "left").join(least, GROUP)
    placed = placed.select(*GROUP, "id", F.coalesce("cluster", "first", "least").alias("cluster"))
    sizes = placed.groupBy(*GROUP, "cluster").count().where("count > 1").drop("count")
    return placed.join(sizes, [*GROUP, "cluster"], "left_semi")


def visual_edges(index: DataFrame, threshold: float, media: DataFrame | None = None, window: int = 0, dismissals: DataFrame | None = None) -> DataFrame:
    """Similar pairs that weren't dismissed and, with a window, were taken within as many
    seconds; an undated item is within any window."""
    return similar_pairs(index, threshold, media, window, dismissals)


def visual_groups(edges: DataFrame) -> DataFrame:
    """``(component, n, min_similarity, ids)``: components of the edges with their weakest edge, to 3 digits.
    The links of :func:`mediacat.operators.vectors.similar_links` give the groups of all pairs."""
    edges = checkpointed(edges)  # the similarity join is taken once
    members = checkpointed(connected_components(edges))
    weakest = edges.join(members, edges.a == members.id).groupBy("component").agg(F.round(F.min("score").cast("double"), 3).alias("min_similarity"))
    return members.groupBy("component").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).join(weakest, "component")


def _scan(media: DataFrame, index: DataFrame, threshold: float, window: int, dismissals: DataFrame | None, exact: bool, visual: bool) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``scan``, and the edges of its visual groups."""
    spark, edges = media.sparkSession, None
    none = dismissals if dismissals is not None else spark.createDataFrame([], "media_id_a long, media_id_b long")
    parts = []
    clusters = checkpointed(split_dismissed(exact_members(media), none))  # both passes take them
    if exact:
        rows = media.join(clusters.select("id", "cluster"), "id")
        parts.append(ranked(rows, ["cluster"]).select(F.lit("exact").alias("type"), F.col("cluster").alias("group_id"), "id", "rank", "file_size"))
    if visual:
        out = (clusters if exact else exact_members(media)).select(F.col("id").alias("media_id"))
        photos = media.where("media_type = 'photo'").select(F.col("id").alias("media_id"))
        left = index.join(checkpointed(photos.join(out, "media_id", "left_anti")), "media_id", "left_semi")  # read more than once
        edges = checkpointed(similar_links(left, threshold, media, window, none))
        rows = media.join(connected_components(edges), "id")
        parts.append(ranked(rows, ["component"]).select(F.lit("visual").alias("type"), F.col("component").alias("group_id"), "id", "rank", "file_size"))
    out = parts[0] if parts else spark.createDataFrame([], "type string, group_id long, id long, rank int, file_size long")
    return (out.unionByName(parts[1]) if len(parts) == 2 else out), edges


def scan(media: DataFrame, index: DataFrame, threshold: float = 0.97, window: int = 86400, dismissals: DataFrame | None = None, exact: bool = True, visual: bool = True) -> DataFrame:
    """``(type, group_id, id, rank)`` of every duplicate: exact clusters, then visual groups of
    photos outside them. Without the exact pass, members of all exact groups stay out."""
    return _scan(media, index, threshold, window, dismissals, exact, visual)[0].drop("file_size")


def scan_report(media: DataFrame, index: DataFrame, threshold: float = 0.97, window: int = 86400, dismissals: DataFrame | None = None, exact: bool = True, visual: bool = True, scope: DataFrame | None = None) -> DataFrame:
    """One row a group of a scan, within ``scope`` (ids) if given, in the order of the review:
    ``(place, type, group_id, keeper, n, bytes, min_similarity, media_scanned)``.

    Exact groups come first, then visual ones, each with the most members first, ties by
    keeper. ``bytes`` is what all members but the keeper take, ``min_similarity`` the weakest
    link to 3 digits (1 for exact groups), ``media_scanned`` the size of the scope, ids that
    it repeats or that don't exist not counted.
    """
    if scope is not None:
        media = checkpointed(media.join(scope.select("id").distinct(), "id", "left_semi"))
    rows, edges = _scan(media, index, threshold, window, dismissals, exact, visual)
    rows = checkpointed(rows)
    groups = reclaimable(rows, ["type", "group_id"])
    if edges is None:
        groups = groups.withColumn("min_similarity", F.lit(1.0))
    else:
        of = rows.where("type = 'visual'").select("type", "group_id", F.col("id").alias("a"))
        weakest = edges.join(of, "a").groupBy("type", "group_id").agg(F.round(F.min("score").cast("double"), 3).alias("min_similarity"))
        groups = groups.join(weakest, ["type", "group_id"], "left").withColumn("min_similarity", F.coalesce("min_similarity", F.lit(1.0)))
    placed = numbered(groups, [F.col("type"), F.desc("n"), F.col("keeper")], "place")
    total = media.agg(F.count("*").alias("media_scanned"))
    return placed.join(F.broadcast(total)).select("place", "type", "group_id", "keeper", "n", "bytes", "min_similarity", "media_scanned")  # one row
