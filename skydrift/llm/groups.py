"""Pairwise matches and partial lists consolidated into groups (deterministic Boruvka hooking).

Each round every component selects its smallest outgoing edge, edges being ordered by their
ends, and hooks onto the component at the other end. With a total order the hooks form trees
whose only cycles are mutual pairs, of which the smaller becomes the root. The trees collapse
by pointer doubling; the edges are relabelled, freed of loops and repeats, and the next round
starts. Components at least halve per round, so billions of pairs take a few dozen passes. All
state lives in tables in the shared folder; the driver sees only row counts.

Busy ends (a component that holds a third of all nodes) are looked up apart: a bounded sample
shows the keys that hold more than 1/128 of it, 127 at most, and these are broadcast with what they
map to. The sample steers the plan only; a key it misses is looked up like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.runtime import Durable

HOT_SHARE = 128
#: Fewer rows than this burden no task, whatever their keys.
HOT_ROWS = 50_000
#: Rows looked at to find busy keys.
SAMPLE_ROWS = 65_536


def lookup(df: DataFrame, key: str, to: DataFrame, rows: int) -> DataFrame:
    """df with the column ``root`` of ``to`` (u unique, root) at u = key; null where u is absent.

    ``rows`` is the number of rows of df.
    """
    plain = to.select(F.col("u").alias("_u"), "root")
    if rows <= HOT_ROWS:
        return df.join(plain, F.col(key) == F.col("_u"), "left").drop("_u")
    share = min(1.0, SAMPLE_ROWS / rows)
    seen = df.select(F.col(key).alias("_h"))
    seen = seen if share == 1 else seen.sample(False, share, 7)
    hot = seen.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows * share / HOT_SHARE).select("_h")
    known = hot.join(to, F.col("_h") == F.col("u"), "left").select("_h", "root")
    marked = df.join(F.broadcast(known.select("_h", F.col("root").alias("_hot"))), F.col(key) == F.col("_h"), "left")
    warm = marked.where("_h is not null").drop("_h").withColumnRenamed("_hot", "root")
    cold = marked.where("_h is null").drop("_h", "_hot").join(plain, F.col(key) == F.col("_u"), "left").drop("_u")
    return cold.unionByName(warm)


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b", keep: Durable | None = None) -> DataFrame:
    """node, group_id for every end of an edge; group_id is the smallest node of the group.

    The ends may be of any orderable type. Null ends, loops, repeated and reversed edges link
    nothing new: an edge with a null end is ignored, an end that only meets itself forms a group
    of its own. No edges give no rows. Other columns are ignored.
    """
    keep = keep or Durable(edges.sparkSession, "groups")
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now = keep.put(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    label = keep.put(now.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("at", F.col("node")))
    nodes = label.count()
    live = now.where("u <> v")
    while n := live.count():
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest outgoing edge by (smaller end, greater end) leads to the smallest neighbour
        hook = both.groupBy("u").agg(F.min("v").alias("root"))
        tree = keep.put(hook)
        size = tree.count()
        # of a mutual pair the smaller is the root
        pairs = lookup(tree.withColumnRenamed("root", "p"), "p", tree, size)
        rooted = keep.put(
            pairs.select("u", F.when((F.col("root") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("root"))
        )
        keep.drop(tree)
        tree = rooted
        while True:
            step = lookup(tree.withColumnRenamed("root", "p"), "p", tree, size)
            doubled = keep.put(step.select("u", F.col("root"), (F.col("root") != F.col("p")).alias("moved")))
            moved = doubled.where("moved").count()
            keep.drop(tree)
            tree = doubled
            if not moved:
                break
        tree = tree.select("u", "root")
        first = lookup(live.select("u", "v"), "u", tree, n).select("v", F.col("root").alias("u"))
        second = lookup(first, "v", tree, n).select("u", F.col("root").alias("v"))
        fresh = keep.put(second.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        moved_label = lookup(label, "at", tree, nodes)
        relabelled = keep.put(moved_label.select("node", F.coalesce("root", "at").alias("at")))
        keep.drop(now, label, doubled)
        now = live = fresh
        label = relabelled
    # roots are hooks' ends, not always the smallest: name each group by its smallest node
    name = label.groupBy("at").agg(F.min("node").alias("root")).withColumnRenamed("at", "u")
    return lookup(label, "at", name, nodes).select("node", F.col("root").alias("group_id"))


def track_key(written: Column) -> Column:
    """What names a track however it is written: its search, tile and candidate numbers.

    Something written without these three numbers names only itself, blanks and case aside;
    null and blank are null.
    """
    rx = r"(?i)scramble\D*?0*(\d+)\D+?roi\D*?0*(\d+)\D+?candidate\D*?0*(\d+)"
    bare = F.regexp_replace(F.lower(written), r"^\s+|\s+$", "")
    numbers = F.concat_ws("/", *[F.regexp_extract(written, rx, i) for i in (1, 2, 3)])
    return F.when(written.rlike(rx), numbers).when(F.length(bare) > 0, F.concat(F.lit("raw:"), bare))


def track_links(tracks: DataFrame, matches: DataFrame, lists: DataFrame) -> DataFrame:
    """a, b: links between existing tracks ('t' + key) and lists ('l' + list_no) they stand in.

    A list is a node of its own, so a list of any length is as many links as it has entries.
    Ends that name no track are removed before anything is linked through them.
    """
    known = tracks.select(track_key(F.col("_candidate_id")).alias("k")).where("k is not null").distinct()
    m = matches.where("is_match").select(track_key(F.col("candidate_a")).alias("ka"), track_key(F.col("candidate_b")).alias("kb"))
    m = m.where("ka <> kb").distinct()
    m = m.join(known.select(F.col("k").alias("ka")), "ka", "left_semi").join(known.select(F.col("k").alias("kb")), "kb", "left_semi")
    entries = F.explode(F.concat(F.coalesce("members", F.array().cast("array<string>")), F.array("representative"))).alias("m")
    e = lists.where("list_no is not null").select("list_no", entries).select("list_no", track_key(F.col("m")).alias("k")).where("k is not null").distinct()
    e = e.join(known, "k", "left_semi")
    t = lambda c: F.concat(F.lit("t"), F.col(c))
    return m.select(t("ka").alias("a"), t("kb").alias("b")).union(
        e.select(t("k").alias("a"), F.concat(F.lit("l"), F.col("list_no").cast("string")).alias("b"))
    )


def track_groups(tracks: DataFrame, matches: DataFrame, lists: DataFrame) -> DataFrame:
    """_candidate_id, group_id: every track of a group of at least two tracks.

    group_id is the smallest _candidate_id of the group, as spelled in ``tracks``. Undecided
    matches, nulls and ids of no track link nothing; tracks without an id are in no group.
    """
    keep = Durable(tracks.sparkSession, "track-groups")
    parts = connected_groups(track_links(tracks, matches, lists), keep=keep).where(F.col("node").startswith("t"))
    ids = tracks.select("_candidate_id").where("_candidate_id is not null").distinct()
    named = ids.withColumn("node", F.concat(F.lit("t"), track_key(F.col("_candidate_id")))).join(parts, "node")
    member = keep.put(named.select("_candidate_id", F.col("group_id").alias("at")))
    whole = (
        member.groupBy("at")
        .agg(F.min("_candidate_id").alias("root"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("at").alias("u"), "root")
    )
    out = lookup(member, "at", whole, member.count()).where("root is not null")
    return out.select("_candidate_id", F.col("root").alias("group_id"))
