"""Consolidation of far too many small files into fewer well-sized ones.

``compaction_plan`` works on a listing: it brings every spelling of a path to one, keeps the
finished event files below the small-file size, finds the folders that hold more of them than
allowed and packs these folder by folder into output files of the target size.

``compact_table`` carries a consolidation out on a partitioned Parquet table. Partitions with more
small files than allowed are rewritten into a staging folder, each into as many files as its bytes
need, and counted. Then the version is claimed by a note of what will be replaced by what, and the partitions
are overwritten dynamically (those rewritten, no others) by renaming: the old folder is parked, the new one takes its
place, and files that someone put there meanwhile are moved back beside it, since exactly the files
named in the note are replaced. Only when all of that is verified is the version committed and the parked
data deleted. What breaks off in between is completed, from the same note, by ``recover``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.operators.skew import running_total
from skydrift.runtime import Durable, remove

#: What an event file is called (fixed value).
EVENT_FILE = r"^events_block_\d{3}(_s\d{3})?\.fits$"
SMALL_BYTES = 1_048_576
TARGET_BYTES = 128 * 1_048_576


#: Small files a folder may keep; more are consolidated. A plan that must leave no small file keeps one at most.
MAX_SMALL = 1
#: Partitions rewritten per round; the next round takes the next ones.
ROUND = 500


def canonical_path(path: Column, root: str = "/srv/fps") -> Column:
    """The absolute path without blanks around it, scheme, doubled slashes, '.' and '..'.

    Percent escapes are undone in file: addresses only (elsewhere % is a letter of the name;
    a malformed escape leaves the address as it is). Relative paths start at ``root``. Null
    and blank paths are null.
    """
    bare = F.regexp_replace(path, r"^[\s ]+|[\s ]+$", "")
    inside = F.regexp_replace(bare, r"^(?i)file:(//[^/]*)?", "")
    undone = F.coalesce(F.try_url_decode(F.regexp_replace(inside, r"\+", "%2B")), inside)
    plain = F.when(bare.rlike(r"^(?i)file:"), undone).otherwise(bare)
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), plain))
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(whole, "/"),
        empty,
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    # most paths need no resolving, which is by far the dearest step
    odd = whole.contains("//") | whole.contains("/.") | whole.endswith("/")
    # nor do paths that begin with / and end with a letter need any of the rest
    ready = path.rlike(r"^(?!.*(//|/\.))/.*[a-z]\z")
    resolved = F.when(F.length(bare) > 0, F.when(odd, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(whole))
    return F.when(ready, path).otherwise(resolved)


def small_event_files(listing: DataFrame, small_bytes: int = SMALL_BYTES, root: str = "/srv/fps") -> DataFrame:
    """listing_no, path (canonical), size: one row per small finished event file.

    A file listed more than once, under whatever spelling, comes out with its lowest
    listing_no. Null, zero and negative sizes are unknown or unfinished files and stay out, as
    do null paths.
    """
    # most rows are told by their size or by a name that no way of writing turns into an event file's
    likely = F.col("path").contains("events_block_") | F.col("path").contains("%")
    return (
        listing.where((F.col("size") > 0) & (F.col("size") < small_bytes) & likely)
        .select("listing_no", canonical_path(F.col("path"), root).alias("path"), "size")
        .where(F.substring_index("path", "/", -1).rlike(EVENT_FILE))
        .groupBy("path")
        .agg(F.min(F.struct("listing_no", "size")).alias("r"))
        .select("r.listing_no", "path", "r.size")
    )


def compaction_plan(
    listing: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, root: str = "/srv/fps", max_small: int = MAX_SMALL
) -> DataFrame:
    """listing_no, path, size, output: the larger file that takes each small file in, once.

    A folder that holds more than ``max_small`` small files, enough to fill a file of
    ``small_bytes``, is consolidated by itself, in path order. The few small files of other
    folders are counted at the parent folder by the same rule, and what is few there too is packed at the top:
    otherwise no larger file could take them in.
    """
    keep = Durable(listing.sparkSession, "plan")
    small = keep.put(small_event_files(listing, small_bytes, root))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    f = small.withColumn("_dir", folder).withColumn("_up", F.regexp_replace(folder, r"/[^/]*$", ""))
    crowded = (F.col("_n") > max_small) & (F.col("_bytes") >= small_bytes)
    count = (F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    dirs = f.groupBy("_up", "_dir").agg(*count).withColumn("_own", crowded)
    ups = dirs.where("not _own").groupBy("_up").agg(F.sum("_bytes").alias("_bytes"), F.sum("_n").alias("_n")).select("_up", crowded.alias("_upown"))
    place = dirs.join(ups, "_up", "left").select(
        "_dir", F.when(F.col("_own"), F.col("_dir")).when(F.col("_upown"), F.col("_up")).otherwise(F.lit(root)).alias("_home")
    )
    packed = running_total(f.join(place, "_dir").select("listing_no", "path", "size", "_home"), ["_home"], ["path"], "size")
    bin_no = F.floor(F.col("before") / F.lit(target_bytes)).cast("int")
    return packed.select(
        "listing_no", "path", "size", F.format_string("%s/events_merged_%06d.fits", F.col("_home"), bin_no).alias("output")
    )


def plan_targets(plan: DataFrame, photons: DataFrame, data_root: str = "/srv/fps/allsky_queries/data") -> DataFrame:
    """output, n_files, bytes, n_photons: each larger file with the photon rows that go into it."""
    rows = photons.where("file_id is not null").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    at = rows.select(F.concat(F.lit(data_root + "/"), "file_id").alias("path"), "n")
    return (
        plan.join(at, "path", "left")
        .groupBy("output")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_photons"))
    )


class Conflict(RuntimeError):
    """The table changed between the reading and the commit of a consolidation."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def snapshot_version(spark: SparkSession, root: str) -> int:
    """The greatest committed version of the table, 0 where none was."""
    fs, p = _fs(spark, f"{root}/_snapshots")
    if not fs.exists(p):
        return 0
    found = [re.fullmatch(r"(\d+)\.commit", s.getPath().getName()) for s in fs.listStatus(p)]
    return max([0, *(int(m[1]) for m in found if m)])


def _claim(spark: SparkSession, path: str, text: str, message: str) -> None:
    """Writes a file that must not exist yet; of two writers one gets a Conflict."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise Conflict(message) from e
    out.write(bytearray(text.encode()))
    out.close()


def commit_snapshot(spark: SparkSession, root: str, version: int) -> None:
    """Claims a version; of two writers that ask for the same one, one gets a Conflict."""
    _claim(spark, f"{root}/_snapshots/{version:012d}.commit", "", f"version {version} was committed by another writer")


def _open_note(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(version, path) of a note without a commit: a consolidation under way or broken off."""
    fs, p = _fs(spark, f"{root}/_snapshots")
    if not fs.exists(p):
        return None
    names = {s.getPath().getName() for s in fs.listStatus(p)}
    for n in sorted(names):
        if (m := re.fullmatch(r"(\d+)\.note", n)) and f"{m[1]}.commit" not in names:
            return int(m[1]), f"{root}/_snapshots/{n}"
    return None


def table_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, part (folder below the root) of each data file; the contents aren't read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    )
    at = F.regexp_replace("path", r"/[^/]*$", "")
    return files.select("path", F.col("length").alias("size"), F.regexp_extract(at, r"((?:/[^/=]+=[^/]*)+)$", 1).alias("part"))


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isFile()) if fs.exists(p) else []


def _move(spark: SparkSession, a: str, b: str) -> None:
    fs, p = _fs(spark, a)
    q = spark._jvm.org.apache.hadoop.fs.Path(b)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"{a} could not be renamed to {b}")


def _swap(spark: SparkSession, root: str, note: dict, part: str) -> None:
    """Puts a rewritten partition in the place of the old one; may be done again at any point."""
    new, old, live = f"{note['staged']}{part}", f"{note['parked']}{part}", f"{root}{part}"
    fs, p = _fs(spark, new)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(p):
        if not fs.exists(path(old)):
            _move(spark, live, old)
        for name in _names(spark, live):  # written after the old folder was parked
            _move(spark, f"{live}/{name}", f"{new}/{name}")
        fs.delete(path(live), True)
        _move(spark, new, live)
    replaced = set(note["files"][part])
    for name in _names(spark, old):  # written after the files to be replaced were listed
        if name not in replaced and not name.startswith((".", "_")):
            _move(spark, f"{old}/{name}", f"{live}/{name}")


def _finish(spark: SparkSession, root: str, version: int, note: dict) -> None:
    for part in note["files"]:
        _swap(spark, root, note, part)
    for part, names in note["written"].items():
        if missing := set(names) - set(_names(spark, f"{root}{part}")):
            raise RuntimeError(f"{len(missing)} rewritten files did not arrive in {part}; the replaced ones are kept in {note['parked']}")
    commit_snapshot(spark, root, version)
    remove(spark, note["parked"])
    remove(spark, note["staged"])


def recover(spark: SparkSession, root: str) -> int | None:
    """Completes a consolidation that broke off after it had claimed its version; the version, or None if there was none."""
    found = _open_note(spark, root)
    if not found:
        return None
    version, path = found
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    if not text.endswith("}"):  # broken off while the note was written: nothing was replaced yet
        fs, p = _fs(spark, path)
        fs.delete(p, False)
        return None
    _finish(spark, root, version, json.loads(text))
    return version


def compact_table(
    spark: SparkSession,
    root: str,
    partition_cols: list[str],
    small_bytes: int = SMALL_BYTES,
    max_small: int = 8,
    target_bytes: int = TARGET_BYTES,
    before_commit: Callable[[], None] | None = None,
) -> dict[str, int]:
    """Rewrites the partitions of a Parquet table that hold more than ``max_small`` small files.

    Returns the last version committed and the partitions, files and rows rewritten (0 partitions:
    nothing to do, no commit). Partitions are taken in rounds of ROUND, each a version of its own.
    Raises Conflict, leaving the table as it was, if another writer committed or any
    file of these partitions came, went or changed size before the version was claimed; files that come later
    stay. A consolidation under way, or broken off (see ``recover``), is a Conflict too. Files of names without
    a partition folder (an unpartitioned table) are one partition. ``before_commit``
    is called between staging and the conflict check (for tests). The rows of a
    partition are spread over its files by their place in the old ones, so a task that is repeated writes the same.
    """
    done = {"version": snapshot_version(spark, root), "partitions": 0, "files_before": 0, "rows": 0}
    while True:
        base = snapshot_version(spark, root)
        if _open_note(spark, root):
            raise Conflict("a consolidation is under way or broke off; recover() completes it")
        keep = Durable(spark, "compact")
        try:
            step = _round(spark, root, base, partition_cols, small_bytes, max_small, target_bytes, before_commit, keep)
        finally:
            keep.close()
        if not step:
            return done
        done = {"version": base + 1, **{k: done[k] + step[k] for k in ("partitions", "files_before", "rows")}}
        if step["partitions"] < ROUND:
            return done


def _round(spark, root, base, partition_cols, small_bytes, max_small, target_bytes, before_commit, keep) -> dict[str, int] | None:
    files = table_files(spark, root)
    full = files.groupBy("part").agg(
        F.count_if(F.col("size") < small_bytes).alias("small"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "size")).alias("sign")
    )
    # a partition whose files are as few as its bytes need can't be improved
    need = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(target_bytes))).cast("int")
    todo = keep.put(full.where(F.col("small") > max_small).withColumn("outs", need).where(F.col("n") > F.col("outs")).orderBy("part").limit(ROUND))
    rows = todo.collect()
    if not rows:
        return None
    named: dict[str, list[str]] = {r.part: [] for r in rows}
    chosen = F.broadcast(todo.select("part"))  # ROUND rows at most
    for r in files.join(chosen, "part", "left_semi").groupBy("part").agg(F.collect_list(F.regexp_extract("path", r"([^/]*)$", 1)).alias("names")).toLocalIterator():
        named[r.part] = r.names
    data = spark.read.option("basePath", root).parquet(*[f"{root}{r.part}" for r in rows])
    at = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))  # the metadata column has it escaped
    part_of = F.regexp_extract(F.regexp_replace(at, r"/[^/]*$", ""), r"((?:/[^/=]+=[^/]*)+)$", 1)
    # a number for every file to be written; each is one task's work
    offsets, n_out = [], 0
    for r in rows:
        offsets.append((r.part, n_out, r.outs))
        n_out += r.outs
    plan = F.broadcast(spark.createDataFrame(offsets, "_part string, _first int, _outs int"))
    spread = F.pmod(F.xxhash64("_file", "_row"), F.col("_outs").cast("long")).cast("int")
    marked = data.select("*", part_of.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    placed = marked.join(plan, "_part").withColumn("_out", F.col("_first") + spread).drop("_part", "_first", "_outs", "_file", "_row")
    staged, parked = (f"{root}/{d}/{uuid.uuid4().hex}" for d in ("_staging", "_replaced"))
    try:
        placed.repartitionById(n_out, F.col("_out")).drop("_out").write.partitionBy(*partition_cols).parquet(staged)
        counted = lambda base_: spark.read.schema(data.schema).option("basePath", base_).parquet(*[f"{base_}{r.part}" for r in rows]).groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("n"))
        before = keep.put(counted(root))
        after = keep.put(counted(staged))
        if before.exceptAll(after).count() or after.exceptAll(before).count():
            raise Conflict("the staged copy holds other rows than were read")
        n_rows = before.agg(F.sum("n")).first()[0] or 0
        if before_commit:
            before_commit()
        again = table_files(spark, root).join(chosen, "part", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "size")).alias("sign"))
        changed = todo.select("part", "n", "sign").exceptAll(again.select("part", "n", "sign")).count()
        if snapshot_version(spark, root) != base or changed:
            raise Conflict("the table changed while it was consolidated")
        note = {"staged": staged, "parked": parked, "files": named, "written": {r.part: _names(spark, f"{staged}{r.part}") for r in rows}}
        _claim(spark, f"{root}/_snapshots/{base + 1:012d}.note", json.dumps(note), f"version {base + 1} was claimed by another writer")
    except BaseException:
        remove(spark, staged)  # nothing was replaced yet
        raise
    _finish(spark, root, base + 1, note)
    return {"partitions": len(rows), "files_before": sum(r.n for r in rows), "rows": n_rows}
