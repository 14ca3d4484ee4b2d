"""Points near other points or regions, and the cell of a partition of the sky that holds them.

A quadtree over (ra, dec) is grown from a bounded sample of the points, so that its leaves
hold about equally many. Every point belongs to exactly one leaf; every region is replicated
to all leaves its bounding box meets. In each leaf the regions' boxes are bulk-loaded into a
packed R-tree, a batch of points is sent down it, and what arrives is refined by the exact
great-circle distance. A pair is reported in the leaf, and by the half of a box wrapped at
RA 0, that holds its reference point (the point itself), so none is reported twice.

Regions no more numerous than ``max_broadcast`` (checked, not assumed) are sent to the points,
which then need no shuffle at all. Beyond that both sides are shuffled by leaf, and a leaf that
is expected to hold more than ``rows_per_task`` points is salted, its regions going to each
salt, so that no task grows with the data or with a crowded spot of the sky.

Points with null, NaN or infinite coordinates or |dec| > 90 are in no leaf and never come out;
RA counts modulo 360. Regions need a usable centre and, for discs, a radius that is not null,
NaN or negative. Repeated regions (equal in name, place and radius) count once. Empty sides
give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 14
FANOUT = 16


# ---------------------------------------------------------------- quadtree


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of v moved to the even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def z_order(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    n = 1 << LEVELS
    x = np.clip((ra * (n / 360.0)).astype(np.int64), 0, n - 1)
    y = np.clip(((dec + 90.0) * (n / 180.0)).astype(np.int64), 0, n - 1)
    return (_spread(x) | (_spread(y) << np.uint64(1))).astype(np.int64)


@dataclass
class QuadTree:
    """Leaves as intervals of the Z-order: first code and level of each, with its box."""

    start: np.ndarray
    level: np.ndarray
    share: np.ndarray  # of the sampled points

    @classmethod
    def grow(cls, ra: np.ndarray, dec: np.ndarray, leaves: int = 512, least_level: int = 4) -> QuadTree:
        codes = np.sort(z_order(ra, dec))
        most = max(1, math.ceil(len(codes) / max(1, leaves)))
        out: list[tuple[int, int, int]] = []
        stack = [(0, 0)]
        while stack:
            first, level = stack.pop()
            span = 1 << (2 * (LEVELS - level))
            n = int(np.searchsorted(codes, first + span) - np.searchsorted(codes, first))
            if level < least_level or (n > most and level < LEVELS):
                stack.extend((first + k * (span >> 2), level + 1) for k in range(4))
            else:
                out.append((first, level, n))
        out.sort()
        a = np.array(out, dtype=np.int64)
        return cls(a[:, 0], a[:, 1], a[:, 2] / max(1, len(codes)))

    def leaf_of(self, ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, z_order(ra, dec), side="right") - 1

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = np.zeros(len(self.start))
        y = np.zeros(len(self.start))
        for bit in range(LEVELS):
            x += ((self.start >> (2 * bit)) & 1) * float(1 << bit)
            y += ((self.start >> (2 * bit + 1)) & 1) * float(1 << bit)
        n, side = float(1 << LEVELS), 2.0 ** (LEVELS - self.level)
        return x * 360 / n, (x + side) * 360 / n, y * 180 / n - 90, (y + side) * 180 / n - 90


# ---------------------------------------------------------------- geometry


def separation(ra1, dec1, ra2, dec2):
    """Great-circle distance in degrees (haversine)."""
    r1, d1, r2, d2 = (np.radians(v) for v in (ra1, dec1, ra2, dec2))
    h = np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin((r2 - r1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.minimum(1.0, np.sqrt(h))))


def disc_boxes(ra: np.ndarray, dec: np.ndarray, radius: np.ndarray):
    """Bounding boxes of discs in the (ra, dec) plane, cut at RA 0: (disc, x0, x1, y0, y1)."""
    slack = 1e-9
    r = np.minimum(radius + slack, 180.0)
    y0, y1 = np.maximum(dec - r, -90.0), np.minimum(dec + r, 90.0)
    s = np.sin(np.radians(np.minimum(r, 90.0)))
    c = np.cos(np.radians(dec))
    polar = (dec + r >= 90) | (dec - r <= -90) | (s >= c)
    half = np.where(polar, 180.0, np.degrees(np.arcsin(np.clip(np.where(polar, 0.0, s / np.where(c == 0, 1, c)), 0, 1))) + slack)
    i = np.arange(len(ra))
    x0, x1 = np.where(half >= 180, 0.0, ra - half), np.where(half >= 180, 360.0, ra + half)
    under, over = x0 < 0, x1 > 360
    parts = [
        (i, np.maximum(x0, 0.0), np.minimum(x1, 360.0), y0, y1),
        (i[under], x0[under] + 360, np.full(under.sum(), 360.0), y0[under], y1[under]),
        (i[over], np.zeros(over.sum()), x1[over] - 360, y0[over], y1[over]),
    ]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


# ---------------------------------------------------------------- packed R-trees


@dataclass
class Forest:
    """One packed R-tree per leaf of the quadtree, all in common arrays."""

    root: np.ndarray  # leaf -> node, -1: none
    box: np.ndarray  # node boxes, 4 x nodes
    first: np.ndarray
    count: np.ndarray
    low: np.ndarray  # node points to entries, not to nodes
    entry_box: np.ndarray  # 4 x entries
    entry: np.ndarray  # entry -> region

    @classmethod
    def load(cls, n_leaves: int, leaf: np.ndarray, region: np.ndarray, box: np.ndarray) -> Forest:
        order = np.argsort(leaf, kind="stable")
        leaf, region, box = leaf[order], region[order], box[:, order]
        bounds = np.searchsorted(leaf, np.arange(n_leaves + 1))
        root = np.full(n_leaves, -1, dtype=np.int64)
        nb: list[np.ndarray] = []
        nf: list[np.ndarray] = []
        nc: list[np.ndarray] = []
        nl: list[np.ndarray] = []
        perm = np.arange(len(leaf))
        made = 0
        for q in np.unique(leaf):
            a, b = bounds[q], bounds[q + 1]
            n = b - a
            cx, cy = box[0, a:b] + box[1, a:b], box[2, a:b] + box[3, a:b]
            slices = max(1, math.ceil(math.sqrt(n / FANOUT)))
            rank = np.argsort(np.argsort(cx, kind="stable"), kind="stable")
            o = np.lexsort((cy, rank // max(1, math.ceil(n / slices))))
            perm[a:b] = a + o
            part, first, low = box[:, a:b][:, o], a, True
            while True:
                cut = np.arange(0, part.shape[1], FANOUT)
                up = np.stack([np.minimum.reduceat(part[0], cut), np.maximum.reduceat(part[1], cut), np.minimum.reduceat(part[2], cut), np.maximum.reduceat(part[3], cut)])
                nb.append(up)
                nf.append(first + cut)
                nc.append(np.diff(np.append(cut, part.shape[1])))
                nl.append(np.full(len(cut), low))
                first, low, part = made, False, up
                made += len(cut)
                if len(cut) == 1:
                    break
            root[q] = made - 1
        none = np.zeros(0)
        return cls(
            root,
            np.concatenate(nb, axis=1) if nb else np.zeros((4, 0)),
            np.concatenate(nf) if nf else none.astype(np.int64),
            np.concatenate(nc) if nc else none.astype(np.int64),
            np.concatenate(nl) if nl else none.astype(bool),
            box[:, perm],
            region[perm],
        )

    def probe(self, leaf: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, region) for every box that holds the point; boxes are open at x1."""
        pt = np.arange(len(x))
        node = self.root[leaf]
        pt, node = pt[node >= 0], node[node >= 0]
        out_p, out_r = [], []
        while len(pt):
            b = self.box[:, node]
            px, py = x[pt], y[pt]
            ok = (px >= b[0]) & (px <= b[1]) & (py >= b[2]) & (py <= b[3])
            pt, node = pt[ok], node[ok]
            count, first = self.count[node], self.first[node]
            total = int(count.sum())
            child = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else first, count) + np.arange(total)
            cp, low = np.repeat(pt, count), np.repeat(self.low[node], count)
            e, ep = child[low], cp[low]
            eb = self.entry_box[:, e]
            px, py = x[ep], y[ep]
            ok = (px >= eb[0]) & ((px < eb[1]) | (eb[1] >= 360)) & (py >= eb[2]) & (py <= eb[3])
            out_p.append(ep[ok])
            out_r.append(self.entry[e[ok]])
            pt, node = cp[~low], child[~low]
        if not out_p:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_p), np.concatenate(out_r)


def replicate(tree: QuadTree, region: np.ndarray, box: np.ndarray, chunk: int = 2048):
    """(leaf, row of box) for every leaf a box meets."""
    x0, x1, y0, y1 = tree.boxes()
    leaf, row = [], []
    for a in range(0, len(region), chunk):
        b = box[:, a : a + chunk]
        meet = (b[0][:, None] < x1) & (b[1][:, None] >= x0) & (b[2][:, None] < y1 + 1e-12) & (b[3][:, None] >= y0 - 1e-12)
        r, q = np.nonzero(meet)
        leaf.append(q)
        row.append(r + a)
    return (np.concatenate(leaf), np.concatenate(row)) if leaf else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class DiscIndex:
    """Discs, found with every point they hold."""

    tree: QuadTree
    ra: np.ndarray
    dec: np.ndarray
    radius: np.ndarray
    forest: Forest = field(init=False)

    def __post_init__(self) -> None:
        disc, *box = disc_boxes(self.ra, self.dec, self.radius)
        box = np.stack(box) if len(disc) else np.zeros((4, 0))
        leaf, row = replicate(self.tree, disc, box)
        self.forest = Forest.load(len(self.tree.start), leaf, disc[row], box[:, row])

    def find(self, leaf: np.ndarray, ra: np.ndarray, dec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, r = self.forest.probe(leaf, ra, dec)
        ok = separation(ra[p], dec[p], self.ra[r], self.dec[r]) <= self.radius[r]
        return p[ok], r[ok]


def _unit(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=-1)


@dataclass
class CellIndex:
    """Cells given by their centres: the part of the sky nearer to one centre than to any other.

    No point of a leaf is farther from its centre than the leaf's own middle is from its
    nearest centre plus half the leaf, so the discs of that radius hold the right cell.
    """

    tree: QuadTree
    ra: np.ndarray
    dec: np.ndarray
    forest: Forest = field(init=False)

    def __post_init__(self) -> None:
        x0, x1, y0, y1 = self.tree.boxes()
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        half = (x1 - x0) / 2 * np.cos(np.radians(cy)) + (y1 - y0) / 2
        leaf, region, boxes = [], [], []
        if len(self.ra):
            for q in range(len(cx)):
                d = separation(cx[q], cy[q], self.ra, self.dec)
                reach = d.min() + half[q] + 1e-7
                near = np.nonzero(d <= reach + half[q])[0]
                disc, *box = disc_boxes(self.ra[near], self.dec[near], np.full(len(near), reach))
                box = np.stack(box)
                meet = (box[0] < x1[q]) & (box[1] >= x0[q]) & (box[2] <= y1[q]) & (box[3] >= y0[q])
                leaf.append(np.full(meet.sum(), q))
                region.append(near[disc[meet]])
                boxes.append(box[:, meet])
        self.forest = Forest.load(
            len(cx),
            np.concatenate(leaf) if leaf else np.zeros(0, np.int64),
            np.concatenate(region) if region else np.zeros(0, np.int64),
            np.concatenate(boxes, axis=1) if boxes else np.zeros((4, 0)),
        )
        self.unit = _unit(self.ra, self.dec)

    def find(self, leaf: np.ndarray, ra: np.ndarray, dec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, r = self.forest.probe(leaf, ra, dec)
        dot = np.einsum("ij,ij->i", _unit(ra[p], dec[p]), self.unit[r])
        order = np.lexsort((r, -dot, p))
        p, r = p[order], r[order]
        first = np.ones(len(p), bool)
        first[1:] = p[1:] != p[:-1]
        return p[first], r[first]


# ---------------------------------------------------------------- operators


def usable_points(points: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows with finite coordinates and |dec| <= 90, RA brought to [0, 360)."""
    a, d = F.col(ra).cast("double"), F.col(dec).cast("double")
    turned = F.pmod(a, F.lit(360.0))
    return (
        points.where(a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))) & d.isNotNull() & ~F.isnan(d) & (F.abs(d) <= 90))
        .withColumn(ra, F.when(turned >= 360.0, F.lit(0.0)).otherwise(turned))
        .withColumn(dec, d)
    )


def grow_quadtree(points: DataFrame, ra: str = "ra", dec: str = "dec", sample_rows: int = 100_000, leaves: int = 512) -> QuadTree:
    """A tree from a sample of about ``sample_rows`` points, four times as many at most.

    The rate is set by the size Catalyst expects of the points, so one scan is enough. The sample
    steers the partitioning only; no result depends on it.
    """
    rows = points.select(ra, dec)
    # two doubles and a header per row, and a file takes less
    expected = float(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) / 16
    share = min(1.0, sample_rows / max(1.0, expected))
    got = (rows if share >= 1 else rows.sample(False, share, 11)).limit(4 * sample_rows).toPandas()
    return QuadTree.grow(got[ra].to_numpy(float), got[dec].to_numpy(float), leaves)


def _bounded(regions: DataFrame, most: int) -> pd.DataFrame | None:
    got = regions.limit(most + 1).toPandas()
    return None if len(got) > most else got


def _regions(regions: DataFrame, name: str, ra: str, dec: str, radius: str | None) -> DataFrame:
    cols = [F.col(name).cast("string").alias("_name"), F.col(ra).alias("_ra"), F.col(dec).alias("_dec")]
    if radius:
        cols.append(F.col(radius).cast("double").alias("_radius"))
    out = usable_points(regions.select(*cols), "_ra", "_dec").where("_name is not null")
    if radius:
        out = out.where("_radius is not null and not isnan(_radius) and _radius >= 0")
    return out.distinct().orderBy("_name") if not radius else out.distinct()


def near_regions(
    points: DataFrame,
    keep: Sequence[str],
    discs: DataFrame | None = None,
    disc_cols: tuple[str, str, str, str] = ("name", "ra", "dec", "radius"),
    cells: DataFrame | None = None,
    cell_cols: tuple[str, str, str] = ("name", "ra", "dec"),
    recorded: str | None = None,
    ra: str = "ra",
    dec: str = "dec",
    sample_rows: int = 100_000,
    leaves: int = 512,
    max_broadcast: int = 200_000,
    rows_per_task: int = 200_000,
) -> DataFrame:
    """keep..., near_kind ('disc' or 'cell'), target: what each point lies in.

    discs: every disc whose radius (degrees, included) reaches the point. cells: the one cell
    that holds the point; with ``recorded`` only where that column of the point is null or
    names another cell. ``keep`` names columns of the points that are passed on.
    """
    spark = points.sparkSession
    side = [c for c in dict.fromkeys([*keep, *([recorded] if recorded else [])])]
    pts = usable_points(points.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(side)], F.col(ra).alias("_ra"), F.col(dec).alias("_dec")), "_ra", "_dec")
    tree = grow_quadtree(pts, "_ra", "_dec", sample_rows, leaves)
    types = [pts.schema[f"k_{i}"].dataType for i in range(len(side))]
    rec = side.index(recorded) if recorded else -1
    n_keep = len(keep)
    schema = T.StructType([*[T.StructField(f"k_{i}", types[i]) for i in range(n_keep)], T.StructField("near_kind", T.StringType()), T.StructField("target", T.StringType())])
    disc_df = _regions(discs, disc_cols[0], disc_cols[1], disc_cols[2], disc_cols[3]) if discs is not None else None
    cell_df = _regions(cells, cell_cols[0], cell_cols[1], cell_cols[2], None) if cells is not None else None
    parts: list[DataFrame] = []
    sent: dict[str, tuple] = {}
    for kind, df in (("disc", disc_df), ("cell", cell_df)):
        if df is None:
            continue
        local = _bounded(df, max_broadcast)
        if local is None:
            parts.append(_shuffled(pts, tree, df, kind, n_keep, rec, schema, rows_per_task))
            continue
        local = local.sort_values("_name").drop_duplicates(["_name", "_ra", "_dec", *(["_radius"] if kind == "disc" else [])])
        args = (tree, local["_ra"].to_numpy(float), local["_dec"].to_numpy(float))
        index = DiscIndex(*args, local["_radius"].to_numpy(float)) if kind == "disc" else CellIndex(*args)
        sent[kind] = (index, local["_name"].tolist())
    if sent:
        box = spark.sparkContext.broadcast((tree, sent))

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sent = box.value
            for batch in batches:
                x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_ra", "_dec"))
                leaf = tree.leaf_of(x, y)
                for kind, (index, names) in sent.items():
                    yield from _answers(batch, kind, *index.find(leaf, x, y), names, n_keep, rec)

        parts.append(pts.mapInArrow(locate, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "near_kind", "target")


def _answers(batch, kind: str, p: np.ndarray, r: np.ndarray, names: list[str], n_keep: int, rec: int):
    if kind == "cell" and rec >= 0 and len(p):
        import pyarrow.compute as pc

        at = pc.index_in(batch.column(f"k_{rec}").cast(pa.string()), value_set=pa.array(names, pa.string()))
        told = at.fill_null(-1).to_numpy(zero_copy_only=False)
        other = told[p] != r
        p, r = p[other], r[other]
    if not len(p):
        return
    rows = pa.array(p)
    target = pa.array(names, pa.string()).take(pa.array(r))
    cols = [batch.column(f"k_{i}").take(rows) for i in range(n_keep)]
    yield pa.RecordBatch.from_arrays([*cols, pa.array([kind] * len(p), pa.string()), target], names=[*[f"k_{i}" for i in range(n_keep)], "near_kind", "target"])


def _shuffled(pts: DataFrame, tree: QuadTree, regions: DataFrame, kind: str, n_keep: int, rec: int, schema: T.StructType, rows_per_task: int) -> DataFrame:
    """The same for regions too many to be sent whole: both sides meet by (leaf, salt)."""
    spark = pts.sparkSession
    salts = np.maximum(1, np.ceil(tree.share * pts.count() / rows_per_task)).astype(int)
    # rows x leaves distances at once, in blocks of bounded size
    blocks = lambda n: [slice(k, k + 2048) for k in range(0, n, 2048)]
    x0, x1, y0, y1 = tree.boxes()
    reach = None
    if kind == "cell":
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        half = (x1 - x0) / 2 * np.cos(np.radians(cy)) + (y1 - y0) / 2

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = np.full(len(cx), np.inf)
            for b in batches:
                a, d = b["_ra"].to_numpy(float), b["_dec"].to_numpy(float)
                for k in blocks(len(a)):
                    np.minimum(best, separation(cx[None], cy[None], a[k, None], d[k, None]).min(axis=0), out=best)
            yield pd.DataFrame({"leaf": np.arange(len(cx)), "d": best})

        # one row per leaf: bounded by the number of leaves
        got = regions.mapInPandas(nearest, "leaf int, d double").groupBy("leaf").agg(F.min("d").alias("d")).toPandas()
        reach = np.full(len(cx), np.inf)
        reach[got["leaf"].to_numpy()] = got["d"].to_numpy()
        reach = np.where(np.isfinite(reach), reach, 0) + half + 1e-7

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ra, dec = b["_ra"].to_numpy(float), b["_dec"].to_numpy(float)
            if kind == "disc":
                disc, *box = disc_boxes(ra, dec, b["_radius"].to_numpy(float))
                leaf, row = replicate(tree, disc, np.stack(box))
                pair = np.unique(np.stack([leaf, disc[row]]), axis=1)
            else:
                near = [np.nonzero(separation(cx[None], cy[None], ra[k, None], dec[k, None]) <= reach + half) for k in blocks(len(ra))]
                r = np.concatenate([f[0] + 2048 * n for n, f in enumerate(near)]) if near else np.zeros(0, int)
                q = np.concatenate([f[1] for f in near]) if near else np.zeros(0, int)
                pair = np.stack([q, r])
            n = salts[pair[0]]
            leaf, row = np.repeat(pair[0], n), np.repeat(pair[1], n)
            salt = np.arange(len(leaf)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else leaf
            yield b.iloc[row].assign(leaf=leaf.astype(np.int32), salt=salt.astype(np.int32)).reset_index(drop=True)

    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in regions.schema)
    right = regions.mapInPandas(spread, f"{cols}, leaf int, salt int")
    shape = T.StructType([*pts.schema.fields, T.StructField("leaf", T.IntegerType()), T.StructField("salt", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_ra", "_dec"))
            leaf = tree.leaf_of(x, y)
            # from the row itself: a task that is repeated salts it alike
            salt = (b.column("_row").to_numpy(zero_copy_only=False) >> 7) % salts[leaf]
            b = b.select([f for f in b.schema.names if f != "_row"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32)), pa.array(salt.astype(np.int32))], names=[*b.schema.names, "leaf", "salt"])

    from pyspark.sql.types import MapType

    plain = [c for c in pts.columns if not isinstance(pts.schema[c].dataType, MapType)]
    left = pts.withColumn("_row", F.xxhash64(*plain)).mapInArrow(assign, shape)

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        q = int(key[0].as_py())
        empty = pa.Table.from_batches([], schema=out_schema)
        if not a.num_rows or not b.num_rows:
            return empty
        batch = a.combine_chunks().to_batches()[0]
        one = QuadTree(tree.start[q : q + 1], tree.level[q : q + 1], tree.share[q : q + 1])
        b = b.sort_by("_name")
        names = b.column("_name").to_pylist()
        args = (one, b.column("_ra").to_numpy(), b.column("_dec").to_numpy())
        index = DiscIndex(*args, b.column("_radius").to_numpy()) if kind == "disc" else CellIndex(*args)
        x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_ra", "_dec"))
        got = list(_answers(batch, kind, *index.find(np.zeros(len(x), np.int64), x, y), names, n_keep, rec))
        return pa.Table.from_batches(got, schema=out_schema) if got else empty

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)
    return left.groupBy("leaf", "salt").cogroup(right.groupBy("leaf", "salt")).applyInArrow(meet, schema)


def photon_surroundings(photons: DataFrame, catalogue: DataFrame, tiles: DataFrame, **how) -> DataFrame:
    """run_id, event_id, near_kind, target: the sources each photon lies near, and its right tile.

    ids are the low 32 bits; near_kind 'source' for every source within its mask radius,
    'tile' where the recorded tile is null or not the one whose region holds the photon.
    """
    from skydrift.operators.skew import low32

    rows = photons.where("run_id is not null and event_id is not null").select(
        low32(F.col("run_id")).alias("run_id"), low32(F.col("event_id")).alias("event_id"), "ra", "dec", "tile_id"
    )
    out = near_regions(
        rows,
        ["run_id", "event_id"],
        catalogue,
        ("source_name", "ra", "dec", "mask_radius_degrees"),
        tiles,
        ("tile_id", "ra_degrees", "dec_degrees"),
        recorded="tile_id",
        **how,
    )
    kind = F.when(F.col("near_kind") == "disc", F.lit("source")).otherwise(F.lit("tile"))
    return out.withColumn("near_kind", kind).distinct()
