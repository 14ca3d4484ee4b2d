"""The search's clusters and their significance in the overlapping caps of many tiles, each place worked out once.

A photon lies in about a dozen caps, which see the same surroundings save near their edges. So photons are shuffled by
blocks of the sky with a margin, not by tile, and all that is counted carries for each tile what its edge takes away:
a count in a cap is the count in the sky less those pairs whose second photon the cap doesn't hold. Results are
those of ``seeding`` and ``background`` on the photons of each tile; labels and edges of clusters are told apart per tile.
Bins and bands of a block share each search for pairs, in Arrow batches, as pairs are too many for rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydrift.config import REPORT_EDGES, SearchConfig, band_label, bin_edges
from skydrift.functions import sphere, statistics
from skydrift.operators.background import CLUSTER, GOLDEN
from skydrift.operators.photons import finite
from skydrift.operators.radius_join import by_band
from skydrift.operators.seeding import eps_of
from skydrift.runtime import Durable

#: Blocks of the sky, about 25 degrees across. More photons than this are further divided by time bins.
_BLOCKS, _PER_PART = 64, 400_000
#: Tiles and sources are sent to all tasks up to these numbers, and caps up to this radius (degrees) are handled here.
_MOST_TILES, _MOST_SOURCES, _WIDEST = 5_000, 200_000, 30.0
#: Pairs looked at together, rows handed on together.
_PAIRS, _ROWS = 1 << 19, 50_000
_TIE = 1 + 1e-12


def unit(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1)


def _square(degrees) -> np.ndarray:
    """Square of the chord of an angle."""
    return 4 * np.sin(np.radians(degrees) / 2) ** 2


def _angle(square: np.ndarray) -> np.ndarray:
    return np.degrees(2 * np.arcsin(np.minimum(1.0, np.sqrt(square) / 2)))


def _centres(n: int) -> np.ndarray:
    """Directions spread evenly over the sky."""
    k = np.arange(n) + 0.5
    z, turn = 1 - 2 * k / n, 2 * math.pi * k * GOLDEN
    s = np.sqrt(1 - z * z)
    return np.stack([s * np.cos(turn), s * np.sin(turn), z], 1)


def near(q: np.ndarray, q_group: np.ndarray, p: np.ndarray, p_group: np.ndarray, reach: np.ndarray, strips: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, square of the chord) of all q x p of one group within its reach (degrees), in order of i, some at a time.

    q lies within 60 degrees of its middle. Groups of p are sorted in strips of the sky around it, ``strips`` to the reach; a place and a strip leave a range of them.
    """
    if not len(q) or not len(p):
        return
    mid = q.mean(0)
    mid /= np.linalg.norm(mid)
    pole = np.eye(3)[np.argmin(np.abs(mid))]
    north = pole - mid * (pole @ mid)
    north /= np.linalg.norm(north)
    frame = np.stack([mid, np.cross(north, mid), north], 1)
    r = np.radians(reach)
    high = r / strips
    per = int(math.pi / high.min()) + 16

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ frame
        return np.arctan2(y[:, 1], y[:, 0]), np.arcsin(np.clip(y[:, 2], -1, 1))

    u, v = place(p)
    key = p_group * float(per) + np.floor((v + math.pi / 2) / high[p_group])
    key = key * 8 + u
    order = np.argsort(key, kind="stable")
    key = key[order]
    px, py, pz = (np.ascontiguousarray(p[order, k]) for k in range(3))
    u, v = place(q)
    rq, hq = r[q_group], high[q_group]
    first = np.floor((v + math.pi / 2 - rq) / hq)
    last = np.floor((v + math.pi / 2 + rq) / hq)
    steps = int((last - first).max()) + 1
    lows, highs = [], []
    for k in range(steps):
        strip = first + k
        a, b = strip * hq - math.pi / 2, (strip + 1) * hq - math.pi / 2
        away = np.maximum(0.0, np.maximum(a - v, v - b))
        least = np.minimum(np.cos(a), np.cos(b))
        room = np.maximum(0.0, np.sin(rq / 2) ** 2 - np.sin(away / 2) ** 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            half = np.where(least > 1e-9, 2 * np.arcsin(np.minimum(1.0, np.sqrt(room / (np.cos(v) * np.maximum(least, 1e-9))))), math.pi) + 1e-7
        at = (q_group * float(per) + strip) * 8 + u
        lo = np.searchsorted(key, at - half)
        hi = np.searchsorted(key, at + half, "right")
        fine = (strip <= last) & (strip >= 0)
        lows.append(lo)
        highs.append(np.where(fine, hi, lo))
    low, many = np.stack(lows, 1), np.stack(highs, 1) - np.stack(lows, 1)
    ends = np.cumsum(many.sum(1))
    limit = _square(reach)[q_group] * _TIE
    start = 0
    while start < len(q):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        n = many[start:stop].ravel()
        total = int(n.sum())
        if total:
            begin = np.cumsum(n) - n
            j = np.repeat(low[start:stop].ravel() - begin, n) + np.arange(total)
            per_q = many[start:stop].sum(1)
            own = np.arange(start, stop)
            d = px[j] - np.repeat(q[start:stop, 0], per_q)
            d2 = d * d
            d = py[j] - np.repeat(q[start:stop, 1], per_q)
            d2 += d * d
            d = pz[j] - np.repeat(q[start:stop, 2], per_q)
            d2 += d * d
            ok = np.flatnonzero(d2 <= np.repeat(limit[start:stop], per_q))
            if len(ok):
                yield np.repeat(own, per_q)[ok], order[j[ok]], d2[ok]
        start = stop


def _words(held: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, m = held.shape
    wide = np.zeros((n, -(-max(1, m) // 64) * 64), bool)
    wide[:, :m] = held
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _bits(words: np.ndarray, m: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").view(bool)[:, :m]


def _true(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, by way of the faster one of a row."""
    return np.divmod(np.flatnonzero(held), held.shape[1])


class _Counts:
    """Counts per row and tile of pairs (i, j): what the sky holds less what the tile's cap doesn't."""

    def __init__(self, rows: np.ndarray, points: np.ndarray, tiles: int):
        self.rows, self.points, self.tiles = rows, points, tiles
        self.all, self.less = np.zeros(len(rows), np.int32), np.zeros(len(rows) * tiles, np.int32)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):  # none is left of some pairs
            return
        base = int(i[0])
        got = np.bincount(i - base)
        self.all[base : base + len(got)] += got
        for w in range(self.rows.shape[1]):
            gone = self.rows[i, w] & ~self.points[j, w]
            at = np.flatnonzero(gone)
            if len(at):
                row, tile = _true(_bits(gone[at].reshape(-1, 1), 64))
                flat = i[at][row] * self.tiles + tile + 64 * w
                base = int(flat.min())
                got = np.bincount(flat - base)
                self.less[base : base + len(got)] += got

    def get(self) -> np.ndarray:
        """rows x tiles; holds where the row has the tile."""
        return self.all[:, None] - self.less.reshape(len(self.rows), self.tiles)


class Sky:
    """What every task knows: caps, blocks, sources, groups with enough photons."""

    def __init__(self, config: SearchConfig, tiles: list, sources: list):
        self.config, self.names = config, [t[0] for t in tiles]
        place = np.array([t[1:4] for t in tiles], float).reshape(-1, 3)
        self.tiles, self.radius = unit(place[:, 0], place[:, 1]), place[:, 2]
        self.eps = np.array(eps_of(config))
        self.n_bands, self.n_bins = len(config.bands), len(bin_edges(config.bin_days)) - 1
        self.blocks = _centres(_BLOCKS)
        self.apart = np.linalg.norm(self.blocks[:, None] - self.blocks[None], axis=2) + np.eye(_BLOCKS)
        s = np.array([x[:2] for x in sources], float).reshape(-1, 2)
        self.sources = unit(s[:, 0], s[:, 1])
        self.flux = np.array([np.nan if x[2] is None else x[2] for x in sources], float)
        self.masks = np.maximum(config.mask_scale * self.eps, config.mask_least_radius)
        self.crowded: np.ndarray | None = None
        self.parts = self.tile_parts = 1

    def block_key(self, block: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return (block * self.parts + bins % self.parts).astype(np.int32)

    def tile_key(self, tile: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return (tile * self.tile_parts + bins % self.tile_parts).astype(np.int32)

    def held(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        return x @ self.tiles[which].T >= np.cos(np.radians(self.radius[which])) - 1e-15

    def tiles_near(self, x: np.ndarray) -> np.ndarray:
        """Tiles whose caps may hold some of the points."""
        mid = x.mean(0)
        size = np.linalg.norm(mid)
        if size < 1e-9:
            return np.arange(len(self.tiles))
        mid = mid / size
        wide = _angle(((x - mid) ** 2).sum(1).max())
        return np.flatnonzero(_angle(((self.tiles - mid) ** 2).sum(1)) <= self.radius + wide + 1e-6)

    def reaches(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """n x blocks: whether a block's cell (the places nearest to its centre) may be within reach (degrees) of a place."""
        d = x @ self.blocks.T
        own = d.argmax(1)
        return d[np.arange(len(x)), own][:, None] - d <= np.sin(np.radians(reach))[:, None] * self.apart[own] + 1e-12

    def zones(self, ra: np.ndarray, dec: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, ...]:
        """zone_lat, zone_lon as of seeding.zone_columns, and the middle of the zone."""
        size = np.radians(self.eps[band] * self.config.zone_scale)
        lat = np.floor((np.radians(dec) + math.pi / 2) / size)
        middle = (lat + 0.5) * size - math.pi / 2
        bins = np.maximum(1, np.ceil(2 * math.pi * np.maximum(0.05, np.abs(np.cos(middle))) / size))
        lon = np.floor(np.mod(np.radians(ra), 2 * math.pi) / (2 * math.pi) * bins)
        return lat.astype(np.int64), lon.astype(np.int64), np.degrees((lon + 0.5) / bins * 2 * math.pi), np.degrees(np.clip(middle, -math.pi / 2, math.pi / 2))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


_PACKED = "key int, data binary"


def _packed(keys: np.ndarray, kinds: np.dtype, columns: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys as one binary value: what is shuffled is told apart by its key only."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    rows, keys = np.empty(len(order), kinds), keys[order]
    for name, column in zip(kinds.names, columns):
        rows[name] = column[order]
    starts = np.flatnonzero(np.r_[True, np.diff(keys) > 0])
    data = [rows[lo:hi].tobytes() for lo, hi in zip(starts, np.r_[starts[1:], len(keys)])]
    yield pa.RecordBatch.from_arrays([pa.array(keys[starts], pa.int32()), pa.array(data, pa.binary())], names=["key", "data"])


def _by_key(batches: Iterator[pa.RecordBatch], kinds: np.dtype, work: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """work(key, columns) for each run of equal keys."""

    def done() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)
        return work(now, *[np.ascontiguousarray(rows[name]) for name in kinds.names])

    now, parts = None, []
    for batch in batches:
        for key, data in zip(*(c.to_pylist() for c in batch.columns)):
            if parts and key != now:
                yield from done()
                parts = []
            now = key
            parts.append(np.frombuffer(data, kinds))
    if parts:
        yield from done()


def _rows(names: Sequence[str], columns: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + _ROWS]) for c in columns], names=list(names))


def _group_counts(sky: Sky, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = sky.n_bins * sky.n_bands
    total = np.zeros(len(sky.tiles) * n, np.int64)
    for batch in batches:
        ra, dec, bins, band = _columns(batch)
        for k in range(0, len(ra), 10_000):
            s = slice(k, k + 10_000)
            row, tile = _true(sky.held(unit(ra[s], dec[s]), np.arange(len(sky.tiles))))
            total += np.bincount(tile * n + (bins[s] * sky.n_bands + band[s])[row], minlength=len(total))
    at = np.flatnonzero(total)
    yield from _rows(("at", "n"), (at, total[at]))


_PLACED = np.dtype([("event_id", "i8"), ("ra", "f8"), ("dec", "f8"), ("bin_index", "i4"), ("band", "i4")])


def _to_blocks(sky: Sky, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Photons once for each block that may have to look at them for the seeds of its zones."""
    c = sky.config
    reach = sky.eps * (1 + 2.5 * c.zone_scale + c.outer_scale)
    for batch in batches:
        every = _columns(batch)
        for k in range(0, len(every[0]), 10_000):
            event, ra, dec, bins, band = (x[k : k + 10_000] for x in every)
            row, block = _true(sky.reaches(unit(ra, dec), reach[band]))
            yield from _packed(sky.block_key(block, bins[row]), _PLACED, [a[row] for a in (event, ra, dec, bins, band)])


_SEEDS = np.dtype([*_PLACED.descr, ("core", "?")])


def _seeds(sky: Sky, key: int, event: np.ndarray, ra: np.ndarray, dec: np.ndarray, bins: np.ndarray, band: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cores of each tile, and its photons that have one within eps, of the zones of a block."""
    c, block = sky.config, key // sky.parts
    order = np.argsort(event, kind="stable")
    event, ra, dec, bins, band = (a[order] for a in (event, ra, dec, bins, band))
    x = unit(ra, dec)
    which = sky.tiles_near(x)
    group = bins.astype(np.int64) * sky.n_bands + band
    held = sky.held(x, which) & sky.crowded[group][:, which]
    some = held.any(1)
    if not some.any():
        return
    event, ra, dec, bins, band, x, group, held = (a[some] for a in (event, ra, dec, bins, band, x, group, held))
    tiles, words = len(which), _words(held)
    # zones, and whether they are the block's own or near enough for a photon in reach of one of its own
    lat, lon, mid_ra, mid_dec = sky.zones(ra, dec, band)
    name = (group * (int(lat.max()) + 1) + lat) * (int(lon.max()) + 1) + lon
    _, head, zone = np.unique(name, return_index=True, return_inverse=True)
    eps_z, middle = sky.eps[band[head]], unit(mid_ra[head], mid_dec[head])
    d = middle @ sky.blocks.T
    nearest = d.argmax(1)
    own_z = nearest == block
    if not own_z.any():
        return
    look_z = own_z | (d[np.arange(len(d)), nearest] - d[:, block] <= np.sin(np.radians(eps_z * (1 + 1.56 * c.zone_scale))) * sky.apart[nearest, block] + 1e-12)
    by_zone = np.argsort(zone, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(zone[by_zone]) > 0])
    all_of, any_of = (f.reduceat(words[by_zone], starts, axis=0) for f in (np.bitwise_and, np.bitwise_or))
    whole, split = _bits(all_of, tiles), _bits(any_of & ~all_of, tiles) & look_z[:, None]
    # an entry per zone for the tiles that hold all of it, and one per tile that holds a part
    full = np.flatnonzero(look_z & whole.any(1))
    part_z, part_t = _true(split)
    sizes = np.diff(np.r_[starts, len(zone)])
    entry_zone = np.r_[full, part_z]

    def members(zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[zones]
        e = np.repeat(np.arange(len(zones)), n)
        return e, by_zone[np.repeat(starts[zones] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    e, m = members(entry_zone)
    tile_of = np.r_[np.full(len(full), -1), part_t]
    keep = (tile_of[e] < 0) | held[m, np.maximum(tile_of[e], 0)]
    e, m = e[keep], m[keep]
    n_e = len(entry_zone)
    mean = np.stack([np.bincount(e, x[m, k], n_e) for k in range(3)], 1) / np.bincount(e, minlength=n_e)[:, None]
    mean /= np.linalg.norm(mean, axis=1)[:, None]
    apart = ((x[m] - mean[e]) ** 2).sum(1)
    far = np.zeros(n_e)
    np.maximum.at(far, e, apart)
    eps_e = eps_z[entry_zone]
    guarded, outer = eps_e * c.inner_scale + _angle(far), eps_e * c.outer_scale
    if (guarded >= outer).any():
        raise ValueError("a zone's guarded inner radius reaches the outer one: take smaller zones")
    seen = np.zeros((n_e, tiles), bool)
    seen[: len(full)] = whole[full]
    seen[np.arange(len(full), n_e), part_t] = True
    ring, inside = _Counts(_words(seen), words, tiles), _square(guarded)
    reach = np.tile(sky.eps, sky.n_bins)
    for i, j, d2 in near(mean, group[head][entry_zone], x, group, reach * c.outer_scale, 3):
        out = d2 > inside[i]
        ring.add(i[out], j[out])
    ratio = (1 - np.cos(np.radians(eps_e))) / (np.cos(np.radians(guarded)) - np.cos(np.radians(outer)))
    at, t = _true(seen)
    mu = ring.get()[at, t] * ratio[at]
    threshold = np.full((len(head), tiles), np.iinfo(np.int32).max, np.int32)
    threshold[entry_zone[at], t] = np.maximum(c.min_samples, np.ceil(mu + 2.5 * np.sqrt(mu) + 1))
    # neighbours of the photons looked at
    look = np.flatnonzero(look_z[zone])
    found = _Counts(words[look], words, tiles)
    for i, j, _ in near(x[look], group[look], x, group, reach):
        found.add(i, j)
    core = np.zeros_like(held)
    core[look] = held[look] & (found.get() >= threshold[zone[look]])
    core_words = _words(core)
    own = np.flatnonzero(own_z[zone])
    cores = np.flatnonzero(core.any(1))
    rest = own[(words[own] & ~core_words[own]).any(1)]
    wanted = core_words.copy()
    for i, j, _ in near(x[rest], group[rest], x[cores], group[cores], reach):
        heads = np.flatnonzero(np.r_[True, np.diff(i) > 0])
        wanted[rest[i[heads]]] |= np.bitwise_or.reduceat(core_words[cores[j]], heads, axis=0)
    row, t = _true(_bits(wanted[own] & words[own], tiles))
    p = own[row]
    yield from _packed(sky.tile_key(which[t], bins[p]), _SEEDS, (event[p], ra[p], dec[p], bins[p], band[p], core[p, t]))


def connected(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest node of its component, roots label themselves) after edges a, b joined them."""
    while len(a):
        a, b = label[a], label[b]
        more = a != b
        a, b = a[more], b[more]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := label[label], label):
            label = further
    return label


_CLUSTERS = "tile int, bin_index int, band int, label int, ra double, dec double, n_members int, n_core int"


def _clusters(sky: Sky, key: int, event: np.ndarray, ra: np.ndarray, dec: np.ndarray, bins: np.ndarray, band: np.ndarray, core: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The clusters of a tile (of some bins of it) from its cores and their surroundings."""
    order = np.argsort(event, kind="stable")
    ra, dec, bins, band, core = (a[order] for a in (ra, dec, bins, band, core.astype(bool)))
    x, group = unit(ra, dec), bins.astype(np.int64) * sky.n_bands + band
    reach = np.tile(sky.eps, sky.n_bins)
    cores, rest = np.flatnonzero(core), np.flatnonzero(~core)
    if not len(cores):
        return
    label = np.arange(len(cores))
    for i, j, _ in near(x[cores], group[cores], x[cores], group[cores], reach):
        once = i < j
        label = connected(label, i[once], j[once])
    joined, at = [cores], [label]
    for i, j, d2 in near(x[rest], group[rest], x[cores], group[cores], reach):
        heads = np.flatnonzero(np.r_[True, np.diff(i) > 0])
        least = np.repeat(np.minimum.reduceat(d2, heads), np.diff(np.r_[heads, len(i)]))
        joined.append(rest[i[heads]])
        at.append(label[np.minimum.reduceat(np.where(d2 == least, j, len(cores)), heads)])
    member, of = np.concatenate(joined), np.concatenate(at)
    o = np.argsort(member, kind="stable")  # sums in order of events, so that equal clusters of several tiles have equal places
    member, of = member[o], of[o]
    roots, of = np.unique(of, return_inverse=True)
    n = np.bincount(of)
    mean = np.stack([np.bincount(of, x[member, k]) for k in range(3)], 1) / n[:, None]
    size = np.linalg.norm(mean, axis=1)
    g = group[cores[roots]]
    o = np.lexsort((roots, g))
    starts = np.flatnonzero(np.r_[True, np.diff(g[o]) > 0])
    number = np.empty(len(o), np.int64)
    number[o] = np.arange(len(o)) - np.repeat(starts, np.diff(np.r_[starts, len(o)]))
    with np.errstate(invalid="ignore", divide="ignore"):
        c_ra = np.mod(np.degrees(np.arctan2(mean[:, 1], mean[:, 0])), 360.0)
        c_dec = np.degrees(np.arcsin(np.clip(mean[:, 2] / size, -1, 1)))
    ok = size >= 1e-12
    columns = (np.full(len(n), key // sky.tile_parts), g // sky.n_bands, g % sky.n_bands, number, c_ra, c_dec, n, np.bincount(of, core[member]).astype(np.int64))
    kinds = [np.float64 if "double" in w else np.int32 for w in _CLUSTERS.split(", ")]
    yield from _rows([w.split()[0] for w in _CLUSTERS.split(", ")], [a[ok].astype(kind) for a, kind in zip(columns, kinds)])


_LOOKED_AT = np.dtype([*[(n, "i4") for n in ("tile", "bin_index", "band", "label")], ("ra", "f8"), ("dec", "f8"), ("n_members", "i4"), ("n_core", "i4"), ("energy", "f8")])


def _to_clusters(sky: Sky, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters to the block of their centroid, photons (tile -1; band -1 outside all bands) to the blocks whose clusters may count them."""
    reach = np.append(np.maximum(sky.eps * sky.config.outer_scale, sky.eps.max()), sky.eps.max())
    for batch in batches:
        every = _columns(batch)
        for k in range(0, len(every[0]), 10_000):
            tile, bins, band, label, ra, dec, n, cores, energy = (a[k : k + 10_000] for a in every)
            hit = sky.reaches(unit(ra, dec), np.where(tile < 0, reach[band], 0.0))
            one = np.flatnonzero(tile >= 0)
            hit[one] = False
            hit[one, (unit(ra[one], dec[one]) @ sky.blocks.T).argmax(1)] = True
            row, block = _true(hit)
            yield from _packed(sky.block_key(block, bins[row]), _LOOKED_AT, [a[row] for a in (tile, bins, band, label, ra, dec, n, cores, energy)])


@lru_cache(64)
def _pattern(inner: float, outer: float, total: int) -> np.ndarray:
    """total x 3: parts along centre, north and east of directions spread evenly over a ring, as of background._ring_direction."""
    n = np.arange(total)
    a, b = math.cos(math.radians(inner)), math.cos(math.radians(outer))
    c = a - (n + 0.5) / total * (a - b)
    s = np.sqrt(np.maximum(0.0, 1 - c * c))
    turn = 2 * math.pi * np.mod((n + 0.5) * GOLDEN, 1.0)
    return np.stack([c, s * np.cos(turn), s * np.sin(turn)], 1)


def _li_ma(on: np.ndarray, off: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        both = on + off
        s = on * np.log((1 + alpha) / alpha * on / both) + np.where(off > 0, off * np.log((1 + alpha) * np.maximum(off, 1e-300) / both), 0.0)
        return np.where(on <= alpha * off, 0.0, np.sqrt(np.maximum(0.0, 2 * s)))


_SCORED = "tile int, bin_index int, band int, label int, c_ra double, c_dec double, n_members int, n_core int, n_on int, n_off int, on_region int, n_samples int, n_region int, n_retained int"
_REPORT = list(zip(REPORT_EDGES[:-1], REPORT_EDGES[1:]))


def _scores(sky: Sky, key: int, tile, bins, band, label, ra, dec, n_members, n_core, energy) -> Iterator[pa.RecordBatch]:
    """Counts and sampled areas of those clusters of a block that may be detections."""
    c = sky.config
    rows = np.flatnonzero(tile >= 0)
    if not len(rows):
        return
    ph = np.flatnonzero(tile < 0)
    xp, p_bin, p_band = unit(ra[ph], dec[ph]), bins[ph].astype(np.int64), band[ph].astype(np.int64)
    _, head, entry = np.unique(np.stack([bins[rows], band[rows], ra[rows], dec[rows]], 1), axis=0, return_index=True, return_inverse=True)
    entry = entry.ravel()
    b, place = band[rows][head].astype(np.int64), (ra[rows][head], dec[rows][head])
    x, e_bin = unit(*place), bins[rows][head].astype(np.int64)
    which = np.unique(tile[rows])
    t = np.searchsorted(which, tile[rows])
    seen = np.zeros((len(head), len(which)), bool)
    seen[entry, t] = True
    eps, mask = sky.eps[b], sky.masks[b]
    # sources: those that veto, those that mask (a photon in a ring lies in a mask that meets the ring, if in any)
    close = (x @ sky.sources.T) if len(sky.sources) else np.zeros((len(x), 0))
    sep = _angle(np.maximum(0.0, 2 - 2 * close))
    free = np.ones(len(x), bool)
    if len(sky.sources):
        limit = np.maximum(c.veto_radius, eps)
        for i, s in zip(*np.nonzero(sep < limit[:, None] + 1e-4)):
            if _angle(((x[i] - sky.sources[s]) ** 2).sum()) < limit[i]:
                free[i] = False
    with np.errstate(invalid="ignore"):
        usable = np.isfinite(sky.flux) & (sky.flux >= c.mask_least_flux) if c.mask_least_flux > 0 else np.ones(len(sky.flux), bool)
    masks = sky.sources[usable]
    meets = (sep[:, usable] < (eps * c.outer_scale + mask)[:, None]) & (sep[:, usable] + mask[:, None] > (eps * c.inner_scale)[:, None])
    held_all = sky.held(xp, which)
    ok = p_band >= 0
    xs, s_band, s_group = xp[ok], p_band[ok], p_bin[ok] * sky.n_bands + p_band[ok]
    words = _words(held_all[ok] & sky.crowded[s_group][:, which])
    covered = np.zeros(len(xs), bool)
    for i, _, _ in near(xs, s_band, np.repeat(masks, sky.n_bands, 0), np.tile(np.arange(sky.n_bands), len(masks)), sky.masks):
        covered[i] = True
    on, off = _Counts(_words(seen), words, len(which)), _Counts(_words(seen), words, len(which))
    core, hole = _square(eps) * _TIE, _square(eps * c.inner_scale) / _TIE
    at = np.flatnonzero(free)
    for i, j, d2 in near(x[at], e_bin[at] * sky.n_bands + b[at], xs, s_group, np.tile(sky.eps * c.outer_scale, sky.n_bins), 3):
        i = at[i]
        near_ = d2 <= core[i]
        on.add(i[near_], j[near_])
        ring = (d2 >= hole[i]) & ~covered[j]
        off.add(i[ring], j[ring])
    n_on, n_off = on.get()[entry, t], off.get()[entry, t]
    todo = np.flatnonzero(free[entry] & (n_on > 0) & (n_off >= c.least_off))
    edge = _angle(np.maximum(0.0, ((x[entry] - sky.tiles[which[t]]) ** 2).sum(1)))
    a, d = np.radians(place[0]), np.radians(place[1])
    basis = np.stack([x, np.stack([-np.sin(d) * np.cos(a), -np.sin(d) * np.sin(a), np.cos(d)], 1), np.stack([-np.sin(a), np.cos(a), np.zeros(len(a))], 1)], 1)
    on_region = np.full(len(rows), c.area_samples)
    samples, region, retained = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    radius = sky.radius[which[t]]
    caps, rims = sky.tiles[which], np.cos(np.radians(sky.radius[which]))

    def in_caps(entry: int, pattern: np.ndarray, ts: np.ndarray) -> np.ndarray:
        return pattern @ (basis[entry] @ caps[ts].T) >= rims[ts]

    todo = todo[np.argsort(entry[todo], kind="stable")]
    for own in np.split(todo, np.flatnonzero(np.diff(entry[todo])) + 1) if len(todo) else ():
        k = int(entry[own[0]])
        inner, outer = float(eps[k]) * c.inner_scale, float(eps[k]) * c.outer_scale
        cut = own[edge[own] > radius[own] - eps[k] - 1e-6]
        if len(cut):
            on_region[cut] = in_caps(k, _pattern(0.0, float(eps[k]), c.area_samples), t[cut]).sum(0)
        discs, cos = basis[k] @ masks[meets[k]].T, math.cos(math.radians(mask[k]))
        n, live = c.area_samples, own
        while len(live):
            clear = edge[live] <= radius[live] - outer - 1e-6
            inside = live[~clear]
            samples[live], region[live], retained[live] = n, n, n
            if discs.shape[1] or len(inside):
                pattern = _pattern(inner, outer, n)
                bare = ~(pattern @ discs >= cos).any(1) if discs.shape[1] else np.ones(n, bool)
                retained[live] = bare.sum()
                if len(inside):
                    held = in_caps(k, pattern, t[inside])
                    region[inside], retained[inside] = held.sum(0), (held & bare[:, None]).sum(0)
            share = retained[live] / n
            with np.errstate(all="ignore"):
                ratio = np.where((share <= 0) | (share >= 1), 0.0, np.sqrt(share * (1 - share) / n) / share * np.sqrt(n_off[live]))
            n *= 2
            live = live[ratio > c.max_area_ratio] if n <= c.max_area_samples else live[:0]
    todo = todo[(on_region[todo] > 0) & (retained[todo] > 0)]
    # what is far from being a detection goes no further; the rest is judged by the formulas all searches share
    e = eps[entry[todo]]
    cap = lambda deg: 1 - np.cos(np.radians(deg))
    alpha = cap(e) * on_region[todo] / c.area_samples / ((cap(e * c.outer_scale) - cap(e * c.inner_scale)) * retained[todo] / samples[todo])
    todo = todo[_li_ma(n_on[todo].astype(float), n_off[todo].astype(float), alpha) >= c.min_sigma - 1e-6]
    # photons of all bands near them
    apertures = np.zeros((len(rows), len(_REPORT)), np.int64)
    all_words = _words(held_all)
    report = np.searchsorted(REPORT_EDGES, energy[ph], "right") - 1
    for k in np.unique(b[entry[todo]]):
        mine = np.unique(entry[todo][b[entry[todo]] == k])
        for r in range(len(_REPORT)):
            sub = np.flatnonzero(report == r)
            found = _Counts(_words(seen[mine]), all_words[sub], len(which))
            for i, j, _ in near(x[mine], e_bin[mine], xp[sub], p_bin[sub], np.full(sky.n_bins, sky.eps[k])):
                found.add(i, j)
            its = todo[b[entry[todo]] == k]
            apertures[its, r] = found.get()[np.searchsorted(mine, entry[its]), t[its]]
    names = [w.split()[0] for w in _SCORED.split(", ")] + [f"r{r}" for r in range(len(_REPORT))]
    ints = [tile[rows], bins[rows], band[rows], label[rows]], [n_members[rows], n_core[rows], n_on, n_off, on_region, samples, region, retained, *apertures.T]
    yield from _rows(names, [*(v[todo].astype(np.int32) for v in ints[0]), ra[rows][todo], dec[rows][todo], *(v[todo].astype(np.int32) for v in ints[1])])


def fits(region: DataFrame, catalogue: DataFrame, config: SearchConfig) -> Sky | None:
    """The caps and sources for all tasks, unless they are too many or too wide; caps and sources without a place are left out."""
    tiles = region.where(finite(F.col("ra_degrees"), F.col("dec_degrees"), F.col("analysis_radius_degrees"))).select("tile_id", "ra_degrees", "dec_degrees", "analysis_radius_degrees")
    got = tiles.distinct().limit(_MOST_TILES + 1).collect()
    far = catalogue.select("ra", "dec", "flux1000").where(finite(F.col("ra"), F.col("dec"))).distinct().limit(_MOST_SOURCES + 1).collect()
    odd = not got or len(got) > _MOST_TILES or len(far) > _MOST_SOURCES or max(t[3] for t in got) > _WIDEST or len({t[0] for t in got}) < len(got)
    if odd or None in {t[0] for t in got} or max(eps_of(config)) * max(config.outer_scale + 1 + 2.5 * config.zone_scale, 1) > 30:
        return None
    return Sky(config, sorted(got), far)


def detections(every: DataFrame, sky: Sky) -> DataFrame:
    """Detections of all caps with photons_per_band, as of background.detections and aperture_counts.

    every: event_id (unique), ra, dec, energy, bin_index, band (null outside all bands), each photon once.
    """
    spark, c = every.sparkSession, sky.config
    keep = Durable(spark, "caps")
    tasks = max(48, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = every.where(finite(F.col("ra"), F.col("dec")) & (F.abs("dec") <= 90))
    seeds = every.where("band is not null")
    counts = seeds.select("ra", "dec", "bin_index", "band").mapInArrow(lambda it, s=spark.sparkContext.broadcast(sky): _group_counts(s.value, it), "at long, n long")
    found = counts.groupBy("at").agg(F.sum("n").alias("n")).collect()
    groups = sky.n_bins * sky.n_bands
    crowded = np.zeros(len(sky.tiles) * groups, bool)
    crowded[[r.at for r in found if r.n >= c.least_photons]] = True
    sky.crowded = np.ascontiguousarray(crowded.reshape(len(sky.tiles), groups).T)
    # a photon lies in some dozen caps; of a tile only cores and what is near them are looked at
    sky.parts = max(1, min(sky.n_bins, math.ceil(sum(r.n for r in found) / 11 / _PER_PART)))
    sky.tile_parts = math.ceil(sky.parts / 8)
    sent = spark.sparkContext.broadcast(sky)

    def placed(df: DataFrame, place: Callable) -> DataFrame:
        return df.mapInArrow(lambda it: place(sent.value, it), _PACKED)

    def worked(packed: DataFrame, kinds: np.dtype, work: Callable, out: str) -> DataFrame:
        rows = packed.repartition(tasks, "key").sortWithinPartitions("key")
        return rows.mapInArrow(lambda it: _by_key(it, kinds, lambda key, *a: work(sent.value, key, *a)), out)

    seeded = worked(placed(seeds.select("event_id", "ra", "dec", "bin_index", "band"), _to_blocks), _PLACED, _seeds, _PACKED)
    clusters = keep.put(worked(seeded, _SEEDS, _clusters, _CLUSTERS))
    none = F.lit(-1)
    photons = every.select(none.alias("tile"), "bin_index", F.coalesce("band", none).alias("band"), none.alias("label"), "ra", "dec", none.alias("n_members"), none.alias("n_core"), "energy")
    both = photons.unionByName(clusters.withColumn("energy", F.lit(0.0)).select(photons.columns))
    scored = worked(placed(both, _to_clusters), _LOOKED_AT, _scores, _SCORED + "".join(f", r{r} int" for r in range(len(_REPORT))))
    eps = by_band(list(sky.eps))
    inner, outer = eps * c.inner_scale, eps * c.outer_scale
    share = lambda n, of: F.col(n) / of.cast("double")
    names = F.array(*[F.lit(n) for n in sky.names])
    s = scored.withColumn("tile_id", F.element_at(names, F.col("tile") + 1)).withColumn("eps", eps)
    s = s.withColumn("on_area", sphere.ring_area_deg2(F.lit(0.0), eps) * share("on_region", F.lit(c.area_samples)))
    s = s.withColumn("off_area", sphere.ring_area_deg2(inner, outer) * share("n_retained", F.col("n_samples")))
    s = s.withColumn("masked_fraction", F.when(F.col("n_region") > 0, (F.col("n_region") - F.col("n_retained")) / F.col("n_region")).otherwise(0.0))
    s = s.withColumn("alpha", F.when(F.col("off_area") > 0, F.col("on_area") / F.col("off_area"))).where("on_area > 0")
    s = s.withColumn("expected_bg", F.col("alpha") * F.col("n_off")).withColumn("sigma", F.coalesce(statistics.li_ma(F.col("n_on"), F.col("n_off"), F.col("alpha")), F.lit(0.0)))
    stable = (F.col("off_area") >= 1e-10) & (1 - F.col("masked_fraction") >= c.least_unmasked) & (F.col("n_off") >= c.least_off)
    s = s.withColumn("stable", F.coalesce(stable, F.lit(False))).where(F.col("stable") & (F.col("sigma") >= c.min_sigma))
    entries = [v for r, (lo, hi) in enumerate(_REPORT) for v in (F.lit(band_label(lo, hi)), F.col(f"r{r}"))]
    s = s.withColumn("photons_per_band", F.create_map(*entries))
    cols = ("c_ra", "c_dec", "n_members", "n_core", "n_on", "n_off", "on_area", "n_samples", "n_region", "n_retained", "off_area", "masked_fraction", "alpha", "expected_bg", "sigma", "stable", "eps", "photons_per_band")
    return s.select(*CLUSTER, *cols)
