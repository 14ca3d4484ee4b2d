"""FITS binary tables and images, read in parallel (one partition per file) and written for exchange.

Registered as the data source ``fits``: ``spark.read.format("fits").option("hdu", "EVENTS")
.load(path)``. The schema is that of the first file unless one is given; a file that lacks a
column asked for is an error. Only the columns of the schema are decoded. After the first
ingest tables belong in Parquet, where filters and columns are pushed into the scan.
"""

from __future__ import annotations

import glob
import math
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 2880
# Element types of the table format, most significant byte first.
_KINDS = {"L": ("i1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()), "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()), "E": (">f4", T.DoubleType()), "D": (">f8", T.DoubleType())}


@dataclass
class Hdu:
    name: str
    header: dict[str, object]
    start: int  # of the data
    size: int  # of the data, without padding


def _value(card: str) -> object:
    text = card[10:]
    if text.lstrip().startswith("'"):
        m = re.match(r"\s*'((?:[^']|'')*)'", text)
        return m[1].replace("''", "'").rstrip() if m else ""
    bare = text.split("/")[0].strip()
    if bare in ("T", "F"):
        return bare == "T"
    try:
        return int(bare)
    except ValueError:
        try:
            return float(bare.replace("D", "E"))
        except ValueError:
            return bare


def hdus(path: str) -> list[Hdu]:
    """The header-data units of a file."""
    out: list[Hdu] = []
    total = os.path.getsize(path)
    with open(path, "rb") as f:
        at = 0
        while at + BLOCK <= total:
            header: dict[str, object] = {}
            ended = False
            while not ended:
                f.seek(at)
                block = f.read(BLOCK).decode("ascii", "replace")
                if len(block) < BLOCK:
                    raise ValueError(f"{path}: the header has no end")
                at += BLOCK
                for k in range(0, BLOCK, 80):
                    card = block[k : k + 80]
                    key = card[:8].rstrip()
                    if key == "END":
                        ended = True
                        break
                    if card[8:10] == "= ":
                        header.setdefault(key, _value(card))
            if not out and "SIMPLE" not in header:
                raise ValueError(f"{path}: no FITS file")
            axes = [int(header.get(f"NAXIS{k}", 0)) for k in range(1, int(header.get("NAXIS", 0)) + 1)]
            n = abs(int(header.get("BITPIX", 8))) // 8 * math.prod(axes) if axes else 0
            n = int(header.get("GCOUNT", 1)) * (n + (int(header.get("PCOUNT", 0)) if axes else 0))
            out.append(Hdu(str(header.get("EXTNAME", "PRIMARY" if not out else "")).strip().upper(), header, at, n))
            at += -(-n // BLOCK) * BLOCK
    return out


def find(path: str, name: str) -> Hdu:
    for h in hdus(path):
        if h.name == name.upper():
            return h
    raise ValueError(f"{path}: no extension {name}")


@dataclass
class Field:
    name: str
    code: str
    repeat: int
    offset: int
    width: int
    scale: float
    zero: float

    @property
    def type(self) -> T.DataType:
        if self.code == "A":
            return T.StringType()
        if self.code == "X":
            return T.ArrayType(T.BooleanType())
        base = _KINDS[self.code][1]
        if self.scale != 1 or self.zero != 0:
            base = T.LongType() if self.code in "BIJK" and self.scale == 1 and float(self.zero).is_integer() and self.code != "K" else T.DoubleType()
        return base if self.repeat == 1 else T.ArrayType(base)


def fields(h: Hdu) -> list[Field]:
    out, at = [], 0
    for k in range(1, int(h.header["TFIELDS"]) + 1):
        m = re.match(r"(\d*)([A-Z])", str(h.header[f"TFORM{k}"]))
        repeat, code = int(m[1] or 1), m[2]
        if code not in _KINDS and code not in "AX":
            raise ValueError(f"column {h.header.get(f'TTYPE{k}')}: format {code} is not supported")
        width = -(-repeat // 8) if code == "X" else repeat * (1 if code == "A" else np.dtype(_KINDS[code][0]).itemsize)
        out.append(Field(str(h.header.get(f"TTYPE{k}", f"col{k}")).strip(), code, repeat, at, width, float(h.header.get(f"TSCAL{k}", 1)), float(h.header.get(f"TZERO{k}", 0))))
        at += width
    return out


def schema_of(h: Hdu) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.type) for f in fields(h)])


def _decode(raw: np.ndarray, f: Field) -> pa.Array:
    part = np.ascontiguousarray(raw[:, f.offset : f.offset + f.width])
    n = len(part)
    if f.code == "A":
        return pa.array([bytes(r).split(b"\0")[0].decode("utf-8", "replace").rstrip() for r in part], pa.string())
    if f.code == "X":
        bits = np.unpackbits(part, axis=1)[:, : f.repeat].astype(bool)
        return pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), f.repeat).cast(pa.list_(pa.bool_()))
    v = part.view(_KINDS[f.code][0]).reshape(n, f.repeat)
    if f.code == "L":
        v = v == ord("T")
    elif f.scale != 1 or f.zero != 0:
        v = v.astype(np.int64) + int(f.zero) if f.type in (T.LongType(), T.ArrayType(T.LongType())) else v * f.scale + f.zero
    elif f.code == "E":
        v = v.astype(np.float64)
    elif f.code == "B":
        v = v.astype(np.int16)
    v = v.astype(v.dtype.newbyteorder("="))
    if f.repeat == 1:
        return pa.array(v[:, 0])
    flat = pa.array(v.ravel())
    return pa.FixedSizeListArray.from_arrays(flat, f.repeat).cast(pa.list_(flat.type))


def read_table(path: str, name: str, columns: Sequence[str] | None = None, rows_per_batch: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of a table, mapped from the file and decoded column by column."""
    h = find(path, name)
    n, width = int(h.header["NAXIS2"]), int(h.header["NAXIS1"])
    known = {f.name: f for f in fields(h)}
    wanted = list(known) if columns is None else list(columns)
    if missing := [c for c in wanted if c not in known]:
        raise ValueError(f"{path}: no columns {missing}")
    if not n:
        return
    data = np.memmap(path, np.uint8, "r", h.start, (n, width))
    for a in range(0, n, rows_per_batch):
        raw = np.asarray(data[a : a + rows_per_batch])
        yield pa.RecordBatch.from_arrays([_decode(raw, known[c]) for c in wanted], names=wanted)


def read_image(path: str, name: str = "PRIMARY") -> tuple[np.ndarray, dict[str, object]]:
    """An image, axes in file order reversed (as rows of the last axis), with its header."""
    h = find(path, name)
    axes = [int(h.header[f"NAXIS{k}"]) for k in range(int(h.header["NAXIS"]), 0, -1)]
    kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[int(h.header["BITPIX"])]
    return np.memmap(path, kind, "r", h.start, tuple(axes)), h.header


# ---------------------------------------------------------------- writing


def _card(key: str, value: object) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        text = f"{value!r:>20}".upper() if isinstance(value, float) else f"{value:>20}"
    else:
        quoted = str(value).replace("'", "''")
        text = f"'{quoted:<8}'"
    return f"{key:<8}= {text}".ljust(80)[:80].encode("ascii")


def _padded(data: bytes, fill: bytes) -> bytes:
    return data + fill * (-len(data) % BLOCK)


def _header(cards: Sequence[tuple[str, object]]) -> bytes:
    return _padded(b"".join(_card(k, v) for k, v in cards) + b"END".ljust(80), b" ")


def write_fits(path: str, tables: dict[str, dict[str, tuple[str, object]]], image: tuple[np.ndarray, dict[str, object]] | None = None) -> None:
    """Writes binary tables {extension: {column: (format, values)}}, replacing the file in one step."""
    first: list[tuple[str, object]] = [("SIMPLE", True), ("BITPIX", -64 if image else 8), ("NAXIS", image[0].ndim if image else 0)]
    body = b""
    if image:
        first += [(f"NAXIS{k + 1}", s) for k, s in enumerate(reversed(image[0].shape))] + list(image[1].items())
        body = _padded(image[0].astype(">f8").tobytes(), b"\0")
    out = _header([*first, ("EXTEND", True)]) + body
    for name, cols in tables.items():
        parts, cards = [], []
        for k, (col, (form, values)) in enumerate(cols.items(), 1):
            m = re.match(r"(\d*)([A-Z])", form)
            repeat, code = int(m[1] or 1), m[2]
            if code == "A":
                raw = np.array([str(v).encode()[:repeat].ljust(repeat) for v in values], f"S{repeat}").view(np.uint8).reshape(len(values), repeat)
            elif code == "X":
                raw = np.packbits(np.asarray(values, bool).reshape(len(values), repeat), axis=1)
            elif code == "L":
                raw = np.where(np.asarray(values, bool), ord("T"), ord("F")).astype(np.uint8).reshape(len(values), repeat)
            else:
                raw = np.asarray(values).astype(_KINDS[code][0]).reshape(len(values), repeat).view(np.uint8).reshape(len(values), -1)
            parts.append(raw)
            cards += [(f"TTYPE{k}", col), (f"TFORM{k}", form)]
        rows = np.concatenate(parts, axis=1) if parts else np.zeros((0, 0), np.uint8)
        head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.shape[1]), ("NAXIS2", rows.shape[0]), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(cols)), *cards, ("EXTNAME", name)]
        out += _header(head) + _padded(rows.tobytes(), b"\0")
    tmp = f"{path}.tmp"
    with open(tmp, "wb") as f:
        f.write(out)
    os.replace(tmp, path)


# ---------------------------------------------------------------- data source


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _paths(options: dict) -> list[str]:
    path = options.get("path", "").removeprefix("file://")
    found = sorted(glob.glob(os.path.join(path, "**", "*.fits"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise ValueError(f"no FITS files at {path}")
    return found


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields if f.name != "file_id"]
        self.with_file = "file_id" in schema.names
        self.order = schema.names
        self.options = dict(options)
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _paths(self.options)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        for b in read_table(partition.path, self.options.get("hdu", "EVENTS"), self.columns):
            cols = {n: c for n, c in zip(self.columns, b.columns)}
            if self.with_file:
                cols["file_id"] = pa.array([partition.path] * b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([cols[n].cast(self.arrow.field(n).type) for n in self.order], schema=self.arrow)


class FitsDataSource(DataSource):
    """Tables of FITS files; a file_id column holds the path of each row's file."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> T.StructType:
        first = schema_of(find(_paths(self.options)[0], self.options.get("hdu", "EVENTS")))
        return T.StructType([*first.fields, T.StructField("file_id", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_fits(spark: SparkSession, path: str, hdu: str = "EVENTS") -> DataFrame:
    spark.dataSource.register(FitsDataSource)
    return spark.read.format("fits").option("hdu", hdu).load(path)


def schema_differences(paths: Sequence[str], hdu: str = "EVENTS") -> list[str]:
    """Files whose table differs in columns, formats or dimensions from the first one's (headers only)."""
    sign = lambda h: [(h.header.get(f"TTYPE{k}"), h.header.get(f"TFORM{k}"), h.header.get(f"TDIM{k}")) for k in range(1, int(h.header["TFIELDS"]) + 1)]
    first = sign(find(paths[0], hdu))
    return [p for p in paths[1:] if sign(find(p, hdu)) != first]


def exposure_rows(spark: SparkSession, path: str) -> DataFrame:
    """layer, iy, ix, energy, exposure of a plate-carree exposure cube (layers by rising energy)."""
    cube, head = read_image(path)
    if cube.ndim != 3 or not str(head.get("CTYPE1", "")).startswith("RA---CAR") or not str(head.get("CTYPE2", "")).startswith("DEC--CAR"):
        raise ValueError("the cube must have energy, latitude and longitude axes in a plate-carree projection")
    energy = np.concatenate([b.column(0).to_numpy() for b in read_table(path, "ENERGIES")])
    if len(energy) != cube.shape[0] or np.any(~np.isfinite(energy)) or np.any(np.diff(energy) <= 0):
        raise ValueError("the energy axis doesn't fit the cube")
    n, ny, nx = cube.shape
    values = np.asarray(cube, float).ravel()
    k = np.arange(len(values))
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"layer": k // (ny * nx), "iy": k // nx % ny, "ix": k % nx, "energy": energy[k // (ny * nx)], "exposure": values}))
