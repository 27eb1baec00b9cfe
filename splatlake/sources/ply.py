"""PLY splat files: header, a Spark data source that reads row ranges in parallel, and a writer.

``spark.read.format("splat_ply").load(path)`` (after ``register(spark)``) gives splat_id and one column for each vertex
property; option ``columns`` prunes them in the reader.  Binary files are split by rows; ASCII files are one partition,
since their tokens follow no lines.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from ..functions import canonical as C

# Scalar names, their numpy types and Spark types.
TYPES = {
    "char": ("i1", ByteType()), "int8": ("i1", ByteType()), "uchar": ("u1", ShortType()), "uint8": ("u1", ShortType()),
    "short": ("<i2", ShortType()), "int16": ("<i2", ShortType()), "ushort": ("<u2", IntegerType()), "uint16": ("<u2", IntegerType()),
    "int": ("<i4", IntegerType()), "int32": ("<i4", IntegerType()), "uint": ("<u4", LongType()), "uint32": ("<u4", LongType()),
    "float": ("<f4", FloatType()), "float32": ("<f4", FloatType()), "double": ("<f8", DoubleType()), "float64": ("<f8", DoubleType()),
}
MAX_HEADER = 8 << 20
CHUNK_ROWS = 1 << 16
COPY_BYTES = 4 << 20


class PlyError(ValueError):
    """A file that is not a readable splat table."""


@dataclass
class Header:
    format: str
    count: int
    properties: list[tuple[str, str]]
    comments: list[str] = field(default_factory=list)
    offset: int = 0

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(name, TYPES[kind][0]) for name, kind in self.properties])

    @property
    def degree(self) -> int:
        return C.sh_degree(sum(n.startswith("f_rest_") for n, _ in self.properties))


def parse_header(raw: bytes) -> Header:
    """raw: the file's beginning, with the whole header."""
    lines, at, ended = [], 0, False
    while (end := raw.find(b"\n", at)) >= 0:
        line = raw[at:end].rstrip(b"\r").decode("ascii", "replace").strip()
        at = end + 1  # exactly one newline: the data may begin with any byte
        lines.append(line)
        if line == "end_header":
            ended = True
            break
    if not lines or lines[0] != "ply":
        raise PlyError("not a PLY file")
    if not ended:
        raise PlyError("the header does not end")
    out, element, elements = Header("", -1, [], offset=at), None, 0
    for line in lines[1:-1]:
        word, *rest = line.split() or [""]
        if word == "format":
            out.format = rest[0] if rest else ""
        elif word in ("comment", "obj_info"):
            out.comments.append(line[len(word) :].strip())
        elif word == "element":
            element, elements = rest[0], elements + 1
            if element == "vertex":
                if elements > 1:
                    raise PlyError("the vertex element must be the first")
                out.count = int(rest[1])
        elif word == "property" and element == "vertex":
            if rest[0] == "list":
                raise PlyError("a list property in the vertex element")
            if rest[0] not in TYPES:
                raise PlyError(f"unknown type {rest[0]}")
            out.properties.append((rest[1], rest[0]))
    if out.format not in ("ascii", "binary_little_endian"):
        raise PlyError(f"format {out.format or '(none)'} is not supported")
    if out.count < 0:
        raise PlyError("no vertex element")
    return out


def local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path.removeprefix("file:")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local disk, HDFS or an object store that Arrow knows) and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def opened(path: str):
    system, at = filesystem(path)
    return system.open_input_file(at)


def read_header(path: str) -> Header:
    raw = b""
    with opened(path) as f:
        while b"end_header" not in raw and len(raw) < MAX_HEADER and (more := f.read(1 << 16)):
            raw += more
        raw += f.read(4)
    if b"end_header" not in raw:
        raise PlyError("the header does not end" if raw.startswith(b"ply") else "not a PLY file")
    return parse_header(raw)


def layout(header: Header) -> dict[str, str]:
    """Raw splat columns by property name; says what is missing or too many."""
    names = [n for n, _ in header.properties]
    numbered = lambda p: sorted((n for n in names if n.startswith(p)), key=lambda n: int(n[len(p) :]))
    for need in ("x", "y", "z", "opacity", "f_dc_0", "f_dc_1", "f_dc_2"):
        if need not in names:
            raise PlyError(f"property {need} is missing")
    scale, rot, rest = numbered("scale_"), numbered("rot_"), numbered("f_rest_")
    if len(scale) != 3:
        raise PlyError(f"3 scale_ properties are needed; there are {len(scale)}")
    if len(rot) != 4:
        raise PlyError(f"4 rot_ properties are needed; there are {len(rot)}")
    try:
        C.sh_degree(len(rest))
    except ValueError as e:
        raise PlyError(str(e)) from e
    out = {c: c for c in ("x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2")} | {"opacity": "op_logit"}
    out |= {n: f"s{k}" for k, n in enumerate(scale)} | {n: f"r{k}" for k, n in enumerate(rot)}
    return out | {n: f"f_rest_{k}" for k, n in enumerate(rest)}


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class SplatPly(DataSource):
    @classmethod
    def name(cls) -> str:
        return "splat_ply"

    def schema(self) -> StructType:
        header = read_header(self.options["path"])
        wanted = self.options.get("columns")
        wanted = wanted.split(",") if wanted else [n for n, _ in header.properties]
        kinds = dict(header.properties)
        return StructType([StructField("splat_id", LongType(), False), *(StructField(n, TYPES[kinds[n]][1], False) for n in wanted)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(self.options["path"], schema, int(self.options.get("partitionRows", 1_000_000)))


class PlyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int):
        self.path, self.out, self.rows, self.header = path, schema, rows, read_header(path)

    def partitions(self) -> list[InputPartition]:
        n = self.header.count
        if self.header.format == "ascii":
            return [Rows(0, n)]
        need = self.header.offset + n * self.header.dtype.itemsize
        system, at = filesystem(self.path)
        if system.get_file_info(at).size < need:
            raise PlyError("the file is shorter than its vertex count")
        return [Rows(k, min(n, k + self.rows)) for k in range(0, n, self.rows)] or [Rows(0, 0)]

    def _batch(self, first: int, rows: np.ndarray) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.out)
        cols = [pa.array(np.arange(first, first + len(rows)), pa.int64())]
        cols += [pa.array(np.ascontiguousarray(rows[f.name])).cast(f.type) for f in list(schema)[1:]]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        kind = self.header.dtype
        with opened(self.path) as f:
            if self.header.format == "ascii":
                yield from self._ascii(f)
                return
            f.seek(self.header.offset + partition.first * kind.itemsize)
            for at in range(partition.first, partition.last, CHUNK_ROWS):
                n = min(CHUNK_ROWS, partition.last - at)
                yield self._batch(at, np.frombuffer(f.read(n * kind.itemsize), kind))

    def _ascii(self, f) -> Iterator[pa.RecordBatch]:
        """Tokens split at any byte up to a space, carried over chunks; surplus ones are ignored, too few are an error."""
        f.seek(self.header.offset)
        width, done, held, rest = len(self.header.properties), 0, [], b""
        table = bytes(32 if b <= 32 else b for b in range(256))
        while done < self.header.count:
            raw = f.read(1 << 20)
            text = rest + raw.translate(table)
            parts = text.split(b" ")
            rest = parts.pop() if raw else b""
            held += [p for p in parts if p]
            n = min(len(held) // width, self.header.count - done)
            if n:
                values = np.array(held[: n * width], dtype="S").astype(np.float64).reshape(n, width)
                rows = np.zeros(n, self.header.dtype)
                for k, (name, _) in enumerate(self.header.properties):
                    rows[name] = values[:, k]
                yield self._batch(done, rows)
                done, held = done + n, held[n * width :]
            if not raw and done < self.header.count:
                raise PlyError("the file has fewer values than its vertex count")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SplatPly)


def read_splats(spark: SparkSession, path: str, convention: str = "graphdeco", linear_scale: bool = False) -> DataFrame:
    """A PLY file in the splat schema; properties that splats don't need are not read."""
    header = read_header(path)
    if header.count == 0:
        raise PlyError("the file has no vertices")
    names = layout(header)
    register(spark)
    raw = spark.read.format("splat_ply").option("columns", ",".join(names)).load(path)
    return C.canonicalise(raw.select("splat_id", *[F.col(f"`{n}`").alias(c) for n, c in names.items()]), convention, linear_scale)


def encoded(table: pa.Table) -> tuple[list[str], bytes]:
    """Property names and rows, graphdeco-like: opacity as logit, rotation w first, zero normals."""
    n = table.num_rows
    sh = np.asarray(table.column("sh").combine_chunks().flatten(), np.float32).reshape(n, -1)
    extra = sh.shape[1] // 3 - 1
    names = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", *(f"f_rest_{k}" for k in range(3 * extra)), "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
    rows = np.zeros(n, [(name, "<f4") for name in names])
    for c in "xyz":
        rows[c] = table.column(c).to_numpy()
    for c in range(3):
        rows[f"f_dc_{c}"] = sh[:, c]
        for k in range(extra):
            rows[f"f_rest_{c * extra + k}"] = sh[:, 3 + 3 * k + c]
        rows[f"scale_{c}"] = table.column(f"s{c}").to_numpy()
    o = np.clip(table.column("opacity").to_numpy().astype(np.float64), 1e-7, 1 - 1e-7)
    rows["opacity"] = np.log(o / (1 - o))
    for k, c in enumerate(("qw", "qx", "qy", "qz")):
        rows[f"rot_{k}"] = table.column(c).to_numpy()
    return names, rows.tobytes()


def _head(n: int, names: list[str]) -> bytes:
    return ("\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property float {name}" for name in names), "end_header"]) + "\n").encode()


def write_ply(path: str, table: pa.Table) -> None:
    """A binary file of a collected splat table."""
    names, data = encoded(table)
    system, at = filesystem(path)
    with system.open_output_stream(at) as f:
        f.write(_head(table.num_rows, names) + data)


def write_splats(splats: DataFrame, path: str, in_place: bool | None = None) -> int:
    """A binary file of the splats by id: executors write its parts and then put them together, no row passes the driver.

    On a file system of the machines each part goes to its place by a task of its own (``in_place``); on others, which only
    append, one task streams them.
    """
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    system, target = filesystem(path)
    _, held = filesystem(folder)
    in_place = isinstance(system, fs.LocalFileSystem) if in_place is None else in_place
    system.create_dir(held)

    def encode(batches):
        from pyspark import TaskContext

        # Every attempt has a file of its own; the one that succeeds names it.
        name, n, seen = uuid.uuid4().hex, 0, set()
        system, at = filesystem(folder)
        with system.open_output_stream(f"{at}/{name}") as f:
            for b in batches:
                if b.num_rows:
                    names, data = encoded(pa.Table.from_batches([b]))
                    f.write(data)
                    n += b.num_rows
                    seen.add(" ".join(names))
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": pa.array([name]), "n": pa.array([n], pa.int64()), "names": pa.array([sorted(seen)], pa.list_(pa.string()))})

    try:
        parts = sorted(splats.select(*C.SPLAT).orderBy("splat_id").mapInArrow(encode, "part int, file string, n long, names array<string>").collect())
        if not parts:
            raise PlyError("no splats")
        layouts = {x for r in parts for x in r.names}
        if len(layouts) > 1:
            raise PlyError("splats of different degrees")
        names, files = layouts.pop().split(" "), [r.file for r in parts]
        width = 4 * len(names)
        n = sum(r.n for r in parts)
        head = _head(n, names)
        places = [len(head) + width * k for k in itertools.accumulate((r.n for r in parts), initial=0)]
        whole = f"{path}.part"

        def copy(name: str, out) -> None:
            with opened(f"{folder}/{name}") as f:
                while data := f.read(COPY_BYTES):
                    out.write(data)

        def put(row) -> None:
            with open(filesystem(whole)[1], "r+b") as out:
                out.seek(places[row.id])
                copy(files[row.id], out)

        def stream(_) -> None:
            system, at = filesystem(path)
            with system.open_output_stream(at) as out:
                out.write(head)
                for name in files:
                    copy(name, out)

        if in_place:
            made = filesystem(whole)[1]
            with system.open_output_stream(made) as f:
                f.write(head)
            splats.sparkSession.range(0, len(files), 1, len(files)).foreach(put)
            system.move(made, target)
        else:
            splats.sparkSession.range(0, 1, 1, 1).foreach(stream)
        return n
    finally:
        system.delete_dir(held)
