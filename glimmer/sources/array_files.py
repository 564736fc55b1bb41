"""Movies in array, headerless and TIFF files as a data source of Spark: a file is read in ranges of
frames, each by a task of its own, and only the range's bytes are read.

Files are reached through Arrow's file systems (local paths and file, hdfs, s3 and gs URIs). Frames
are numbered on from file to file, in the order of the files' names."""

from __future__ import annotations

import ast
import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of pixels that a task reads, and frames of one batch.
RANGE_BYTES, BATCH_FRAMES = 64 << 20, 64


class MovieFileError(ValueError):
    """A file that is no movie of a supported form; says which file and why."""


@dataclass
class Layout:
    """Where a file's frames lie: each as runs of (offset, bytes)."""

    frames: int
    size: int  # pixels a frame
    dtype: str
    start: int = 0  # frames lie one after the other from here, unless ``runs`` says otherwise
    runs: list[list[tuple[int, int]]] | None = None


def listed(path: str):
    """The file system and the files of a path: a file, a folder (names that start with . or _ left out) or a pattern."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if any(c in posixpath.basename(place) for c in "*?["):
        inside = system.get_file_info(fs.FileSelector(posixpath.dirname(place)))
        files = [x for x in inside if x.is_file and fnmatch.fnmatch(x.base_name, posixpath.basename(place))]
    else:
        one = system.get_file_info(place)
        if one.type == fs.FileType.NotFound:
            raise MovieFileError(f"{path}: no such file")
        files = [one] if one.is_file else [x for x in system.get_file_info(fs.FileSelector(place)) if x.is_file and x.base_name[0] not in "._"]
    return system, sorted((x.path, x.size) for x in files)


def npy_layout(file, size: int) -> Layout:
    head = file.read(12)
    if head[:6] != b"\x93NUMPY":
        raise MovieFileError("not an array file")
    start, length = (10, int.from_bytes(head[8:10], "little")) if head[6] == 1 else (12, int.from_bytes(head[8:12], "little"))
    file.seek(start)
    said = ast.literal_eval(file.read(length).decode("latin-1"))
    shape, dtype = tuple(said["shape"]), np.dtype(said["descr"])
    if said["fortran_order"]:
        raise MovieFileError("arrays in Fortran order are not supported")
    if len(shape) != 3 or dtype.kind not in "uifb":
        raise MovieFileError(f"not a (t, y, x) array of numbers: {shape}, {dtype}")
    pixels = shape[1] * shape[2]
    if size < start + length + shape[0] * pixels * dtype.itemsize:
        raise MovieFileError("shorter than its header says")
    return Layout(shape[0], pixels, dtype.str, start + length)


def raw_layout(size: int, height: int, width: int, dtype: str) -> Layout:
    one = height * width * np.dtype(dtype).itemsize
    if one <= 0 or size % one:
        raise MovieFileError(f"{size} bytes are no whole number of frames of {one} bytes")
    return Layout(size // one, height * width, np.dtype(dtype).str)


def tif_layout(file, size: int) -> Layout:
    """Pages of an uncompressed grey-scale file, by its directories alone: no pixel is read."""

    def numbers(at: int, kind: str, count: int = 1) -> list[int]:
        file.seek(at)
        got = file.read(count * np.dtype(kind).itemsize)
        if len(got) < count * np.dtype(kind).itemsize:
            raise MovieFileError("shorter than its directories say")
        return np.frombuffer(got, order + kind).tolist()

    file.seek(0)
    order = {b"II": "<", b"MM": ">"}.get(file.read(2))
    if order is None or numbers(2, "u2") != [42]:
        raise MovieFileError("not a baseline TIFF file")
    kinds = {1: "u1", 3: "u2", 4: "u4"}
    runs, found, at, seen = [], None, numbers(4, "u4")[0], set()
    while at:
        if at in seen:
            raise MovieFileError("its directories form a circle")
        seen.add(at)
        entries = numbers(at, "u2")[0]
        tags = {}
        for k in range(entries):
            entry = at + 2 + 12 * k
            tag, kind = numbers(entry, "u2", 2)
            count = numbers(entry + 4, "u4")[0]
            if kind in kinds:
                where = entry + 8 if count * np.dtype(kinds[kind]).itemsize <= 4 else numbers(entry + 8, "u4")[0]
                tags[tag] = numbers(where, kinds[kind], count)
        one = lambda tag, default: tags[tag][0] if tag in tags else default  # noqa: E731, B023
        if one(259, 1) != 1 or one(277, 1) != 1:
            raise MovieFileError("compressed or coloured pages are not supported")
        dtype = order + {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(one(258, 8) // 8)
        shape = (one(257, 0), one(256, 0), dtype)
        if found is not None and shape != found:
            raise MovieFileError("its pages differ in shape or kind")
        found = shape
        page = list(zip(tags.get(273, []), tags.get(279, []), strict=False))
        if sum(n for _, n in page) != shape[0] * shape[1] * np.dtype(dtype).itemsize or any(o + n > size for o, n in page):
            raise MovieFileError("shorter than its directories say")
        runs.append(page)
        at = numbers(at + 2 + 12 * entries, "u4")[0]
    if found is None:
        return Layout(0, 0, "u1")
    return Layout(len(runs), found[0] * found[1], found[2], runs=runs)


@dataclass
class FrameRange(InputPartition):
    """Some frames of one file: the first one's number, and the bytes of each."""

    path: str
    first: int
    size: int
    dtype: str
    runs: list[list[tuple[int, int]]]


class MovieReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def layout(self, file, size: int) -> Layout:
        kind = self.options.get("kind", "npy")
        if kind == "npy":
            return npy_layout(file, size)
        if kind == "tif":
            return tif_layout(file, size)
        if kind == "raw":
            return raw_layout(size, int(self.options["height"]), int(self.options["width"]), self.options.get("dtype", "<u2"))
        raise MovieFileError(f"unknown kind of movie: {kind}")

    def partitions(self) -> list[InputPartition]:
        system, files = listed(self.options["path"])
        out, t = [], 0
        for path, size in files:
            try:
                with system.open_input_file(path) as file:
                    found = self.layout(file, size)
            except MovieFileError as e:
                raise MovieFileError(f"{path}: {e}") from None
            one = found.size * np.dtype(found.dtype).itemsize
            step = max(1, int(self.options.get("range_bytes", RANGE_BYTES)) // max(1, one))
            for a in range(0, found.frames, step):
                b = min(a + step, found.frames)
                # frames that lie together are named by their first byte
                runs = found.runs[a:b] if found.runs is not None else [[(found.start + a * one, (b - a) * one)]]
                out.append(FrameRange(path, t + a, found.size, found.dtype, runs))
            t += found.frames
        return out or [FrameRange("", 0, 0, "u1", [])]

    def read(self, partition: FrameRange) -> Iterator:
        import pyarrow as pa

        if not partition.runs:
            return
        system, _ = listed(self.options["path"])
        size, dtype = partition.size, np.dtype(partition.dtype)
        together = len(partition.runs) == 1 and partition.runs[0][0][1] > size * dtype.itemsize
        t = partition.first
        with system.open_input_file(partition.path) as file:

            def frames() -> Iterator[np.ndarray]:
                if together:
                    (at, n), one = partition.runs[0][0], size * dtype.itemsize * BATCH_FRAMES
                    for k in range(at, at + n, one):
                        file.seek(k)
                        yield np.frombuffer(file.read(min(one, at + n - k)), dtype).reshape(-1, size)
                    return
                for k in range(0, len(partition.runs), BATCH_FRAMES):
                    held = []
                    for page in partition.runs[k : k + BATCH_FRAMES]:
                        for at, n in page:
                            file.seek(at)
                            held.append(file.read(n))
                    yield np.frombuffer(b"".join(held), dtype).reshape(-1, size)

            for some in frames():
                values = pa.array(np.ascontiguousarray(some, np.float64).ravel())
                ends = pa.array(np.arange(0, (len(some) + 1) * size, size, dtype=np.int32)) if size else pa.array(np.zeros(len(some) + 1, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(t, t + len(some), dtype=np.int32)), pa.ListArray.from_arrays(ends, values)], ["t", "px"])
                t += len(some)


class MovieFiles(DataSource):
    """spark.read.format("movie_frames"): options path, kind (npy, raw, tif), for raw files height, width and
    dtype, and range_bytes, the pixels' bytes that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "movie_frames"

    def schema(self) -> str:
        return "t int, px array<double>"

    def reader(self, schema) -> MovieReader:
        return MovieReader(dict(self.options))
