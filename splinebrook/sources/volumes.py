"""NIfTI images as a Spark data source: slabs of images are read in parallel, and one file is written for each image.

    spark.dataSource.register(Volumes)
    voxels = spark.read.format(Volumes.name()).load(path)
    write_volumes(voxels, path, shape, tr, affine)

Rows are (image, x, y, z, y_t array<double>). Paths are opened by pyarrow's file systems (local or mounted folders, HDFS, S3, GCS),
on the driver and in every task, so on a cluster they have to lie in shared storage.

Reading: an uncompressed image is cut into slabs of planes of about SLAB_BYTES, each a partition that reads only its own
bytes of every volume; a compressed one can only be read whole. Nothing is opened but the header to plan it.

Writing: a task holds one image at a time. It writes below a folder of its own, and only when all tasks are done does the
driver move the files to where they are read; a task that fails takes its own files away, and a job that fails takes all.
With mode overwrite the images of the same names are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .nifti import HEAD, Header, encode, header_of, parse

SLAB_BYTES = 64 << 20
ROWS = 4096
SCHEMA = "image string, x int, y int, z int, y_t array<double>"
PENDING = "_pending"
ENDINGS = (".nii", ".nii.gz")


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pyarrow.fs.LocalFileSystem(), path


def image_name(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[: -len(".nii.gz")] if name.endswith(".nii.gz") else name[: -len(".nii")]


class Volumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options["path"], int(self.options.get("slab_bytes", SLAB_BYTES)))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        shape = tuple(int(v) for v in self.options["shape"].split(","))
        affine = np.eye(4)
        if "affine" in self.options:
            affine[:3] = np.array([float(v) for v in self.options["affine"].split(",")]).reshape(3, 4)
        return VolumeWriter(self.options["path"], shape, float(self.options.get("tr", 1.0)), affine, self.options.get("compress", "true") == "true", overwrite)


@dataclass
class Slab(InputPartition):
    """Planes first..stop - 1 of an image's third axis; the whole file where header is None."""

    path: str
    header: Header | None
    first: int
    stop: int


class VolumeReader(DataSourceReader):
    def __init__(self, path: str, slab_bytes: int):
        self.path, self.slab_bytes = path, slab_bytes

    def partitions(self) -> Sequence[Slab]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        out: list[Slab] = []
        for f in sorted(files, key=lambda f: f.path):
            if not f.is_file or not f.path.endswith(ENDINGS) or f"/{PENDING}" in f.path:
                continue
            if f.path.endswith(".gz"):
                out.append(Slab(f.path, None, 0, 0))
                continue
            with system.open_input_file(f.path) as source:
                header = header_of(source.read(HEAD))
            nx, ny, nz, nt = header.shape
            planes = max(1, self.slab_bytes // max(1, nx * ny * nt * header.width))
            out += [Slab(f.path, header, z, min(z + planes, nz)) for z in range(0, nz, planes)]
        return out

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(slab.path) as source:
            if slab.header is None:
                data, first = parse(source.read()).data, 0
            else:
                data, first = slab.header.planes(source, slab.first, slab.stop), slab.first
        nx, ny, nz, nt = data.shape
        for start in range(0, nx * ny * nz, ROWS):
            at = np.arange(start, min(start + ROWS, nx * ny * nz))
            x, y, z = np.unravel_index(at, (nx, ny, nz))
            values = np.ascontiguousarray(data[x, y, z])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, nt, dtype=np.int32)), pa.array(values.ravel()))
            place = [pa.array(v.astype(np.int32)) for v in (x, y, z + first)]
            yield pa.RecordBatch.from_arrays([pa.array([image_name(slab.path)] * len(at)), *place, lists], ["image", "x", "y", "z", "y_t"])


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, shape: tuple[int, int, int], tr: float, affine: np.ndarray, compress: bool, overwrite: bool):
        self.path, self.shape, self.tr, self.affine, self.compress, self.overwrite = path, shape, tr, affine, compress, overwrite
        self.job = uuid.uuid4().hex

    def pending(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        system, root = opened(self.path.rstrip("/"))
        return system, root, f"{root}/{PENDING}-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, _, pending = self.pending()
        folder, files = f"{pending}/{uuid.uuid4().hex}", []
        image, grid = None, None

        def close() -> None:
            if image is not None:
                system.create_dir(folder)
                name = f"{image}.nii{'.gz' if self.compress else ''}"
                with system.open_output_stream(f"{folder}/{name}", compression=None) as sink:
                    sink.write(encode(grid, self.tr, self.affine, self.compress))
                files.append(name)

        try:
            for batch in batches:
                names, place = batch.column("image").to_pylist(), [batch.column(a).to_numpy() for a in "xyz"]
                for k, name in enumerate(names):
                    if not name or "/" in name:
                        raise ValueError(f"{name!r} cannot name a file")
                    values = batch.column("y_t")[k].values.to_numpy(zero_copy_only=False)
                    if name != image:
                        close()
                        if f"{name}.nii{'.gz' if self.compress else ''}" in files:
                            raise ValueError(f"the rows of {name} are not together; use write_volumes")
                        image, grid = name, np.zeros((*self.shape, len(values)), dtype=np.float32)
                    if len(values) != grid.shape[3]:
                        raise ValueError(f"{name}: {len(values)} values where others have {grid.shape[3]}")
                    grid[tuple(int(p[k]) for p in place)] = values
            close()
        except BaseException:
            if system.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
                system.delete_dir(folder)
            raise
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, pending = self.pending()
        every = [(m.folder, f) for m in messages if m is not None for f in m.files]
        names = [f for _, f in every]
        there = [f for f in names if system.get_file_info(f"{root}/{f}").is_file]
        if len(set(names)) < len(names) or (there and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"images written twice, or there already: {sorted(there or names)[:5]}")
        system.create_dir(root)
        for folder, name in every:
            system.move(f"{folder}/{name}", f"{root}/{name}")
        self.clean(system, pending)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, pending = self.pending()
        self.clean(system, pending)

    @staticmethod
    def clean(system: pyarrow.fs.FileSystem, pending: str) -> None:
        if system.get_file_info(pending).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(pending)


def write_volumes(voxels: DataFrame, path: str, shape: tuple[int, int, int], tr: float = 1.0, affine: np.ndarray | None = None, compress: bool = True, mode: str = "append") -> None:
    """One file for each image of voxels (image, x, y, z, y_t); cells without a row are zeros. mode: append, which refuses names that
    are there, or overwrite, which replaces them."""
    voxels.sparkSession.dataSource.register(Volumes)
    dealt = voxels.select("image", *[voxels[a].cast("int").alias(a) for a in "xyz"], voxels["y_t"].cast("array<double>").alias("y_t")).repartition("image").sortWithinPartitions("image")
    numbers = ",".join(map(str, (np.eye(4) if affine is None else np.asarray(affine))[:3].ravel().tolist()))
    options = {"shape": ",".join(map(str, shape)), "tr": str(tr), "affine": numbers, "compress": str(compress).lower()}
    dealt.write.format(Volumes.name()).options(**options).mode(mode).save(path)
