"""NIfTI images as tables: voxel rows, loading through a mask, pairing of files, and an encoder.

The bytes are read by Spark's binary-file reader, so any store that Spark knows will do; an image is the unit of reading.
"""

from __future__ import annotations

import gzip
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed codes of the format's data types.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


@dataclass
class Image:
    data: np.ndarray  # x, y, z, t
    zooms: tuple[float, ...]
    affine: np.ndarray

    @property
    def tr(self) -> float:
        """Seconds between volumes; 1 where the header has none."""
        return float(self.zooms[3]) if len(self.zooms) > 3 and self.zooms[3] > 0 else 1.0


#: Bytes of a header.
HEAD = 352


@dataclass(frozen=True)
class Header:
    shape: tuple[int, int, int, int]
    kind: str  # with its byte order
    offset: int
    slope: float
    inter: float
    zooms: tuple[float, ...]
    affine: tuple[float, ...]

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize

    def scaled(self, data: np.ndarray) -> np.ndarray:
        data = data.astype(np.float64)
        return data * self.slope + self.inter if self.slope != 0 and not np.isnan(self.slope) else data

    def planes(self, source, first: int, stop: int) -> np.ndarray:
        """Planes of the third axis in all volumes, from an uncompressed file that can be read anywhere."""
        nx, ny, nz, nt = self.shape
        plane, parts = nx * ny * self.width, []
        for t in range(nt):
            source.seek(self.offset + (t * nz + first) * plane)
            parts.append(np.frombuffer(source.read((stop - first) * plane), dtype=self.kind).reshape((nx, ny, stop - first), order="F"))
        return self.scaled(np.stack(parts, axis=3))


def header_of(raw: bytes) -> Header:
    order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    if struct.unpack_from(f"{order}i", raw)[0] != 348:
        raise ValueError("not a NIfTI-1 image")
    dim = struct.unpack_from(f"{order}8h", raw, 40)
    kind = TYPES[struct.unpack_from(f"{order}h", raw, 70)[0]]
    zooms = struct.unpack_from(f"{order}8f", raw, 76)[1 : dim[0] + 1]
    offset, slope, inter = struct.unpack_from(f"{order}3f", raw, 108)
    shape = dim[1 : dim[0] + 1]
    return Header((*shape, *[1] * (4 - len(shape))), order + kind, int(offset), slope, inter, zooms, struct.unpack_from(f"{order}12f", raw, 280))


def parse(content: bytes) -> Image:
    """A single-file image (.nii or .nii.gz), scaled."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    head = header_of(raw)
    data = np.frombuffer(raw, dtype=head.kind, count=int(np.prod(head.shape)), offset=head.offset).reshape(head.shape, order="F")
    affine = np.eye(4)
    affine[:3] = np.array(head.affine).reshape(3, 4)
    return Image(head.scaled(data), head.zooms, affine)


def encode(data: np.ndarray, tr: float = 1.0, affine: np.ndarray | None = None, compress: bool = True) -> bytes:
    """A float32 image of a 3-D or 4-D array."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, tr, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *(np.eye(4) if affine is None else affine)[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.astype("<f4").tobytes(order="F")
    return gzip.compress(raw) if compress else raw


def voxels(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, x, y, z, y_t array<double>) of every voxel of every image under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = parse(content).data
                for x in range(image.shape[0]):  # a slab at a time bounds the batch
                    slab = image[x].reshape(-1, image.shape[3])
                    yy, zz = np.divmod(np.arange(len(slab)), image.shape[2])
                    offsets = pa.array(np.arange(0, slab.size + 1, slab.shape[1], dtype=np.int32))
                    place = [pa.array(v.astype(np.int32)) for v in (np.full(len(slab), x), yy, zz)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(slab)), *place, pa.ListArray.from_arrays(offsets, pa.array(slab.ravel()))], ["path", "x", "y", "z", "y_t"])

    return files.mapInArrow(run, "path string, x int, y int, z int, y_t array<double>")


def masked(images: DataFrame, masks: DataFrame) -> DataFrame:
    """The voxels of images at which their mask is 1. masks: (path of the image it belongs to, x, y, z, y_t)."""
    inside = masks.filter(F.element_at("y_t", 1) == 1).select("path", "x", "y", "z")
    return images.join(inside, ["path", "x", "y", "z"], "left_semi")


def paired(files: DataFrame) -> DataFrame:
    """files (path) -> (subject, movement, image, mask) of subjects that have both movements, each with image and mask."""
    named = files.select("path", F.regexp_extract("path", r"(sub-[A-Za-z0-9]+)", 1).alias("subject"), F.regexp_extract("path", r"movement(\d+)", 1).cast("int").alias("movement"))
    images = named.filter(F.col("path").rlike(r"-preproc_bold\.nii(\.gz)?$")).withColumnRenamed("path", "image")
    masks = named.filter(F.col("path").rlike(r"-brain_mask\.nii(\.gz)?$")).withColumnRenamed("path", "mask")
    both = images.join(masks, ["subject", "movement"]).filter(F.col("movement").isin(1, 2))
    whole = both.groupBy("subject").agg(F.count_distinct("movement").alias("n")).filter("n = 2").select("subject")
    return both.join(whole, "subject", "left_semi")
