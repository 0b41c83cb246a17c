"""WAV files as a data source: `spark.read.format("wav")`, a row a file.

Columns (SCHEMA): path, bytes, rate, channels, bits, frames, duration_s, samples (mono, from -1 to 1) and
bytes_read. Which of them are read follows the schema given to `spark.read.schema(...)`: without samples only the
headers of a file's chunks are read, some dozens of bytes, however long it is. A file that is damaged or no
WAV has a row with nulls; a data chunk that claims more than the file has counts as long as it is.

Files are listed with their sizes on the driver and dealt to tasks of about `split` bytes (option, 64 MB;
`split` files where only headers are read: 256). Paths are any that Arrow's file systems open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import workers

SCHEMA = "path string, bytes long, rate int, channels int, bits int, frames long, duration_s double, samples array<float>, bytes_read long"
#: Codes of the sample formats.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, file):
        self.file, self.read_so_far = file, 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        self.read_so_far += len(got)
        return got


def header(file: Counted, size: int) -> dict | None:
    """rate, channels, bits, format, frames and where the samples lie; None if that isn't a WAV file."""
    start = file.read(0, 12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:] != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", file.read(at, 8))
        if name == b"fmt " and n >= 16:
            fmt = file.read(at + 8, min(n, 40))
            if len(fmt) < 16:
                return None
            code, channels, rate, _, width, bits = struct.unpack("<HHIIHH", fmt[:16])
            code = struct.unpack("<H", fmt[24:26])[0] if code == EXTENSIBLE and len(fmt) >= 26 else code
            found = {"rate": rate, "channels": channels, "bits": bits, "code": code, "width": width}
        elif name == b"data":
            if not found or not found["width"] or not found["rate"] or not found["channels"]:
                return None
            n = min(n, size - at - 8)
            return found | {"at": at + 8, "frames": n // found["width"]}
        at += 8 + n + n % 2
    return None


def samples(file: Counted, h: dict) -> np.ndarray | None:
    """Mono samples from -1 to 1; None for formats other than PCM of 8 to 32 bits and floats."""
    raw = file.read(h["at"], h["frames"] * h["width"])
    bits, n = h["bits"], h["frames"] * h["channels"]
    if h["width"] * 8 != bits * h["channels"]:
        return None
    if h["code"] == FLOAT and bits in (32, 64):
        x = np.frombuffer(raw, f"<f{bits // 8}", n).astype(np.float64)
    elif h["code"] == PCM and bits == 8:
        x = (np.frombuffer(raw, np.uint8, n).astype(np.float64) - 128) / 128
    elif h["code"] == PCM and bits in (16, 32):
        x = np.frombuffer(raw, f"<i{bits // 8}", n) / float(1 << (bits - 1))
    elif h["code"] == PCM and bits == 24:
        b = np.frombuffer(raw, np.uint8, n * 3).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        return None
    return x.reshape(-1, h["channels"]).mean(1).astype(np.float32)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WavReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.whole = "samples" in self.names
        self.path, self.split = options["path"], int(options.get("split", 64 << 20 if self.whole else 256))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        listed = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        found = sorted((f.path, f.size) for f in listed if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))
        parts, room = [], 0
        for f in found:
            if room <= 0:
                parts.append([])
                room = self.split
            parts[-1].append(f)
            room -= f[1] if self.whole else 1
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        kinds = {"path": pa.string(), "rate": pa.int32(), "channels": pa.int32(), "bits": pa.int32(), "duration_s": pa.float64(), "samples": pa.list_(pa.float32())}
        for path, size in partition.files:
            row = {"path": path, "bytes": size}
            with system.open_input_file(path) as opened:
                file = Counted(opened)
                h = header(file, size)
                if h:
                    row |= {k: h[k] for k in ("rate", "channels", "bits", "frames")} | {"duration_s": h["frames"] / h["rate"]}
                    row["samples"] = samples(file, h) if self.whole else None
                row["bytes_read"] = file.read_so_far
            yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], kinds.get(n, pa.int64())) for n in self.names], self.names)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The WAV files of a folder, or one file: these columns of SCHEMA (all but samples, where none is named), and no more is read than they need."""
    workers.ship(spark)
    spark.dataSource.register(WavSource)
    own = dict(c.split(" ") for c in SCHEMA.split(", "))
    names = columns or [c for c in own if c != "samples"]
    return spark.read.format("wav").schema(", ".join(f"{c} {own[c]}" for c in names)).load(path)
