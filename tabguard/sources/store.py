"""Files of any store that Spark knows, as Python's binary files on the driver."""

from __future__ import annotations

import io

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _open(spark, path)
    return fs.exists(p)


def first_file(spark: SparkSession, path: str) -> str | None:
    """The path of a file, or of the first data file in a folder; None if there is none."""
    p, fs = _open(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return path
    parts = [s.getPath() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))]
    return min(parts, key=lambda x: x.getName()).toString() if parts else None


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, sorted; none if there is no such folder."""
    p, fs = _open(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def read(spark: SparkSession, path: str) -> bytes:
    with reader(spark, path) as f:
        return f.read()


def replace(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, in the place of one that may be there."""
    p, fs = _open(spark, path)
    if fs.exists(p):
        fs.delete(p, False)
    with writer(spark, path) as f:
        f.write(data)


class _Reader(io.RawIOBase):
    def __init__(self, spark: SparkSession, path: str):
        p, fs = _open(spark, path)
        self.stream, self.size, self.at = fs.open(p), fs.getFileStatus(p).getLen(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.at)
        if n <= 0:
            return 0
        self.stream.seek(self.at)
        data = bytes(self.stream.readNBytes(n))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


class _Writer(io.RawIOBase):
    def __init__(self, spark: SparkSession, path: str):
        p, fs = _open(spark, path)
        self.stream = fs.create(p, False)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def reader(spark: SparkSession, path: str) -> io.BufferedReader:
    """Only what is asked for is read."""
    return io.BufferedReader(_Reader(spark, path), 1 << 16)


def writer(spark: SparkSession, path: str) -> io.BufferedWriter:
    """A new file; one that exists is an error."""
    return io.BufferedWriter(_Writer(spark, path), 1 << 20)


def plain_path(path: str) -> str:
    """A path whose characters Spark's readers don't take for a pattern."""
    return "".join(f"\\{c}" if c in "[]{}*?" else c for c in path)
