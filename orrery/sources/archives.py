"""Class names of JAR files (S13), from the ZIP central directory alone: nothing is unpacked, and of a file only its end is read.

`JarSource` is a Spark data source, `spark.dataSource.register(JarSource)`, then `spark.read.format("jar_classes").load(path)` over a file or a folder: one partition a file,
and two short reads in it. `jar_classes` does the same for a column of bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the ZIP format: signatures, the fixed part of the end record, the longest comment.
_END, _ENTRY, _END_SIZE, _COMMENT = b"PK\x05\x06", b"PK\x01\x02", 22, 65535
SCHEMA = "path string, package string, name string, error string"


def entries(read: Callable[[int, int], bytes], size: int) -> Iterator[str]:
    """Names in the central directory. read(offset, length) gives bytes of the file."""
    start = max(0, size - _END_SIZE - _COMMENT)
    tail = read(start, size - start)
    at = tail.rfind(_END, 0, max(0, len(tail) - _END_SIZE + len(_END)))
    if at < 0:
        raise ValueError("no central directory")
    length, offset = struct.unpack("<II", tail[at + 12 : at + 20])
    body = tail[offset - start : offset - start + length] if offset >= start else read(offset, length)
    i = 0
    while i + 46 <= len(body):
        if body[i : i + 4] != _ENTRY:
            raise ValueError("a bad entry in the central directory")
        name, extra, comment = struct.unpack("<HHH", body[i + 28 : i + 34])
        yield body[i + 46 : i + 46 + name].decode("utf-8", "replace")
        i += 46 + name + extra + comment


def classes(names: Iterator[str]) -> list[tuple[str, str]]:
    """(package, class with dots) of class entries, each once, sorted; versions of one class are one, descriptors are none."""
    out = set()
    for name in names:
        parts = name.split("/")
        if len(parts) > 3 and parts[:2] == ["META-INF", "versions"] and parts[2].isdigit():
            parts = parts[3:]
        last = parts[-1]
        if last.endswith(".class") and last not in ("module-info.class", "package-info.class"):
            dotted = ".".join(parts)[: -len(".class")].replace("$", ".")
            out.add((dotted.rpartition(".")[0], dotted))
    return sorted(out)


def _rows(path: str | None, read: Callable[[int, int], bytes], size: int) -> list[tuple]:
    try:
        return [(path, package, name, None) for package, name in classes(entries(read, size))]
    except (ValueError, struct.error, OSError) as e:
        return [(path, None, None, str(e))]


def jar_classes(jars: DataFrame) -> DataFrame:
    """path, package, name, error of (path, content): a row a class; a file that is no archive gives one row with the error. Null content gives none."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if content is not None:
                    rows += _rows(path, lambda at, n, content=content: content[at : at + n], len(content))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["path", "package", "name", "error"])

    return jars.select("path", "content").mapInArrow(run, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        fs, at = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = fs.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        head = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else self.path.partition("://")[0] + "://"
        return [_File(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and f.path.endswith(".jar")] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        fs, at = pafs.FileSystem.from_uri(partition.path) if "://" in partition.path else (pafs.LocalFileSystem(), partition.path)
        with fs.open_input_file(at) as f:
            yield from _rows(partition.path, lambda offset, n: f.read_at(n, offset), f.size())


class JarSource(DataSource):
    """format("jar_classes"): path is a file, a folder, or a URI of either that the executors can read."""

    @classmethod
    def name(cls) -> str:
        return "jar_classes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def import_owners(imports: DataFrame, found: DataFrame) -> DataFrame:
    """name, path of every archive that holds an imported class, or, for an import that ends with .*, the package (J21's exact case)."""
    wide = F.col("name").endswith(".*")
    asked = imports.select("name").where("name is not null").distinct().select("name", wide.alias("wide"), F.regexp_replace("name", r"\.\*$", "").alias("key"))
    known = found.where("error is null").select("path", F.explode(F.array(F.struct(F.lit(False).alias("wide"), F.col("name").alias("key")), F.struct(F.lit(True).alias("wide"), F.col("package").alias("key")))).alias("k"))
    return asked.join(known.select("path", "k.wide", "k.key").distinct(), ["wide", "key"]).select("name", "path")
