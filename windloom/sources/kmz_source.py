"""``spark.read.format("kmz")`` and ``df.write.format("geojson_features")``: survey files as a data source of Spark's Python API.

Reading: a partition is a file. It is parsed as a stream, placemark by placemark, so a file may be of any size; a row is a
placemark (as ``survey.read_kmz`` gives them) or, with ``fault`` set, something that was left out. ``mode`` FAILFAST raises
on the first fault instead. Writing: each task writes one part of a FeatureCollection; parts appear only when all tasks have
ended, and are deleted when one fails. Paths are local or of any file system that Arrow opens (``s3://``, ``hdfs://``, ...).

Defined results: a folder's name holds from where it is read; null or non-finite vertices are left out on reading and an
error on writing; an empty file is a fault; an empty table writes an empty collection.
"""

from __future__ import annotations

import json
import math
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import ArrowInvalid, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from windloom.sources.survey import NEEDED, PLACEMARK, local_name, placemark

CHUNK = 1 << 20
SCHEMA = PLACEMARK + ", fault string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Unreadable(Exception):
    """A file that can't be read to its end, by reason."""


def events_of(stream) -> Iterator[tuple[str, ElementTree.Element]]:
    """Begin and end of each element, a chunk of the file at a time. Entities are never declared nor expanded."""
    parser, head = ElementTree.XMLPullParser(("start", "end")), b""
    try:
        while chunk := stream.read(CHUNK):
            head = (head + chunk)[: 2 * CHUNK] if len(head) < 2 * CHUNK else head
            if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
                raise Unreadable("ENTITIES")
            parser.feed(chunk)
            yield from parser.read_events()
        parser.close()
        yield from parser.read_events()
    except ElementTree.ParseError as error:
        raise Unreadable("MALFORMED") from error


def placemarks(stream) -> Iterator[tuple[tuple | None, str | None]]:
    """(placemark, None) or (None, fault) in document order; what has been read is let go."""
    folders: list[str] = []
    open_: list[ElementTree.Element] = []
    for event, node in events_of(stream):
        kind = local_name(node.tag)
        if event == "start":
            open_.append(node)
            if kind == "Folder":
                folders.append("")
            continue
        open_.pop()
        above = local_name(open_[-1].tag) if open_ else ""
        if kind == "name" and above == "Folder":
            folders[-1] = (node.text or "").strip()
        elif kind == "Folder":
            folders.pop()
        elif kind == "Placemark":
            rows, faults = placemark(node)
            for row in rows:
                yield (row[0], " / ".join(f for f in folders if f), *row[1:]), None
            for fault in faults:
                yield None, fault
        if open_ and not any(local_name(n.tag) == "Placemark" for n in open_):
            open_[-1].remove(node)


def rows_of(path: str) -> Iterator[tuple]:
    """The rows of one KMZ or KML file."""
    where, name = _opened(path)
    k = 0
    try:
        with where.open_input_file(name) as file:
            packed = file.read(2) == b"PK"
            file.seek(0)
            if packed:
                with zipfile.ZipFile(file) as z:
                    inner = next((n for n in z.namelist() if n.lower().endswith(".kml")), None)
                    if inner is None:
                        raise Unreadable("NO_KML")
                    with z.open(inner) as stream:
                        for row, fault in placemarks(stream):
                            yield _row(path, k, row, fault)
                            k += 1
            else:
                for row, fault in placemarks(file):
                    yield _row(path, k, row, fault)
                    k += 1
    except (zipfile.BadZipFile, ArrowInvalid):  # the latter where the file is shorter than an archive's end
        yield _row(path, k, None, "MALFORMED")
    except Unreadable as error:
        yield _row(path, k, None, str(error))


def _row(path: str, k: int, row: tuple | None, fault: str | None) -> tuple:
    if row is None:
        return path, k, None, None, None, None, None, None, fault
    name, folder, kind, points, properties = row
    return path, k, name, folder, kind, [p[0] for p in points], [p[1] for p in points], properties, None


@dataclass
class _File(InputPartition):
    path: str


class _KmzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def partitions(self) -> list[_File]:
        where, name = _opened(self.path)
        info = where.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        found = where.get_file_info(fs.FileSelector(name, recursive=True))
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path and not self.path.startswith("file:") else ""
        return [_File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith((".kmz", ".kml"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        for row in rows_of(partition.path):
            if self.strict and row[-1] is not None:
                raise ValueError(f"{row[-1]}: {partition.path}")
            yield row


class KmzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kmz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _KmzReader:
        return _KmzReader(dict(self.options))


@dataclass
class _Part(WriterCommitMessage):
    hidden: str
    name: str


def feature(row: dict) -> dict:
    """A GeoJSON feature from geometry_type, lon and lat; all other columns are properties."""
    points = [[x, y] for x, y in zip(row.pop("lon"), row.pop("lat"), strict=True)]
    kind = row.pop("geometry_type")
    if kind not in NEEDED or len(points) < NEEDED[kind] or not all(math.isfinite(v) for p in points for v in p):
        raise ValueError(f"no {kind} of {len(points)} vertices")
    shape = points[0] if kind == "Point" else points if kind == "LineString" else [points]
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": shape}, "properties": row}


class _FeatureWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.job = options["path"], names, overwrite, uuid.uuid4().hex

    def write(self, rows) -> _Part:
        where, folder = _opened(self.path)
        where.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        part = _Part(f"{folder}/_{self.job}-{name}.geojson", f"{folder}/part-{name}.geojson")
        with where.open_output_stream(part.hidden) as out:
            out.write(b'{"type":"FeatureCollection","features":[')
            for k, row in enumerate(rows):
                out.write((b",\n" if k else b"\n") + json.dumps(feature(dict(zip(self.names, row))), default=str).encode())
            out.write(b"\n]}")
        return part

    def commit(self, messages: list[_Part | None]) -> None:
        where, folder = _opened(self.path)
        where.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(folder)):
                if old.base_name.startswith("part-"):
                    where.delete_file(old.path)
        for part in messages:
            if part is not None:
                where.move(part.hidden, part.name)
        self.abort([])

    def abort(self, messages: list[_Part | None]) -> None:
        where, folder = _opened(self.path)
        for left in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if left.base_name.startswith(f"_{self.job}-"):
                where.delete_file(left.path)


class FeatureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geojson_features"

    def writer(self, schema, overwrite: bool) -> _FeatureWriter:
        return _FeatureWriter(dict(self.options), list(schema.names), overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(KmzSource)
    spark.dataSource.register(FeatureSink)
