"""Survey sources and sinks: KMZ/KML files, GeoJSON text, CSV sections."""

from __future__ import annotations

import io
import math
import zipfile
from collections import Counter
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACEMARK = "path string, ordinal long, name string, folder string, geometry_type string, lon array<double>, lat array<double>, properties map<string,string>"
FAULT = "path string, fault string, n long"
#: Vertices that a geometry needs; other kinds aren't read.
NEEDED = {"Point": 1, "LineString": 2, "Polygon": 4}
OTHERS = ("Track", "MultiTrack", "Model", "LinearRing")
MAX_BYTES = 64 << 20


def local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def coordinates(text: str | None) -> list[tuple[float, float]]:
    """White-space separated lon,lat[,height] tuples; malformed and non-finite ones are dropped."""
    out = []
    for part in (text or "").split():
        try:
            lon, lat = (float(x) for x in part.split(",")[:2])
        except ValueError:
            continue
        if math.isfinite(lon) and math.isfinite(lat):
            out.append((lon, lat))
    return out


def extended_data(node) -> dict[str, str]:
    """Names and values of a placemark's Data and SimpleData elements."""
    out = {}
    for d in node.iter():
        if local_name(d.tag) in ("Data", "SimpleData") and d.get("name"):
            value = next((c.text for c in d if local_name(c.tag) == "value"), None) if local_name(d.tag) == "Data" else d.text
            out[d.get("name")] = (value or "").strip()
    return out


def name_of(node) -> str:
    return next((c.text or "" for c in node if local_name(c.tag) == "name"), "").strip()


def _ring_text(geometry) -> str | None:
    """The coordinates of a geometry; of a polygon those of its outer boundary, wherever that stands."""
    outer = next((c for c in geometry.iter() if local_name(c.tag) == "outerBoundaryIs"), geometry) if local_name(geometry.tag) == "Polygon" else geometry
    return next((c.text for c in outer.iter() if local_name(c.tag) == "coordinates"), None)


def placemark(node) -> tuple[list[tuple], list[str]]:
    """(name, geometry type, vertices, properties) of each geometry of a placemark, and its faults."""
    out, faults, name, properties = [], [], name_of(node), extended_data(node)
    rings = {id(r) for p in node.iter() if local_name(p.tag) == "Polygon" for r in p.iter()}
    for g in node.iter():
        what = local_name(g.tag)
        if what in OTHERS and id(g) not in rings:
            faults.append(f"SKIPPED_{what}")
        if what in NEEDED:
            points = coordinates(_ring_text(g))
            if what == "Polygon" and points and points[0] != points[-1]:
                points.append(points[0])
            if len(points) >= NEEDED[what]:
                out.append((name, what, points, properties))
            else:
                faults.append(f"TOO_FEW_VERTICES_{what}")
    return out, faults


def document(content: bytes) -> tuple[list[tuple], Counter]:
    """(name, folder path, geometry type, vertices, properties) in document order, and the faults with their numbers.

    Lines need two vertices, rings four; a file that is no document, too large or declares entities gives a fault only.
    """
    faults: Counter = Counter()
    if content[:2] == b"PK":
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                kml = next((n for n in z.namelist() if n.lower().endswith(".kml")), None)
                if kml is None:
                    return [], Counter(["NO_KML"])
                if z.getinfo(kml).file_size > MAX_BYTES:
                    return [], Counter(["TOO_LARGE"])
                content = z.read(kml)
        except zipfile.BadZipFile:
            return [], Counter(["MALFORMED"])
    if len(content) > MAX_BYTES:
        return [], Counter(["TOO_LARGE"])
    if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
        return [], Counter(["ENTITIES"])  # never expanded
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return [], Counter(["MALFORMED"])
    out: list[tuple] = []

    def walk(node, folders: tuple[str, ...]) -> None:
        kind = local_name(node.tag)
        if kind == "Placemark":
            rows, left = placemark(node)
            out.extend((name, " / ".join(folders), *rest) for name, *rest in rows)
            faults.update(left)
            return
        name = name_of(node)
        below = (*folders, name) if kind == "Folder" and name else folders
        for c in node:
            walk(c, below)

    walk(root, ())
    return out, faults


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of all KMZ or KML files under a path, one file to a task at a time; ``kmz_faults`` tells what isn't among them."""

    def parse(frames):
        for frame in frames:
            rows = []
            for file, content in zip(frame["path"], frame["content"]):
                for k, (name, folder, kind, points, properties) in enumerate(document(bytes(content))[0]):
                    rows.append((file, k, name, folder, kind, [p[0] for p in points], [p[1] for p in points], properties))
            yield pd.DataFrame(rows, columns=["path", "ordinal", "name", "folder", "geometry_type", "lon", "lat", "properties"])

    return _files(spark, path).mapInPandas(parse, PLACEMARK)


def kmz_faults(spark: SparkSession, path: str) -> DataFrame:
    """Files that can't be read and placemarks that were left out, by file and reason."""

    def parse(frames):
        for frame in frames:
            rows = [(file, fault, n) for file, content in zip(frame["path"], frame["content"]) for fault, n in sorted(document(bytes(content))[1].items())]
            yield pd.DataFrame(rows, columns=["path", "fault", "n"])

    return _files(spark, path).mapInPandas(parse, FAULT)


def geometry_json(kind: Column, lon: Column, lat: Column) -> Column:
    """GeoJSON text of a point, line or ring from its vertices."""
    pairs = F.transform(F.arrays_zip(lon.alias("lon"), lat.alias("lat")), lambda p: F.concat(F.lit("["), p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]")))
    listed = F.array_join(pairs, ",")
    inside = F.when(kind == "Point", listed).when(kind == "LineString", F.concat(F.lit("["), listed, F.lit("]"))).when(kind == "Polygon", F.concat(F.lit("[["), listed, F.lit("]]")))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), inside, F.lit("}"))


def feature_collection(rows: DataFrame, key: list[str], lon: str, lat: str, properties: list[str], order: list[str]) -> DataFrame:
    """One GeoJSON FeatureCollection for each key, features in the given order."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, feature.alias("feature")))), lambda r: r["feature"])
    return rows.groupBy(*key).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), listed.alias("features"))).alias("geojson"))


def write_csv_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Each section of a report to its own folder, NULL money as ``Not costed``."""
    for name, rows in sections.items():
        money = [c for c, t in rows.dtypes if t.startswith("decimal")]
        rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("Not costed")).alias(c) if c in money else F.col(c) for c in rows.columns]).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
