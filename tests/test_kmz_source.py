"""The KMZ and GeoJSON formats: streams of placemarks, faults, commits and what a failed write leaves."""

import json
import zipfile

import pytest

from windloom.sources import kmz_source, survey

HEAD, TAIL = '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"


def point(name, lon=1.5, lat=2.5):
    return f"<Placemark><name>{name}</name><ExtendedData><Data name='k'><value>{name}!</value></Data></ExtendedData><Point><coordinates>{lon},{lat},0</coordinates></Point></Placemark>"


BODY = f"""<Folder><name>Site</name><Folder><name>WTG</name>{point('A')}</Folder>{point('B', 'nan')}
<Placemark><name>P</name><Polygon><innerBoundaryIs><LinearRing><coordinates>4,4 5,4 5,5 4,4</coordinates></LinearRing></innerBoundaryIs><outerBoundaryIs><LinearRing><coordinates>0,0 9,0 9,9</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder>
<Placemark><name>L</name><MultiGeometry><LineString><coordinates>0,0 1,1</coordinates></LineString><LineString><coordinates>0,0</coordinates></LineString></MultiGeometry></Placemark>"""


@pytest.fixture()
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.kml").write_text(HEAD + BODY + TAIL)
    with zipfile.ZipFile(folder / "b.kmz", "w") as z:
        z.writestr("doc.kml", HEAD + point("Z") + TAIL)
    (folder / "c.kml").write_text(HEAD + point("half"))
    (folder / "d.kml").write_text('<!DOCTYPE k [<!ENTITY x "y">]>' + HEAD + TAIL)
    (folder / "e.kmz").write_bytes(b"PK nothing")
    (folder / "f.kml").write_text("")
    (folder / "notes.txt").write_text("no survey")
    return folder


def test_reads_what_the_batch_reader_reads(spark, files):
    kmz_source.register(spark)
    rows = spark.read.format("kmz").load(str(files)).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["ordinal"])):
        by_file.setdefault(r["path"][-5:], []).append(r)
    good = [(r["name"], r["folder"], r["geometry_type"], list(zip(r["lon"], r["lat"])), r["properties"]) for r in by_file["a.kml"] if r["fault"] is None]
    assert good == survey.document((HEAD + BODY + TAIL).encode())[0]
    assert [(g[0], g[1]) for g in good] == [("A", "Site / WTG"), ("P", "Site"), ("L", "")]
    assert good[1][3] == [(0, 0), (9, 0), (9, 9), (0, 0)]  # the outer boundary, closed, though the hole comes first
    assert sorted(r["fault"] for r in by_file["a.kml"] if r["fault"]) == ["TOO_FEW_VERTICES_LineString", "TOO_FEW_VERTICES_Point"]
    assert [r["name"] for r in by_file["b.kmz"]] == ["Z"]
    assert [(r["name"], r["fault"]) for r in by_file["c.kml"]] == [("half", None), (None, "MALFORMED")]
    assert [r["fault"] for r in by_file["d.kml"] + by_file["e.kmz"] + by_file["f.kml"]] == ["ENTITIES", "MALFORMED", "MALFORMED"]
    assert set(by_file) == {"a.kml", "b.kmz", "c.kml", "d.kml", "e.kmz", "f.kml"}
    with pytest.raises(Exception, match="ENTITIES"):
        spark.read.format("kmz").option("mode", "FAILFAST").load(str(files / "d.kml")).collect()


def test_a_file_is_a_stream(tmp_path):
    path = tmp_path / "big.kml"
    with open(path, "w") as out:
        out.write(HEAD + "<Folder><name>All</name>")
        for k in range(30_000):
            out.write(point(f"T{k}") + " " * 100)
        out.write("</Folder>" + TAIL)
    assert path.stat().st_size > 4 * kmz_source.CHUNK
    import tracemalloc

    tracemalloc.start()
    assert sum(1 for row in kmz_source.rows_of(str(path)) if row[3] == "All") == 30_000
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


def test_writes_collections_and_nothing_on_failure(spark, tmp_path):
    kmz_source.register(spark)
    schema = "id long, geometry_type string, lon array<double>, lat array<double>"
    good = [(k, kind, [0.0, 9.0, 9.0, 0.0][:n], [0.0, 0.0, 9.0, 0.0][:n]) for k, (kind, n) in enumerate([("Point", 1), ("LineString", 3), ("Polygon", 4)] * 4)]
    out = tmp_path / "out"
    spark.createDataFrame(good, schema).repartition(3).write.format("geojson_features").mode("append").save(str(out))
    read = lambda: [f for p in sorted(out.glob("part-*")) for f in json.loads(p.read_text())["features"]]
    features = read()
    assert sorted(f["properties"]["id"] for f in features) == list(range(12))
    assert {f["geometry"]["type"]: f["geometry"]["coordinates"] for f in features}["Polygon"] == [[[0, 0], [9, 0], [9, 9], [0, 0]]]
    with pytest.raises(Exception, match="vertices"):
        spark.createDataFrame([*good, (99, "Point", [float("nan")], [1.0])], schema).repartition(3).write.format("geojson_features").mode("append").save(str(out))
    assert len(read()) == 12 and not list(out.glob("_*"))
    spark.createDataFrame(good[:2], schema).write.format("geojson_features").mode("overwrite").save(str(out))
    assert len(read()) == 2
