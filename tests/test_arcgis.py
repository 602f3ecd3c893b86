"""The feature layer source against a local HTTP server."""
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from spanline.names import fetch_road_network_info
from spanline.sources import arcgis

FIELDS = [("OBJECTID", "esriFieldTypeOID"), ("ROAD", "esriFieldTypeString"), ("START_SLK", "esriFieldTypeDouble"), ("LANES", "esriFieldTypeSmallInteger"), ("BUILT", "esriFieldTypeDate"), ("NOTE", "esriFieldTypeString")]
ROWS = [{"OBJECTID": k, "ROAD": f"H{k % 4:03}", "START_SLK": k if k % 2 else k / 2, "LANES": None if k % 7 == 0 else k % 3, "BUILT": 10**12 + k, "NOTE": "it's"} for k in range(57)]


class Layer(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.seen.append(q)
        rows = ROWS
        if "ROAD = 'H001'" in q["where"]:
            rows = [r for r in rows if r["ROAD"].lower() == "h001"]
        if "LANES > 0" in q["where"]:
            rows = [r for r in rows if r["LANES"]]
        names = [n for n, _ in FIELDS] if q["outFields"] == "*" else q["outFields"].split(",")
        if "returnCountOnly" in q:
            out = {"count": len(rows)}
        else:
            at, n = int(q.get("resultOffset", 0)), int(q["resultRecordCount"])
            geometry = {"geometry": {"x": 1.5}} if q["returnGeometry"] == "true" else {}
            out = {"fields": [{"name": n, "type": t} for n, t in FIELDS if n in names], "features": [{"attributes": {n: r[n] for n in names}} | geometry for r in rows[at : at + n]]}
        body = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Layer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/0/query"
    server.shutdown()


def test_every_attribute_arrives_with_its_type(spark, url):
    got = fetch_road_network_info(spark, url, chunk_limit=10, columns=["*"])
    assert dict(got.dtypes) == {"OBJECTID": "bigint", "ROAD": "string", "START_SLK": "double", "LANES": "int", "BUILT": "bigint", "NOTE": "string"}
    assert got.rdd.getNumPartitions() == 6
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == [tuple(r.values()) for r in ROWS]


def test_filters_and_columns_narrow_the_request(spark, url):
    d = fetch_road_network_info(spark, url, chunk_limit=10, columns=["ROAD", "LANES", "OBJECTID"]).where("ROAD = 'H001' and LANES > 0").select("OBJECTID")
    Layer.seen.clear()
    assert sorted(r[0] for r in d.collect()) == [r["OBJECTID"] for r in ROWS if r["ROAD"] == "H001" and r["LANES"]]
    data = [q for q in Layer.seen if "returnCountOnly" not in q]
    assert len(data) == 1 and all("ROAD = 'H001'" in q["where"] and "LANES > 0" in q["where"] for q in Layer.seen)
    assert {frozenset(q["outFields"].split(",")) for q in Layer.seen} == {frozenset(("ROAD", "LANES", "OBJECTID"))}


def test_a_schema_names_what_is_fetched(spark, url):
    spark.dataSource.register(arcgis.ArcGISDataSource)
    Layer.seen.clear()
    d = spark.read.format("arcgis").schema("NOTE string, START_SLK double").option("url", url).load()
    assert d.agg(F.count("NOTE"), F.sum("START_SLK")).first()[0] == 57
    assert {q["outFields"] for q in Layer.seen} == {"NOTE,START_SLK"}


def test_geometry_and_layers_without_a_description(spark, url):
    got = fetch_road_network_info(spark, url, columns=["ROAD"], returnGeometry="true")
    assert got.columns == ["ROAD", "geometry"] and json.loads(got.first().geometry) == {"x": 1.5}
    plain = lambda u, p, t: {"features": [{"attributes": {"A": 1, "B": 1.5, "C": "x", "D": None}}]}
    assert arcgis.layer_schema("u", {}, 1, plain) == "`A` bigint, `B` double, `C` string, `D` string"
    assert arcgis.layer_schema("u", {}, 1, lambda u, p, t: {"features": []}) == arcgis.SCHEMA


def test_conditions_never_lose_a_row():
    e = lambda f, v: f(("A",), v)
    assert arcgis.condition(e(arcgis.EqualTo, "it's")) == "A = 'it''s'"
    assert arcgis.condition(e(arcgis.GreaterThan, "a")) is None and arcgis.condition(e(arcgis.LessThanOrEqual, 2.5)) == "A <= 2.5"
    assert arcgis.condition(e(arcgis.In, (1, 2))) == "A IN (1, 2)" and arcgis.condition(e(arcgis.In, (None, 2))) is None
    assert arcgis.condition(arcgis.IsNotNull(("A",))) == "A IS NOT NULL" and arcgis.condition(arcgis.EqualTo(("A", "B"), 1)) is None
    assert arcgis.condition(e(arcgis.EqualTo, float("nan"))) is None and arcgis.condition(e(arcgis.EqualTo, True)) is None
