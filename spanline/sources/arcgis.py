"""ArcGIS REST feature layer as a Python data source: one offset range for each partition."""
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

FIELDS = "ROAD,START_SLK,END_SLK,CWY,NETWORK_TYPE,START_TRUE_DIST,END_TRUE_DIST,RA_NO"
SCHEMA = "ROAD string, START_SLK double, END_SLK double, CWY string, NETWORK_TYPE string, START_TRUE_DIST double, END_TRUE_DIST double, RA_NO string"


def http_get(url: str, params: dict, timeout: float) -> dict:
    """GET with three retries, backing off by halves, on 429 and 5xx."""
    for k in range(4):
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or k == 3:
                raise
            time.sleep(0.5 * 2**k)


def parameters(query_params: dict | None, additional: dict | None, **kwargs) -> dict:
    """query_params replace the defaults; additional, then kwargs override; the order is always set."""
    base = dict(query_params) if query_params is not None else {"where": "1=1", "outFields": FIELDS, "returnGeometry": "false", "f": "json"}
    return {"orderByFields": "OBJECTID"} | base | (additional or {}) | kwargs


def _body(x, what: str):
    if not isinstance(x, dict):
        raise ValueError("the answer is no object")
    if "error" in x:
        raise ValueError(f"the server reports {x['error']}")
    if what not in x or what == "features" and not isinstance(x[what], list):
        raise ValueError(f"the answer lacks {what}")
    return x


def count(url, params, timeout, get=http_get) -> int:
    return int(_body(get(url, params | {"returnCountOnly": "true"}, timeout), "count")["count"])


def features(url, params, start: int, stop: int, size: int, timeout, get=http_get):
    """The features from start to stop."""
    at = start
    while at < stop:
        x = _body(get(url, params | {"resultOffset": at, "resultRecordCount": min(size, stop - at)}, timeout), "features")
        yield from x["features"]
        at += len(x["features"])
        if not x["features"]:
            if x.get("exceededTransferLimit"):
                raise RuntimeError("an empty page says that more follow")
            return


def pages(url, params, start: int, stop: int, size: int, timeout, get=http_get):
    """Attributes of the features from start to stop."""
    return (f["attributes"] for f in features(url, params, start, stop, size, timeout, get))


class _Range(InputPartition):
    def __init__(self, start, stop):
        self.start, self.stop = start, stop


#: Spark types of field types; dates are milliseconds since 1970, as the service sends them.
TYPES = {"esriFieldTypeDouble": "double", "esriFieldTypeSingle": "double", "esriFieldTypeInteger": "int", "esriFieldTypeSmallInteger": "int", "esriFieldTypeBigInteger": "bigint", "esriFieldTypeOID": "bigint", "esriFieldTypeDate": "bigint"}


def layer_schema(url, params, timeout, get=http_get) -> str:
    """The fields that params ask for, with their types, from the description that comes with one row."""
    x = _body(get(url, params | {"resultRecordCount": 1}, timeout), "features")
    fields = x.get("fields")
    if fields is None:
        rows = [f["attributes"] for f in x["features"]]
        kind = lambda v: "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
        listed = [f"`{n}` {kind(v)}" for n, v in (rows[0] if rows else {}).items()]
    else:
        listed = [f"`{f['name']}` {TYPES.get(f['type'], 'string')}" for f in fields]
    if str(params.get("returnGeometry")).lower() == "true":
        listed.append("geometry string")
    return ", ".join(listed) or SCHEMA


def _literal(v) -> str | None:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None


def condition(f) -> str | None:
    """A filter as a where clause that no wanted row fails, or None.

    A server may compare text without regard to case and in an order of its own, so text is only asked to be equal.
    """
    if len(getattr(f, "attribute", ("", ""))) != 1:
        return None
    name = f.attribute[0]
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL"
    if isinstance(f, In):
        got = [_literal(v) for v in f.value]
        return f"{name} IN ({', '.join(got)})" if got and None not in got else None
    sign = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
    value = _literal(f.value) if sign else None
    return f"{name} {sign} {value}" if value and (sign == "=" or not isinstance(f.value, str)) else None


def settings(options) -> tuple[str, dict, int, float]:
    """(url, parameters, rows of a request, timeout) of a source's options; `columns` names the fields to ask for."""
    size, timeout = int(options.get("chunk_limit", 1000)), float(options.get("request_timeout", 30))
    if size <= 0 or timeout <= 0:
        raise ValueError("chunk_limit and request_timeout must be positive")
    params = parameters(json.loads(options["query_params"]) if "query_params" in options else None, json.loads(options.get("additional_params", "{}")))
    if "columns" in options:
        params["outFields"] = options["columns"]
    return options["url"], params, size, timeout


class _Reader(DataSourceReader):
    def __init__(self, schema, options, get=http_get):
        self.names, self.get = schema.fieldNames(), get
        self.whole = {f.name for f in schema if f.dataType.typeName() in ("integer", "long")}
        self.real = {f.name for f in schema if f.dataType.typeName() == "double"}
        self.url, self.params, self.size, self.timeout = settings(options)
        # What the schema names is all that is sent.
        self.params["outFields"] = ",".join(n for n in self.names if n != "geometry") or "OBJECTID"

    def pushFilters(self, filters):
        """Filters that the service can narrow by join the where clause; Spark evaluates all of them again."""
        for f in filters:
            clause = condition(f)
            if clause and f.attribute[0] != "geometry":
                where = self.params.get("where", "1=1")
                self.params["where"] = clause if where == "1=1" else f"({where}) AND {clause}"
            yield f

    def partitions(self):
        n = count(self.url, self.params, self.timeout, self.get)
        return [_Range(a, min(n, a + self.size)) for a in range(0, n, self.size)] or [_Range(0, 0)]

    def read(self, part):
        for f in features(self.url, self.params, part.start, part.stop, self.size, self.timeout, self.get):
            a = f["attributes"]
            yield tuple(json.dumps(f.get("geometry")) if n == "geometry" and n not in a and "geometry" in f else self._cell(n, a.get(n)) for n in self.names)

    def _cell(self, name, v):
        if v is None:
            return None
        return int(v) if name in self.whole else float(v) if name in self.real else v


class ArcGISDataSource(DataSource):
    """spark.read.format("arcgis").option("url", ...).load()

    The schema is the layer's, for the fields that outFields (or `columns`) names, "*" for all; with
    .schema(...) only the fields named there are fetched. Filters narrow the request where
    spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls):
        return "arcgis"

    def schema(self):
        url, params, _, timeout = settings(self.options)
        return layer_schema(url, params, timeout)

    def reader(self, schema):
        return _Reader(schema, self.options)
