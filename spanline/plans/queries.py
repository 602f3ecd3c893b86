"""Registered queries of the interval operators and their DuckDB SQL."""
from pyspark.sql import functions as F

from ..functions import mappings as M
from ..functions import stats, steps
from ..operators import homogeneous, reshape, segments
from ..operators.aggregations import Action, Aggregation as A
from ..operators.merge import on_intervals, on_slk_intervals
from ..tables import written
from . import views as V

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _rounded(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _merge(s, d, *actions):
    t = V.grid(s, d, 100.0).select("road", F.col("f").alias("slk_from"), F.col("t").alias("slk_to"))
    g = V.gap(s, d).select("road", "rid", F.col("f").alias("slk_from"), F.col("t").alias("slk_to"), "cents", "qty", "st")
    return on_slk_intervals(t, g, ["road"], list(actions), ("slk_from", "slk_to"), "rid")


def _merged(s, d, *actions):
    return _rounded(_merge(s, d, *actions))


def _shares(s, d, kind):
    return _merge(s, d, Action("cents", kind, "v")).withColumn("v", F.round(F.col("v") + _OFF, 3))


_PAIRS = V.sql("obs", "gap", "tgt", "pairs")


def _agg(expr):
    return _PAIRS + f"SELECT road, slk_from, slk_to, {expr} AS v FROM pairs GROUP BY road, slk_from, slk_to"


def _longest(v):
    return _PAIRS + f"SELECT road, slk_from, slk_to, first({v} ORDER BY tw DESC, mt, mi) AS v FROM (SELECT road, slk_from, slk_to, {v}, sum(w) AS tw, min(dt) AS mt, arg_min(i, dt) AS mi FROM pairs GROUP BY ALL) GROUP BY road, slk_from, slk_to"


_PERCENTILE = _PAIRS + """, x AS (SELECT road, slk_from, slk_to, cents AS v, coalesce(sum(h) OVER (PARTITION BY road, slk_from ORDER BY cents, dt, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS x, row_number() OVER o AS k, count(cents) OVER (PARTITION BY road, slk_from) AS n
FROM (SELECT *, (lag(w) OVER o + w) / 2 AS h FROM pairs WINDOW o AS (PARTITION BY road, slk_from ORDER BY cents, dt, i)) WINDOW o AS (PARTITION BY road, slk_from ORDER BY cents, dt, i)),
y AS (SELECT *, x / max(x) OVER (PARTITION BY road, slk_from) AS p, lag(v) OVER o AS v0, lag(x) OVER o / max(x) OVER (PARTITION BY road, slk_from) AS p0 FROM x WINDOW o AS (PARTITION BY road, slk_from ORDER BY k))
SELECT road, slk_from, slk_to, round(first(CASE WHEN n <= 1 OR k = 1 THEN v ELSE v0 + (v - v0) * (0.75 - p0) / (p - p0) END ORDER BY k) + 0.0000211, 4) AS v FROM y WHERE n <= 1 OR p >= 0.75 GROUP BY road, slk_from, slk_to"""
#: Shares of cents often end in a decimal 5, which a sum in another order rounds either way: what is rounded is moved off such ties.
_OFF = 0.00037
_KINDS = {
    "average": ("cents", A.Average(), _agg("round(avg(cents), 6)")),
    "length_weighted_average": ("cents", A.LengthWeightedAverage(), _agg("round(sum(cents * w) / sum(w), 6)")),
    "first": ("st", A.First(), _agg("arg_min(st, i)")),
    "sum": ("cents", A.Sum(), _agg("sum(cents)")),
    "sum_proportion_of_target": ("cents", A.SumProportionOfTarget(), _agg("round(sum(cents * w) / max(tlen), 6)")),
    "min": ("cents", A.Min(), _agg("min(cents)")),
    "max": ("cents", A.Max(), _agg("max(cents)")),
    "index_of_min": ("qty", A.IndexOfMin(), _agg("first(i ORDER BY qty, dt, i)")),
    "index_of_max": ("qty", A.IndexOfMax(), _agg("first(i ORDER BY qty DESC, dt, i)")),
    "keep_longest_numeric": ("qty", A.KeepLongest(), _longest("qty")),
    "keep_longest_text": ("st", A.KeepLongest(), _longest("st")),
    "keep_longest_segment": ("st", A.KeepLongestSegment(), _agg("first(st ORDER BY w DESC, dt, i)")),
}
for _n, (_c, _a, _s) in _KINDS.items():
    query(f"merge_{_n}", _s)(lambda s, d, c=_c, a=_a: _merged(s, d, Action(c, a, "v")))


# Interpolated values of seven places before the point end in a tie now and then: moved off it likewise, to 4 places.
@query("merge_length_weighted_percentile", _PERCENTILE)
def _(s, d):
    return _merge(s, d, Action("cents", A.LengthWeightedPercentile(0.75), "v")).withColumn("v", F.round(F.col("v") + 0.0000211, 4))


@query("merge_sum_proportion_of_data", _agg(f"round(sum(cents * w / len) + {_OFF}, 3)"))
def _(s, d):
    return _shares(s, d, A.SumProportionOfData())


@query("merge_proportional_sum", _agg(f"round(sum(cents * w / len) + {_OFF}, 3)"))
def _(s, d):
    return _shares(s, d, A.ProportionalSum())


_MULTI = [Action("cents", A.LengthWeightedAverage(), "lwa"), Action("cents", A.Sum(), "total"), Action("qty", A.Max(), "top"), Action("st", A.KeepLongestSegment(), "st")]
query("merge_multi_action", _PAIRS + "SELECT road, slk_from, slk_to, round(sum(cents * w) / sum(w), 6) AS lwa, sum(cents) AS total, max(qty) AS top, first(st ORDER BY w DESC, dt, i) AS st FROM pairs GROUP BY road, slk_from, slk_to")(lambda s, d: _merged(s, d, *_MULTI))
query("merge_unmatched_targets", _PAIRS + "SELECT road, slk_from, slk_to FROM pairs WHERE i IS NULL")(lambda s, d: _merged(s, d, Action("cents", A.Sum(), "v")).where("v is null").drop("v"))


@query("on_intervals_adapter", _agg("sum(cents)"))
def _(s, d):
    t, g = V.grid(s, d, 100.0).drop("rid"), V.gap(s, d)
    return on_intervals(t, g, ["road"], "f", "t", [("cents", "sum", "v")], "rid").toDF("road", "slk_from", "slk_to", "v")


@query("merge_binned", _agg("sum(cents)"))
def _(s, d):
    t, g = V.grid(s, d, 100.0).drop("rid"), V.gap(s, d)
    return on_slk_intervals(t, g, ["road"], [Action("cents", A.Sum(), "v")], ("f", "t"), "rid", bin_width=100.0).toDF("road", "slk_from", "slk_to", "v")


_IDS = "SELECT rid, CAST(sum(b) OVER (ORDER BY road, flag, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS segment_id FROM (SELECT road, flag, rid, CASE WHEN coalesce(lag({t}) OVER o <> {f}, true){more} THEN 1 ELSE 0 END AS b FROM obs WINDOW o AS (PARTITION BY road, flag ORDER BY rid))"
query("segment_ids_slk", V.sql("obs") + _IDS.format(f="sf", t="s", more=""))(lambda s, d: segments.segment_ids(V.obs(s, d), ["road", "flag"], ("sf", "s")).select("rid", "segment_id"))
query("segment_ids_true", V.sql("obs") + _IDS.format(f="sf", t="s", more=" OR coalesce(lag(t) OVER o <> f, true)"))(lambda s, d: segments.segment_ids(V.obs(s, d), ["road", "flag"], ("sf", "s"), ("f", "t")).select("rid", "segment_id"))
query("linspace_steps", V.sql("obs") + "SELECT rid, unnest(list_concat([f], list_filter(list_transform(range((floor(f / 7) + 1)::BIGINT, ceil(t / 7)::BIGINT), lambda k: k * 7.0::DOUBLE), lambda x: NOT (x - f < 2 AND x - 7 <= f) AND NOT (t - x < 2 AND x + 7 >= t)), [t])) AS at FROM obs")(
    lambda s, d: V.obs(s, d).select("rid", F.explode(steps.linspace_steps(F.col("f"), F.col("t"), 7.0, 2.0)).alias("at")))
query("fixed_steps", V.sql("obs") + "SELECT rid, unnest(list_concat(list_transform(range(0, ceil((t - f) / 7)::BIGINT), lambda k: f + k * 7), [t])) AS at FROM obs")(lambda s, d: V.obs(s, d).select("rid", F.explode(steps.fixed_steps(F.col("f"), F.col("t"), 7.0)).alias("at")))
query("as_metres", "SELECT l_orderkey, l_linenumber, round_even(l_discount * 1000, 0)::BIGINT AS m FROM lineitem")(lambda s, d: V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", steps.as_metres(F.col("l_discount")).alias("m")))

_SEG = ", e AS (SELECT *, CASE WHEN coalesce(lag(s) OVER o <> sf OR lag(t) OVER o <> f, true) THEN 1 ELSE 0 END AS b FROM obs WINDOW o AS (PARTITION BY road ORDER BY rid)), i AS (SELECT *, sum(b) OVER (ORDER BY road, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS g FROM e), m AS (SELECT road, g, min(sf) AS a, max(s) AS z, min(f) AS c, max(t) AS y FROM i GROUP BY road, g), p AS (SELECT *, unnest(list_distinct(list_concat([a], list_transform(range((floor(a / 60) + 1)::BIGINT, ceil(z / 60)::BIGINT), lambda k: k * 60.0::DOUBLE)))) AS x FROM m), q AS (SELECT *, lead(x, 1, z) OVER (PARTITION BY g ORDER BY x) AS x2 FROM p) "
query("split_max_length", V.sql("obs") + _SEG + "SELECT road, g::BIGINT AS segment_index, x AS sf, x2 AS s, x - a + c AS f, x2 - a + c AS t, (SELECT first(i.st ORDER BY least(i.s, q.x2) - greatest(i.sf, q.x) DESC, i.sf, i.rid) FROM i WHERE i.g = q.g AND i.sf < q.x2 AND i.s > q.x) AS st FROM q")(
    lambda s, d: segments.split_to_max_length(V.obs(s, d).select("road", "rid", "sf", "s", "f", "t", "st"), ["road"], ("sf", "s"), ("f", "t"), 60.0).drop("rid"))
query("longest_overlap", _agg("first(i ORDER BY w DESC, dt - len, i)"))(lambda s, d: segments.longest_overlap(V.grid(s, d, 100.0).drop("rid"), V.gap(s, d), ["road"], ("f", "t"), "rid", "v").toDF("road", "slk_from", "slk_to", "v"))
query("overlay", V.sql("obs", "tgt", "segb") + """, p AS (SELECT road, f AS x FROM tgt UNION SELECT road, t FROM tgt UNION SELECT road, f FROM segb UNION SELECT road, t FROM segb), q AS (SELECT road, x AS f, lead(x) OVER (PARTITION BY road ORDER BY x) AS t FROM p)
SELECT q.road, q.f AS sf, q.t AS s, q.f, q.t, a.rid AS o, b.rid AS n FROM q LEFT JOIN tgt a ON a.road = q.road AND a.f <= q.f AND a.t >= q.t LEFT JOIN segb b ON b.road = q.road AND b.f <= q.f AND b.t >= q.t WHERE q.t IS NOT NULL AND (a.rid IS NOT NULL OR b.rid IS NOT NULL)""")(
    lambda s, d: segments.overlay(*[V.grid(s, d, *w).withColumns({"sf": F.col("f"), "s": F.col("t")}) for w in ((100.0,), (137.0, 50.0))], ["road"], ("sf", "s"), ("f", "t"), "o", "n"))
_CROSS = V.sql("obs", "lanes") + """, p AS (SELECT road, f AS x FROM lanes UNION SELECT road, t FROM lanes), q AS (SELECT road, x AS a, lead(x) OVER (PARTITION BY road ORDER BY x) AS b FROM p),
act AS (SELECT q.road, a, b, l.flag, l.st, l.rid, l.f FROM q JOIN lanes l ON l.road = q.road AND l.f <= q.a AND l.t >= q.b), g AS (SELECT road, a, b, string_agg(flag || st, ',' ORDER BY f, flag, st) AS sig FROM act GROUP BY road, a, b),
h AS (SELECT *, CASE WHEN sig IS NOT DISTINCT FROM lag(sig) OVER (PARTITION BY road ORDER BY a) THEN 0 ELSE 1 END AS nw FROM g), n AS (SELECT *, (sum(nw) OVER (ORDER BY road, a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::BIGINT AS k FROM h),
e AS (SELECT k, min(a) AS f, max(b) AS t FROM n GROUP BY k) """
_cross = lambda s, d: segments.cross_sections_normalised(V.lanes(s, d), ["road"], ["flag", "st"], ("sf", "s"), ("f", "t"))
query("cross_sections", _CROSS + "SELECT n.road, n.k AS cross_section_number, e.f AS sf, e.t AS s, e.f, e.t, flag, st, rid AS original_index, sum(n.b - n.a) AS overlap FROM n JOIN act ON act.road = n.road AND act.a = n.a JOIN e ON e.k = n.k GROUP BY ALL")(lambda s, d: segments.cross_sections(V.lanes(s, d), ["road"], ["flag", "st"], ("sf", "s"), ("f", "t")))
query("cross_sections_groups", _CROSS + "SELECT DISTINCT n.road, n.k AS cross_section_number, e.f AS sf, e.t AS s, e.f, e.t FROM n JOIN e ON e.k = n.k")(lambda s, d: _cross(s, d)[0])
query("check_monotonic", V.sql("obs", "gap") + "SELECT bool_and(x) AS ok FROM (SELECT lag(t, 1, 0) OVER (PARTITION BY road ORDER BY rid) <= f AS x FROM gap)")(lambda s, d: segments.check_monotonic(V.gap(s, d), ["road"], ("f", "t"), "rid"))
query("check_reversed", V.sql("obs", "gap") + "SELECT bool_and(f <= t) AS ok FROM gap")(lambda s, d: segments.check_no_reversed(V.gap(s, d), ("f", "t")))
query("check_linear_index", V.sql("obs") + "SELECT count(*) FILTER (f IS NULL OR t IS NULL) AS n_missing, count(*) FILTER (f > t) AS n_reversed, count(*) FILTER (f = t) AS n_zero FROM obs")(lambda s, d: segments.linear_index_faults(V.obs(s, d), ["f", "t"]))
query("check_disjoint", V.sql("obs", "gap") + "SELECT bool_and(x) AS ok FROM (SELECT coalesce(f >= lag(t) OVER (PARTITION BY road ORDER BY rid), true) AS x FROM gap)")(lambda s, d: segments.check_disjoint(V.gap(s, d), ("f", "t"), ["road"], "rid"))

_QP = V.sql("obs") + ", c AS (SELECT *, cents / 1e6 AS v FROM obs), w AS (SELECT road, rid, rn, sum(1.0::DOUBLE) OVER l AS nl, sum(v) OVER l AS sl, sum(v * v) OVER l AS ql, sum(1.0::DOUBLE) OVER r AS nr, sum(v) OVER r AS sr, sum(v * v) OVER r AS qr, sum(1.0::DOUBLE) OVER a AS na, sum(v) OVER a AS sa, sum(v * v) OVER a AS qa FROM c WINDOW l AS (PARTITION BY road ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY road ORDER BY rid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), a AS (PARTITION BY road)) "
_cond = lambda s, d: V.obs(s, d).withColumn("v", F.col("cents") / 1e6)
_Q = "1 - ((ql - sl * sl / nl) + (qr - sr * sr / nr)) / (qa - sa * sa / na)"
query("cumulative_q", _QP + f"SELECT rid, round({_Q}, 8) AS q FROM w WHERE nr IS NOT NULL")(lambda s, d: _rounded(homogeneous.cumulative_q(_cond(s, d), ["road"], "rid", "v").select("rid", "q"), 8))
_CV = "CASE WHEN n{0} > 1 THEN sqrt(greatest(0, (n{0} * q{0} / (s{0} * s{0}) - 1) * n{0} / (n{0} - 1))) END"
query("cumulative_p", _QP + f"SELECT rid, round(({_CV.format('l')} + {_CV.format('r')}) / 2, 7) AS p FROM w WHERE nr IS NOT NULL")(lambda s, d: _rounded(homogeneous.cumulative_p(_cond(s, d), ["road"], "rid", "v").select("rid", "p"), 7))
query("best_bisection", _QP + f", x AS (SELECT w.*, o.len, o.tot, o.nxt FROM w JOIN (SELECT rid, t AS len, max(t) OVER (PARTITION BY road) AS tot, lead(t) OVER (PARTITION BY road ORDER BY rid) AS nxt FROM obs) o USING (rid)), y AS (SELECT road, rid, {_Q} AS q, coalesce(len > 100 AND tot - CASE WHEN nxt = tot THEN len ELSE nxt END > 100, false) AS inn FROM x WHERE nr IS NOT NULL) SELECT road, first(rid ORDER BY round(q, 9) DESC, rid) AS rid, round(max(q), 7) AS q FROM y WHERE inn GROUP BY road")(
    lambda s, d: _rounded(homogeneous.best_bisection(_cond(s, d), ["road"], "rid", "v", "qty", 100.0).groupBy("road").agg(F.min("rid").alias("rid"), F.max("best_q").alias("q")), 7))
_MEAN_Q = "CASE WHEN qa > 1e-24 * na * m * m THEN 1 - (greatest(0, q - s * s / n) + greatest(0, qa - q - s * s / (na - n))) / qa END"
_SIDE = "CASE WHEN {n} > 1 AND {s} + {n} * m <> 0 THEN sqrt(greatest(0, {q} - {s} * {s} / {n}) / ({n} - 1)) * {n} / abs({s} + {n} * m) END"
_MEAN_P = f"({_SIDE.format(n='n', s='s', q='q')} + {_SIDE.format(n='(na - n)', s='(-s)', q='(qa - q)')}) / 2"


def _bisected(x: str, best: str, equal: str) -> str:
    """Segments (road, a, z) split over and over at the places where x is best, by a recursive query; ids count the starts so far."""
    return V.sql("obs").replace("WITH ", "WITH RECURSIVE ", 1) + f""", c AS (SELECT road, rid, f, t, cents / 1e6 AS v, t - f AS len, row_number() OVER (PARTITION BY road ORDER BY f, t) AS k FROM obs),
g AS (SELECT road, 1::BIGINT AS a, max(k) AS z, sum(len) AS total FROM c GROUP BY road UNION ALL
SELECT road, b AS a, coalesce(lead(b) OVER (PARTITION BY road, a ORDER BY b), z + 1) - 1 AS z, len AS total FROM (
SELECT road, a, z, b, sum(len) AS len FROM (SELECT *, max(CASE WHEN k = a OR is_cut THEN k END) OVER (PARTITION BY road, a ORDER BY k) AS b, max(is_cut) OVER (PARTITION BY road, a) AS any_cut FROM (
SELECT *, coalesce({equal}, false) AS is_cut FROM (SELECT *, {best}(x) OVER (PARTITION BY road, a) AS best FROM (SELECT *, CASE WHEN n > 0 AND before > 200 AND la - before - CASE WHEN k = z THEN 0 ELSE len END > 200 THEN {x} END AS x FROM (
SELECT *, sum(1.0::DOUBLE) OVER p AS n, sum(v - m) OVER p AS s, sum((v - m) * (v - m)) OVER p AS q, sum(len) OVER p AS before, sum((v - m) * (v - m)) OVER w AS qa, count(*) OVER w AS na, sum(len) OVER w AS la
FROM (SELECT g.road, a, z, k, v, len, avg(v) OVER (PARTITION BY g.road, a) AS m FROM g JOIN c ON c.road = g.road AND k BETWEEN a AND z WHERE total > 1000)
WINDOW p AS (PARTITION BY road, a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY road, a)))))) WHERE any_cut GROUP BY road, a, z, b))
SELECT c.road, rid, f, t, v, sum(CASE WHEN i.a IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY c.road ORDER BY k)::BIGINT AS segment_id FROM c LEFT JOIN (SELECT DISTINCT road, a FROM g) i ON i.road = c.road AND i.a = c.k"""


for _n, _f, _s in (("shs", homogeneous.shs, _bisected(_MEAN_Q, "max", "x >= best - 1e-9")), ("mcv", homogeneous.mcv, _bisected(_MEAN_P, "min", "x <= best + 1e-9 * greatest(1, abs(best))"))):
    query(f"homogeneous_{_n}", _s)(lambda s, d, f=_f: f(_cond(s, d).select("road", "rid", "f", "t", "v"), ("f", "t"), ["v"], (200.0, 1000.0), ["road"]))
_km = lambda s, d: V.obs(s, d).select("rid", "road", "flag", "cents", (F.col("f") / 1000).alias("a"), (F.col("t") / 1000).alias("b"))
query("stretch", V.sql("obs") + "SELECT rid, unnest(range(f::BIGINT, t::BIGINT)) / 1000.0::DOUBLE AS SLK FROM obs")(lambda s, d: reshape.stretch(_km(s, d).select("rid", "a", "b"), "a", "b"))
query("make_segments", V.sql("obs") + "SELECT rid, f + k * 7 AS a, least(t, f + (k + 1) * 7) AS b, least(t, f + (k + 1) * 7) - (f + k * 7) AS Length FROM (SELECT *, unnest(range(0, ceil((t - f) / 7)::BIGINT)) AS k FROM obs)")(lambda s, d: reshape.make_segments(_km(s, d).select("rid", "a", "b"), "a", "b", max_segment=7, split_ends=False, as_km=False))
query("get_segments", V.sql("obs") + ", e AS (SELECT *, CASE WHEN coalesce(lag(t) OVER o <> f OR lag(flag) OVER o <> flag, true) THEN 1 ELSE 0 END AS b FROM obs WINDOW o AS (PARTITION BY road ORDER BY rid)), g AS (SELECT *, sum(b) OVER (PARTITION BY road ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e) SELECT road, flag, round(min(f) / 1000, 6) AS START_SLK, round(max(t) / 1000, 6) AS END_SLK, round(sum(cents * qty) / sum(qty), 4) AS m FROM g GROUP BY road, flag, k")(
    lambda s, d: reshape.get_segments(reshape.stretch(written(_km(s, d).drop("rid")), "a", "b"), ["road"], "SLK", 1, split_at=["flag"], summarise={"m": F.avg("cents")}).select("road", "flag", F.round("START_SLK", 6).alias("START_SLK"), F.round("END_SLK", 6).alias("END_SLK"), F.round("m", 4).alias("m")))
query("interval_merge", _agg("round(sum(cents * w) / sum(w), 6)"))(lambda s, d: _rounded(reshape.interval_merge(V.grid(s, d, 100.0).drop("rid"), V.gap(s, d), ["road"], "f", "t", {"v": "cents"}).toDF("road", "slk_from", "slk_to", "v")))

_XSP = "CASE l_linenumber % 4 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' WHEN 2 THEN 'R1' ELSE 'LO' END"
_item = lambda s, d: V.table(s, d, "lineitem").withColumn("xsp", F.expr(_XSP))
_ALL = M.LANES[:11]
query("lane_to_col", f"SELECT road, {', '.join(f'''max(q) FILTER (xsp = '{x}') AS q{x}''' for x in _ALL)} FROM (SELECT l_suppkey AS road, {_XSP} AS xsp, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) WHERE xsp <> 'LO' GROUP BY road")(
    lambda s, d: reshape.lane_to_col(_item(s, d).groupBy(F.col("l_suppkey").alias("road"), "xsp").agg(F.sum("l_quantity").alias("q")), "xsp", ["road"], ["q"]))
query("lane_to_row", "SELECT l_orderkey, l_linenumber, l_returnflag || n AS XSP, CASE n WHEN '1' THEN l_quantity ELSE l_tax END AS A, CASE n WHEN '1' THEN l_discount END AS B FROM lineitem, (VALUES ('1'), ('2')) v(n)")(
    lambda s, d: reshape.lane_to_row(V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("A_1"), F.col("l_tax").alias("A_2"), F.col("l_discount").alias("B_1")), "l_returnflag", ["l_orderkey", "l_linenumber"], ["A_", "B_"]))
query("lane_side_split", f"SELECT l_orderkey, l_linenumber, left(x, 1) AS SIDE, right(x, 1)::INT AS LANE_NO FROM (SELECT *, {_XSP} AS x FROM lineitem) WHERE x <> 'LO'")(lambda s, d: reshape.lane_side_split(_item(s, d).select("l_orderkey", "l_linenumber", "xsp"), "xsp"))
query("cway_to_side", "SELECT l_orderkey, l_linenumber, cw, side FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'L' WHEN 'N' THEN 'S' ELSE 'R' END AS cw FROM lineitem), (VALUES ('L'), ('R')) v(side) WHERE cw IN ('S', side)")(
    lambda s, d: reshape.cway_to_side(V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE l_returnflag WHEN 'A' THEN 'L' WHEN 'N' THEN 'S' ELSE 'R' END").alias("cw")), "cw"))


def _case(col, table):
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


for _n, _f, _t in (("lanes", lambda x: M.get_lanes(M.get_lanes(x, "dtims", "xsp"), "xsp", "description"), dict(zip(M.DTIMS, M.LANE_LABELS))), ("surface", M.surf_type, dict(zip(range(1, 14), M.SURFACES["short"]))), ("pavement", M.pavement_name, M.PAVEMENTS), ("region", M.region_name, M.REGIONS), ("route", M.route_description, dict(zip(range(1, 25), M.ROUTE_LABELS)))):
    query(f"map_{_n}", f"SELECT l_orderkey, l_linenumber, {_case('l_quantity::INT', _t)} AS name FROM lineitem")(lambda s, d, f=_f: V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", f(F.col("l_quantity").cast("int")).alias("name")))
query("most_common", "SELECT l_suppkey, first(q ORDER BY n DESC, q) AS m FROM (SELECT l_suppkey, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")(lambda s, d: V.table(s, d, "lineitem").groupBy("l_suppkey").agg(stats.most_common(F.col("l_quantity")).alias("m")))
query("quantiles", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY l_suppkey")(
    lambda s, d: _rounded(V.table(s, d, "lineitem").groupBy("l_suppkey").agg(*[getattr(stats, q)(F.col("l_extendedprice")).alias(q) for q in ("q75", "q90", "q95")]), 4))
query("deterioration", "SELECT l_orderkey, l_linenumber, k::INT AS k, round(l_extendedprice * pow(1 - (pow(1.0 + l_tax, 0.5) - 1), k), 4) AS v FROM lineitem, range(0, 7) r(k)")(
    lambda s, d: V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(stats.deteriorate(F.col("l_extendedprice"), F.col("l_tax"), n_periods=3, n_intervals=2)).alias("k", "v")).withColumn("v", F.round("v", 4)))


# Lookups and operators beyond the ones above.
_LI = lambda s, d, *c: V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *c)
_Q = "l_quantity::INT"
_q = lambda: F.col("l_quantity").cast("int")
_from = lambda x, values: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(x, F.lit(len(values))))
_list = lambda x, values: "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + f"][1 + {x} % {len(values)}]"
_SURF = M.SURFACES["short"]
for _n, _f, _values, _t in (
    ("lane_to_side", M.lane_to_side, ["L1", "R2", "LO", "X1", "RL3"], {"L1": "L", "R2": "R", "LO": "L", "RL3": "R"}),
    ("hsd_to_side", M.hsd_to_side, ["L", "R", "l", "r", "S"], {"L": "L", "R": "R", "l": "L", "r": "R"}),
    ("surface_number", M.surface_number, [*M.SURFACE_NAMES.values(), "none"], {v: k for k, v in M.SURFACE_NAMES.items()}),
    ("surf_id", M.surf_id, [*_SURF, "none"], {v: k + 1 for k, v in enumerate(_SURF)}),
    ("pavement_id", M.pavement_id, [*M.PAVEMENTS.values(), "none"], {v: k for k, v in M.PAVEMENTS.items()}),
    ("region_number", M.region_number, [*M.REGIONS.values(), "none"], {v: k for k, v in M.REGIONS.items()}),
    ("link_category", M.link_category, [*M.LINK_CATEGORIES, "ZZ"], M.LINK_CATEGORIES),
):
    query(f"map_{_n}", f"SELECT l_orderkey, l_linenumber, {_case(_list(_Q, _values), _t)} AS name FROM lineitem")(lambda s, d, f=_f, v=_values: _LI(s, d, f(_from(_q(), v)).alias("name")))
query("map_surface_name", f"SELECT l_orderkey, l_linenumber, {_case(_Q, M.SURFACE_NAMES)} AS name FROM lineitem")(lambda s, d: _LI(s, d, M.surface_name(_q()).alias("name")))
query("map_route_change", f"SELECT l_orderkey, l_linenumber, {_case(_list(_Q, [*M.OLD_ROUTES, 99.0]), {o: k + 1 for k, o in enumerate(M.OLD_ROUTES)})} AS name FROM lineitem")(lambda s, d: _LI(s, d, M.route_change(_from(_q(), [*M.OLD_ROUTES, 99.0])).alias("name")))
_ROADS = ["H005", "H052", "H001", "H009", "M045", "H006", "H010"]
query("map_rurality", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber + 3 = 7 AND road IN ('M045', 'H006', 'M026', 'M010') OR road = 'H005' AND slk >= 48.5 OR road = 'H052' AND slk >= 12.22 OR road = 'H001' AND slk >= 35.5 OR road = 'H009' AND slk >= 18.54 THEN 'Rural' ELSE 'Metro' END AS name FROM (SELECT *, {_list('l_suppkey', _ROADS)} AS road, l_quantity::DOUBLE AS slk FROM lineitem)")(
    lambda s, d: _LI(s, d, M.rurality(F.col("l_linenumber") + 3, _from(F.col("l_suppkey"), _ROADS), F.col("l_quantity")).alias("name")))
query("first_and_last", "SELECT l_suppkey, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS a, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS z FROM lineitem GROUP BY l_suppkey")(
    lambda s, d: V.table(s, d, "lineitem").groupBy("l_suppkey").agg(*[f(F.col("l_extendedprice"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")).alias(n) for f, n in ((stats.first, "a"), (stats.last, "z"))]))
query("deterioration_to_value", "SELECT l_orderkey, l_linenumber, k::INT AS k, round(l_extendedprice * pow(1 - (l_tax + 0.01), k) + 0.0000137, 4) AS v FROM (SELECT *, unnest(range(0, greatest(0, floor(ln(l_extendedprice * 0.9 / l_extendedprice) / ln(1 - (l_tax + 0.01)))::INT + 1) + 1)) AS k FROM lineitem)")(
    lambda s, d: _LI(s, d, F.posexplode(stats.deteriorate(F.col("l_extendedprice"), F.col("l_tax") + 0.01, final=F.col("l_extendedprice") * 0.9)).alias("k", "v")).withColumn("v", F.round(F.col("v") + 0.0000137, 4)))
query("fixed_segment_rows", V.sql("obs") + "SELECT rid, f + k * 7 AS a, least(t, f + (k + 1) * 7) AS b FROM (SELECT *, unnest(range(0, ceil((t - f) / 7)::BIGINT)) AS k FROM obs)")(
    lambda s, d: V.obs(s, d).select("rid", F.explode(steps.pieces(steps.fixed_steps(F.col("f"), F.col("t"), 7.0))).alias("p")).select("rid", "p.a", "p.b"))
query("cross_sections_rows", _CROSS + "SELECT n.k AS cross_section_number, flag, st, rid AS original_index, sum(n.b - n.a) AS overlap FROM n JOIN act ON act.road = n.road AND act.a = n.a GROUP BY ALL")(lambda s, d: _cross(s, d)[1])
query("segments_of_intervals", SQL["get_segments"])(lambda s, d: reshape.segments_of_intervals(_km(s, d).drop("rid"), ["road"], "a", "b", split_at=["flag"], summarise={"m": "cents"}).select("road", "flag", F.round("START_SLK", 6).alias("START_SLK"), F.round("END_SLK", 6).alias("END_SLK"), F.round("m", 4).alias("m")))
query("segments_of_intervals_points", SQL["get_segments"])(lambda s, d: reshape.segments_of_intervals(_km(s, d).drop("rid"), ["road"], "a", "b", split_at=["flag"], summarise={"m": F.avg("cents")}).select("road", "flag", F.round("START_SLK", 6).alias("START_SLK"), F.round("END_SLK", 6).alias("END_SLK"), F.round("m", 4).alias("m")))
query("best_bisection_p", _QP + f", x AS (SELECT w.*, o.len, o.tot, o.nxt FROM w JOIN (SELECT rid, t AS len, max(t) OVER (PARTITION BY road) AS tot, lead(t) OVER (PARTITION BY road ORDER BY rid) AS nxt FROM obs) o USING (rid)), y AS (SELECT road, rid, ({_CV.format('l')} + {_CV.format('r')}) / 2 AS p, coalesce(len > 100 AND tot - CASE WHEN nxt = tot THEN len ELSE nxt END > 100, false) AS inn FROM x WHERE nr IS NOT NULL) SELECT road, first(rid ORDER BY round(p, 9), rid) AS rid, round(min(p), 7) AS p FROM y WHERE inn GROUP BY road")(
    lambda s, d: _rounded(homogeneous.best_bisection(_cond(s, d), ["road"], "rid", ["v"], "qty", 100.0, "best", "p").groupBy("road").agg(F.min("rid").alias("rid"), F.min("best").alias("p")), 7))
query("wide_lanes_to_row", "SELECT l_orderkey, l_linenumber, n AS lane, CASE n WHEN 'q_L1' THEN l_quantity WHEN 'q_R2' THEN l_tax END AS q_ FROM lineitem, (VALUES ('q_L1'), ('q_R2')) v(n)")(
    lambda s, d: reshape.wide_lanes_to_row(_LI(s, d, F.col("l_quantity").alias("q_L1"), F.col("l_tax").alias("q_R2")), ["l_orderkey", "l_linenumber"], "lane", prefixes="q_"))
query("interval_merge_points", V.sql("obs", "tgt") + ", p AS (SELECT t.road, t.f AS a, t.t AS b, x FROM tgt t, unnest(range(t.f::BIGINT, t.t::BIGINT)) AS u(x)), j AS (SELECT p.road, p.x, o.flag, o.cents FROM p LEFT JOIN obs o ON o.road = p.road AND o.f <= p.x AND o.t > p.x), e AS (SELECT *, CASE WHEN lag(x) OVER o IS NOT DISTINCT FROM x - 1 AND lag(flag) OVER o IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS nw FROM j WINDOW o AS (PARTITION BY road ORDER BY x)), g AS (SELECT *, sum(nw) OVER (PARTITION BY road ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e) SELECT road, flag, round(min(x) / 1000.0, 6) AS \"START_SLK\", round((max(x) + 1) / 1000.0, 6) AS \"END_SLK\", round(avg(cents), 4) AS m FROM g GROUP BY road, flag, k")(
    lambda s, d: reshape.interval_merge(V.grid(s, d, 100.0).select("road", (F.col("f") / 1000).alias("a"), (F.col("t") / 1000).alias("b")), _km(s, d).drop("rid"), ["road"], "a", "b", {"m": F.avg("cents")}, split_at=["flag"], use_ranges=False).select("road", "flag", F.round("START_SLK", 6).alias("START_SLK"), F.round("END_SLK", 6).alias("END_SLK"), F.round("m", 4).alias("m")))
query("interval_merge_cut", SQL["interval_merge_points"])(
    lambda s, d: reshape.interval_merge(V.grid(s, d, 100.0).select("road", (F.col("f") / 1000).alias("a"), (F.col("t") / 1000).alias("b")), _km(s, d).drop("rid"), ["road"], "a", "b", {"m": "cents"}, split_at=["flag"], use_ranges=False).select("road", "flag", F.round("START_SLK", 6).alias("START_SLK"), F.round("END_SLK", 6).alias("END_SLK"), F.round("m", 4).alias("m")))


# Groups of all rows, mixed lengths and options.
def _long(s, d):
    """Targets and data with one very long row a road among the others."""
    t, g = V.grid(s, d, 100.0).select("road", "f", "t"), V.gap(s, d).select("road", "rid", "f", "t", "cents")
    roads = t.select("road").distinct()
    far = roads.select("road", F.lit(0.0).alias("f"), F.lit(1e12).alias("t"))
    wide = roads.select("road", (F.col("road") * 10000000).alias("rid"), F.lit(-1e9).alias("f"), F.lit(1e9).alias("t"), F.lit(7.0).alias("cents"))
    return t.union(far), g.union(wide)


_LONG = V.sql("obs", "gap", "tgt") + ", a AS (SELECT road, f, t FROM tgt UNION ALL SELECT DISTINCT road, 0, 1e12 FROM tgt), b AS (SELECT road, f, t, cents FROM gap UNION ALL SELECT DISTINCT road, -1e9, 1e9, 7 FROM tgt) SELECT a.road, a.f, a.t, sum(cents) AS total, max(cents) AS top FROM a LEFT JOIN b ON a.road = b.road AND b.f < a.t AND b.t > a.f GROUP BY ALL"
query("merge_mixed_lengths", _LONG)(lambda s, d: on_slk_intervals(*_long(s, d), ["road"], [Action("cents", A.Sum(), "total"), Action("cents", A.Max(), "top")], ("f", "t"), "rid"))
query("merge_percentile_one_target", V.sql("obs", "gap") + """, x AS (SELECT v, sum(w) OVER o - w / 2 AS x, row_number() OVER o AS k FROM (SELECT cents AS v, qty AS w, road * 1e7 + t AS e, rid FROM gap) WINDOW o AS (ORDER BY v, e, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT min(x) AS a, max(x) AS z FROM x), y AS (SELECT *, lag(v) OVER (ORDER BY k) AS v0, lag(x) OVER (ORDER BY k) AS x0, a + 0.9 * (z - a) AS g FROM x, m)
SELECT 0.0::DOUBLE AS f, 1e12::DOUBLE AS t, round(v0 + (v - v0) * (g - x0) / (x - x0) + 0.00013, 3) AS v FROM y WHERE x >= g AND x0 < g""")(
    lambda s, d: on_slk_intervals(V.table(s, d, "region").limit(1).select(F.lit(0.0).alias("f"), F.lit(1e12).alias("t")), V.gap(s, d).select("rid", (F.col("road") * 1e7 + F.col("f")).alias("f"), (F.col("road") * 1e7 + F.col("t")).alias("t"), "cents"), [], [Action("cents", A.LengthWeightedPercentile(0.9), "v")], ("f", "t"), "rid").withColumn("v", F.round(F.col("v") + 0.00013, 3)))
# One measure for all roads: each road starts at a multiple of 10^7.
_line = lambda s, d: V.obs(s, d).select("rid", "flag", *[(F.col("road") * 1e7 + F.col(c)).alias(c) for c in ("f", "t", "sf", "s")], "cents", "qty")
query("segment_ids_no_category", V.sql("obs") + "SELECT rid, CAST(sum(b) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS segment_id FROM (SELECT rid, CASE WHEN coalesce(lag(road) OVER o <> road OR lag(s) OVER o <> sf OR lag(t) OVER o <> f, true) THEN 1 ELSE 0 END AS b FROM obs WINDOW o AS (ORDER BY rid))")(
    lambda s, d: segments.segment_ids(_line(s, d), [], ("sf", "s"), ("f", "t")).select("rid", "segment_id"))
query("check_monotonic_no_category", V.sql("obs") + "SELECT bool_and(coalesce(f >= p, f >= 0)) AS ok FROM (SELECT road * 1e7 + f AS f, lag(road * 1e7 + t) OVER (ORDER BY rid) AS p FROM obs)")(lambda s, d: segments.check_monotonic(_line(s, d), [], ("f", "t"), "rid"))
query("check_disjoint_no_category", V.sql("obs") + "SELECT bool_and(coalesce(f >= p, true)) AS ok FROM (SELECT road * 1e7 + f AS f, max(road * 1e7 + t) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM obs)")(lambda s, d: segments.check_disjoint(_line(s, d), ("f", "t"), [], "rid"))
query("overlay_checked", SQL["overlay"])(
    lambda s, d: segments.overlay(*[V.grid(s, d, *w).withColumns({"sf": F.col("f"), "s": F.col("t")}) for w in ((100.0,), (137.0, 50.0))], ["road"], ("sf", "s"), ("f", "t"), "o", "n", relax_slk_checks=True, check_rows=True))
query("overlay_no_category", V.sql("obs", "tgt", "segb") + """, a AS (SELECT rid, road * 1e7 + f AS f, road * 1e7 + t AS t FROM tgt), b AS (SELECT rid, road * 1e7 + f AS f, road * 1e7 + t AS t FROM segb), p AS (SELECT f AS x FROM a UNION SELECT t FROM a UNION SELECT f FROM b UNION SELECT t FROM b), q AS (SELECT x AS f, lead(x) OVER (ORDER BY x) AS t FROM p)
SELECT q.f AS sf, q.t AS s, q.f, q.t, a.rid AS o, b.rid AS n FROM q LEFT JOIN a ON a.f <= q.f AND a.t >= q.t LEFT JOIN b ON b.f <= q.f AND b.t >= q.t WHERE q.t IS NOT NULL AND (a.rid IS NOT NULL OR b.rid IS NOT NULL)""")(
    lambda s, d: segments.overlay(*[V.grid(s, d, *w).select("rid", *[(F.col("road") * 1e7 + F.col(c)).alias(n) for n, c in (("f", "f"), ("t", "t"), ("sf", "f"), ("s", "t"))]) for w in ((100.0,), (137.0, 50.0))], [], ("sf", "s"), ("f", "t"), "o", "n"))
# SLK runs at half the true distance, so that pieces are cut by the latter.
query("split_max_length_true", V.sql("obs") + """, m AS (SELECT road, dense_rank() OVER (ORDER BY road) - 1 AS g, min(f) AS c, max(t) AS y FROM obs GROUP BY road), p AS (SELECT road, g, unnest(list_concat([c], list_transform(range((floor(c / 60) + 1)::BIGINT, ceil(y / 60)::BIGINT), lambda k: k * 60.0::DOUBLE), [y])) AS x FROM m),
q AS (SELECT *, lead(x) OVER (PARTITION BY road ORDER BY x) AS x2 FROM p QUALIFY x2 IS NOT NULL), i AS (SELECT q.road, q.g, q.x, q.x2, o.st, row_number() OVER (PARTITION BY q.road, q.x ORDER BY least(o.t, q.x2) - greatest(o.f, q.x) DESC, o.f, o.rid) AS n FROM q JOIN obs o ON o.road = q.road AND o.f < q.x2 AND o.t > q.x)
SELECT road, g::BIGINT AS segment_index, x / 2 AS sf, x2 / 2 AS s, x AS f, x2 AS t, st FROM i WHERE n = 1""")(
    lambda s, d: segments.split_to_max_length(V.obs(s, d).select("road", "rid", (F.col("f") / 2).alias("sf"), (F.col("t") / 2).alias("s"), "f", "t", "st"), ["road"], ("sf", "s"), ("f", "t"), 60.0).drop("rid"))
_ALL_Q = V.sql("obs") + ", c AS (SELECT rid, cents / 1e6 AS v FROM obs), m AS (SELECT count(*)::DOUBLE AS na, avg(v) AS a FROM c), w AS (SELECT rid, na, sum(1.0::DOUBLE) OVER l AS nl, sum(v - a) OVER l AS sl, sum((v - a) * (v - a)) OVER l AS ql, sum((v - a) * (v - a)) OVER () AS qa FROM c, m WINDOW l AS (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
query("cumulative_q_no_group", _ALL_Q + "SELECT rid, round(1 - ((ql - sl * sl / nl) + (qa - ql - sl * sl / (na - nl))) / qa + 0.000000003, 8) AS q FROM w WHERE nl < na")(
    lambda s, d: homogeneous.cumulative_q(_cond(s, d), [], "rid", "v").select("rid", F.round(F.col("q") + 0.000000003, 8).alias("q")))
_TWO = ", ".join(f"sum({v}) OVER {o} AS s{n}{k}, sum({v} * {v}) OVER {o} AS q{n}{k}" for v, n in (("(cents / 1e6)", "u"), ("qty", "v")) for o, k in (("l", "l"), ("a", "a")))
_two = lambda n: f"1 - ((q{n}l - s{n}l * s{n}l / nl) + (q{n}a - q{n}l - (s{n}a - s{n}l) * (s{n}a - s{n}l) / (na - nl))) / (q{n}a - s{n}a * s{n}a / na)"
query("best_bisection_two", V.sql("obs") + f", w AS (SELECT road, rid, t AS len, count(*) OVER l AS nl, count(*) OVER a AS na, max(t) OVER a AS tot, lead(t) OVER (PARTITION BY road ORDER BY rid) AS nxt, {_TWO} FROM obs WINDOW l AS (PARTITION BY road ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY road)), y AS (SELECT road, rid, (({_two('u')}) + ({_two('v')})) / 2 AS q FROM w WHERE nl < na AND len > 100 AND tot - CASE WHEN nxt = tot THEN len ELSE nxt END > 100) SELECT road, first(rid ORDER BY round(q, 9) DESC, rid) AS rid, round(max(q), 7) AS q FROM y GROUP BY road")(
    lambda s, d: _rounded(homogeneous.best_bisection(_cond(s, d).withColumn("w", F.col("qty")), ["road"], "rid", ["v", "w"], "qty", 100.0).groupBy("road").agg(F.min("rid").alias("rid"), F.max("best_q").alias("q")), 7))
