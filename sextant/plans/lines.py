"""Named queries of outlines, divides, streams and profiles as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import grids, lines
from sextant.operators.blocks import meet
from sextant.plans.registry import _FILL, _REACH, _flow, _query, _r
from sextant.plans.views import VIEWS, view, with_views

#: Sides walked with the cell on the right hand: number, the neighbour beyond, where the side begins and where it ends.
_SIDES = "side(k, ox, oy, tx, ty, hx, hy) AS (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0))"
_ID = "(y * 2147483648 + x) * 4 + k"


def _outlined(c: str) -> str:
    """The rings around components in ``c`` (x, y, component): every side is followed round until it comes back to itself."""
    return (
        f", {_SIDES}, e AS (SELECT c.component AS g, (c.y * 2147483648 + c.x) * 4 + k AS id, c.x, c.y, k, c.x + tx AS t0, c.y + ty AS t1, c.x + hx AS h0, c.y + hy AS h1 FROM {c} c JOIN side ON true LEFT JOIN {c} n ON n.x = c.x + ox AND n.y = c.y + oy AND n.component = c.component WHERE n.x IS NULL),"
        " nx AS (SELECT e.id, arg_max(f.id, CASE WHEN f.x = e.x AND f.y = e.y THEN 1 ELSE 0 END) AS next FROM e JOIN e f ON f.g = e.g AND f.t0 = e.h0 AND f.t1 = e.h1 GROUP BY e.id),"
        " walk(start, id, step) AS (SELECT id, id, 0 FROM e UNION ALL SELECT start, next, step + 1 FROM walk JOIN nx USING (id) WHERE next <> start),"
        " ring AS (SELECT start FROM walk GROUP BY start HAVING min(id) = start),"
        " w AS (SELECT start AS ring, step, e.*, count(*) OVER (PARTITION BY start) AS sides, sum(CASE k WHEN 2 THEN y + 1 WHEN 0 THEN -y ELSE 0 END) OVER (PARTITION BY start) AS area, coalesce(lag(k) OVER (PARTITION BY start ORDER BY step), last_value(k) OVER (PARTITION BY start ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM walk JOIN ring USING (start) JOIN e USING (id))"
        " SELECT g AS component, ring, CAST(step AS BIGINT) AS step, CAST(t0 AS BIGINT) AS x, CAST(t1 AS BIGINT) AS y, sides, area < 0 AS hole, CAST(area AS BIGINT) AS area FROM w WHERE k <> before"
    )


def _on_relief(oracle: str) -> str:
    return oracle.replace(VIEWS["dem"], VIEWS["relief"])


@_query("t9_outlines", _REACH + _outlined("c"))
def _t9_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.zone_outlines(grids.components(view(spark, sf_dir, "dem").where("v >= 120")))


@_query("t10_outlines", _REACH.replace("dem WHERE v >= 120", "dem WHERE v >= 90 AND v < 180") + _outlined("c"))
def _t10_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = view(spark, sf_dir, "dem").select("x", "y", F.floor(F.col("v") / 90).cast("double").alias("class")).where("class = 1")
    return lines.zone_outlines(grids.components(classes, class_column="class"))


@_query(
    "t16_outlines",
    _FILL + ", wet AS (SELECT x, y FROM f JOIN d USING (x, y) GROUP BY x, y, v HAVING min(w) > v), r(x, y, sx, sy) AS (SELECT x, y, x, y FROM wet UNION SELECT m.x, m.y, r.sx, r.sy FROM r JOIN wet m ON greatest(abs(m.x - r.x), abs(m.y - r.y)) = 1), c AS (SELECT x, y, min(sy * 2147483648 + sx) AS component FROM r GROUP BY x, y)" + _outlined("c"),
)
def _t16_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    wet = grids.fill_depressions(view(spark, sf_dir, "dem")).where("filled > v")
    return lines.zone_outlines(grids.components(wet.select("x", "y"), diagonal=True))


@_query(
    "t17_divide_lines",
    _on_relief(_flow(
        f", b AS (SELECT CAST(sx AS BIGINT) AS x, CAST(sy AS BIGINT) AS y, CAST(y AS BIGINT) * 2147483648 + CAST(x AS BIGINT) AS basin FROM down JOIN dirs USING (x, y) WHERE k < 0), {_SIDES},"
        " e AS (SELECT c.basin, n.basin AS other, (c.y * 2147483648 + c.x) * 4 + k AS id, c.x + tx AS t0, c.y + ty AS t1, c.x + hx AS h0, c.y + hy AS h1 FROM b c JOIN side ON true JOIN b n ON n.x = c.x + ox AND n.y = c.y + oy AND n.basin > c.basin),"
        " o AS (SELECT basin, other, t0, t1, count(*) AS n, min(id) AS id FROM e GROUP BY ALL), i AS (SELECT basin, other, h0, h1, count(*) AS n, min(id) AS id FROM e GROUP BY ALL),"
        " nx AS (SELECT i.id, o.id AS next FROM o JOIN i ON o.basin = i.basin AND o.other = i.other AND o.t0 = i.h0 AND o.t1 = i.h1 WHERE o.n = 1 AND i.n = 1),"
        " opened(start, id, step) AS (SELECT id, id, 0 FROM e WHERE id NOT IN (SELECT next FROM nx) UNION ALL SELECT start, next, step + 1 FROM opened JOIN nx USING (id)),"
        " rest AS (SELECT id FROM e WHERE id NOT IN (SELECT id FROM opened)), round(start, id, step) AS (SELECT id, id, 0 FROM rest UNION ALL SELECT start, next, step + 1 FROM round JOIN nx USING (id) WHERE next <> start),"
        " w AS (SELECT *, false AS closed FROM opened UNION ALL SELECT *, true FROM round WHERE start IN (SELECT start FROM round GROUP BY start HAVING min(id) = start)),"
        " z AS (SELECT w.*, e.*, count(*) OVER (PARTITION BY start) AS sides FROM w JOIN e USING (id)), size AS (SELECT basin AS s, count(*) AS n FROM b GROUP BY basin)"
        " SELECT basin, other, start AS line, CAST(step + g AS BIGINT) AS step, CAST(CASE g WHEN 0 THEN t0 ELSE h0 END AS BIGINT) AS x, CAST(CASE g WHEN 0 THEN t1 ELSE h1 END AS BIGINT) AS y, sides * 30e0 AS metres, (p.n + q.n) * 900e0 AS area, closed"
        " FROM z JOIN size p ON p.s = basin JOIN size q ON q.s = other, range(0, 2) r(g) WHERE sides >= 5 AND (g = 0 OR step = sides - 1)"
    )),
)
def _t17_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.divide_lines(grids.basins(grids.flow_direction(view(spark, sf_dir, "relief"))))


@_query(
    "t14_stream_lines",
    _on_relief(_flow(
        ", s AS (SELECT acc.x, acc.y, acc.cells, w.tx, w.ty, coalesce(w.k, 0) % 2 AS slant, row_number() OVER (ORDER BY acc.cells, acc.y, acc.x) AS n FROM acc LEFT JOIN ways w ON w.x = acc.x AND w.y = acc.y WHERE acc.cells >= 6),"
        " dn AS (SELECT a.n AS up, b.n FROM s a JOIN s b ON b.x = a.tx AND b.y = a.ty), above AS (SELECT n, list(up) AS ups FROM dn GROUP BY n),"
        # donors drain less than what they flow into, so orders are known one after another
        " od(n, orders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]) UNION ALL SELECT od.n + 1, list_append(orders, CASE WHEN ups IS NULL THEN 1 ELSE list_max(list_transform(ups, lambda u: orders[u])) + CASE WHEN len(list_filter(ups, lambda u: orders[u] = list_max(list_transform(ups, lambda t: orders[t])))) > 1 THEN 1 ELSE 0 END END) FROM od JOIN s ON s.n = od.n + 1 LEFT JOIN above ON above.n = od.n + 1),"
        " last AS (SELECT orders FROM od ORDER BY n DESC LIMIT 1), alone AS (SELECT n, ups[1] AS up FROM above WHERE len(ups) = 1),"
        " p(first, n, step, metres) AS (SELECT n, n, 0, 0e0 FROM s WHERE n NOT IN (SELECT n FROM alone) UNION ALL SELECT first, alone.n, step + 1, metres + CASE WHEN s.slant = 1 THEN 30e0 * sqrt(2e0) ELSE 30e0 END FROM p JOIN alone ON alone.up = p.n JOIN s ON s.n = p.n),"
        " parent AS (SELECT p.first, dn.n AS into FROM p JOIN dn ON dn.up = p.n WHERE dn.n NOT IN (SELECT n FROM alone))"
        " SELECT CAST(f.y AS BIGINT) * 2147483648 + f.x AS path, CAST(step AS BIGINT) AS step, CAST(s.x AS BIGINT) AS x, CAST(s.y AS BIGINT) AS y, s.cells, orders[s.n] AS strahler, CAST(i.y AS BIGINT) * 2147483648 + i.x AS parent, round(metres, 4) AS metres"
        " FROM p JOIN s ON s.n = p.n JOIN s f ON f.n = p.first CROSS JOIN last LEFT JOIN parent ON parent.first = p.first LEFT JOIN s i ON i.n = parent.into"
    )),
)
def _t14_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = grids.flow_accumulation(grids.flow_direction(view(spark, sf_dir, "relief")))
    return lines.stream_lines(flow, 6).withColumn("metres", F.round("metres", 4))


_SAMPLED = with_views("relief", "drawn") + (
    ", a AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM drawn WINDOW w AS (PARTITION BY line_id ORDER BY seq)), l AS (SELECT *, coalesce(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) * 30e0, 0e0) AS length FROM a),"
    " c AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS start FROM l),"
    " m AS (SELECT line_id, x, y, nx, ny, start, length, unnest(CASE WHEN nx IS NULL THEN [start] ELSE list_transform(range(CAST(ceil(start / 30) AS BIGINT), CAST(ceil((start + length) / 30) AS BIGINT)), lambda k: k * 30e0) END) AS metres FROM c),"
    " p AS (SELECT line_id, metres, round(x + CASE WHEN length > 0 THEN (metres - start) / length ELSE 0 END * (coalesce(nx, x) - x), 9) AS x, round(y + CASE WHEN length > 0 THEN (metres - start) / length ELSE 0 END * (coalesce(ny, y) - y), 9) AS y FROM m),"
    " q AS (SELECT p.*, floor(p.x) + i AS cx, floor(p.y) + j AS cy, (CASE i WHEN 1 THEN p.x - floor(p.x) ELSE 1 - (p.x - floor(p.x)) END) * (CASE j WHEN 1 THEN p.y - floor(p.y) ELSE 1 - (p.y - floor(p.y)) END) AS weight FROM p, range(0, 2) a(i), range(0, 2) b(j)),"
    " t AS (SELECT line_id, metres, q.x, q.y, sum(r.v * weight) / sum(CASE WHEN r.v IS NOT NULL THEN weight END) AS v FROM q LEFT JOIN relief r ON r.x = cx AND r.y = cy WHERE weight > 0 GROUP BY line_id, metres, q.x, q.y) "
)


@_query("w2_sampled_lines", _SAMPLED + "SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY metres) - 1 AS sample, round(metres, 4) AS metres, round(v, 4) AS v FROM t")
def _w2_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.sampled_lines(view(spark, sf_dir, "drawn"), view(spark, sf_dir, "relief"))
    return out.select("line_id", "sample", F.round("metres", 4).alias("metres"), F.round("v", 4).alias("v"))


@_query(
    "w2_line_profiles",
    _SAMPLED + ", g AS (SELECT *, v - lag(v) OVER w AS rise, metres - lag(metres) OVER w AS run FROM t WHERE v IS NOT NULL WINDOW w AS (PARTITION BY line_id ORDER BY metres))"
    " SELECT line_id, round(any_value(n.length_m), 4) AS length_m, any_value(points) AS points, round(min(v), 4) AS lowest, round(max(v), 4) AS highest, CASE WHEN count(v) > 0 THEN round(coalesce(sum(greatest(rise, 0)), 0), 4) END AS ascent, CASE WHEN count(v) > 0 THEN round(coalesce(sum(greatest(-rise, 0)), 0), 4) END AS descent"
    " FROM (SELECT line_id, max(metres) AS length_m, count(*) AS points FROM t GROUP BY line_id) n LEFT JOIN g USING (line_id) GROUP BY line_id",
)
def _w2_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.profiled_lines(view(spark, sf_dir, "drawn"), view(spark, sf_dir, "relief"))
    return out.select("line_id", F.round("length_m", 4).alias("length_m"), "points", *[_r(F.round(c, 4), c) for c in ("lowest", "highest", "ascent", "descent")])


@_query(
    "t15_flow_length",
    _on_relief(_flow(
        ", far(x, y, length) AS (SELECT x, y, 0e0 FROM dirs UNION SELECT tx, ty, length + CASE WHEN k % 2 = 1 THEN 30e0 * sqrt(2e0) ELSE 30e0 END FROM far JOIN ways USING (x, y)), l AS (SELECT x, y, max(length) AS length FROM far GROUP BY x, y),"
        " sl AS (SELECT x, y, CASE WHEN k = 9 THEN sqrt(dx*dx + dy*dy) ELSE 0 END AS gradient FROM g), q AS (SELECT acc.x, acc.y, length, gradient, cells * 900e0 * 0.5e0 / greatest(60e0, 60 * 0.0195e0 * pow(length, 0.77e0) * pow(greatest(gradient, 1e-4), -0.385e0)) AS discharge FROM acc JOIN l USING (x, y) JOIN sl ON acc.x = sl.x AND acc.y = sl.y WHERE cells >= 6),"
        " r AS (SELECT *, least(1e0, discharge / 200) AS a, least(1e0, gradient / 0.5e0) AS b FROM q) SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(length, 4) AS length, round(discharge, 4) AS discharge, round(0.5e0 * a + 0.5e0 * b, 6) AS risk, CASE WHEN a >= b THEN 'flow' ELSE 'slope' END AS reason FROM r WHERE 0.5e0 * a + 0.5e0 * b >= 0.15e0"
    )),
)
def _t15_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "relief")
    directions = grids.flow_direction(cells)
    lengths = grids.flow_lengths(directions)
    rivers = meet(grids.streams(grids.flow_accumulation(directions), 6), lengths, ["x", "y"])
    out = grids.flood_risk(rivers, grids.slope_degrees(cells), 0.5)
    return out.select("x", "y", F.round("length", 4).alias("length"), F.round("discharge", 4).alias("discharge"), _r("risk", "risk"), "reason")
