"""Pieces of the DuckDB SQL that the queries are compared with. Points are structs, polygons lists of them."""

from __future__ import annotations

from scenekiln.functions import geometry as g
from scenekiln.plans.shapes import SQL


def with_shapes(*names: str) -> str:
    return ", ".join(SQL[n] for n in names)


def quad(points: list[tuple[float, float]], dx: float = 0, dy: float = 0) -> str:
    return "[" + ", ".join(f"{{'x': {float(x + dx)}::DOUBLE, 'y': {float(y + dy)}::DOUBLE}}" for x, y in points) + "]"


def shoelace(p: str) -> str:
    """Signed area."""
    return f"(list_sum([{p}[i].x * {p}[i % len({p}) + 1].y - {p}[i % len({p}) + 1].x * {p}[i].y FOR i IN range(1, len({p}) + 1)]) / 2)"


def moved(p: str) -> str:
    """By the matrix a, b, dx, dy of the row."""
    return f"[{{'x': a * p.x + b * p.y + dx, 'y': -b * p.x + a * p.y + dy}} FOR p IN {p}]"


PLACED = f"""matrices AS (
  SELECT *, scale * cos(radians(angle)) AS a, scale * sin(radians(angle)) AS b FROM placements),
moves AS (SELECT *, (1 - a) * 360 - b * 360 + tx * 720 AS dx, b * 360 + (1 - a) * 360 + ty * 720 AS dy FROM matrices),
placed AS (
  SELECT scene, z, class, {moved(quad(g.CARD_QUAD, *g.placement_offset(720)))} AS corners,
    {moved(quad(g.CORNER_HL, *g.placement_offset(720)))} AS hull_hl, {moved(quad(g.CORNER_LR, *g.placement_offset(720)))} AS hull_lr FROM moves),
occluded AS (SELECT *, lead(corners) OVER (PARTITION BY scene ORDER BY z) AS occluder FROM placed),
hulls AS (
  SELECT scene, z, class, occluder, 0 AS corner, hull_hl AS hull FROM occluded UNION ALL SELECT scene, z, class, occluder, 1, hull_lr FROM occluded)"""


def _away(of: str, i: int, j: int) -> str:
    """Signed distance of corner i of one polygon from line j of the other (h: the hull, o: the occluder), positive inside."""
    by, k = "ho".replace(of, ""), j % 4 + 1
    return f"{by}_turn * (({by}x{k} - {by}x{j}) * ({of}y{i} - {by}y{j}) - ({by}y{k} - {by}y{j}) * ({of}x{i} - {by}x{j}))"


def _enters(of: str, i: int, j: int) -> str:
    """How far along edge i the inner side of line j begins; past its end if all of it is outside (of the occluder's edges,
    also if it lies on the line, as an edge that both have counts once)."""
    d, e = f"{of}{i}{j}", f"{of}{i % 4 + 1}{j}"
    out = f"({d} < 0 AND {e} < 0)" + (f" OR ({d} <= 0 AND {e} <= 0)" if of == "o" else "")
    return f"CASE WHEN {out} THEN 2.0::DOUBLE WHEN {d} < 0 THEN {d} / ({d} - {e}) ELSE 0.0::DOUBLE END"


def _leaves(of: str, i: int, j: int) -> str:
    d, e = f"{of}{i}{j}", f"{of}{i % 4 + 1}{j}"
    return f"CASE WHEN {e} < 0 AND {d} >= 0 THEN {d} / ({d} - {e}) ELSE 1.0::DOUBLE END"


def _part(of: str, i: int) -> str:
    """Twice what the part of edge i that lies inside the other polygon adds to the area."""
    x, y, p, q = f"{of}x{i}", f"{of}y{i}", f"{of}x{i % 4 + 1}", f"{of}y{i % 4 + 1}"
    at = lambda v, w, t: f"({v} + {t} * ({w} - {v}))"
    t, u = f"{of}t{i}", f"{of}u{i}"
    return f"CASE WHEN {t} < {u} THEN {of}_turn * ({at(x, p, t)} * {at(y, q, u)} - {at(x, p, u)} * {at(y, q, t)}) ELSE 0.0::DOUBLE END"


_FOUR = range(1, 5)
#: measured: every hull with its area, its points' x and y, and what it shares with its occluder (null without one). The
#: border of what both share is made of the parts of either's edges that lie inside the other; its area follows by Green's
#: theorem. All of it stands beside its row: nothing is unnested, grouped or joined. shared: the hulls that have an occluder.
SHARED = f"""corners AS (
  SELECT scene, z, corner, class, occluder, [q.x FOR q IN hull] AS xs, [q.y FOR q IN hull] AS ys, abs({shoelace('hull')}) AS area, sign({shoelace('hull')}) AS h_turn, sign({shoelace('occluder')}) AS o_turn,
    {', '.join(f"{p}[{i}].{c} - 360 AS {p[0]}{c}{i}" for p in ('hull', 'occluder') for i in _FOUR for c in 'xy')} FROM hulls),
away AS (SELECT *, {', '.join(f"{_away(of, i, j)} AS {of}{i}{j}" for of in 'ho' for i in _FOUR for j in _FOUR)} FROM corners),
inside AS (
  SELECT *, {', '.join(f"greatest({', '.join(_enters(of, i, j) for j in _FOUR)}) AS {of}t{i}, least({', '.join(_leaves(of, i, j) for j in _FOUR)}) AS {of}u{i}" for of in 'ho' for i in _FOUR)} FROM away),
measured AS (
  SELECT scene, z, corner, class, occluder IS NULL AS free, area, xs, ys, CASE WHEN occluder IS NOT NULL THEN abs({' + '.join(_part(of, i) for of in 'ho' for i in _FOUR)}) / 2 END AS inter FROM inside),
shared AS (SELECT * FROM measured WHERE NOT free)"""
#: labels: the kept corners with box and fractions on a canvas of 720.
LABELS = """boxes AS (
  SELECT scene, z, corner, class, greatest(0, trunc(list_min(xs) - 3)::INTEGER) AS xmin, greatest(0, trunc(list_min(ys) - 3)::INTEGER) AS ymin,
    least(720, trunc(list_max(xs) + 3)::INTEGER) AS xmax, least(720, trunc(list_max(ys) + 3)::INTEGER) AS ymax FROM measured WHERE free OR (area - inter) / area >= 0.9::DOUBLE),
labels AS (
  SELECT *, (xmin + xmax) / 2.0::DOUBLE / 720 AS cx, (ymin + ymax) / 2.0::DOUBLE / 720 AS cy, (xmax - xmin) / 720.0::DOUBLE AS w, (ymax - ymin) / 720.0::DOUBLE AS h
  FROM boxes WHERE xmin < xmax AND ymin < ymax)"""
NAMES = "names AS (SELECT p_brand AS class, (row_number() OVER (ORDER BY p_brand) - 1)::INTEGER AS id FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL))"


def scenes_sql(select: str, *more: str) -> str:
    """A query over labels and names."""
    return "WITH " + ",\n".join([with_shapes("placements"), PLACED, SHARED, LABELS.replace("labels AS (", "corner_labels AS ("), NAMES, *more]) + "\n" + select


def regions(polygons: str) -> str:
    """Named parts up to regions(vec_id, area): what all of a row's polygons (vec_id, of, p) wind around, each the way round of
    its own signed area. Edges are cut where they cross; of a piece, the points right beside its middle are looked at."""
    beside = lambda side: f"""CASE WHEN f.ay <= {side}y AND f.b_y > {side}y AND (f.bx - f.ax) * ({side}y - f.ay) - (f.b_y - f.ay) * ({side}x - f.ax) > 0 THEN 1
      WHEN f.b_y <= {side}y AND f.ay > {side}y AND (f.bx - f.ax) * ({side}y - f.ay) - (f.b_y - f.ay) * ({side}x - f.ax) < 0 THEN -1 ELSE 0 END"""  # noqa: E731
    return f"""forward AS (SELECT vec_id, of, CASE WHEN {shoelace('p')} < 0 THEN list_reverse(p) ELSE p END AS p FROM {polygons}),
edges AS (
  SELECT vec_id, of * 1000 + i AS e, of, p[i].x - 360 AS ax, p[i].y - 360 AS ay, p[i % len(p) + 1].x - 360 AS bx, p[i % len(p) + 1].y - 360 AS b_y
  FROM (SELECT vec_id, of, p, unnest(range(1, len(p) + 1)) AS i FROM forward)),
met AS (
  SELECT a.vec_id, a.e, ((b.ax - a.ax) * (b.b_y - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / d AS t, ((b.ax - a.ax) * (a.b_y - a.ay) - (b.ay - a.ay) * (a.bx - a.ax)) / d AS u
  FROM (SELECT a, b, (a.bx - a.ax) * (b.b_y - b.ay) - (a.b_y - a.ay) * (b.bx - b.ax) AS d FROM edges a JOIN edges b ON a.vec_id = b.vec_id AND a.e <> b.e) WHERE d <> 0),
cuts AS (SELECT vec_id, e, t FROM met WHERE t > 0 AND t < 1 AND u BETWEEN 0 AND 1 UNION SELECT vec_id, e, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM edges),
spans AS (SELECT vec_id, e, t, lead(t) OVER (PARTITION BY vec_id, e ORDER BY t) AS u FROM cuts),
pieces AS (
  SELECT vec_id, e, t, ax + t * (bx - ax) AS px, ay + t * (b_y - ay) AS py, ax + u * (bx - ax) AS qx, ay + u * (b_y - ay) AS qy, (ay - b_y) / len * 1e-7::DOUBLE AS nx, (bx - ax) / len * 1e-7::DOUBLE AS ny
  FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS len FROM spans JOIN edges USING (vec_id, e) WHERE u > t)),
sides AS (SELECT vec_id, e, t, px * qy - qx * py AS c, (px + qx) / 2 + nx AS lx, (py + qy) / 2 + ny AS ly, (px + qx) / 2 - nx AS rx, (py + qy) / 2 - ny AS ry FROM pieces),
winds AS (SELECT s.vec_id, s.e, s.t, s.c, f.of, sum({beside('l')}) AS l, sum({beside('r')}) AS r FROM sides s JOIN edges f ON s.vec_id = f.vec_id GROUP BY s.vec_id, s.e, s.t, s.c, f.of),
bounds AS (SELECT vec_id, e, t, c, (min(l) > 0)::INTEGER - (min(r) > 0)::INTEGER AS way FROM winds GROUP BY vec_id, e, t, c),
regions AS (SELECT vec_id, abs(sum(c * way)) / 2 AS area FROM bounds GROUP BY vec_id)"""
