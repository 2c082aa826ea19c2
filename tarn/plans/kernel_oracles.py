"""DuckDB SQL for the queries whose operators are kernels, folds or searches: written out as recursion and relaxation."""

from __future__ import annotations

from tarn.functions import geo
from tarn.plans import derived as d
from tarn.plans.online_queries import _LEN, _PROFILE, _TAGS
from tarn.plans.scalar_queries import _HAV, W, _tx, _ty
from tarn.streaming.trips import MOVES

E = 2 * W / (1 << geo.DETAIL_ZOOM)
LAST = (1 << geo.DETAIL_ZOOM) - 1
#: More rounds of relaxation than least-cost paths have edges on the data that SQL is run on.
ROUNDS = 24


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def _thinned(points: str, eps: float) -> str:
    """CTE ``kept`` (id, k): vertices that Ramer-Douglas-Peucker keeps of lines ``points`` (id, k from 1 on, n, x, y)."""
    return f"""
pts as materialized ({points}),
ends as (select distinct id, n from pts),
halves(id, a, b) as (
 select id, 1::bigint, n::bigint from ends where n >= 2
 union all
 select id, unnest([a, m]), unnest([m, b]) from (
  select h.id, h.a, h.b, arg_max(p.k, (far, -p.k))::bigint m, max(far) far from (
   select h.id, h.a, h.b, p.k, case when hypot > 0 then abs((yb - ya) * x - (xb - xa) * y + xb * ya - yb * xa) / hypot else sqrt(pow(x - xa, 2) + pow(y - ya, 2)) end far
   from (select h.id, h.a, h.b, pa.x xa, pa.y ya, pb.x xb, pb.y yb, sqrt(pow(pb.x - pa.x, 2) + pow(pb.y - pa.y, 2)) hypot
         from halves h join pts pa on pa.id = h.id and pa.k = h.a join pts pb on pb.id = h.id and pb.k = h.b where h.b - h.a >= 2) h
   join pts p on p.id = h.id and p.k > h.a and p.k < h.b) h join pts p on p.id = h.id and p.k = h.k
  group by h.id, h.a, h.b) where far > {eps!r}),
kept as (select distinct id, unnest([a, b]) k from halves)"""


_LINES = "select way_id id, k, n, mx x, my y from line where n >= 2"
_EPS = E / geo.TILE_PIXELS / 2
_PAD = E / 64

RDP = f"""{_recursive(d.with_tables(f", {_thinned(_LINES, _EPS)}", "line"))}
select id way_id, count(*) n from kept group by 1"""

#: Each segment against every tile that its own box touches, clipped as Liang and Barsky do.
_CUT = """
seg as (select id, row_number() over w i, x ax, y ay, lead(x) over w bx, lead(y) over w by_
        from kept join pts using (id, k) window w as (partition by id order by k)),
box as (select *, greatest(floor((least(ax, bx) - {p} + {w}) / {e}), 0)::bigint x0, least(floor((greatest(ax, bx) + {p} + {w}) / {e}), {l})::bigint x1,
         greatest(floor(({w} - greatest(ay, by_) - {p}) / {e}), 0)::bigint y0, least(floor(({w} - least(ay, by_) + {p}) / {e}), {l})::bigint y1 from seg where bx is not null),
col as (select *, unnest(range(x0, x1 + 1)) tx from box),
cell as (select *, unnest(range(y0, y1 + 1)) ty from col),
side as (select *, tx * {e} - {w} - {p} west, tx * {e} - {w} + {e} + {p} east, {w} - ty * {e} - {e} - {p} south, {w} - ty * {e} + {p} north, bx - ax dx, by_ - ay dy from cell),
clip as (select *, greatest(0, case when dx > 0 then (west - ax) / dx when dx < 0 then (east - ax) / dx end, case when dy > 0 then (south - ay) / dy when dy < 0 then (north - ay) / dy end) t0,
          least(1, case when dx > 0 then (east - ax) / dx when dx < 0 then (west - ax) / dx end, case when dy > 0 then (north - ay) / dy when dy < 0 then (south - ay) / dy end) t1
         from side where not (dx = 0 and (ax < west or ax > east)) and not (dy = 0 and (ay < south or ay > north))),
part as (select id, tx, ty, i, case when t0 <= 0 then ax else ax + t0 * dx end fx, case when t0 <= 0 then ay else ay + t0 * dy end fy,
          case when t1 >= 1 then bx else ax + t1 * dx end lx, case when t1 >= 1 then by_ else ay + t1 * dy end ly from clip where t0 <= t1),
walk as (select *, coalesce(lag(i) over w = i - 1 and lag(lx) over w = fx and lag(ly) over w = fy, false) joined from part window w as (partition by id, tx, ty order by i)),
runs as (select id, tx, ty, run, bool_or(fx <> lx or fy <> ly) drawn from (select *, sum((not joined)::int) over (partition by id, tx, ty order by i) run from walk) group by 1, 2, 3, 4)
""".format(e=repr(E), w=repr(W), p=repr(_PAD), l=LAST)

BINNING = f"""{_recursive(d.with_tables(f", {_thinned(_LINES, _EPS)}, {_CUT}", "line"))}
select {geo.DETAIL_ZOOM}::integer z, tx x, ty y, id way_id, count(*) runs from runs where drawn group by all"""


_G = 4096 / E

#: What a decoder must find in each tile: pieces of classified ways on the tile's grid without steps of no length, and peaks.
_DRAWN = f"""{_recursive(d.with_tables(f""", {_thinned(_LINES + " and way_id in (select way_id from kinds)", _EPS)}, {_CUT},
snap as (select id, tx, ty, i, sum((not joined)::int) over (partition by id, tx, ty order by i) run,
  round((fx - (tx * {E!r} - {W!r})) * {_G!r})::bigint gx0, round((({W!r} - ty * {E!r}) - fy) * {_G!r})::bigint gy0,
  round((lx - (tx * {E!r} - {W!r})) * {_G!r})::bigint gx1, round((({W!r} - ty * {E!r}) - ly) * {_G!r})::bigint gy1 from walk),
lines as (select id, tx, ty, run, 1 + count(*) filter (gx0 <> gx1 or gy0 <> gy1) n,
  arg_min(gx0, i) + coalesce(sum(gx1) filter (gx0 <> gx1 or gy0 <> gy1), 0) sx, arg_min(gy0, i) + coalesce(sum(gy1) filter (gx0 <> gx1 or gy0 <> gy1), 0) sy from snap group by all),
spot as (select node_id id, {_tx('14')} tx, {_ty('14')} ty, mx, my from pois),
every as (select id, tx, ty, n, sx, sy from lines where n > 1 union all
  select id, tx, ty, 1, round((mx - (tx * {E!r} - {W!r})) * {_G!r})::bigint, round((({W!r} - ty * {E!r}) - my) * {_G!r})::bigint from spot)""", "line", "kinds", "pois"))}"""
DECODED = f"{_DRAWN} select tx x, ty y, count(distinct id) features, count(*) segments, sum(n)::bigint vertices, sum(sx)::bigint sum_x, sum(sy)::bigint sum_y from every group by 1, 2"
ARCHIVED = f"{_DRAWN} select tx x, ty y, count(distinct id) features from every group by 1, 2"


def _cell(v: str, up: bool = False) -> str:
    return f"least(greatest(floor(({W!r} - {v}) / {E!r}), 0), {LAST})::bigint" if up else f"least(greatest(floor(({v} + {W!r}) / {E!r}), 0), {LAST})::bigint"


#: A walk over the grid enters one new tile at each line that it crosses.
TRAVERSAL = d.with_tables(
    f""", s as (select way_id, pos, mx, my, lead(mx) over w bx, lead(my) over w by_ from line window w as (partition by way_id order by pos))
select way_id, pos::integer pos, 1 + abs({_cell('bx')} - {_cell('mx')}) + abs({_cell('by_', True)} - {_cell('my', True)}) n_tiles from s where bx is not null""",
    "line",
)

_SHADE = "0.7071067811865476 * cos(slope) + 0.7071067811865475 * sin(slope) * cos(radians(135.0::double) - aspect)"
HILLSHADE = d.with_tables(
    f""", o as (select unnest([-1, 0, 1]) i), w as (select a.i, b.i j from o a, o b where a.i <> 0 or b.i <> 0),
g as (select px + i px, py + j py, sum(elev * -i * case when j = 0 then 2 else 1 end) gx, sum(elev * -j * case when i = 0 then 2 else 1 end) gy
      from dem, w where elev is not null group by 1, 2 having count(*) = 8),
s as (select px, py, atan(sqrt(dx * dx + dy * dy)) slope, atan2(dy, -dx) aspect from (select px, py, gx / 8000.0::double * 0.5 dx, gy / 8000.0::double * 0.5 dy from g))
select px, py, round(greatest({_SHADE}, 0) * 255)::integer shade from s""",
    "dem",
)

#: Marching squares without saddles, which the raster has none of: each cell that a level passes has one segment.
CONTOURS = d.with_tables(
    """, k as (select a.px c, a.py r, a.elev a, b.elev b, g.elev g, h.elev h from dem a join dem b on b.px = a.px + 1 and b.py = a.py
  join dem g on g.px = a.px + 1 and g.py = a.py + 1 join dem h on h.px = a.px and h.py = a.py + 1
  where a.elev is not null and b.elev is not null and g.elev is not null and h.elev is not null),
v as (select unnest(range(ceil(min(elev) / 20)::bigint, floor(max(elev) / 20)::bigint + 1)) * 20.0::double e from dem),
m as (select * from k, v where least(a, b, g, h) < e and greatest(a, b, g, h) >= e),
p as (select c, r, e, unnest([
  {'i': 0, 'cut': (a >= e) <> (b >= e), 'x': c + (e - a) / nullif(b - a, 0), 'y': r::double},
  {'i': 1, 'cut': (b >= e) <> (g >= e), 'x': c + 1.0::double, 'y': r + (e - b) / nullif(g - b, 0)},
  {'i': 2, 'cut': (g >= e) <> (h >= e), 'x': c + 1 - (e - g) / nullif(h - g, 0), 'y': r + 1.0::double},
  {'i': 3, 'cut': (h >= e) <> (a >= e), 'x': c::double, 'y': r + 1 - (e - h) / nullif(a - h, 0)}]) t from m),
s as (select c, r, e, list(t.x order by t.i) x, list(t.y order by t.i) y from p where t.cut group by all)
select e ele, (e % 100 = 0)::integer as level, count(*) segments, round(sum(sqrt(pow(x[2] - x[1], 2) + pow(y[2] - y[1], 2))), 3) pixels from s group by all""",
    "dem",
)

_NEXT = " ".join(f"when state = '{s}' and event = '{e}' then '{to}'" for (s, e), to in MOVES.items())
JOB_STATES = f"""with recursive e as (select user_id::bigint job_id, row_number() over (partition by user_id order by event_id) i,
  ['enqueue', 'yield', 'finish', 'fail', 'acknowledge'][(event_id % 5 + 1)::int] event from events),
f(job_id, i, state) as (select distinct job_id, 0::bigint, 'idle' from e union all
  select f.job_id, e.i, case {_NEXT} else state end from f join e on e.job_id = f.job_id and e.i = f.i + 1)
select job_id, arg_max(state, i) state from f group by 1"""

REPORT = d.with_tables(
    f"""{_TAGS}, v as (select *, first_value(description) over w d0, first_value(detail) over w t0 from tg where kind in ('debt', 'bug') window w as (partition by kind, id order by path, line)),
r as (select kind, id, '- ' || id || ' ' || any_value(d0) || ' [' || any_value(t0) || '] ' || string_agg(path || ':' || line::varchar, ', ' order by path || ':' || line::varchar) filter (description = d0 and detail = t0) t from v group by 1, 2),
b as (select kind, '## ' || kind || chr(10) || string_agg(t, chr(10) order by id) body from r group by 1)
select string_agg(body, chr(10) || chr(10) order by kind = 'bug') page from b""",
    "source_lines",
)

SVG = d.with_tables(
    """, e as (select route_id, seq, (500 + seq * 7 % 40 + route_id % 11)::double elev from route_points),
m as (select route_id, seq, elev, min(elev) over v lo, max(elev) over v hi, count(*) over v n, row_number() over (partition by route_id order by seq) - 1 i from e window v as (partition by route_id)),
p as (select route_id, seq, case when n > 1 then i / (n - 1) else 0 end * 300.0::double x, 80 - (elev - lo) / greatest(hi - lo, 5) * 80.0::double y from m),
s as (select route_id, 'M' || string_agg(printf('%.1f,%.1f', x, y), ' L' order by seq) line from p group by 1)
select route_id, length(line)::integer n_line, length(line || ' L300.0,80.0 L0.0,80.0 Z')::integer n_area from s""",
    "route_points",
)

#: All trails against all points: for each trail the edge nearest as a great circle, then the trail nearest in plain coordinates.
NEAREST_EXACT = d.with_tables(
    f""", pt as (select node_id point_id, cast(100 * lon_u as double) * cast(1e-9 as double) qx, cast(100 * lat_u as double) * cast(1e-9 as double) qy from peaks),
g as (select route_id, seq, lng ax, lat ay, lead(lng) over w bx, lead(lat) over w by_ from route_points semi join trails on id = route_id window w as (partition by route_id order by seq)),
s as (select point_id, qx, qy, route_id id, seq, ax, ay, bx, by_, least(greatest(coalesce(((qx - ax) * (bx - ax) + (qy - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0), 0), 1) t from pt, g where bx is not null),
h as (select point_id, id, seq, qx plng, qy plat, ax + t * (bx - ax) lng, ay + t * (by_ - ay) lat from s),
m as (select point_id, id, seq, sqrt(pow(lng - plng, 2) + pow(lat - plat, 2)) dist, 2 * 6371000 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))) metres from h),
e as (select point_id, id, arg_min(dist, (metres, seq)) dist, min(metres) metres from m group by 1, 2),
b as (select point_id, arg_min(id, (dist, id)) id, arg_min(metres, (dist, id)) metres from e group by 1)
select point_id, b.id trail_id, name as name, highway, round(metres)::bigint metres from b join trails on trails.id = b.id""",
    "peaks",
    "trails",
)


def _paths() -> str:
    first = f""", p as (select route_id, seq, node_id, lng, lat, lag(node_id) over w prev, lag(lng) over w plng, lag(lat) over w plat
 from (select way_id route_id, pos seq, node_id, lon lng, lat from line) window w as (partition by route_id order by seq)),
o as (select prev a, node_id b, 2 * 6371000 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))) cost from p where prev is not null and prev <> node_id),
g as materialized (select a, b, min(cost) cost from (select a, b, cost from o union all select b, a, cost from o) group by 1, 2),
r0 as materialized (select 1::bigint node, 0.0::double cost)"""
    rounds = ", ".join(f"r{k} as materialized (select node, min(cost) cost from (from r{k - 1} union all select g.b, r.cost + g.cost from r{k - 1} r join g on g.a = r.node) group by 1)" for k in range(1, ROUNDS + 1))
    return d.with_tables(f"{first}, {rounds} select 0::bigint source, node, round(cost, 3) cost from r{ROUNDS}", "line")


#: Heights along a route without jitter: thinned in (distance, height), the others on straight lines between kept points.
_ELEVATIONS = f"{_PROFILE.replace(', p as (', ', pr as (', 1).replace(' from p)', ' from pr)', 1)}{_LEN}, k1 as (select route_id, seq, sum(m) over (partition by route_id order by seq) dist from q)"
SMOOTH = f"""{_recursive(d.with_tables(f'''{_ELEVATIONS},
prof as materialized (select route_id, seq, dist, elev, row_number() over (partition by route_id order by seq) k, count(*) over (partition by route_id) n from k1 join e using (route_id, seq)),
{_thinned("select route_id id, k, n, dist x, elev y from prof", 3.0)},
f as (select prof.*, kept.k is not null or n = 1 keep from prof left join kept on kept.id = route_id and kept.k = prof.k),
z as (select *, last_value(case when keep then dist end ignore nulls) over l d0, last_value(case when keep then elev end ignore nulls) over l e0, first_value(case when keep then dist end ignore nulls) over r d1, first_value(case when keep then elev end ignore nulls) over r e1
 from f window l as (partition by route_id order by seq rows between unbounded preceding and current row), r as (partition by route_id order by seq rows between current row and unbounded following))''', "route_points"))}
select route_id, seq, round(case when keep then elev else e0 + coalesce((dist - d0) / nullif(d1 - d0, 0), 0) * (e1 - e0) end, 3) elev from z"""

ORACLE_SQL: dict[str, str] = {
    "geo01_rdp_simplify": RDP,
    "geo03_tile_binning": BINNING,
    "geo04_mvt_geometry": DECODED,
    "snk06_pmtiles_roundtrip": ARCHIVED,
    "gen04_grid_traversal": TRAVERSAL,
    "geo10_contours": CONTOURS,
    "geo11_hillshade": HILLSHADE,
    "str09_job_states": JOB_STATES,
    "snk22_report": REPORT,
    "prj33_svg_paths": SVG,
    "jon11_nearest_exact": NEAREST_EXACT,
    "geo13_shortest_path": _paths(),
    "agg14_profile_smooth": SMOOTH,
}
