"""SQL texts that give the results of ``queries()`` on the plain tables, for another engine."""

from __future__ import annotations

VIEWS = {
    "v_profiles": """
select o_orderkey as id,
  'race/' || lower(replace(o_orderpriority, ' ', '-')) || '/' || year(o_orderdate) || '/stage-' || o_orderkey as pcs_url,
  lower(replace(o_orderpriority, ' ', '-')) as slug,
  o_orderpriority as race_name, cast(year(o_orderdate) as int) as season, cast(o_orderkey as varchar) as stage_number,
  case when o_orderkey % 97 = 0 then null when o_orderkey % 89 = 0 then 0.0 else o_totalprice / 1000 end as distance_km,
  case when o_orderkey % 101 = 0 then null else cast((o_custkey * 37 + o_orderkey * 11) % 5000 as int) end as vertical_meters,
  cast((o_custkey * 7) % 400 as int) as profile_score,
  case o_orderstatus when 'F' then 'bunch_sprint' when 'O' then 'solo_or_breakaway' else null end as victory_type
from orders""",
    "v_climbs": """
select stage_id, climb_order, climb_url, category, length_km, steepness_pct, top_elevation_m, km_before_finish from (
 select l_orderkey as stage_id, l_linenumber as climb_order, 'location/' || l_partkey as climb_url,
  case when l_returnflag = 'A' and l_linenumber % 2 = 0 then 'HC' when l_returnflag = 'R' then '1'
       when l_returnflag = 'N' then cast(2 + l_linenumber % 3 as varchar) else null end as category,
  l_quantity / 4 as length_km, case when l_tax = 0 then null else round(l_discount * 100, 2) end as steepness_pct,
  case when l_partkey % 50 = 0 then 0 else cast(floor(l_extendedprice / 40) as int) end as top_elevation_m,
  case when l_partkey % 20 = 0 then null else l_quantity end as km_before_finish,
  row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as rn
 from lineitem) x where rn = 1""",
    "v_results": """
select l_orderkey as stage_id,
  cast(row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as int) as rank,
  'rider/' || l_suppkey as rider_url, s_name as rider_name, n_name as team_name
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "v_startlist": """
select '1-urgent' as race_slug, 2024 as season, 'rider/' || s_suppkey as rider_url, s_name as rider_name, n_name as team_name
from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 <> 0""",
    "v_day_results": """
select stage_id, user_id, finish_time_seconds,
  row_number() over (partition by stage_id order by finish_time_seconds, user_id) as rank,
  finish_time_seconds - min(finish_time_seconds) over (partition by stage_id) as gap_seconds from (
 select stage_id, user_id, case stage_id % 3 when 0 then s when 1 then s - s % 1200 else s - s % 21600 end as finish_time_seconds from (
  select cast(extract(day from ts) as int) as stage_id, user_id,
   min(cast(extract(hour from ts) as int) * 3600 + cast(extract(minute from ts) as int) * 60 + cast(floor(extract(second from ts)) as int)) as s
  from events group by 1, 2) a) b""",
    "v_pages": """
select page_id * 10 + v as id, url, fetched_at,
  case v when 1 then replace(html, 'track(', 'track(9')
         when 2 then case when page_id % 2 = 0 then replace(html, '</article>', '<p>Update</p></article>') else html end
         else html end as html
from pages cross join (values (0, timestamp '2024-01-01'), (1, timestamp '2024-01-02'),
  (2, timestamp '2024-01-03'), (3, timestamp '2024-01-04')) as f(v, fetched_at)""",
    "v_hashed": r"""
select id, url, fetched_at, sha256(trim(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'),
      '^.*?<body\b[^>]*>', '', 'is'), '</body\s*>.*$', '', 'is'),
    '<[/!?a-zA-Z][^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
  'Pageload \d+\.\d+s', '', 'g'), '\s+', ' ', 'g'))) as html_sha256
from v_pages""",
    "v_log": """
select id, url, fetched_at, html_sha256 from (
 select *, lag(html_sha256) over (partition by url order by fetched_at, id) as before from v_hashed) x
where html_sha256 is distinct from before""",
    "v_features": """
select p.id, p.pcs_url, p.race_name, p.season, p.victory_type, p.distance_km,
  cast(p.vertical_meters as double) as vertical_meters, p.vertical_meters / p.distance_km as climb_ratio,
  cast(p.profile_score as double) as profile_score,
  cast(coalesce(c.n, 0) as double) as nb_climbs, cast(coalesce(c.hard, 0) as double) as nb_hard_climbs,
  cast(coalesce(c.alt, 0) as double) as max_altitude, coalesce(c.steep, 0) as avg_steepness_pct,
  coalesce(c.last_km, p.distance_km) as km_last_climb_to_finish
from v_profiles p left join (
 select stage_id, count(*) as n, count(*) filter (where category in ('1', 'HC')) as hard, max(top_elevation_m) as alt,
  avg(steepness_pct) as steep, arg_max_null(km_before_finish, climb_order) as last_km
 from v_climbs group by stage_id) c on c.stage_id = p.id
where p.distance_km is not null and p.distance_km <> 0 and p.vertical_meters is not null and p.profile_score is not null""",
}

VIEWS["v_landed"] = """
select o_orderkey, o_custkey, pcs_url as url, slug, season, stage_number, floor(o_totalprice / 1000) as dist,
 o_orderkey % 13 = 0 as blocked, o_orderkey % 13 <> 0 and o_orderkey % 17 = 0 as blank
from orders join v_profiles on id = o_orderkey"""
_RACE = "array_to_string(list_transform(string_split(replace(slug, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

FEATURES = (
    "distance_km", "vertical_meters", "climb_ratio", "profile_score", "nb_climbs", "nb_hard_climbs", "max_altitude",
    "avg_steepness_pct", "km_last_climb_to_finish",
)
RADAR = ("distance_km", "vertical_meters", "climb_ratio", "nb_hard_climbs", "max_altitude", "avg_steepness_pct")

VIEWS["v_z"] = (
    "select f.id, f.victory_type, "
    + ", ".join(f"(f.{c} - s.{c}_m) / s.{c}_d as z_{c}" for c in FEATURES)
    + " from v_features f, (select "
    + ", ".join(f"avg({c}) as {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1) as {c}_d" for c in FEATURES)
    + " from v_features) s"
)
_DISTANCE = "sqrt(" + " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in FEATURES) + ")"
VIEWS["v_twins"] = f"""
select id, unnest(near).id as twin_id, unnest(near).d as distance, unnest(range(1, len(near) + 1)) as rank from (
 select a.id, min({{'d': {_DISTANCE}, 'id': b.id}}, 8) as near from v_z a join v_z b on a.id <> b.id group by a.id) x"""
_USES = {
    "v_features": ("v_profiles", "v_climbs"), "v_z": ("v_features",), "v_twins": ("v_z",), "v_hashed": ("v_pages",),
    "v_log": ("v_hashed",), "v_landed": ("v_profiles",),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for inner in [*_needed(_USES.get(name, ())), name]:
            if inner not in out:
                out.append(inner)
    return out


def _on(names: str, body: str) -> str:
    views = _needed(tuple(names.split()))
    # Views used by more than one other view are computed once.
    parts = [f"{v} as materialized ({VIEWS[v].strip()})" for v in views]
    extra = body.strip()
    if extra.startswith("with "):
        parts.append(extra[5:])
        return "with " + ",\n".join(parts)
    return "with " + ",\n".join(parts) + "\n" + extra


TARGET = 7


def _single(k: int) -> str:
    return (
        f"select b.id as twin_id, {_DISTANCE} as distance, b.victory_type, "
        f"row_number() over (order by {_DISTANCE}, b.id) as rank from v_z a join v_z b on a.id = {TARGET} and b.id <> {TARGET} "
        f"qualify rank <= {k}"
    )


_RATES = """select {by}cast(row_number() over ({part}order by cnt desc, first_rank) as int) as place, victory_type, cnt as "count",
 round(cnt / sum(cnt) over ({part2}), 6) as rate from (
 select {by}victory_type, count(*) as cnt, min(rank) as first_rank from t where victory_type is not null group by {by}victory_type) x"""

_ELEVATION = """with u as (select * from v_climbs where top_elevation_m <> 0 and length_km is not null and km_before_finish is not null),
b as (select p.id as stage_id, p.distance_km as dist, coalesce(max(u.top_elevation_m) * 0.22, 0.0) as valley
 from v_profiles p left join u on u.stage_id = p.id where p.distance_km is not null group by 1, 2),
pts as (
 select stage_id, 0 as seq, 0.0 as km, valley as elevation from b
 union all select stage_id, 1000000, dist, valley from b
 union all select b.stage_id, climb_order * 2 + 1, greatest(0.0, dist - km_before_finish - length_km), valley from b join u using (stage_id)
 union all select b.stage_id, climb_order * 2 + 2, dist - km_before_finish, cast(top_elevation_m as double) from b join u using (stage_id)),
points as (select stage_id, row_number() over (partition by stage_id order by km, seq) as point_no, km, elevation from pts)
"""

_DETAILS = """with details as (select r as race_order, p_partkey as row_order, 'location/' || p_partkey as climb_url,
 cast(p_size + r as double) as length_km, case when p_size % 7 = 0 then null else p_size / 4.0 end as steepness_pct,
 cast(p_size * 50 + r as int) as top_elevation_m, case when p_size % 5 = 0 then null else cast(p_size as double) end as km_before_finish
 from part cross join (values (0), (1)) as v(r) where p_size > 10 * r and p_brand <> 'Brand#11'),
facts as (select * exclude (race_order, row_order, rn) from (
 select *, row_number() over (partition by climb_url order by race_order desc, row_order desc) as rn from details) x where rn = 1)
"""

_LABEL = """case victory_type when 'bunch_sprint' then 'Sprint massif' when 'reduced_group_sprint' then 'Sprint groupe réduit'
 when 'solo_or_breakaway' then 'Solo / échappée' else coalesce(nullif(victory_type, ''), '—') end"""

_CHALLENGED = """select id, url, fetched_at,
 case when instr(url, '//m.') > 0 then replace(html, '<body>', '<body>Just a moment') else html end as html from v_pages"""

SQL = {
    "stage_features": _on("v_features", "select id, victory_type, "
                          + ", ".join(f"round({c}, 6) as {c}" for c in FEATURES) + " from v_features"),
    "standardized": _on("v_z", "select id, " + ", ".join(f"round(z_{c}, 6) as z_{c}" for c in FEATURES) + " from v_z"),
    "twins_single": _on("v_z", f"select cast(rank as int) as rank, twin_id, round(distance, 6) as distance from ({_single(8)}) x"),
    "twins_bulk": _on("v_twins", "select id, cast(rank as int) as rank, twin_id, round(distance, 6) as distance from v_twins"),
    "twins_embeddings": """with v as (select vec_id, cast(embedding as double[]) as e from embeddings)
select a.vec_id as id, b.vec_id as twin_id, round(list_distance(a.e, b.e), 6) as distance,
 cast(row_number() over (partition by a.vec_id order by list_distance(a.e, b.e), b.vec_id) as int) as rank
from v a join v b on a.vec_id <> b.vec_id qualify rank <= 8""",
    "base_rates": _on("v_z", f"with t as ({_single(8)}) "
                      + _RATES.format(by="", part="", part2="")),
    "base_rates_all": _on("v_twins", "with t as (select w.id, w.rank, p.victory_type from v_twins w join v_profiles p on p.id = w.twin_id) "
                          + _RATES.format(by="id, ", part="partition by id ", part2="partition by id")),
    "radar_single": _on("v_features", " union all ".join(
        f"select '{c}' as feature, round(max(t.{c}), 6) as value, "
        f"cast(case when count(*) <= 1 then 50 else round(count(*) filter (where f.{c} < t.{c}) / (count(*) - 1) * 100) end as int) as percentile "
        f"from v_features f, (select * from v_features where id = {TARGET}) t" for c in RADAR)),
    "radar_all": _on("v_features", " union all ".join(
        f"select id, '{c}' as feature, round({c}, 6) as value, "
        f"cast(case when count(*) over () <= 1 then 50 else round(percent_rank() over (order by {c}) * 100) end as int) as percentile "
        f"from v_features" for c in RADAR)),
    "time_to_seconds": """select event_id, t as time_text,
 case when t = '' or t like '%x%' then null else list_reduce(list_transform(string_split(t, ':'), lambda p: cast(p as bigint)), lambda a, p: a * 60 + p) end as seconds
from (select event_id, case event_id % 5 when 0 then h || ':' || lpad(cast(m as varchar), 2, '0') || ':' || lpad(cast(s as varchar), 2, '0')
 when 1 then m || ':' || lpad(cast(s as varchar), 2, '0') when 2 then cast(s as varchar) when 3 then 'x:' || s else '' end as t from (
 select event_id, extract(hour from ts) as h, extract(minute from ts) as m, cast(floor(extract(second from ts)) as int) as s from events) a) b""",
    "gaps": _on("v_day_results", "select stage_id, user_id, cast(finish_time_seconds as bigint) as finish_time_seconds, cast(gap_seconds as bigint) as gap_seconds from v_day_results"),
    "victory": _on("v_day_results", """select stage_id, cast(n as int) as winner_group_size, case when n >= 20 then 'bunch_sprint'
 when n = 1 and coalesce(second_gap, 20) >= 20 then 'solo_or_breakaway' else 'reduced_group_sprint' end as victory_type
from (select stage_id, count(*) filter (where gap_seconds = 0) as n, min(gap_seconds) filter (where rank = 2) as second_gap
 from v_day_results group by stage_id) x"""),
    "victory_all_stages": _on("v_profiles v_results", """select p.id as stage_id, case when r.n is null then null when r.n >= 20 then 'bunch_sprint'
 when r.n = 1 and coalesce(r.second_gap, 20) >= 20 then 'solo_or_breakaway' else 'reduced_group_sprint' end as victory_type,
 cast(r.n as int) as winner_group_size
from v_profiles p left join (select stage_id, count(*) filter (where t = w) as n, min(t - w) filter (where rank = 2) as second_gap from (
 select stage_id, rank, t, min(t) filter (where rank = 1) over (partition by stage_id) as w
 from (select stage_id, rank, 14000 + (rank // 3) * 13 as t from v_results) a) b group by stage_id) r on r.stage_id = p.id"""),
    "rider_matchup": _on("v_z v_results v_startlist", f"""with t as materialized ({_single(10)})
select rider_url, rider_name, team_name, appearances, best_rank, round(avg_rank, 6) as avg_rank from (
select s.rider_url, r.rider_name, s.team_name, count(*) as appearances, min(r.rank) as best_rank, avg(r.rank) as avg_rank
from v_startlist s join v_results r on r.rider_url = s.rider_url join t on t.twin_id = r.stage_id
where r.rank <= 10 and s.race_slug = '1-urgent' and s.season = 2024 group by 1, 2, 3) x
order by appearances desc, x.avg_rank, rider_url, rider_name limit 15"""),
    "elevation_points": _on("v_profiles v_climbs", _ELEVATION
                            + "select stage_id, cast(point_no as int) as point_no, round(km, 6) as km, round(elevation, 6) as elevation from points"),
    "elevation_xy": _on("v_profiles v_climbs", _ELEVATION + """
, tops as (select stage_id, greatest(max(elevation), 1.0) as m, max(elevation) as peak from points group by 1),
firsts as (select points.stage_id, min(point_no) as top_no from points join tops using (stage_id) where elevation = peak group by 1)
select q.stage_id, cast(q.point_no as int) as point_no, round(case when b.dist > 0 then q.km / b.dist * 1000 else 0 end, 6) as x,
 round(112 - q.elevation / t.m * 104, 6) as y, q.point_no = f.top_no and q.elevation > 0 as is_top
from points q join b using (stage_id) join tops t using (stage_id) join firsts f using (stage_id)"""),
    "listing_page": _on("v_profiles", """select id, pcs_url, race_name, season, distance_km from v_profiles where distance_km is not null
order by season desc nulls first, race_name asc nulls last, id limit 25 offset 25"""),
    "listing_filtered": _on("v_profiles", """select id, pcs_url, race_name, season, distance_km from v_profiles where distance_km is not null
 and season = 1997 and race_name = '2-HIGH' and victory_type = 'bunch_sprint'
order by season desc nulls first, race_name asc nulls last, id limit 25"""),
    "listing_total": _on("v_profiles", """select count(*) as total, greatest(1, cast(ceil(count(*) / 25.0) as bigint)) as pages
from v_profiles where distance_km is not null and season = 1997"""),
    "dashboard_stats": _on("v_profiles", """select count(*) as stage_count, count(distinct race_name) as race_count, min(season) as season_min,
 max(season) as season_max, case when min(season) = max(season) then cast(min(season) as varchar) else min(season) || '–' || max(season) end as season_label
from v_profiles"""),
    "filter_options": _on("v_profiles", """select distinct 'season' as option, cast(season as varchar) as value from v_profiles where season is not null
union all select distinct 'race_name', race_name from v_profiles where race_name is not null
union all select distinct 'victory_type', victory_type from v_profiles where victory_type is not null"""),
    "stage_detail": _on("v_profiles v_climbs", """select p.id, p.pcs_url, p.race_name, p.season, p.distance_km, c.climb_order, c.climb_url, c.category,
 c.length_km, c.top_elevation_m, c.km_before_finish from v_profiles p left join v_climbs c on c.stage_id = p.id"""),
    "upsert_profiles": _on("v_profiles", """with cur as (select * from v_profiles where season <= 1998),
inc as (select * replace (distance_km + 1 as distance_km, nullif(victory_type, 'bunch_sprint') as victory_type) from v_profiles where season >= 1997)
select coalesce(c.pcs_url, i.pcs_url) as pcs_url, case when c.id is not null then c.id else n.new_id end as id,
 case when i.id is not null then i.race_name else c.race_name end as race_name,
 case when i.id is not null then i.season else c.season end as season,
 round(case when i.id is not null then i.distance_km else c.distance_km end, 6) as distance_km,
 case when i.id is not null then i.victory_type else c.victory_type end as victory_type,
 c.id is null as is_new, i.id is not null as is_touched
from cur c full join inc i on c.pcs_url = i.pcs_url
left join (select inc.pcs_url, (select max(id) from cur) + row_number() over (order by inc.id, inc.pcs_url) as new_id
 from inc anti join cur on inc.pcs_url = cur.pcs_url) n on n.pcs_url = i.pcs_url"""),
    "upsert_children": _on("v_profiles v_climbs", """with touched as (select id as stage_id from v_profiles where season >= 1999),
inc as (select c.stage_id, c.climb_order, c.climb_url || '/new' as climb_url, cast(null as varchar) as category
 from v_climbs c semi join touched t on c.stage_id = t.stage_id where climb_order in (1, 2, 4)),
cut as (select t.stage_id, coalesce(max(i.climb_order), 0) as last from touched t left join inc i on i.stage_id = t.stage_id group by 1)
select coalesce(c.stage_id, i.stage_id) as stage_id, coalesce(c.climb_order, i.climb_order) as climb_order,
 case when i.stage_id is not null then i.climb_url else c.climb_url end as climb_url,
 case when i.stage_id is not null then i.category else c.category end as category,
 c.length_km, c.steepness_pct, c.top_elevation_m, c.km_before_finish
from (select v.* from v_climbs v left join cut on cut.stage_id = v.stage_id where cut.stage_id is null or v.climb_order <= cut.last) c
full join inc i on c.stage_id = i.stage_id and c.climb_order = i.climb_order"""),
    "replace_children": _on("v_profiles v_results", """with touched as (select id as stage_id from v_profiles where season >= 1999),
inc as (select stage_id, rank, rider_url from (
 select l_orderkey as stage_id, l_linenumber as rank, 'rider/' || l_suppkey as rider_url,
  row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as rn
 from lineitem semi join touched t on l_orderkey = t.stage_id where l_tax <> 0) x where rn = 1)
select stage_id, rank, rider_url from v_results r anti join touched t on r.stage_id = t.stage_id
union all select stage_id, rank, rider_url from inc"""),
    "insert_absent": """with cur as (select 'rider/' || c_custkey as rider_url, cast(null as bigint) as stage_id from customer where c_mktsegment <> 'BUILDING'),
inc as (select 'rider/' || o_custkey as rider_url, min(o_orderkey) as stage_id from orders group by 1)
select * from cur union all select * from inc anti join cur on inc.rider_url = cur.rider_url""",
    "replace_slice": """with cur as (select lower(n_name) as race_slug, 2024 as season, 'rider/' || c_custkey as rider_url, c_name as rider_name
 from customer join nation on c_nationkey = n_nationkey),
touched as (select lower(n_name) as race_slug, 2024 as season from nation where n_regionkey in (1, 2)),
inc as (select lower(n_name) as race_slug, 2024 as season, 'rider/' || s_suppkey as rider_url, s_name as rider_name
 from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1)
select * from cur anti join touched on cur.race_slug = touched.race_slug and cur.season = touched.season union all select * from inc""",
    "orphans": _on("v_profiles v_climbs", """select stage_id, climb_order from v_climbs c
anti join (select id from v_profiles where season >= 1996) p on p.id = c.stage_id"""),
    "cascade_delete": _on("v_profiles v_climbs", """select stage_id, climb_order from v_climbs c
semi join (select id from v_profiles where season >= 1996) p on p.id = c.stage_id"""),
    "dup_keys": """select l_orderkey as stage_id, l_linenumber as climb_order, count(*) as "rows" from lineitem group by 1, 2 having count(*) > 1""",
    "enrich_last_wins": _DETAILS + "select * from facts",
    "enrich_apply": _on("v_climbs", _DETAILS + """select c.stage_id, c.climb_order, c.climb_url, c.category,
 case when f.climb_url is not null then f.length_km else c.length_km end as length_km,
 case when f.climb_url is not null then f.steepness_pct else c.steepness_pct end as steepness_pct,
 case when f.climb_url is not null then f.top_elevation_m else c.top_elevation_m end as top_elevation_m,
 case when f.climb_url is not null then f.km_before_finish else c.km_before_finish end as km_before_finish
from v_climbs c left join facts f on f.climb_url = c.climb_url"""),
    "url_meta": _on("v_profiles", r"""select pcs_url as url, 'https://example.org/' || pcs_url as full_url,
 array_to_string(list_transform(string_split(replace(slug, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as race_name,
 season, stage_number from v_profiles
union all select url, url, null, null, null from pages"""),
    "fingerprint": _on("v_hashed", "select id, html_sha256 from v_hashed"),
    "changed_snapshots": _on("v_log", "select id, url, html_sha256 from v_log"),
    "latest_snapshot": _on("v_log", "select url, arg_max(id, fetched_at) as id from v_log group by url"),
    "work_list": _on("v_profiles", """select distinct slug, season, 'race/' || slug || '/' || season as race_url,
 'race/' || slug || '/' || season || '/startlist' as startlist_url, 'race/' || slug || '/' || season || '/route/climbs' as climbs_url
from v_profiles where season = 1997"""),
    "listed_startlists": """select slug as race_slug, season, count(*) as riders, min(rider_url) as first_rider from (
select distinct lower(replace(o_orderpriority, ' ', '-')) as slug, cast(year(o_orderdate) as int) as season,
 'rider/' || o_custkey as rider_url from orders) x where season % 2 = 0 and slug < '4' group by 1, 2""",
    "listed_climbs": _on("v_profiles v_climbs", """select race_name, season, count(distinct id) as stages, count(*) as climbs
from v_profiles join v_climbs on stage_id = id where season % 2 = 0 and slug < '4' group by 1, 2"""),
    "inline_work_list": """select split_part(pair, ':', 1) as slug, cast(split_part(pair, ':', 2) as int) as season, count(*) as stages
from (select unnest(string_split(races, ',')) as pair from (
 select lower(replace(o_orderpriority, ' ', '-')) || ':' || year(o_orderdate) || ',' || lower(o_orderstatus) || ':' || (year(o_orderdate) + 1) as races
 from orders) a) b group by 1, 2""",
    "failure_log": _on("v_pages", f"""with challenged as ({_CHALLENGED})
select 'pcs' as source, url, 'fetch error: challenge page returned instead of content' as reason, fetched_at is not null as has_time
from challenged where instr(html, 'Just a moment') > 0 or instr(html, 'cf-browser-verification') > 0"""),
    "replay_list": _on("v_log v_pages", """with failed as (select url, max(fetched_at) + interval 12 hour as failed_at from v_pages
 where id % 10 = 2 or instr(url, '//m.') > 0 group by url),
stored as (select url, max(fetched_at) as stored_at from v_log group by url)
select f.url, strftime(f.failed_at, '%Y-%m-%d %H:%M:%S') as failed_at from failed f left join stored s on s.url = f.url
where s.stored_at is null or s.stored_at <= f.failed_at"""),
    "label_lookup": _on("v_profiles", f"select id, {_LABEL} as label, victory_type is not null as is_run from v_profiles"),
    "climb_intensity": _on("v_features", "select id, round(least(climb_ratio / 40, 1.0), 6) as intensity from v_features"),
    "profile_json": _on("v_profiles", """select id, cast(to_json({'pcs_url': pcs_url, 'season': season, 'vertical_meters': vertical_meters, 'profile_score': profile_score}) as varchar) as raw_json
from v_profiles where vertical_meters is not null"""),
    "page_fields": r"""select page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang,
 trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as title
from pages""",
    "page_links": r"""select url as race_url, cast(generate_subscripts(links, 1) as int) as stage_no, unnest(links) as stage_url
from (select url, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) as links from pages) x""",
    "snapshot_roundtrip": "select page_id, sha256(html) as html_hash from pages",
    "falsy_fallback": "select p_partkey, coalesce(nullif(p_size % 3, 0), p_size) as observed, coalesce(p_size % 3, p_size) as documented from part",
    "climb_counts": _on("v_climbs", "select stage_id, count(*) as nb_climbs, max(climb_order) as last_order from v_climbs group by 1"),
    "ingest_profiles": _on("v_landed", f"""select url as pcs_url, {_RACE} as race_name, season, stage_number,
 cast(dist as double) as distance_km, cast(o_custkey % 5000 as int) as vertical_meters, cast(null as int) as profile_score, 2 as nb_climbs,
 case when o_custkey % 40 >= 20 then 'solo_or_breakaway' else 'reduced_group_sprint' end as victory_type,
 case when o_custkey % 40 = 0 then 2 else 1 end as winner_group_size
from v_landed where not blocked and not blank
union all select url, 'Stored', season, stage_number, null, null, null, null, null, null
from v_landed where (blocked or blank) and season <= 1996"""),
    "ingest_climbs": _on("v_landed", """select url as pcs_url, n as climb_order, case n when 1 then 'First' else 'Second' end as climb_name,
 'location/' || (o_custkey + n - 1) as climb_url, case n when 1 then 'HC' end as category
from v_landed cross join (values (1), (2)) as v(n) where not blocked and not blank"""),
    "ingest_results": _on("v_landed", """select url as pcs_url, n as rank, 'rider/' || (o_custkey + n - 1) as rider_url,
 cast(14400 + case n when 2 then o_custkey % 40 else 0 end as int) as finish_time_seconds,
 cast(case n when 2 then o_custkey % 40 else 0 end as int) as gap_seconds
from v_landed cross join (values (1), (2)) as v(n) where not blocked and not blank"""),
    "ingest_failures": _on("v_landed", """select 'pcs' as source, url, case when blocked
 then 'fetch error: challenge page returned instead of content' else 'parse error: empty page' end as reason
from v_landed where blocked or blank"""),
    "reparse_profiles": _on("v_landed", """select url as pcs_url, case when season <= 1996 then 'Stored' end as race_name,
 case when season <= 1996 then season end as season, case when not blocked and not blank then cast(dist + 1 as double) end as distance_km
from v_landed where (not blocked and not blank) or season <= 1996"""),
    "startlist_ingest": """select 'c-' || c_custkey as race_slug, 2023 as season, cast(null as varchar) as race_name, 'rider/old' as rider_url,
 cast(null as varchar) as team_url from customer
union all select 'c-' || c_custkey, 2024, c_name, 'rider/' || (c_custkey + n), 'team/t'
from customer cross join (values (0), (1)) as v(n) where c_acctbal >= 0""",
    "enrich_job": _on("v_climbs", """with facts as (select 'location/' || coalesce(a.p_partkey, b.p_partkey + 1) as climb_url,
 coalesce(a.p_size, b.p_size) as size from part a full join part b on a.p_partkey = b.p_partkey + 1)
select c.stage_id, c.climb_order, c.climb_url, c.category,
 case when f.size is not null then cast(f.size as double) else c.length_km end as length_km,
 case when f.size is not null then f.size / 4.0 else c.steepness_pct end as steepness_pct,
 case when f.size is not null then f.size * 50 else c.top_elevation_m end as top_elevation_m,
 case when f.size is not null then cast(coalesce(nullif(f.size % 3, 0), f.size) as double) else c.km_before_finish end as km_before_finish
from v_climbs c left join facts f on f.climb_url = c.climb_url"""),
    "stream_late_changes": _on("v_hashed", """select id, url, html_sha256 from (
 select id, url, html_sha256, lag(html_sha256) over (partition by url order by day(fetched_at) % 2 desc, fetched_at, id) as before
 from v_hashed) x where before is null or before <> html_sha256"""),
    "stored_log": _on("v_log", """select id, url, html_sha256 from v_log
where fetched_at >= timestamp '2024-01-02' and fetched_at < timestamp '2024-01-04'"""),
    "stored_profiles": _on("v_landed", """select url as pcs_url, cast(dist + case o_orderkey % 4 when 1 then 1 else 0 end as double) as distance_km,
 2 as stage_climbs, 2 as stage_results from v_landed where not blocked and not blank"""),
    "run_counters": _on("v_landed", """select 'pcs' as source, cast(sum(case when blocked or blank then 0 else n end) as bigint) as ok,
 cast(sum(case when blocked or blank then n else 0 end) as bigint) as failed
from (select blocked, blank, case o_orderkey % 4 when 1 then 2 else 1 end as n from v_landed) x"""),
    "refetch_profiles": _on("v_landed", """select url as pcs_url, cast(dist + case o_orderkey % 4 when 1 then 1 else 0 end as double) as distance_km
from v_landed where not blocked and not blank"""),
    "refetch_failures": _on("v_landed", """select 'pcs' as source, url, case when blocked and (n = 1 or o_orderkey % 4 = 1) then 'fetch error' else 'parse error' end as kind,
 '2024-01-0' || n as day from v_landed cross join (values (1), (2)) as v(n)
where case when n = 1 then blocked or blank when o_orderkey % 4 = 1 then blocked or blank else o_orderkey % 4 <> 3 end"""),
    "discovered_profiles": _on("v_landed", """select url as pcs_url, 'Race ' || o_orderkey as race_name from v_landed
where not blocked and not blank and o_orderkey % 11 <> 0 and o_orderkey % 19 <> 0"""),
    "discovery_failures": _on("v_landed", """select 'pcs' as source, 'race/k-' || o_orderkey || '/2024' as url,
 case when o_orderkey % 11 = 0 then 'fetch error' else 'parse error' end as kind, '2024-01-01' as day
from v_landed where o_orderkey % 11 = 0 or o_orderkey % 19 = 0
union all select 'pcs', url, case when blocked then 'fetch error' else 'parse error' end, '2024-01-01'
from v_landed where (blocked or blank) and o_orderkey % 11 <> 0 and o_orderkey % 19 <> 0"""),
    "reparse_readable": _on("v_landed", """select url as pcs_url, cast(dist + case o_orderkey % 4 when 1 then 1 else 0 end as double) as distance_km
from v_landed where not blocked and not blank"""),
    "enrich_failures": """select 'enrich_climbs' as source, 'race/p-' || p_partkey || '/2024/route/climbs' as url,
 case p_partkey % 9 when 1 then 'fetch error' else 'parse error' end as kind, '2024-01-01' as day from part where p_partkey % 9 < 2""",
    "rider_records": """select 'rider/' || s_suppkey as pcs_url, s_name as name, (s_nationkey + 1980) || '-01-02' as birthdate,
 case when s_suppkey % 7 <> 0 then cast(s_suppkey % 40 + 50 as double) end as weight, cast('1.' || (s_suppkey % 30 + 60) as double) as height,
 'N' || s_nationkey as nationality from supplier""",
    "ranking_records": """select 'ranking/' || c_custkey as url, n as position, case n when 2 then '' else cast(n + 1 as varchar) end as rank,
 cast((c_custkey + n) * 3 as varchar) as points, 'R' as rider_name, 'rider/' || (c_custkey + n) as rider_url, 'T' || c_nationkey as team_name
from customer cross join (values (0), (1), (2)) as v(n)""",
    "ingest_json": _on("v_landed", f"""select url as pcs_url, case when not blocked and not blank then
 '{{"pcs_url":"' || url || '","race_name":"' || {_RACE} || '","season":' || season || ',"stage_number":"' || stage_number
 || '","distance":' || cast(dist as decimal(6,2)) || ',"vertical_meters":' || (o_custkey % 5000)
 || ',"profile_score":null,"profile_icon":null,"stage_type":null,"date":null,"departure":null,"arrival":null,"victory_type":"'
 || case when o_custkey % 40 >= 20 then 'solo_or_breakaway' else 'reduced_group_sprint' end
 || '","winner_group_size":' || case when o_custkey % 40 = 0 then 2 else 1 end
 || ',"climbs":[{{"climb_order":1,"climb_name":"First","climb_url":"location/' || o_custkey || '","category":"HC"}},'
 || '{{"climb_order":2,"climb_name":"Second","climb_url":"location/' || (o_custkey + 1) || '","category":null}}],"results":['
 || '{{"rank":1,"rider_name":"A","rider_url":"rider/' || o_custkey || '","team_name":null,"status":null,"finish_time_seconds":14400}},'
 || '{{"rank":2,"rider_name":"B","rider_url":"rider/' || (o_custkey + 1) || '","team_name":null,"status":null,"finish_time_seconds":'
 || (14400 + o_custkey % 40) || '}},{{"rank":null,"rider_name":"C","rider_url":"rider/0","team_name":null,"status":null,"finish_time_seconds":null}}],'
 || '"errors":["profile_score: ?"]}}' end as raw_json
from v_landed where (not blocked and not blank) or season <= 1996"""),
}
