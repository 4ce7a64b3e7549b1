"""SQL for the queries of ``studies``."""

from __future__ import annotations

from haargrid.jobs.oracle import DETAIL, LONG, STATS, forward, r6, vectors

DEEPEST = 20
GRID = """g as (select event_type as grid, user_id as x, date_diff('day', date '1970-01-01', ts::date)::bigint as y, hour(ts)::bigint as z, count(*)::double as v from events group by all),
box as (select *, greatest(level_x, level_y, level_z) as deepest from (select grid, """ + ", ".join(f"min({c}) as low_{c}, max({c}) as high_{c}, ceil(log2(max({c}) - min({c}) + 1))::int as level_{c}" for c in "xyz") + " from g group by grid))"


def rank(d: int, k: str) -> str:
    """How many lower dimensions are halved at depth k."""
    return " + ".join(["0", *(f"(level_{c} > {k})::int" for c in "xyz"[:d])])


def slot(k: int) -> str:
    bits = [f"case when level_{c} > {k} then ((({c} - low_{c}) >> greatest(level_{c} - 1 - {k}, 0)) & 1) << ({rank(d, str(k))}) else 0 end" for d, c in enumerate("xyz")]
    return f"case when {k} < deepest then ({' + '.join(bits)})::varchar else '' end"


def index(d: int, c: str) -> str:
    steps = [f"case when length(path) > {k} and level_{c} > {k} then ((substr(path, {k + 1}, 1)::bigint >> ({rank(d, str(k))})) & 1) << (least(level_{c}, length(path)) - 1 - {k}) else 0 end" for k in range(DEEPEST)]
    return f"({' + '.join(steps)})::bigint"


KIDS = "(1 << (" + " + ".join(f"(level_{c} > length(path))::int" for c in "xyz") + "))"
TREE = GRID + """, cell as (select grid, level_x, level_y, level_z, deepest, v, """ + " || ".join(slot(k) for k in range(DEEPEST)) + """ as full_path from g join box using (grid)),
region as (select grid, level_x, level_y, level_z, substr(full_path, 1, d) as path, count(*) as n, min(v) as lo, max(v) as hi from (select *, unnest(range(0, deepest + 1))::int as d from cell) group by all),
node as (select grid, level_x, level_y, level_z, path, case when hole then least(lo, 0) else lo end as lo, case when hole then greatest(hi, 0) else hi end as hi from (select *, n < (1::bigint << (""" + " + ".join(f"greatest(level_{c} - length(path), 0)" for c in "xyz") + """)) as hole from region)),
split as (select * from node where lo != hi),
child as (select grid, level_x, level_y, level_z, path || s::varchar as path from (select *, unnest(range(0, """ + KIDS + """))::int as s from split) union all select grid, level_x, level_y, level_z, path from node where path = ''),
tree as (select child.*, coalesce(node.lo, 0) as v from child left join node using (grid, path) where node.grid is null or node.lo = node.hi),
placed as (select grid, path, v, """ + ", ".join(f"level_{c}, 1::bigint << (level_{c} - least(level_{c}, length(path))) as size_{c}, {index(d, c)} as index_{c}" for d, c in enumerate("xyz")) + """ from tree),
leaf_box as (select placed.*, """ + ", ".join(f"low_{c}, high_{c}, low_{c} + index_{c} * size_{c} as {c}" for c in "xyz") + " from placed join box using (grid))"
OUTSIDE = " or ".join(f"{c} > high_{c} or {c} + size_{c} <= low_{c}" for c in "xyz")
WORLD = {"x": "x * 0.5::double + y * 0.25::double + 1.0", "y": "y * 0.5::double - 2.0", "z": "z * 2.0::double + 3.0"}

LINES = vectors(1) + ", " + forward(1, 6)


def canonical(thresholds: str) -> str:
    """can(threshold, tree_id, path, v): leaves of the canonical trees; kept(threshold, tree_id, path): their inner nodes."""
    return f"""{LINES}, t as (select unnest([{thresholds}])::double as threshold),
bad as (select threshold, tree_id, path from coef, t where j = 1 and abs(c) > threshold + 1e-12),
kept as (select distinct threshold, tree_id, substr(path, 1, d) as path from (select *, unnest(range(0, length(path) + 1))::int as d from bad)),
cand as (select threshold, tree_id, path || s as path from kept, (select unnest(['0', '1']) as s) union all select threshold, tree_id, '' from t, (select distinct tree_id from leaf)),
value as (select tree_id, path, c as v from coef where j = 0 union all select tree_id, path, v from leaf),
can as (select cand.*, value.v from cand anti join kept using (threshold, tree_id, path) join value using (tree_id, path)),
gone as (select threshold, tree_id, sum(abs(c) * pow(2.0, -length(path))) as discarded from (select * from coef, t where j = 1) anti join kept using (threshold, tree_id, path) group by all),
pair as (select can.threshold, can.tree_id, can.v, leaf.v as cell from can join (select tree_id, v, path as full_path, unnest(range(0, 7))::int as d from leaf) leaf on leaf.tree_id = can.tree_id and can.path = substr(leaf.full_path, 1, leaf.d))"""


ONE = "with " + canonical("0.05")
THREE = GRID + """, a as (select grid, x, y, z, v from g), b as (select * from a where v > 1), c as (select grid, x, y, z, least(v, 2) as v from a)"""
SPLITS = {c: f"least(2, greatest(1, level_{c} - 3))" for c in "xyz"}


#: Cells of 16 a side whose middles lie in the suppliers' closed solids, by the solids' inequalities.
SOLIDS = """solid as (select s_suppkey as grid, s_suppkey % 2 = 0 as box, case when s_suppkey % 2 = 0 then s_suppkey % 4 + 0.25::double else s_suppkey % 4 + 0.2718::double end as px, s_nationkey % 3 as py, s_suppkey % 3 as pz, s_suppkey % 7 + 2.0::double as sx, s_nationkey % 5 + 3.0::double as sy, floor(abs(s_acctbal))::bigint % 6 + 2.0::double as sz from supplier where s_suppkey % 5 != 0),
r as (select unnest(range(0, 16))::bigint as i), inside as (select grid, a.i as x, b.i as y, c.i as z from solid, r a, r b, r c where a.i + 0.5::double > px and b.i + 0.5::double > py and c.i + 0.5::double > pz
 and case when box then a.i + 0.5 < px + sx and b.i + 0.5 < py + sy and c.i + 0.5 < pz + sz else (a.i + 0.5::double - px) / sx + (b.i + 0.5::double - py) / sy + (c.i + 0.5::double - pz) / sz < 1 end)"""


def differing(p: str, q: str) -> str:
    return f"select '{p}' as first, '{q}' as second, count(*) filter ({p}.v is distinct from {q}.v) as cells from {p} full join {q} using (grid, x, y, z)"


def metric(name: str, value: str) -> str:
    return f"""select '{name}' as metric, method, level as lo, lead(level) over w as hi, n as n_lo, lead(n) over w as n_hi, mean as mean_lo, lead(mean) over w as mean_hi, med as median_lo, lead(med) over w as median_hi
 from (select method, level, avg({value}) as mean, median({value}) as med, count({value}) as n from m where {value} is not null and level >= 2 group by all) window w as (partition by method order by level)"""


RATE = "case when {c}_lo > 0 and {c}_hi > 0 then round(log2({c}_hi / {c}_lo), 6) + 0.0 end as rate_{c}"
EXTREMES = """select level, thingi_id, {r} as ratio, lo::int as rank, 'smallest' as block, kind from k where lo <= 10 union all select level, thingi_id, {r}, hi::int, 'largest', kind from k where hi <= 10"""

SOLID_TREE = f"{SOLIDS}, g as (select *, 1.0::double as v from inside), " + TREE.split("group by all),\n", 1)[1]

# cells of the ellipsoid of order lines, without blocks; the box is the whole cube
CUBE = """spread as (select x, y, z, greatest(x, y, z) as longest from (select (max(l_partkey) - min(l_partkey))::double as x, (max(l_suppkey) - min(l_suppkey))::double as y, (max(l_quantity) - min(l_quantity))::double as z from lineitem)),
lv as (select floor(log2(n))::int // 2 + 2 as level from (select count(*) as n from customer)), mid as (select i::bigint as i, (i + 0.5::double) / (1 << level) - 0.5 as m from (select level, unnest(range(0, (1 << level)::bigint)) as i from lv)),
""" + ", ".join(f"m{c} as (select i as {c}, (m / (0.25::double + 0.25::double * {c} / longest)) * (m / (0.25::double + 0.25::double * {c} / longest)) as q{c} from mid, spread)" for c in "xyz") + """,
g as materialized (select 'shape' as grid, x, y, z, 1.0::double as v from mx join my on qx + qy <= 1.0 join mz on qx + qy + qz <= 1.0),
box as (select 'shape' as grid, level as deepest, """ + ", ".join(f"0::bigint as low_{c}, (1 << level)::bigint as high_{c}, level as level_{c}" for c in "xyz") + " from lv)"
CUBE_TREE = CUBE + ", " + TREE.split("from g group by grid)), ", 1)[1]
_WHOLE = ", ".join(f"w{k} as (select x >> {k} as x, y >> {k} as y, z >> {k} as z from g group by all having count(*) = {8**k})" for k in range(4))
_LARGEST = " union all ".join(f"select {1 << k} as side, a.x << {k} as x, a.y << {k} as y, a.z << {k} as z from w{k} a" + (f" anti join (select x, y, z from w{k + 1}) b on b.x = a.x >> 1 and b.y = a.y >> 1 and b.z = a.z >> 1" if k < 3 else "") for k in range(4))

ORACLE_SQL: dict[str, str] = {
    "slice_blocks": f"with {CUBE}, {_WHOLE} select side::bigint as side, count(*) as n, " + ", ".join(f"sum({c})::bigint as sum_{c}" for c in "xyz") + f" from ({_LARGEST}) group by side",
    "slice_tree": f"with {CUBE_TREE} select grid as tree_id, path, v as value from tree",
    "sparse_build_events": f"with {TREE} select grid as tree_id, path, v as value from tree",
    "ref_histogram_partial": f"with {TREE} select (" + " + ".join(f"{1 << d} * (level_{c} > length(path))::int" for d, c in enumerate("xyz")) + ")::int as ref, count(*) as n from split group by 1",
    "grid_levels": f"with {GRID} select grid, level_x, level_y, level_z, " + ", ".join(f"least(level_{c}, 4)::int as capped_{c}, least(floor(log2(high_{c} - low_{c} + 1)), 4)::int as base_{c}" for c in "xyz") + ", full_nodes from box join (select grid, sum(1::bigint << (" + " + ".join(f"least(level_{c}, d)" for c in "xyz") + "))::bigint as full_nodes from (select *, unnest(range(0, deepest + 1))::int as d from box) group by grid) using (grid)",
    "outside_active_box": f"with {TREE} select grid as tree_id, count(*) filter ({OUTSIDE}) as leaves_outside, coalesce(sum(size_x * size_y * size_z) filter ({OUTSIDE}), 0)::bigint as cells_outside from leaf_box group by grid",
    "sparse_max_error": f"with {TREE} select grid as tree_id, path, {r6('v / 2')} as max_error from tree",
    "boolean_fill": f"with {GRID} select grid, x, y, z, true as value from g where v > 0.5",
    "leaf_midpoint_samples": f"with {TREE} select grid as tree_id, path, " + " + ".join(f"pow((index_{c} * size_{c} + 0.5::double) / pow(2.0, level_{c}) - 0.5, 2)" for c in "xyz") + " <= 0.35 * 0.35 as inside from leaf_box",
    "stage_reconstruction": f"with {GRID} select grid, x, y, z, v as value, " + ", ".join(f"{e} as world_{c}" for c, e in WORLD.items()) + " from g where v != 0",
    "approximate_topology": f"""with {GRID}, n as (select grid, 0 as level, x >> 3 as a, y >> 3 as b, z >> 3 as c, count(*) as k from g group by all union all select grid, 1, x >> 7, y >> 7, z >> 7, count(*) from g group by all union all select grid, 2, x >> 12, y >> 12, z >> 12, count(*) from g group by all),
 s as (select grid, count(*) filter (level = 0) as leaf_count, count(*) filter (level > 0) as non_leaf_count, sum(k) filter (level = 0)::bigint as active_voxels from n group by grid)
 select *, leaf_count * 512 as leaf_topo_bits, non_leaf_count * 8192 as internal_topo_bits_approx, leaf_count * 512 + non_leaf_count * 8192 as total_topo_bits_approx from s""",
    "canonical_lines": ONE + f" select can.tree_id, path, {r6('v')} as value, {r6('coalesce(discarded, 0)')} as discarded from can left join gone using (threshold, tree_id)",
    "downsplit_lines": ONE + f" select tree_id, path, {r6('v')} as value from can",
    "decomposed_lines": ONE + f" select tree_id, path, {r6('v')} as value from can",
    "partitioned_lines": ONE + f" select tree_id, path, {r6('v')} as value from can",
    "cascade_lines": "with " + canonical("0.01, 0.05, 0.2") + " select tree_id, threshold, count(*) as boxes from can group by all",
    "normalize_alternating": f"with {vectors(1)} select tree_id, ((i >> 4) & 3)::varchar || ((i >> 2) & 3)::varchar || (i & 3)::varchar as path, {r6('v')} as value, '333' as refs from emb",
    "push_and_normalize": f"with {vectors(3)} select tree_id, path, {r6('v')} as value from leaf",
    "lineage_round": DETAIL + """, go as (select tree_id, path from low group by all having max(abs(c)) <= 0.06 + 1e-12)
 select leaf.tree_id, leaf.path, coalesce(go.path, leaf.path) as new_path from leaf left join go on go.tree_id = leaf.tree_id and go.path = substr(leaf.path, 1, 1)""",
    "lineage_partial": DETAIL + """, plan as (select tree_id, path, case when max(abs(c)) <= 0.06 + 1e-12 then 3 else """ + " + ".join(f"(max(abs(c)) filter (j & {b} != 0) <= 0.06 + 1e-12)::int" for b in (1, 2, 4)) + """ end as dims from low group by all)
 select tree_id, (1 << dims)::bigint as n, sum(8 // (1 << dims))::bigint as leaves from plan group by all""",
    "partition_splits": f"with {GRID} select grid, " + ", ".join(f"{s}::int as cut_{c}, (level_{c} - {s})::int as left_{c}" for c, s in SPLITS.items()) + f", (1 << ({' + '.join(SPLITS.values())}))::int as n_parts from box",
    "metadata_roundtrip": f"with {GRID} select low_x || ',' || low_y || ',' || low_z as bbox_min, level_x || ',' || level_y || ',' || level_z as per_dim_levels, '2,1,1' as grid_levels, 16 as n_partitions from box",
    "csv_pivot": f"with {STATS} select thingi_id::varchar as thingi_id, " + ", ".join(f"coalesce(max(case when level = {x} then ds_bytes end)::varchar, 'nan') as l{x}" for x in range(1, 8)) + " from stats group by stats.thingi_id having count(ds_bytes) > 0",
    "stats_append": f"with {STATS} select thingi_id, level, n_rows as can_nodes, can_bytes as can_raw_total_bytes, ds_bytes as ds_raw_total_bytes, null::bigint as vdb_file_bytes from stats where level >= 2",
    "tool_lines": f"""with {GRID}, n as (select grid, 0 as level, 512 as bits, x >> 3 as a, y >> 3 as b, z >> 3 as c, count(*) as k from g group by all union all select grid, 1, 8192, x >> 7, y >> 7, z >> 7, count(*) from g group by all union all select grid, 2, 65536, x >> 12, y >> 12, z >> 12, count(*) from g group by all),
 s as (select grid, count(distinct level) as levels, count(*) as nodes, sum(bits)::bigint as bits, count(*) filter (level = 0) as leafs, sum(k) filter (level = 0)::bigint as active from n group by grid)
 select grid, levels, nodes, bits as level_bits, bits as total_topology_bits, ceil(bits / 8.0)::bigint as total_topology_bytes, leafs as leaf_count, active as active_leaf_voxels, leafs * 512 - active as inactive_leaf_voxels, 0::bigint as active_tiles, active as total_leaf_coefficients, active as total_coefficients, leafs * 16384 as dense_value_bits, active * 32 as active_value_bits from s""",
    "discover_pairs": f"""with {STATS} select thingi_id, level, 'runs/' || thingi_id || '_l' || level || '_canonical_3d.bin' as canonical,
 case when thingi_id % 3 = 0 then 'runs/' || thingi_id || '_l' || level || '_pushdown_3d.bin' when thingi_id % 2 = 0 then 'runs/' || thingi_id || '_l' || level || '_downsplit_3d.bin' end as restructured,
 case when thingi_id % 5 = 0 then 'runs/' || thingi_id || '_l' || level || '_openvdb.vdb' end as vdb from stats where level != 3""",
    "sweep_folder_scan": f"""with {STATS}, f as (select 'thr_0.' || lpad(thingi_id::varchar, 6, '0') as folder, thingi_id, level from stats where not (thingi_id % 10 = 5 and level = 2))
 select folder, substr(folder, 5)::double as threshold from f where level <= 3 group by folder having count(distinct level) = 3""",
    "named_grid_scan": f"with {GRID} select grid, x, y, z, v as value from g where grid = (select min(grid) from g)",
    "level_pivots": f"with {STATS}, c as (" + " union all ".join(f"select '{m}' as col, thingi_id, level, {c}::double as v from stats" for m, c in (("can", "can_bytes"), ("ds", "ds_bytes"), ("vdb", "vdb_bytes"), ("rows", "n_rows"))) + ') select thingi_id, col as "column", ' + ", ".join(f"max(case when level = {x} then v end) as l{x}" for x in range(2, 8)) + " from c where level between 2 and 7 group by thingi_id, col having count(v) > 0",
    "extremal_both_ratios": f"""with {STATS}, r as (select 'bytes' as kind, level, thingi_id, vdb_bytes / ds_bytes::double as ratio from stats where vdb_bytes > 0 and ds_bytes > 0 union all select 'counts', level, thingi_id, n_rows / ds_bytes::double from stats where n_rows > 0 and ds_bytes > 0),
 k as (select *, row_number() over (partition by kind, level order by ratio, thingi_id) as lo, row_number() over (partition by kind, level order by ratio desc, thingi_id desc) as hi from r) """ + EXTREMES.format(r=r6("ratio")),
    "slope_rates_by_metric": f"""with {LONG}, m as (select method, level, value::double as a, value / n_rows::double as b, case when value is not null then n_rows::double end as c from long join stats using (thingi_id, level)),
 p as ({metric('bytes', 'a')} union all {metric('bytes_by_row', 'b')} union all {metric('rows', 'c')}), q as (select metric, method, lo, hi, n_lo, n_hi, mean_lo, mean_hi, median_lo as med_lo, median_hi as med_hi from p where hi is not null)
 select metric, method, lo, hi, n_lo, n_hi, {r6('mean_lo')} as mean_lo, {r6('mean_hi')} as mean_hi, {r6('med_lo')} as median_lo, {r6('med_hi')} as median_hi, {RATE.format(c='mean')}, {RATE.format(c='med').replace('rate_med', 'rate_median')} from q""",
    "semijoin_returned": f"with {STATS} select thingi_id, level, can_bytes from stats where exists (select 1 from lineitem where l_returnflag = 'R' and l_quantity >= 45 and l_suppkey = thingi_id and l_linenumber = level)",
    "equality_of_all_pairs": f"with {THREE} " + " union all ".join(differing(p, q) for p, q in (("a", "b"), ("a", "c"), ("b", "c"))),
    "unit_cube": """with p as (select l_returnflag as thing, l_orderkey, l_linenumber, l_partkey::double as x, l_suppkey::double as y, l_quantity as z from lineitem),
 b as (select thing, min(x) as lx, min(y) as ly, min(z) as lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as side from p group by thing)
 select thing, l_orderkey, l_linenumber, """ + ", ".join(f"{r6(f'case when side > 0 then ({c} - l{c}) / side else 0 end')} as {c}" for c in "xyz") + " from p join b using (thing)",
    "open_meshes": "select s_suppkey as mesh from supplier where s_suppkey % 5 = 0",
    "mesh_trees": f"with {SOLID_TREE} select grid as tree_id, count(*) as leaves, sum(case when v > 0 then size_x * size_y * size_z else 0 end)::bigint as cells from placed group by grid",
    "mesh_voxels": f"with {SOLIDS} select grid, x, y, z from inside",
    "mesh_filter_slice": "select p_partkey, rn as row from (select p_partkey, row_number() over (order by p_partkey) - 1 as rn, count(*) over () as n from part where p_size <= 40 and p_brand is not null and p_retailprice > 0) where rn >= round_even(2 * n / 5.0, 0) and rn < round_even(3 * n / 5.0, 0)",
}
