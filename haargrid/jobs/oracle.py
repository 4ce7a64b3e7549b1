"""SQL for the registered queries, over the same tables, for an independent engine."""

from __future__ import annotations


def vectors(dims: int) -> str:
    """leaf(tree_id, path, v) of the embeddings' trees."""
    levels = 6 // dims
    coords = [f"((i >> {levels * d}) & {(1 << levels) - 1})" for d in range(dims)]
    path = " || ".join("(" + " + ".join(f"{1 << d} * (({c} >> {b}) & 1)" for d, c in enumerate(coords)) + ")::varchar" for b in reversed(range(levels)))
    return f"""emb as (select vec_id as tree_id, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as v from embeddings where embedding is not null),
leaf as (select tree_id, {path} as path, v from emb)"""


def forward(dims: int, levels: int) -> str:
    """coef(tree_id, path, j, c) of leaf."""
    return f"""coef as (select tree_id, substr(path, 1, d) as path, j,
  sum(case when bit_count(substr(path, d + 1, 1)::int & j) % 2 = 0 then v else -v end * pow(2.0, -{dims} * ({levels} - d))) as c
  from leaf, (select unnest(range(0, {levels}))::int as d), (select unnest(range(0, {1 << dims}))::int as j) group by all)"""


def r6(c: str) -> str:
    return f"round({c}, 6) + 0.0"


RASTER = """cells as (select l_suppkey as tree_id, l_partkey % 4 as x, l_orderkey % 4 as y, sum(l_quantity) as v from lineitem group by all)"""
RASTER_LEAF = RASTER + ", leaf as (select tree_id, " + " || ".join(f"(((x >> {b}) & 1) + 2 * ((y >> {b}) & 1))::varchar" for b in (1, 0)) + " as path, v from cells)"
VOXELS = "vox as (select user_id as grid, (day(ts) % 8)::bigint as x, (hour(ts) % 8)::bigint as y, (length(event_type) % 8)::bigint as z, count(*)::double as v from events group by all)"
CELLS = VOXELS + """, box as materialized (select grid, x, y, z from (select distinct grid from vox), (select unnest(range(0, 8)) as x), (select unnest(range(0, 8)) as y), (select unnest(range(0, 8)) as z)),
cell as materialized (select grid as tree_id, x, y, z, case when coalesce(v, 0) > 0 then 1.0 else 0.0 end::double as v, """ + " || ".join(f"(((x >> {b}) & 1) + 2 * ((y >> {b}) & 1) + 4 * ((z >> {b}) & 1))::varchar" for b in (2, 1, 0)) + """ as path from box left join vox using (grid, x, y, z))"""
# each stage is stored, so that no engine joins the regions with themselves while it still aggregates them
TREE = CELLS + """, region as materialized (select tree_id, substr(path, 1, d) as path, min(v) as v from cell, (select unnest(range(0, 4))::int as d) group by all having min(v) = max(v)),
inside as materialized (select r.tree_id, r.path from region r join region q on q.tree_id = r.tree_id and q.path = substr(r.path, 1, length(r.path) - 1) where r.path != ''),
tree as materialized (select tree_id, path, v from region anti join inside using (tree_id, path)),
node as (select distinct tree_id, substr(path, 1, k) as path from (select tree_id, path, unnest(range(0, length(path) + 1))::int as k from tree))"""
STATS = """stats as (select l_suppkey as thingi_id, l_linenumber as level, sum(l_quantity::bigint)::bigint as can_bytes, sum(case when l_returnflag = 'N' then l_quantity::bigint end)::bigint as ds_bytes,
  sum(case when l_linestatus = 'O' then l_quantity::bigint end)::bigint as vdb_bytes, count(*) as n_rows from lineitem group by all)"""
LONG = STATS + """, long as (select thingi_id, level, 'can' as method, can_bytes as value from stats union all select thingi_id, level, 'ds', ds_bytes from stats union all select thingi_id, level, 'vdb', vdb_bytes from stats)"""
TWO = VOXELS + ", other as (select grid, x, y, z, v - 0.5 as v from vox where v > 2), pair as (select grid, x, y, z, coalesce(vox.v, 0) as a, coalesce(other.v, 0) as b from vox full join other using (grid, x, y, z))"
DETAIL = "with " + vectors(3) + ", " + forward(3, 2) + ", low as (select * from coef where length(path) = 1 and j > 0)"


def index(c: int) -> str:
    bits = " + ".join(f"case when length(path) > {b} then ((substr(path, {b + 1}, 1)::bigint >> {c}) & 1) << (length(path) - 1 - {b}) else 0 end" for b in range(3))
    return f"({bits})::bigint"


def inside(x: str, y: str, z: str) -> dict[str, str]:
    t = f"greatest(0.0, least(1.0, (({x} - 0.2) + ({y} - 0.2) + ({z} - 0.2)) / 1.8))"
    return {
        "sphere": f"pow({x} - 0.5, 2) + pow({y} - 0.5, 2) + pow({z} - 0.5, 2) <= 0.35 * 0.35",
        "tetrahedron": f"{x} + {y} + {z} <= 1.0",
        "rod": " + ".join(f"pow({p} - 0.2 - {t} * 0.6, 2)" for p in (x, y, z)) + " <= 0.08 * 0.08",
    }


MORTON = " | ".join(f"((({c} >> {b}) & 1) << {3 * b + d})" for b in range(21) for d, c in enumerate(("l_partkey", "l_suppkey", "l_linenumber::bigint")))
UNMORTON = [" | ".join(f"(((o_orderkey >> {3 * b + d}) & 1) << {b})" for b in range(21)) for d in range(3)]
POINTS = [f"(({c} % 16 + 0.5::double) / 16)" for c in ("l_partkey", "l_suppkey", "l_orderkey")]
GIVE = "(1 * (max(abs(c)) filter (j & 1 != 0) <= 0.06 + 1e-12)::int + 2 * (max(abs(c)) filter (j & 2 != 0) <= 0.06 + 1e-12)::int + 4 * (max(abs(c)) filter (j & 4 != 0) <= 0.06 + 1e-12)::int)"
PART = "coalesce(sum(abs(c)) filter (j & {b} != 0), 0) * (max(abs(c)) filter (j & {b} != 0) <= 0.06 + 1e-12)::int"
PLAN = DETAIL + f""", plan as (select tree_id, path, case when max(abs(c)) <= 0.06 + 1e-12 then 7 else {GIVE} end as give,
  case when max(abs(c)) <= 0.06 + 1e-12 then sum(abs(c)) else {" + ".join(PART.format(b=b) for b in (1, 2, 4))} end / 8 as discarded from low group by all)"""
WHATIF = "with " + vectors(3) + ", " + forward(3, 2) + """, need as (select tree_id, path, sum(abs(c)) / case when path = '' then 1.0 else 0.125 end as need from coef where j > 0 group by tree_id, path),
 goes as (select tree_id, path, case when path = '' then max(need) over (partition by tree_id) else need end as f from need),
 t as (select unnest([0.0, 0.01, 0.05, 1.0, 4.0])::double as threshold),
 got as (select tree_id, threshold, bool_or(path = '' and f <= threshold + 1e-12) as all_, count(*) filter (path != '' and f <= threshold + 1e-12) as kids, count(*) filter (f <= threshold + 1e-12) as coarsenable from goes, t group by all)
select tree_id, threshold, case when all_ then 1 else kids + 8 * (8 - kids) end::bigint as boxes, (9 - coarsenable)::bigint as inner_nodes, coarsenable from got"""

ORACLE_SQL: dict[str, str] = {
    "haar2d_lineitem": f"with {RASTER_LEAF}, {forward(2, 2)} select tree_id, path, j, {r6('c')} as c from coef",
    "haar1d_embeddings": f"with {vectors(1)}, {forward(1, 6)} select tree_id, path, j, {r6('c')} as c from coef",
    "haar3d_embeddings": f"with {vectors(3)}, {forward(3, 2)} select tree_id, path, j, {r6('c')} as c from coef",
    "inverse_haar_roundtrip": f"with {vectors(3)} select tree_id, path, {r6('v')} as value from leaf",
    "node_means": f"with {vectors(2)}, {forward(2, 3)} select tree_id, path, {r6('c')} as mean from coef where j = 0",
    "morton_encode": f"select l_orderkey, l_linenumber, ({MORTON})::bigint as m from lineitem",
    "morton_decode": f"select o_orderkey, ({UNMORTON[0]})::bigint as x, ({UNMORTON[1]})::bigint as y, ({UNMORTON[2]})::bigint as z from orders",
    "bit_index_sets": f"""with {TREE}, refs as (select distinct ref::int as ref from (select 7 as ref from tree where path != '' union all select n_nationkey % 8 from nation) where ref > 0),
 d as (select ref, unnest(range(0, 3))::int as dim from refs), m as (select ref, dim, (1 << bit_count(ref & ((1 << dim) - 1)))::int as own_index, (1 << bit_count(ref))::int as n from d where (ref >> dim) & 1 = 1)
 select ref, dim, own_index, string_agg(j::varchar, ',' order by j) as indexes from (select *, unnest(range(0, n))::int as j from m) where j & own_index != 0 group by ref, dim, own_index""",
    "tree_levels": f"with {TREE} select tree_id, path, " + ", ".join(f"length(path)::int as level_{c}, {index(d)} as index_{c}" for d, c in enumerate("xyz")) + " from tree",
    "box_volumes": f"with {TREE} select tree_id, length(path)::int as depth, count(*) as boxes, {r6('sum(pow(2.0, -3 * length(path)))')} as volume from tree group by all",
    "preorder_ordinals": f"""with {TREE}, a as (select node.tree_id, node.path, tree.v is not null as leaf from node left join tree using (tree_id, path))
 select tree_id, path, (row_number() over w - 1)::int as node_no, case when leaf then (sum(leaf::int) over w - 1)::bigint end as box_no from a window w as (partition by tree_id order by path)""",
    "subtree_ranges": f"with {TREE} select tree_id, substr(path, 1, k) as path, count(*) as nodes from (select tree_id, path, unnest(range(0, length(path) + 1))::int as k from node) group by all",
    "ancestry": f"""with {TREE} select node.tree_id, substr(node.path, 1, length(node.path) - 1) as path, count(*) as children, count(tree.v) as leaf_children
 from node left join tree using (tree_id, path) where node.path != '' group by all""",
    "adaptive_build_events": f"with {TREE} select tree_id, path, v as value from tree",
    "ref_histogram": f"with {TREE} select 7 as ref, count(*) as n from node anti join tree using (tree_id, path) having count(*) > 0",
    "descriptor_stats": f"""with {TREE}, a as (select tree_id, count(*) as nodes, count(tree.v) as boxes from node left join tree using (tree_id, path) group by tree_id)
 select tree_id, boxes, nodes, nodes * 3 as topo_bits, case when nodes > boxes then '{{"7":' || (nodes - boxes) || '}}' else '{{}}' end as ref_counts from a""",
    "descriptor_files": f"""with {TREE}, b as (select node.tree_id, string_agg(case when tree.v is null then '111' else '000' end, '' order by path) as bits from node left join tree using (tree_id, path) group by node.tree_id),
 p as (select tree_id, length(bits) as n_bits, rpad(bits, (ceil(length(bits) / 8.0) * 8)::int, '0') as bits from b),
 h as (select tree_id, n_bits, unnest(range(0, length(bits), 4)) as i, bits from p)
 select tree_id, n_bits, string_agg(lower(hex(8 * substr(bits, i::int + 1, 1)::int + 4 * substr(bits, i::int + 2, 1)::int + 2 * substr(bits, i::int + 3, 1)::int + substr(bits, i::int + 4, 1)::int)), '' order by i) as descriptor from h group by tree_id, n_bits""",
    "descriptor_roundtrip": f"with {TREE} select tree_id, path from tree",
    "coarsen_round_full": DETAIL + f""", go as (select tree_id, path from low group by all having max(abs(c)) <= 0.06 + 1e-12)
 select tree_id, path, {r6('c')} as value from coef semi join go using (tree_id, path) where j = 0 union all
 select leaf.tree_id, leaf.path, {r6('leaf.v')} from leaf left join go on go.tree_id = leaf.tree_id and go.path = substr(leaf.path, 1, 1) where go.tree_id is null""",
    "coarsen_round_partial": PLAN + f" select tree_id, path, give::int as give, {r6('discarded')} as discarded from plan where give > 0",
    "coarsen_bounds": DETAIL + """, b as (select 'flat' as bound, max(abs(c)) <= 0.05 + 1e-12 as go from low group by tree_id, path union all
 select 'per_volume', max(abs(c)) <= 0.05 / 0.125 + 1e-12 from low group by tree_id, path union all select 'sum_volume', sum(abs(c)) <= 0.05 * 0.125 + 1e-12 from low group by tree_id, path)
 select bound, count(*) filter (go) as nodes from b group by bound""",
    "discarded_l1": PLAN + f" select tree_id, {r6('sum(discarded)')} as discarded from plan group by tree_id",
    "whatif_thresholds": WHATIF,
    "rasterize": f"with {TREE} select tree_id, x, y, z, v as value from cell",
    "sparse_fill": f"with {TREE} select tree_id, x, y, z, v as value from cell where v != 0",
    "occupancy_threshold": f"with {RASTER} select tree_id, (" + " | ".join(f"(((x >> {b}) & 1) << {2 * b}) | (((y >> {b}) & 1) << {2 * b + 1})" for b in range(2)) + ")::bigint as m, v / 2000.0::double >= 0.5 as at_least, v / 2000.0::double > 0.5 as above from cells",
    "analytic_shapes": "select l_returnflag, " + ", ".join(f"count(*) filter ({f}) as {n}" for n, f in inside(*POINTS).items()) + " from lineitem group by l_returnflag",
    "error_norms": f"with {TWO} select grid, {r6('max(abs(a - b))')} as linf_error, {r6('sum(abs(a - b)) / 512')} as l1_error, {r6('sqrt(sum((a - b) * (a - b)) / 512)')} as l2_error, {r6('max(abs(a))')} as linf_sol, {r6('sum(abs(a)) / 512')} as l1_sol, {r6('sqrt(sum(a * a) / 512)')} as l2_sol from pair group by grid",
    "max_error": DETAIL + f""", go as (select tree_id, path from low group by all having max(abs(c)) <= 0.06 + 1e-12), mean as (select tree_id, path, c as m from coef semi join go using (tree_id, path) where j = 0)
 select leaf.tree_id, coalesce(mean.path, leaf.path) as path, {r6('max(abs(coalesce(m, v) - v))')} as max_error from leaf left join mean on mean.tree_id = leaf.tree_id and mean.path = substr(leaf.path, 1, 1) group by all""",
    "grid_compare_outer": f"with {TWO} select grid, count(*) as different, {r6('sum(a - b)')} as missing from pair where a != b group by grid",
    "corner_sample": f"""with {TREE}, c as (select tree_id, path, {", ".join(f"{index(d)} << (3 - length(path)) as {c}" for d, c in enumerate("xyz"))} from tree)
 select c.tree_id, c.path, coalesce(vox.v, 0.0) as value, vox.v is not null as active from c left join vox on vox.grid = c.tree_id and vox.x = c.x and vox.y = c.y and vox.z = c.z""",
    "grid_extent": f"with {VOXELS} select grid, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z, " + ", ".join(f"ceil(log2(greatest(max({c}) + 1 - min({c}), 1)))::int as level_{c}" for c in "xyz") + " from vox group by grid",
    "voxel_topology": """with v as (select distinct l_returnflag as grid, l_partkey as x, l_suppkey as y, l_linenumber::bigint as z from lineitem),
 n as (select grid, 0 as level, 512 as bits, x >> 3 as a, y >> 3 as b, z >> 3 as c, count(*) as k from v group by all union all select grid, 1, 8192, x >> 7, y >> 7, z >> 7, count(*) from v group by all union all select grid, 2, 65536, x >> 12, y >> 12, z >> 12, count(*) from v group by all)
 select grid, level, count(*) as nodes, sum(bits)::bigint as mask_bits, sum(k)::bigint as voxels from n group by grid, level""",
    "masked_layout": f"with {TREE} select tree_id, path, v as value from tree",
    "level_pivot_first": f"with {STATS} select thingi_id, " + ", ".join(f"max(case when level = {x} then ds_bytes end)::double as l{x}" for x in range(1, 8)) + " from stats group by thingi_id having count(ds_bytes) > 0",
    "level_aggregate": f"with {LONG} select level, method, count(*) as n, {r6('avg(value::double)')} as mean, {r6('median(value::double)')} as median from long group by all",
    "extremal_topk": f"""with {STATS}, r as (select level, thingi_id, can_bytes / vdb_bytes::double as ratio from stats where can_bytes > 0 and vdb_bytes > 0),
 k as (select *, row_number() over (partition by level order by ratio, thingi_id) as lo, row_number() over (partition by level order by ratio desc, thingi_id desc) as hi from r)
 select level, thingi_id, {r6('ratio')} as ratio, lo::int as rank, 'smallest' as block from k where lo <= 10 union all select level, thingi_id, {r6('ratio')}, hi::int, 'largest' from k where hi <= 10""",
    "slope_rates": f"""with {LONG}, a as (select method, level, avg(value::double) as mean, median(value::double) as med, count(value) as n from long where value is not null and level >= 2 group by all),
 p as (select method, level as lo, lead(level) over w as hi, n as n_lo, lead(n) over w as n_hi, mean as mean_lo, lead(mean) over w as mean_hi, med as median_lo, lead(med) over w as median_hi from a window w as (partition by method order by level))
 select method, lo, hi, n_lo, n_hi, {r6('mean_lo')} as mean_lo, {r6('mean_hi')} as mean_hi, {r6('median_lo')} as median_lo, {r6('median_hi')} as median_hi,
 case when mean_lo > 0 and mean_hi > 0 then {r6('log2(mean_hi / mean_lo)')} end as rate_mean, case when median_lo > 0 and median_hi > 0 then {r6('log2(median_hi / median_lo)')} end as rate_median from p where hi is not null""",
    "count_distinct_things": f"with {STATS} select level, count(distinct thingi_id) as things from stats where level >= 2 group by level",
    "size_ratios": f"with {STATS} select thingi_id, level, {r6('can_bytes::double / nullif(vdb_bytes, 0)')} as ratio, (can_bytes * 32 + n_rows * 3)::bigint as total_bits from stats",
    "sweep_sorted": f"""with {STATS}, s as (select level / 10.0::double as threshold, sum(can_bytes)::bigint as can, sum(ds_bytes)::bigint as ds from stats group by 1)
 select threshold, 'can' as variant, can as total_bytes from s union all select threshold, 'ds', ds from s order by 1 desc, 2""",
    "antijoin_incremental": f"with {STATS} select thingi_id, level, can_bytes from stats where not (level < 4 or thingi_id % 3 = 0)",
    "semijoin_siblings": f"with {STATS} select thingi_id, level from stats where ds_bytes is not null and vdb_bytes is not null",
    "left_coalesce_files": f"with {STATS} select thingi_id, level, case when ds_bytes > 200 then ds_bytes else can_bytes end as bytes from stats",
    "pairwise_equality": f"with {TWO} select side, count(*) as cells from (select 'first' as side, * from (select * from vox except all select * from other) union all select 'second', * from (select * from other except all select * from vox)) group by side",
    "outermost_prefixes": f"""with {TREE}, c as (select tree_id, substr(path, 1, length(path) - 1) as path, count(*) as leaves from tree where path != '' group by all having count(*) >= 2)
 select c.tree_id, c.path, c.leaves from c where not exists (select 1 from c q where q.tree_id = c.tree_id and length(q.path) < length(c.path) and c.path like q.path || '%')""",
    "zorder_concat": f"""with {TREE} select tree_id // 16 as tree_id, ((((tree_id % 4) >> 1) & 1) + 2 * (((tree_id // 4 % 4) >> 1) & 1))::varchar || (((tree_id % 4) & 1) + 2 * ((tree_id // 4 % 4) & 1))::varchar || path as path, v as value from tree""",
    "slice_i_of_n": "select c_custkey, rn as row from (select c_custkey, row_number() over (order by c_custkey) - 1 as rn, count(*) over () as n from customer) where rn >= round_even(3 * n / 7.0, 0) and rn < round_even(4 * n / 7.0, 0)",
    "partition_layout": f"with {VOXELS} select grid, x >> 1 as px, y >> 2 as py, z >> 2 as pz, (x >> 1) * 2 as ox, (y >> 2) * 4 as oy, (z >> 2) * 4 as oz, count(*) as voxels, sum(v) as total from vox group by all",
    "jsonlines_parse": f"select event_type, props->>'$.k' as k, count(*) as n, {r6('sum(value)')} as total from events group by all",
    "regexp_discover": "select regexp_extract(url, '^https?://([^/]+)', 1) as host, count(*) as pages, count(distinct regexp_extract(url, '([0-9]+)', 1)) as numbers from pages group by 1",
}
