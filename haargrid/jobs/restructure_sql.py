"""SQL of coarsening, pushing down and normalising whole forests, a table for each stage of each round.

A leaf is (t, tree_id, path, refs, v): the threshold, and paths and refinements as strings of digits. Rounds are
written out, so a fixpoint needs their number; a tree that isn't done after them would show as a difference.
Steps of a leaf are rows here, and paths are put together again by their order.
"""

from __future__ import annotations

from haargrid.jobs.oracle import r6, vectors

ZERO = "1e-12"


def _each(term: str) -> str:
    return " + ".join("(" + term.format(d=d, b=1 << d) + ")" for d in range(3))


def spread(slot: str, ref: str) -> str:
    return "(" + _each(f"case when {ref} & {{b}} != 0 then (({slot} >> bit_count({ref} & ({{b}} - 1))::int) & 1) << {{d}} else 0 end") + ")"


def packed(bits: str, ref: str) -> str:
    return "(" + _each(f"case when {ref} & {{b}} != 0 then (({bits} >> {{d}}) & 1) << bit_count({ref} & ({{b}} - 1))::int else 0 end") + ")"


def halved(refs: str) -> str:
    """How often a string of refinements halves a box."""
    count = lambda digits: f"(length({refs}) - length(translate({refs}, '{digits}', '')))"
    return f"({count('124')} + 2 * {count('356')} + 3 * {count('7')})"


def table(name: str, text: str) -> str:
    return f"{name} as materialized ({text})"


def coarsened(src: str, out: str, p: str) -> list[str]:
    """A round: out(t, tree_id, path, refs, v, changed), and {p}give with what each family gives up."""
    mask = "(1 << bit_count(ref & ({b} - 1))::int)"
    small = f"max(d) filter (j & {mask} != 0) <= t + {ZERO}"
    return [
        table(f"{p}kid", f"select t, tree_id, path, left(path, length(path) - 1) as up, left(refs, length(refs) - 1) as up_refs, right(refs, 1)::int as ref, right(path, 1)::int as slot, v from {src} where path != ''"),
        table(f"{p}whole", f"select t, tree_id, up, any_value(up_refs) as up_refs, any_value(ref) as ref, count(*)::int as n from {p}kid group by t, tree_id, up having count(*) = 1 << bit_count(any_value(ref))::int"),
        table(f"{p}det", f"select w.t, w.tree_id, w.up, w.up_refs, w.ref, j, abs(sum(case when bit_count(slot & j) % 2 = 0 then v else -v end)) / any_value(n) as d from {p}whole w join {p}kid k using (t, tree_id, up), (select unnest(range(1, 8))::int as j) where j < n group by all"),
        table(
            f"{p}give",
            f"select t, tree_id, up, up_refs, ref, case when max(d) <= t + {ZERO} then ref else {_each(f'case when ref & {{b}} != 0 and {small} then {{b}} else 0 end')} end as give, "
            f"case when max(d) <= t + {ZERO} then sum(d) else {_each(f'case when ref & {{b}} != 0 and {small} then sum(d) filter (j & {mask} != 0) else 0 end')} end * pow(2.0, -{halved('up_refs')}) as discarded from {p}det group by t, tree_id, up, up_refs, ref",
        ),
        table(f"{p}going", f"select t, tree_id, up, give, ref - give as keep from {p}give where give > 0"),
        table(
            out,
            f"select t, tree_id, case when keep = 0 then up else up || {packed(spread('slot', 'ref'), 'keep')}::varchar end as path, case when keep = 0 then up_refs else up_refs || keep::varchar end as refs, avg(v) as v, true as changed from {p}kid join {p}going using (t, tree_id, up) group by all "
            f"union all select t, tree_id, path, up_refs || ref::varchar, v, false from {p}kid anti join {p}going using (t, tree_id, up) union all select t, tree_id, path, refs, v, false from {src} where path = ''",
        ),
    ]


def _steps(src: str, name: str) -> str:
    return table(
        name,
        f"select t, tree_id, path, v, k, left(path, k) as node, ref, {spread('slot', 'ref')} as bits, pow(2.0, -{halved('below')}) as share from "
        f"(select *, substr(refs, k + 1, 1)::int as ref, substr(path, k + 1, 1)::int as slot, substr(refs, k + 1) as below from (select *, unnest(range(0, length(path)))::int as k from {src}))",
    )


def _joined(part: str, src: str) -> str:
    """Leaves of their new steps; a tree of one leaf has none."""
    return (
        f"select t, tree_id, path as was, coalesce(string_agg({packed('new_bits', 'new_ref')}::varchar, '' order by k, sub) filter (new_ref != 0), '') as path, coalesce(string_agg(new_ref::varchar, '' order by k, sub) filter (new_ref != 0), '') as refs, any_value(v) as v "
        f"from {part} group by t, tree_id, path union all select t, tree_id, path, path, refs, v from {src} where path = ''"
    )


def pushed(src: str, out: str, p: str) -> list[str]:
    """out(t, tree_id, was, path, refs, v): every planned node pushed; {p}plan(t, tree_id, node, ref, push)."""
    detail = ", ".join(f"abs(sum(case when bits & {1 << d} != 0 then -v else v end * share)) as d{d}" for d in range(3))
    own = ", ".join(f"case when ref & {1 << d} != 0 then round(d{d}, 12) else 1e300 end as x{d}" for d in range(3))
    return [
        _steps(src, f"{p}step"),
        table(f"{p}node", f"select t, tree_id, node, any_value(ref) as ref, count(*) filter (length(path) = k + 1) as kids, {detail} from {p}step group by t, tree_id, node"),
        table(f"{p}plan", f"select t, tree_id, node, ref, case when bit_count(ref) > 1 and kids > 1 then case when x2 <= x1 and x2 <= x0 then 4 when x1 <= x0 then 2 else 1 end else 0 end as push from (select *, {own} from {p}node)"),
        table(
            f"{p}fused",
            f"select t, tree_id, node, r from (select p.t, p.tree_id, p.node, p.push, {spread('right(c.node, 1)::int', 'p.ref')} & ~p.push as r, c.ref - c.push as new from {p}plan c join {p}plan p on c.t = p.t and c.tree_id = p.tree_id and p.node = left(c.node, length(c.node) - 1) where c.node != '' and p.push > 0) "
            "group by t, tree_id, node, push, r having count(*) = 2 and min(new) = max(new) and min(new) & push = 0",
        ),
        table(f"{p}made", f"select s.*, push, f.r is not null as fuse from {p}step s join {p}plan using (t, tree_id, node) left join {p}fused f on f.t = s.t and f.tree_id = s.tree_id and f.node = s.node and f.r = s.bits & ~push"),
        table(f"{p}carry", f"select *, coalesce(lag(case when fuse then push else 0 end) over w, 0) as dim, coalesce(lag(case when fuse then bits & push else 0 end) over w, 0) as bit from {p}made window w as (partition by t, tree_id, path order by k)"),
        table(f"{p}part", f"select t, tree_id, path, v, k, 0 as sub, (ref & ~push) | dim as new_ref, (bits & ~push) | bit as new_bits from {p}carry union all select t, tree_id, path, v, k, 1, push, bits & push from {p}carry where push > 0 and not fuse"),
        table(out, _joined(f"{p}part", src)),
    ]


def normalized(src: str, out: str, p: str) -> list[str]:
    """A round of taking over: out(t, tree_id, was, path, refs, v)."""
    return [
        _steps(src, f"{p}step"),
        table(f"{p}inner", f"select t, tree_id, node, any_value(ref) as ref from {p}step group by t, tree_id, node"),
        table(
            f"{p}take",
            f"select t, tree_id, node, common & ~ref as take from {p}inner join (select t, tree_id, left(node, length(node) - 1) as node, count(*) as n, bit_and(ref) as common from {p}inner where node != '' group by 1, 2, 3) using (t, tree_id, node) where n = 1 << bit_count(ref)::int and common & ~ref != 0",
        ),
        table(f"{p}both", f"select s.*, coalesce(take, 0) as take, coalesce(lag(take) over w, 0) as taken, coalesce(lead(bits) over w, 0) as below from {p}step s left join {p}take using (t, tree_id, node) window w as (partition by t, tree_id, path order by k)"),
        table(f"{p}part", f"select t, tree_id, path, v, k, 0 as sub, (ref & ~taken) | take as new_ref, (bits & ~taken) | (below & take) as new_bits from {p}both"),
        table(out, _joined(f"{p}part", src)),
    ]


def normal_form(src: str, out: str, p: str, rounds: int) -> list[str]:
    parts = []
    for i in range(rounds):
        parts += normalized(src if i == 0 else f"{p}{i}", out if i + 1 == rounds else f"{p}{i + 1}", f"{p}{i}_")
    return parts


def canonical(src: str, out: str, p: str, rounds: int = 2) -> list[str]:
    """Rounds of coarsening, with {out}_lost(t, tree_id, discarded)."""
    parts = []
    for i in range(rounds):
        parts += coarsened(src if i == 0 else f"{p}{i}", out if i + 1 == rounds else f"{p}{i + 1}", f"{p}{i}_")
    lost = " union all ".join(f"select t, tree_id, discarded from {p}{i}_give where give > 0" for i in range(rounds))
    return [*parts, table(f"{out}_lost", f"select t, tree_id, sum(discarded) as discarded from ({lost}) group by t, tree_id")]


def downsplit(src: str, out: str, p: str, rounds: int = 6, normal: int = 3) -> list[str]:
    """out(t, tree_id, path, refs, v): pushes, a coarsening round and the normal form, until nothing is coarsened; {out}_lost as above."""
    parts, now, done, plain = [], src, [], []
    for i in range(rounds):
        q = f"{p}{i}"
        parts += [*pushed(now, f"{q}p", f"{q}p_"), *coarsened(f"{q}p", f"{q}c", f"{q}c_")]
        parts.append(table(f"{q}go", f"select distinct t, tree_id from {q}c where changed"))
        parts.append(table(f"{q}did", f"select distinct t, tree_id from {q}p_plan where push > 0"))
        done.append(f"select t, tree_id, path, refs, v from {now} anti join {q}go using (t, tree_id) semi join {q}did using (t, tree_id)")
        plain.append(f"select t, tree_id, path, refs, v from {now} anti join {q}go using (t, tree_id) anti join {q}did using (t, tree_id)")
        parts.append(table(f"{q}g", f"select t, tree_id, path, refs, v from {q}c semi join {q}go using (t, tree_id)"))
        parts += normal_form(f"{q}g", f"{q}n", f"{q}n_", normal)
        now = f"{q}n"
    lost = " union all ".join(f"select t, tree_id, discarded from {p}{i}c_give where give > 0" for i in range(rounds))
    parts.append(table(f"{p}plain", " union all ".join(plain)))
    parts += normal_form(f"{p}plain", f"{p}tidy", f"{p}tidy_", normal)
    parts.append(table(out, " union all ".join([*done, f"select t, tree_id, path, refs, v from {p}tidy", f"select t, tree_id, path, refs, v from {now}"])))
    return [*parts, table(f"{out}_lost", f"select t, tree_id, sum(discarded) as discarded from ({lost}) group by t, tree_id")]


# queries over the vectors' trees in three dimensions


def trees(thresholds: str, refs: str = "'77'") -> str:
    """full(t, tree_id, path, refs, v) of the vectors, for each threshold."""
    return f"{vectors(3)}, {table('full_', f'select t, tree_id, path, {refs} as refs, v from leaf, (select unnest([{thresholds}])::double as t)')}"


def placed(src: str, out: str, p: str) -> list[str]:
    """out(t, tree_id, path, v, i): the numbers of the cells in each leaf, of 4 x 4 x 4."""
    later = ", ".join(f"coalesce(sum((ref >> {d}) & 1) over (partition by t, tree_id, path order by k desc rows between unbounded preceding and 1 preceding), 0)::int as later{d}" for d in range(3))
    own = ", ".join(f"sum((ref >> {d}) & 1)::int as n{d}, sum(((bits >> {d}) & 1) << later{d})::int as i{d}" for d in range(3))
    none = ", ".join(f"0 as n{d}, 0 as i{d}" for d in range(3))
    number = " + ".join(f"(((i{d} << (2 - n{d})) + q{d}.q) << {2 * d})" for d in range(3))
    joins = " ".join(f"join {p}range q{d} on q{d}.q < (4 >> n{d})" for d in range(3))
    return [
        _steps(src, f"{p}step"),
        table(f"{p}place", f"select t, tree_id, path, any_value(v) as v, {own} from (select *, {later} from {p}step) group by t, tree_id, path union all select t, tree_id, path, v, {none} from {src} where path = ''"),
        table(f"{p}range", "select unnest(range(0, 4))::int as q"),
        table(out, f"select t, tree_id, path, v, {number} as i from {p}place {joins}"),
    ]


def counted(src: str, out: str) -> list[str]:
    """out(t, tree_id, boxes, inner_, ref_counts, nonbg) of each tree."""
    return [
        table(f"{out}_inner", f"select distinct t, tree_id, left(path, k) as node, substr(refs, k + 1, 1) as ref from (select *, unnest(range(0, length(path)))::int as k from {src})"),
        table(f"{out}_refs", f"select t, tree_id, sum(n)::bigint as inner_, '{{' || string_agg('\"' || ref || '\":' || n, ',' order by ref) || '}}' as ref_counts from (select t, tree_id, ref, count(*) as n from {out}_inner group by all) group by t, tree_id"),
        table(out, f"select t, tree_id, boxes, coalesce(inner_, 0) as inner_, coalesce(ref_counts, '{{}}') as ref_counts, nonbg from (select t, tree_id, count(*) as boxes, count(*) filter (v != 0) as nonbg from {src} group by t, tree_id) left join {out}_refs using (t, tree_id)"),
    ]


def errors(src: str, out: str) -> list[str]:
    """out(t, ...): norms of what each cell of the vectors differs from its leaf, and of the leaves."""
    e = "abs(c.v - emb.v)"
    return [
        *placed(src, f"{out}_cell", f"{out}_"),
        table(out, f"select t, count(*) as cells, max({e}) as a, avg({e}) as b, sqrt(avg({e} * {e})) as c, max(abs(c.v)) as d, avg(abs(c.v)) as e, sqrt(avg(c.v * c.v)) as f from {out}_cell c join emb on emb.tree_id = c.tree_id and emb.i = c.i group by t"),
    ]


def both(thresholds: str) -> str:
    """Canonical and restructured trees, their sizes and norms."""
    parts = [*canonical("full_", "can", "a"), *downsplit("can", "ds", "b")]
    for v in ("can", "ds"):
        parts += [*counted(v, f"{v}_size"), *errors(v, f"{v}_err")]
    total = lambda v: f"select t, '{v}' as variant, sum(boxes + inner_)::bigint as nodes, sum(boxes)::bigint as boxes, sum(nonbg)::bigint as nonbg, sum(ceil((boxes + inner_) * 3 / 8.0)::bigint)::bigint as desc_bytes from {v}_size group by t"
    return f"with {trees(thresholds)}, {', '.join(parts)}, {table('total', ' union all '.join(map(total, ('can', 'ds'))))}, err as (select 'can' as variant, * from can_err union all select 'ds', * from ds_err)"


def one(*parts: str) -> str:
    return f"with {trees('0.06')}, " + ", ".join([*canonical("full_", "can", "a"), *parts])


def leaf_rows(src: str, more: str = "") -> str:
    return f" select tree_id, path, refs, {r6('v')} as value{more} from {src}"


def summed(src: str) -> str:
    return f" select s.tree_id, count(*) as boxes, {r6('coalesce(any_value(discarded), 0)')} as discarded, {r6(f'sum(v * pow(2.0, -{halved("refs")}))')} as mean from {src} s left join {src}_lost l on l.tree_id = s.tree_id group by s.tree_id"


def cascade(thresholds: list[float]) -> str:
    parts, now = [], "full_"
    for k, t in enumerate(thresholds):
        parts += [table(f"from{k}", f"select {t}::double as t, tree_id, path, refs, v from {now}"), *canonical(f"from{k}", f"to{k}", f"c{k}_", 3)]
        now = f"to{k}"
    return f"with {trees('0.0')}, {', '.join(parts)} " + " union all ".join(f"select tree_id, {t}::double as threshold, count(*) as boxes from to{k} group by tree_id" for k, t in enumerate(thresholds))


#: Trees below the first step as trees of their own, restructured, and composed again.
PARTS = [
    table("part", "select t, tree_id || '/' || left(path, 1) as tree_id, substr(path, 2) as path, substr(refs, 2) as refs, v from can where path != ''"),
    *downsplit("part", "done", "b"),
    table("top", "select distinct tree_id, left(refs, 1) as ref from can where path != ''"),
    table("whole", "select t, d.id as tree_id, slot || path as path, ref || refs as refs, v from (select *, split_part(tree_id, '/', 1)::bigint as id, split_part(tree_id, '/', 2) as slot from done) d join top on top.tree_id = d.id union all select t, tree_id, path, refs, v from can where path = ''"),
    *canonical("whole", "seamless", "c", 4),
]
_LEVELS = table("full_", "select 0.06::double as t, tree_id * 8 + level as tree_id, left(path, level) as path, repeat('7', level) as refs, avg(v) as v from leaf, (select unnest([1, 2])::int as level) group by all")
_COLUMNS = "{v}.boxes + {v}.inner_ as {v}_nodes, {v}.boxes as {v}_boxes, ({v}.boxes + {v}.inner_) * 3 as {v}_topo_bits, {v}.ref_counts as {v}_ref_counts, ceil(({v}.boxes + {v}.inner_) * 3 / 8.0)::bigint + ceil({v}.boxes / 8.0)::bigint as {v}_raw_total_bytes, null::double as {v}_blosc2_total_bytes, ceil(({v}.boxes + {v}.inner_) * 3 / 8.0)::bigint as {v}_desc_raw_bytes, null::double as {v}_desc_blosc2_bytes, ceil({v}.boxes / 8.0)::bigint as {v}_coeffs_raw_bytes, null::double as {v}_coeffs_blosc2_bytes"
STATS_ROWS = (
    f"with {vectors(3)}, {_LEVELS}, " + ", ".join([*canonical("full_", "can_", "a"), *downsplit("can_", "ds_", "b"), *counted("can_", "can"), *counted("ds_", "ds")])
    + ", m as (select *, (512 + 73728)::bigint as masks, (8 ** level)::bigint as active from (select *, (can.tree_id % 8)::int as level from can)) select m.tree_id // 8 as thingi_id, level, "
    + _COLUMNS.format(v="m").replace("as m_", "as can_") + ", " + _COLUMNS.format(v="ds")
    + ", masks as vdb_topo_bits, ceil(masks / 8.0)::bigint as vdb_topo_bytes, active as vdb_active_leaf_voxels, 512::bigint as vdb_dense_value_bits, active as vdb_active_value_bits, active as vdb_active_leaf, 512 - active as vdb_inactive_leaf, 0::bigint as vdb_active_tiles, active as vdb_total_leaf_coefficients, active as vdb_total_coefficients, ceil((masks + 512) / 8.0)::bigint as vdb_file_bytes from m join ds on ds.tree_id = m.tree_id"
)
THREE_THRESHOLDS = "0.0, 0.06, 0.1"

ORACLE_SQL: dict[str, str] = {
    "canonical_fixpoint": one() + f" select can.tree_id, count(*) as boxes, {r6('coalesce(any_value(discarded), 0)')} as discarded from can left join can_lost using (tree_id) group by can.tree_id",
    "threshold_cascade": cascade([0.01, 0.05, 0.2]),
    "push_down_round": one(*pushed("can", "down", "b")) + leaf_rows("down", ", was"),
    "normalize": one(*pushed("can", "down", "b"), table("plain", "select t, tree_id, path, refs, v from down"), *normal_form("plain", "out_", "c", 4)) + leaf_rows("out_"),
    "downsplit_leaves": one(*downsplit("can", "ds", "b")) + leaf_rows("ds"),
    "downsplit_compress": one(*downsplit("can", "ds", "b")) + summed("ds"),
    "downsplit_lineage": one(*downsplit("can", "ds", "b"), *placed("can", "old_cell", "c"), *placed("ds", "new_cell", "d"))
    + " select o.tree_id, o.path as origin, n.path, count(*) / any_value(n.size)::double as share from old_cell o join (select *, count(*) over (partition by tree_id, path) as size from new_cell) n on n.tree_id = o.tree_id and n.i = o.i group by o.tree_id, o.path, n.path",
    "partitioned_compress": one(*PARTS) + " select tree_id, count(*) as boxes from seamless group by tree_id",
    "resume_parts": one() + " select tree_id, left(path, 1) as part, count(*) as leaves from can where (tree_id + coalesce(try_cast(left(path, 1) as int), 0)) % 4 >= 2 group by all",
    "resumed_compress": one(*PARTS) + leaf_rows("seamless"),
    "compare_thresholds": both(THREE_THRESHOLDS)
    + f""", count_ as (select count(distinct tree_id) as n, count(*) as cells from leaf),
 r as (select t, variant, nodes, boxes, a as e, cells from total join err using (t, variant) union all select t, 'given', 73 * n, 64 * n, 0.0, cells from (select distinct t from full_), count_ union all select t, 'dense', 0, cells, 0.0, cells from (select distinct t from full_), count_)
 select t as threshold, variant, nodes::bigint as nodes, boxes::bigint as boxes, (nodes * 3)::bigint as topo_bits, (boxes * 32)::bigint as coeff_bits, (nodes * 3 + boxes * 32)::bigint as total_bits, {r6('(nodes * 3 + boxes * 32) / (cells * 32.0::double)')} as ratio_to_dense, {r6('e')} as max_error from r""",
    "sweep_rows": both(THREE_THRESHOLDS)
    + f""", orig as (select sum(ceil((512 + 73728 + 512 * 32) / 8.0)::bigint)::bigint as file_bytes, sum(512 + 73728)::bigint as topo_bits, sum(active)::bigint as active from (select tree_id, count(*) as active from emb where v != 0 group by tree_id))
 select t as threshold, variant, nodes, boxes, nodes * 3 as topo_bits, boxes as n_leaves, nonbg as n_nonbg_leaves, {r6('a')} as "Linf_error", {r6('b')} as "L1_error", {r6('c')} as "L2_error", {r6('d')} as "Linf_sol", {r6('e')} as "L1_sol", {r6('f')} as "L2_sol",
 desc_bytes as desc_raw_bytes, 4 * boxes as values_raw_bytes, desc_bytes + 4 * boxes as raw_total_bytes, null::double as desc_blosc2_bytes, null::double as values_blosc2_bytes, null::double as blosc2_total_bytes,
 file_bytes as vdb_orig_file_bytes, topo_bits as vdb_orig_topo_bits, active as vdb_orig_active_voxels, active as vdb_orig_total_coefficients, null::bigint as vdb_recon_file_bytes, {r6('(desc_bytes + 4 * boxes) / file_bytes::double')} as ratio_raw_vs_vdb, null::double as ratio_blosc2_vs_vdb
 from total join err using (t, variant), orig""",
    "stats_rows": STATS_ROWS,
}
