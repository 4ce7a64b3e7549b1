"""SQL for the queries of images: trees whose sides have unequal levels, compressed round by round."""

from __future__ import annotations

from haargrid.jobs.restructure_sql import canonical, placed, table

CELLS = """lit as (select l_suppkey as tree_id, l_linenumber - 1 as x, l_partkey % (l_suppkey % 9 + 5) as y, sum(l_quantity)::bigint % 65536 as n from lineitem group by all),
extent as (select tree_id, max(x) + 1 as height, max(y) + 1 as width from lit group by tree_id),
cell as materialized (select tree_id, a.x::bigint as x, b.y::bigint as y, coalesce(n, 0) / 65535.0::double as v, height, width, floor(log2(height))::int as lx, floor(log2(width))::int as ly from extent join (select unnest(range(0, 7)) as x) a on a.x < height join (select unnest(range(0, 13)) as y) b on b.y < width left join lit using (tree_id, x, y))"""


def step(k: int, what: str) -> str:
    """Digit k of a cell's path or refinements."""
    rx, ry = f"(lx > {k})", f"(ly > {k})"
    bit = lambda c: f"((({c} >> greatest(l{c} - 1 - {k}, 0)) & 1) * {rx if c == 'x' else ry}::int)"
    own = f"{bit('x')} + ({bit('y')} << {rx}::int)" if what == "path" else f"{rx}::int + 2 * {ry}::int"
    return f"case when {k} < greatest(lx, ly) then ({own})::varchar else '' end"


FULL = table("full_", "select 0.0005::double as t, tree_id, " + ", ".join(" || ".join(step(k, w) for k in range(4)) + f" as {w}" for w in ("path", "refs")) + ", v from cell where x < 1 << lx and y < 1 << ly")
TREES = f"with {CELLS}, {FULL}, " + ", ".join(canonical("full_", "can", "a", 6))
PLACE = placed("can", "unused", "p")[:2]
AFTER = table("after_", "select c.tree_id, c.x, c.y, c.v as a, p.v as b from cell c join pplace p on p.tree_id = c.tree_id and c.x >> (lx - n0) = i0 and c.y >> (ly - n1) = i1 where c.x < 1 << lx and c.y < 1 << ly")


def _size(src: str, name: str) -> str:
    return f"(select tree_id, count(*) as boxes_{name}, any_value(nodes) as nodes_{name} from {src} join (select tree_id, count(*) as nodes from (select distinct tree_id, left(path, k) from (select *, unnest(range(0, length(path) + 1))::int as k from {src})) group by tree_id) using (tree_id) group by tree_id)"


ORACLE_SQL: dict[str, str] = {
    "tiff_cells": f"with {CELLS} select tree_id, x, y, round(v, 9) as value from cell",
    "image_compress": TREES + ", " + ", ".join([*PLACE, AFTER]) + f" select tree_id, boxes_before, boxes_after, nodes_before, nodes_after, max_difference, mean_difference from {_size('full_', 'before')} join {_size('can', 'after')} using (tree_id) join (select tree_id, round(max(abs(a - b)), 9) as max_difference, round(avg(a - b), 9) + 0.0 as mean_difference from after_ group by tree_id) using (tree_id)",
    "image_resample": TREES + ", " + ", ".join([*PLACE, AFTER]) + " select tree_id, x >> 1 as x, y >> 1 as y, round(avg(b), 9) as value from after_ group by all",
}
