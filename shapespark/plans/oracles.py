"""DuckDB SQL of the catalog's queries, where SQL can say them."""

from __future__ import annotations

from .views import KINDS, POINTS, SEGMENTS

N = POINTS
_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
TREES = f"""tr as (select user_id::varchar cell_id, n node_id, list_position({_KINDS}, event_type)::int structure_id, value x, (props::json->>'$.k')::double y,
  hour(ts) + minute(ts) / 60.0::double z, case when n = 1 then -1 else n // 2 end parent_id from (select *, row_number() over (partition by user_id order by ts, event_id) n from events))"""
KEPT = f"""{TREES}, kept as (select * from tr where structure_id in (1, 2, 3)),
  f as (select k.* exclude (parent_id), case when p.node_id is null then -1 else k.parent_id end parent_id from kept k left join kept p on k.cell_id = p.cell_id and k.parent_id = p.node_id)"""


def walk(t: str) -> str:
    """Depth, root and path length of the nodes of t."""
    return f"""w as (select cell_id, node_id, node_id root_id, 0 depth, 0.0::double dist_root, 0.0::double edge, [node_id] path from {t} where parent_id = -1
      union all select c.cell_id, c.node_id, w.root_id, w.depth + 1, w.dist_root + sqrt((c.x - p.x)^2 + (c.y - p.y)^2 + (c.z - p.z)^2), sqrt((c.x - p.x)^2 + (c.y - p.y)^2 + (c.z - p.z)^2), list_append(w.path, c.node_id)
      from w join {t} c on c.cell_id = w.cell_id and c.parent_id = w.node_id join {t} p on p.cell_id = w.cell_id and p.node_id = w.node_id)"""


RANKED = """sized as (select cell_id, root_id, count(*) size from w group by 1, 2),
  ranks as (select cell_id, root_id, size, (row_number() over (partition by cell_id order by size desc, root_id) - 1)::int component_rank from sized),
  pos as materialized (select w.*, component_rank, row_number() over (partition by w.cell_id order by component_rank, depth, w.node_id) as position from w join ranks using (cell_id, root_id))"""
VEC = "v as (select lpad(vec_id::varchar, 8, '0') id, label, list_transform(embedding, lambda x: x::double) vector from embeddings)"
ENTRIES = f"""{VEC}, ij as (select i, j from (select unnest(range({N})) i), (select unnest(range({N})) j) where i < j),
  ent as (select id, label, i, j, {N} * i - (i * (i + 1)) // 2 + j - i - 1 k, sqrt((vector[4*i+1] - vector[4*j+1])^2 + (vector[4*i+2] - vector[4*j+2])^2 + (vector[4*i+3] - vector[4*j+3])^2 + (vector[4*i+4] - vector[4*j+4])^2) d from v, ij),
  sorted as (select id, any_value(label) label, list(d order by d) ds from ent group by id)"""


def bounds(where: str) -> str:
    return f"""b0 as (select a.id first, b.id as second, round(0.5 * sqrt(2 * list_sum(list_transform(range(1, {N * (N - 1) // 2 + 1}), lambda k: (a.ds[k] - b.ds[k])^2)) / {N * N}), 6) dist, a.label from sorted a join sorted b on a.id < b.id {where})"""


CLASS = f"{ENTRIES}, {bounds('and a.label = b.label')}"
BOTH = "both_ as (select first, second, dist from b0 union all select second, first, dist from b0)"
RANK = "near as (select *, row_number() over (partition by first order by dist, second) r from both_)"
STEPS = f"""{ENTRIES}, q0 as (select id, k, d as value, 2 * (i + 1) * (j + 1) * (2.0 / {N * (N + 1)})^2 w from ent
  union all select id, -1, 0.0, (select sum(((g + 1) * 2.0 / {N * (N + 1)})^2) from (select unnest(range({N})) g)) from v),
  st as (select id, value, hi - w lo, hi from (select *, sum(w) over (partition by id order by value, k rows unbounded preceding) hi from q0))"""
EDGES = "edges as (select [quantile_cont(dist, 0.2), quantile_cont(dist, 0.4), quantile_cont(dist, 0.6), quantile_cont(dist, 0.8)] e from b0), bn as (select b0.*, len(list_filter(e, lambda t: t < dist))::int bin from b0, edges)"
KNOWN = f"{CLASS}, {EDGES}, hk as (select first, second, bin, dist slb, case when first[-1:] < '5' then round(1.5 * dist + second[-2:]::double / 1000 + 1e-9, 6) end d from bn)"
DISCS = """px as (select (p_partkey // 10)::int::varchar image_id, r::int r, (t + 20 * (p_partkey % 10))::int c, case when 25 * ((r - 10)^2 + (t - 10)^2) <= p_size * p_size then p_partkey + 1 else 0 end::int as label,
  case when 25 * ((r - 10)^2 + (t - 10)^2) <= p_size * p_size then r + 0.5 * t else 0.0 end::double signal from part, (select unnest(range(20)) r), (select unnest(range(20)) t))"""
TURNED = f"""{ENTRIES}, sq as (select id, i, j, d from ent union all select id, j, i, d from ent union all select id, g, g, 0.0 from v, (select unnest(range({N})) g)),
  c0 as (select min(id) c from v), ori as (select id cell_id, case when id = c then i else (i + {N} - 1) % {N} end i, case when id = c then j else (j + {N} - 1) % {N} end j, d from sq, c0)"""


# Spaces of nations: matrices as lists of lists, and all permutations of their points.
M = len(SEGMENTS)
_EACH = f"range(1, {M + 1})"
_SEGMENTS = "[" + ", ".join(f"'{x}'" for x in SEGMENTS) + "]"


def _sum(over: str, body: str) -> str:
    """The sum of body over 1 to M of a variable."""
    return f"list_sum(list_transform({_EACH}, lambda {over}: {body}))"


NATIONS = f"""seg as (select unnest({_SEGMENTS}) s, unnest(range({M})) k), held as (select c_nationkey, c_mktsegment, avg(c_acctbal) balance, count(*) customers from customer group by 1, 2),
  pt as (select lpad(n_nationkey::varchar, 3, '0') id, k, coalesce(balance / 1000, 0) x, coalesce(customers / 4, 0) y, k::double z from nation cross join seg left join held on c_nationkey = n_nationkey and c_mktsegment = s),
  dd as (select a.id, a.k i, b.k j, sqrt((a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2) d from pt a join pt b using (id)),
  sp as (select id, list(r order by i) m from (select id, i, list(d order by j) r from dd group by id, i) group by id),
  sq as (select id, m, {_sum("i", _sum("j", "m[i][j]^2"))} / {M * M} size, list_transform(m, lambda r: list_sum(r) / {M}) reach from sp),
  perms as (select [{", ".join(f"p{i}" for i in range(M))}] p from {", ".join(f"(select unnest({_EACH}) p{i})" for i in range(M))} where len(list_distinct([{", ".join(f"p{i}" for i in range(M))}])) = {M})"""
#: One descent for each pair: the linearised cost of every permutation, and the cost of the best one.
_CROSS = _sum("i", _sum("k", "s.x[i][k] * s.y[{0}[k]][p[i]]"))
DESCENT = f"""pr as (select a.id first, b.id as second, a.m x, b.m y, a.size + b.size base, a.reach rx, b.reach ry from sq a join sq b on a.id < b.id),
  go as (select first, second, x, y, base, 0 step, base as cost, null::bigint[] plan, false ended, rx, ry from pr
    union all select first, second, x, y, base, step + 1, case when falls then value else cost end, case when falls then new else plan end, not falls, rx, ry
    from (select *, value < cost - 1e-12 * base falls from (select t.* exclude (p), new, base - 2.0 / {M * M} * {_sum("i", _sum("k", "x[i][k] * y[new[k]][new[i]]"))} as value from
      (select s.*, null p, (select arg_min(p, case when s.plan is null then -{_sum("i", "s.rx[i] * s.ry[p[i]]")} else -{_CROSS.format("s.plan")} end) from perms) as new from go s where not ended) t))),
  gw as (select first, second, x, y, sqrt(greatest(cost, 0)) / 2 dist, plan, step - 1 n_iter from go where ended)"""


def fused() -> str:
    """Conditional gradients with the exact line search, at alpha = 0.5, from the product coupling."""
    kinds = "[" + ", ".join(str(k % 3 + 1) for k in range(M)) + "]"
    penalty = f"list_transform({_EACH}, lambda i: list_transform({_EACH}, lambda j: case list_sort([{kinds}[i], {kinds}[j]]) when [1, 3] then 2.0::double when [1, 2] then 0.7::double else 0.0::double end))"
    table = lambda body: f"list_transform({_EACH}, lambda i: list_transform({_EACH}, lambda j: {body}))"
    times = lambda m: table(_sum("k", _sum("l", f"x[i][k] * {m}[k][l] * y[l][j]")))
    dot = lambda a, b: _sum("i", _sum("j", f"{a}[i][j] * {b}[i][j]"))
    return f"""with recursive {NATIONS}, f as (select {penalty} fe),
    st as (select a.id first, b.id as second, a.m x, b.m y, a.size + b.size base, {table(str(1.0 / (M * M)))} p from sq a join sq b on a.id < b.id),
    go as (select *, {times("p")} c, 0 step, false ended from st
      union all select first, second, x, y, base, case when ends then p else {table("p[i][j] + t * mv[i][j]")} end p, case when ends then c else {table("c[i][j] + t * md[i][j]")} end c, step + 1, ends
      from (select *, slope > -1e-9 * greatest(base, 1.0) ends, case when curve > 0 then least(1.0, -slope / (2 * curve)) else 1.0 end t
        from (select *, {dot("g", "mv")} slope, -{dot("md", "mv")} curve from (select *, {times("mv")} md
          from (select *, {table(f"case when new[i] = j then 1.0 / {M} else 0 end - p[i][j]")} mv from (select s.*, (select arg_min(perms.p, {_sum("i", "s.g[i][perms.p[i]]")}) from perms) as new
            from (select go.*, {table("0.5 * fe[i][j] - 2.0 * c[i][j]")} g from go, f where not ended and step < 200) s)))))),
    done as (select first, second, base - 2 * {dot("c", "p")} q, {dot("fe", "p")} l, row_number() over (partition by first, second order by step desc) r from go, f)
    select first, second, round(0.5 * q + 0.5 * l, 6) dist, round(q, 6) gw_cost, round(l, 6) feature_cost from done where r = 1"""


def deformation() -> str:
    cross = _sum("k", "x[i][k] * y[plan[k]][plan[i]]")
    rows = f"{_sum('k', 'x[i][k]^2')} / {M * M} + {_sum('k', 'y[plan[i]][k]^2')} / {M * M} - 2 * {cross} / {M * M}"
    return f"""with recursive {NATIONS}, {DESCENT}, e as (select first, second, i, plan[i] j, {rows} amount from gw, (select unnest({_EACH}) i))
    select first, second, 'first' side, (i - 1)::int i, round(amount, 6) amount from e union all select first, second, 'second', (j - 1)::int, round(amount, 6) from e"""


def nation_bounds() -> str:
    """Step functions of sorted distances, with the weights of their points, met where they overlap."""
    return f"""with {NATIONS}, w as (select id, i, j, d, 2 * (i + 1) * (j + 1) * {(2 / (M * (M + 1))) ** 2!r} w from dd where i < j union all select id, -1, -1, 0.0, sum((k + 1)^2) * {(2 / (M * (M + 1))) ** 2!r} from pt group by id),
    s as (select id, d as value, hi - w lo, hi from (select *, sum(w) over (partition by id order by d, i, j rows unbounded preceding) hi from w))
    select a.id first, b.id as second, round(0.5 * sqrt(sum((a.value - b.value)^2 * (least(a.hi, b.hi) - greatest(a.lo, b.lo)))), 6) slb from s a join s b on a.id < b.id and a.lo < b.hi and b.lo < a.hi group by 1, 2"""


def wnn() -> str:
    half = lambda n: f"select {n} m, id obj, vector[{32 * n + 1}:{32 * n + 32}] x from v"
    dist = "sqrt(list_sum(list_transform(range(1, 33), lambda t: ({0}[t] - {1}[t])^2)))"
    theta = "exp(-greatest({0} - nearest, 0) / (bandwidth - nearest))"
    return f"""with {VEC}, mo as ({half(0)} union all {half(1)}),
    dm as (select a.m, a.obj first, b.obj as second, {dist.format("a.x", "b.x")} d from mo a join mo b on a.m = b.m and a.obj <> b.obj),
    sc as (select m, first obj, avg(d) filter (r <= 20) bandwidth, min(d) nearest from (select *, row_number() over (partition by m, first order by second) r from dm) group by 1, 2),
    nb as (select m source, first obj, second from (select *, row_number() over (partition by m, first order by d, second) r from dm) where r <= 10),
    dims as (select source, t.m as target, nb.obj, k, avg(t.x[k]) g from nb join mo t on t.obj = nb.second, (select unnest(range(1, 33)) k) group by 1, 2, 3, 4),
    guess as (select source, target, obj, list(g order by k) g from dims group by 1, 2, 3),
    af as (select source, target, guess.obj, {theta.format(dist.format("guess.g", "mo.x"))} a from guess join mo on mo.m = target and mo.obj = guess.obj join sc on sc.m = target and sc.obj = guess.obj),
    ra as (select x.source, x.obj, o.a / (x.a + 1e-4) r from af x join af o on o.source = x.source and o.target = x.source and o.obj = x.obj where x.source <> x.target),
    ex as (select source, obj, exp(r - max(r) over (partition by obj)) e from ra),
    we as (select source m, obj, sum(e) / any_value(total) weight from (select *, sum(e) over (partition by obj) total from ex) group by 1, 2)
    select first, second, round(least(1.0, greatest(0.0, sum(weight * {theta.format("d")}))), 6) similarity from dm join sc on sc.m = dm.m and sc.obj = dm.first join we on we.m = dm.m and we.obj = dm.first group by 1, 2"""


def relative() -> str:
    d = lambda lo: f"list_sum(list_transform(range({lo}, {lo + 32}), lambda t: (p.vector[t] - q.vector[t])^2))"
    z = lambda c: f"(ln({c}) - avg(ln({c})) over ()) / stddev_pop(ln({c})) over ()"
    # unrounded bounds, as the query takes them
    exact = CLASS.replace("round(0.5 * sqrt(", "(0.5 * sqrt(").replace(f"/ {N * N}), 6) dist", f"/ {N * N})) dist")
    return f"""with {exact}, t as (select first, second, dist d1, {d(1)} d2, {d(33)} d3 from b0 join v p on p.id = first join v q on q.id = second),
    n as (select first, second, {z("d1")} z1, {z("d2")} z2, {z("d3")} z3 from t), g as (select first, second, z1 - z2 x, z2 - z3 y, z3 - z1 z from n),
    lo as (select quantile_cont(u, 0.01) l from (select unnest([x, y, z]) u from g)), s as (select first, second, x - l x, y - l y, z - l z, l from g, lo),
    hi as (select quantile_cont(u, 0.99) h from (select unnest([x, y, z]) u from s))
    select first, second, round(x / h / (-3 * l / h), 6) x, round(y / h / (-3 * l / h), 6) y, round(z / h / (-3 * l / h), 6) z from s, hi"""


ORACLES = {
    "nation_gw": f"with recursive {NATIONS}, {DESCENT} select first, second, round(dist, 6) dist, true converged, n_iter::int n_iter from gw",
    "nation_gw_query_target": f"with recursive {NATIONS}, {DESCENT} select first, second, round(dist, 6) dist from gw where first < '005' and second >= '005'",
    "nation_gw_wanted": f"with recursive {NATIONS}, {DESCENT} select first, second, round(dist, 6) dist from gw where second::int - first::int <= 2",
    "nation_qgw": f"with recursive {NATIONS}, {DESCENT} select first, second, round(dist, 6) dist, true converged from gw",
    "nation_couplings": f"with recursive {NATIONS}, {DESCENT} select first, second, (unnest({_EACH}) - 1)::int i, (unnest(plan) - 1)::int j, round(1.0 / {M}, 6)::double mass from gw",
    "nation_deformation": deformation(),
    "nation_slb": nation_bounds(),
    "nation_fused_gw": fused(),
    "nation_orders": f"""with {NATIONS}, h as (select lpad(c_nationkey::varchar, 3, '0') id, k, c_mktsegment from customer join seg on s = c_mktsegment), t as (select id, count(*) n from h group by 1),
      c as (select t.id, k, count(h.id) / any_value(n) share from t cross join seg left join h using (id, k) group by 1, 2), cum as (select id, k, sum(share) over (partition by id order by k) f from c)
      select a.id first, b.id as second, round(sum(abs(a.f - b.f)), 6) dist from cum a join cum b on a.id < b.id and a.k = b.k group by 1, 2""",
    "forest_path_lengths": f"""with recursive {KEPT}, {walk("f")}, ch as (select cell_id, parent_id node_id, count(*) n from f group by 1, 2),
      stays as materialized (select w.cell_id, w.node_id, w.root_id, w.path, w.dist_root from w join f using (cell_id, node_id) left join ch using (cell_id, node_id) where parent_id = -1 or coalesce(n, 0) <> 1),
      met as (select a.cell_id, a.node_id a, b.node_id b, a.dist_root da, b.dist_root db, a.path[len(list_filter(a.path, lambda x: list_contains(b.path, x)))] common from stays a join stays b on a.cell_id = b.cell_id and a.root_id = b.root_id and a.node_id < b.node_id)
      select met.cell_id, a, b, round(da + db - 2 * c.dist_root, 6) as length from met join w c on c.cell_id = met.cell_id and c.node_id = common""",
    "swc_parse": f"with {TREES} select cell_id, node_id, case when node_id = 1 then 7 else structure_id end structure_id, case when node_id = 1 then 0 else x end x, case when node_id = 1 then 0 else y end y, case when node_id = 1 then 0 else z end z, 1.0::double radius, parent_id from tr",
    "swc_roundtrip": f"with {TREES} select cell_id, node_id, structure_id, x, y, z, 1.0::double radius, parent_id from tr",
    "forest_annotate": f"""with recursive {TREES}, {walk("tr")}, sub as (select cell_id, unnest(path) node_id, edge, node_id below, depth from w),
      s as (select s.cell_id, s.node_id, sum(case when s.below <> s.node_id then edge else 0 end) subtree_length, max(s.depth) deepest from sub s group by 1, 2), ch as (select cell_id, parent_id node_id, count(*)::int n from tr group by 1, 2)
      select w.cell_id, w.node_id, root_id, depth, w.node_id::int as position, coalesce(n, 0)::int n_children, round(dist_root, 6) dist_root, round(subtree_length, 6) subtree_length, (deepest - depth)::int height
      from w join s using (cell_id, node_id) left join ch using (cell_id, node_id)""",
    "forest_linearize": f"""with recursive {KEPT}, {walk("f")}, {RANKED} select p.cell_id, p.position node_id, structure_id, x, y, z, 1.0::double radius, coalesce(u.position, -1) parent_id
      from pos p join f using (cell_id, node_id) left join pos u on u.cell_id = p.cell_id and u.node_id = f.parent_id""",
    "forest_components": f"""with recursive {KEPT}, {walk("f")}, {RANKED} select p.cell_id, root_id, component_rank, count(*) n_nodes, bool_or(structure_id = 1) has_soma, round(sum(edge), 6) total_length, round(max(dist_root), 6) weighted_depth, max(depth) discrete_depth
      from pos p join f using (cell_id, node_id) group by 1, 2, 3""",
    "forest_filter": f"""with {TREES}, kept as (select * from tr where x > 2) select k.cell_id, k.node_id, k.structure_id, k.x, k.y, k.z, 1.0::double radius, case when p.node_id is null then -1 else k.parent_id end parent_id
      from kept k left join kept p on k.cell_id = p.cell_id and k.parent_id = p.node_id""",
    "forest_soma_rejects": f"with {TREES} select cell_id, 'preprocess' stage, 'Found 0 soma root nodes, not 1.' reason from tr where node_id = 1 and structure_id <> 1",
    "forest_soma_accepts": f"""with {TREES}, kept as (select * from tr where structure_id in (1, 2, 3) and cell_id in (select cell_id from tr where node_id = 1 and structure_id = 1))
      select k.cell_id, k.node_id, k.structure_id, k.x, k.y, k.z, 1.0::double radius, case when p.node_id is null then -1 else k.parent_id end parent_id from kept k left join kept p on k.cell_id = p.cell_id and k.parent_id = p.node_id""",
    "type_counts": f"with {TREES} select cell_id, structure_id, count(*) n from tr group by 1, 2",
    "branching_degree": f"with {TREES} select t.cell_id, t.node_id, count(c.node_id) degree from tr t left join tr c on c.cell_id = t.cell_id and c.parent_id = t.node_id group by 1, 2",
    "total_length": f"with {TREES} select c.cell_id, round(coalesce(sum(sqrt((c.x - p.x)^2 + (c.y - p.y)^2 + (c.z - p.z)^2)), 0), 6) total_length from tr c left join tr p on p.cell_id = c.cell_id and p.node_id = c.parent_id group by 1",
    "forest_contract": f"""with recursive {KEPT}, {walk("f")}, ch as (select cell_id, parent_id node_id, count(*) n from f group by 1, 2),
      stays as (select f.cell_id, f.node_id from f left join ch using (cell_id, node_id) where parent_id = -1 or coalesce(n, 0) <> 1),
      up as (select w.cell_id, w.node_id, w.dist_root, unnest(path) above, generate_subscripts(path, 1) place from w join stays using (cell_id, node_id)),
      nearest as (select up.cell_id, up.node_id, max_by(above, place) parent_id from up join stays s on s.cell_id = up.cell_id and s.node_id = above where above <> up.node_id group by 1, 2)
      select w.cell_id, w.node_id, coalesce(n.parent_id, -1) parent_id, round(case when n.parent_id is null then 0 else w.dist_root - p.dist_root end, 6) dist, structure_id, round(w.dist_root, 6) dist_root
      from w join stays using (cell_id, node_id) join f using (cell_id, node_id) left join nearest n using (cell_id, node_id) left join w p on p.cell_id = w.cell_id and p.node_id = n.parent_id""",
    "forest_same": f"with {TREES} select distinct cell_id, true same from tr",
    "forest_preorder": f"with recursive {TREES}, {walk('tr')} select cell_id, node_id, (row_number() over (partition by cell_id order by path) - 1)::int place from w",
    "pdist_condensed": f"with {ENTRIES} select id cell_id, k::int k, round(d, 6) d from ent",
    "squareform": f"with {ENTRIES} select id cell_id, g::int i, round(sum(d), 6) total, {N - 1} last_j from (select id, i g, d from ent union all select id, j, d from ent) group by 1, 2",
    "icdm_summary": f"with {ENTRIES} select id cell_id, round(min(d), 6) step, round(sum(least(d, 1.0)), 6) capped, true is_sorted, round(1.0 / {N}, 6)::double mass from ent group by 1",
    "icdm_roundtrip": f"with {ENTRIES} select id cell_id, {N} n, round(sum(d), 6) total from ent group by 1",
    "pairs_all": f"with {VEC} select a.id first, count(*) n, max(b.id) as last from v a join v b on a.id < b.id group by 1",
    "slb_uniform": f"with {ENTRIES}, {bounds('')} select first, second, dist slb from b0",
    "slb_weighted": f"""with {STEPS} select a.id first, b.id as second, round(0.5 * sqrt(sum((s.value - t.value)^2 * greatest(0, least(s.hi, t.hi) - greatest(s.lo, t.lo)))), 6) slb from v a join v b on a.label = b.label and a.id < b.id
      join st s on s.id = a.id join st t on t.id = b.id and t.lo < s.hi and s.lo < t.hi group by 1, 2""",
    "inverse_cdf": f"with {STEPS} select id, round(hi, 6) hi, round(value, 6) as value from st",
    "distances_roundtrip": f"with {CLASS}, {BOTH} select * from both_ union all select distinct first, first, 0.0 from both_",
    "unit_mean": f"with {CLASS.replace('round(0.5 * sqrt(', '(0.5 * sqrt(').replace(f'/ {N * N}), 6) dist', f'/ {N * N})) dist')} select first, second, round(dist / (select avg(dist) from b0), 6) dist from b0",
    "rename_pairs": f"with {CLASS} select least('v' || reverse(first), 'v' || reverse(second)) first, greatest('v' || reverse(first), 'v' || reverse(second)) as second, dist from b0",
    "knn_graph": f"with {CLASS}, {BOTH}, {RANK} select first, second from near where r <= 5 union select second, first from near where r <= 5",
    "knn_cutoff": f"with {CLASS}, {BOTH}, {RANK} select first, max(dist) cutoff from near where r <= 5 group by 1",
    "medoid": f"with {CLASS}, {BOTH}, t as (select label, first, round(sum(dist), 9) total from both_ join v on v.id = first group by 1, 2) select label, min_by(first, (total, first)) as name, round(min(total), 4) total from t group by 1",
    "slb_bins": f"with {CLASS}, {EDGES} select bin, count(*) n, max(dist) most from bn group by 1",
    "seed_pairs": f"""with {CLASS}, {EDGES}, {BOTH}, {RANK} select least(first, second) first, greatest(first, second) as second from near where r <= 4
      union select first, second from (select first, second, row_number() over (partition by bin order by first, second) r from bn) where r <= 50""",
    "error_quantiles": f"with {KNOWN} select bin, round(quantile_cont(d - slb, 0.1), 6) q10, round(quantile_cont(d - slb, 0.5), 6) median, round(quantile_cont(d - slb, 0.9), 6) q90 from hk where d is not null group by 1",
    "estimator_matrix": f"with {KNOWN}, e as (select bin, quantile_cont(d - slb, 0.5) m from hk where d is not null group by 1) select first, second, round(coalesce(d, slb + coalesce(m, 0)) + 1e-9, 6) estimate from hk left join e using (bin)",
    "anchor_minplus": f"""with {VEC}, an as (select label l, min(id) anchor from v group by 1), t as (select v.id, a.id anchor, sqrt(list_sum(list_transform(range(1, 65), lambda k: (v.vector[k] - a.vector[k])^2))) d from v, v a where a.id in (select anchor from an))
      select a.id first, b.id as second, round(min(s.d + t.d), 6) dist from v a join v b on a.label = b.label and a.id < b.id join t s on s.id = a.id join t on t.id = b.id and t.anchor = s.anchor group by 1, 2""",
    "embedding_distance": f"with {VEC} select a.id first, b.id as second, round(list_sum(list_transform(range(1, 65), lambda k: (a.vector[k] - b.vector[k])^2)), 6) dist from v a join v b on a.label = b.label and a.id < b.id",
    "orient_argmax": f"with {TURNED} select cell_id, round(sum(d * (i + 1) * (j + 2)), 6) total, count(*) n from ori group by 1",
    "avg_shape": f"with {TURNED}, u as (select id cell_id, min(d) unit from ent where d > 0 group by 1) select i::int i, j::int j, round(avg(least(d / unit, 2.0)), 6) capped, round(avg(d / unit), 6) plain from ori join u using (cell_id) group by 1, 2",
    "laplacian_score": f"""with {ENTRIES}, {bounds("")}, {BOTH}, g as (select first, second from both_ where dist < 0.012), n as (select count(*) n from g), deg as (select first obj, count(*) / any_value(n) g from g, n group by 1),
      fe as (select id obj, c, case when label = c then 1.0 else 0.0 end f from v, (select unnest(range(10)) c)), m as (select c, sum(f * g) m from fe join deg using (obj) group by 1), ce as (select obj, c, f - m f from fe join m using (c))
      select 'label_' || a.c as name, round(1 - sum(a.f * b.f) / sum(a.f * a.f), 6) score from g join ce a on a.obj = first join ce b on b.obj = second and b.c = a.c group by 1""",
    "bh_qvalue": f"""with {TREES}, p as (select cell_id, (sum(case when structure_id = 5 then 1 else 0 end) + 1) / (count(*) + 1) p from tr group by 1)
      select cell_id, round(p, 6) p, round(least(1.0, p * count(*) over () / (rank() over (order by p) + (count(*) over (partition by p) - 1) / 2)), 6) q from p""",
    "relative_dispersion": relative(),
    "density_hist": f"""with {VEC}, p as (select id, vector[1] x, vector[2] y from v), r as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1, count(*) n from p),
      b as (select id, least(floor((x - x0) / ((x1 - x0) / 10)), 9) bx, least(floor((y - y0) / ((y1 - y0) / 10)), 9) as by_, n, (x1 - x0) / 10 * (y1 - y0) / 10 area from p, r)
      select id, round(count(*) over (partition by bx, by_) / (n * area), 6) density from b""",
    "wnn": wnn(),
    "cluster_pairs": f"with {VEC} select a.label, count(*) n from v a join v b on a.label = b.label and a.id < b.id where a.label in (select label from v group by 1 having count(*) >= 30) group by 1",
    "cluster_share": f"with {VEC} select (row_number() over (order by label) - 1)::int as label, round(count(*) / sum(count(*)) over (), 6) share from v group by v.label",
    "interior_labels": f"with {DISCS}, s as (select image_id, min(r) r0, max(r) r1, min(c) c0, max(c) c1 from px group by 1) select distinct image_id, label from px where label > 0 and (image_id, label) not in (select (image_id, label) from px join s using (image_id) where r in (r0, r1) or c in (c0, c1))",
    "mask_moments": f"with {DISCS} select image_id, label, count(*) n, round(avg(r), 6) r, round(avg(c), 6) c from px where label > 0 group by 1, 2",
    "boundary_pixels": f"""with {DISCS} select p.image_id, p.label, count(*) n from px p where label > 0 and (select count(*) from px o where o.image_id = p.image_id and o.label = p.label and abs(o.r - p.r) + abs(o.c - p.c) = 1) < 4 group by 1, 2""",
    "channel_normalise": f"with {DISCS} select image_id, r, c, round(signal / sum(signal) over (partition by image_id, label), 6) share from px where label > 0",
    "push_forward": """with plan as (select c_mktsegment i, c_nationkey j, count(*) / (select count(*) from customer) mass from customer group by 1, 2), w as (select c_mktsegment i, sum(o_totalprice) v from orders join customer on o_custkey = c_custkey group by 1),
      m as (select j, sum(v * mass) mass from plan join w using (i) group by 1) select j, round(mass / sum(mass) over (), 6) mass from m""",
}
