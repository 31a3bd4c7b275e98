"""Caches, dumps, results, registries, comparisons and viewer flows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import debt as D
from ..operators import graph as G
from ..operators import naming as N
from ..operators import overlay as V
from ..operators import placement as P
from ..operators import resolve as R
from ..operators import runs as U
from ..operators import search as W
from ..sources import publish
from ..sources.tables import table
from . import base
from .base import query, with_
from .graph_queries import COCHANGE, MASSES, candidates


@query("name_cache", with_("sup") + " select substr(sha1(string_agg(path, chr(10) order by path)), 1, 12) as key, district, min(district_name) as name from sup group by district")
def name_cache(spark, d):
    files = base.sup(spark, d)
    return publish.name_cache(files, files.select("district", F.col("district_name").alias("name")).distinct())


@query("cached_names", with_("sup") + """,
k as (select district, min(district_name) as name, substr(sha1(string_agg(path, chr(10) order by path)), 1, 12) as key from sup group by district),
n as (select district, substr(sha1(string_agg(path, chr(10) order by path)), 1, 12) as key from sup where file_id > (select min(file_id) from sup) group by district)
select n.district, k.name from n join k using (key)""")
def cached_names(spark, d):
    files = base.sup(spark, d)
    later = files.where(F.col("file_id") > files.agg(F.min("file_id")).first()[0])  # one district has other members now
    return publish.cached_names(later, name_cache(spark, d))


@query("blend_dump", MASSES + """,
r as (select *, max(weight) over (partition by node) as top, row_number() over (partition by node order by weight desc, a, b) as rn from (select a as node, * from bl union all select b, * from bl)),
kp as (select distinct a, b from r where rn <= 14 and weight >= 0.02::double * top)
select round_even(ms, 10) as mass_static_s, round_even(mc, 10) as mass_cochange_s, round_even(mp, 10) as mass_proximity_s, round_even(me, 10)::double as mass_semantic_s,
  (select count(*) from bl) as candidates, (select round_even(count(*) filter (where weight < 0.02::double) / count(*), 10) from bl) as below_floor,
  (select round_even(max(weight), 9) from bl) as largest, (select round_even(sum(weight), 6) from bl) as summed, (select count(*) from kp) as kept from mass""")
def blend_dump(spark, d):
    return publish.blend_dump(candidates(spark, d))


@query("graph_dump", with_("sup", "heavy") + """ select '{"a":"' || x.path || '","b":"' || y.path || '","weight":' || n || (case when n > 1 then ',"often":true' else '' end) || '}' as line
from heavy join sup x on x.file_id = src join sup y on y.file_id = dst""")
def graph_dump(spark, d):
    edges = base.heavy_arcs(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").alias("weight"), F.when(F.col("n") > 1, F.lit(True)).alias("often"))
    return publish.graph_dump(base.sup(spark, d), edges, ["often"])


@query("corpus_summary", """with m as (select o_orderpriority, 'o_totalprice' as metric, o_totalprice::double as x from orders union all select o_orderpriority, 'o_custkey', o_custkey::double from orders)
select o_orderpriority, metric, round_even(quantile_cont(x, 0.5), 4) as median, round_even(quantile_cont(x, 0.1), 4) as p10, round_even(quantile_cont(x, 0.9), 4) as p90 from m group by all""")
def corpus_summary(spark, d):
    return publish.band_summary(table(spark, d, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"])


@query("comparison_ids", """select n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') as id from nation""")
def comparison_ids(spark, d):
    from ..operators.history import comparison_id

    return comparison_id(table(spark, d, "nation"), ["n_name", "n_regionkey"]).select("n_nationkey", "id")


@query("result_problems", """with r as (select s_nationkey as k, count(*) as files, sum(s_suppkey)::bigint as ids from supplier where s_nationkey <> (select max(s_nationkey) from supplier) group by 1),
f as (select s_nationkey as k, count(*) as files, sum(case when s_acctbal < 0 then 0 else s_suppkey end)::bigint as ids from supplier where s_nationkey <> (select min(s_nationkey) from supplier) group by 1)
select k, problem from (select coalesce(r.k, f.k) as k, case when f.k is null then 'missing' when r.k is null then 'unexpected' when r.files <> f.files or r.ids <> f.ids then 'count' end as problem from r full join f on r.k = f.k) where problem is not null""")
def result_problems(spark, d):
    s = table(spark, d, "supplier")
    last, first = s.agg(F.max("s_nationkey"), F.min("s_nationkey")).first()
    side = lambda rows, ids: rows.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("files"), F.sum(ids).alias("ids"))
    reported = side(s.where(F.col("s_nationkey") != last), F.col("s_suppkey"))
    found = side(s.where(F.col("s_nationkey") != first), F.when(F.col("s_acctbal") < 0, 0).otherwise(F.col("s_suppkey")))
    return U.result_problems(reported, found, ["k"], ["files", "ids"])


@query("timeline_replay", """with e as (select user_id as job, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as stage, floor(epoch(ts))::bigint as moment from events),
r as (select job, seq, (moment - min(moment) over (partition by job))::bigint as elapsed, sum(length(stage) * 60.0::double) over (partition by job order by seq rows between current row and unbounded following) as estimate,
  (max(moment) over (partition by job) - moment)::bigint as remaining, max(seq) over (partition by job) as last from e)
select job, seq, elapsed, estimate, remaining, estimate - remaining as error from r where seq < last""")
def timeline_replay(spark, d):
    e = table(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("job"), F.row_number().over(order).cast("long").alias("seq"), F.col("event_type").alias("stage"), F.unix_timestamp(F.col("ts")).alias("at"))
    predicted = e.select(F.col("event_type").alias("stage")).distinct().withColumn("seconds", F.length("stage") * 60.0)
    return U.replayed(rows, predicted)


@query("registry_removal", """with c as (select * from customer where c_nationkey <> 3), o as (select * from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)),
l as (select * from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)))
select 'customer' as name, count(*) as rows from c union all select 'orders', count(*) from o union all select 'lineitem', count(*) from l""")
def registry_removal(spark, d):
    tables = {t: table(spark, d, t) for t in ("customer", "orders", "lineitem")}
    cascade = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    left = U.removed(tables, "customer", tables["customer"].where("c_nationkey = 3"), "c_custkey", cascade)
    counts = [df.agg(F.lit(t).alias("name"), F.count("*").alias("rows")) for t, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("access_allowed", """with q as (select distinct o_orderpriority as principal, o_orderstatus as operation from orders),
u as (select o_orderpriority as principal, o_orderstatus as operation, o_totalprice > 1000 as ok from orders where o_orderstatus <> 'P')
select q.*, coalesce((select bool_and(ok) from u where u.principal = q.principal and u.operation = q.operation), false) as allowed from q""")
def access_allowed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("principal"), F.col("o_orderstatus").alias("operation"), (F.col("o_totalprice") > 1000).alias("allow"))
    return U.allowed(o.select("principal", "operation").distinct(), o.where("operation <> 'P'"))


@query("parity_report", with_("sup", "und") + """,
ca as (select file_id, path, case when file_id = (select max(file_id) from sup) then (select min(district) from sup) else district end as district from sup),
ce as (select * from und where weight > (select min(weight) from und)),
cl as (select ca.district as dc, s.district as dr, count(*) as n from ca join sup s using (path) group by all),
al as (select sum(n) as files, sum(n) filter (where rn = 1) as alike from (select *, row_number() over (partition by dc order by n desc, dr) as rn from cl)),
q as (select 'r' as side, x.district as da, y.district as db, weight from und join sup x on x.file_id = a join sup y on y.file_id = b
  union all select 'c', x.district, y.district, weight from ce join ca x on x.file_id = a join ca y on y.file_id = b),
m as (select side, sum(weight) as m from q group by side),
k as (select side, d, sum(k) as k, sum(w) as w from (select side, da as d, weight as k, case when da = db then weight else 0 end as w from q union all select side, db, weight, 0 from q) group by all),
mod as (select k.side, round_even(sum(w / m - 1.1::double * pow(k / (2 * m), 2)), 6) as q from k join m on m.side = k.side group by k.side),
dq as (select round_even((select q from mod where side = 'c') - (select q from mod where side = 'r'), 6) as dq),
lost as (select (select count(*) from und) - (select count(*) from ce) as lost)
select files::bigint as files, round_even(alike / files, 6) as placed_alike, dq, lost as edges_lost, 0::bigint as edges_new, (alike / files >= 0.95 and abs(dq) <= 0.02 and lost = 0) as passed from al, dq, lost""")
def parity_report(spark, d):
    files, edges = base.sup(spark, d), base.undirected(spark, d)
    last, low = files.agg(F.max("file_id"), F.min("district")).first()
    candidate = files.withColumn("district", F.when(F.col("file_id") == last, low).otherwise(F.col("district")))
    least = edges.agg(F.min("weight")).first()[0]
    return C.parity(files, candidate, edges, edges.where(F.col("weight") > least))


@query("variant_churn", with_("sup", "und", "heavy") + """,
v as (select 'all' as variant, a, b, weight from und union all select 'heavy', least(src, dst), greatest(src, dst), n::double from heavy),
q as (select variant, x.district as da, y.district as db, weight from v join sup x on x.file_id = a join sup y on y.file_id = b),
m as (select variant, count(*) as edges, sum(weight) as m, sum(case when da = db then weight else 0 end) as w from q group by variant),
k as (select variant, sum(k * k) as k2 from (select variant, d, sum(weight) as k from (select variant, da as d, weight from q union all select variant, db, weight from q) group by all) group by variant)
select m.variant, edges, round_even(w / m, 6) as inside, round_even(w / m - k2 / (4 * m * m), 6) as q from m join k on k.variant = m.variant""")
def variant_churn(spark, d):
    heavy = base.heavy_arcs(spark, d).select(F.lit("heavy").alias("variant"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("n").cast("double").alias("weight"))
    every = base.undirected(spark, d).select(F.lit("all").alias("variant"), "a", "b", "weight")
    return C.variant_churn(every.union(heavy), base.sup(spark, d))


@query("head_cochange", with_("cf") + COCHANGE + """ select least(case when a % 10 = 0 then a + 100000 else a end, case when b % 10 = 0 then b + 100000 else b end) as a,
greatest(case when a % 10 = 0 then a + 100000 else a end, case when b % 10 = 0 then b + 100000 else b end) as b, cnt, round_even(weight, 6) as weight from co""")
def head_cochange(spark, d):
    renames = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("from_path"), (F.col("s_suppkey") + 100_000).alias("to_path"))
    return C.head_cochange(base.commit_files(spark, d), renames).withColumn("weight", F.rint(F.col("weight") * 1e6) / 1e6)


@query("head_frame", with_("sup", "e", "und") + """,
bs as (select path, district from sup where file_id % 7 <> 0),
hd as (select case when file_id % 5 = 0 and file_id % 7 <> 0 then path || '.new' else path end as path, path as identity, file_id from sup),
kp as (select hd.*, bs.district from hd left join bs on bs.path = hd.identity),
w as (select x.path, y.district, sum(coalesce(und.weight, 0)) as weight from e join kp x on x.file_id = src join kp y on y.file_id = dst
  left join und on und.a = least(src, dst) and und.b = greatest(src, dst) where x.district is null and y.district is not null group by all),
r as (select path, district, row_number() over (partition by path order by weight desc, district) as rn from w)
select kp.path, identity, coalesce(kp.district, r.district, (select max(district) + 1 from bs))::int as district from kp left join r on r.path = kp.path and rn = 1""")
def head_frame(spark, d):
    files = base.sup(spark, d)
    moved = (F.col("file_id") % 5 == 0) & (F.col("file_id") % 7 != 0)
    head = files.select("file_id", F.when(moved, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.col("path").alias("old"), moved.alias("moved"))
    renamed = head.where("moved").select(F.lit("renamed").alias("status"), F.col("old").alias("from_path"), F.col("path").alias("to_path"))
    at = lambda end: head.select(F.col("file_id").alias(end), F.col("path").alias(f"p_{end}"))
    named = lambda rows, a, b: rows.join(at(a), a).join(at(b), b).withColumns({a: F.col(f"p_{a}"), b: F.col(f"p_{b}")}).drop(f"p_{a}", f"p_{b}")
    base_files = files.where("file_id % 7 <> 0").select("path", "district")
    return C.head_frame(head.select("path"), base_files, renamed, named(base.arcs(spark, d), "src", "dst").select("src", "dst"), named(base.undirected(spark, d), "a", "b"))


FINDINGS = """with f as (select 'god' as kind, o_custkey::varchar as path, o_orderdate from orders where o_totalprice > 200000 union all select 'hotspot', o_custkey::varchar, o_orderdate from orders where o_orderpriority = '1-URGENT'),
b as (select distinct kind, path from f where o_orderdate <= '1998-01-01'), a as (select distinct kind, path from f where o_orderdate > '1998-01-01')"""


@query("debt_changes", FINDINGS + " select coalesce(b.kind, a.kind) as kind, coalesce(b.path, a.path) as path, case when b.kind is null then 'added' when a.kind is null then 'removed' else 'shared' end as change from b full join a on a.kind = b.kind and a.path = b.path")
def debt_changes(spark, d):
    o = table(spark, d, "orders").withColumn("path", F.col("o_custkey").cast("string"))
    f = o.where("o_totalprice > 200000").select(F.lit("god").alias("kind"), "path", "o_orderdate").union(o.where("o_orderpriority = '1-URGENT'").select(F.lit("hotspot"), "path", "o_orderdate"))
    return C.debt_changes(f.where("o_orderdate <= timestamp '1998-01-01'"), f.where("o_orderdate > timestamp '1998-01-01'"))


@query("commit_comparison", """with b as (select o_custkey::varchar as path, min(o_orderkey % 9) as district from orders where o_orderdate <= '1998-01-01' group by 1),
h as (select o_custkey::varchar as path, min(o_orderkey % 9) as district from orders where o_orderdate > '1996-01-01' group by 1)
select coalesce(b.path, h.path) as path, case when b.path is null then 'added' when h.path is null then 'removed' when b.district <> h.district then 'moved' else 'kept' end as change,
  b.district as base_district, h.district as head_district, 'aaa' as base_commit, 'bbb' as head_commit from b full join h on h.path = b.path""")
def commit_comparison(spark, d):
    o = table(spark, d, "orders")
    side = lambda c: o.where(c).groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.min(F.col("o_orderkey") % 9).alias("district"))
    ends = {"base_commit": "aaa", "head_commit": "bbb"}
    return C.comparison(side("o_orderdate <= timestamp '1998-01-01'"), side("o_orderdate > timestamp '1996-01-01'"), ends)


@query("filename_words", """with f as (select ascii(split_part(p_name, ' ', 2)) % 4 as district, p_partkey, replace(p_name, ' ', '_') || '.py' as base from part),
w as (select distinct district, p_partkey, unnest(list_filter(string_split_regex(lower(regexp_replace(base, '\\.[^.]*$', '')), '[^a-z0-9]+'), lambda x: length(x) > 3)) as word from f),
z as (select district, count(*) as size from f group by 1), c as (select district, word, count(*) as n from w group by all),
p(district, other) as (values (0, 1), (1, 0), (2, 3)),
s as (select p.district, p.other, c.word, round_even(c.n / z.size * ln((z.size + y.size + 1) / (c.n + coalesce(m.n, 0) + 1.0::double)), 6) as score
  from p join c on c.district = p.district join z on z.district = p.district join z y on y.district = p.other left join c m on m.district = p.other and m.word = c.word where c.n >= greatest(2, 0.3::double * z.size))
select *, row_number() over (partition by district, other order by score desc, word)::int as rank from s""")
def filename_words(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/"), k, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py"))
    files = table(spark, d, "part").select((F.ascii(F.split("p_name", " ")[1]) % 4).cast("int").alias("district"), path.alias("path"))
    return N.filename_words(files, spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "district int, other int"))


@query("palette_largest", with_("sup") + """ select 'district' as kind, name, district::bigint as id, rank from (
  select district, min(district_name) as name, row_number() over (order by count(*) desc, district)::int as rank from sup group by district) where rank <= 6""")
def palette_largest(spark, d):
    files = base.sup(spark, d)
    sizes = files.groupBy("district").agg(F.min("district_name").alias("name"), F.count("*").alias("size"))
    return W.grouped_results(files, None, sizes, " ")


def _streets(spark, d):
    return base.sup(spark, d).select("file_id", F.col("lang").alias("district"), F.col("district").alias("neighbourhood"))


@query("street_flows", with_("sup", "e") + """,
f as (select x.district as src, y.district as dst, count(*) as n from e join sup x on x.file_id = src join sup y on y.file_id = dst
  where x.lang = 'ASIA' and y.lang = 'ASIA' and x.district <> y.district group by all)
select src, dst, n, row_number() over (order by n desc, src, dst)::int as rank from f order by rank limit 20""")
def street_flows(spark, d):
    return W.street_flows(base.arcs(spark, d), _streets(spark, d), "ASIA")


@query("cross_flows", with_("sup", "e") + """,
x as (select p.district as neighbourhood, q.lang as other, true as outward from e join sup p on p.file_id = src join sup q on q.file_id = dst where p.lang = 'ASIA' and q.lang <> 'ASIA'
  union all select q.district, p.lang, false from e join sup p on p.file_id = src join sup q on q.file_id = dst where q.lang = 'ASIA' and p.lang <> 'ASIA'),
f as (select neighbourhood, other, outward, count(*) as n from x group by all)
select *, row_number() over (order by n desc, neighbourhood, other, outward)::int as rank from f order by rank limit 12""")
def cross_flows(spark, d):
    return W.cross_flows(base.arcs(spark, d), _streets(spark, d), "ASIA")


@query("polygon_test", """with p as (select l_orderkey * 10 + l_linenumber as point, min(l_tax) as x, min(l_discount) as y from lineitem group by 1),
s as (select s_suppkey as polygon, (s_suppkey % 10) / 100.0::double + 0.0013 as cx, (s_suppkey // 10) / 100.0::double + 0.0017 as cy from supplier)
select point, polygon from p join s on abs(x - cx) + abs(y - cy) < 0.011::double""")
def polygon_test(spark, d):
    pts = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point")).agg(F.min("l_tax").alias("x"), F.min("l_discount").alias("y"))
    s, r = table(spark, d, "supplier"), 0.011
    cx, cy = (F.col("s_suppkey") % 10) / F.lit(100.0) + 0.0013, F.floor(F.col("s_suppkey") / 10) / F.lit(100.0) + 0.0017
    corner = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
    rings = s.select(F.col("s_suppkey").alias("polygon"), F.array(corner(r, 0), corner(0, r), corner(-r, 0), corner(0, -r)).alias("ring"))
    return P.inside_polygons(pts, rings, 0.01)


@query("cycle_report")
def cycle_report(spark, d):
    return D.cycle_report(base.sup(spark, d), base.heavy_arcs(spark, d)).select("component", "bundles", "imports", F.size("mutual").alias("mutual"), F.size("cut").alias("cut"))


@query("cycle_routes")
def cycle_routes(spark, d):
    return D.cycle_routes(base.sup(spark, d), base.heavy_arcs(spark, d))


@query("file_places")
def file_places(spark, d):
    files = base.sup(spark, d).select("file_id", F.col("lang").alias("district"), F.col("district").alias("neighbourhood"))
    return P.file_places(files, base.undirected(spark, d))


@query("symbol_cards")
def symbol_cards(spark, d):
    k = F.col("p_partkey")
    parent = F.when(F.floor(k / 25) % 4 != 0, k - 25)
    rows = table(spark, d, "part").select((k % 25).alias("file_id"), k.alias("sym"), parent.alias("parent"), F.col("p_size").alias("lines"))
    return P.cards(rows).select("file_id", "sym", F.size("ring").alias("numbers"))


@query("topological_levels", with_("sup", "e") + """,
bu as (select distinct least(x.district, y.district) as src, greatest(x.district, y.district) as dst from e join sup x on x.file_id = e.src join sup y on y.file_id = e.dst where x.district <> y.district),
hv as (select src, dst from (select *, row_number() over (partition by src order by dst) as rn from bu) where rn <= 2),
w as (select src as node, 0 as level from hv where src not in (select dst from hv) union select hv.dst, level + 1 from w join hv on hv.src = w.node)
select node, max(level) as level from w group by node""")
def topological_levels(spark, d):
    pairs = D.bundles(base.sup(spark, d), base.arcs(spark, d)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    rn = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return G.topological_levels(pairs.withColumn("rn", rn).where("rn <= 2").select("src", "dst"))


@query("area_members", with_("sup") + """ select 'asia' as label, path from sup where starts_with(path, 'ASIA/') union select 'ones', path from sup where regexp_matches(path, '^[^/]*/[^/]*/[^/]*1$')""")
def area_members(spark, d):
    files = base.sup(spark, d)
    rows = [("area", "asia", 0, "ASIA/**", None), ("area", "asia", 1, "ASIA/*/*", None), ("area", "ones", 0, "*/*/*1", None)]
    return V.members(V.table(spark, rows), files)


@query("class_orders")
def class_orders(spark, d):
    """Parts as classes: each derives from the parts of a half and of a third of its number."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("cls"), F.posexplode(F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3)))).alias("pos", "base"))
    return R.linearizations(rows.where("base <> cls and base > 0"))
