"""Landmarks, proposals, symbols and map documents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import partition as T
from ..operators import suggest as S
from ..operators import symbols as Y
from ..sources import document
from ..sources.tables import checkpointed, table
from . import base
from .base import query, with_


@query("suggest_crossings", with_("sup", "und") + """,
x as (select und.a, und.b, weight, least(p.district, q.district) as da, greatest(p.district, q.district) as db from und join sup p on p.file_id = a join sup q on q.file_id = b where p.district <> q.district),
t as (select da, db from x group by all order by sum(weight) desc, da, db limit 3),
r as (select x.*, row_number() over (partition by x.da, x.db order by weight desc, a, b) as rn from x join t on t.da = x.da and t.db = x.db)
select da, db, a, b, weight from r where rn = 1""")
def suggest_crossings(spark, d):
    return S.crossings(base.undirected(spark, d), base.sup(spark, d))


@query("suggest_tour", with_("sup", "und") + """,
dg as (select node, sum(weight) as degree from (select a as node, weight from und union all select b, weight from und) group by node),
r as (select district, file_id, row_number() over (partition by district order by coalesce(degree, 0) desc, file_id) as rn from sup left join dg on node = file_id),
z as (select district, count(*) as size from sup group by district)
select z.district, (row_number() over (order by size desc, z.district) - 1)::int as pos, file_id from z join r on r.district = z.district and rn = 1""")
def suggest_tour(spark, d):
    files = base.sup(spark, d)
    return S.district_tour(files, G.capitals(files, G.weighted_degree(base.undirected(spark, d))))


def _scored(spark, d):
    """Suppliers as files with lines, complexity, churn and fan-in.  Pairs and files are read many times: they are made once."""
    pairs = checkpointed(base.pairs(spark, d))
    ahead, back = (pairs.where(f"a <> b and {n} > 0") for n in ("ahead", "back"))
    fan = ahead.select(F.col("b").alias("file_id")).union(back.select("a")).groupBy("file_id").agg(F.count("*").cast("double").alias("fanin"))
    churn = pairs.where("a = b").select(F.col("a").alias("file_id"), F.col("ahead").alias("churn"))
    files = base.sup(spark, d).join(fan, "file_id", "left").join(churn, "file_id", "left")
    return pairs, checkpointed(files.select(
        "file_id", "path", "district", "district_name", (F.col("file_id") * 7 % 300).alias("loc"), (F.col("file_id") * 11 % 50).alias("complexity"),
        F.coalesce("churn", F.lit(0)).cast("long").alias("churn"), F.coalesce("fanin", F.lit(0.0)).alias("fanin"),
    ))


@query("suggest_entry_routes")
def suggest_entry_routes(spark, d):
    pairs, files = _scored(spark, d)
    return S.entry_routes(base.directed(pairs), files, files)


@query("landmarks")
def landmarks(spark, d):
    pairs, files = _scored(spark, d)
    edges = base.linked(pairs)
    return G.landmarks(files, edges, checkpointed(G.betweenness(edges)))


@query("neighbourhood_labels", with_("sup") + """,
c as (select district, file_id % 3 as nb, regexp_extract(path, '^(.*)/', 1) as dir, count(*) as n from (select lang as district, file_id, path from sup) group by all),
t as (select district, nb, dir from (select *, row_number() over (partition by district, nb order by n desc, dir) as rn from c) where rn = 1),
e as (select district, nb, dir, k, array_to_string(list_slice(string_split(dir, '/'), len(string_split(dir, '/')) - k + 1, len(string_split(dir, '/'))), '/') as tail from t, lateral (select unnest(range(1, len(string_split(dir, '/')) + 1)) as k)),
o as (select *, (select count(distinct f.dir) from e f where f.district = e.district and f.k = e.k and f.tail = e.tail) as owners from e)
select t.district, t.nb::int as neighbourhood, coalesce((select tail from o where o.district = t.district and o.nb = t.nb and owners = 1 order by k limit 1), t.dir) as label from t""")
def neighbourhood_labels(spark, d):
    members = base.sup(spark, d).select(F.col("lang").alias("district"), (F.col("file_id") % 3).cast("int").alias("neighbourhood"), "path")
    return T.neighbourhood_labels(members)


NAMES = """with tops as (select s_suppkey as file_id, 'n' || s_suppkey % 20 as name, s_suppkey as sym_id from supplier where s_suppkey % 3 = 0),
pk as (select s_suppkey as file_id, s_nationkey as package, 'n' || s_suppkey % 20 as name, s_suppkey as sym_id from supplier),
im as (select s_suppkey as file_id, 'n' || (s_suppkey + 5) % 20 as name, s_suppkey + 1000 as sym_id from supplier),
one as (select package, name, min(sym_id) as sym_id from pk group by all having count(distinct sym_id) = 1),
ev as (select file_id, name, sym_id, 0 as turn, 'local' as source from tops
  union all select s.file_id, one.name, one.sym_id, 1, 'package' from (select distinct file_id, package from pk) s join one using (package)
  union all select file_id, name, sym_id, 2, 'import' from im),
bd as (select file_id, name, sym_id, source from (select *, row_number() over (partition by file_id, name order by turn, sym_id) as rn from ev) where rn = 1)"""


def _bound(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_nationkey").alias("package"))
    name = lambda k: F.concat(F.lit("n"), (F.col("file_id") + k) % 20)
    tops = s.where("file_id % 3 = 0").select("file_id", name(0).alias("name"), F.col("file_id").alias("sym_id"))
    package = s.select("file_id", "package", name(0).alias("name"), F.col("file_id").alias("sym_id"))
    imports = s.select("file_id", name(5).alias("name"), (F.col("file_id") + 1000).alias("sym_id"))
    return Y.bindings(tops, package, imports)


@query("symbol_bindings", NAMES + " select * from bd")
def symbol_bindings(spark, d):
    return _bound(spark, d)


@query("symbol_reasons", NAMES + """,
cd as (select l_orderkey * 10 + l_linenumber as owner, l_suppkey as file_id, case l_partkey % 9 when 0 then null when 1 then 'self' else 'n' || l_partkey % 25 end as head,
  case when l_partkey % 2 = 0 then 'm' || l_partkey % 4 end as attr, l_suppkey as cls from lineitem),
mb as (select s_suppkey as cls, 'm' || s_suppkey % 4 as name, s_suppkey + 5000 as sym_id from supplier),
r as (select cd.*, bd.sym_id as b, o.sym_id as m_own, f.sym_id as m_of from cd left join bd on bd.file_id = cd.file_id and bd.name = cd.head
  left join mb o on o.cls = cd.cls and o.name = cd.attr left join mb f on f.cls = bd.sym_id and f.name = cd.attr),
k as (select case when head is null then 'dynamic' when head = 'self' then case when m_own is not null then 'resolved' else 'unresolved_attribute' end
  when attr is null and b is not null then 'resolved' when attr is not null and m_of is not null then 'resolved'
  when b is not null then 'unresolved_attribute' else 'external' end as reason from r)
select reason, count(*) as n from k group by 1""")
def symbol_reasons(spark, d):
    li = table(spark, d, "lineitem")
    part = F.col("l_partkey")
    candidates = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("owner"), F.col("l_suppkey").alias("file_id"),
        F.when(part % 9 == 0, F.lit(None)).when(part % 9 == 1, "self").otherwise(F.concat(F.lit("n"), part % 25)).alias("head"),
        F.when(part % 2 == 0, F.concat(F.lit("m"), part % 4)).alias("attr"), F.lit("call").alias("kind"), F.col("l_suppkey").alias("cls"),
    )
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cls"))
    members = s.select("cls", F.concat(F.lit("m"), F.col("cls") % 4).alias("name"), (F.col("cls") + 5000).alias("sym_id"))
    none = spark.createDataFrame([], "owner long, name string")
    modules = spark.createDataFrame([], "name string, attr string, sym_id long")
    return Y.reason_counts(Y.resolved(candidates, _bound(spark, d), members, none, modules))


@query("symbol_receivers", """with m as (select p_partkey as sym_id, p_brand as dir, p_partkey % 40 as file_id, p_name as receiver from part where p_partkey % 4 <> 0),
t as (select p_partkey as sym_id, p_brand as dir, p_partkey % 40 as file_id, p_name as name from part where p_partkey % 4 = 0),
f as (select file_id, name, min(sym_id) as parent from t group by all having count(*) = 1), w as (select dir, name, min(sym_id) as parent from t group by all having count(*) = 1)
select sym_id, coalesce(f.parent, w.parent) as parent from m left join f on f.file_id = m.file_id and f.name = receiver left join w on w.dir = m.dir and w.name = receiver where coalesce(f.parent, w.parent) is not null""")
def symbol_receivers(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sym_id"), F.col("p_brand").alias("dir"), (F.col("p_partkey") % 40).alias("file_id"), F.col("p_name").alias("name"))
    return Y.receivers(p.where("sym_id % 4 <> 0").withColumnRenamed("name", "receiver"), p.where("sym_id % 4 = 0"))


@query("compact_uses", """with s as (select p_partkey % 50 as def_file, list_extract(string_split(p_name, ' '), -1) as base, min(p_partkey) as sym_idx from part group by all),
u as (select distinct l_suppkey % 50 as def_file, list_extract(string_split(p_name, ' '), -1) as base, l_orderkey % 30 as usr from lineitem join part on p_partkey = l_partkey)
select def_file, sym_idx, list_sort(list(distinct usr)) as users from u join s using (def_file, base) group by all""")
def compact_uses(spark, d):
    p = table(spark, d, "part").withColumn("dotted", F.replace("p_name", F.lit(" "), F.lit(".")))
    symbols = p.select((F.col("p_partkey") % 50).alias("file_id"), F.col("dotted").alias("name"), F.col("p_partkey").alias("sym_idx"))
    uses = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_suppkey") % 50).alias("dst"), F.col("dotted").alias("name"), (F.col("l_orderkey") % 30).alias("src"))
    return document.compact_uses(uses, symbols)


@query("map_document", with_("sup", "e") + """ select 'demo' as repo, (select count(*) from sup)::int as files, (select count(*) from e)::int as edges,
  (select list(x order by x) from (select distinct district::varchar as x from sup)) as districts""")
def map_document(spark, d):
    pairs, files = _scored(spark, d)
    arcs = base.directed(pairs)
    where = {c: F.lit(0.5) for c in ("x", "y", "rx", "ry", "rw", "rh")}
    files = files.withColumns({**where, "file_id": F.col("file_id") - 1, "code_lines": F.col("loc")})
    near = arcs.select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))
    names = files.select("district", F.col("district_name").alias("name")).distinct()
    doc = document.document(files, near, names, "demo", "0" * 40, "py", 0.0)
    count = lambda c: F.sum(F.size(c)).cast("int")
    whole = doc.groupBy("repo").agg(count("F").alias("files"), count("E").alias("edges"), F.first("names", ignorenulls=True).alias("names"))
    return whole.select("repo", "files", "edges", F.map_keys("names").alias("districts"))
