"""Resolution, partition and layout operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as P
from ..operators import partition as T
from ..operators import resolve as R
from ..sources import syntax
from ..sources.tables import table
from . import base
from .base import query, with_

URLS = """with u as (select page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) as path from pages),
roots as (select distinct regexp_extract(path, '^([^/]*/[^/]*)', 1) as root from u where page_id % 3 = 0 union select distinct regexp_extract(path, '^([^/]*)', 1) from u where page_id % 2 = 0)"""


@query("package_root", URLS + """ select page_id, path, (select root from roots where root <> '' and (path = root or starts_with(path, root || '/')) order by length(root) desc limit 1) as root from u""")
def package_root(spark, d):
    u = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    roots = u.where("page_id % 3 = 0").select(F.regexp_extract("path", "^([^/]*/[^/]*)", 1).alias("root")).union(u.where("page_id % 2 = 0").select(F.regexp_extract("path", "^([^/]*)", 1)))
    return R.longest_prefix(u, "path", roots.where("root <> ''"), "root")


@query("innermost_interval", """with s as (select o_custkey as file_id, o_orderkey as sym_id, (epoch(o_orderdate) / 86400)::bigint as start, (epoch(o_orderdate) / 86400)::bigint + (o_orderkey % 200) as "end", o_orderkey % 3 as depth from orders),
p as (select o_custkey as file_id, l_orderkey, l_linenumber, l_partkey, (epoch(l_shipdate) / 86400)::bigint as line from lineitem join orders on o_orderkey = l_orderkey),
q as (select distinct file_id, line from p),
r as (select q.file_id, line, sym_id, row_number() over (partition by q.file_id, line order by s."end" - start, depth desc, sym_id desc) as rn from q join s on s.file_id = q.file_id and line between start and s."end")
select file_id, line, sym_id from r where rn = 1""")
def innermost_interval(spark, d):
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    o = table(spark, d, "orders")
    spans = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("sym_id"), day("o_orderdate").alias("start"), (day("o_orderdate") + F.col("o_orderkey") % 200).alias("end"), (F.col("o_orderkey") % 3).alias("depth"))
    points = table(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("file_id"), day("l_shipdate").alias("line")).distinct()
    return R.innermost(points, spans)


@query("structural_implements", """with pr as (select distinct l_suppkey as owner, p_brand as method, p_type as sig from lineitem join part on p_partkey = l_partkey),
rq as (select distinct p_size as interface, p_brand as method, p_type as sig from part),
nd as (select interface, count(*) as need from rq group by 1)
select owner, rq.interface from rq join pr using (method, sig) join nd on nd.interface = rq.interface group by owner, rq.interface, need having count(*) = need""")
def structural_implements(spark, d):
    p = table(spark, d, "part")
    provided = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("owner"), F.col("p_brand").alias("method"), F.col("p_type").alias("sig"))
    return R.implements(p.select(F.col("p_size").alias("interface"), F.col("p_brand").alias("method"), F.col("p_type").alias("sig")), provided)


@query("generated_collapse", """with f as (select doc_id, min(doc_id) over (partition by text) as target, doc_id + 1 as nxt from documents),
e as (select x.target as a, y.target as b, x.doc_id % 7 + 1.0::double as weight, x.doc_id % 5 / 5.0::double as cochange from f x join f y on y.doc_id = x.nxt)
select least(a, b) as a, greatest(a, b) as b, sum(weight)::double as weight, max(cochange) as cochange from e where a <> b group by all""")
def generated_collapse(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("target"))
    redirect = docs.join(first, "h").where("doc_id <> target").select(F.col("doc_id").alias("file_id"), "target")
    edges = docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(docs.select(F.col("doc_id").alias("b")), "b")
    edges = edges.select("a", "b", (F.col("a") % 7 + F.lit(1.0)).alias("weight"), ((F.col("a") % 5) / F.lit(5.0)).alias("cochange"))
    return R.collapsed(edges, redirect)


@query("reexport_follow", """with recursive b as (select p_partkey as k, (p_partkey * 7) % 2000 as t from part where p_partkey % 3 <> 0),
w as (select p_partkey as s, p_partkey as pos, 0 as h from part union all select w.s, b.t, h + 1 from w join b on b.k = w.pos where h < 4),
l as (select s, pos, h, row_number() over (partition by s order by h desc) as rn from w)
select s as module, case when exists (select 1 from b where b.k = l.pos) then s else l.pos end as target from l where rn = 1""")
def reexport_follow(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("module"), F.lit("x").alias("name"))
    b = p.where("module % 3 <> 0").select("module", "name", (F.col("module") * 7 % 2000).alias("to_module"), F.col("name").alias("to_name"))
    return R.followed(p, b).select("module", "target")


@query("import_mass", with_("e") + """, s as (select src, dst, dst % 3 as stmt from e), p as (select src, dst, 1.0::double / count(*) over (partition by src, stmt) as share from s)
select src, dst, round_even(sum(share), 6) as share from p group by all""")
def import_mass(spark, d):
    e = base.arcs(spark, d).withColumn("stmt", F.col("dst") % 3)
    return R.import_mass(e).withColumn("share", F.rint(F.col("share") * 1e6) / 1e6)


@query("narrowed_imports", """with dc as (select distinct p_brand as package, p_partkey as file, p_name as name from part),
sl as (select distinct l_suppkey as src, p_brand as package, p_name as name from lineitem join part on p_partkey = l_partkey),
ow as (select package, name, count(distinct file) as owners, min(file) as file from dc group by all),
mt as (select sl.*, ow.file, coalesce(owners = 1, false) as sure from sl left join ow using (package, name)),
vd as (select src, package, bool_and(sure) as sure from mt group by all)
select distinct mt.src, mt.package, mt.file from mt join vd using (src, package) where vd.sure
union all select distinct vd.src, vd.package, dc.file from vd join dc using (package) where not vd.sure""")
def narrowed_imports(spark, d):
    p = table(spark, d, "part")
    declared = p.select(F.col("p_brand").alias("package"), F.col("p_partkey").alias("file"), F.col("p_name").alias("name"))
    li = table(spark, d, "lineitem")
    selected = li.join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("src"), F.col("p_brand").alias("package"), F.col("p_name").alias("name")).distinct()
    return R.narrowed_packages(selected, declared)


@query("symbol_references", """with df as (select distinct p_name as symbol, p_partkey % 50 as dst from part), rf as (select p_name as symbol, l_suppkey as src from lineitem join part on p_partkey = l_partkey)
select src, dst, count(distinct symbol) as symbols, count(*) as occurrences from rf join df using (symbol) where src <> dst group by all""")
def symbol_references(spark, d):
    p = table(spark, d, "part")
    refs = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_name").alias("symbol"), F.col("l_suppkey").alias("file_id"))
    return R.symbol_references(p.select(F.col("p_name").alias("symbol"), (F.col("p_partkey") % 50).alias("file_id")), refs)


@query("warm_start", with_("sup") + """, o as (select file_id, district as community from sup where file_id % 4 <> 0)
select file_id, coalesce(community, (select max(community) from o) + row_number() over (partition by community is null order by file_id))::bigint as community from sup left join o using (file_id)""")
def warm_start(spark, d):
    s = base.sup(spark, d)
    out = T.warm_start_table(s, s.where("file_id % 4 <> 0").select("file_id", F.col("district").alias("community")))
    return out.select("file_id", F.col("community").cast("long").alias("community"))


@query("leiden_partition")
def leiden_partition(spark, d):
    nodes = base.sup(spark, d).select(F.lit("r").alias("repo"), "file_id")
    return T.partition(base.linked(base.pairs(spark, d)).withColumn("repo", F.lit("r")), nodes)


@query("neighbourhoods")
def neighbourhoods(spark, d):
    files = base.sup(spark, d).select("file_id", "path", F.col("lang").alias("district"))
    return T.neighbourhood_table(files, base.undirected(spark, d))


@query("treemap")
def treemap(spark, d):
    files = base.part_files(spark, d).select("file_id", "path", F.col("package").alias("district"), F.col("complexity").alias("loc"))
    centres = files.select("district").distinct().withColumns({"x": F.lit(0.5), "y": F.lit(0.5)})
    return P.treemaps(files, centres)


@query("footprint_fit", with_("part_files") + " select round_even(corr(complexity::double, fanin), 6) as r from part_files")
def footprint_fit(spark, d):
    f = base.part_files(spark, d).select(F.col("complexity").alias("loc"), F.lit(None).cast("long").alias("code_lines"), F.col("fanin").alias("area"))
    return P.area_fit(f).select((F.rint(F.col("r") * 1e6) / 1e6).alias("r"))


@query("hit_test", """with p as (select l_orderkey * 10 + l_linenumber as point, min(l_tax) as x, min(l_discount) as y from lineitem group by 1),
b as (select s_suppkey as box, (s_suppkey % 10) / 100.0::double as x0, (s_suppkey // 10) / 100.0::double as y0 from supplier)
select point, box from p join b on x >= x0 and x < x0 + 0.015::double and y >= y0 and y < y0 + 0.015::double""")
def hit_test(spark, d):
    pts = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point")).agg(F.min("l_tax").alias("x"), F.min("l_discount").alias("y"))
    s = table(spark, d, "supplier")
    x0, y0 = (F.col("s_suppkey") % 10) / F.lit(100.0), F.floor(F.col("s_suppkey") / 10) / F.lit(100.0)
    boxes = s.select(F.col("s_suppkey").alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.015).alias("x1"), (y0 + 0.015).alias("y1"))
    return P.containing(pts, boxes, 0.05)


# a package with a file for each part: it imports the file of another part, and a loop or a branch for each unit of its size
PYTHON = """py as (select p_partkey as k, 'town/m' || p_partkey || '.py' as path, p_size % 5 as branches, (p_partkey * 7) % (select count(*) + 9 from part) as other from part)"""


def python_files(spark, d):
    parts = table(spark, d, "part")
    total = parts.agg((F.count("*") + 9).alias("total"))  # some imported files do not exist
    k, branches = F.col("p_partkey"), (F.col("p_size") % 5).cast("int")
    text = F.concat(
        F.lit('"""Docs."""\n\nfrom . import m'), (k * 7) % F.col("total"), F.lit("\n\n\ndef walk(steps):\n"), F.repeat(F.lit("    if steps:\n        steps += 1\n"), branches), F.lit("    return steps\n")
    )
    return parts.crossJoin(F.broadcast(total)).select(F.concat(F.lit("town/m"), k, F.lit(".py")).alias("path"), text.alias("content"))


@query("python_metrics", "with " + PYTHON + " select path, (8 + 2 * branches)::bigint as loc, (3 + 2 * branches)::bigint as code_lines, (1 + branches)::bigint as complexity, 1 as symbols from py")
def python_metrics(spark, d):
    rows = syntax.parsed(python_files(spark, d), "python")
    whole = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("path", whole("loc"), whole("code_lines"), whole("complexity"), F.size("symbols").alias("symbols"))


@query("python_imports", "with " + PYTHON + " select 'town.m' || x.k as src, 'town.m' || x.other as dst from py x join py y on y.k = x.other where x.k <> x.other")
def python_imports(spark, d):
    rows = syntax.parsed(python_files(spark, d), "python").withColumn("src", R.module_name(F.col("path")))
    modules = rows.select(F.col("src").alias("module"))
    stated = rows.select("src", F.col("path").endswith("__init__.py").alias("is_package"), F.explode("imports").alias("i")).select("src", "is_package", "i.*")
    return R.python_imports(stated, modules)
