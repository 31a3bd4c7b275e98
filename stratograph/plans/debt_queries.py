"""Structural debt, change checks, overlays, organizations, searches, history and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import check as C
from ..operators import debt as D
from ..operators import evaluation as E
from ..operators import history as H
from ..operators import naming as N
from ..operators import organization as O
from ..operators import overlay as V
from ..operators import search as W
from ..operators import signals as S
from ..sources.tables import table
from . import base
from .base import query, with_
from .graph_queries import BUNDLES, COCHANGE, rounded

EPOCH = "1998-01-01"

# ---- debt


@query("misplaced", with_("sup", "heavy") + """,
t as (select heavy.src as f, q.lang as other from heavy join sup q on q.file_id = heavy.dst union all select heavy.dst, q.lang from heavy join sup q on q.file_id = heavy.src),
n as (select f, other, count(*) as n from t group by all),
r as (select path, s.lang as district, other, n, sum(n) over (partition by f) as edges from n join sup s on s.file_id = f),
k as (select *, row_number() over (partition by path order by n desc, other) as rn from r where other <> district and edges >= 5)
select path, district, edges::bigint as edges, other as to_district, round_even(n / edges, 4) as share from k where rn = 1 and n / edges > 0.3::double""")
def misplaced(spark, d):
    files = base.sup(spark, d).withColumn("district", F.col("lang"))
    return D.misplaced(files, base.heavy_arcs(spark, d), min_share=0.3)


CUT = "(select min(v) from (select {c} as v from {t} order by {c} desc limit greatest(ceil(0.05::double * (select count(*) from {t}))::int, {m}, 1)))"


@query("god_files", with_("part_files") + f""",
c as (select {CUT.format(c='fanin', t='part_files', m=1)} as cf, {CUT.format(c='complexity', t='part_files', m=1)} as cc)
select path, fanin, 1 + (select count(*) from part_files x where x.fanin > p.fanin) as fanin_rank, complexity,
  1 + (select count(*) from part_files x where x.complexity > p.complexity) as complexity_rank
from part_files p, c where fanin >= cf and complexity >= cc and cf > 0 and cc > 0""")
def god_files(spark, d):
    return D.god_files(base.part_files(spark, d))


HOT = f""",
sc as (select file_id, path, churn, complexity, churn * complexity as score from part_files),
hc as (select {CUT.format(c='score', t='sc', m=2)} as cut)"""


@query("hotspots", with_("part_files") + HOT + """
select path, churn, complexity, score, row_number() over (order by score desc, file_id)::int as rank from sc, hc where score >= cut and cut > 0""")
def hotspots(spark, d):
    return D.hotspots(base.part_files(spark, d))


@query("top_cut", with_("part_files") + f" select {CUT.format(c='fanin', t='part_files', m=1)} as cut")
def top_cut(spark, d):
    return D.top_cut(base.part_files(spark, d), "fanin")


@query("unreached", with_("sup", "heavy") + """ select path, district, count(*) as out_edges from heavy join sup on file_id = src
where src not in (select dst from heavy) group by path, district""")
def unreached(spark, d):
    return D.unreached(base.sup(spark, d), base.heavy_arcs(spark, d))


@query("hidden_coupling", with_("cf", "sup", "heavy") + COCHANGE + """,
li as (select distinct least(src, dst) as a, greatest(src, dst) as b from heavy),
h as (select x.path as left_path, y.path as right_path, cnt, weight, x.district as dx, y.district as dy,
    regexp_extract(x.path, '^(.*)/', 1) = regexp_extract(y.path, '^(.*)/', 1) as same_dir
  from co join sup x on x.file_id = co.a join sup y on y.file_id = co.b
  where cnt >= 3 and weight >= 0.03::double and not exists (select 1 from li where li.a = co.a and li.b = co.b))
select left_path, right_path, cnt, round_even(weight, 6) as weight,
  row_number() over (order by same_dir, dx = dy, weight desc, cnt desc, left_path, right_path)::int as rank from h""")
def hidden_coupling(spark, d):
    return D.hidden_coupling(base.sup(spark, d), S.cochange_pairs(base.commit_files(spark, d)), base.heavy_arcs(spark, d), min_weight=0.03)


@query("district_bundles", BUNDLES + " select * from bu")
def district_bundles(spark, d):
    return D.bundles(base.sup(spark, d), base.arcs(spark, d))


@query("district_cycles", with_("sup", "heavy") + """,
e12 as (select src, dst from heavy),
bu as (select x.district as src, y.district as dst, count(*) as n from e12 e join sup x on x.file_id = e.src join sup y on y.file_id = e.dst where x.district <> y.district group by all),
r as (select src, dst from bu union select r.src, bu.dst from r join bu on bu.src = r.dst),
m as (select p.src as node, p.dst as other from r p join r q on p.src = q.dst and p.dst = q.src),
c as (select node, least(node, min(other)) as component from m group by node having count(*) filter (where other <> node) > 0),
f as (select x.component, count(*) as bundles, sum(n)::bigint as imports from bu join c x on x.node = src join c y on y.node = dst where x.component = y.component group by x.component)
select c.component, string_agg(node::varchar, ',' order by node) as districts, bundles, imports from c join f on f.component = c.component group by c.component, bundles, imports""")
def district_cycles(spark, d):
    return D.district_cycles(base.sup(spark, d), base.heavy_arcs(spark, d))


@query("debt_diff", """with b as (select o_custkey as path, count(*) as n, sum(o_totalprice) as price from orders where o_orderdate <= '1998-01-01' group by 1),
a as (select o_custkey as path, count(*) as n, sum(o_totalprice) as price from orders where o_orderdate > '1998-01-01' group by 1)
select coalesce(b.path, a.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' else 'shared' end as status,
  a.n - b.n as n_delta, round_even(a.price - b.price, 2) as price_delta from b full join a on a.path = b.path""")
def debt_diff(spark, d):
    o = table(spark, d, "orders")
    side = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price"))
    out = D.report_diff(side(f"o_orderdate <= timestamp '{EPOCH}'"), side(f"o_orderdate > timestamp '{EPOCH}'"), ["path"], ["n", "price"])
    return rounded(out, "price_delta", digits=2)


@query("pinned_relabel", with_("sup", "heavy") + """,
bs as (select file_id, district from sup where file_id % 7 <> 0),
nw as (select file_id from sup where file_id % 7 = 0),
si as (select src, dst from heavy union all select dst, src from heavy),
w as (select si.src as file_id, bs.district, count(*) as n from si join nw on nw.file_id = si.src join bs on bs.file_id = si.dst group by all),
r as (select *, row_number() over (partition by file_id order by n desc, district) as rn from w)
select s.file_id, coalesce(bs.district, r.district, (select max(district) + 1 from bs))::int as district,
  case when bs.district is not null then 'kept' when r.district is not null then 'placed' else 'unplaced' end as status
from sup s left join bs using (file_id) left join r on r.file_id = s.file_id and r.rn = 1""")
def pinned_relabel(spark, d):
    files = base.sup(spark, d).select("file_id", "district")
    return D.pinned_districts(files, files.where("file_id % 7 <> 0"), base.heavy_arcs(spark, d))


@query("debt_filters", with_("part_files") + HOT + """,
h as (select 'hotspot' as kind, path, churn as district, row_number() over (order by score desc, file_id)::int as rank from sc, hc where score >= cut)
select * from h where path like 'src/Brand#1%' and rank <= (select rank from h where path like 'src/Brand#1%' order by rank limit 1 offset 4)""")
def debt_filters(spark, d):
    found = D.hotspots(base.part_files(spark, d)).select(F.lit("hotspot").alias("kind"), "path", F.col("churn").alias("district"), "rank")
    return D.filtered(found, ["hotspot"], "src/Brand#1", top=5)


# ---- check


@query("check_cross_edges", with_("sup") + """,
s as (select l_suppkey as src, l_shipdate as ts, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as dst from lineitem),
g as (select ts > timestamp '1998-01-01' as head, least(src, dst) as a, greatest(src, dst) as b, count(*)::double as weight from s where dst is not null and src <> dst group by all),
x as (select g.* from g join sup p on p.file_id = a join sup q on q.file_id = b where p.district <> q.district and weight >= 6)
select a, b, weight, 'added' as change, case when exists (select 1 from g where not g.head and g.a = x.a and g.b = x.b) then 'prune' else 'edge' end as cause
  from x where head and not exists (select 1 from x y where not y.head and y.a = x.a and y.b = x.b)
union all
select a, b, weight, 'removed', case when exists (select 1 from g where g.head and g.a = x.a and g.b = x.b) then 'prune' else 'edge' end
  from x where not head and not exists (select 1 from x y where y.head and y.a = x.a and y.b = x.b)""")
def check_cross_edges(spark, d):
    files, seq = base.sup(spark, d), base.sequence(spark, d)
    side = lambda c: seq.where(c).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("weight"))
    b, h = side(f"ts <= timestamp '{EPOCH}'"), side(f"ts > timestamp '{EPOCH}'")
    return C.cross_edge_changes(C.cross_edges(b.where("weight >= 6"), files), C.cross_edges(h.where("weight >= 6"), files), b, h)


CHANGES = """,
ch as (select case file_id % 4 when 0 then 'added' when 1 then 'modified' when 2 then 'deleted' else 'renamed' end as status,
    case when file_id % 4 <> 0 then path end as f, case when file_id % 4 = 0 then path when file_id % 4 = 3 then path || '.new' end as t from sup where file_id % 3 = 0)"""


def _changes(spark, d):
    p = base.sup(spark, d).where("file_id % 3 = 0")
    k = F.col("file_id") % 4
    status = F.when(k == 0, "added").when(k == 1, "modified").when(k == 2, "deleted").otherwise("renamed")
    return p.select(
        status.alias("status"), F.when(k != 0, F.col("path")).alias("from_path"),
        F.when(k == 0, F.col("path")).when(k == 3, F.concat("path", F.lit(".new"))).alias("to_path"),
    )


@query("check_identity", with_("sup") + CHANGES + """,
hd as (select case when ch.t is not null then ch.t else sup.path end as path from sup left join ch on ch.f = sup.path and ch.status = 'renamed' where file_id % 4 <> 2 or file_id % 3 <> 0)
select hd.path, coalesce(ch.f, hd.path) as identity, sup.district from hd left join ch on ch.t = hd.path and ch.status = 'renamed' left join sup on sup.path = coalesce(ch.f, hd.path)""")
def check_identity(spark, d):
    files, changes = base.sup(spark, d), _changes(spark, d)
    gone = (F.col("file_id") % 4 == 2) & (F.col("file_id") % 3 == 0)
    moved = (F.col("file_id") % 4 == 3) & (F.col("file_id") % 3 == 0)
    head = files.where(~gone).select(F.when(moved, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"))
    ids = C.identities(head, changes)
    return ids.join(files.select(F.col("path").alias("identity"), "district"), "identity", "left").select("path", "identity", "district")


@query("check_changed_files", with_("sup") + CHANGES + """
select case when status in ('added', 'renamed') then t else f end as path, case when status = 'renamed' then f end as base_path, status,
  case when status = 'added' and file_id % 8 = 0 then null else district end as district, (status = 'added' and file_id % 8 <> 0) as placed,
  case when status = 'added' and file_id % 8 = 0 then 'unsupported_language' end as reason
from ch join sup on sup.path = coalesce(f, t)""")
def check_changed_files(spark, d):
    files = base.sup(spark, d)
    known = files.where("not (file_id % 4 = 0 and file_id % 3 = 0)").select("path", "district")
    head = files.where("file_id % 8 <> 0 or file_id % 3 <> 0").select("path", "district")
    return C.changed_files(_changes(spark, d), known, head)


@query("threshold_replay", """with m as (select date_trunc('month', o_orderdate) as mo, count(distinct o_orderpriority) as districts, -count(*) / 100000.0::double as dq from orders group by 1),
t as (select * from (values (2), (4), (5)) a(max_districts), (values (0.0005::double), (0.001::double), (0.002::double)) b(max_dq))
select max_districts, max_dq, count(*) filter (where districts > max_districts or dq < -max_dq) as fired, count(*) as total from m, t group by all""")
def threshold_replay(spark, d):
    o = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("mo"))
    rows = o.agg(F.count_distinct("o_orderpriority").alias("districts"), (-F.count("*") / F.lit(100000.0)).alias("dq"))
    return E.fire_rates(rows, [2, 4, 5], [0.0005, 0.001, 0.002])


# ---- names, searches, overviews

SEGMENTS = """with f as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as district, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) as path from pages),
sg as (select district, path, list_filter(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), lambda s: s not in ('src', 'lib', 'pkg', 'internal', 'packages', 'core', 'app', 'python')) as s,
  list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) as every from f),
df as (select segment, count(*) as df from (select path, unnest(list_distinct(every)) as segment from sg) group by 1),
sp as (select district, path, unnest(s) as segment, generate_subscripts(s, 1) - 1 as depth from sg),
sc as (select district, segment, sum(1.0::double / (1.0::double + depth * 0.4::double) * ln(((select count(*) from f) + 1)::double / (df + 1))) as raw, min((path, depth)) as first
  from sp join df using (segment) where df <= 0.6::double * (select count(*) from f) group by all),
tr as (select district, segment, round_even(raw, 6) as score, row_number() over (partition by district order by round_even(raw, 6) desc, first)::int as rank from sc where raw > 0.08)"""


def url_files(spark, d):
    return table(spark, d, "pages").select(
        F.col("page_id").alias("file_id"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("district"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path")
    )


@query("segment_idf_terms", SEGMENTS + " select * from tr")
def segment_idf_terms(spark, d):
    return N.ranked_terms(url_files(spark, d))


@query("segment_frequency", SEGMENTS + " select * from df")
def segment_frequency(spark, d):
    return N.segment_frequency(url_files(spark, d))


@query("segment_idf_names", SEGMENTS + """ select a.district, left(case when b.score > 0.55 * a.score then a.segment || ' & ' || b.segment else a.segment end, 32) as name
from tr a left join tr b on a.district = b.district and b.rank = 2 where a.rank = 1""")
def segment_idf_names(spark, d):
    return N.proposed_names(N.ranked_terms(url_files(spark, d)))


@query("unique_names")
def unique_names(spark, d):
    files = url_files(spark, d)
    return N.unique_names(N.ranked_terms(files), files.groupBy("district").agg(F.count("*").alias("size")))


@query("search_ranked", with_("part_files") + """,
st as (select *, lower(regexp_extract(path, '([^/]+?)(?:\\.[^./]*)?$', 1)) as stem from part_files),
sc as (select file_id as id, path as name, (case when stem = 'red' then -1000 when starts_with(stem, 'red') then 0 when contains(lower(path), 'red') then 100 end) - fanin as score from st)
select 'file' as kind, name, id, score, row_number() over (order by score, id)::int as rank from sc where score is not null order by score, id limit 14""")
def search_ranked(spark, d):
    return W.search_hits(base.part_files(spark, d), None, "red")


@query("district_search", """with x as (select n_nationkey as district, n_name as name, count(s_suppkey) as size from nation left join supplier on s_nationkey = n_nationkey group by all),
t as (select district, name, size, case when lower(name) = 'united' then 0 when starts_with(lower(name), 'i') then 1 when regexp_matches(lower(name), '(^|[^a-z0-9])i') then 2 when contains(lower(name), 'i') then 3 end as tier from x)
select district, name, tier from t where tier is not null order by tier, size desc, district limit 5""")
def district_search(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("district")).agg(F.count("*").alias("size"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("district"), F.col("n_name").alias("name"))
    return W.district_hits(n.join(s, "district", "left").withColumn("size", F.coalesce("size", F.lit(0))), "i")


@query("ranked_neighbours", with_("heavy") + """,
fi as (select dst as file_id, count(*) as fanin from heavy group by 1),
n as (select dst as file_id from heavy where src = 1 union select src from heavy where dst = 1)
select file_id, coalesce(fanin, 0) as fanin, row_number() over (order by coalesce(fanin, 0) desc, file_id)::int as rank from n left join fi using (file_id) order by rank limit 8""")
def ranked_neighbours(spark, d):
    thick = base.heavy_arcs(spark, d)
    fan = thick.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("fanin"))
    files = base.sup(spark, d).select("file_id").join(fan, "file_id", "left").withColumn("fanin", F.coalesce("fanin", F.lit(0)).cast("long"))
    return W.ranked_neighbours(thick, files, 1, 8)


@query("roads_topn", BUNDLES + """,
t as (select * from bu order by n desc, src, dst limit 12),
s as (select *, src as d from bu union all select *, dst from bu),
o as (select *, row_number() over (partition by d order by n desc, src, dst) as rn from s)
select src, dst, n from t union select src, dst, n from o where rn <= 2""")
def roads_topn(spark, d):
    return W.selected_flows(D.bundles(base.sup(spark, d), base.arcs(spark, d)))


@query("layer_overview", with_("part_files") + """ select substr(path, 5, 7) as district, count(*) as files, sum(churn)::bigint as churn, sum(churn) / count(*) as churn_per_file,
median(complexity)::double as median_complexity, count(distinct regexp_extract(path, '^src/([^/]*)', 1)) as packages from part_files group by 1 having count(*) >= 10""")
def layer_overview(spark, d):
    files = base.part_files(spark, d).withColumn("district", F.substring("path", 5, 7))
    return W.layer_overview(files)


@query("hubs", with_("part_files") + """,
h as (select file_id, fanin, regexp_extract(path, '([^/]*)$', 1) as base, path from part_files where fanin >= 1000)
select file_id, fanin, row_number() over (order by fanin desc, file_id)::int as rank,
  case when count(*) over (partition by base) > 1 then list_extract(string_split(path, '/'), -2) || '/' || base else base end as shown from h""")
def hubs(spark, d):
    return W.hubs(base.part_files(spark, d), 1000)


@query("blast_radius", """select l_partkey as sym_id, count(distinct l_suppkey) as users, count(distinct s_nationkey) as districts
from lineitem join supplier on s_suppkey = l_suppkey group by 1""")
def blast_radius(spark, d):
    uses = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sym_id"), F.col("l_suppkey").alias("file_id"))
    return W.blast_radius(uses, base.sup(spark, d))


@query("district_index", with_("part_files") + """,
g as (select *, path[5:11] as district, regexp_extract(path, '^(.*)/', 1) as dir from part_files),
t as (select district, path as top_file from (select *, row_number() over (partition by district order by fanin desc, file_id) as rn from g) where rn = 1),
n as (select district, dir, count(*) as n from g group by all),
r as (select *, sum(n) over (partition by district) as files, row_number() over (partition by district order by n desc, dir) as rn from n)
select district, files::bigint as files, top_file, case when n >= 0.4 * files then dir end as directory from r join t using (district) where rn = 1""")
def district_index(spark, d):
    return W.district_index(base.part_files(spark, d).withColumn("district", F.substring("path", 5, 7)))


@query("package_groups", with_("part_files") + """,
g as (select regexp_extract(path, '^(.*)/', 1) as package, count(*) as files from part_files group by 1),
r as (select *, row_number() over (order by files desc, package) as rn from g)
select case when rn <= 10 then package else 'other' end as package, sum(files)::bigint as files from r group by 1""")
def package_groups(spark, d):
    return W.package_groups(base.part_files(spark, d))


# ---- overlays and organizations

SPEC_ROWS = [
    ("area", "asia", 0, "ASIA/**", None),
    ("area", "china", 0, "ASIA/CHINA/*", None),
    ("area", "none", 0, "NOWHERE/*", None),
    ("stop", "walk", 0, "EUROPE/FRANCE/Supplier#1", None),
    ("stop", "walk", 1, "MISSING/FILE", None),
    ("note", "why", 0, "district:CHINA", None),
    ("note", "gone", 0, "district:ATLANTIS", None),
]


@query("lens_resolve", with_("sup") + """,
sp(section, label, pos, spec, pat) as (values ('area', 'asia', 0, 'ASIA/**', '^ASIA(?:/.*)?$'), ('area', 'china', 0, 'ASIA/CHINA/*', '^ASIA/CHINA/[^/]*$'),
  ('area', 'none', 0, 'NOWHERE/*', '^NOWHERE/[^/]*$'), ('stop', 'walk', 0, 'EUROPE/FRANCE/Supplier#1', null), ('stop', 'walk', 1, 'MISSING/FILE', null),
  ('note', 'why', 0, 'district:CHINA', null), ('note', 'gone', 0, 'district:ATLANTIS', null)),
c as (select section, label, pos, spec,
  case when pat is not null then (select count(*) from sup where regexp_matches(path, pat))
    when spec like 'district:%' then (select count(distinct district_name) from sup where 'district:' || district_name = spec)
    when spec like '%#%' then 0
    else (select count(*) from sup where path = spec) end as targets, pat from sp)
select section, label, pos, spec, targets, case when targets = 0 then case when pat is not null then 'empty_glob' when spec like 'district:%' then 'unknown_district'
    when spec like '%#%' then 'unknown_symbol' else 'missing_path' end when targets > 1 and pat is null then 'ambiguous' else 'resolved' end as status from c""")
def lens_resolve(spark, d):
    return V.resolve(V.table(spark, SPEC_ROWS), base.sup(spark, d))


@query("lens_diff", with_("sup") + """,
a as (select 'area' as section, lang as label, path as spec, file_id % 5 <> 0 as ok from sup where file_id % 3 <> 0),
b as (select 'area' as section, lang as label, path as spec, file_id % 7 <> 0 as ok from sup where file_id % 4 <> 0)
select coalesce(a.section, b.section) as section, coalesce(a.label, b.label) as label, coalesce(a.spec, b.spec) as spec,
  case when a.ok is null then case when b.ok then 'added' else 'broken' end when b.ok is null then 'removed' when not a.ok and b.ok then 'added'
    when a.ok and not b.ok then 'broken' else 'shared' end as change
from a full join b on a.section = b.section and a.label = b.label and a.spec = b.spec""")
def lens_diff(spark, d):
    s = base.sup(spark, d)
    side = lambda keep, ok: s.where(keep).select(F.lit("area").alias("section"), F.col("lang").alias("label"), F.col("path").alias("spec"), F.when(F.expr(ok), "resolved").otherwise("missing_path").alias("status"), F.lit(0).alias("pos"))
    return V.changes(side("file_id % 3 <> 0", "file_id % 5 <> 0"), side("file_id % 4 <> 0", "file_id % 7 <> 0"))


@query("lens_hops", """with o as (select o_custkey::varchar as label, o_orderkey::varchar as spec, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders)
select label, pos, spec as from_spec, to_spec from (select *, lead(spec) over (partition by label order by pos) as to_spec from o) where to_spec is not null""")
def lens_hops(spark, d):
    o = table(spark, d, "orders").select(
        F.lit("stop").alias("section"), F.col("o_custkey").cast("string").alias("label"), F.col("o_orderkey").cast("string").alias("spec"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("pos"),
    )
    return V.hops(o)


ORG = """with pr as (select 'cargo' as ecosystem, replace(p_name || '_' || (p_partkey % 1000), '_', '-') as key, p_brand as member, min((p_type, p_size::varchar)) as m from part where p_partkey % 3 <> 0 group by all),
dc as (select p_brand as member, 'cargo' as ecosystem, p_name || '_' || (p_partkey % 1000) as name, case when p_partkey % 5 = 0 then 'path' else 'version' end as pin_kind, p_size::varchar as pin_value from part),
c as (select ecosystem, key, count(*) as n, min(member) as only_member from pr group by all)
"""


def _org(spark, d):
    p = table(spark, d, "part").withColumn("p_name", F.concat_ws("_", "p_name", F.col("p_partkey") % 1000))
    provided = p.where("p_partkey % 3 <> 0").select(
        F.col("p_brand").alias("member"), F.lit("cargo").alias("ecosystem"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_type").alias("file")
    )
    declared = p.select(
        F.col("p_brand").alias("member"), F.lit("cargo").alias("ecosystem"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 5 == 0, "path").otherwise("version").alias("pin_kind"), F.col("p_size").cast("string").alias("pin_value"),
    )
    return O.resolve(declared, provided)


@query("org_resolve", ORG + """ select dc.member, dc.ecosystem, dc.name, dc.pin_kind, dc.pin_value,
  case when o.member is not null then 'self' when c.n is null then case when pin_kind = 'path' then 'unresolved' else 'external' end when c.n = 1 then 'edge' else 'ambiguous' end as outcome,
  case when o.member is null and c.n = 1 then c.only_member end as target
from dc left join pr o on o.key = replace(dc.name, '_', '-') and o.member = dc.member left join c on c.key = replace(dc.name, '_', '-')""")
def org_resolve(spark, d):
    return _org(spark, d).select("member", "ecosystem", "name", "pin_kind", "pin_value", "outcome", "target")


@query("pin_judge", ORG + """ select dc.pin_kind, case when dc.pin_kind = 'path' then 'unjudged' when t.m[2] = dc.pin_value then 'match' else 'skew' end as pin_status, count(*) as n
from dc left join pr o on o.key = replace(dc.name, '_', '-') and o.member = dc.member join c on c.key = replace(dc.name, '_', '-') and c.n = 1 join pr t on t.key = c.key
where o.member is null group by all""")
def pin_judge(spark, d):
    edges = _org(spark, d).where("outcome = 'edge'")
    members = edges.select("target", F.sha1(F.col("target").cast("binary")).alias("commit")).distinct()
    return O.judged(edges, members).groupBy("pin_kind", "pin_status").agg(F.count("*").alias("n"))


# ---- history


@query("latest_per_group", """select o_custkey, o_orderkey, o_orderdate from orders o where not exists (select 1 from orders n where n.o_custkey = o.o_custkey
  and (n.o_orderdate > o.o_orderdate or (n.o_orderdate = o.o_orderdate and n.o_orderkey > o.o_orderkey)))""")
def latest_per_group(spark, d):
    return H.newest_by_absence(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("latest_by_rank", """select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1""")
def latest_by_rank(spark, d):
    return H.newest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("retention_prune", """select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3 as keep from orders""")
def retention_prune(spark, d):
    return H.retained(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_orderkey", "keep")


@query("point_lookup", "select o_orderkey, o_totalprice from orders where o_custkey = 7 and o_orderstatus = 'F'")
def point_lookup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("string").alias("slug"), F.col("o_orderstatus").alias("commit_sha"))
    return H.point_lookup(o, "7", "F").select("o_orderkey", "o_totalprice")


@query("warm_start_source", """select o_orderkey from orders where o_custkey = 7 order by (o_orderpriority = '1-URGENT') desc, o_orderdate desc, o_orderkey desc limit 1""")
def warm_start_source(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("slug"), F.col("o_orderpriority").alias("branch"), F.col("o_orderdate").alias("indexed_at"), F.col("o_orderkey").alias("commit_sha")
    )
    return H.warm_start_source(o, "7", "1-URGENT").select(F.col("commit_sha").alias("o_orderkey"))


@query("top256", "select event_id, ts from events order by ts desc, event_id desc limit 256")
def top256(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.col("ts").alias("completed_at"), F.col("event_id").alias("job_id"))
    return H.recent_timings(e).select("event_id", "ts")


@query("json_jobs", """select event_id as job_id from events where event_type like 'cl%' and json_extract_string(props, '$.k') = '3'""")
def json_jobs(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("slug"), F.col("props").alias("spec_json"))
    return H.json_jobs(e, "cl", "k", "3")


@query("provenance_diff", """with b as (select doc_id // 2 as path, sha256(text) as old from documents where doc_id % 2 = 0),
a as (select doc_id // 2 + 40 as path, sha256(text) as new from documents where doc_id % 2 = 1 or doc_id < 200 group by all),
a1 as (select path, min(new) as new from a group by path),
j as (select coalesce(b.path, a1.path) as path, old, new from b full join a1 on a1.path = b.path),
g as (select distinct old from j where new is null)
select path, case when new is null then 'deleted' when old is null then case when new in (select old from g) then 'renamed' else 'added' end
  when old = new then 'unchanged' else 'changed' end as change from j""")
def provenance_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    half = F.floor(F.col("doc_id") / 2)
    before = docs.where("doc_id % 2 = 0").select(half.alias("path"), "digest")
    after = docs.where("doc_id % 2 = 1 or doc_id < 200").select((half + 40).alias("path"), "digest").groupBy("path").agg(F.min("digest").alias("digest"))
    return H.provenance(before, after)


@query("cache_misses", """with f as (select source as context, doc_id as path, sha256(text) as digest from documents),
c as (select source as context, doc_id as path, sha256(case when doc_id % 3 = 0 then text else text || '.' end) as digest from documents where doc_id % 2 = 0)
select context, path, digest from f where not exists (select 1 from c where c.context = f.context and c.path = f.path and c.digest = f.digest)""")
def cache_misses(spark, d):
    docs = table(spark, d, "documents")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    files = docs.select(F.col("source").alias("context"), F.col("doc_id").alias("path"), sha(F.col("text")).alias("digest"))
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(".")))
    cache = docs.where("doc_id % 2 = 0").select(F.col("source").alias("context"), F.col("doc_id").alias("path"), sha(changed).alias("digest"))
    return H.cache_misses(files, cache)


@query("lru_eviction", """select doc_id as key, (select sum(n_chars) from documents) - coalesce(sum(n_chars) over (order by n_chars, doc_id rows between unbounded preceding and 1 preceding), 0) > 1000000 as evict from documents""")
def lru_eviction(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), F.col("n_chars").alias("last_used"))
    return H.evicted(docs, 1_000_000)


@query("freshness", """with s as (select o_custkey as repo, o_orderkey as c, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders),
h as (select c_custkey as repo, case when c_custkey % 9 = 0 then null else (select max(o_orderkey) from orders where o_custkey = c_custkey) end as head, c_custkey % 5 = 0 as dirty from customer)
select h.repo, case when head is null and h.repo % 9 = 0 then 'missing' when head is null then 'missing' when s.c is null then 'none' when s.c = head and not dirty then 'fresh' else 'stale' end as state
from h left join s on s.repo = h.repo and s.rn = 1""")
def freshness(spark, d):
    o = table(spark, d, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    snaps = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit_sha"), F.row_number().over(order).alias("sequence"))
    last = o.groupBy(F.col("o_custkey").alias("repo")).agg(F.max("o_orderkey").alias("m"))
    heads = table(spark, d, "customer").select(F.col("c_custkey").alias("repo")).join(last, "repo", "left")
    heads = heads.select("repo", F.when(F.col("repo") % 9 != 0, F.col("m")).alias("head"), (F.col("repo") % 5 == 0).alias("dirty"))
    return H.freshness(snaps, heads)


@query("job_latest_stage", "select user_id as job, max_by(event_type, (ts, event_id)) as stage, count(*) as events from events group by 1")
def job_latest_stage(spark, d):
    return H.latest_stage(table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "ts", "event_id"))


@query("eta_factors", """select event_type as stage, round_even((sum(least(greatest(value / 50, 0.5::double), 2.0::double)) + 3) / (count(*) + 3), 6) as factor from events group by 1""")
def eta_factors(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("observed"), F.lit(50.0).alias("predicted"))
    return rounded(H.eta_factors(e), "factor")


LOGLOG = """with p as (select o_orderkey, any_value(o_totalprice) as y, count(*) as x from orders join lineitem on l_orderkey = o_orderkey group by 1)
select round_even(regr_slope(ln(y), ln(x)), 6) as slope, round_even(regr_intercept(ln(y), ln(x)), 6) as intercept from p"""


@query("loglog_fit", LOGLOG)
def loglog_fit(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("x"))
    p = table(spark, d, "orders").join(n, "o_orderkey").groupBy("o_orderkey").agg(F.first("o_totalprice").alias("y"), F.max("x").alias("x"))
    return rounded(H.loglog_fit(p, "y", "x"), "slope", "intercept")


@query("upsert", """select o_orderkey, case when o_orderkey % 3 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 2 = 0
union all select o_orderkey, o_totalprice + 1 from orders where o_orderkey % 3 = 0 and o_orderkey % 2 <> 0""")
def upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return H.upserted(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


# ---- evaluation


@query("quantile7", """select l_returnflag, round_even(quantile_cont(l_extendedprice, 0.1), 4) as p10, round_even(quantile_cont(l_extendedprice, 0.5), 4) as p50, round_even(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem group by 1""")
def quantile7(spark, d):
    return rounded(E.quantile7(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9]), "p10", "p50", "p90", digits=4)


@query("nearest_rank", """select l_returnflag, l_extendedprice as value from (select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice) as rn,
  count(*) over (partition by l_returnflag) as n from lineitem) where rn = greatest(1, ceil(90 * n / 100.0))""")
def nearest_rank(spark, d):
    return E.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 90)


@query("counter_mode", """select user_id, event_type as mode from (select *, row_number() over (partition by user_id order by n desc, first) as rn from (
  select user_id, event_type, count(*) as n, min(event_id) as first from events group by all)) where rn = 1""")
def counter_mode(spark, d):
    return E.first_mode(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("band_percentiles", """select case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as band, round_even(quantile_cont(p_retailprice, 0.1), 4) as p10,
  round_even(quantile_cont(p_retailprice, 0.5), 4) as p50, round_even(quantile_cont(p_retailprice, 0.9), 4) as p90 from part group by 1""")
def band_percentiles(spark, d):
    band = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return rounded(E.quantile7(table(spark, d, "part").withColumn("band", band), ["band"], "p_retailprice", [0.1, 0.5, 0.9]), "p10", "p50", "p90", digits=4)


@query("pearson_spearman", """with r as (select l_returnflag, l_quantity as x, l_extendedprice as y,
  rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as rx,
  rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2 as ry from lineitem)
select l_returnflag, round_even(corr(x, y), 6) as pearson, round_even(corr(rx, ry), 6) as spearman from r group by 1""")
def pearson_spearman(spark, d):
    return E.correlations(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


PAIRSETS = with_("heavy") + """,
h as (select src as a, dst as b from heavy),
o as (select src as a, dst as b from (select *, row_number() over (partition by src order by n desc, dst) as rn from e) where rn <= 5 and (src + dst) % 3 <> 0)"""


def _pairs(spark, d):
    ends = lambda e: e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return ends(base.heavy_arcs(spark, d)), ends(base.heavy_arcs(spark, d, 5).where("(src + dst) % 3 <> 0"))


@query("set_compare", PAIRSETS + """, j as (select h.a as ha, o.a as oa from h full join o on h.a = o.a and h.b = o.b),
k as (select count(ha) as hand, count(oa) as other, count(*) filter (where ha is not null and oa is not null) as "both", count(*) filter (where oa is null) as hand_only, count(*) filter (where ha is null) as other_only from j)
select *, round_even("both" / hand, 4) as hand_recall, round_even(other_only / other, 4) as new_share from k""")
def set_compare(spark, d):
    return E.set_compare(*_pairs(spark, d))


@query("recall_gate", PAIRSETS + """, k as (select (select count(*) from h) as hand, (select count(*) from (select * from h intersect select * from o)) as found)
select hand, found, round_even(found / hand, 6) as recall, found / hand >= 0.8 as passed from k""")
def recall_gate(spark, d):
    return E.recall_gate(*_pairs(spark, d))


@query("score_pairs", PAIRSETS + """, j as (select h.a as ha, o.a as oa from h full join o on h.a = o.a and h.b = o.b)
select case when ha is not null and oa is not null then 'agreed' when oa is not null then 'new' else 'unknown' end as cause, count(*) as n from j group by 1""")
def score_pairs(spark, d):
    return E.score_pairs(*_pairs(spark, d))


@query("map_stats", with_("sup", "e") + """,
x as (select p.district as ds, q.district as dd from e join sup p on p.file_id = src join sup q on q.file_id = dst),
f as (select ds as district, 1 as i, 0 as c from x where ds = dd union all select ds, 0, 1 from x where ds <> dd union all select dd, 0, 1 from x where ds <> dd)
select s.district, (select count(*) from sup t where t.district = s.district) as files, coalesce(sum(i), 0)::bigint as internal, coalesce(sum(c), 0)::bigint as crossing
from (select distinct district from sup) s left join f using (district) group by s.district""")
def map_stats(spark, d):
    return E.map_stats(base.sup(spark, d), base.arcs(spark, d))


@query("displacement", """with p as (select l_orderkey as id, avg(l_tax) as xa, avg(l_discount) as ya, max(l_tax) as xb, max(l_discount) as yb from lineitem group by 1),
d as (select sqrt(pow(xb - xa, 2) + pow(yb - ya, 2)) as d from p)
select round_even(avg(d), 6) as mean, round_even(quantile_cont(d, 0.5), 6) as median, round_even(quantile_cont(d, 0.9), 6) as p90, round_even(avg(case when d > 0.1 then 1.0::double else 0.0::double end), 6) as moved from d""")
def displacement(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    a = li.agg(F.avg("l_tax").alias("x"), F.avg("l_discount").alias("y"))
    return E.displacement(a, li.agg(F.max("l_tax").alias("x"), F.max("l_discount").alias("y")))


@query("cross_language_mass", with_("sup", "und") + """
select x.lang <> y.lang as crossing, count(*) as edges, round_even(sum(weight) / (select sum(weight) from und), 6) as share
from und join sup x on x.file_id = a join sup y on y.file_id = b group by 1""")
def cross_language_mass(spark, d):
    files = base.sup(spark, d)
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("lang").alias(f"l_{end}"))
    u = base.undirected(spark, d)
    total = u.agg(F.sum("weight").alias("t"))
    out = u.join(at("a"), "a").join(at("b"), "b").crossJoin(F.broadcast(total)).groupBy((F.col("l_a") != F.col("l_b")).alias("crossing"))
    return rounded(out.agg(F.count("*").alias("edges"), (F.sum("weight") / F.max("t")).alias("share")), "share")
