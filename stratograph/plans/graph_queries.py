"""Signals, blending, graph and lookup operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blend as B
from ..operators import graph as G
from ..operators import lookup as L
from ..operators import signals as S
from ..sources.tables import checkpointed, table
from . import base
from .base import query, with_


@query("churn", with_("cf") + " select f, count(distinct sha) as churn from cf group by f")
def churn(spark, d):
    return S.churn(base.commit_files(spark, d))


COCHANGE = """,
sz as (select sha from cf group by sha having count(*) between 2 and 40),
bc as (select cf.* from cf join sz using (sha)),
solo as (select f, count(*) as solo from cf group by f),
co as (select a, b, cnt, cnt / least(x.solo, y.solo) as weight
  from (select p.f as a, q.f as b, count(*) as cnt from bc p join bc q on p.sha = q.sha and p.f < q.f group by all having count(*) >= 2) z
  join solo x on x.f = a join solo y on y.f = b where least(x.solo, y.solo) >= 3)"""


@query("cochange", with_("cf") + COCHANGE + " select a, b, cnt, round_even(weight, 6) as weight from co")
def cochange(spark, d):
    return S.cochange_pairs(base.commit_files(spark, d)).withColumn("weight", F.rint(F.col("weight") * 1e6) / 1e6)


def doc_terms(spark, d):
    """(id, term, tf, source) of letters-only words over two letters."""
    words = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("term")
    )
    return checkpointed(words.groupBy("id", "source", "term").agg(F.count("*").alias("tf")))


TERMS = """with t as (
  select id, source, term, count(*) as tf from (
    select doc_id as id, source, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as term from documents) group by all),
n as (select count(*)::double as n from documents),
f as (select term, count(distinct id) as df from t group by term having count(distinct id) >= 2 and count(distinct id) <= 0.5 * (select n from n)),
w as (select id, source, term, (1 + ln(tf)) * ln((select n from n) / df) as w from t join f using (term)),
norm as (select id, sqrt(sum(w * w)) as norm from w group by id),
v as (select w.id, source, term, w / norm as w from w join norm on w.id = norm.id where norm > 0)"""


@query("tfidf_cosine", TERMS + """ select p.id as a, q.id as b, round_even(sum(p.w * q.w), 6) as cosine
from v p join v q on p.term = q.term and p.source = q.source and p.id < q.id group by all having sum(p.w * q.w) > 0.28""")
def tfidf_cosine(spark, d):
    terms = doc_terms(spark, d)
    total = table(spark, d, "documents").count()
    vectors = S.term_vectors(terms.select("id", "term", "tf"), total).join(terms.select("id", "source").distinct(), "id")
    return S.cosine_pairs(vectors, "source").withColumn("cosine", F.rint(F.col("cosine") * 1e6) / 1e6)


@query("tfidf_vectors", TERMS + " select id, count(*) as terms, round_even(max(w), 6) as top from v group by id")
def tfidf_vectors(spark, d):
    vectors = S.term_vectors(doc_terms(spark, d).select("id", "term", "tf"), table(spark, d, "documents").count())
    return vectors.groupBy("id").agg(F.count("*").alias("terms"), (F.rint(F.max("w") * 1e6) / 1e6).alias("top"))


PROX = """list_aggregate(list_transform(range(1, least(len({x}), len({y})) + 1), lambda i: case when list_slice({x}, 1, i) = list_slice({y}, 1, i) then 1 else 0 end), 'sum')"""


def prox_sql(a: str, b: str) -> str:
    x, y = (f"list_slice(string_split({p}, '/'), 1, len(string_split({p}, '/')) - 1)" for p in (a, b))
    return f"coalesce({PROX.format(x=x, y=y)}, 0)::double / greatest(len({x}), len({y}), 1)"


@query("path_proximity", f"""with u as (
  select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) as path from pages)
select p.page_id as a, q.page_id as b, round_even({prox_sql('p.path', 'q.path')}, 6) as proximity
from u p join u q on p.host = q.host and p.page_id < q.page_id""")
def path_proximity(spark, d):
    u = table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path")
    )
    from ..functions.scalar import proximity

    left, right = u.select(F.col("page_id").alias("a"), "host", F.col("path").alias("pa")), u.select(F.col("page_id").alias("b"), "host", F.col("path").alias("pb"))
    return left.join(right, "host").where("a < b").select("a", "b", (F.rint(proximity(F.col("pa"), F.col("pb")) * 1e6) / 1e6).alias("proximity"))


CANDIDATES = with_("cf", "sup", "und") + COCHANGE + f""",
st as (select a, b, weight from und),
pairs as (select a, b from co union select a, b from st),
top as (select s.lang, greatest(coalesce(max(st.weight), 0), 1) as top from sup s left join st on st.a = s.file_id group by s.lang),
c0 as (select p.a, p.b, coalesce(st.weight, 0) / top.top as static_s, least(coalesce(co.weight, 0), 1) as cochange_s,
    {prox_sql('x.path', 'y.path')} as proximity_s, 0.0::double as semantic_s
  from pairs p join sup x on x.file_id = p.a join sup y on y.file_id = p.b join top on top.lang = x.lang
  left join st on st.a = p.a and st.b = p.b left join co on co.a = p.a and co.b = p.b),
c1 as (select *, 0.45::double * static_s + 0.35::double * cochange_s + 0.08::double * proximity_s + 0.12::double * semantic_s as w from c0),
cand as (select a, b, round_even(static_s, 4) as static_s, round_even(cochange_s, 4) as cochange_s, round_even(proximity_s, 4) as proximity_s,
    round_even(semantic_s, 4) as semantic_s, round_even(w, 5) as weight from c1 where w >= 0.02::double)"""


@query("candidate_edges", CANDIDATES + " select * from cand")
def candidates(spark, d):
    co = checkpointed(S.cochange_pairs(base.commit_files(spark, d)))
    static = checkpointed(base.undirected(spark, d))
    none = static.where("false").select("a", "b", F.col("weight").alias("cosine"))
    # masses, blend and floor all read the candidates: they are made once
    return checkpointed(S.assemble(S.candidate_pairs(co, static), base.sup(spark, d), static, co, none))


MASSES = CANDIDATES + """,
mass as (select {m} from cand),
raw as (select a, b, 0.45::double / ms * static_s + 0.35::double / mc * cochange_s + 0.08::double / mp * proximity_s + 0.12::double / me * semantic_s as weight
  from cand, mass),
bl as (select a, b, weight / (select max(weight) from raw) as weight from raw)""".format(
    m=", ".join(f"case when coalesce(sum({c}), 0) = 0 then 1 else sum({c}) end as {n}" for c, n in (("static_s", "ms"), ("cochange_s", "mc"), ("proximity_s", "mp"), ("semantic_s", "me")))
)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.rint(F.col(c) * 10.0**digits) / 10.0**digits for c in cols})


@query("signal_masses", MASSES + " select round_even(ms, 3) as mass_static_s, round_even(mc, 3) as mass_cochange_s, round_even(mp, 3) as mass_proximity_s, round_even(me, 3)::double as mass_semantic_s from mass")
def signal_masses(spark, d):
    return rounded(B.signal_masses(candidates(spark, d)), "mass_static_s", "mass_cochange_s", "mass_proximity_s", "mass_semantic_s", digits=3)


@query("blend_mass", MASSES + " select a, b, round_even(weight, 9) as weight from raw")
def blend_mass(spark, d):
    return rounded(B.blend(candidates(spark, d), rescale=False), "weight", digits=9)


@query("blend_rescaled", MASSES + " select a, b, round_even(weight, 6) as weight from bl")
def blend_rescaled(spark, d):
    return rounded(B.blend(candidates(spark, d)), "weight")


# ranks on weights rounded to 9 digits, so that both engines break ties alike
KEEP = MASSES + """,
q as (select a, b, round_even(weight, 9) as weight from {src}),
ends as (select a as node, * from q union all select b, * from q),
rk as (select *, row_number() over (partition by node order by weight desc, a, b) as rn, max(weight) over (partition by node) as top from ends),
kept as (select distinct a, b from rk where rn <= 14 and weight >= {floor})"""


def steady(df):
    return rounded(df, "weight", digits=9)


@query("prune_top14_absolute", KEEP.format(src="bl", floor="0.02::double") + " select a, b from kept")
def prune_absolute(spark, d):
    return B.prune_absolute(steady(B.blend(candidates(spark, d)))).select("a", "b")


@query("prune_node_relative", KEEP.format(src="bl", floor="0.02::double * top") + " select a, b from kept")
def prune_relative(spark, d):
    return B.prune_node_relative(steady(B.blend(candidates(spark, d)))).select("a", "b")


@query("prune_percentile", KEEP.format(src="bl", floor="(select quantile_cont(weight, 0.1) from q)") + " select a, b from kept")
def prune_percentile(spark, d):
    return B.prune_percentile(steady(B.blend(candidates(spark, d))), 0.1).select("a", "b")


@query("prune_pre_rescale", KEEP.format(src="raw", floor="0.00007752604982072655::double") + " select a, b from kept")
def prune_pre(spark, d):
    return B.keep_top(steady(B.blend(candidates(spark, d), rescale=False)), B.PRE_RESCALE).select("a", "b")


@query("prune_stats", MASSES + " select count(*) as candidates, count(*) filter (where round_even(weight, 9) < 0.02::double) as below_floor, round_even(sum(round_even(weight, 9)), 4) as weight_sum from bl")
def prune_stats(spark, d):
    return rounded(B.prune_stats(steady(B.blend(candidates(spark, d)))), "weight_sum", digits=4)


@query("path_encode", with_("sup", "und") + " select a, b, weight from und")
def path_encode(spark, d):
    files = base.sup(spark, d).select("file_id", "path")
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("path").alias(f"p_{end}"))
    paths = base.undirected(spark, d).join(at("a"), "a").join(at("b"), "b").select(F.col("p_a").alias("a"), F.col("p_b").alias("b"), "weight")
    return B.encoded(paths, files)


@query("fanin_shares", with_("e") + """ select dst, round_even(sum(share), 2) as fanin from (
select src, dst, 1.0::double / count(*) over (partition by src) as share from e) group by dst""")
def fanin_shares(spark, d):
    return S.fan_in(S.import_shares(base.arcs(spark, d)))


@query("descendant_fanin", with_("e") + """,
tree as (select s_suppkey // 2 as parent, s_suppkey as child from supplier where s_suppkey >= 2),
cl as (select parent as top, child as below from tree union select cl.top, tree.child from cl join tree on tree.parent = cl.below),
sh as (select src, dst, 1.0::double / count(*) over (partition by src) as share from e)
select sh.dst, round_even(sum(share), 2) as fanin from sh join cl on cl.top = sh.dst and cl.below = sh.src group by sh.dst""")
def descendant_fanin(spark, d):
    tree = table(spark, d, "supplier").where("s_suppkey >= 2").select(F.floor(F.col("s_suppkey") / 2).alias("parent"), F.col("s_suppkey").alias("child"))
    return S.descendant_fan_in(tree, S.import_shares(base.arcs(spark, d)))


OVERVIEW = with_("sup", "e") + """,
x as (select p.district as ds, q.district as dd from e join sup p on p.file_id = src join sup q on q.file_id = dst where p.district <> q.district),
f as (select district, sum(i)::bigint as i, sum(o)::bigint as o from (
  select ds as district, 0 as i, 1 as o from x union all select dd, 1, 0 from x) group by district),
s as (select district, min(district_name) as name, count(*) as files from sup group by district)
select s.district, name, files, coalesce(i, 0)::bigint as imports_in, coalesce(o, 0)::bigint as imports_out,
  row_number() over (order by files desc, name, s.district)::int as rank from s left join f using (district)"""


@query("overview", OVERVIEW)
def overview(spark, d):
    files = base.sup(spark, d)
    names = files.select("district", F.col("district_name").alias("name")).distinct()
    return L.overview(files, base.arcs(spark, d), names)


@query("deps_limited", with_("sup", "e") + """,
n as (select distinct dst as file_id, 'out' as direction from e where src = 1 union select distinct src, 'in' from e where dst = 1),
r as (select path, direction, row_number() over (partition by direction order by path) as rn, count(*) over (partition by direction) as total from n join sup using (file_id))
select path, direction, total, greatest(total - 25, 0) as omitted from r where rn <= 25""")
def deps_limited(spark, d):
    return L.deps(base.arcs(spark, d), base.sup(spark, d), 1)


@query("where_path", with_("sup") + " select file_id, path, district from sup where path = (select min(path) from sup)")
def where_path(spark, d):
    files = base.sup(spark, d)
    return L.where_path(files, files.agg(F.min("path")).first()[0]).select("file_id", "path", "district")


@query("where_suggest", with_("sup") + " select path, levenshtein(path, 'ASIA/CHINA/Supplier') as distance from (select distinct path from sup) order by distance, path limit 3")
def where_suggest(spark, d):
    return L.nearest_paths(base.sup(spark, d), "ASIA/CHINA/Supplier").withColumn("distance", F.col("distance").cast("long"))


@query("where_qualified", """with recursive sym as (
  select r_regionkey::bigint as sym_id, r_name as name, -1::bigint as parent from region
  union all select 100 + n_nationkey, n_name, n_regionkey from nation
  union all select 1000 + s_suppkey, s_name, 100 + s_nationkey from supplier),
up as (select sym_id, name as local, parent from sym
  union all select up.sym_id, sym.name || '::' || up.local, sym.parent from up join sym on sym.sym_id = up.parent)
select sym_id, local from up where parent = -1""")
def where_qualified(spark, d):
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    rows = (
        region.select(F.col("r_regionkey").cast("long").alias("sym_id"), F.col("r_name").alias("name"), F.lit(-1).cast("long").alias("parent"))
        .union(nation.select((F.col("n_nationkey") + 100).cast("long"), "n_name", F.col("n_regionkey").cast("long")))
        .union(supplier.select(F.col("s_suppkey") + 1000, "s_name", (F.col("s_nationkey") + 100).cast("long")))
    )
    return L.qualified_symbols(rows.withColumn("file_id", F.lit(0))).select("sym_id", "local")


@query("coverage_rollup", with_("sup", "heavy") + """,
hit as (select src as file_id from heavy union select dst from heavy)
select lang, count(*) as total_files, count(*) filter (where hit.file_id is null) as zero_edge_files
from sup left join hit using (file_id) group by rollup(lang)""")
def coverage_rollup(spark, d):
    return L.coverage_by_language(base.sup(spark, d), base.heavy_arcs(spark, d))


@query("weighted_degree", with_("und") + " select node, sum(weight) as degree from (select a as node, weight from und union all select b, weight from und) group by node")
def weighted_degree(spark, d):
    return G.weighted_degree(base.undirected(spark, d))


@query("adjacency", with_("und") + """ select node, list_sort(list(distinct n)) as neighbours from (select a as node, b as n from und union all select b, a from und) group by node""")
def adjacency(spark, d):
    return G.adjacency(base.undirected(spark, d))


PAIRS = with_("sup", "und") + """,
de as (select least(x.district, y.district) as da, greatest(x.district, y.district) as db, sum(weight) as weight
  from und join sup x on x.file_id = a join sup y on y.file_id = b where x.district <> y.district group by all)"""


@query("district_edges", PAIRS + " select * from de")
def district_edges(spark, d):
    return G.district_edges(base.undirected(spark, d), base.sup(spark, d))


@query("roads", PAIRS + " select da, db, round_even(weight / (select max(weight) from de), 3) as strength from de where weight / (select max(weight) from de) > 0.18::double")
def roads(spark, d):
    return G.roads(base.undirected(spark, d), base.sup(spark, d))


@query("classify_districts", with_("sup", "heavy") + """,
hit as (select src as file_id from heavy union select dst from heavy)
select district, count(*) as size, case when count(*) * 100 >= (select count(*) from sup) * 3 then 'mainland'
  when bool_or(hit.file_id is not null) then 'island' else 'unconnected' end as class
from sup left join hit using (file_id) group by district""")
def classify_districts(spark, d):
    return G.classify(base.sup(spark, d), base.heavy_arcs(spark, d), percent=3)


MODULARITY = """,
inn as (select x.district as da, y.district as db, weight from und join sup x on x.file_id = a join sup y on y.file_id = b),
m as (select sum(weight) as m from inn),
k as (select d, sum(k) as k, sum(w) as w from (
  select da as d, weight as k, case when da = db then weight else 0 end as w from inn union all select db, weight, 0 from inn) group by d)
"""


@query("modularity_fixed", with_("sup", "und") + MODULARITY + " select round_even(sum(w / m - 1.1::double * pow(k / (2 * m), 2)), 6) as q from k, m")
def modularity_fixed(spark, d):
    return G.modularity(base.undirected(spark, d), base.sup(spark, d))


@query("place_plurality", with_("sup", "und") + """,
near as (select a as f, b as g, weight from und union all select b, a, weight from und),
w as (select f as file_id, s.district, sum(weight) as weight from near join sup s on s.file_id = g
  where f % 10 = 0 and g % 10 <> 0 group by all),
r as (select *, row_number() over (partition by file_id order by weight desc, district) as rn from w)
select file_id, district, weight from r where rn = 1""")
def place_plurality(spark, d):
    u = base.undirected(spark, d)
    near = u.select(F.col("a").alias("f"), F.col("b").alias("g"), "weight").union(u.select("b", "a", "weight")).where("f % 10 = 0 and g % 10 <> 0")
    w = near.join(base.sup(spark, d).select(F.col("file_id").alias("g"), "district"), "g").groupBy(F.col("f").alias("file_id"), "district").agg(F.sum("weight").alias("weight"))
    return G.place_by_plurality(w)


BUNDLES = with_("sup", "e") + """,
bu as (select x.district as src, y.district as dst, count(*) as n from e join sup x on x.file_id = e.src join sup y on y.file_id = e.dst
  where x.district <> y.district group by all)"""


@query("mutual_pairs", BUNDLES + """ select p.src as a, p.dst as b, case when p.n <= q.n then p.src else p.dst end as lighter_src, p.n as n_ab, q.n as n_ba
from bu p join bu q on p.src = q.dst and p.dst = q.src where p.src < p.dst""")
def mutual_pairs(spark, d):
    from ..operators.debt import bundles

    return G.mutual_pairs(bundles(base.sup(spark, d), base.arcs(spark, d)))


@query("route_bfs", with_("heavy") + """,
w(node, depth) using key (node) as (select 1::bigint, 0 union
  select heavy.dst, w.depth + 1 from w join heavy on heavy.src = w.node where not exists (select 1 from recurring.w seen where seen.node = heavy.dst))
select node, depth from w""")
def route_bfs(spark, d):
    return G.bfs_tree(base.heavy_arcs(spark, d).select("src", "dst", F.col("dst").alias("pos")), 1).select("node", "depth")


def heavy_bundles(spark, d):
    """Of each district the three heaviest bundles: a sparse graph whatever the size of the tables."""
    from ..operators.debt import bundles

    order = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return bundles(base.sup(spark, d), base.arcs(spark, d)).withColumn("rn", F.row_number().over(order)).where("rn <= 3").drop("rn")


@query("reachable_nations", BUNDLES + """,
s as (select src, dst from (select *, row_number() over (partition by src order by n desc, dst) as rn from bu) where rn <= 3),
r as (select src, dst from s union select r.src, s.dst from r join s on s.src = r.dst)
select src, dst from r""")
def reachable_nations(spark, d):
    return G.reachable(heavy_bundles(spark, d))


@query("scc_nations", BUNDLES + """,
s as (select src, dst from (select *, row_number() over (partition by src order by n desc, dst) as rn from bu) where rn <= 3),
r as (select src, dst from s union select r.src, s.dst from r join s on s.src = r.dst),
m as (select p.src as node, p.dst as other from r p join r q on p.src = q.dst and p.dst = q.src)
select node, least(node, min(other)) as component from m group by node having count(*) filter (where other <> node) > 0""")
def scc_nations(spark, d):
    return G.strong_components(heavy_bundles(spark, d))


@query("capitals", with_("sup", "und") + """,
dg as (select node, sum(weight) as degree from (select a as node, weight from und union all select b, weight from und) group by node),
r as (select district, file_id, coalesce(degree, 0) as degree, row_number() over (partition by district order by coalesce(degree, 0) desc, file_id) as rn
  from sup left join dg on node = file_id)
select district, file_id, degree from r where rn = 1""")
def capitals(spark, d):
    return G.capitals(base.sup(spark, d), G.weighted_degree(base.undirected(spark, d)))


@query("betweenness")
def betweenness(spark, d):
    linked = base.undirected(spark, d).select("a", "b", F.lit(1.0).alias("weight"))
    return rounded(G.betweenness(checkpointed(linked)), "betweenness")


@query("feedback_cut")
def feedback_cut(spark, d):
    from ..operators.debt import bundles

    rows = [(r["src"], r["dst"], r["n"]) for r in bundles(base.sup(spark, d), base.arcs(spark, d)).collect()]  # one row a pair of nations
    return spark.createDataFrame(G.feedback_cut(rows), "src int, dst int")


@query("district_jaccard", with_("sup") + """,
b as (select file_id, file_id % 25 as db from sup),
j as (select district as da, db, count(*) as common from sup join b using (file_id) group by all)
select da, db::int as db, common, common / ((select count(*) from sup s where s.district = da) + (select count(*) from b where b.db = j.db) - common) as jaccard from j""")
def district_jaccard(spark, d):
    files = base.sup(spark, d)
    other = files.select("file_id", (F.col("file_id") % 25).cast("int").alias("district"))
    return G.jaccard_pairs(files.select("file_id", "district"), other)


@query("nmi_ari", """with c as (select lang, source, count(*)::double as n from documents group by all),
r as (select lang, sum(n) as n from c group by lang), k as (select source, sum(n) as n from c group by source), t as (select sum(n) as t from c),
h as (select (select -sum(n / t * ln(n / t)) from r, t) as ha, (select -sum(n / t * ln(n / t)) from k, t) as hb,
  (select sum(c.n / t * ln(c.n * t / (r.n * k.n))) from c join r using (lang) join k using (source), t) as mi,
  (select sum(n * (n - 1) / 2) from r) as pa, (select sum(n * (n - 1) / 2) from k) as pb, (select sum(n * (n - 1) / 2) from c) as pc, (select t from t) as t)
select round_even(mi / ((ha + hb) / 2), 6) as nmi,
  round_even((pc - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) as ari from h""")
def nmi_ari(spark, d):
    return G.agreement(table(spark, d, "documents"), "lang", "source")


@query("vector_cosine_pairs", """select p.vec_id as a, q.vec_id as b, round_even(list_cosine_similarity(p.embedding::double[], q.embedding::double[]), 5) as cosine
from embeddings p join embeddings q on p.label = q.label and p.vec_id < q.vec_id and list_cosine_similarity(p.embedding::double[], q.embedding::double[]) > 0.3""")
def vector_cosine_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    norm = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x * x, lambda acc: F.sqrt(acc))
    v = v.withColumn("norm", norm)
    a, b = (v.select(F.col("vec_id").alias(x), "label", F.col("e").alias(f"e{x}"), F.col("norm").alias(f"n{x}")) for x in ("a", "b"))
    dot = F.aggregate(F.zip_with("ea", "eb", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    out = a.join(b, "label").where("a < b").select("a", "b", (dot / (F.col("na") * F.col("nb"))).alias("cosine"))
    return rounded(out.where("cosine > 0.3"), "cosine", digits=5)
