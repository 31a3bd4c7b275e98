"""Import resolution over the driver's tables: parts and suppliers as files, orders as what they state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import imports as I
from ..sources.tables import checkpointed, table
from . import base
from .base import query, with_

# parts as Python files of four projects and a rest, some under src, some packages
PROJECT_FILES = """pf as (select p_partkey, 'pkg' || (p_partkey % 6) || '/' || (case p_partkey % 3 when 0 then 'src/' else '' end) ||
    (case when p_partkey % 5 = 0 then 'u' || (p_partkey % 6) else 'k' || (p_partkey % 13) end) || '/mod' || p_partkey || (case when p_partkey % 11 = 0 then '/__init__.py' else '.py' end) as path,
    case when p_partkey % 6 < 4 then 'pkg' || (p_partkey % 6) else '' end as root from part),
pi as (select *, case when root = '' then path else substr(path, length(root) + 2) end as inner_path from pf),
pd as (select path, root, inner_path, replace(regexp_replace(regexp_replace(inner_path, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') as whole from pi),
mods as (select project, module, min(path) as path from (
  select root as project, whole as module, path from pd union all
  select root, substr(whole, 5), path from pd where starts_with(inner_path, 'src/')) group by all)"""


def project_files(spark, d):
    k = F.col("p_partkey")
    top = F.when(k % 5 == 0, F.concat(F.lit("u"), k % 6)).otherwise(F.concat(F.lit("k"), k % 13))
    end = F.when(k % 11 == 0, "/__init__.py").otherwise(".py")
    path = F.concat(F.lit("pkg"), k % 6, F.lit("/"), F.when(k % 3 == 0, "src/").otherwise(""), top, F.lit("/mod"), k, end)
    return table(spark, d, "part").select(k, path.alias("path"))


def project_modules_of(spark, d):
    return checkpointed(I.project_modules(project_files(spark, d), spark.createDataFrame([(f"pkg{i}",) for i in range(4)], "root string")))


@query("project_modules", "with " + PROJECT_FILES + " select * from mods")
def project_modules(spark, d):
    return project_modules_of(spark, d)


@query("scoped_imports", "with " + PROJECT_FILES + """,
asked as (select distinct 's' || l_suppkey as src, 'pkg' || (l_suppkey % 4) as project,
  case when l_partkey % 5 = 0 then 'u' || (l_partkey % 6) else 'k' || (l_partkey % 13) end || '.mod' || l_partkey as hit from lineitem),
tops as (select distinct string_split(module, '.')[1] as top, project from mods where project <> ''),
owners as (select top, min(project) as owner from tops group by top having count(*) = 1),
m as (select a.*, o.path as p_own, r.path as p_root, case when w.owner <> a.project then x.path end as p_other from asked a
  left join mods o on o.project = a.project and o.module = a.hit left join mods r on r.project = '' and r.module = a.hit
  left join owners w on w.top = string_split(a.hit, '.')[1] left join mods x on x.project = w.owner and x.module = a.hit)
select src, project, hit, coalesce(p_own, p_root, p_other) as dst,
  case when p_own is not null then 'own' when p_root is not null then 'root' when p_other is not null then 'other' end as via from m""")
def scoped_imports(spark, d):
    p = F.col("l_partkey")
    top = F.when(p % 5 == 0, F.concat(F.lit("u"), p % 6)).otherwise(F.concat(F.lit("k"), p % 13))
    asked = table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("pkg"), F.col("l_suppkey") % 4).alias("project"), F.concat(top, F.lit(".mod"), p).alias("hit")
    )
    return I.scoped_imports(asked, project_modules_of(spark, d))


@query("symbol_uses", """with c as (select l_suppkey as src, 'h' || (l_partkey % 40) as head, case when l_linenumber % 2 = 0 then 'a' || (l_partkey % 7) end as attr from lineitem),
b as (select s_suppkey as src, 'h' || k as local, (s_suppkey + k) % 25 as module, case when k % 3 <> 0 then 'n' || (k % 9) end as name from supplier, (select unnest(range(40)) as k))
select distinct c.src, b.module::bigint as dst, coalesce(b.name, c.attr) as name from c join b on b.src = c.src and b.local = c.head where coalesce(b.name, c.attr) is not null and c.src <> b.module""")
def symbol_uses(spark, d):
    li, k = table(spark, d, "lineitem"), F.col("k")
    attr = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("a"), F.col("l_partkey") % 7))
    stated = li.select(F.col("l_suppkey").alias("src"), F.concat(F.lit("h"), F.col("l_partkey") % 40).alias("head"), attr.alias("attr"))
    bound = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    bound = bound.select("src", F.concat(F.lit("h"), k).alias("local"), ((F.col("src") + k) % 25).alias("module"), F.when(k % 3 != 0, F.concat(F.lit("n"), k % 9)).alias("name"))
    return I.symbol_uses(stated, bound)


@query("import_projections", with_("e") + """,
s as (select src, dst, 1.0::double / count(*) over (partition by src, dst % 3) as share from e),
x as (select 'directed' as kind, src as a, dst as b, share from s union all select 'static', least(src, dst), greatest(src, dst), share from s union all select 'fanin', dst, null, share from s)
select kind, a, b, round_even(sum(share), 6) as weight from x group by all""")
def import_projections(spark, d):
    stated = base.arcs(spark, d).withColumn("stmt", F.col("dst") % 3)
    return I.projections(stated).withColumn("weight", F.rint(F.col("weight") * 1e6) / 1e6)


ALIASES = [("", "@/", "src/"), ("apps/a1", "@/", "apps/a1/src/"), ("apps/a1", "@/lib/", "apps/a1/library/"), ("apps/a2/x1", "@app", "apps/a2/x1/main.ts"), ("", "~shared/", "shared/")]


@query("alias_targets", f"""with i as (select distinct 'apps/a' || (p_partkey % 4) || '/x' || (p_partkey % 3) || '/f' || (p_partkey % 9) || '.ts' as src,
  case p_partkey % 5 when 0 then '@/lib/m' || p_size when 1 then '~shared/m' || p_size when 2 then '@app' when 3 then '@/lib/deep/m' || p_size else 'react' end as specifier from part),
al(scope, prefix, target) as (values {", ".join(str(a) for a in ALIASES)}),
r as (select src, specifier, target || substr(specifier, length(prefix) + 1) as path, row_number() over (partition by src, specifier order by length(scope) desc, length(prefix) desc, prefix, target) as rn
  from i join al on (scope = '' or starts_with(src, scope || '/')) and (specifier = prefix or (ends_with(prefix, '/') and starts_with(specifier, prefix)) or starts_with(specifier, prefix || '/')))
select src, specifier, path from r where rn = 1""")
def alias_targets(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    src = F.concat(F.lit("apps/a"), k % 4, F.lit("/x"), k % 3, F.lit("/f"), k % 9, F.lit(".ts"))
    what = (
        F.when(k % 5 == 0, F.concat(F.lit("@/lib/m"), size)).when(k % 5 == 1, F.concat(F.lit("~shared/m"), size)).when(k % 5 == 2, "@app")
        .when(k % 5 == 3, F.concat(F.lit("@/lib/deep/m"), size)).otherwise("react")
    )
    return I.alias_targets(table(spark, d, "part").select(src.alias("src"), what.alias("specifier")), spark.createDataFrame(ALIASES, "scope string, prefix string, target string"))


PACKAGES = """pk as (select 'n' || k as name, 'packages/p' || k as dir, case when k % 2 = 0 then ['dist/index.js', 'src/main.ts'] else ['lib/start.js'] end as entries, k = 3 as excluded from (select unnest(range(5)) as k)),
fl as (select 'packages/p0/src/index.ts' as path union select 'packages/p2/src/main.ts' union select 'packages/p1/src/start.tsx' union
  select distinct 'packages/p' || (p_partkey % 5) || '/' || (case p_partkey % 3 when 0 then 'src/' else '' end) || 'm' || (p_size % 6) || '.ts' from part)"""


@query("package_entries", "with " + PACKAGES + """,
i as (select distinct p_size as src, 'n' || (p_partkey % 5) as name, case p_partkey % 4 when 0 then '' when 1 then 'dist/m' || (p_size % 6) || '.js' when 2 then 'm' || (p_size % 6) else 'nope' end as subpath from part),
st as (select i.*, dir, excluded, case when subpath = '' then list_concat(entries, ['index.ts', 'src/index.ts']) else [subpath, subpath || '.ts', subpath || '.tsx', subpath || '/index.ts'] end as stated from i join pk using (name)),
c as (select src, name, subpath, dir, unnest(stated) as f, generate_subscripts(stated, 1) as pos from st),
en as (select src, name, subpath, arg_min(path, pos) as p from c join fl on path = dir || '/' || f group by all),
mi as (select src, name, subpath, dir, pos, regexp_replace(regexp_replace(f, '^(\\./)?(dist|build|lib|out)/((esm|cjs|types)/)?', 'src/'), '(\\.d)?\\.[mc]?[jt]sx?$', '') as stem from c where regexp_matches(f, '^(\\./)?(dist|build|lib|out)/')),
mc as (select src, name, subpath, dir, pos, j, stem || (case j when 0 then '.ts' when 1 then '.tsx' else '/index.ts' end) as f from mi, (select unnest(range(3)) as j)),
mr as (select src, name, subpath, arg_min(path, pos * 10 + j) as p from mc join fl on path = dir || '/' || f group by all),
fi as (select dir, path from (select dir, path, row_number() over (partition by dir order by len(string_split(path, '/')), path) as rn from pk join fl on starts_with(path, dir || '/') where excluded) where rn = 1)
select st.src, st.name, st.subpath, coalesce(en.p, mr.p, fi.path) as dst, case when en.p is not null then 'entry' when mr.p is not null then 'mirror' when fi.path is not null then 'redirect' end as via
from st left join en on en.src = st.src and en.name = st.name and en.subpath = st.subpath left join mr on mr.src = st.src and mr.name = st.name and mr.subpath = st.subpath left join fi on fi.dir = st.dir""")
def package_entries(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = [(f"n{i}", f"packages/p{i}", ["dist/index.js", "src/main.ts"] if i % 2 == 0 else ["lib/start.js"], i == 3) for i in range(5)]
    packages = spark.createDataFrame(rows, "name string, dir string, entries array<string>, excluded boolean")
    part = table(spark, d, "part")
    files = part.select(F.concat(F.lit("packages/p"), k % 5, F.lit("/"), F.when(k % 3 == 0, "src/").otherwise(""), F.lit("m"), size % 6, F.lit(".ts")).alias("path")).distinct()
    files = files.union(spark.createDataFrame([("packages/p0/src/index.ts",), ("packages/p2/src/main.ts",), ("packages/p1/src/start.tsx",)], "path string"))
    sub = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("dist/m"), size % 6, F.lit(".js"))).when(k % 4 == 2, F.concat(F.lit("m"), size % 6)).otherwise("nope")
    return I.package_entries(part.select(size.alias("src"), F.concat(F.lit("n"), k % 5).alias("name"), sub.alias("subpath")).distinct(), packages, files)


# suppliers as Rust files below modules of nations and regions
CRATE = """sr as (select s_suppkey as k, 'r' || n_regionkey as r, 'n' || n_nationkey as n, n_nationkey % 2 = 0 as flat from supplier join nation on n_nationkey = s_nationkey),
cf as (select 'src/lib.rs' as path union select 'src/' || r || '.rs' from sr union select 'src/' || r || '/' || n || (case when flat then '.rs' else '/mod.rs' end) from sr
  union select 'src/' || r || '/' || n || '/s' || k || '.rs' from sr),
ct as (select distinct 'src/lib.rs' as src, r as name, 'src/' || r || '.rs' as dst from sr
  union select 'src/' || r || '.rs', n, 'src/' || r || '/' || n || (case when flat then '.rs' else '/mod.rs' end) from sr
  union select 'src/' || r || '/' || n || (case when flat then '.rs' else '/mod.rs' end), 's' || k, 'src/' || r || '/' || n || '/s' || k || '.rs' from sr)"""


def crate(spark, d):
    """(files, declared modules) of the crate."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    r, n, k = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("s"), "s_suppkey")
    mid = F.concat(F.lit("src/"), r, F.lit("/"), n, F.when(F.col("n_nationkey") % 2 == 0, ".rs").otherwise("/mod.rs"))
    top, leaf = F.concat(F.lit("src/"), r, F.lit(".rs")), F.concat(F.lit("src/"), r, F.lit("/"), n, F.lit("/"), k, F.lit(".rs"))
    files = s.select(F.explode(F.array(F.lit("src/lib.rs"), top, mid, leaf)).alias("path")).distinct()
    stated = F.array(F.struct(F.lit("src/lib.rs").alias("src"), r.alias("name")), F.struct(top.alias("src"), n.alias("name")), F.struct(mid.alias("src"), k.alias("name")))
    return files, s.select(F.explode(stated).alias("m")).select("m.src", "m.name").distinct()


@query("rust_module_tree", "with " + CRATE + " select * from ct")
def rust_module_tree(spark, d):
    files, declared = crate(spark, d)
    return I.module_files(declared, files)


@query("rust_module_paths", "with " + CRATE + """ select 'crate' as module, 'src/lib.rs' as path union select 'crate::' || r, 'src/' || r || '.rs' from sr
union select 'crate::' || r || '::' || n, 'src/' || r || '/' || n || (case when flat then '.rs' else '/mod.rs' end) from sr union select 'crate::' || r || '::' || n || '::s' || k, 'src/' || r || '/' || n || '/s' || k || '.rs' from sr""")
def rust_module_paths(spark, d):
    files, declared = crate(spark, d)
    return I.module_paths(checkpointed(I.module_files(declared, files)), spark.createDataFrame([("src/lib.rs", "crate")], "path string, crate string"))


@query("rust_uses", with_("e") + ", " + CRATE + """,
pl as (select k, 'src/' || r || '/' || n || '/s' || k || '.rs' as path from sr),
lv as (select distinct x.path as src, dst % 3 as stmt, y.path as dst from e join pl x on x.k = e.src join pl y on y.k = e.dst union
  select x.path, x.k % 3, x.path from pl x),
sh as (select src, dst, 1.0::double / count(*) over (partition by src, stmt) as share from lv)
select src, dst, round_even(sum(share), 6) as share from sh where src <> dst group by all""")
def rust_uses(spark, d):
    paths = checkpointed(rust_module_paths(spark, d))
    at = paths.where(F.col("module").rlike(r"::s\d+$")).select(F.regexp_extract("module", r"::s(\d+)$", 1).cast("long").alias("k"), "module", "path")
    x, y = at.select(F.col("k").alias("src"), F.col("path").alias("p")), at.select(F.col("k").alias("dst"), F.col("module").alias("m"))
    uses = base.arcs(spark, d).join(x, "src").join(y, "dst").select(F.col("p").alias("src"), (F.col("dst") % 3).alias("stmt"), F.concat("m", F.lit("::Item")).alias("path"))
    own = at.select(F.col("path").alias("src"), (F.col("k") % 3).alias("stmt"), F.concat("module", F.lit("::helper")).alias("path"))
    return I.rust_uses(uses.union(own), paths).withColumn("share", F.rint(F.col("share") * 1e6) / 1e6)


@query("coverage_causes", with_("sup", "e") + """,
ed as (select src, dst from e where n = (select max(n) from e)),
st as (select distinct l_suppkey as src from lineitem where l_shipdate > '1998-10-01'),
rs as (select distinct l_suppkey as src from lineitem where l_shipdate > '1998-11-01'),
al as (select * from sup where file_id not in (select src from ed union select dst from ed))
select lang, case when st.src is null then 'no_imports' when rs.src is null then 'unresolved' else 'dropped' end as cause, count(*) as files
from al left join st on st.src = file_id left join rs on rs.src = file_id group by all""")
def coverage_causes(spark, d):
    li, e = table(spark, d, "lineitem"), base.arcs(spark, d)
    top = e.agg(F.max("n").alias("top"))
    files = base.sup(spark, d).select(F.col("file_id").alias("path"), "lang")
    late = lambda day: li.where(F.col("l_shipdate") > F.lit(day).cast("timestamp")).select(F.col("l_suppkey").alias("src"))
    return I.coverage_causes(files, e.join(F.broadcast(top), F.col("n") == F.col("top")), late("1998-10-01"), late("1998-11-01"))


@query("import_outcomes", "with recursive " + PACKAGES + """,
i as (select p_partkey, 'n' || (p_partkey % 7) as name, 'm' || (p_size % 6) || '.ts' as sub from part)
select case when pk.name is null then 'external' when fl.path is not null then 'entry' when excluded then 'redirect' else 'unresolved' end as via, count(*) as imports
from i left join pk using (name) left join fl on fl.path = pk.dir || '/' || i.sub group by 1""")
def import_outcomes(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = [(f"n{i}", f"packages/p{i}", ["dist/index.js"], i == 3) for i in range(5)]
    packages = spark.createDataFrame(rows, "name string, dir string, entries array<string>, excluded boolean")
    part = table(spark, d, "part")
    files = part.select(F.concat(F.lit("packages/p"), k % 5, F.lit("/"), F.when(k % 3 == 0, "src/").otherwise(""), F.lit("m"), size % 6, F.lit(".ts")).alias("path")).distinct()
    files = files.union(spark.createDataFrame([("packages/p0/src/index.ts",), ("packages/p2/src/main.ts",), ("packages/p1/src/start.tsx",)], "path string"))
    asked = part.select(k.alias("src"), F.concat(F.lit("n"), k % 7).alias("name"), F.concat(F.lit("m"), size % 6, F.lit(".ts")).alias("subpath"))
    known = I.package_entries(asked, packages, files)
    outside = asked.join(packages, "name", "left_anti").select(F.lit("external").alias("via"))
    return I.import_outcomes(known.select("via").union(outside))


@query("path_hash")
def path_hash(spark, d):
    """FNV-1a of the member paths of each nation."""
    groups = base.sup(spark, d).groupBy("district").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return groups.select("district", X.path_hashes(F.col("paths")).alias("hash"))


@query("rfc3339_times", "select o_orderkey, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%SZ') as at from orders")
def rfc3339_times(spark, d):
    o = table(spark, d, "orders")
    seconds = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86_400 + F.col("o_orderkey") % 86_400
    return o.select("o_orderkey", X.rfc3339(seconds).alias("at"))


@query("number_texts", """select p_partkey, case when p_size % 2 = 0 then (p_size // 2)::varchar else format('{:.2f}', p_size / 2.0::double) end as fanin,
  round_even(p_size / 50.0::double * 100, 0)::bigint::varchar || '%' as share from part""")
def number_texts(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", X.fanin_text(size / F.lit(2.0), F.lit("python")).alias("fanin"), X.percent_text(size / F.lit(50.0)).alias("share")
    )


@query("git_progress_lines", """select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 3 < 2 then 'Receiving objects' end as stage, case when l_linenumber % 3 < 2 then (l_suppkey % 101)::int end as percent,
  case when l_linenumber % 3 < 2 then l_suppkey::bigint end as done, case when l_linenumber % 3 = 0 then ((l_partkey % 90)::double * 1048576 + 262144)::bigint end as received from lineitem""")
def git_progress_lines(spark, d):
    n = F.col("l_linenumber") % 3
    head = F.concat(F.lit("Receiving objects:  "), F.col("l_suppkey") % 101, F.lit("% ("), F.col("l_suppkey"), F.lit("/"), F.col("l_partkey"), F.lit(")"))
    line = F.when(n == 0, F.concat(head, F.lit(", "), F.col("l_partkey") % 90, F.lit(".25 MiB | 3.10 MiB/s"))).when(n == 1, head).otherwise("done.")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.git_progress(line).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "p.stage", "p.percent", "p.done", "p.received")


@query("workspace_members", """with f as (select distinct 'apps/' || p_size || '/x' as folder, p_size % 2 as k, p_size from part)
select case when k = 0 then folder else 'apps/' || p_size end as folder, (k = 1 and p_size <> 7) as member from f""")
def workspace_members(spark, d):
    size = F.col("p_size")
    folder = F.when(size % 2 == 0, F.concat(F.lit("apps/"), size, F.lit("/x"))).otherwise(F.concat(F.lit("apps/"), size))
    return table(spark, d, "part").select(folder.alias("folder")).distinct().withColumn("member", X.workspace_members(F.col("folder"), ["apps/*", "!apps/7"]))
