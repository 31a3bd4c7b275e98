"""Sources, versions, packages and repeated thresholds over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import debt as D
from ..operators import evaluation as E
from ..operators import resolve as R
from ..operators import signals as S
from ..sources import repository
from ..sources.tables import table
from . import base
from .base import query, with_

PATHS = """with f as (select (case p_size % 5 when 0 then 'src/' when 1 then 'lib/tests/' when 2 then '.hidden/' when 3 then 'pkg/vendor/' else '' end) || p_brand || '/' || p_partkey ||
  (case p_partkey % 5 when 0 then '.py' when 1 then '.go' when 2 then '_test.go' when 3 then '.ts' else '.d.ts' end) as path from part),
k as (select path, list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) as dirs from f),
s as (select path, case when path like '%.py' and not list_has_any(dirs, ['__pycache__', '.git', 'tests', 'test', 'templates', 'vendor', 'third_party', 'migrations', 'testdata', 'node_modules']) then 'python'
  when path like '%.go' and path not like '%\\_test.go' escape '\\' and not list_has_any(dirs, ['vendor', 'node_modules', 'dist', 'testdata', '__tests__', 'tests', 'test', '.git', 'docs', 'documentation', 'examples', 'example', 'third_party', 'generated', 'fixtures', '__pycache__']) and not list_contains(list_transform(dirs, lambda x: starts_with(x, '.')), true) then 'go'
  when path like '%.ts' and path not like '%.d.ts' and not list_has_any(dirs, ['vendor', 'node_modules', 'dist', 'testdata', '__tests__', 'tests', 'test', '.git', 'docs', 'documentation', 'examples', 'example', 'third_party', 'generated', 'fixtures', '__pycache__']) and not list_contains(list_transform(dirs, lambda x: starts_with(x, '.')), true) then 'typescript' end as language from k)"""


def tree_paths(spark, d):
    size, key = F.col("p_size") % 5, F.col("p_partkey") % 5
    folder = F.when(size == 0, "src/").when(size == 1, "lib/tests/").when(size == 2, ".hidden/").when(size == 3, "pkg/vendor/").otherwise("")
    ending = F.when(key == 0, ".py").when(key == 1, ".go").when(key == 2, "_test.go").when(key == 3, ".ts").otherwise(".d.ts")
    return table(spark, d, "part").select(F.concat(folder, "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), ending).alias("path"))


@query("source_files", PATHS + " select (row_number() over (order by path) - 1)::bigint as file_id, path from s where language = 'go'")
def source_files(spark, d):
    return repository.source_files(tree_paths(spark, d), "go")


@query("detected_sources", PATHS + """ select language, count(*) as files, count(*) / sum(count(*)) over () as share, row_number() over (order by count(*) desc, language)::int as rank
from s where language is not null group by language""")
def detected_sources(spark, d):
    return repository.detected_sources(tree_paths(spark, d))


@query("version_satisfies", """select p_partkey, case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then p_size >= 20
  when p_partkey % 4 = 2 then p_size >= 10 and p_size < 30 else (p_size % 7, p_size % 3) >= (3, 1) and p_size % 7 < 4 end as ok from part""")
def version_satisfies(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    need = F.when(k == 0, "1.x").when(k == 1, ">=20").when(k == 2, ">=10, <30").otherwise("^3.1")
    have = F.when(k == 3, F.concat_ws(".", n % 7, n % 3)).otherwise(n.cast("string"))
    return table(spark, d, "part").select("p_partkey", scalar.satisfies(need, have, F.lit("npm")).alias("ok"))


@query("package_keys", """select p_partkey, case p_partkey % 3 when 0 then replace(p_name, '_', '-') when 1 then regexp_replace(lower(p_type || '__' || p_brand), '[-_.]+', '-', 'g') else p_name end as key from part""")
def package_keys(spark, d):
    k = F.col("p_partkey") % 3
    eco = F.when(k == 0, "cargo").when(k == 1, "pypi").otherwise("npm")
    name = F.when(k == 1, F.concat("p_type", F.lit("__"), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", scalar.package_key(eco, name).alias("key"))


@query("member_fingerprints", with_("sup") + " select district, substr(sha1(string_agg(path, chr(10) order by path)), 1, 12) as fingerprint from sup group by district")
def member_fingerprints(spark, d):
    return base.sup(spark, d).groupBy("district").agg(scalar.member_fingerprint(F.collect_list("path")).alias("fingerprint"))


@query("package_projection", with_("sup", "heavy") + """,
p as (select heavy.src as s, x.lang as a, y.lang as b from heavy join sup x on x.file_id = heavy.src join sup y on y.file_id = heavy.dst where x.lang <> y.lang),
n as (select a as src, b as dst, count(*) as n from p group by all),
r as (select src, dst from n union select r.src, n.dst from r join n on n.src = r.dst)
select src, dst, n, (select count(*) > 0 from r where r.src = r.dst) as crosses from n""")
def package_projection(spark, d):
    files = base.sup(spark, d)
    return D.package_projection(files, base.heavy_arcs(spark, d), files.select(F.col("lang").alias("root")).distinct())


CARRIER = with_("cf") + """,
sz as (select sha from cf group by sha having count(*) between 2 and 40), bc as (select cf.* from cf join sz using (sha)),
solo as (select f, count(*) as solo from cf group by f),
pr as (select p.f as a, q.f as b, count(*) as cnt from bc p join bc q on p.sha = q.sha and p.f < q.f group by all),
th as (select * from (values (3, 2), (3, 3), (5, 2), (5, 4), (100, 2), (600, 10)) t(min_solo, min_pairs))
select min_solo, min_pairs, (select count(*) from pr join solo x on x.f = a join solo y on y.f = b where cnt >= min_pairs and least(x.solo, y.solo) >= min_solo) as pairs from th"""


@query("cochange_carriers", CARRIER)
def cochange_carriers(spark, d):
    return S.carriers(base.commit_files(spark, d), [(3, 2), (3, 3), (5, 2), (5, 4), (100, 2), (600, 10)])


@query("rename_share", """with a as (select n_nationkey as k, n_name as name from nation), b as (select n_nationkey as k, case when n_nationkey % 4 = 0 then n_name || ' 2' else n_name end as name from nation)
select count(*) as matched, round_even(avg(case when a.name <> b.name then 1.0::double else 0.0::double end), 6) as renamed from a join b using (k)""")
def rename_share(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("district"), F.col("n_name").alias("name"))
    later = n.withColumn("name", F.when(F.col("district") % 4 == 0, F.concat("name", F.lit(" 2"))).otherwise(F.col("name")))
    return E.rename_share(n, later, n.select(F.col("district").alias("da"), F.col("district").alias("db")))


@query("typescript_candidates", """with b as (select p_partkey as id, 'm' || p_partkey % 60 || (case p_partkey % 4 when 0 then '.js' when 1 then '.mjs' when 2 then '' else '/x' end) as base from part),
f as (select distinct 'm' || p_size || (case p_size % 3 when 0 then '.ts' when 1 then '/index.ts' else '.tsx' end) as path from part),
c as (select id, unnest(case when base like '%.mjs' then [base] when base like '%.js' then [replace(base, '.js', '.ts'), replace(base, '.js', '.tsx')]
  else [base || '.ts', base || '/index.ts', base || '.tsx', base || '/index.tsx', base || '/src/index.ts', base] end) as path,
  generate_subscripts(case when base like '%.mjs' then [base] when base like '%.js' then [base, base] else [base, base, base, base, base, base] end, 1) as pos from b)
select id, arg_min(c.path, pos) as path from c join f using (path) group by id""")
def typescript_candidates(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 4
    ending = F.when(k == 0, ".js").when(k == 1, ".mjs").when(k == 2, "").otherwise("/x")
    spec = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("m"), (F.col("p_partkey") % 60).cast("string"), ending).alias("base"))
    s = F.col("p_size") % 3
    files = p.select(F.concat(F.lit("m"), F.col("p_size").cast("string"), F.when(s == 0, ".ts").when(s == 1, "/index.ts").otherwise(".tsx")).alias("path")).distinct()
    return R.first_candidate(spec.select("id", R.typescript_candidates(F.col("base")).alias("cs")), "id", "cs", files)


@query("symbol_categories", """select p_partkey, case p_partkey % 6 when 0 then 'callable' when 1 then 'type' when 2 then 'term' when 3 then 'namespace' when 4 then 'parameter' else 'other' end as category from part""")
def symbol_categories(spark, d):
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, "().").when(k == 1, "#").when(k == 2, ".").when(k == 3, "/").when(k == 4, "(x)").otherwise("!")
    return table(spark, d, "part").select("p_partkey", R.symbol_category(F.concat("p_name", tail)).alias("category"))
