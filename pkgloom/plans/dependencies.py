"""Dependency-graph queries (D1-D15) and version functions (F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgloom.functions import uri
from pkgloom.functions.versions import constraint, dotted_range, split_constraints, version_key
from pkgloom.operators import graph as g
from pkgloom.operators.dependencies import agreement, best_matches, constraint_sets, dependents, match_counts, matches, resolve, source_counts
from pkgloom.operators.nested import flatten
from pkgloom.plans.registry import Registry
from pkgloom.session import cut

deps = Registry()

# the versions of the test data in SQL: three numbers and at most one qualifier; a bound may have fewer numbers
_KEY = "[coalesce(try_cast(regexp_extract({v}, '^(\\d+)', 1) AS INT), 0), coalesce(try_cast(regexp_extract({v}, '^\\d+\\.(\\d+)', 1) AS INT), 0), coalesce(try_cast(regexp_extract({v}, '^\\d+\\.\\d+\\.(\\d+)', 1) AS INT), 0), CASE WHEN {v} LIKE '%-beta%' THEN -2 WHEN {v} LIKE '%-rc%' THEN -1 ELSE 0 END, coalesce(try_cast(regexp_extract({v}, '-[a-z]+(\\d+)', 1) AS INT), 0)]"
SETS_SQL = r"""
sets AS (SELECT DISTINCT dependency_id AS package_id, list_sort(list_distinct(list_transform(version_range, lambda x: regexp_replace(x, '\s', '', 'g')))) AS r, package_version_id AS source FROM deps WHERE version_range IS NOT NULL),
specs AS (SELECT DISTINCT package_id, r, unnest(r) AS spec FROM sets),
parsed AS (SELECT *, regexp_replace(spec, '[\[\]()]', '', 'g') AS inn FROM specs),
bounds AS (SELECT *, spec[1] IN ('[', '(') AS bracketed, CASE WHEN inn LIKE '%,%' THEN split_part(inn, ',', 1) ELSE inn END AS lo, CASE WHEN inn LIKE '%,%' THEN split_part(inn, ',', 2) ELSE inn END AS hi FROM parsed),
keyed AS (SELECT *, """ + _KEY.format(v="lo") + " AS lk, " + _KEY.format(v="hi") + " AS hk FROM bounds), vk AS (SELECT id, package_id AS vp, version, " + _KEY.format(v="version") + """ AS k FROM pv),
matched AS (SELECT DISTINCT package_id, r, id AS target FROM keyed JOIN vk ON vp = package_id AND CASE WHEN NOT bracketed THEN version = lo ELSE (lo = '' OR k > lk OR (spec LIKE '[%' AND k = lk)) AND (hi = '' OR k < hk OR (spec LIKE '%]' AND k = hk)) END)"""


@deps("F6_latest_version", f"SELECT package_id, max(k)::VARCHAR AS latest FROM (SELECT package_id, {_KEY.format(v='version')} AS k FROM pv) GROUP BY package_id")
def latest_version(c):
    """The greatest version of each package in version order, by numbers and qualifier."""
    best = c.package_versions.groupBy("package_id").agg(F.max_by("version", version_key("version")).alias("v"))
    numbers = [F.coalesce(F.regexp_extract("v", p, 1).try_cast("int"), F.lit(0)) for p in (r"^(\d+)", r"^\d+\.(\d+)", r"^\d+\.\d+\.(\d+)")]
    kind = F.when(F.col("v").contains("-beta"), -2).when(F.col("v").contains("-rc"), -1).otherwise(0)
    last = F.coalesce(F.regexp_extract("v", r"-[a-z]+(\d+)", 1).try_cast("int"), F.lit(0))
    return best.select("package_id", F.concat(F.lit("["), F.concat_ws(", ", *[x.cast("string") for x in (*numbers, kind, last)]), F.lit("]")).alias("latest"))


@deps("F6_sorted_versions", f"SELECT id, package_id, dense_rank() OVER (PARTITION BY package_id ORDER BY {_KEY.format(v='version')}) AS place FROM pv")
def sorted_versions(c):
    """Place of every version in its package, from 1; equal versions share one.

    The distinct versions of all packages are numbered together by range partitions; a package's first number is
    taken off, so that no task sorts a hot package alone.
    """
    keyed = c.package_versions.select("id", "package_id", version_key("version").alias("k"))
    numbered = cut(g.renumber(keyed.select(F.struct("package_id", "k").alias("node"))).select("node.package_id", "node.k", "number"))
    first = numbered.groupBy("package_id").agg(F.min("number").alias("first"))
    placed = numbered.join(first, "package_id").select("package_id", "k", (F.col("number") - F.col("first") + 1).alias("place"))
    return keyed.join(placed, ["package_id", "k"]).select("id", "package_id", "place")


@deps("N7_last_purls", f"SELECT vulnerability_id, package_name, arg_max(package_version, ({_KEY.format(v='package_version')}, package_version)) AS last FROM vpurls GROUP BY ALL")
def last_purls(c):
    """The last vulnerable version of each package, by version order, then text."""
    per = c.vulnerabilities_purls.groupBy("vulnerability_id", "package_name").agg(F.max_by("package_version", F.struct(version_key("package_version"), "package_version")).alias("last"))
    return per.select("vulnerability_id", "package_name", "last")


@deps("N7_source_patches", """SELECT id AS record_key, ord - 1 AS child_no, json_extract_string(p, '$.filename') AS filename FROM (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS ord FROM (SELECT id, CASE WHEN json_type(st, '$.patches') = 'ARRAY' THEN json_extract(st, '$.patches[*]') WHEN json_type(st, '$.patches') = 'OBJECT' THEN [json_extract(st, '$.patches')] ELSE [] END AS ps
 FROM (SELECT id, CASE WHEN json_type(statement) = 'ARRAY' THEN json_extract(statement, '$[0]') ELSE statement::JSON END AS st FROM vulnerabilities WHERE json_valid(statement)))) WHERE regexp_matches(json_extract_string(p, '$.filename'), '\\.(java|py|c|cpp|h)$')""")
def source_patches(c):
    """Patches of files of program text, by their extension."""
    p = flatten(c.vulnerabilities, "id", "statement", {"patches"})
    name = F.col("fields")["filename"]
    return p.where(name.rlike(r"\.(java|py|c|cpp|h)$")).select("record_key", F.col("child_no").cast("long").alias("child_no"), name.alias("filename"))


@deps("D11_resolver_agreement", "WITH a AS (SELECT DISTINCT vulnerability_id AS key, package_name || ':' || package_version AS member FROM vpurls), b AS (SELECT DISTINCT x.vulnerability_id AS key, p.package_name || ':' || v.version AS member FROM packages p JOIN pv v ON v.package_id = p.id JOIN vpurls x ON x.package_name = p.package_name AND x.package_version = v.version AND x.forge = p.forge) SELECT a.key, count(*) AS n_a, count(b.member) AS n_b, count(b.member) AS n_both, round(count(b.member) / count(*)::DOUBLE, 6) AS share FROM a LEFT JOIN b ON b.key = a.key AND b.member = a.member GROUP BY a.key")
def resolver_agreement(c):
    """How far what a source names and what the tables resolve agree, for each vulnerability."""
    x = c.vulnerabilities_purls
    named = x.select(F.col("vulnerability_id").alias("key"), F.concat_ws(":", "package_name", "package_version").alias("member"))
    v = c.versions("package_id", "version").select("package_id", F.col("version").alias("package_version"))
    p = c.packages.select(F.col("id").alias("package_id"), "package_name", "forge")
    found = x.join(p, ["package_name", "forge"]).join(v, ["package_id", "package_version"])
    found = found.select(F.col("vulnerability_id").alias("key"), F.concat_ws(":", "package_name", "package_version").alias("member"))
    return agreement(named, found).withColumn("share", F.round("share", 6))


@deps("D5_matched_edges", f"WITH {SETS_SQL} SELECT package_id, array_to_string(r, '|') AS ranges, target FROM matched")
def matched_edges(c):
    """Which versions each set of constraints allows: the edges written out."""
    _, sets = constraint_sets(c.dependencies)
    m = matches(sets, c.package_versions)
    return m.select(F.split_part("set_id", F.lit("|"), F.lit(1)).cast("long").alias("package_id"), F.regexp_replace("set_id", r"^-?\d+\|", "").alias("ranges"), "target")


@deps("D1_constraints", r"""SELECT DISTINCT spec, left(spec, 1) IN ('[', '(') AS bracketed, CASE WHEN inn LIKE '%,%' THEN split_part(inn, ',', 1) ELSE inn END AS lower, CASE WHEN inn LIKE '%,%' THEN split_part(inn, ',', 2) ELSE inn END AS upper, spec LIKE '[%' AS lower_in, spec LIKE '%]' AS upper_in
 FROM (SELECT spec, regexp_replace(spec, '[\[\]()]', '', 'g') AS inn FROM (SELECT regexp_replace(unnest(version_range), '\s', '', 'g') AS spec FROM deps))""")
def constraints(c):
    specs = c.dependencies.select(F.explode("version_range").alias("spec")).select(F.regexp_replace("spec", r"\s", "").alias("spec")).distinct()
    return specs.select("spec", *[x.alias(k) for k, x in constraint(F.col("spec")).items()])


@deps("D2_split_constraints", r"SELECT package_version_id, dependency_id, coalesce(len(version_range), 1) AS n FROM deps")
def split_specs(c):
    """The constraints joined into one text and split again, brackets kept whole."""
    text = F.array_join("version_range", ",")
    return c.dependencies.select("package_version_id", "dependency_id", F.size(split_constraints(text)).cast("long").alias("n"))


@deps("D3_matching_revisions", f"WITH {SETS_SQL} SELECT package_id, array_to_string(r, '|') AS ranges, count(*) AS n_versions FROM matched GROUP BY package_id, r")
def matching_revisions(c):
    _, sets = constraint_sets(c.dependencies)
    m = match_counts(sets, c.package_versions)
    return m.select(F.split_part("set_id", F.lit("|"), F.lit(1)).cast("long").alias("package_id"), F.regexp_replace("set_id", r"^-?\d+\|", "").alias("ranges"), F.col("n").alias("n_versions"))


@deps("D4_dependency_edges", f"WITH {SETS_SQL}, per AS (SELECT package_id, r, count(*) AS n FROM matched GROUP BY package_id, r) SELECT s.source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_targets FROM sets s LEFT JOIN per ON per.package_id = s.package_id AND per.r = s.r GROUP BY s.source")
def dependency_edges(c):
    """Out-degree of every version in the dependency graph, from the factorised tables."""
    uses, sets = constraint_sets(c.dependencies)
    per = match_counts(sets, c.package_versions)
    return uses.join(per, "set_id", "left").groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_targets"))


@deps("D5_inverted_edges", f"WITH {SETS_SQL}, per AS (SELECT package_id, r, count(DISTINCT source) AS n FROM sets GROUP BY package_id, r) SELECT target, CAST(sum(n) AS BIGINT) AS n_sources FROM matched JOIN per USING (package_id, r) GROUP BY target")
def inverted_edges(c):
    """In-degree of every version: how many (source, set) name it."""
    uses, sets = constraint_sets(c.dependencies)
    return source_counts(uses, sets, c.package_versions).select("target", F.col("n").alias("n_sources"))


_ROOT = "SELECT min(id) AS node FROM pv WHERE package_id = (SELECT min(package_id) FROM pv)"


@deps("D6_direct_dependents", f"WITH {SETS_SQL} SELECT DISTINCT s.source AS node, 1 AS dist FROM matched m JOIN sets s ON s.package_id = m.package_id AND s.r = m.r JOIN pv ON pv.id = s.source WHERE m.target IN ({_ROOT}) AND pv.created_at >= TIMESTAMP '2017-01-01'")
def direct_dependents(c):
    uses, sets = constraint_sets(c.dependencies)
    v = c.package_versions
    first = v.agg(F.min("package_id").alias("package_id"))
    roots = v.join(F.broadcast(first), "package_id").agg(F.min("id").alias("node"))
    return dependents(uses, sets, v, roots, "2017-01-01", transitive=False)


@deps("D6_transitive_dependents")
def transitive_dependents(c):
    uses, sets = constraint_sets(c.dependencies)
    v = c.package_versions
    first = v.agg(F.min("package_id").alias("package_id"))
    roots = v.join(F.broadcast(first), "package_id").agg(F.min("id").alias("node"))
    return dependents(uses, sets, v, roots, "2017-01-01")


@deps("D7_revisions", "SELECT package_id, version, count(*) AS n_rows FROM package_versions GROUP BY package_id, version")
def revisions(c):
    """Package and version are the identity of a revision; ids and generators are not."""
    return c.table("package_versions").groupBy("package_id", "version").agg(F.count(F.lit(1)).alias("n_rows"))


@deps("D8_dependency_json", """SELECT package_version_id, dependency_id, '{"dependency_id":' || dependency_id || ',"ranges":[' || array_to_string(list_transform(version_range, lambda x: '"' || x || '"'), ',') || ']}' AS json FROM deps WHERE version_range IS NOT NULL""")
def dependency_json(c):
    d = c.dependencies.where("version_range IS NOT NULL")
    return d.select("package_version_id", "dependency_id", F.to_json(F.struct("dependency_id", F.col("version_range").alias("ranges"))).alias("json"))


@deps("D12_invalidated_files", f"WITH {SETS_SQL} SELECT DISTINCT left(p.package_name, 1) || '/' || split_part(p.package_name, ':', 1) || '/' || split_part(p.package_name, ':', 2) || '/' || pv.version || '.json' AS path FROM matched m JOIN sets s ON s.package_id = m.package_id AND s.r = m.r JOIN pv ON pv.id = s.source JOIN packages p ON p.id = pv.package_id WHERE m.target IN ({_ROOT})")
def invalidated_files(c):
    """Cache files of the direct dependents of a changed version, as its SQL; D12_all_invalidated_files has all."""
    uses, sets = constraint_sets(c.dependencies)
    v = c.package_versions
    first = v.agg(F.min("package_id").alias("package_id"))
    roots = v.join(F.broadcast(first), "package_id").agg(F.min("id").alias("node"))
    return cache_files(c, dependents(uses, sets, v, roots, None, transitive=False))


@deps("D12_all_invalidated_files")
def all_invalidated_files(c):
    """Cache files of a changed version and of its dependents, direct or not."""
    uses, sets = constraint_sets(c.dependencies)
    v = c.package_versions
    first = v.agg(F.min("package_id").alias("package_id"))
    roots = v.join(F.broadcast(first), "package_id").agg(F.min("id").alias("node"))
    return cache_files(c, dependents(uses, sets, v, roots).select("node").unionByName(roots))


def cache_files(c, hit):
    """(path) of the cache file of each version ``hit`` (node)."""
    v = c.package_versions
    p = c.packages.select(F.col("id").alias("package_id"), "package_name")
    j = hit.join(v.select(F.col("id").alias("node"), "package_id", "version"), "node").join(p, "package_id")
    return j.select(cache_file("package_name", "version").alias("path")).distinct()


def cache_file(package: str, version: str):
    group, artifact = F.split_part(package, F.lit(":"), F.lit(1)), F.split_part(package, F.lit(":"), F.lit(2))
    return F.concat(F.left(package, F.lit(1)), F.lit("/"), group, F.lit("/"), artifact, F.lit("/"), version, F.lit(".json"))


@deps("D15_scopes", "SELECT scope, count(*) AS n FROM (SELECT unnest(dependency_type) AS scope FROM deps) GROUP BY scope")
def scopes(c):
    return c.dependencies.select(F.explode("dependency_type").alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@deps("D9_direct_resolution", f"WITH {SETS_SQL}, best AS (SELECT m.package_id, m.r, arg_max(vk.version, (vk.k, vk.version)) AS version FROM matched m JOIN vk ON vk.id = m.target GROUP BY 1, 2) SELECT DISTINCT s.source, best.version, best.package_id FROM sets s JOIN best ON best.package_id = s.package_id AND best.r = s.r")
def direct_resolution(c):
    """The highest version that each dependency allows."""
    uses, sets = constraint_sets(c.dependencies)
    v = c.package_versions
    found = uses.join(best_matches(sets, v), "set_id").join(v.select(F.col("id").alias("target"), "package_id", "version"), "target")
    return found.select("source", "package_id", "version").distinct()


def _roots(c):
    """The version with the most dependencies that any version satisfies, the smallest id of several."""
    uses, sets = constraint_sets(c.dependencies)
    per = uses.join(best_matches(sets, c.package_versions), "set_id").groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("n"), "node").limit(1).select("node")


@deps("D9_transitive_resolution")
def transitive_resolution(c):
    uses, sets = constraint_sets(c.dependencies)
    return resolve(uses, sets, c.package_versions, _roots(c))


@deps("G2_search_from_revision")
def search_from_revision(c):
    """What the nodes of a version reach within it and the versions it resolves to, in the graph across versions."""
    uses, sets = constraint_sets(c.dependencies)
    revisions = resolve(uses, sets, c.package_versions, _roots(c)).select(F.col("node").alias("revision"), (F.col("dist") == 0).alias("root"))
    homes = c.lineitem.select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("revision")).distinct()
    return g.search_within(c.part_edges, homes, revisions)


@deps("G3_search_of_dependents")
def search_of_dependents(c):
    """Which nodes of a version's dependents, direct or not, reach the nodes of the version, in the graph of each dependent with what it resolves to."""
    uses, sets = constraint_sets(c.dependencies)
    v = c.package_versions
    first = v.agg(F.min("package_id").alias("package_id"))
    root = v.join(F.broadcast(first), "package_id").agg(F.min("id").alias("node"))
    starts = dependents(uses, sets, v, root).select("node").unionByName(root).distinct()
    resolved = resolve(uses, sets, v, starts.withColumn("dependent", F.col("node")), keys=("dependent",)).select("dependent", F.col("node").alias("revision"))
    homes = c.lineitem.select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("revision")).distinct()
    return g.search_dependents(c.part_edges, homes, resolved, root.select(F.col("node").alias("revision")))


@deps("D13_maven_purls", "SELECT DISTINCT x.package_name || ':' || x.package_version AS coordinate FROM vpurls x WHERE purl LIKE 'pkg:maven/%'")
def maven_purls(c):
    """Coordinates of all Maven package URLs."""
    p = uri.purl_parts("purl")
    return c.vulnerabilities_purls.where(p["type"] == "maven").select(F.concat_ws(":", uri.purl_package("purl"), p["version"]).alias("coordinate")).distinct()


@deps("D14_dotted_ranges", "SELECT DISTINCT p_size::VARCHAR AS lower, CASE WHEN p_size % 2 = 0 THEN p_size + 1 END::VARCHAR AS upper FROM part")
def dotted_ranges(c):
    """Ranges of the older form, every second one open."""
    spec = F.concat(F.lit("[ "), F.col("p_size").cast("string"), F.lit(" .."), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 1).cast("string")).otherwise(""), F.lit("]"))
    return c.part.select(*[x.alias(k) for k, x in dotted_range(spec).items()]).distinct()


QUERIES, SQL = deps.queries, deps.sql
