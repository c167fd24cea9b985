"""Aggregations, set operations and orders (A1-A19, U1-U5, O1-O10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgloom.operators.graph import renumber
from pkgloom.plans.registry import Registry, micros

aggregates = Registry()


@aggregates("A1_dependencies_of_revision", "SELECT package_version_id, string_agg(DISTINCT dependency_id::VARCHAR, ',' ORDER BY dependency_id::VARCHAR) AS dependencies FROM deps GROUP BY package_version_id")
def dependencies_of_revision(c):
    return c.dependencies.groupBy("package_version_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("dependency_id").cast("string"))), ",").alias("dependencies"))


@aggregates("A2_revisions_of_product", "SELECT package_id, count(DISTINCT version) AS n, min(version) AS first, max(version) AS last FROM pv GROUP BY package_id")
def revisions_of_product(c):
    """The hot packages hold most versions, so the state per product is a count and the ends, not a list."""
    return c.package_versions.groupBy("package_id").agg(F.count_distinct("version").alias("n"), F.min("version").alias("first"), F.max("version").alias("last"))


@aggregates("A4_receivers_of_source", "SELECT source_id, string_agg(line::VARCHAR || ':' || call_type, '|' ORDER BY line::VARCHAR || ':' || call_type) AS receivers FROM call_sites GROUP BY source_id")
def receivers_of_source(c):
    r = F.concat_ws(":", F.col("line").cast("string"), "call_type")
    return c.call_sites.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(r)), "|").alias("receivers"))


@aggregates("A5_type_dictionary", "SELECT regexp_extract(uri, '^/[^/]+/([^.]+)', 1) AS type, regexp_extract(uri, '\\.(.*)$', 1) AS signature, count(DISTINCT id) AS n FROM callables GROUP BY 1, 2")
def type_dictionary(c):
    return c.callables.groupBy(F.regexp_extract("uri", r"^/[^/]+/([^.]+)", 1).alias("type"), F.regexp_extract("uri", r"\.(.*)$", 1).alias("signature")).agg(F.count_distinct("id").alias("n"))


@aggregates("A8_largest_degree", "SELECT src AS node, count(*) AS degree FROM part_edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1")
def largest_degree(c):
    d = c.part_edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return d.orderBy(F.desc("degree"), "node").limit(1)


@aggregates("A9_degree_distribution", "SELECT degree, count(*) AS n FROM (SELECT count(*) AS degree FROM part_edges GROUP BY src) GROUP BY degree")
def degree_distribution(c):
    return c.part_edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@aggregates("A10_graph_summary", "SELECT CAST(ceil(log2(n + 1)) AS BIGINT) AS bucket, count(*) AS graphs, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, round(stddev_pop(n), 6) AS deviation FROM (SELECT m.package_version_id, count(*) AS n FROM call_sites s JOIN callables cl ON cl.id = s.source_id JOIN modules m ON m.id = cl.module_id GROUP BY 1) GROUP BY 1")
def graph_summary(c):
    cl = c.callables.select(F.col("id").alias("source_id"), "module_id").join(c.modules.select(F.col("id").alias("module_id"), "package_version_id"), "module_id")
    per = c.call_sites.join(cl, "source_id").groupBy("package_version_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.ceil(F.log2(F.col("n") + 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("graphs"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.stddev_pop("n"), 6).alias("deviation"))


@aggregates("A12_distinct_products", "SELECT o_custkey, count(DISTINCT l_partkey) AS products FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def distinct_products(c):
    return c.orders.join(c.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count_distinct("l_partkey").alias("products"))


@aggregates("A13_origin_counts", "SELECT CASE WHEN a.has AND b.has THEN 'both' WHEN a.has THEN 'static' ELSE 'dynamic' END AS origin, count(*) AS n FROM (SELECT src, dst, true AS has FROM part_edges) a FULL JOIN (SELECT DISTINCT l_partkey AS src, p_partkey AS dst, true AS has FROM lineitem JOIN part ON p_partkey = l_partkey + 1) b USING (src, dst) GROUP BY 1")
def origin_counts(c):
    next_part = c.lineitem.select(F.col("l_partkey").alias("src")).distinct().join(c.part.select((F.col("p_partkey") - 1).alias("src"), F.col("p_partkey").alias("dst")), "src").withColumn("d", F.lit(True))
    j = c.part_edges.withColumn("s", F.lit(True)).join(next_part, ["src", "dst"], "full")
    origin = F.when(F.col("s").isNotNull() & F.col("d").isNotNull(), "both").when(F.col("s").isNotNull(), "static").otherwise("dynamic")
    return j.groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@aggregates("A14_set_match", "SELECT package_id, round(CASE WHEN n = 0 AND m = 0 THEN 1.0 ELSE common / greatest(n, m)::DOUBLE END, 6) AS match FROM (SELECT package_id, count(DISTINCT version) FILTER (WHERE version LIKE '%.0') AS n, count(DISTINCT version) FILTER (WHERE version LIKE '0.%') AS m, count(DISTINCT version) FILTER (WHERE version LIKE '%.0' AND version LIKE '0.%') AS common FROM pv GROUP BY package_id)")
def set_match(c):
    """Common part of two sets of versions over the larger; two empty sets match wholly."""
    v = F.col("version")
    a, b = v.endswith(".0"), v.startswith("0.")
    d = c.package_versions.select("package_id", "version").distinct()
    per = d.groupBy("package_id").agg(F.count_if(a).alias("n"), F.count_if(b).alias("m"), F.count_if(a & b).alias("both"))
    return per.select("package_id", F.round(F.when((F.col("n") == 0) & (F.col("m") == 0), 1.0).otherwise(F.col("both") / F.greatest("n", "m")), 6).alias("match"))


@aggregates("A15_module_statistics", "SELECT p_brand, count(*) AS modules, round(avg(p_size), 3) AS mean_size, round(count(*) FILTER (WHERE p_size > 25) / count(*)::DOUBLE, 3) AS large_share FROM part GROUP BY p_brand")
def module_statistics(c):
    return c.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("modules"), F.round(F.avg("p_size"), 3).alias("mean_size"), F.round(F.count_if(F.col("p_size") > 25) / F.count(F.lit(1)), 3).alias("large_share"))


@aggregates("A16_latest_date", "SELECT user_id, strftime(greatest(coalesce(max(ts) FILTER (WHERE event_type = 'purchase'), TIMESTAMP '1950-01-01'), TIMESTAMP '1950-01-01'), '%Y-%m-%d') AS latest FROM events GROUP BY user_id")
def latest_date(c):
    """A floor stands where no date was parsed."""
    floor = F.lit("1950-01-01").cast("timestamp_ntz")
    t = F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))), floor)
    return c.events.groupBy("user_id").agg(F.date_format(F.greatest(t, floor), "yyyy-MM-dd").alias("latest"))


@aggregates("A17_weights", "SELECT c_nationkey, round(sum(1.0 / n), 9) AS weight FROM customer, (SELECT count(*) AS n FROM customer) GROUP BY c_nationkey")
def weights(c):
    n = c.customer.agg(F.count(F.lit(1)).alias("n"))
    return c.customer.join(F.broadcast(n)).groupBy("c_nationkey").agg(F.round(F.sum(1.0 / F.col("n")), 9).alias("weight"))


@aggregates("A18_approximate_distinct", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def approximate_distinct(c):
    """Whether a sketch of 2^14 registers counts within three per cent; sketches merge along edges and partitions."""
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey", F.lit(14)))
    per = c.lineitem.groupBy("l_returnflag").agg(sketch.alias("s"), F.count_distinct("l_orderkey").alias("n"))
    return per.select("l_returnflag", (F.abs(F.col("s") - F.col("n")) <= 0.03 * F.col("n")).alias("close"))


@aggregates("A19_distinct_names", "SELECT DISTINCT package_name FROM vpurls")
def distinct_names(c):
    return c.vulnerabilities_purls.select("package_name").distinct()


@aggregates("U1_union_of_calls", "SELECT source_id, target_id FROM call_sites WHERE call_type = 'static' UNION SELECT source_id, target_id FROM call_sites WHERE line >= 2")
def union_of_calls(c):
    s = c.call_sites
    return s.where("call_type = 'static'").select("source_id", "target_id").union(s.where("line >= 2").select("source_id", "target_id")).distinct()


@aggregates("U2_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'part' AS kind, src, dst FROM part_edges UNION ALL SELECT 'supplier', src, dst FROM supplier_edges) GROUP BY kind")
def union_all(c):
    both = c.part_edges.withColumn("kind", F.lit("part")).unionByName(c.supplier_edges.withColumn("kind", F.lit("supplier")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@aggregates("U3_intersection", "SELECT src, dst FROM part_edges INTERSECT SELECT dst, src FROM part_edges")
def intersection(c):
    return c.part_edges.intersect(c.part_edges.select("dst", "src"))


@aggregates("U4_difference", "SELECT src, dst FROM part_edges EXCEPT SELECT dst, src FROM part_edges")
def difference(c):
    return c.part_edges.subtract(c.part_edges.select("dst", "src"))


@aggregates("U5_last_wins", "SELECT uri, max(CASE WHEN is_internal_call THEN 2 ELSE 1 END) AS origin FROM callables GROUP BY uri")
def last_wins(c):
    """Internal over external methods of the same URI."""
    a = c.callables.where("NOT is_internal_call").select("uri", F.lit(1).alias("origin"))
    b = c.callables.where("is_internal_call").select("uri", F.lit(2).alias("origin"))
    return a.unionByName(b).groupBy("uri").agg(F.max("origin").alias("origin"))


@aggregates("O1_nulls_last", "SELECT id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS place FROM packages")
def nulls_last(c):
    """The place of every row in a full order: range partitions with offsets on a sortable key, no window over all rows."""
    key = F.struct(F.coalesce(-micros("created_at"), F.lit(2**62)).alias("late"), F.col("id"))
    return renumber(c.packages.select(key.alias("node"))).select("node.id", (F.col("number") + 1).alias("place"))


@aggregates("O3_page", "SELECT id, version FROM pv ORDER BY id LIMIT 50 OFFSET 100")
def offset_page(c):
    return c.package_versions.select("id", "version").orderBy("id").offset(100).limit(50)


@aggregates("O5_first_dependents", "SELECT dependency_id, package_version_id FROM (SELECT dependency_id, package_version_id, row_number() OVER (PARTITION BY dependency_id ORDER BY package_version_id) AS rn FROM (SELECT DISTINCT dependency_id, package_version_id FROM deps)) WHERE rn <= 3")
def first_dependents(c):
    """The first three dependents of each package: salted partial tops before the top of each package."""
    d = c.dependencies.select("dependency_id", "package_version_id").distinct().withColumn("salt", F.pmod(F.hash("package_version_id"), F.lit(32)))
    local = Window.partitionBy("dependency_id", "salt").orderBy("package_version_id")
    few = d.withColumn("rn", F.row_number().over(local)).where("rn <= 3")
    w = Window.partitionBy("dependency_id").orderBy("package_version_id")
    return few.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("dependency_id", "package_version_id")


@aggregates("O10_shortest_path", "SELECT package_version_id, arg_min(path, (length(path), path)) AS path FROM files GROUP BY package_version_id")
def shortest_path(c):
    return c.files.groupBy("package_version_id").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"))


@aggregates("O9_sample", "SELECT node FROM (SELECT DISTINCT src AS node FROM part_edges) ORDER BY md5(node || ':7') LIMIT 10")
def seeded_sample(c):
    """A seeded sample of ten nodes: the ten smallest hashes."""
    n = c.part_edges.select(F.col("src").alias("node")).distinct()
    return n.orderBy(F.md5(F.concat(F.col("node").cast("string"), F.lit(":7")).cast("binary"))).limit(10)


@aggregates("J_right_outer", "SELECT n.n_name, count(c.c_custkey) AS n FROM customer c RIGHT JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9000 GROUP BY n.n_name")
def right_outer(c):
    j = c.customer.join(c.nation, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_acctbal") > 9000), "right")
    return j.groupBy("n_name").agg(F.count("c_custkey").alias("n"))


@aggregates("J_versions_before", "SELECT e.event_id, max(epoch_us(o.o_orderdate)) AS before_us FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id")
def versions_before(c):
    """The last order of a customer before each event: an as-of join by key and time."""
    j = c.events.select("event_id", "user_id", "ts").join(c.orders.select(F.col("o_custkey").alias("user_id"), "o_orderdate"), "user_id").where("o_orderdate <= ts")
    return j.groupBy("event_id").agg(F.max(micros("o_orderdate")).alias("before_us"))


QUERIES, SQL = aggregates.queries, aggregates.sql
