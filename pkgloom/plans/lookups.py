"""Keyed and paged look-ups, one function for each question a client asks about one package, version or vulnerability.

A key is a filter on the scan, not on a finished answer; a page is the top of an order by a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.plans.registry import Registry
from pkgloom.sources.catalog import Catalog

PAGE = 10
lookups = Registry()


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """``limit`` rows after the first ``offset`` in the order of ``order``, which should be unique."""
    return rows.orderBy(*order).offset(offset).limit(limit)


class Lookups:
    def __init__(self, catalog: Catalog):
        self.c = catalog

    def packages(self, offset: int = 0, limit: int = PAGE) -> DataFrame:
        return page(self.c.packages.select("id", "package_name", "forge", "project_name"), ["id"], offset, limit)

    def search_packages(self, text: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
        return page(self.c.packages.where(F.contains("package_name", F.lit(text))).select("id", "package_name", "forge"), ["id"], offset, limit)

    def package(self, name: str) -> DataFrame:
        """The package with its latest version, one row for each forge; a version without a time is older than any other."""
        p = self.c.packages.where(F.col("package_name") == name).select(F.col("id").alias("package_id"), "package_name", "forge")
        last = self._versions(name).groupBy("package_id").agg(F.max_by("version", F.struct("created_at", "id")).alias("version"))
        return p.join(last, "package_id", "left")

    def _versions(self, name: str) -> DataFrame:
        ids = [r[0] for r in self.c.packages.where(F.col("package_name") == name).select("id").collect()]  # one for each forge
        return self.c.table("package_versions").where(F.col("package_id").isin(ids)).select("id", "package_id", "version", "cg_generator", "created_at").distinct()

    def versions(self, name: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
        return page(self._versions(name).select("id", "version", "cg_generator"), ["id"], offset, limit)

    def version(self, name: str, version: str) -> DataFrame:
        return self._versions(name).where(F.col("version") == version).select("id", "package_id", "cg_generator")

    def dependencies(self, version_id: int, offset: int = 0, limit: int = PAGE) -> DataFrame:
        d = self.c.table("dependencies").where(F.col("package_version_id") == version_id).distinct()
        return page(d.select("dependency_id", F.array_join("version_range", "|").alias("ranges")), ["dependency_id", "ranges"], offset, limit)

    def modules(self, version_id: int, offset: int = 0, limit: int = PAGE) -> DataFrame:
        return page(self.c.modules.where(F.col("package_version_id") == version_id).select("id", "module_name_id", "final"), ["id"], offset, limit)

    def files(self, version_id: int, offset: int = 0, limit: int = PAGE) -> DataFrame:
        return page(self.c.files.where(F.col("package_version_id") == version_id).select("id", "path"), ["id"], offset, limit)

    def callables(self, version_id: int, offset: int = 0, limit: int = PAGE) -> DataFrame:
        m = self.c.modules.where(F.col("package_version_id") == version_id).select(F.col("id").alias("module_id"))
        return page(self.c.callables.join(m, "module_id", "left_semi").select("id", "uri", "line_start", "line_end"), ["id"], offset, limit)

    def edges(self, version_id: int, offset: int = 0, limit: int = PAGE) -> DataFrame:
        m = self.c.modules.where(F.col("package_version_id") == version_id).select(F.col("id").alias("module_id"))
        own = self.c.callables.join(m, "module_id", "left_semi").select(F.col("id").alias("source_id"))
        return page(self.c.call_sites.join(own, "source_id", "left_semi").select("source_id", "target_id", "call_type"), ["source_id", "target_id"], offset, limit)

    def vulnerability(self, external_id: str) -> DataFrame:
        return self.c.vulnerabilities.where(F.col("external_id") == external_id).select("id", "external_id", "feed_id")

    def purls_of(self, external_id: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
        x = self.c.vulnerabilities_purls.select(F.col("vulnerability_id").alias("id"), "purl").distinct()
        return page(x.join(self.vulnerability(external_id).select("id"), "id", "left_semi").select("purl"), ["purl"], offset, limit)


def _first(c, table: str, column: str):
    return c.table(table).agg(F.min(column)).first()[0]


_NAME = "(SELECT min(package_name) FROM packages WHERE id IN (SELECT package_id FROM pv GROUP BY package_id HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM pv GROUP BY package_id))))"


def _busiest(c) -> str:
    """The name of the package with the most versions."""
    n = c.versions("package_id").groupBy("package_id").agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n")).first()[0]
    return n.where(F.col("n") == top).join(c.packages.select(F.col("id").alias("package_id"), "package_name"), "package_id").agg(F.min("package_name")).first()[0]


@lookups("S25_packages_page", "SELECT id, package_name, forge, project_name FROM packages ORDER BY id LIMIT 10 OFFSET 10")
def packages_page(c):
    return Lookups(c).packages(offset=PAGE)


@lookups("S25_packages_found", "SELECT id, package_name, forge FROM packages WHERE contains(package_name, 'core') ORDER BY id LIMIT 10")
def packages_found(c):
    return Lookups(c).search_packages("core")


@lookups("S25_package", f"SELECT p.id AS package_id, package_name, forge, version FROM packages p LEFT JOIN (SELECT package_id, arg_max(version, (coalesce(created_at, TIMESTAMP '1800-01-01'), id)) AS version FROM pv GROUP BY package_id) v ON v.package_id = p.id WHERE package_name = {_NAME}")
def package(c):
    return Lookups(c).package(_busiest(c))


@lookups("S25_versions_page", f"SELECT id, version, cg_generator FROM pv WHERE package_id IN (SELECT id FROM packages WHERE package_name = {_NAME}) ORDER BY id LIMIT 10 OFFSET 20")
def versions_page(c):
    return Lookups(c).versions(_busiest(c), offset=2 * PAGE)


@lookups("S25_dependencies_page", "SELECT dependency_id, array_to_string(version_range, '|') AS ranges FROM deps WHERE package_version_id = (SELECT min(package_version_id) FROM deps) ORDER BY ALL LIMIT 10")
def dependencies_page(c):
    return Lookups(c).dependencies(_first(c, "dependencies", "package_version_id"))


@lookups("S25_modules_page", "SELECT id, module_name_id, final FROM modules WHERE package_version_id = (SELECT min(l_orderkey) FROM lineitem) ORDER BY id LIMIT 10")
def modules_page(c):
    return Lookups(c).modules(_first(c, "lineitem", "l_orderkey"))


@lookups("S25_files_page", "SELECT id, path FROM files WHERE package_version_id = (SELECT min(l_orderkey) FROM lineitem) ORDER BY id LIMIT 10")
def files_page(c):
    return Lookups(c).files(_first(c, "lineitem", "l_orderkey"))


@lookups("S25_callables_page", "SELECT id, uri, line_start, line_end FROM callables WHERE module_id IN (SELECT id FROM modules WHERE package_version_id = (SELECT min(l_orderkey) FROM lineitem)) ORDER BY id LIMIT 10")
def callables_page(c):
    return Lookups(c).callables(_first(c, "lineitem", "l_orderkey"))


@lookups("S25_edges_page", "SELECT source_id, target_id, call_type FROM call_sites WHERE source_id IN (SELECT id FROM callables WHERE module_id IN (SELECT id FROM modules WHERE package_version_id = (SELECT min(l_orderkey) FROM lineitem))) ORDER BY source_id, target_id LIMIT 10")
def edges_page(c):
    return Lookups(c).edges(_first(c, "lineitem", "l_orderkey"))


@lookups("S25_vulnerability", "SELECT id, external_id, feed_id FROM vulnerabilities WHERE external_id = (SELECT min(external_id) FROM vulnerabilities)")
def vulnerability(c):
    return Lookups(c).vulnerability(_first(c, "vulnerabilities", "external_id"))


@lookups("S25_purls_page", "SELECT DISTINCT purl FROM vulnerabilities_purls WHERE vulnerability_id = (SELECT id FROM vulnerabilities WHERE external_id = (SELECT min(external_id) FROM vulnerabilities)) ORDER BY purl LIMIT 10")
def purls_page(c):
    return Lookups(c).purls_of(_first(c, "vulnerabilities", "external_id"))


QUERIES, SQL = lookups.queries, lookups.sql
