"""Call graphs as parquet, partitioned by graph: save, load, delete; text, CSV and JSON forms; build-if-missing caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.operators.graph import integrity_errors
from pkgloom.session import Folder

TABLES = {
    "nodes": "graph_id long, node long, external boolean",
    "edges": "graph_id long, src long, dst long",
    "sites": "graph_id long, src long, calls array<struct<dst:long,line:int,call_type:string,receivers:array<string>>>",
}
BUCKETS = 256


class GraphStore:
    """Graphs under ``root``, in BUCKETS by graph_id; reading or replacing one touches its bucket only.

    A bucket is a folder of versions, each with its nodes, edges and call sites. A new version is written beside the bucket
    and moved into it in one step; the last one counts, so a run that ends halfway leaves what was there before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Folder(spark)

    def _current(self, bucket: int) -> tuple[int, str] | None:
        """Number and folder of a bucket's last version."""
        at = f"{self.root}/bucket={bucket}"
        versions = [int(n[2:]) for n in self.files.names(at) if n.startswith("v=")]
        return (max(versions), f"{at}/v={max(versions)}") if versions else None

    def _buckets(self) -> list[int]:
        return [int(n[7:]) for n in self.files.names(self.root) if n.startswith("bucket=")]

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """'nodes', 'edges' or 'sites' of all graphs, or of some buckets."""
        found = [self._current(b) for b in (self._buckets() if buckets is None else buckets)]
        paths = [f"{f[1]}/{name}" for f in found if f and self.files.names(f"{f[1]}/{name}")]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def save(self, nodes: DataFrame, edges: DataFrame, sites: DataFrame | None = None) -> None:
        """Stores graphs (nodes: graph_id, node, external; edges: graph_id, src, dst); a graph that is stored already is replaced.

        sites: graph_id, src, dst, line, call_type, receivers; kept together by graph and source.
        Arcs to unknown nodes and repeated nodes are errors, and then nothing is changed.
        """
        pair = lambda g, n: F.struct(F.col(g), F.col(n))
        bad = integrity_errors(nodes.select(F.xxhash64(pair("graph_id", "node")).alias("node")), edges.select(F.xxhash64(pair("graph_id", "src")).alias("src"), F.xxhash64(pair("graph_id", "dst")).alias("dst")).distinct())
        errors = [r["error"] for r in bad.select("error").distinct().collect()]
        if errors:
            raise ValueError(", ".join(sorted(errors)))
        new = {"nodes": nodes.select("graph_id", "node", "external"), "edges": edges.select("graph_id", "src", "dst").distinct(), "sites": _grouped(sites) if sites is not None else self.spark.createDataFrame([], TABLES["sites"])}
        self._replace(nodes.select("graph_id").distinct(), new)

    def delete(self, graph_id: int) -> None:
        """Removes a graph; one that is not stored is no error."""
        if self._current(graph_id % BUCKETS):
            self._replace(self.spark.createDataFrame([(graph_id,)], "graph_id long"), {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})

    def _replace(self, graphs: DataFrame, new: dict[str, DataFrame]) -> None:
        """New versions of the buckets of ``graphs`` (graph_id), in which their rows are those of ``new``."""
        place = F.pmod("graph_id", F.lit(BUCKETS)).cast("int")
        buckets = sorted(r[0] for r in graphs.select(place.alias("b")).distinct().collect())  # BUCKETS at most
        half = f"{self.root}/_{uuid.uuid4().hex}"
        for name, df in new.items():
            kept = self.table(name, buckets).join(graphs, "graph_id", "left_anti").select(*df.columns)
            kept.unionByName(df).withColumn("bucket", place).repartition("bucket").write.partitionBy("bucket").parquet(f"{half}/{name}")
        for b in buckets:
            old = self._current(b)
            for name in new:
                self.files.move(f"{half}/{name}/bucket={b}", f"{half}/v/{b}/{name}")
            self.files.move(f"{half}/v/{b}", f"{self.root}/bucket={b}/v={old[0] + 1 if old else 0}")
            if old:
                self.files.delete(old[1])
        self.files.delete(half)

    def load(self, graph_id: int) -> tuple[DataFrame, DataFrame] | None:
        """(nodes, edges) of a graph, or None."""
        nodes = self.table("nodes", [graph_id % BUCKETS]).where(F.col("graph_id") == graph_id)
        return None if nodes.isEmpty() else (nodes, self.table("edges", [graph_id % BUCKETS]).where(F.col("graph_id") == graph_id))

    def sites(self, graph_id: int | None = None) -> DataFrame:
        """graph_id, src, dst, line, call_type, receivers of a graph's call sites, or of all graphs."""
        rows = self.table("sites") if graph_id is None else self.table("sites", [graph_id % BUCKETS]).where(F.col("graph_id") == graph_id)
        return rows.select("graph_id", "src", F.inline("calls"))

    def dump(self, graph_id: int, path: str) -> None:
        """A graph as text: a line for each edge, then one for each source with its call sites as JSON."""
        here = [graph_id % BUCKETS]
        edges = self.table("edges", here).where(F.col("graph_id") == graph_id).select(F.lit(0).alias("part"), "src", "dst", F.concat_ws(" -> ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
        meta = self.table("sites", here).where(F.col("graph_id") == graph_id).select(F.lit(1).alias("part"), "src", F.lit(None).cast("long").alias("dst"), F.concat(F.col("src").cast("string"), F.lit(": "), F.to_json("calls")).alias("value"))
        edges.unionByName(meta).orderBy("part", "src", "dst").select("value").write.mode("overwrite").text(path)


def _grouped(sites: DataFrame) -> DataFrame:
    """Call sites by graph and source, in order."""
    return sites.groupBy("graph_id", "src").agg(F.array_sort(F.collect_list(F.struct("dst", "line", "call_type", "receivers"))).alias("calls"))


def write_edge_list(edges: DataFrame, names: DataFrame, path: str) -> None:
    """Lines 'uri->uri' of edges (src, dst) with names (node, uri)."""
    j = edges.join(names.select(F.col("node").alias("src"), F.col("uri").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("uri").alias("b")), "dst")
    j.select(F.concat_ws("->", "a", "b").alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes doubled, line ends in values as blanks."""
    clean = [F.regexp_replace(F.col(f"`{f.name}`"), r"\R", " ").alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rows.schema]
    rows.select(*clean).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, json): {nodes, externals, edges} of each graph, lists sorted. A graph is one row, as large as it is."""
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.sort_array(F.collect_list(F.when(F.col("external"), F.col("node")))).alias("externals"))
    e = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.array("src", "dst"))).alias("edges"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct("nodes", "externals", F.coalesce("edges", F.array().cast("array<array<bigint>>")).alias("edges"))).alias("json"))


def read_graph_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (graph_id, json)."""
    g = rows.select("graph_id", F.from_json("json", "nodes array<bigint>, externals array<bigint>, edges array<array<bigint>>").alias("g"))
    nodes = g.select("graph_id", F.explode("g.nodes").alias("node"), F.col("g.externals").alias("x")).select("graph_id", "node", F.array_contains("x", F.col("node")).alias("external"))
    edges = g.select("graph_id", F.explode("g.edges").alias("e")).select("graph_id", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"))
    return nodes, edges


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and moved there in one step if it is missing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p(path)):
        half = f"{path}.building"
        build().write.mode("overwrite").parquet(half)
        fs.rename(p(half), p(path))
    return spark.read.parquet(path)


def read_coordinates(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(group, artifact, version) of a text file with a coordinate in each line; ``malformed_coordinates`` has the other lines."""
    line, parts = _coordinate_lines(spark, path, header)
    return line.where(F.size(parts) == 3).select(parts[0].alias("group"), parts[1].alias("artifact"), parts[2].alias("version"))


def malformed_coordinates(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(line) of the lines that are no coordinate; blank ones are none either."""
    line, parts = _coordinate_lines(spark, path, header)
    return line.where((F.size(parts) != 3) & (F.trim("line") != "")).select("line")


def _coordinate_lines(spark: SparkSession, path: str, header: bool):
    lines = spark.read.option("header", header).option("sep", "\u0001").csv(path)
    return lines.select(F.col(f"`{lines.columns[0]}`").alias("line")), F.split(F.trim("line"), ":")


def random_graphs(spark: SparkSession, graphs: int, nodes: int, arcs: int, seed: int) -> DataFrame:
    """(graph_id, src, dst): seeded random graphs whose arcs prefer low numbers, src larger than dst."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(2**30)) / 2**30
    rows = spark.range(graphs * arcs).select((F.col("id") % graphs).alias("graph_id"), F.floor(1 + u(1) * (nodes - 1)).alias("src"), u(2).alias("r"))
    return rows.select("graph_id", "src", F.floor(F.col("src") * F.col("r") * F.col("r")).alias("dst")).distinct()
