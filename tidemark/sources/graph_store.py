"""A graph on disk that is replaced as a whole: versions in folders of their own, and a pointer to the one that counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Version of the tables' layout.
SCHEMA_VERSION = "1"
POINTER = "CURRENT"


class _Folder:
    """Files of a folder through Spark's own file systems, so that any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway, self.path = spark.sparkContext._gateway, path.rstrip("/")
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside, then rename it over the old one: readers see the old text or the new, never none."""
        beside = self._at(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        how = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(beside), self.fs.makeQualified(self._at(name)), how)

    def versions(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at("")) if s.isDirectory() and s.getPath().getName().startswith("v-")] if self.fs.exists(self._at("")) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, tables: dict[str, DataFrame] | None = None) -> str:
    """Replace the graph at path by nodes (by node_type), edges (by type) and further `tables` (a summary, say), and name its version.

    All tables are written to a folder of their own; then one rename moves the pointer there. Whatever dies before leaves
    the old graph whole; a version that no pointer names is removed by the next write, but for the one before, which
    readers may still have open. A place that holds another schema version is refused before anything is written.
    """
    spark = nodes.sparkSession
    folder = _Folder(spark, path)
    old = folder.read(POINTER)
    if old and (found := old.split()[0]) != SCHEMA_VERSION:
        raise ValueError(f"{path} holds graph schema {found}, not {SCHEMA_VERSION}")
    version = f"v-{uuid.uuid4().hex}"
    nodes.write.partitionBy("node_type").parquet(f"{folder.path}/{version}/nodes")
    edges.write.partitionBy("type").parquet(f"{folder.path}/{version}/edges")
    for name, table in (tables or {}).items():
        table.write.parquet(f"{folder.path}/{version}/{name}")
    folder.replace(POINTER, f"{SCHEMA_VERSION} {version}\n")
    for stale in folder.versions():
        if stale != version and not (old and stale == old.split()[1]):
            folder.delete(stale)
    return version


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the version that the pointer names; one pointer read for both, so they always belong together."""
    nodes, edges = read_tables(spark, path, "nodes", "edges")
    return nodes, edges


def read_tables(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    """Tables of one version of the graph at path."""
    said = _Folder(spark, path).read(POINTER)
    if said is None:
        raise FileNotFoundError(f"no graph at {path}")
    found, version = said.split()
    if found != SCHEMA_VERSION:
        raise ValueError(f"graph schema {found}, not {SCHEMA_VERSION}")
    return [spark.read.parquet(f"{path.rstrip('/')}/{version}/{name}") for name in names]
