"""Attributes kept beside a graph: tables of (key, value) with a common surface."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.graph import Graph


class PropertyMap(ABC):
    """Values by key. ``lookup`` answers many keys at once; ``get`` asks for one."""

    @abstractmethod
    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key) -> (key, value)."""

    @abstractmethod
    def put(self, key, value) -> None: ...

    @abstractmethod
    def contains(self, key) -> bool: ...

    @abstractmethod
    def clear(self) -> None: ...

    @abstractmethod
    def size(self) -> int: ...

    def get(self, key):
        return self.lookup(self._one(key)).first()["value"]

    def _one(self, key) -> DataFrame:
        return self.spark.createDataFrame([(key,)], "key long")


class AssociativePropertyMap(PropertyMap):
    """A table of pairs. A missing key reads as the default; without one it is an error."""

    def __init__(self, spark: SparkSession, values: DataFrame | None = None, default=None, kind: str = "double"):
        self.spark, self.default = spark, default
        self.values = values.select("key", "value") if values is not None else spark.createDataFrame([], f"key long, value {kind}")

    def lookup(self, keys: DataFrame) -> DataFrame:
        found = keys.select("key").join(self.values.withColumn("__known", F.lit(True)), "key", "left")
        if self.default is None:
            lost = found.filter(F.col("__known").isNull()).first()
            if lost is not None:
                raise KeyError(lost["key"])
            return found.drop("__known")
        return found.withColumn("value", F.when(F.col("__known"), F.col("value")).otherwise(F.lit(self.default))).drop("__known")

    def put(self, key, value) -> None:
        row = self.spark.range(1).select(F.lit(key).cast("long").alias("key"), F.lit(value).alias("value"))
        self.values = self.values.filter(F.col("key") != key).unionByName(row)

    def put_all(self, rows: DataFrame) -> None:
        self.values = self.values.join(rows.select("key"), "key", "left_anti").unionByName(rows.select("key", "value"))

    def erase(self, key) -> None:
        self.values = self.values.filter(F.col("key") != key)

    def contains(self, key) -> bool:
        return not self.values.filter(F.col("key") == key).isEmpty()

    def set_default(self, value) -> None:
        self.default = value

    def clear(self) -> None:
        self.values = self.values.limit(0)

    def size(self) -> int:
        return self.values.count()

    def items(self) -> DataFrame:
        return self.values


class VectorPropertyMap(AssociativePropertyMap):
    """Dense keys 0..n-1 that grow on writing; what was never written reads as the default."""

    def __init__(self, spark: SparkSession, n: int = 0, default=0.0, values: DataFrame | None = None):
        super().__init__(spark, values, default)
        self.n = n

    def put(self, key, value) -> None:
        super().put(key, value)
        self.n = max(self.n, key + 1)

    def contains(self, key) -> bool:
        return 0 <= key < self.n

    def resize(self, n: int) -> None:
        self.n = n
        self.values = self.values.filter(F.col("key") < n)

    def reserve(self, n: int) -> None:
        """Tables need no room made for them."""

    def clear(self) -> None:
        super().clear()
        self.n = 0

    def size(self) -> int:
        return self.n

    def items(self) -> DataFrame:
        return self.lookup(self.spark.range(self.n).select(F.col("id").alias("key")))


class ConstantPropertyMap(PropertyMap):
    def __init__(self, spark: SparkSession, value):
        self.spark, self.value = spark, value

    def lookup(self, keys: DataFrame) -> DataFrame:
        return keys.select("key", F.lit(self.value).alias("value"))

    def put(self, key, value) -> None:
        """Writes are ignored."""

    def contains(self, key) -> bool:
        return True

    def clear(self) -> None:
        """There is nothing to clear."""

    def size(self) -> int:
        return 0


class IdentityPropertyMap(ConstantPropertyMap):
    def __init__(self, spark: SparkSession):
        super().__init__(spark, None)

    def lookup(self, keys: DataFrame) -> DataFrame:
        return keys.select("key", F.col("key").alias("value"))


def get(m: PropertyMap, key):
    return m.get(key)


def put(m: PropertyMap, key, value) -> None:
    m.put(key, value)


def make_associative_property_map(spark, default=None, values=None, kind="double"):
    return AssociativePropertyMap(spark, values, default, kind)


def make_vector_property_map(spark, n=0, default=0.0):
    return VectorPropertyMap(spark, n, default)


def make_constant_property_map(spark, value):
    return ConstantPropertyMap(spark, value)


def make_identity_property_map(spark):
    return IdentityPropertyMap(spark)


class CompositePropertyMap:
    """Named vertex and edge maps; ``attach`` makes them columns of a graph."""

    def __init__(self):
        self.vertex: dict[str, PropertyMap] = {}
        self.edge: dict[str, PropertyMap] = {}

    def add_vertex_property(self, name: str, m: PropertyMap) -> None:
        self.vertex[name] = m

    def add_edge_property(self, name: str, m: PropertyMap) -> None:
        self.edge[name] = m

    def get_vertex_property(self, name: str) -> PropertyMap | None:
        return self.vertex.get(name)

    def get_edge_property(self, name: str) -> PropertyMap | None:
        return self.edge.get(name)

    def has_vertex_property(self, name: str) -> bool:
        return name in self.vertex

    def has_edge_property(self, name: str) -> bool:
        return name in self.edge

    def remove_vertex_property(self, name: str) -> None:
        self.vertex.pop(name, None)

    def remove_edge_property(self, name: str) -> None:
        self.edge.pop(name, None)

    def clear(self) -> None:
        self.vertex.clear()
        self.edge.clear()

    def attach(self, g: Graph) -> Graph:
        for name, m in self.vertex.items():
            g = g.with_vertex_property(name, m.lookup(g.vertices.select(F.col("id").alias("key"))).withColumnRenamed("key", "id"))
        for name, m in self.edge.items():
            g = g.with_edge_property(name, m.lookup(g.edges.select(F.col("eid").alias("key"))).withColumnRenamed("key", "eid"))
        return g
