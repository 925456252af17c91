"""Models of a warehouse as data: what each is made from, how, and by which key it grows; built in the order of their inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from terraloom.operators.star import upsert


@dataclass(frozen=True)
class Model:
    """inputs: names of tables or other models, passed to `make` in order. key and period: where given, a stored result is kept and only rows beyond its highest period are merged."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    key: tuple[str, ...] = ()
    period: str | None = None


class Warehouse:
    """Models over tables. `table` reads a source table; `store` and `load`, where given, write and read models (load gives None for one that was never stored)."""

    def __init__(self, models: Iterable[Model], table: Callable[[str], DataFrame], store: Callable[[str, DataFrame], None] | None = None, load: Callable[[str], DataFrame | None] | None = None):
        self.models: Mapping[str, Model] = {m.name: m for m in models}
        self.table, self.store, self.load = table, store, load

    def order(self, *wanted: str) -> list[str]:
        """The models that the wanted ones need (all, if none are named), each after its inputs; a cycle is a ValueError."""
        graph: dict[str, set[str]] = {}
        left = list(wanted or self.models)
        while left:
            name = left.pop()
            if name not in graph:
                graph[name] = {i for i in self.models[name].inputs if i in self.models}
                left += graph[name]
        return list(TopologicalSorter(graph).static_order())

    def build(self, *wanted: str) -> dict[str, DataFrame]:
        """The wanted models (all, if none are named). A model that several use is one DataFrame, so Spark reuses its exchanges; a stored one is read back."""
        made: dict[str, DataFrame] = {}
        for name in self.order(*wanted):
            m = self.models[name]
            fresh = m.make(*[made[i] if i in made else self.table(i) for i in m.inputs])
            old = self.load(name) if self.load and m.period else None
            if old is not None:
                fresh = upsert(old, fresh, m.key, m.period)
            if self.store:
                self.store(name, fresh)
                fresh = self.load(name) if self.load else fresh
            made[name] = fresh
        return {n: made[n] for n in wanted or self.models}


def stored(spark: SparkSession, folder: str):
    """store and load for Parquet tables in a shared folder; a new version is written beside the old one and then takes its place, so a run that fails leaves the old one."""
    fs = spark._jvm.org.apache.hadoop.fs
    path = lambda name, part: fs.Path(f"{folder.rstrip('/')}/{name}/{part}")

    def store(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(path(name, "next").toString())
        system = path(name, "").getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(path(name, "now"), True)
        system.rename(path(name, "next"), path(name, "now"))

    def load(name: str) -> DataFrame | None:
        at = path(name, "now")
        return spark.read.parquet(at.toString()) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None

    return store, load
