"""Open map elements of a remote source as a Spark data source, asked for by tags and box.

Options: endpoints (comma-separated; the first that answers wins), box (south,west,north,east), transport (as in paged).
The query asks for the tags that the scene needs and for the nodes of the ways found. Conditions on `kind` are pushed
down: only clauses of that kind are asked for (the session needs spark.sql.python.filterPushdown.enabled, which
register() sets). An answer with a remark or without elements fails.
"""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from parcelwise.sources.osm import ANY_KIND, WAYS
from parcelwise.sources.paged import PagedSource, first_answer

KINDS = ("node", "way", "relation")


def query_text(box: str, kinds: tuple[str, ...] = KINDS) -> str:
    """The remote query for elements of some kinds, and for the nodes that ways among them refer to."""
    clauses = [f"{k}[{tag}]({box});" for tag in ANY_KIND for k in kinds]
    if "way" in kinds:
        clauses += [f"way[{tag}]({box});" for tag in WAYS] + [f"way[barrier=hedge]({box});"]
    more = ">;out skel qt;" if "node" in kinds and "way" in kinds else ""
    return f"[out:json][timeout:120];({''.join(clauses)});out body;{more}"


class ElementsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoints = [x for x in options.get("endpoints", "").split(",") if x]
        self.box, self.kinds = options.get("box", ""), KINDS
        module, _, name = options.get("transport", "parcelwise.sources.paged:http").partition(":")
        self.where = (module, name)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",) and f.value in self.kinds:
                self.kinds = (f.value,)
            else:
                yield f

    def partitions(self):
        return [InputPartition(self.kinds)]

    def read(self, partition):
        transport = getattr(importlib.import_module(self.where[0]), self.where[1])
        got = first_answer(self.endpoints, {"data": query_text(self.box, partition.value)}, transport)
        seen = set()
        for e in got["elements"]:
            if (e["type"], e["id"]) not in seen and e["type"] in partition.value:
                seen.add((e["type"], e["id"]))
                yield (e["type"], e["id"], e.get("tags") or {}, e.get("nodes") or [], e.get("lon"), e.get("lat"))


class ElementsSource(DataSource):
    @classmethod
    def name(cls):
        return "map_elements"

    def schema(self):
        return "kind string, id long, tags map<string,string>, nodes array<long>, lon double, lat double"

    def reader(self, schema):
        return ElementsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the remote sources known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    spark.dataSource.register(ElementsSource)
