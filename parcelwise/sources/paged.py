"""A paged remote source as a Spark data source: a count first, then partitions of a page or, of many pages, several.

Options: endpoints (comma-separated; the first that answers wins), layer, bbox, page (rows a page, 5000), limit (rows
beyond which the scan fails, 12000; none for a source that may have any number), transport (module:function taking endpoint and parameters, returning a dict with
numberMatched and features; HTTP by default). A body that isn't JSON, a remark, or an empty page before the end fails.
"""

from __future__ import annotations

import importlib
import json
import math
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def http(endpoint: str, parameters: dict) -> dict:
    with urllib.request.urlopen(f"{endpoint}?{urllib.parse.urlencode(parameters)}", timeout=90) as answer:
        return json.load(answer)


def first_answer(endpoints: list[str], parameters: dict, transport) -> dict:
    """The first endpoint's answer that is whole."""
    errors = []
    for endpoint in endpoints:
        try:
            got = transport(endpoint, parameters)
            if not isinstance(got, dict) or got.get("remark") or not ("features" in got or got.get("elements")):
                raise ValueError("not a whole answer")
            return got
        except Exception as e:  # noqa: BLE001  the next endpoint may answer
            errors.append(f"{endpoint}: {e}")
    raise RuntimeError("no endpoint answered: " + "; ".join(errors))


#: Partitions of a scan; of more pages than that, each reads several, one after the other.
PARTITIONS = 256


class Pages(InputPartition):
    def __init__(self, start: int, rows: int):
        self.start, self.rows = start, rows


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoints = [x for x in options.get("endpoints", "").split(",") if x]
        self.base = {k: options[k] for k in ("layer", "bbox") if k in options}
        self.page, self.limit = int(options.get("page", 5000)), options.get("limit", "12000")
        module, _, name = options.get("transport", "parcelwise.sources.paged:http").partition(":")
        self.where = (module, name)

    def _get(self, start: int, rows: int) -> dict:
        transport = getattr(importlib.import_module(self.where[0]), self.where[1])
        return first_answer(self.endpoints, self.base | {"startIndex": start, "count": rows}, transport)

    def partitions(self):
        first = self._get(0, self.page)
        try:
            total = int(first.get("numberMatched") or 0)
        except (TypeError, ValueError):  # 'unknown': one page is all there is
            total = 0
        total = total or len(first["features"])
        if self.limit != "none" and total > int(self.limit):
            raise RuntimeError(f"{total} rows are more than the limit of {self.limit}")
        rows = self.page * max(1, math.ceil(total / self.page / PARTITIONS))
        return [Pages(at, min(rows, total - at)) for at in range(0, total, rows)] or [Pages(0, 0)]

    def read(self, partition):
        at, end = partition.start, partition.start + partition.rows
        while at < end:
            got = self._get(at, min(self.page, end - at))["features"]
            if not got:
                raise RuntimeError(f"an empty page at {at} of {end}")
            for f in got:
                yield (str(f.get("id")), json.dumps(f.get("properties") or {}), json.dumps(f.get("geometry")))
            at += len(got)


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "paged_features"

    def schema(self):
        return "id string, properties string, geometry string"

    def reader(self, schema):
        return PagedReader(dict(self.options))
