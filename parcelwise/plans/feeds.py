"""Transports that answer as the remote sources would, from the driver's tables, for queries and tests."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path


def _rows(endpoint: str, name: str, columns: list[str]) -> list[dict]:
    import pyarrow.parquet as pq

    if not endpoint.startswith(("/", "file:")):
        raise OSError(f"{endpoint} doesn't answer")
    return pq.read_table(f"{endpoint.removeprefix('file://')}/{name}.parquet", columns=columns).to_pylist()


@lru_cache(maxsize=1)
def _group(path: str, k: int, changed: int):
    """A row group of a file; the one read last is kept, as pages follow each other."""
    import pyarrow.parquet as pq

    with pq.ParquetFile(path) as file:
        return file.read_row_group(k, columns=["s_suppkey", "s_name"])


def _between(endpoint: str, name: str, at: int, end: int) -> tuple[list[dict], int]:
    """The rows from at to end in the order of the files, of which only the row groups with them are read, and the number of
    all rows, from the files' footers."""
    import pyarrow.parquet as pq

    if not endpoint.startswith(("/", "file:")):
        raise OSError(f"{endpoint} doesn't answer")
    table, rows, start = Path(f"{endpoint.removeprefix('file://')}/{name}.parquet"), [], 0
    for path in sorted(table.glob("*.parquet")) if table.is_dir() else [table]:
        footer = pq.read_metadata(path)
        for k in range(footer.num_row_groups):
            n = footer.row_group(k).num_rows
            if start < end and start + n > at:
                first = max(at - start, 0)
                rows += _group(str(path), k, path.stat().st_mtime_ns).slice(first, min(end - start, n) - first).to_pylist()
            start += n
    return rows, start


def pages(endpoint: str, parameters: dict) -> dict:
    """A page of the suppliers as features."""
    at = int(parameters["startIndex"])
    rows, total = _between(endpoint, parameters["layer"], at, at + int(parameters["count"]))
    some = [{"id": f"supplier/{r['s_suppkey']}", "properties": {"name": r["s_name"]}, "geometry": {"type": "Point", "coordinates": [r["s_suppkey"] * 0.5, 1.0]}} for r in rows]
    return {"numberMatched": total, "features": some}


def elements(endpoint: str, parameters: dict) -> dict:
    """Elements of the customers that the query asks for, and of the nodes that their ways refer to."""
    asked = set(re.findall(r"(node|way|relation)\[([a-z]+)", parameters["data"]))
    out = []
    for r in _rows(endpoint, "customer", ["c_custkey"]):
        i = r["c_custkey"]
        kind = ("node", "way", "way", "relation")[i % 4]
        tags = {k: "yes" for k, n in (("building", 3), ("highway", 5), ("amenity", 7), ("shop", 2)) if i % n == 0}
        if any((kind, k) in asked for k in tags):
            nodes = [10**6 + i, 10**6 + i + 1] if kind == "way" else []
            out.append({"type": kind, "id": i, "tags": tags, "nodes": nodes, "lon": i * 0.5 if kind == "node" else None})
            if ">;" in parameters["data"]:
                out += [{"type": "node", "id": n, "lon": n * 0.5} for n in nodes]
    return {"elements": out}
