"""Snapshots of registries (licensed companies, alerts) as a data source: `spark.read.format("registry_snapshot")`."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith

#: Names that a snapshot's list of entries may have, and those of an entry's name.
LISTS = ("companies", "entities", "licensees", "importers", "data")
NAMES = ("name", "company_name")
SCHEMA = "name string, name_lower string, source string, ord int, url string, date string, file string"


@dataclass
class Snapshot(InputPartition):
    path: str


def _files(path: str):
    """The file system and the sorted snapshots below a path or URI of any store that Arrow reads."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return system, [at]
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.path.endswith(".json"))


class SnapshotReader(DataSourceReader):
    """A partition for each snapshot; filters on the lower-case name and on the source are applied while it is read, so that only rows that match leave Python."""

    def __init__(self, path: str):
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            kind = type(f)
            if kind in (EqualTo, EqualNullSafe, In, StringStartsWith, StringContains) and f.attribute in (("name_lower",), ("source",)):
                self.wanted.append((f.attribute[0], kind.__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Snapshot(p) for p in _files(self.path)[1]]

    def _matches(self, row: dict) -> bool:
        test = {"EqualTo": lambda a, b: a == b, "EqualNullSafe": lambda a, b: a == b, "In": lambda a, b: a in b, "StringStartsWith": lambda a, b: a.startswith(b), "StringContains": lambda a, b: b in a}
        return all((row[c] is None and kind == "EqualNullSafe" and v is None) or (row[c] is not None and v is not None and test[kind](row[c], v)) for c, kind, v in self.wanted)

    def read(self, partition: Snapshot) -> Iterator[tuple]:
        system, _ = _files(self.path)
        with system.open_input_stream(partition.path) as f:
            raw = json.loads(f.read().decode("utf-8"))
        source = raw.get("source") if isinstance(raw, dict) else None
        entries = raw if isinstance(raw, list) else next((raw[k] for k in LISTS if isinstance(raw.get(k), list)), [])
        for n, e in enumerate(entries):
            name = next((e[k] for k in NAMES if e.get(k)), None) if isinstance(e, dict) else e if isinstance(e, str) else None
            if not name:
                continue
            of = e if isinstance(e, dict) else {}
            row = {"name": name, "name_lower": name.lower().strip(), "source": source, "ord": n, "url": of.get("url"), "date": of.get("date"), "file": partition.path.rsplit("/", 1)[-1]}
            if self._matches(row):
                yield tuple(row.values())


class RegistrySource(DataSource):
    """Entries of JSON snapshots, in their order (`ord`) by file: name, name_lower, source, ord, url, date, file. Option `path`: a snapshot or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "registry_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistrySource)
