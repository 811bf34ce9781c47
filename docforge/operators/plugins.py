"""Rules written in Python and called from SQL: each states the columns of its results itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, UserDefinedTableFunction


@dataclass(frozen=True)
class Plugin:
    """A rule over the rows of one key in order: `check` takes a row and the row before (None for the first) and gives results as tuples of `schema`."""

    name: str
    schema: str
    key: str
    order: str
    check: Callable[[Row, Row | None], Iterator[tuple]]


def table_function(plugin: Plugin) -> UserDefinedTableFunction:
    """SELECT * FROM name(TABLE(rows)): the key's rows are dealt to one task and sorted there by Spark, as the function asks for; a row at a time is held."""

    fields = StructType.fromDDL(plugin.schema).fields

    class Rule:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{plugin.name} takes a table")
            missing = [c for c in (plugin.key, plugin.order) if c not in rows.dataType.names]
            if missing:
                raise ValueError(f"{plugin.name} needs the columns {', '.join(missing)}")
            schema = StructType().add(plugin.key, rows.dataType[plugin.key].dataType).add("rule_name", StringType())
            for f in fields:
                schema = schema.add(f)
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(plugin.key)], orderBy=[OrderingColumn(plugin.order)])

        def __init__(self):
            self.before = None

        def eval(self, row: Row):
            for out in plugin.check(row, self.before):
                yield (row[plugin.key], plugin.name, *out)
            self.before = row

    return F.udtf(Rule)


def register(spark: SparkSession, plugin: Plugin) -> None:
    spark.udtf.register(plugin.name.replace(".", "_"), table_function(plugin))
