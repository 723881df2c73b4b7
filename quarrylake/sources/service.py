"""A data source over captured answers of search services, with filters that it can apply itself.

    spark.dataSource.register(CapturedHits)
    spark.read.format("captured_hits").option("path", folder).load().where("engine = 'a'")

The folder holds JSON lines in a folder for each engine (engine=a/...), as Spark
writes them with partitionBy("engine"); each file is a partition, and files of
engines that a filter leaves out are not opened. A service declares for each
filter how it honours it: native (the source applies it), emulated or unsupported
(Spark applies it after the read).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

# What services do with filters.
CAPABILITIES = {
    "a": {"include_domains": "native", "date": "post_filtered", "language": "native"},
    "b": {"include_domains": "emulated", "file_type": "emulated"},
    "c": {},
}


class CapturedHits(DataSource):
    """Rows of (engine, query, position, title, url) in the folder named by the option `path`, a URI that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "captured_hits"

    def schema(self) -> str:
        return "engine STRING, query STRING, position INT, title STRING, url STRING"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("engine",), ("query",)):
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, place = pafs.FileSystem.from_uri(self.path)
        found = system.get_file_info(pafs.FileSelector(place, recursive=True))
        files = sorted(x.path for x in found if x.is_file and x.base_name.endswith(".json"))
        engine = lambda path: next((part[7:] for part in path.split("/") if part.startswith("engine=")), None)
        kept = [x for x in files if "engine" not in self.wanted or engine(x) == self.wanted["engine"]]
        return [InputPartition((x, engine(x))) for x in kept] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        file, engine = partition.value
        system, _ = pafs.FileSystem.from_uri(self.path)
        with system.open_input_stream(file) as stream:
            for line in io.TextIOWrapper(stream, "utf-8"):
                row = {"engine": engine, **json.loads(line)}
                if all(row.get(k) == v for k, v in self.wanted.items()):
                    yield row.get("engine"), row.get("query"), row.get("position"), row.get("title"), row.get("url")


def filter_modes(spark: SparkSession, filters: DataFrame) -> DataFrame:
    """(question_id, engine, filter, mode): how each service treats each filter that a question sets. `filters` has
    question_id and active, an array of names."""
    rows = [(e, f, m) for e, of in CAPABILITIES.items() for f, m in of.items()]
    known = spark.createDataFrame(rows, "engine string, filter string, mode string")
    engines = spark.createDataFrame([(e,) for e in CAPABILITIES], "engine string")
    asked = filters.select("question_id", F.explode("active").alias("filter")).join(F.broadcast(engines), F.lit(True))
    return asked.join(F.broadcast(known), ["engine", "filter"], "left").select("question_id", "engine", "filter", F.coalesce("mode", F.lit("unsupported")).alias("mode"))
