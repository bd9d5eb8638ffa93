"""Saved runs as a data source: the catalogue's features from each run's own files.

A folder of runs has ``log/chain_id=N`` with a run's moves in Parquet and
``settings/chain_id=N`` with its settings as one line of JSON. Every run is a
partition. A filter on ``chain_id`` or ``filepath`` is pushed to the list of
runs, so that only the runs asked for are opened; of a log only the footers
are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .files import CATALOGUE, save_log

#: What is found in the files themselves; all else stands in the settings.
FOUND = ("filepath", "run_length", "mod_time")
NAMES = [f.split()[0] for f in CATALOGUE.replace(", ", ",").split(",")]


def save_runs(log: DataFrame, settings: DataFrame, path: str) -> None:
    """Writes the logs of all chains, and ``settings``: chain_id and a column for each setting."""
    save_log(log, f"{path}/log")
    line = F.to_json(F.struct(*[c for c in settings.columns if c != "chain_id"])).alias("value")
    settings.select("chain_id", line).write.partitionBy("chain_id").text(f"{path}/settings")


def register(spark: SparkSession) -> None:
    """Makes the source known; Spark refuses one that takes filters unless the session lets it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunSource)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of the runs saved under ``path``, and their chain_id."""
    register(spark)
    return spark.read.format(RunSource.name()).load(path)


@dataclass
class Run(InputPartition):
    chain_id: int
    folder: str
    settings: str


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(system, folder: str) -> list:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder))
    return [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]


class RunReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path.rstrip("/"), []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("chain_id",), ("filepath",)):
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _open(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(f"{root}/log")):
            key, _, value = info.base_name.partition("=")
            if key != "chain_id":
                continue
            about = {"chain_id": int(value), "filepath": f"{self.path}/log/{info.base_name}"}
            if all(about[name] in values for name, values in self.wanted):
                out.append(Run(about["chain_id"], about["filepath"], f"{self.path}/settings/{info.base_name}"))
        return out or [Run(-1, "", "")]

    def read(self, run: Run):
        import pyarrow.parquet as pq

        if not run.folder:
            return
        system, folder = _open(run.folder)
        logs = _files(system, folder)
        length = 0
        for f in logs:
            with system.open_input_file(f.path) as opened:
                length += pq.ParquetFile(opened).metadata.num_rows
        _, folder = _open(run.settings)
        settings: dict = {}
        for f in _files(system, folder):
            with system.open_input_file(f.path) as opened:
                for line in opened.read().decode().splitlines():
                    settings |= json.loads(line)
        found = {"filepath": run.folder, "run_length": length, "mod_time": max((f.mtime.timestamp() for f in logs), default=None)}
        yield (run.chain_id, *[found[n] if n in FOUND else settings.get(n) for n in NAMES])


class RunSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_runs"

    def schema(self) -> str:
        return f"chain_id LONG, {CATALOGUE}"

    def reader(self, schema) -> RunReader:
        return RunReader(self.options["path"])
