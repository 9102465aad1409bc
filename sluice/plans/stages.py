"""Stages of a run as tables that outlive it: what was written once is not done again.

A stage's table, and an action (a merge, an append), leaves a mark once it is
done. A run that was interrupted goes through
the same program again, finds its tables and marks, and goes on where they end;
nothing outside is asked twice for what is stored. Actions are given rows of
stored stages, so one that was done but not marked does the same again.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sluice.sources.warehouse import Warehouse


@dataclasses.dataclass
class Stages:
    """Stages below ``folder``, by name."""

    warehouse: Warehouse
    folder: str

    def done(self, name: str) -> bool:
        return name in self.warehouse.names(f"{self.folder}/_marks")

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, made and written if it is not there; its mark holds its schema."""
        path = f"{self.folder}/{name}"

        def write() -> str:
            df = make()
            df.write.mode("overwrite").parquet(path)
            return df.schema.json()

        self.once(name, write)
        schema = StructType.fromJson(json.loads(self.warehouse.text(f"{self.folder}/_marks/{name}")))
        return self.warehouse.spark.read.schema(schema).parquet(path)

    def once(self, name: str, action: Callable[[], str | None]) -> None:
        """``action``, unless it is marked as done; what it returns is kept in the mark."""
        if not self.done(name):
            self.warehouse.create(f"{self.folder}/_marks/{name}", action() or "")

    def clear(self) -> None:
        self.warehouse.remove(self.folder)
