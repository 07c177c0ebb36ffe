"""Polled registries as a Spark data source, for batches and streams.

A listing is split into one partition for each (organisation, date); a partition is read by a transport, a function
of the partition that yields (source_id, body) and does its own HTTP. The transport is injected, so that tests and
replays need no network, and retried; a partition that keeps failing fails its task, and Spark retries that. As a stream
the offset is the last day listed: a batch takes the days since, whatever happens to it is taken up again from there.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "organisation_id bigint, fetcher_type string, site string, listed_on string, source_id string, body string"
Transport = Callable[[dict], Iterator[tuple[str, str]]]


class Listing(InputPartition):
    def __init__(self, value: dict) -> None:
        super().__init__(json.dumps(value, sort_keys=True))


class _Polled:
    def __init__(self, options: dict, transport: Transport, attempts: int, wait: float) -> None:
        self.options, self.transport, self.attempts, self.wait = options, transport, attempts, wait

    def listings(self, last: date, days: int) -> list[Listing]:
        orgs = json.loads(self.options["organisations"])
        return [Listing({**o, "listed_on": (last - timedelta(days=k)).isoformat()}) for o in orgs for k in range(days)]

    def read(self, partition: Listing) -> Iterator[tuple]:
        p = json.loads(partition.value)
        for attempt in range(self.attempts):
            try:
                rows = list(self.transport(p))
                break
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.wait)
        for source_id, body in rows:
            yield p["id"], p["fetcher_type"], p["site"], p["listed_on"], source_id, body


class _Reader(_Polled, DataSourceReader):
    def partitions(self) -> list[Listing]:
        return self.listings(date.fromisoformat(self.options["date"]), int(self.options.get("days", "7")))


class _StreamReader(_Polled, DataSourceStreamReader):
    """Days from the one after `date` minus `days` to today, or to the option `until`."""

    def initialOffset(self) -> dict:
        return {"day": (date.fromisoformat(self.options["date"]) - timedelta(days=int(self.options.get("days", "7")))).isoformat()}

    def latestOffset(self, *_) -> dict:
        return {"day": self.options.get("until") or date.today().isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Listing]:
        first, last = date.fromisoformat(start["day"]), date.fromisoformat(end["day"])
        return self.listings(last, max(0, (last - first).days))

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


def register(spark: SparkSession, transport: Transport, name: str = "registry", attempts: int = 3, wait: float = 1.0) -> None:
    """Make spark.read.format(name) and spark.readStream.format(name) available; options: organisations (JSON list of id, fetcher_type, site), date, days."""

    class Registry(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), transport, attempts, wait)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(dict(self.options), transport, attempts, wait)

    spark.dataSource.register(Registry)
