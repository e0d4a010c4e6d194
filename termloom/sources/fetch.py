"""Ingest: chapters, pages and form requests over HTTP, one partition a request, to be landed first."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Timeout and bounds of the pause after a request, in seconds.
TIMEOUT, PAUSE = 30, (1.0, 3.0)


class Requests(DataSource):
    """spark.read.format("requests").option("urls", JSON list): (ord, url, body). Options pause
    (false: none between requests) and timeout. A failed request fails the task."""

    @classmethod
    def name(cls) -> str:
        return "requests"

    def schema(self) -> str:
        return "ord int, url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return RequestReader(self.options)


class RequestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.timeout = float(options.get("timeout", TIMEOUT))
        self.pause = options.get("pause", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, u)) for k, u in enumerate(self.urls)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k, url = partition.value
        with urlopen(url, timeout=self.timeout) as r:
            body = r.read().decode("utf-8")
        if self.pause:
            time.sleep(random.uniform(*PAUSE))
        yield k, url, body


def with_query(url: str, data: dict[str, str]) -> str:
    """A GET request of a form: the fields replace the URL's query."""
    return f"{url.partition('#')[0].partition('?')[0]}?{urlencode(data)}"


def fetched(spark: SparkSession, urls: list[str], pause: bool = True) -> DataFrame:
    """(ord, url, body) of the URLs, in a partition each."""
    spark.dataSource.register(Requests)
    return spark.read.format("requests").option("urls", json.dumps(urls)).option("pause", str(pause).lower()).load()


def exists(path: str) -> bool:
    """Whether a file of the driver is there; errors other than its absence are raised."""
    try:
        Path(path).stat()
    except FileNotFoundError:
        return False
    return True
