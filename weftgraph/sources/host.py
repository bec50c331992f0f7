"""The commit list of a hosting service as a Python data source, at rest and as a stream.

`register(spark, fetch)` makes the format `commit_list` known. A batch read has a partition
for each page, which its task fetches; a short page ends the list, and the ones after it
are empty. A stream's offset is the newest sha that was seen: a micro-batch lists what
stands above it, oldest first, and one that runs again after a failure lists the same
commits again. Options: repo, most (commits at most that a batch read or the stream's
first micro-batch lists, 200).

Cases: a page that can't be fetched has no rows; a commit without a sha is left out; if the
newest seen sha is no longer listed (its history was rewritten), everything up to `most`
is listed again, as the reader of the stream knows which commits are stored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from weftgraph.sources.readers import PAGE, Fetch, with_retries

FORMAT = "commit_list"


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class _Host:
    """The list of one repository's commits, page by page."""

    def __init__(self, fetch: Fetch, options: dict[str, str]) -> None:
        self.fetch, self.repo, self.most = fetch, options["repo"], int(options.get("most", 200))

    def page(self, number: int) -> list[str]:
        body = with_retries(self.fetch, f"repos/{self.repo}/commits?per_page={PAGE}&page={number + 1}")
        try:
            listed = json.loads(body) if body else []
        except ValueError:
            listed = []
        return [c["sha"] for c in listed if isinstance(c, dict) and c.get("sha")] if isinstance(listed, list) else []

    def newest_down(self) -> Iterator[str]:
        """All shas, newest first, fetched as far as they are asked for."""
        number, left = 0, True
        while left:
            shas = self.page(number)
            yield from shas
            number, left = number + 1, len(shas) == PAGE


class _Reader(DataSourceReader):
    def __init__(self, host: _Host) -> None:
        self.host = host

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(-(-self.host.most // PAGE))]

    def read(self, partition: Page) -> Iterator[tuple]:
        for k, sha in enumerate(self.host.page(partition.number)):
            pos = partition.number * PAGE + k
            if pos < self.host.most:
                yield self.host.repo, pos, sha


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, host: _Host) -> None:
        self.host = host

    def initialOffset(self) -> dict:
        return {"sha": ""}

    def _above(self, start: str, end: str | None = None) -> list[str]:
        """What was listed after `start` up to `end`, oldest first."""
        out: list[str] = []
        below_end = end is None
        for n, sha in enumerate(self.host.newest_down()):
            if sha == start or n >= self.host.most and not start:
                break
            below_end = below_end or sha == end
            if below_end:
                out.append(sha)
        return out[-self.host.most :][::-1] if start == "" else out[::-1]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        shas = self._above(start["sha"])
        return iter([(self.host.repo, n, sha) for n, sha in enumerate(shas)]), {"sha": shas[-1] if shas else start["sha"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(self.host.repo, n, sha) for n, sha in enumerate(self._above(start["sha"], end["sha"]))])


def register(spark: SparkSession, fetch: Fetch, name: str = FORMAT) -> str:
    """Makes the format known to a session, and its name."""

    class CommitList(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "repo string, pos int, sha string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(_Host(fetch, self.options))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Stream(_Host(fetch, self.options))

    spark.dataSource.register(CommitList)
    return name
