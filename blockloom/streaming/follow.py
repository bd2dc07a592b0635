"""Following a chain: a stream whose offset is a block number.

Each micro-batch fetches the blocks between the last offset and the head, so a
restarted query goes on where its checkpoint ends.
"""

from __future__ import annotations

import json

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from blockloom.plans.blocks import BlockSet, batches
from blockloom.sources.live import Blocks
from blockloom.spec import ChainSpec


class FollowReader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.names = schema.fieldNames()
        self.fetch, self.head = cloudpickle.loads(bytes.fromhex(options["fetch"]))
        self.start, self.tasks, self.batch = int(options["start"]), int(options.get("tasks", "4")), int(options.get("blocksperbatch", "100"))
        self.most = int(options.get("blocksperstep", "10000"))
        self.at = self.start

    def initialOffset(self):
        return {"block": self.start}

    def latestOffset(self):
        head = self.head()
        self.at = max(self.at, min(self.at + self.most, (head + 1) if head is not None else self.at))
        return {"block": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["block"])
        return [Blocks(c.ranges) for c in BlockSet.span(start["block"], end["block"]).chunks(self.tasks)] or [Blocks(())]

    def read(self, partition):
        for chunk in batches(BlockSet(partition.ranges), self.batch) if partition.ranges else []:
            for row in self.fetch(list(chunk)):
                yield tuple(row.get(n) for n in self.names)

    def commit(self, end):
        """Nothing is held back for a batch."""


class FollowSource(DataSource):
    @classmethod
    def name(cls):
        return "blockloom_follow"

    def schema(self):
        return self.options["schema"]

    def streamReader(self, schema):
        return FollowReader(schema, self.options)


def follow(spark: SparkSession, chain: ChainSpec, table: str, start: int = 0, blocks_per_step: int = 10_000) -> DataFrame:
    """A table of a chain as an endless stream of typed rows, from block `start` on."""
    entity = chain.entities[table]
    spark.dataSource.register(FollowSource)
    schema = entity.raw_schema if isinstance(entity.raw_schema, str) else json.dumps(entity.raw_schema.jsonValue())
    raw = spark.readStream.format("blockloom_follow").options(schema=schema, fetch=cloudpickle.dumps((entity.fetch, chain.head)).hex(), start=str(start), blocksPerStep=str(blocks_per_step)).load()
    return entity.typed(raw)
