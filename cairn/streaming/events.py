"""Refresh events: a node says that a catalog has a new snapshot, or asks the leader for one."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT, REQUEST = "EVENT", "REQUEST"
SCHEMA = "catalog_name string, source_node_id string, version bigint, hash string, timestamp timestamp, kind string"


@dataclass(frozen=True)
class RefreshEvent:
    catalog_name: str
    source_node_id: str
    version: int
    hash: str
    timestamp: datetime
    kind: str = EVENT

    def to_json(self) -> str:
        when = self.timestamp if self.timestamp.tzinfo else self.timestamp.replace(tzinfo=timezone.utc)
        return json.dumps(asdict(self) | {"timestamp": when.isoformat()}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> RefreshEvent:
        """A missing or unknown kind is an EVENT; any other missing field is an error."""
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError("an event is an object")
        try:
            kind = found.get("kind") if found.get("kind") in (EVENT, REQUEST) else EVENT
            when = datetime.fromisoformat(found["timestamp"])
            return RefreshEvent(found["catalog_name"], found["source_node_id"], int(found["version"]), found["hash"], when, kind)
        except (KeyError, TypeError) as e:
            raise ValueError(f"an event without {e}") from e


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of JSON texts in a column `value`, in batch or stream; malformed ones are left out."""
    rows = lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    whole = F.lit(True)
    for name in ("catalog_name", "source_node_id", "version", "hash", "timestamp"):
        whole &= F.col(name).isNotNull()
    return rows.where(whole).withColumn("kind", F.when(F.col("kind") == REQUEST, REQUEST).otherwise(EVENT))


def latest_per_catalog(events: DataFrame, by: str = "timestamp") -> DataFrame:
    """The last event of each catalog and kind: what a batch of them comes down to."""
    others = [c for c in events.columns if c not in ("catalog_name", "kind")]
    last = events.groupBy("catalog_name", "kind").agg(F.max_by(F.struct(*others), F.struct(by, "version", "source_node_id", "hash")).alias("e"))
    return last.select("catalog_name", "kind", "e.*")
