"""Refresh of catalogs across processes."""

from cairn.streaming.engine import Engine, RetryPolicy
from cairn.streaming.events import EVENT, REQUEST, RefreshEvent, latest_per_catalog, parse_events
from cairn.streaming.leader import FileLease, SingleNode
from cairn.streaming.metrics import Counters, Metrics
from cairn.streaming.sync import FileSync, HttpSync, KafkaSync, TableSync

__all__ = ["EVENT", "REQUEST", "Counters", "Engine", "FileLease", "FileSync", "HttpSync", "KafkaSync", "Metrics", "RefreshEvent", "RetryPolicy", "SingleNode", "TableSync", "latest_per_catalog", "parse_events"]
