"""What the engine reports about itself."""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Callable

log = logging.getLogger(__name__)


class Metrics:
    """Counts and gauges by name and tags; this one drops them."""

    def count(self, name: str, **tags) -> None: ...

    def gauge(self, name: str, value: float, **tags) -> None: ...


class Counters(Metrics):
    """Keeps them in memory."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.gauges: dict = {}

    def count(self, name, **tags):
        self.counts[name, *sorted(tags.items())] += 1

    def gauge(self, name, value, **tags):
        self.gauges[name, *sorted(tags.items())] = value


class Statsd(Metrics):
    """Writes statsd lines with tags to `send`, such as a datagram socket's."""

    def __init__(self, send: Callable[[bytes], object], prefix: str = "cairn"):
        self.send, self.prefix = send, prefix

    def _line(self, name: str, value, kind: str, tags: dict) -> None:
        marks = ",".join(f"{k}:{v}" for k, v in sorted(tags.items()))
        self.send(f"{self.prefix}.{name}:{value}|{kind}{'|#' + marks if marks else ''}".encode())

    def count(self, name, **tags):
        self._line(name, 1, "c", tags)

    def gauge(self, name, value, **tags):
        self._line(name, value, "g", tags)


class Quiet(Metrics):
    """Passes on to another; its errors never reach the engine."""

    def __init__(self, inner: Metrics):
        self.inner = inner

    def count(self, name, **tags):
        try:
            self.inner.count(name, **tags)
        except Exception:
            log.warning("metric %s was lost", name, exc_info=True)

    def gauge(self, name, value, **tags):
        try:
            self.inner.gauge(name, value, **tags)
        except Exception:
            log.warning("metric %s was lost", name, exc_info=True)
