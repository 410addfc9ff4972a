"""Which node loads and publishes."""

from __future__ import annotations

import json
import logging
import os
import threading
import time
from collections.abc import Callable

log = logging.getLogger(__name__)


class SingleNode:
    """Always the leader."""

    def start(self) -> None: ...

    def stop(self) -> None: ...

    def is_leader(self) -> bool:
        return True

    def on_change(self, listener: Callable[[bool], None]) -> None:
        """Leadership never changes here."""


class FileLease:
    """The node that holds a lease file leads; it must renew within `seconds`. For nodes that share a
    folder. A holder counts itself out after two thirds of the lease, before others may take it. Started,
    it renews (or tries to take) the lease three times in each of its terms until it is stopped."""

    def __init__(self, path: str, node_id: str, seconds: float = 15, clock: Callable[[], float] = time.time):
        self.path, self.node_id, self.seconds, self.clock = path, node_id, seconds, clock
        self._until, self._led, self._listeners = 0.0, False, []
        self._ended, self._lock = threading.Event(), threading.RLock()

    def start(self) -> None:
        self._ended.clear()
        self.renew()
        threading.Thread(target=self._keep, args=(self._ended,), name="lease", daemon=True).start()

    def _keep(self, ended: threading.Event) -> None:
        while not ended.wait(self.seconds / 3):
            try:
                self.renew()
            except OSError:
                log.warning("the lease %s wasn't renewed", self.path, exc_info=True)

    def stop(self) -> None:
        self._ended.set()
        self._ended = threading.Event()
        with self._lock:
            self._give_up()

    def _give_up(self) -> None:
        if self.is_leader():
            os.remove(self.path)
        self._until = 0.0
        self._tell()

    def on_change(self, listener: Callable[[bool], None]) -> None:
        self._listeners.append(listener)

    def is_leader(self) -> bool:
        return self.clock() < self._until

    def renew(self) -> bool:
        with self._lock:
            return self._renew()

    def _renew(self) -> bool:
        now = self.clock()
        try:
            with open(self.path) as file:
                held = json.load(file)
        except (OSError, ValueError):
            held = None
        if held is None or held["node"] == self.node_id or held["until"] <= now:
            mine = f"{self.path}.{self.node_id}"
            with open(mine, "w") as file:
                json.dump({"node": self.node_id, "until": now + self.seconds}, file)
            try:
                if held is None:
                    os.link(mine, self.path)  # fails if another node was faster
                    os.remove(mine)
                else:
                    os.replace(mine, self.path)
                with open(self.path) as file:
                    if json.load(file)["node"] == self.node_id:
                        self._until = now + self.seconds * 2 / 3
            except FileExistsError:
                os.remove(mine)
        self._tell()
        return self.is_leader()

    def _tell(self) -> None:
        if (led := self.is_leader()) != self._led:
            self._led = led
            for listener in self._listeners:
                listener(led)
