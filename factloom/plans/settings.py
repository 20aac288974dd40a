"""Settings from several layers, and a lease for one writer at a time. Plain values on the driver; nothing here touches data."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession


def resolve_setting(name: str, *, flags: Mapping = {}, env: Mapping[str, str] | None = None, config: Mapping = {}, default=None, env_name: str | None = None, kind: type = str) -> tuple[object, str | None]:
    """(value, where it is from): a flag before the environment before a configuration before the default; (None, None) where none has it.

    Text from the environment or a configuration is read as ``kind``; text that can't be is no value.
    """

    def read(v):
        if not isinstance(v, str) or kind is str:
            return v
        try:
            return kind(v)
        except ValueError:
            return None

    env = os.environ if env is None else env
    layers = [("flag", flags.get(name)), ("env", read(env.get(env_name)) if env_name else None), ("config", read(config.get(name))), ("default", default)]
    return next(((v, source) for source, v in layers if v is not None), (None, None))


def merge_settings(given: Mapping, layers: list[Mapping]) -> dict:
    """``given`` with what it lacks (or has as None) from the layers, first come first."""
    out = {k: v for k, v in given.items() if v is not None}
    for layer in layers:
        for k, v in layer.items():
            if v is not None:
                out.setdefault(k, v)
    return out


class Locked(RuntimeError):
    """Another writer holds the lease."""


class Lease:
    """The right to write to a store, held by one at a time: a file in the store's folder, created only where there is none, that runs out by itself."""

    def __init__(self, spark: SparkSession, folder: str, owner: str = "writer", ttl_ms: int = 30_000):
        self.spark, self.owner, self.ttl_ms = spark, owner, ttl_ms
        self._fs_api = spark._jvm.org.apache.hadoop.fs
        self._at = self._fs_api.Path(f"{folder.rstrip('/')}/_lease.json")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.token: str | None = None

    def held(self) -> dict | None:
        """Who holds the lease, or None; a file that can't be read is held by nobody known."""
        if not self._fs.exists(self._at):
            return None
        stream = self._fs.open(self._at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return {}
        finally:
            stream.close()

    def acquire(self, wait_ms: int = 5000, now_ms=lambda: int(time.time() * 1000)) -> str:
        """Take the lease, waiting up to ``wait_ms``; one that has run out is broken. Raises :class:`Locked` with the holder's name."""
        until = now_ms() + wait_ms
        while True:
            token = uuid.uuid4().hex
            try:
                out = self._fs.create(self._at, False)
            except Exception:  # noqa: BLE001
                holder = self.held() or {}
                if holder.get("expires_at", 1 << 62) < now_ms():
                    self._fs.delete(self._at, False)
                    continue
                if now_ms() >= until:
                    raise Locked(f"store-locked: {holder.get('owner', 'unknown')}") from None
                time.sleep(0.05)
                continue
            out.write(bytearray(json.dumps({"token": token, "owner": self.owner, "expires_at": now_ms() + self.ttl_ms}).encode()))
            out.close()
            self.token = token
            return token

    def release(self) -> None:
        """Give the lease back, if it is still this one's."""
        if self.token and (self.held() or {}).get("token") == self.token:
            self._fs.delete(self._at, False)
        self.token = None

    @contextmanager
    def taken(self, wait_ms: int = 5000):
        self.acquire(wait_ms)
        try:
            yield self
        finally:
            self.release()
