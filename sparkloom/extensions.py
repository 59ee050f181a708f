"""What others may add: parsers, rerankers and connectors, by name."""

from __future__ import annotations

import importlib.util
import logging
import pathlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

from .sources import parsers
from .sources.connectors import Connector

log = logging.getLogger(__name__)
GROUP = "sparkloom.plugins"


@dataclass
class Plugin:
    """A named addition. ``extensions`` and ``parse`` make it a parser, ``rerank`` a reranker, ``connector`` a source."""

    name: str
    extensions: tuple[str, ...] = ()
    parse: Callable[[bytes, str], str] | None = None
    rerank: Callable[[str, DataFrame], DataFrame] | None = None
    connector: Connector | None = None
    setup: Callable[[dict], None] | None = None
    teardown: Callable[[], None] | None = None


@dataclass
class Registry:
    """Plugins by name. One that fails to set up or to be taken down doesn't harm the others."""

    plugins: dict[str, Plugin] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def register(self, plugin: Plugin, config: dict | None = None) -> bool:
        if plugin.name in self.plugins:
            raise ValueError(f"there is a plugin {plugin.name} already")
        try:
            if plugin.setup:
                plugin.setup(config or {})
            if plugin.connector:
                plugin.connector.configure(config or {})
        except Exception as wrong:  # noqa: BLE001  whatever a plugin raises is its own affair
            log.warning("plugin %s: %s", plugin.name, wrong)
            self.failed[plugin.name] = str(wrong)
            return False
        self.plugins[plugin.name] = plugin
        if plugin.parse:
            parsers.register(list(plugin.extensions), plugin.parse)
        return True

    def unregister(self, name: str) -> None:
        plugin = self.plugins.pop(name)
        try:
            if plugin.teardown:
                plugin.teardown()
        except Exception as wrong:  # noqa: BLE001
            log.warning("plugin %s: %s", name, wrong)

    def of(self, kind: str) -> list[Plugin]:
        """Those that have ``parse``, ``rerank`` or ``connector``."""
        return [p for p in self.plugins.values() if getattr(p, kind) is not None]

    def discover(self, enabled: Iterable[str] = (), config: dict[str, dict] | None = None) -> list[str]:
        """Registers installed plugins (entry points that give a Plugin); all, or those named."""
        names = set(enabled)
        found = []
        for point in entry_points(group=GROUP):
            if names and point.name not in names:
                continue
            try:
                plugin = point.load()()
            except Exception as wrong:  # noqa: BLE001
                self.failed[point.name] = str(wrong)
                continue
            if self.register(plugin, (config or {}).get(point.name)):
                found.append(point.name)
        return found

    def discover_folder(self, folder: str, enabled: Iterable[str] = (), config: dict[str, dict] | None = None) -> list[str]:
        """Registers plugins of Python files in a local folder of the driver: each has a function ``plugin`` that gives one."""
        names = set(enabled)
        found = []
        for path in sorted(pathlib.Path(folder).glob("*.py")):
            if path.name.startswith("_") or names and path.stem not in names:
                continue
            try:
                spec = importlib.util.spec_from_file_location(f"plugin_{path.stem}", path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                plugin = module.plugin()
            except Exception as wrong:  # noqa: BLE001
                self.failed[path.stem] = str(wrong)
                continue
            if self.register(plugin, (config or {}).get(path.stem)):
                found.append(path.stem)
        return found

    def rerank(self, query: str, hits: DataFrame) -> DataFrame:
        """``hits`` through every reranker in turn."""
        for plugin in self.of("rerank"):
            hits = plugin.rerank(query, hits)
        return hits


@dataclass
class Sync:
    """What connectors have brought in: counts, times and errors by name."""

    registry: Registry
    status: dict[str, dict] = field(default_factory=dict)

    def run(self, spark: SparkSession, name: str, sink: Callable[[DataFrame], int], now: float) -> dict:
        """Fetches a connector's documents and hands them to ``sink``, which says how many there were."""
        connector = self.registry.plugins[name].connector
        try:
            result = {"last_sync": now, "documents": sink(connector.fetch(spark)), "error": None}
        except Exception as wrong:  # noqa: BLE001  one source's failure is recorded, the others go on
            result = {"last_sync": now, "documents": 0, "error": str(wrong)}
        self.status[name] = result
        return result

    def run_all(self, spark: SparkSession, sink: Callable[[DataFrame], int], now: float) -> dict[str, dict]:
        return {p.name: self.run(spark, p.name, sink, now) for p in self.registry.of("connector")}

    def overview(self) -> list[dict]:
        return [{"name": p.name, "schedule": p.connector.schedule, **self.status.get(p.name, {})} for p in self.registry.of("connector")]


def as_files(documents: DataFrame, now: float) -> DataFrame:
    """Connector documents as files for the engine: the id is the path, so a later sync replaces rather than adds."""
    from pyspark.sql import functions as F

    return documents.select(F.col("id").alias("path"), F.concat_ws("\n\n", "title", "content").alias("text"), F.lit(float(now)).alias("modified_time"), F.length("content").cast("long").alias("size"))
