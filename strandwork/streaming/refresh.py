"""Keeping a graph up to date: facts by file, refreshed by manifest, from a batch or from a stream of manifest rows."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandwork.graph import Graph
from strandwork.plans.build import assemble, extract, sources_table
from strandwork.session import materialize
from strandwork.sources import configs, manifests
from strandwork.sources.listing import ScanOptions, scan


class Store:
    """A folder with versions of the facts and the manifest; the newest whole version counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.removeprefix("file://")
        os.makedirs(self.folder, exist_ok=True)

    def version(self) -> str | None:
        done = sorted(d for d in os.listdir(self.folder) if os.path.exists(f"{self.folder}/{d}/manifest/_SUCCESS"))
        return f"{self.folder}/{done[-1]}" if done else None

    def read(self) -> tuple[DataFrame, DataFrame] | None:
        v = self.version()
        return (self.spark.read.parquet(f"{v}/facts"), self.spark.read.parquet(f"{v}/manifest")) if v else None

    def write(self, facts: DataFrame, manifest: DataFrame) -> None:
        v = f"{self.folder}/{time.time_ns():020d}"
        facts.write.parquet(f"{v}/facts")
        manifest.write.parquet(f"{v}/manifest")


def refresh(spark: SparkSession, options: ScanOptions, store: Store, added=()) -> Graph:
    """Parse only files whose content changed or that are new; the graph equals that of a full build.

    Files are ranked by path, so ranks move when files come and go: stored facts take their file's new rank.
    ``added``: extractors of the caller (see ``extract``), the same ones for each refresh of a store.
    """
    sources, files, warnings = sources_table(spark, options)
    now = materialize(sources.withColumn("sha256", F.sha2("content", 256)), "sources")
    manifest = now.select("path", "kind", "rank", "sha256", "mtime")
    before = store.read()
    if before is None:
        facts = materialize(extract(now, added), "facts")
    else:
        old, was = before
        status = manifests.diff(was, manifest)
        dirty = status.where("status in ('added', 'changed')").select("path")
        kept = status.where("status = 'unchanged'").select(F.col("path").alias("fact_path")).join(manifest.select(F.col("path").alias("fact_path"), "rank"), "fact_path")
        # a fact about another file's node has no file_path: its own file is found by the old rank
        named = old.join(was.select(F.col("rank").alias("file"), F.col("path").alias("fact_path")), "file")
        kept = named.join(kept, "fact_path").withColumn("file", F.col("rank")).select(*old.columns)
        facts = materialize(kept.unionByName(extract(now.join(dirty, "path", "left_semi"), added).select(*old.columns)), "facts")
    store.write(facts, manifest)
    return assemble(facts, configs.topology(configs.Folder(os.path.realpath(options.root)), [p for p, k in files if k == "config"]), warnings)


def configs_changed(spark: SparkSession, options: ScanOptions, store: Store) -> bool:
    """Whether a configuration file has come, gone or changed since the store was written; true for an empty store."""
    before = store.read()
    if before is None:
        return True
    now = sources_table(spark, options)[0].where("kind = 'config'").withColumn("sha256", F.sha2("content", 256)).select("path", "sha256", "mtime")
    return not manifests.diff(before[1].where("kind = 'config'"), now).where("status <> 'unchanged'").isEmpty()


def watch(changes: DataFrame, options: ScanOptions, store: Store, done: Callable[[Graph, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Refresh once for each micro-batch of a stream of manifest rows (path, ..) that has any. ``every``: the trigger's
    interval, which is the debounce; without it whatever is there is processed and the query ends."""

    def step(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            done(refresh(batch.sparkSession, options, store), n)

    w = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _stamps(options: ScanOptions) -> dict[str, tuple[float, int]]:
    """Time and size of every listed file."""
    root, out = os.path.realpath(options.root), {}
    for path, _ in scan(options)[0]:
        try:
            s = os.stat(os.path.join(root, path))
        except FileNotFoundError:
            continue  # gone since it was listed
        out[path] = (s.st_mtime, s.st_size)
    return out


def watch_tree(spark: SparkSession, options: ScanOptions, store: Store, done: Callable[[Graph, int], None], debounce: float = 1.5, poll: float = 0.5, rounds: int | None = None) -> None:
    """Refresh now and whenever the tree has changed and then been quiet for ``debounce`` seconds; ends after ``rounds`` refreshes."""
    n, seen, built = 0, None, None
    while rounds is None or n < rounds:
        found, now = _stamps(options), time.monotonic()
        if found != seen:
            seen, since = found, now
        if seen != built and (built is None or now - since >= debounce):
            built = seen
            done(refresh(spark, options, store), n)
            n += 1
        else:
            time.sleep(poll)
