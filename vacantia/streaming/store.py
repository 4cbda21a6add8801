"""A table with one row for each key, kept as Parquet in key buckets: batches are appended, readers merge, and a manifest that is written last says what counts.

A batch writes its own rows only, into the buckets that its keys fall into. A manifest names the folders of each bucket and the last batch; the highest numbered
one is the table. So a batch that dies leaves files that no manifest names, and one that is delivered again is known by its number and changes nothing. When
a bucket has many folders they are merged into one. Manifests and files of older versions go when `keep` newer ones are there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "store_bucket"


class Files:
    """Small files and folders of the file system that holds a path, through Spark's own access to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file as a whole or not at all; fails if it is there already."""
        draft = self.at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(draft, self.at(name)):
            self.fs.delete(draft, False)
            raise FileExistsError(f"{self.root}/{name}: another writer was first")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass(frozen=True)
class Merge:
    """How rows of one key become one: the columns of the row that is greatest in `newest` (nulls are least), but least and greatest values where these are named.

    The result doesn't depend on the order in which rows come. Equal rows in `newest` go by all their columns.
    """

    newest: tuple[str, ...]
    least: tuple[str, ...] = ()
    greatest: tuple[str, ...] = ()

    def __call__(self, df: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in {*keys, *self.least, *self.greatest}]
        one = F.max_by(F.struct(*rest), F.struct(*self.newest, F.to_json(F.struct(*rest)))).alias("_row")
        merged = df.groupBy(*keys).agg(one, *[F.min(c).alias(f"_{c}") for c in self.least], *[F.max(c).alias(f"_{c}") for c in self.greatest])
        named = {**{c: F.col(f"_row.`{c}`") for c in rest}, **{c: F.col(f"_{c}") for c in (*self.least, *self.greatest)}}
        return merged.select(*[named.get(c, F.col(c)).alias(c) for c in df.columns])


@dataclass
class KeyedStore:
    """One table below `path`. `schema` is a DDL string of all columns; rows are dealt to `buckets` by their keys."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    merge: Merge
    buckets: int = 16
    most: int = 8
    keep: int = 2
    files: Files = field(init=False)

    def __post_init__(self):
        self.files = Files(self.spark, self.path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("manifest") if n.endswith(".json"))

    def manifest(self) -> dict:
        """version, last batch, and the folders of each bucket with rows."""
        versions = self.versions()
        return json.loads(self.files.read(f"manifest/{versions[-1]}.json")) if versions else {"version": 0, "batch": -1, "buckets": {}}

    def rows(self, only: Iterable[int] | None = None) -> DataFrame:
        """The table, or its rows in some buckets: one row a key."""
        return self._read(self.manifest(), only)

    def _read(self, manifest: dict, only: Iterable[int] | None = None) -> DataFrame:
        wanted = {str(b) for b in only} if only is not None else None
        paths = sorted(f"{self.path.rstrip('/')}/data/{f}/{BUCKET}={b}" for b, folders in manifest["buckets"].items() if wanted is None or b in wanted for f in folders)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths), self.keys)

    def _write(self, df: DataFrame) -> tuple[str, list[int]]:
        """A new folder with the rows, and the buckets that it has."""
        folder = uuid.uuid4().hex
        columns = self.spark.createDataFrame([], self.schema).columns
        placed = df.select(*columns, self.bucket().alias(BUCKET))
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path.rstrip('/')}/data/{folder}")
        return folder, sorted(int(n.partition("=")[2]) for n in self.files.names(f"data/{folder}") if n.startswith(f"{BUCKET}="))

    def _publish(self, manifest: dict) -> None:
        self.files.publish(f"manifest/{manifest['version']}.json", json.dumps(manifest))
        self._forget()

    def _forget(self) -> None:
        """Delete manifests but the last `keep`, and folders that only deleted ones named. Files of a batch that died stay until `sweep`."""
        versions = self.versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        named = lambda v: {f for folders in json.loads(self.files.read(f"manifest/{v}.json"))["buckets"].values() for f in folders}
        used = set().union(*map(named, kept)) if kept else set()
        for v in old:
            for f in named(v) - used:
                self.files.delete(f"data/{f}")
            self.files.delete(f"manifest/{v}.json")

    def sweep(self) -> None:
        """Delete folders that no manifest names. Only while nothing is being written."""
        used = {f for v in self.versions() for folders in json.loads(self.files.read(f"manifest/{v}.json"))["buckets"].values() for f in folders}
        for f in set(self.files.names("data")) - used:
            self.files.delete(f"data/{f}")

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch's rows; False (and nothing written) if this batch, or a later one, is in already."""
        manifest = self.manifest()
        if batch <= manifest["batch"]:
            return False
        folder, found = self._write(self.merge(rows.select(*self.spark.createDataFrame([], self.schema).columns), self.keys))
        for b in found:
            manifest["buckets"].setdefault(str(b), []).append(folder)
        self._publish({**manifest, "version": manifest["version"] + 1, "batch": batch})
        self.compact()
        return True

    def compact(self) -> list[int]:
        """Merge the folders of buckets that have more than `most` of them; returns these buckets."""
        manifest = self.manifest()
        full = sorted(int(b) for b, folders in manifest["buckets"].items() if len(folders) > self.most)
        if full:
            folder, _ = self._write(self._read(manifest, full))
            self._publish({**manifest, "version": manifest["version"] + 1, "buckets": {**manifest["buckets"], **{str(b): [folder] for b in full}}})
        return full

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows fall into; at most `buckets` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def sink(self, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch once, whatever is delivered again."""

        def batch(df: DataFrame, n: int) -> None:
            self.upsert(prepare(df), n)

        return batch


_SEEN = Merge(("last_seen_at",), ("first_seen_at",), ("last_seen_at",))
#: Tables that are written by key: schema, keys, and how rows of a key become one.
TABLES: dict[str, tuple[str, list[str], Merge]] = {
    "inventory": ("connector_id string, source_external_id string, title string, location string, detail_url string, metadata_hash string, hydration_status string, hydrated_at timestamp, active boolean, first_seen_at timestamp, last_seen_at timestamp", ["connector_id", "source_external_id"], _SEEN),
    "observations": ("connector_id string, source_external_id string, job_id long, is_official boolean, title string, location string, detail_url string, apply_url string, description string, content_hash string, first_seen_at timestamp, last_seen_at timestamp", ["connector_id", "source_external_id"], _SEEN),
    "jobs": ("job_id long, company string, title string, location string, official_detail_url string, official_apply_url string, description string, verified_at timestamp, closed_at timestamp, updated_at timestamp", ["job_id"], Merge(("updated_at", "verified_at"))),
    "classifications": ("job_id long, description_hash string, location_status string, domain_status string, experience_status string, match_tier string, method string, classified_at timestamp", ["job_id", "description_hash"], Merge(("classified_at",))),
    "runs": ("run_id long, connector_id string, run_type string, status string, reported_total long, listings_discovered long, backlog long, error_text string, started_at timestamp, finished_at timestamp", ["run_id"], Merge(("finished_at",), ("started_at",))),
}


def table_store(spark: SparkSession, folder: str, name: str, **more) -> KeyedStore:
    """One of TABLES below a folder."""
    schema, keys, merge = TABLES[name]
    return KeyedStore(spark, f"{folder.rstrip('/')}/{name}", schema, keys, merge, **more)
