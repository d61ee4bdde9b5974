"""A chunk table on Parquet with keyed writes.

Documents are spread over buckets by the hash of their id. A write makes new
folders for the buckets that it touches and then a new manifest, a small file
with the folder of every bucket. Manifests are numbered and made by a rename
that fails if the number is taken, so of two writers one starts anew on top of
the other's table. Readers hold on to the manifest that they read: its folders
stay until `vacuum` removes those that no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import schemas
from tallyloom.operators import chunking

C = F.col
BUCKETS = 64


def chosen_backend(explicit: str | None = None, env: str | None = None, url: str | None = None, user_id: str | None = None) -> str:
    """Where a store lives: as said, else as the setting says, else remote for an address and an owner that is a UUID, else local."""
    if explicit or env:
        return (explicit or env or "").strip().lower()
    try:
        return "remote" if url and str(uuid.UUID(user_id or "")) == (user_id or "").lower() else "local"
    except ValueError:
        return "local"


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = schemas.CHUNKS, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("log")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """Number and folders by bucket of a version, the latest by default; 0 and none before the first write."""
        at = version if version is not None else max(self.versions(), default=0)
        if not at:
            return 0, {}
        stream = self._fs().open(self._path(f"log/{at:020d}"))
        try:
            return at, {int(k): v for k, v in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).items()}
        finally:
            stream.close()

    def _commit(self, version: int, folders: dict[int, str]) -> bool:
        """Whether the manifest could be made; not if another writer was first."""
        fs, tmp = self._fs(), self._path(f"log/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.writeBytes(json.dumps(folders))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(none, 1)
        how[0] = none.NONE
        try:
            context.rename(tmp, self._path(f"log/{version:020d}"), how)
            return True
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def bucket(self, paper: Column) -> Column:
        return F.pmod(F.xxhash64(paper), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[int, str], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}/bucket={b}" for b, f in sorted(folders.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None, *, papers: list[str] | None = None) -> DataFrame:
        """The table of a version; with `papers` only the buckets of these documents are read."""
        only = None
        if papers is not None:
            only = {r[0] for r in self.spark.createDataFrame([(p,) for p in papers], "p string").select(self.bucket(C("p"))).distinct().collect()}
        df = self._read(self.manifest(version)[1], only)
        return df if papers is None else df.where(C("paper_id").isin(papers))

    def _write(self, touched: set[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the touched buckets by what `change` makes of them, again if another writer came in between."""
        if not touched:
            return
        while True:
            at, folders = self.manifest()
            name = f"data/{uuid.uuid4().hex}"
            df = schemas.conform(change(self._read(folders, touched)), self.schema).withColumn("bucket", self.bucket(C("paper_id")))
            df.repartition("bucket").sortWithinPartitions("bucket", "paper_id", "id").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
            fs = self._fs()
            made = {b for b in touched if fs.exists(self._path(f"{name}/bucket={b}"))}
            fs.mkdirs(self._path("log"))
            if self._commit(at + 1, {b: f for b, f in folders.items() if b not in touched} | {b: name for b in made}):
                return
            fs.delete(self._path(name), True)

    def _touched(self, df: DataFrame) -> set[int]:
        return {r[0] for r in df.select(self.bucket(C("paper_id")).alias("b")).distinct().collect()}  # at most as many as there are buckets

    def upsert(self, new: DataFrame) -> None:
        rows = schemas.conform(new, self.schema)
        self._write(self._touched(rows), lambda old: chunking.upsert(old, rows))

    def replace(self, new: DataFrame) -> None:
        """Documents come out exactly as given, without stale chunks."""
        rows = schemas.conform(new, self.schema)
        self._write(self._touched(rows), lambda old: chunking.replace_documents(old, rows))

    def delete(self, paper_id: str, user_id: str) -> int:
        """Deletes a user's document; how many chunks it had."""
        hit = (C("paper_id") == paper_id) & (C("user_id") == user_id)
        n = self.read(papers=[paper_id]).where(hit).count()
        if n:
            self._write(self._touched(self.read(papers=[paper_id])), lambda old: old.where(~F.coalesce(hit, F.lit(False))))
        return n

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last `keep`, and folders that none of those names; how many folders went."""
        kept = self.versions()[-keep:]
        live = {f for v in kept for f in self.manifest(v)[1].values()}
        fs, gone = self._fs(), 0
        for v in self.versions():
            if v not in kept:
                fs.delete(self._path(f"log/{v:020d}"), False)
        for s in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if f"data/{s.getPath().getName()}" not in live:
                fs.delete(s.getPath(), True)
                gone += 1
        return gone

    def documents(self, user_id: str) -> DataFrame:
        return self.read().where(C("user_id") == user_id).groupBy("paper_id", "ticker", "fiscal_period").agg(F.count(F.lit(1)).alias("chunk_count"))

    def count(self, user_id: str) -> int:
        return self.read().where(C("user_id") == user_id).count()
