"""An index kept as generations of changes, and a pointer that says which of them count.

A generation holds what one batch added, updated or pruned, partitioned by bucket of
the id.  A manifest lists the generations that make up the index; manifests are
numbered, written under another name and renamed, so a reader sees the one before or
the whole new one.  What no manifest lists does not exist for readers: a batch that
broke off leaves no trace, one that runs again is known by its number and does
nothing.  Compaction writes the live rows as one generation; going back is naming an
older manifest's generations anew; purging deletes what recent manifests don't list.

A batch reads only the buckets that its rows fall in; what it compares are ids and
digests, not payloads.

Defined results: rows with a null id are left out; of rows that repeat an id in one
batch the one with the largest digest counts; a null payload or text counts as empty;
vectors of another size than the index's raise an error, and nothing is written; an
empty batch is a generation without rows; an index without manifests is empty.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partitions of each generation, and generations at which a batch compacts first.
BUCKETS, MOST = 16, 8


def point_id(text: Column | str, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based identifier (version 5) of a text: the same row has the same one in every build."""
    text = F.col(text) if isinstance(text, str) else text
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


@dataclass(frozen=True)
class Manifest:
    version: int
    generations: tuple[str, ...]
    batch: int | None
    model: str
    dims: int | None


class Generations:
    """The index at a path.  Rows are (id, text, payload columns); with dims, a vector column too."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, model: str = "", dims: int | None = None, buckets: int = BUCKETS, most: int = MOST):
        self.spark, self.path, self.model, self.dims, self.buckets, self.most = spark, path.rstrip("/"), model, dims, buckets, most
        self.columns = [f for f in schema.fields if f.name not in ("id", "text")]
        self.schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), *self.columns, *(T.StructField(n, k) for n, k in (("point_id", T.StringType()), ("sha", T.StringType()), ("deleted", T.BooleanType()), ("generation", T.IntegerType()), ("bucket", T.IntegerType())))])

    # manifests

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._files(f"{self.path}/manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        known = self.versions()
        version = version if version is not None else known[-1] if known else None
        if version is None:
            return None
        if version not in known:
            raise ValueError(f"no manifest {version}")
        values = json.loads(self.spark.read.text(f"{self.path}/manifests/{version:08d}.json", wholetext=True).first()[0])
        return Manifest(version, tuple(values["generations"]), values["batch"], values["model"], values["dims"])

    def _publish(self, generations: tuple[str, ...], batch: int | None, after: Manifest | None) -> Manifest:
        """Raises where another writer was first."""
        version = after.version + 1 if after else 0
        fs, temporary = self._files(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps({"generations": generations, "batch": batch, "model": self.model, "dims": self.dims}, sort_keys=True).encode()))
        out.close()
        if not fs.rename(temporary, self._files(f"{self.path}/manifests/{version:08d}.json")[1]):
            fs.delete(temporary, False)
            raise RuntimeError(f"manifest {version} exists: another writer was first")
        return Manifest(version, generations, batch, self.model, self.dims)

    # rows

    def _read(self, found: Manifest | None) -> DataFrame:
        if found is None or not found.generations:
            return self.spark.createDataFrame([], self.schema)
        parts = [f"{self.path}/data/{g}" for g in found.generations]
        own = self.spark.read.schema(T.StructType([f for f in self.schema.fields if f.name not in ("generation", "bucket")] + [self.schema["bucket"]]))
        out = None
        for number, part in enumerate(parts):
            rows = own.option("basePath", part).parquet(part).withColumn("generation", F.lit(number)).select(*self.schema.names)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _latest(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Of each id its row of the last generation; one generation needs no shuffle for it."""
        held = F.max_by(F.struct(*columns), "generation").alias("x")
        return rows.groupBy("bucket", "id").agg(held).select("bucket", "id", "x.*").where("NOT deleted")

    def current(self, version: int | None = None) -> DataFrame:
        """The live rows: (id, text, payload, point_id, sha)."""
        found = self.manifest(version)
        rows, columns = self._read(found), ["text", *(f.name for f in self.columns), "point_id", "sha", "deleted"]
        live = rows.where("NOT deleted") if found is None or len(found.generations) < 2 else self._latest(rows, columns)
        return live.select("id", *columns[:-1])

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select(*[c for c in self.schema.names if c != "generation"]).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        # a generation without rows has no files to read a schema from, and needs none
        return name

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def apply(self, rows: DataFrame, batch: int | None = None, whole: bool = False) -> Manifest:
        """Writes what rows (id, text, payload) change as a generation; with whole, ids that rows lack are pruned.

        A batch number not above the last one's was applied before.
        """
        found = self.manifest()
        if found is not None and (found.model, found.dims) != (self.model, self.dims):
            raise ValueError(f"the index holds {found.model or 'no model'} of {found.dims} dimensions: build it anew")
        if found is not None and batch is not None and found.batch is not None and batch <= found.batch:
            return found
        if found is not None and len(found.generations) >= self.most:
            found = self.compact()
        own = rows.where("id IS NOT NULL").withColumn("id", F.col("id").cast("string")).withColumn("text", F.coalesce("text", F.lit("")))
        if self.dims is not None and not own.where(F.coalesce(F.size("vector"), F.lit(-1)) != self.dims).isEmpty():
            raise ValueError(f"vectors of another size than {self.dims}")
        sha = F.sha2(F.concat_ws("|", F.lit(self.model), F.lit(str(self.dims or 0)), "text"), 256)
        own = own.withColumns({"sha": sha, "bucket": self._bucket()})
        others = [f.name for f in self.columns]
        own = own.groupBy("bucket", "id").agg(F.max_by(F.struct("text", *others, "sha"), "sha").alias("x")).select("bucket", "id", "x.*")
        touched = range(self.buckets) if whole else sorted(r[0] for r in own.select("bucket").distinct().collect())  # at most `buckets`
        before = self._read(found).where(F.col("bucket").isin(list(touched))).select("bucket", "id", "generation", "sha", "deleted")
        old = self._latest(before, ["sha", "deleted"]).select("bucket", "id", F.col("sha").alias("old"))
        new = own.join(old, ["bucket", "id"], "full" if whole else "left").where(F.col("sha").isNull() | F.col("old").isNull() | (F.col("sha") != F.col("old")))
        new = new.withColumns({"deleted": F.col("sha").isNull(), "point_id": point_id("id"), "generation": F.lit(0)})
        return self._publish((*(found.generations if found else ()), self._write(new)), batch if batch is not None else found.batch if found else None, found)

    def compact(self) -> Manifest:
        """The live rows as one generation."""
        found = self.manifest()
        if found is None or len(found.generations) < 2:
            return found
        live = self.current().withColumns({"bucket": self._bucket(), "deleted": F.lit(False), "generation": F.lit(0)})
        return self._publish((self._write(live),), found.batch, found)

    def rollback(self, version: int) -> Manifest:
        """The generations of an earlier manifest count again; its batch number too, so later batches can run anew."""
        to = self.manifest(version)
        return self._publish(to.generations, to.batch, self.manifest())

    def purge(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the last few, and the generations that none of these lists."""
        known = self.versions()
        kept = {g for v in known[-keep:] for g in self.manifest(v).generations}
        fs, at = self._files(f"{self.path}/data")
        gone = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName() not in kept) if fs.exists(at) else []
        for v in known[:-keep]:
            fs.delete(self._files(f"{self.path}/manifests/{v:08d}.json")[1], False)
        for g in gone:
            fs.delete(self._files(f"{self.path}/data/{g}")[1], True)
        return gone
