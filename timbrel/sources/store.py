"""Keyed tables that are changed in place: only touched buckets are rewritten, readers see whole versions.

A table is a folder. ``data/<write>`` holds what one write made, a folder for each bucket of the
keys; ``versions/<number>`` says which write each bucket is read from. A version appears by one rename
that fails if the number is taken, so a write that dies leaves the version before it, and
of two writers at once the second gets an error. The file system must rename a file atomically.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class KeyedTable:
    """``keys`` tell rows apart; ``deal`` (the keys, unless named) chooses a row's bucket."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, deal: Sequence[str] | None = None):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.deal = list(deal or keys)

    # --- reading

    def version(self) -> int:
        """Number of the newest version; 0 if nothing has been written."""
        return max([int(n) for n in self._names("versions") if n.isdigit()], default=0)

    def read(self, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version (the newest unless named), of some buckets or all."""
        at = self._manifest(version)
        folders = [f"{self.path}/data/{w}/{_BUCKET}={b}" for b, w in at["folders"].items() if buckets is None or int(b) in set(buckets)]
        schema = T.StructType.fromJson(at["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def exists(self) -> bool:
        return self.version() > 0

    # --- writing

    def write(self, rows: DataFrame, once: tuple[str, int] | None = None) -> int:
        """Replace the whole table."""
        return self._commit(rows, None, once)

    def done(self, writer: str) -> int:
        """The last number that a writer gave with ``once``; -1 if none. A write with that number or a lower one changes nothing."""
        return self._manifest(None).get("done", {}).get(writer, -1) if self.exists() else -1

    def upsert(self, new: DataFrame, once: tuple[str, int] | None = None, unique: bool = False) -> int:
        """Insert ``new`` rows in place of those with their keys. Equal keys within ``new``: one of them stays.

        ``once``: a writer's name and a number that grows, a stream's batch for instance; the write and the
        number become visible together, so that a batch that comes again is not applied again.
        ``unique``: no key is twice in ``new``, so it isn't looked through for that.
        """
        if once and self.done(once[0]) >= once[1]:
            return self.version()
        new = new if unique else new.dropDuplicates(self.keys)
        if not self.exists():
            return self.write(new, once)
        touched = self.touched(new)
        return self._commit(self._without(self.read(touched), new).unionByName(new), touched, once)

    def merge(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], once: tuple[str, int] | None = None) -> int:
        """``change`` makes new rows of all rows in the buckets of ``keys``; it must leave rows alone that aren't meant."""
        if once and self.done(once[0]) >= once[1]:
            return self.version()
        touched = self.touched(keys)
        return self._commit(change(self.read(touched)), touched, once) if touched else self.version()

    def refresh(self, new: DataFrame, columns: Sequence[str], once: tuple[str, int] | None = None) -> int:
        """Insert unknown keys; of known ones take ``columns`` from ``new`` and keep the rest."""
        if once and self.done(once[0]) >= once[1]:
            return self.version()
        new = new.dropDuplicates(self.keys)
        if not self.exists():
            return self.write(new, once)
        touched = self.touched(new)
        old = self.read(touched)
        fresh = lambda c: F.when(F.col("new_").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c))
        # a key is unknown if no old row met it
        known = F.coalesce(F.col("old_"), F.lit(False))
        both = old.withColumn("old_", F.lit(True)).join(new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns], F.lit(True).alias("new_")), self._same("new_"), "full_outer")
        return self._commit(both.select(*[(fresh(c) if c in columns else F.when(known, F.col(c)).otherwise(F.col(f"new_{c}"))).alias(c) for c in old.columns]), touched, once)

    def delete(self, gone: DataFrame) -> int:
        """Drop the rows whose keys are in ``gone``."""
        touched = self.touched(gone)
        return self._commit(self._without(self.read(touched), gone), touched) if touched else self.version()

    def replace_buckets(self, rows: DataFrame, touched: Sequence[int]) -> int:
        """``rows`` become all rows of the buckets ``touched``."""
        return self._commit(rows, touched)

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions but the last ``keep``, and writes that no kept version reads (dead ones too; run it with no writer at work)."""
        numbers = sorted(int(n) for n in self._names("versions") if n.isdigit())
        for n in numbers[:-keep]:
            self._fs().delete(self._hadoop(f"{self.path}/versions/{n:012d}"), False)
        used = {w for n in numbers[-keep:] for w in self._manifest(n)["folders"].values()}
        for name in self._names("data"):
            if name not in used:
                self._fs().delete(self._hadoop(f"{self.path}/data/{name}"), True)

    def bucket(self, columns: Sequence[Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(columns or [F.col(c) for c in self.deal])), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of ``rows``; no more numbers than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # --- within

    def _same(self, prefix: str) -> Column:
        cond = F.lit(True)
        for k in self.keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
        return cond

    def _without(self, old: DataFrame, keys: DataFrame) -> DataFrame:
        return old.join(keys.select(*[F.col(k).alias(f"new_{k}") for k in self.keys]).distinct(), self._same("new_"), "left_anti")

    def _commit(self, rows: DataFrame, touched: Sequence[int] | None, once: tuple[str, int] | None = None) -> int:
        number, write = self.version(), uuid.uuid4().hex
        old = self._manifest(number) if number else {"folders": {}}
        out = rows.withColumn(_BUCKET, self.bucket())
        if touched is None or len(touched) > 1:
            out = out.repartition(_BUCKET)
        out.write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{write}")
        made = {n.split("=")[1]: write for n in self._names(f"data/{write}") if n.startswith(f"{_BUCKET}=")}
        kept = {} if touched is None else {b: w for b, w in old["folders"].items() if int(b) not in set(touched)}
        schema = old["schema"] if touched is not None and number else json.loads(rows.schema.json())
        done = {**old.get("done", {}), **({once[0]: once[1]} if once else {})}
        self._publish(number + 1, json.dumps({"schema": schema, "folders": {**kept, **made}, "done": done}))
        return number + 1

    def _publish(self, number: int, text: str) -> None:
        jvm = self.spark._jvm
        draft, final = self._hadoop(f"{self.path}/versions/.draft-{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/versions/{number:012d}")
        out = self._fs().create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as exc:
            if "FileAlreadyExists" in str(exc):
                raise Conflict(f"version {number} of {self.path} was made by another writer") from None
            raise

    def _manifest(self, version: int | None) -> dict:
        number = self.version() if version is None else version
        if not number:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        lines = self.spark.read.text(f"{self.path}/versions/{number:012d}", wholetext=True).collect()  # one small file
        return json.loads(lines[0].value)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs().listStatus(at)] if self._fs().exists(at) else []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own under ``spark.checkpoint.dir``; a temporary one only where one machine has no setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="timbrel-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and it is worked out once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def settled_by(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """``df`` written to the shared folder in ``parts`` buckets of ``key``: groupings and joins within a key then need no exchange."""
    path = shared_folder(df.sparkSession, name)
    held = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(held)
    return df.sparkSession.table(held)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables. Only for those on which nothing still to be computed depends."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
