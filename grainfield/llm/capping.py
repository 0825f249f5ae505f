"""Problem 1: at most so many records of one contributor, the best by quality, kept up to date batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.operators.ranking import grouped_rank
from grainfield.session import shared_path, stored

FIELDS = ["contributor", "quality", "id"]
STATE = "contributor string, quality double, id long"
#: Buckets of contributors in which a state is kept that goes on for many batches.
BUCKETS = 64


def usable_quality(quality: Column) -> Column:
    """Null, NaN, zero and negative quality all count as 0, below any other."""
    return F.when(quality.isNotNull() & ~F.isnan(quality) & (quality > 0), quality.cast("double")).otherwise(F.lit(0.0))


class CapState:
    """A state table of each contributor's kept records and cutoff in a folder, which a later run opens again by its path.

    A batch is first held against the cutoffs: what lies below one is displaced at once and never
    shuffled. The rest is merged with the kept lists of its buckets of contributors alone; contributors over the cap are ranked by
    quality (higher first) and id (smaller first) with a rank that splits hot contributors, and what
    falls out is logged as displaced. Cutoffs only rise, for the cap is fixed. A contributor that is
    null is one contributor. A record seen twice counts once, with its best quality. A version writes only the buckets the batch
    touched, and a manifest written last names the files of every bucket, so a lost driver or a batch run again leaves the state as it was.
    """

    def __init__(self, spark: SparkSession, cap: int, path: str | None = None, parts: int = BUCKETS):
        if cap < 1:
            raise ValueError("cap must be at least 1")
        self.spark, self.cap, self.parts, self.path = spark, cap, parts, (path or shared_path(spark, "capping")).rstrip("/")
        #: bucket -> version of its kept records and of its cutoffs; versions of the log
        self.version, self.buckets, self.cut_buckets, self.logs = 0, {}, {}, []
        for v in self._versions():
            row = spark.read.text(f"{self.path}/manifest/v={v:08d}").first()
            if row:
                self.version, found = v, json.loads(row.value)
                if found["cap"] != cap:
                    raise ValueError(f"the state was made for a cap of {found['cap']}")
                self.buckets, self.cut_buckets = ({int(k): x for k, x in found[n].items()} for n in ("kept", "cutoffs"))
                self.logs, self.parts = found["logs"], found["parts"]
                break

    def _versions(self) -> list[int]:
        """Versions whose manifest is complete, newest first."""
        jvm, root = self.spark._jvm, f"{self.path}/manifest"
        p = jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))), reverse=True)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def _table(self, name: str, versions: dict[int, int], buckets: set[int] | None = None) -> DataFrame:
        return self._read([f"{self.path}/{name}/v={v:08d}/bucket={k}" for k, v in versions.items() if buckets is None or k in buckets])

    @property
    def kept(self) -> DataFrame:
        return self._table("kept", self.buckets)

    @property
    def cutoffs(self) -> DataFrame:
        return self._table("cutoffs", self.cut_buckets)

    def _write(self, rows: DataFrame, name: str, version: int) -> list[int]:
        """The buckets that were written."""
        path = f"{self.path}/{name}/v={version:08d}"
        bucket = F.pmod(F.xxhash64("contributor"), F.lit(self.parts)).cast("int").alias("bucket")
        rows.select(*FIELDS, bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return [r.bucket for r in self.spark.read.schema(f"{STATE}, bucket int").option("basePath", path).parquet(path).select("bucket").distinct().collect()]

    def absorb(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of (contributor, quality, id); returns the records it displaced."""
        batch = batch.select("contributor", usable_quality(F.col("quality")).alias("quality"), F.col("id").cast("long").alias("id"))
        same = F.col("contributor").eqNullSafe(F.col("_c"))
        cut = self.cutoffs.select(F.col("contributor").alias("_c"), F.col("quality").alias("_q"), F.col("id").alias("_i"))
        held = batch.join(cut, same, "left") if self.cut_buckets else batch.withColumns({"_q": F.lit(None).cast("double"), "_i": F.lit(None).cast("long")})
        below = F.coalesce((F.col("quality") < F.col("_q")) | ((F.col("quality") == F.col("_q")) & (F.col("id") > F.col("_i"))), F.lit(False))
        held = stored(held.select(*FIELDS, below.alias("_below")), "held")
        rest = held.filter("NOT _below").select(*FIELDS)
        touched = {r[0] for r in rest.select(F.pmod(F.xxhash64("contributor"), F.lit(self.parts)).cast("int")).distinct().collect()}
        merged = stored(self._table("kept", self.buckets, touched).unionByName(rest).groupBy("contributor", "id").agg(F.max("quality").alias("quality")).select(*FIELDS), "merged")
        full = stored(merged.groupBy(F.col("contributor").alias("_c")).count().filter(F.col("count") > self.cap).select("_c"), "full")
        ranked = stored(grouped_rank(merged.join(full, same, "left_semi"), ["contributor"], [F.col("quality").desc(), F.col("id")]), "ranked")
        version = self.version + 1
        kept = self._write(merged.join(full, same, "left_anti").unionByName(ranked.filter(F.col("rank") <= self.cap).select(*FIELDS)), "kept", version)
        now = ranked.filter(F.col("rank") == self.cap).select(*FIELDS)
        old = self._table("cutoffs", self.cut_buckets, touched).join(now.select(F.col("contributor").alias("_c")), same, "left_anti")
        cuts = self._write(now.unionByName(old), "cutoffs", version)
        out = f"{self.path}/log/v={version:08d}"
        held.filter("_below").select(*FIELDS).unionByName(ranked.filter(F.col("rank") > self.cap).select(*FIELDS)).write.mode("overwrite").parquet(out)
        self.buckets |= dict.fromkeys(kept, version)
        self.cut_buckets |= dict.fromkeys(cuts, version)
        self.version, self.logs = version, [*self.logs, version]
        told = json.dumps({"cap": self.cap, "parts": self.parts, "kept": self.buckets, "cutoffs": self.cut_buckets, "logs": self.logs})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v={version:08d}")
        return self._read([out])

    def displaced(self) -> DataFrame:
        """All records displaced so far, each once."""
        return self._read([f"{self.path}/log/v={v:08d}" for v in self.logs]).groupBy("contributor", "id").agg(F.max("quality").alias("quality"))


def cap_by_share(records: DataFrame, contributor: str, quality: str, key: str, share: float, batches: int = 2) -> CapState:
    """Hold every contributor to a share of all distinct keys, rounded down but at least 1.

    The cap follows from the count of all records, so it is known before the first batch; the
    records then pass through the state in batches by a hash of their key. An empty table gives an
    empty state.
    """
    slim = stored(
        records.groupBy(F.col(key).alias("id")).agg(F.min(F.struct(F.col(contributor).alias("c"), usable_quality(F.col(quality)).alias("q"))).alias("r")).select(F.col("r.c").alias("contributor"), F.col("r.q").alias("quality"), "id"),
        "records",
    )
    state = CapState(records.sparkSession, max(1, int(slim.count() * share + 1e-9)), parts=8)  # both batches touch all of it
    for b in range(batches):
        state.absorb(slim.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == b))
    return state
