"""Method runs whose results are kept.

A run is a list of methods over the same bars. The scores of each method are kept in a folder of their own, named by a digest of
the method, its parameters and the bars; a run computes the methods that are absent and reads the others. A folder is written
beside its place, with a manifest, and moved there in one step, so that a reader sees whole results or none, and of two runs at
once one wins and both are right."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score
from ..session import kept
from . import registry as R

SCORES = "stk string, n long, base double, abs double, rel double"
#: The methods of the three runs, as the run names them, and by their names here.
RUNS = {
    "experiments": {"baseline_v2": "baseline_v2", "I1_roll120": "roll120", "I1_roll80": "roll80", "I2_vol_r0.10": "vol_0.10", "I2_vol_r0.20": "vol_0.20", "I3_lgbm": "gbt", "I4_clipy": "clipy", "ALL_r120_v0.10": "all_0.10", "ALL_r120_v0.20": "all_0.20"},
    "notebook": {"baseline_v2": "baseline_v2", "I1_roll120": "roll120", "I1_roll80": "roll80", "I2_vol_r0.10": "vol_0.10", "I2_vol_r0.20": "vol_0.20", "I3_lgbm": "gbt", "I4_clipy": "clipy"},
    "improvements": {"M0_base": "baseline_v2", "M1_poolridge": "pooled_ridge", "M2_blend": "half_blend", "M3_signcons": "sign_conservative", "M5_tight": "tight", "M8_poollgbm": "gbt_pooled"},
}


def fingerprint(bars: DataFrame) -> str:
    """A digest of the rows (stk, i, p, v), whatever their order or partitions."""
    row = F.xxhash64("stk", "i", "p", "v").cast("decimal(38,0)")
    r = bars.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("s"), F.sum(row % 1_000_003).alias("t")).first()
    return f"{r.n}-{r.s}-{r.t}"


def parameters(method: str) -> dict:
    """What a method's forecasts depend on besides the bars."""
    return asdict(R.PLANS[method]) if method in R.PLANS else asdict(R.POOLED) if method == "pooled_ridge" else asdict(R.BASE)


class Store:
    """Scores by (method, parameters, bars) below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def entry(self, method: str, bars_digest: str) -> tuple[str, str]:
        """The folder of a method's scores, and its manifest."""
        manifest = json.dumps({"method": method, "parameters": parameters(method), "bars": bars_digest}, sort_keys=True)
        return f"{self.folder}/{hashlib.sha256(manifest.encode()).hexdigest()}", manifest

    def has(self, method: str, bars_digest: str) -> bool:
        return self._fs.exists(self._path(self.entry(method, bars_digest)[0]))

    def manifests(self) -> list[dict]:
        """Of all that is published."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        return [json.loads(r.value) for r in self.spark.read.text(f"{self.folder}/*/manifest.json").collect()] if self._fs.globStatus(self._path(f"{self.folder}/*/manifest.json")) else []

    def _publish(self, made: str, method: str, bars_digest: str) -> None:
        """Move a method's folder to its place; if another run was faster, drop it."""
        place, manifest = self.entry(method, bars_digest)
        out = self._fs.create(self._path(f"{made}/manifest.json"), True)
        out.write(bytearray(manifest.encode()))
        out.close()
        if self._fs.exists(self._path(place)) or not self._fs.rename(self._path(made), self._path(place)):
            self._fs.delete(self._path(made), True)

    def run(self, bars: DataFrame, methods: list[str]) -> DataFrame:
        """method, stk, n, base, abs and rel; methods that are absent are computed first, those that share features together.

        The bars are made once, for the digest and all methods."""
        bars = kept(bars.select("stk", "i", "p", "v"))
        digest = fingerprint(bars)
        absent = [m for m in methods if not self.has(m, digest)]
        if absent:
            # a hidden folder: no reader of the store looks there
            made = f"{self.folder}/_made-{uuid.uuid4().hex}"
            R.compare(bars, absent).write.partitionBy("method").parquet(made)
            for m in absent:
                self._fs.mkdirs(self._path(f"{made}/method={m}"))  # of empty bars nothing was written
                self._publish(f"{made}/method={m}", m, digest)
            self._fs.delete(self._path(made), True)
        out = None
        for m in methods:
            own = self.spark.read.schema(SCORES).option("pathGlobFilter", "*.parquet").parquet(self.entry(m, digest)[0]).select(F.lit(m).alias("method"), "*")
            out = own if out is None else out.unionByName(own)
        return out


def named(scores: DataFrame, run: str) -> DataFrame:
    """Scores with the names that a run gives its methods; a run may have a method once only."""
    names = F.create_map(*(F.lit(x) for shown, own in RUNS[run].items() for x in (own, shown)))
    return scores.withColumn("method", names[F.col("method")])


def table(scores: DataFrame, run: str) -> DataFrame:
    """The run's summary, with the differences to its first method."""
    return score.against_baseline(score.summary(named(scores, run)), next(iter(RUNS[run])), round_first=False)


def wide(scores: DataFrame, run: str) -> DataFrame:
    """A row per key, with two columns for each method of the run."""
    return score.wide(named(scores, run), list(RUNS[run]))
