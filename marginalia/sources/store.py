"""Evaluations and generations as tables: upsert, append, materialise, purge, and their guards."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.operators.tables import export_summary
from marginalia.provenance import ProvenanceError, require

KEY = ["question_id", "model_name", "retrieval_mode"]
#: Fields that a checkpoint row must have, and mustn't have blank.
MANDATORY = ["cache_key", *KEY, "answer_text"]
PROVENANCE = ["corpus_source", "retriever_backend", "generation_backend"]


def last_of(df: DataFrame, key: list[str], order: Column | str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order) if isinstance(order, str) else order.desc()))).filter("__n = 1").drop("__n")


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table with new rows in the place of those of their key; of new rows with one key, any one is as good."""
    once = new.dropDuplicates(key)
    return table.join(once.select(*key), key, "left_anti").unionByName(once)


def blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""


def filtered(df: DataFrame, model: str = "", mode: str = "") -> DataFrame:
    """By model and mode, where they are given; an empty one is no filter."""
    df = df.filter(F.col("model_name") == model) if model else df
    return df.filter(F.col("retrieval_mode") == mode) if mode else df


def split_record(rows: DataFrame, generation: list[str], meta: list[str], extra: str = "extra") -> tuple[DataFrame, DataFrame]:
    """(generation, meta): two projections of a record; fields that aren't known go to meta, as JSON."""
    unknown = [c for c in rows.columns if c not in generation and c not in meta]
    packed = F.to_json(F.struct(*unknown)) if unknown else F.lit(None).cast("string")
    return rows.select(*[c for c in generation if c in rows.columns]), rows.select("cache_key", *[c for c in meta if c in rows.columns and c != "cache_key"], packed.alias(extra))


def guard_rows(rows: DataFrame) -> DataFrame:
    """rows, if none lacks a mandatory or provenance field; else raises."""
    wanted = [c for c in [*MANDATORY, *PROVENANCE] if c not in rows.columns]
    require(not wanted, f"checkpoint rows lack columns: {wanted}")
    lacking = rows.filter(F.exists(F.array(*[blank(c) for c in [*MANDATORY, *PROVENANCE]]), lambda x: x)).limit(5)
    bad = [r[0] for r in lacking.select(F.coalesce("cache_key", F.lit("?"))).collect()]
    require(not bad, f"checkpoint rows lack mandatory or provenance fields: {bad}")
    return rows


def materialise(table: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """table and the checkpoint's rows whose key it lacks; a second time adds nothing."""
    new = checkpoint.join(table.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    return table.unionByName(new.select(*table.columns))


def purge(table: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, purged keys)."""
    hit = F.coalesce(predicate, F.lit(False))
    return table.filter(~hit), table.filter(hit).select("cache_key")


def orphans(generations: DataFrame, meta: DataFrame) -> DataFrame:
    """Keys of generations without a meta record; blank keys don't count."""
    return generations.filter(~blank("cache_key")).join(meta.select("cache_key"), "cache_key", "left_anti").select("cache_key").distinct()


def assert_meta_complete(generations: DataFrame, meta: DataFrame) -> None:
    bad = [r[0] for r in orphans(generations, meta).orderBy("cache_key").limit(20).collect()]
    if bad:
        raise ProvenanceError(f"generations without a meta record: {bad}")


def enrich(meta: DataFrame, checkpoint: DataFrame, fields: list[str]) -> DataFrame:
    """meta with fields of the checkpoint laid over its own, by key."""
    over = checkpoint.select("cache_key", *[F.col(f).alias(f"__{f}") for f in fields])
    joined = meta.join(over, "cache_key", "left")
    return joined.select(*[c for c in meta.columns if c not in fields], *[F.coalesce(f"__{f}", *([F.col(f)] if f in meta.columns else [])).alias(f) for f in fields])


class Repository:
    """Evaluations and generations under a path: versions in folders, of which a pointer names the current one.

    An upsert writes a whole new version beside the old one and then moves the pointer, so a
    lost executor or driver leaves the old one whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self, name: str) -> str | None:
        try:
            rows = self.spark.read.json(f"{self.path}/{name}/current").select("version", "at").orderBy(F.desc("at"), F.desc("version")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return rows[0][0] if rows else None

    def _read(self, name: str) -> DataFrame | None:
        version = self._pointer(name)
        return None if version is None else self.spark.read.parquet(f"{self.path}/{name}/{version}")

    def _write(self, name: str, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}/{version}")
        self.spark.createDataFrame([(version, time.time_ns())], "version string, at long").coalesce(1).write.mode("append").json(f"{self.path}/{name}/current")

    def save_evaluations(self, rows: DataFrame) -> None:
        """Upsert by question, model and mode."""
        old = self._read("evaluations")
        self._write("evaluations", rows.dropDuplicates(KEY) if old is None else upsert(old, rows, KEY))

    def evaluation(self, question_id: str, model_name: str, retrieval_mode: str) -> dict | None:
        t = self._read("evaluations")
        row = None if t is None else t.filter((F.col("question_id") == question_id) & (F.col("model_name") == model_name) & (F.col("retrieval_mode") == retrieval_mode)).first()
        return None if row is None else row.asDict(recursive=True)

    def evaluations(self, model: str = "", mode: str = "") -> DataFrame | None:
        t = self._read("evaluations")
        return None if t is None else filtered(t, model, mode)

    def save_generations(self, rows: DataFrame) -> None:
        """Appended; equal ones are kept."""
        old = self._read("generations")
        self._write("generations", rows if old is None else old.unionByName(rows))

    def generations(self, model: str = "", mode: str = "") -> DataFrame | None:
        t = self._read("generations")
        return None if t is None else filtered(t, model, mode)

    def summary(self) -> DataFrame | None:
        t = self._read("evaluations")
        return None if t is None else export_summary(t)

    def export(self, path: str) -> None:
        """Evaluations as JSON lines and CSV."""
        t = self._read("evaluations")
        require(t is not None, "there are no evaluations")
        t.write.mode("overwrite").json(f"{path}/json")
        flat = t.select(*[F.to_json(c).alias(c) if "<" in kind else F.col(c) for c, kind in t.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


class Batched(Repository):
    """A repository whose generations wait in the session until flush() writes them, as one version."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self._waiting: list[DataFrame] = []

    def save_generations(self, rows: DataFrame) -> None:
        self._waiting.append(rows)

    def flush(self) -> None:
        if self._waiting:
            rows = self._waiting[0]
            for more in self._waiting[1:]:
                rows = rows.unionByName(more)
            super().save_generations(rows)
            self._waiting = []


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """A run's manifest as one JSON text; readers see the old one or the new one, as the pointer moves last."""
    version = f"v-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/{version}")
    spark.createDataFrame([(version, time.time_ns())], "version string, at long").coalesce(1).write.mode("append").json(f"{path}/current")


def read_manifest(spark: SparkSession, path: str) -> dict:
    version = spark.read.json(f"{path}/current").orderBy(F.desc("at"), F.desc("version")).first()["version"]
    return json.loads(spark.read.text(f"{path}/{version}", wholetext=True).first()[0])


class Memory:
    """The same contract over frames of this session."""

    def __init__(self) -> None:
        self._evaluations: DataFrame | None = None
        self._generations: DataFrame | None = None

    def save_evaluations(self, rows: DataFrame) -> None:
        self._evaluations = rows.dropDuplicates(KEY) if self._evaluations is None else upsert(self._evaluations, rows, KEY)

    def evaluation(self, question_id: str, model_name: str, retrieval_mode: str) -> dict | None:
        row = None if self._evaluations is None else self._evaluations.filter((F.col("question_id") == question_id) & (F.col("model_name") == model_name) & (F.col("retrieval_mode") == retrieval_mode)).first()
        return None if row is None else row.asDict(recursive=True)

    def evaluations(self, model: str = "", mode: str = "") -> DataFrame | None:
        return None if self._evaluations is None else filtered(self._evaluations, model, mode)

    def save_generations(self, rows: DataFrame) -> None:
        self._generations = rows if self._generations is None else self._generations.unionByName(rows)

    def generations(self, model: str = "", mode: str = "") -> DataFrame | None:
        return None if self._generations is None else filtered(self._generations, model, mode)

    def summary(self) -> DataFrame | None:
        return None if self._evaluations is None else export_summary(self._evaluations)


def safe_output(path: str, protected: str) -> str:
    """path, if it isn't the protected one; a fixture never replaces the corpus."""
    require(path.rstrip("/") != protected.rstrip("/"), f"{path} is the corpus itself")
    return path


def newest_run(runs: DataFrame) -> DataFrame:
    """The newest run (run, started_at, rows) that has rows."""
    return runs.filter("rows > 0").orderBy(F.desc("started_at"), F.desc("run")).limit(1)
