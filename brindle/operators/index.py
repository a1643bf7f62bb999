"""Versioned index on Parquet: manifest diff, upsert, delete, inverted index, publish, counts."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scalars import index_tokens
from brindle.functions.stemming import vocabulary

MANIFEST = "manifest.json"
FIELDS = ("title", "text")


def plan_build(on_disk: DataFrame, indexed: DataFrame, version_changed: bool = False) -> DataFrame:
    """``(source_path, state)`` from two manifests ``(source_path, mtime)``: new, changed, unchanged or deleted."""
    d, i = on_disk.select("source_path", F.col("mtime").alias("d")), indexed.select("source_path", F.col("mtime").alias("i"))
    state = (
        F.when(F.col("i").isNull(), "new")
        .when(F.col("d").isNull(), "deleted")
        .when(F.lit(version_changed) | (F.col("d") > F.col("i")), "changed")
        .otherwise("unchanged")
    )
    return d.join(i, "source_path", "full_outer").select("source_path", state.alias("state"))


def without_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records whose source is not among ``sources`` (vanished or to be replaced)."""
    return records.join(sources.select("source_path").distinct(), "source_path", "left_anti")


def upsert(current: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """The snapshot with ``fresh`` rows in place of those of the same key."""
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def index_counts(records: DataFrame) -> DataFrame:
    """Records, parents and sources, exactly."""
    return records.agg(F.count("*").alias("record_count"), F.countDistinct("parent_id").alias("parent_count"), F.countDistinct("source_path").alias("source_file_count"))


def doc_stats(records: DataFrame, id_column: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(id, dl)``: words of each record over its indexed fields; null fields have none."""
    sizes = [F.size(index_tokens(F.col(f))) for f in fields]
    return records.select(F.col(id_column).alias("id"), sum(sizes[1:], sizes[0]).alias("dl"))


def postings(records: DataFrame, id_column: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(stem, term, id, field, positions, dl)``: the inverted index, in ranges of stem and id.

    Each distinct term is stemmed once. The ranges give every file few stems, so a filter on stems reads little; a stem
    that holds much of the index spans several files. ``dl`` is the length of the record in words. Null fields and empty texts have no rows.
    """
    tokens = records.select(F.col(id_column).alias("id"), *[index_tokens(F.col(f)).alias(f"f{k}") for k, f in enumerate(fields)])
    sizes = [F.size(f"f{k}") for k in range(len(fields))]

    def placed(k: int) -> Column:
        return F.transform(f"f{k}", lambda t, i: F.struct(F.lit(fields[k]).alias("field"), i.alias("position"), t.alias("term")))

    exploded = tokens.select("id", sum(sizes[1:], sizes[0]).alias("dl"), F.explode(F.concat(*map(placed, range(len(fields))))).alias("p")).select("id", "dl", "p.*")
    lists = exploded.groupBy("term", "id", "field", "dl").agg(F.array_sort(F.collect_list("position")).alias("positions"))  # bounded by one field of one record
    stems = vocabulary(records.select(F.explode(F.concat(*[F.array_distinct(index_tokens(F.col(f))) for f in fields])).alias("term")))
    return arranged(lists.join(stems, "term").select("stem", "term", "id", "field", "positions", "dl"))


def arranged(posting_rows: DataFrame) -> DataFrame:
    """Postings in ranges of stem and id, sorted inside each."""
    return posting_rows.repartitionByRange("stem", "id").sortWithinPartitions("stem", "id")


def term_stats(posting_rows: DataFrame, by: str = "stem") -> DataFrame:
    """``(by, df, cf)``: records and occurrences of each stem or term."""
    per = posting_rows.groupBy(by, "id").agg(F.sum(F.size("positions")).alias("tf"))
    return per.groupBy(by).agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


class VersionedIndex:
    """Datasets of a corpus in folders ``root/v=<n>``, and a manifest per version that names the folder of each dataset.

    A version is there once its manifest is, which is written last, under another name, and then renamed: a reader or a lost job sees
    the version before or the new one, never a part and never none. A dataset that a new version does not write is
    taken over from the version before, by its folder. Works on any file system that Spark reaches.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, pattern: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/{pattern}")) or []
        names = [f.getPath() for f in found]
        return [int((p.getParent() if p.getName() == MANIFEST else p).getName()[2:]) for p in names]

    def current(self) -> int | None:
        """The latest complete version."""
        return max(self._versions(f"v=*/{MANIFEST}"), default=None)

    def read(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"no published {name} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{self.manifest()['datasets'][name]}")

    def has(self, name: str) -> bool:
        return self.current() is not None and name in self.manifest()["datasets"]

    def publish(self, datasets: dict[str, DataFrame | Callable[[DataFrame], DataFrame]], meta: dict[str, object] | None = None, keep: bool = True) -> int:
        """Write every dataset as the next version, and then its manifest.

        A dataset may be a function of the version's records: it gets them as they were written, so what made
        them does not run again. Without ``keep`` nothing is taken over from the version before.
        """
        before = self.manifest() if keep and self.current() is not None else {}
        version = max(self._versions("v=*"), default=0) + 1
        places = dict(before.get("datasets", {}))
        for name in sorted(datasets, key=lambda n: n != "records"):
            df = datasets[name]
            if not isinstance(df, DataFrame):
                df = df(self.spark.read.parquet(f"{self.root}/{places['records']}"))
            df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
            places[name] = f"v={version}/{name}"
        facts = {k: v for k, v in before.items() if k.endswith("_count") or k == "batch_id"} | dict(meta or {})
        if "records" in datasets:
            facts |= index_counts(self.spark.read.parquet(f"{self.root}/{places['records']}")).first().asDict()
        if "doc_stats" in datasets:
            facts |= self.spark.read.parquet(f"{self.root}/{places['doc_stats']}").agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("dl"), F.lit(0)).alias("token_count")).first().asDict()
        facts |= {"datasets": places, "build_complete_at": datetime.now(timezone.utc).isoformat()}
        self._write(f"{self.root}/v={version}/{MANIFEST}", json.dumps(facts))
        return version

    def manifest(self) -> dict[str, object]:
        return json.loads(self.spark.read.text(f"{self.root}/v={self.current()}/{MANIFEST}", wholetext=True).first()["value"])

    def _write(self, path: str, text: str) -> None:
        part, target = self._path(f"{path}.part"), self._path(path)
        out = self._fs.create(part, True)
        out.write(text.encode())
        out.close()
        if not self._fs.rename(part, target):
            raise OSError(f"cannot publish {path}")


def search_datasets(id_column: str = "id", fields: tuple[str, ...] = FIELDS) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """What ``publish`` needs besides the records so that they can be searched by words."""
    return {"postings": lambda records: postings(records, id_column, fields), "doc_stats": lambda records: doc_stats(records, id_column, fields)}
