"""Partitioned Parquet tables whose state is what their newest manifest lists.

A write goes to folders of its own, which nobody reads yet, and is published by one manifest that lists all live folders.
Manifests are numbered and a number can be taken once, by a rename that fails if it is there: of two writers at a time the
second starts again from the first one's state. So a write that fails halfway leaves the table as it was, a repeated one
replaces its own rows, and none are lost or doubled. A manifest has an entry per live folder, not per row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "_v"
#: Spark's folder name for null and empty partition values.
NOTHING = "__HIVE_DEFAULT_PARTITION__"


class Lost(Exception):
    """Another writer took the number."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, its paths, and an empty list of rename options: no overwriting."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    context = fs.FileContext.getFileContext(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    return context, fs.Path, spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)


def state(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, what it lists) of the newest manifest; (0, no folders) of a table that isn't there. ``live`` has a list of
    partition values, the version last, for each live folder; ``facts`` is what writers noted."""
    context, at, _ = _files(spark, path)
    folder = at(f"{path}/manifests")
    if not context.util().exists(folder):
        return 0, {"live": [], "facts": {}}
    found = [f.getPath().getName() for f in context.util().listStatus(folder)]
    number = max((int(n) for n in found if n.isdigit()), default=0)
    if not number:
        return 0, {"live": [], "facts": {}}
    text = spark.read.text(f"{path}/manifests/{number:012d}", wholetext=True).first()[0]
    return number, json.loads(text)


def publish(spark: SparkSession, path: str, number: int, live: list[list[str]], facts: dict) -> None:
    """Make ``live`` the table's state, as manifest ``number``; ``Lost`` if that one is there already."""
    context, at, options = _files(spark, path)
    draft, final = at(f"{path}/manifests/.{uuid.uuid4().hex}"), at(f"{path}/manifests/{number:012d}")
    context.mkdir(at(f"{path}/manifests"), None, True)
    fs = draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"live": live, "facts": facts}).encode()))
    out.close()
    try:
        context.rename(draft, final, options)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise Lost(number) from e
        raise


def _text(c: str) -> Column:
    """A partition's value as the manifest has it; null and empty are one partition, as they are in folders."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def read(spark: SparkSession, path: str, by: list[str], live: list[list[str]] | None = None) -> DataFrame:
    """Rows of the live folders of a table partitioned by ``by``; the folders are chosen as partitions, before any is opened."""
    live = state(spark, path)[1]["live"] if live is None else live
    if not live:
        raise FileNotFoundError(f"{path}: nothing is published")
    place = F.concat_ws("\x01", *[_text(c) for c in (*by, VERSION)])
    return spark.read.parquet(f"{path}/data").where(place.isin(["\x01".join(x) for x in live])).drop(VERSION)


def write(df: DataFrame, path: str, by: list[str], keys: list[str] | None = None, replace: bool = False, facts: dict | None = None, tries: int = 5) -> None:
    """Publish the rows of ``df`` in a table partitioned by ``by``, all of string type in the manifest.

    With ``replace`` they take the place of the partitions that they have; else they are added, and rows whose ``keys`` are
    in the table already are left out, as they are then when another writer was first.
    """
    spark = df.sparkSession
    for _ in range(tries):
        number, was = state(spark, path)
        rows = df
        if keys and not replace and was["live"]:
            rows = df.join(read(spark, path, by, was["live"]).select(*keys).distinct(), keys, "left_anti")
        version = uuid.uuid4().hex
        rows.withColumn(VERSION, F.lit(version)).repartition(*by).write.partitionBy(*by, VERSION).mode("append").parquet(f"{path}/data")
        mine = [[str(v) for v in r] for r in rows.select(*[_text(c).alias(c) for c in by]).distinct().collect()]
        new = [[*p, version] for p in mine]
        old = [x for x in was["live"] if not (replace and x[:-1] in mine)]
        try:
            publish(spark, path, number + 1, old + new, {**was["facts"], **(facts or {})})
            return
        except Lost:
            continue
    raise Lost(f"{path}: other writers were first {tries} times")


def replace_runs(df: DataFrame, path: str, by: list[str], old: list[list[str]], number: int, was: dict) -> None:
    """Publish ``df``, one partition, in the place of the live folders ``old`` of state ``was``; ``Lost`` if that isn't the newest."""
    version = uuid.uuid4().hex
    df.withColumn(VERSION, F.lit(version)).write.partitionBy(*by, VERSION).mode("append").parquet(f"{path}/data")
    mine = [[*[r[c] for c in by], version] for r in df.select(*[_text(c).alias(c) for c in by]).limit(1).collect()]
    publish(df.sparkSession, path, number + 1, [x for x in was["live"] if x not in old] + mine, was["facts"])


def sweep(spark: SparkSession, path: str, by: list[str], keep: int = 2) -> int:
    """Delete the folders that none of the last ``keep`` manifests lists, once no writer is at work; their number."""
    context, at, _ = _files(spark, path)
    number = state(spark, path)[0]
    wanted = set()
    for n in range(max(1, number - keep + 1), number + 1):
        wanted |= {tuple(x) for x in json.loads(spark.read.text(f"{path}/manifests/{n:012d}", wholetext=True).first()[0])["live"]}
    plain = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    folders = [(at(f"{path}/data"), ())]
    for _ in (*by, VERSION):
        below = [(f.getPath(), p) for x, p in folders for f in context.util().listStatus(x) if f.isDirectory() and "=" in f.getPath().getName()]
        folders = [(x, (*p, "" if (v := plain(x.getName().split("=", 1)[1])) == NOTHING else v)) for x, p in below]
    gone = [f for f, p in folders if p not in wanted]
    for f in gone:
        context.delete(f, True)
    return len(gone)
