"""Keyed tables in bucketed versions: upserts and look-ups by key without an exchange of the table.

A table is a folder.  Each version is a folder of Parquet files bucketed and sorted by the keys, and a manifest ``_versions/N`` that
names it.  A manifest is created only if there is none of its number, which the file system does atomically, so of two writers that
began with one version the second one fails and nothing of the first is lost.  Readers see whole versions only.  A writer that dies
between the two steps of a commit leaves an empty manifest, which must be deleted before the next commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made a version since this one was read."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    place, files = _files(spark, path)
    folder = place(f"{path}/_versions")
    if not files.exists(folder):
        return []
    found = [(s.getPath().getName(), s.getLen()) for s in files.listStatus(folder)]
    return sorted(int(name) for name, size in found if name.isdigit() and size)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, folder, keys, buckets of a version, the last by default."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version of a table at {path}")
    place, files = _files(spark, path)
    stream = files.open(place(f"{path}/_versions/{known[-1] if version is None else version}"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, the last by default, with its bucketing: joins and groups by its keys need no exchange of it."""
    known = manifest(spark, path, version)
    name = f"versioned_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{c['name']}` {c['type']}" for c in known["columns"])
    keys = ", ".join(f"`{k}`" for k in known["keys"])
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({keys}) sorted by ({keys}) into {known['buckets']} buckets location '{known['folder']}'")
    return spark.table(name)


def commit(rows: DataFrame, path: str, keys: Sequence[str], buckets: int, version: int) -> None:
    """Writes ``rows`` as ``version``; raises Conflict if there is one of this number."""
    spark = rows.sparkSession
    place, files = _files(spark, path)
    folder = str(files.makeQualified(place(f"{path}/v{version}-{uuid.uuid4().hex}")).toString())
    name = f"versioned_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", folder).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    body = json.dumps({"version": version, "folder": folder, "keys": list(keys), "buckets": buckets, "columns": [{"name": c, "type": t} for c, t in rows.dtypes]})
    spark.sql(f"drop table {name}")
    files.mkdirs(place(f"{path}/_versions"))
    try:
        stream = files.create(place(f"{path}/_versions/{version}"), False)
    except Exception as error:
        if not files.exists(place(f"{path}/_versions/{version}")):
            raise
        files.delete(place(folder), True)
        raise Conflict(f"version {version} of {path} was made by another writer") from error
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """The first version; raises Conflict if there is a table.  Rows with a null key raise."""
    commit(_checked(rows, keys), path, keys, buckets, 1)


def _checked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    wrong = F.raise_error(F.lit("a key is null"))
    return rows.withColumns({k: F.coalesce(F.col(k), wrong.cast(rows.schema[k].dataType)) for k in keys})


def upsert(new: DataFrame, path: str) -> None:
    """The next version: the last one's rows without the keys that ``new`` has, and ``new``.

    Only ``new`` is dealt: it goes to the table's buckets, where both sides of the anti join lie.  Rows of one key stay together, so a
    version's files are as many as its buckets, twice at most.
    """
    spark = new.sparkSession
    known = manifest(spark, path)
    keys, buckets = known["keys"], known["buckets"]
    old = read(spark, path, known["version"])
    added = _checked(new.select(*old.columns), keys).repartition(buckets, *keys)
    commit(kept(old, added, keys).unionByName(added), path, keys, buckets, known["version"] + 1)


def kept(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` (as ``read``) without the keys that ``new`` has."""
    return old.hint("merge").join(new.select(*keys).hint("merge"), list(keys), "left_anti")


