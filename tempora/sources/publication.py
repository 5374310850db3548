"""Published tables: versions side by side, and a manifest that names the current ones and is swapped by one rename.

A folder holds version-* folders, each written once and never changed, and the file MANIFEST: a line of JSON with a part's name, its
version, and the fingerprint that it was built from. Readers take the versions that the manifest names when they begin; a build that
fails leaves the manifest, and so all readers, as they were. Two builds at once don't harm readers; the one that ends last stays.
Versions that no manifest names are deleted by retired() alone, when nobody reads them any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "MANIFEST"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Parts by name, with version and fingerprint; empty where nothing is published."""
    at, files = _path(spark, f"{folder}/{MANIFEST}")
    if not files.exists(at):
        return {}
    stream = files.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {p["part"]: p for p in map(json.loads, text.splitlines())}


def _swapped(spark: SparkSession, folder: str, parts: dict[str, dict]) -> None:
    """The rename takes the old file's place in one step where the store renames so; readers see one of both, whole."""
    at, files = _path(spark, f"{folder}/{MANIFEST}")
    new, _ = _path(spark, f"{folder}/.{MANIFEST}-{uuid.uuid4().hex}")
    files.mkdirs(at.getParent())
    stream = files.create(new, False)
    try:
        stream.write(bytearray("".join(json.dumps(parts[p], sort_keys=True) + "\n" for p in sorted(parts)), "utf-8"))
        stream.hsync()
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    rename[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(new), files.makeQualified(at), rename)


def published_parts(spark: SparkSession, folder: str, parts: dict[str, tuple[str, Callable[[], DataFrame]]], form: str = "parquet") -> list[str]:
    """Publishes the parts (name: fingerprint of what it is built from, and how to build it) in place of all that were there.
    Only parts whose fingerprint is new are built; the names of these come back. All parts change at once, after the last is written."""
    known, now, built = manifest(spark, folder), {}, []
    for name, (fingerprint, build) in parts.items():
        if name in known and known[name]["fingerprint"] == fingerprint:
            now[name] = known[name]
            continue
        version = f"version-{uuid.uuid4().hex}"
        build().write.format(form).save(f"{folder}/{version}")
        now[name] = {"part": name, "version": version, "fingerprint": fingerprint, "form": form}
        built.append(name)
    if now != known:
        _swapped(spark, folder, now)
    return built


def publish(df: DataFrame, folder: str, form: str = "json") -> None:
    """A table in place of the one that is published there."""
    published_parts(df.sparkSession, folder, {"": (uuid.uuid4().hex, lambda: df)}, form)


def published(spark: SparkSession, folder: str, part: str = "", schema: StructType | None = None) -> DataFrame:
    """The current version of a part; an error where it is not published."""
    found = manifest(spark, folder)
    if part not in found:
        raise FileNotFoundError(f"nothing is published as {part or 'a table'} in {folder}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(found[part]["form"]).load(f"{folder}/{found[part]['version']}")


def retired(spark: SparkSession, folder: str) -> list[str]:
    """Deletes versions that the manifest does not name, those of failed builds too, and returns their names."""
    keep = {p["version"] for p in manifest(spark, folder).values()}
    at, files = _path(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(at)]
    gone = sorted(n for n in names if (n.startswith("version-") and n not in keep) or n.startswith(f".{MANIFEST}-"))
    for n in gone:
        files.delete(_path(spark, f"{folder}/{n}")[0], True)
    return gone


def state(spark: SparkSession, path: str) -> str:
    """What tells whether a file or folder has changed: paths, lengths and times of its files."""
    at, files = _path(spark, path)
    told = []
    for top in files.globStatus(at) or []:
        found = files.listFiles(top.getPath(), True)
        while found.hasNext():
            s = found.next()
            told.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return json.dumps(sorted(told))
