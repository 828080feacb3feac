"""Captured responses of remote sources, directory manifests and settings as tables."""

from __future__ import annotations

import configparser
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_captures(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """JSON lines {key, data, errors} -> (key, row, ordinal, error): one row per payload, an error row where there are errors.

    `payload` is the schema of one payload. A null or empty list of data without errors has no row; lines that are no JSON
    are error rows with a null key. Ordinals count empty payloads too, so they stay what the source said.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", f"key string, data array<{payload}>, errors array<string>").alias("p"), "value")
    bad = F.when(F.col("p.key").isNull(), F.lit("unreadable")).when(F.size("p.errors") > 0, F.array_join("p.errors", "; "))
    failed = parsed.where(bad.isNotNull()).select(F.col("p.key").alias("key"), F.lit(None).cast(payload).alias("row"), F.lit(None).cast("int").alias("ordinal"), bad.alias("error"))
    rows = parsed.where(bad.isNull()).select(F.col("p.key").alias("key"), F.posexplode("p.data").alias("ordinal", "row"))
    return rows.select("key", "row", "ordinal", F.lit(None).cast("string").alias("error")).unionByName(failed)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder -> (dir, name, bytes, modified), from listings alone: contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def glob_to_regex(glob: str) -> str:
    """A name pattern: `*` is anything within one part of a path, all else stands for itself."""
    return "(?i)^" + "[^/]*".join("\\Q" + part + "\\E" if part else "" for part in glob.split("*")) + "$"


def siblings(files: DataFrame, patterns: list[str]) -> DataFrame:
    """files(dir, name) -> (dir, name, sibling): files of the same folder whose name is the stem with one of the patterns.

    A pattern holds {stem}; a file is not its own sibling. Joined on folder and stem, never across folders.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    media = files.select("dir", "name", F.lower(stem).alias("stem"))
    found = None
    for p in patterns:
        before, after = p.split("{stem}", 1)
        rx = "(?i)^" + "".join("[^/]*" if c == "*" else "\\Q" + c + "\\E" for c in before) + "(.*)" + "".join("[^/]*" if c == "*" else "\\Q" + c + "\\E" for c in after) + "$"
        one = files.select("dir", F.col("name").alias("sibling"), F.lower(F.regexp_extract("name", rx, 1)).alias("stem")).where("stem <> ''")
        found = one if found is None else found.unionByName(one)
    return media.join(found.distinct(), ["dir", "stem"]).where(F.col("name") != F.col("sibling")).select("dir", "name", "sibling").distinct()


def setting(name: str, default: str | None = None, ini: str | None = None, section: str = "settings") -> str | None:
    """A setting from the environment, else from an INI file, else the default."""
    if name.upper() in os.environ:
        return os.environ[name.upper()]
    if ini and os.path.exists(ini):
        parser = configparser.ConfigParser()
        parser.read(ini)
        return parser.get(section, name, fallback=default)
    return default


def decode_data_uri(c: Column, max_bytes: int = 12 * 1024 * 1024) -> Column:
    """A data address -> struct(mime, data, sha256), null if it is none, is broken or too large."""
    rx = r"(?s)^data:([\w.+\-]+/[\w.+\-]+);base64,(.*)$"
    data = F.try_to_binary(F.regexp_replace(F.regexp_extract(c, rx, 2), r"\s", ""), F.lit("base64"))
    return F.when(c.rlike(rx) & data.isNotNull() & (F.octet_length(data) <= max_bytes), F.struct(F.regexp_extract(c, rx, 1).alias("mime"), data.alias("data"), F.sha2(data, 256).alias("sha256")))
