"""Source trees: a scan with the reasons why files are left out, and the manifest of what is read."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.folds import running_total
from loomgraph.schemas import EXCLUDED_DIRECTORIES, SENSITIVE_ENDS, SENSITIVE_NAMES, SENSITIVE_PARTS, SENSITIVE_STEMS, SENSITIVE_SUFFIXES

# Bytes of a file, files and bytes of a repository.
MOST_BYTES = 2 * 1024 * 1024
MOST_FILES = 25_000
MOST_TOTAL = 512 * 1024 * 1024


def either(checks: list[Column]) -> Column:
    return reduce(Column.__or__, checks)


def sensitive(name: Column) -> Column:
    """Whether a file's name says that it may hold a secret: by whole name, by suffix, by a part, or by its stem. A leading dot begins no suffix."""
    low = F.lower(name)
    stem = F.translate(F.regexp_replace(low, r"(?<=.)\.[^.]*$", ""), "-.", "__")
    suffix = F.regexp_extract(low, r"^.+(\.[^.]+)$", 1)
    return either([
        low.isin(SENSITIVE_NAMES), suffix.isin(SENSITIVE_SUFFIXES), low.startswith(".env."), stem.isin(SENSITIVE_STEMS),
        *[low.contains(x) for x in SENSITIVE_PARTS], *[stem.endswith(x) for x in SENSITIVE_ENDS],
    ])


def reason(relative: Column, length: Column) -> Column:
    """Why a file is left out, by its path and length alone; null if it isn't. Its own name is no directory."""
    parts = F.split(relative, "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return (
        F.when(F.arrays_overlap(parents, F.array(*[F.lit(x) for x in EXCLUDED_DIRECTORIES])), "excluded_directory")
        .when(sensitive(F.substring_index(relative, "/", -1)), "sensitive_name").when(length > MOST_BYTES, "too_large")
    )


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, language, bytes, skipped (null: the file is to be read) and its full name. No file is opened: Spark's listing gives names and lengths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    relative = F.regexp_replace(F.substring_index("path", f"{root.rstrip('/').split('://')[-1]}/", -1), "^/+", "")
    suffix = F.lower(F.substring_index(relative, ".", -1))
    language = F.when(suffix == "java", "Java").when(suffix == "py", "Python")
    out = files.select(relative.alias("path"), language.alias("language"), F.col("length").alias("bytes"), reason(relative, F.col("length")).alias("skipped"), F.col("path").alias("full"))
    return out.filter(F.col("language").isNotNull() | F.col("skipped").isNotNull())


class TooLarge(ValueError):
    """A repository goes over a limit; nothing of it is read."""


def over_limits(spark: SparkSession, files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_TOTAL) -> DataFrame:
    """The first file, in order of path, with which count or bytes (columns path, bytes) go over, its position, the bytes with it, and which limit it is (the count is looked at first); no row if all is within. A
    running sum over ranges of paths finds it, so no task sums up all files. Ties in the path count one by one."""
    told = running_total(spark, files.select("path", "bytes", F.monotonically_increasing_id().alias("__tie")), ["path", "__tie"], F.col("bytes"))
    why = F.when(F.col("position") > most_files, "files").when(F.col("total") > most_bytes, "bytes")
    return told.select("path", "position", "total", why.alias("over")).filter("over is not null").orderBy("position").limit(1)


def scan(spark: SparkSession, root: str, most_files: int = MOST_FILES, most_bytes: int = MOST_TOTAL) -> DataFrame:
    """path, language, bytes, sha256, content and skipped (null: the file is read). What is skipped is decided on names and lengths before anything is opened, and a
    skipped file is never opened: the contents are those of a second scan that is given the names of the other files alone; a skipped file's sha256 and content are null. Beyond the limits nothing is read
    (TooLarge). Empty files hold nothing and are not listed; nor are names that begin with a dot or an underscore, which Spark's file listing hides. Files are read on the
    executors, from any store that Spark reads; their names, at most most_files, pass through the driver, as those of any table's files do."""
    listed = listing(spark, root)
    wanted = listed.filter("skipped is null and language is not null")
    if found := over_limits(spark, wanted.filter("bytes > 0"), most_files, most_bytes).first():
        raise TooLarge(f"the repository exceeds its limit of {found['over']} with file {found['position']}")
    left = listed.filter("skipped is not null").select("path", "language", "bytes", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("content"), "skipped")
    plain = [re.sub(r"([{}\[\]*?\\])", r"\\\1", r["full"]) for r in wanted.select("full").collect()]
    if not plain:
        return left
    files = spark.read.format("binaryFile").load(plain).select(F.col("path").alias("full"), F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return wanted.join(files, "full").select("path", "language", "bytes", "sha256", "content", "skipped").unionByName(left)


def preflight(files: DataFrame) -> DataFrame:
    """Files and bytes by language and reason for leaving out."""
    return files.groupBy("language", "skipped").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
