"""Files as tables: listings, texts and daily usage files. Folders are read recursively and by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "struct<provider:string,model:string,requests:long,successful:long,failed:long,tokens:long,cost:double,avg_response_time:double>"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC12/SRC13: ``path, length, modificationTime`` of all files below ``path`` whose names match; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """SRC14: ``file, folder, name, value`` of all texts below ``path``, a row a file; the folder is the last part of the path before the name."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    file = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    return rows.select(file.alias("file"), F.element_at(F.split(file, "/"), -2).alias("folder"), F.element_at(F.split(file, "/"), -1).alias("name"), "value")


def daily_usage(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: a row for each model of each daily file ``usage_*.json``: the day, and the fields of the model; broken files give none."""
    kind = f"date string, models map<string,{MODEL}>"
    rows = spark.read.schema(kind).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "usage_*.json").json(path)
    return rows.select(F.to_date("date").alias("day"), F.explode("models").alias("key", "m")).select("day", "m.*")
