"""The channel dimension, from pages of an upstream API kept as JSON files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.scalars import host_of

_ITEM = "array<struct<id:int,name:string,base_url:string>>"


#: Rows of a full page, and pages that are asked for at most: the dimension has PAGE * PAGES rows at most.
PAGE, PAGES = 100, 20


def fetch_channels(spark: SparkSession, page: Callable[[int], str], rows: int = PAGE, pages: int = PAGES) -> DataFrame:
    """read_channels() of the pages (numbers from 1) that a function returns as text, up to the first that isn't full."""
    texts = []
    for number in range(1, pages + 1):
        texts.append(page(number))
        found = json.loads(texts[-1]).get("data")
        if len(found.get("items") or [] if isinstance(found, dict) else found or []) < rows:
            break
    return _channels(spark.createDataFrame([(t,) for t in texts], "value string"))


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """id, name, base_url; data may be a list or hold one under items, and a blank name becomes the host."""
    return _channels(spark.read.option("wholetext", "true").text(path))


def _channels(pages: DataFrame) -> DataFrame:
    data = F.from_json("value", "data string")["data"]
    items = F.when(F.startswith(data, F.lit("[")), F.from_json(data, _ITEM)).otherwise(F.from_json(data, f"items {_ITEM}")["items"])
    rows = pages.select(F.explode(items).alias("c")).select("c.*")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), host_of(F.col("base_url")))
    return rows.select("id", name.alias("name"), "base_url").dropDuplicates(["id"])
