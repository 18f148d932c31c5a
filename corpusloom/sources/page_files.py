"""Page files of an earlier run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.url import site_folder

_PAGES = "/ai/pages/"


def read_page_files(spark: SparkSession, root: str, sites: DataFrame) -> DataFrame:
    """Exported page files below ``root``, one row per file, with the URL their front matter names.

    The folder of a file is the name of its site, with ``_`` for ``:``.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    ).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    named = files.select(
        F.regexp_extract("file", rf"([^/]+){_PAGES}[^/]+$", 1).alias("folder"),
        F.regexp_extract("file", r"(ai/pages/[^/]+)$", 1).alias("relative_output_path"),
        F.replace(
            F.replace(F.regexp_extract("content", r'(?m)^source_url: "(.*)"$', 1), F.lit('\\"'), F.lit('"')),
            F.lit("\\\\"),
            F.lit("\\"),
        ).alias("url"),
        "content",
    )
    folders = sites.select("site", site_folder(F.col("site")).alias("folder"))
    return named.join(folders, "folder").drop("folder")
