"""Writing published documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusloom.operators.publish import LINE_ORDER


def write_lines(lines: DataFrame, path: str) -> None:
    """A line table as text, one folder per site.

    Lines are range-partitioned in file order, so reading a site's part files by name gives its lines in
    order, and a dominant site is written by many tasks.
    """
    order = ["site", *LINE_ORDER]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("site", "line")
        .write.mode("overwrite")
        .option("lineSep", "\n")
        .partitionBy("site")
        .text(path)
    )


@dataclass
class _Written(WriterCommitMessage):
    count: int


class _OneFilePerRow(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyarrow import fs as arrow_fs

        files, base = arrow_fs.FileSystem.from_uri(self.root)
        made: set[str] = set()
        count = 0
        for row in iterator:
            target = f"{base}/{row['path']}"
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            with files.open_output_stream(target) as out:
                out.write(row["content"].encode("utf-8"))
            count += 1
        return _Written(count)


class DocumentFiles(DataSource):
    """Sink writing one file per ``(path, content)`` row, from the tasks that hold the rows.

    A retried task writes the same bytes to the same path again.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _OneFilePerRow(self.options["root"])


def write_files(documents: DataFrame, root: str) -> None:
    """Export ``(path, content)`` rows as files below ``root`` (any file-system URI executors can reach)."""
    spark = documents.sparkSession
    spark.dataSource.register(DocumentFiles)
    uri = root if "://" in root else f"file://{root}"
    documents.select("path", "content").write.format("document_files").mode("append").option("root", uri).save()
