"""Pages as HTML files, one a row, in a folder for each label.

A file is written beside the folders and renamed into place under a name that its content's hash determines, so a retry or a second attempt of a task writes the same whole file again, and readers see no half of one. No file
names pass the driver, and no rows: each task reports how many files it wrote. `_SUCCESS` comes last.

Paths: whatever pyarrow's file systems reach from the executors (file, hdfs, s3, gs). Defined cases: rows without html or with a label that has no folder are left out; rows with equal host and html in one folder
are one file; a null or empty host is `page`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.domains import slug
from ..operators.corpus import sample

#: Folder of each label; fixed values.
FOLDERS = {"phish": "phishing", "benign": "benign"}
#: Characters of the host and digits of the hash in a file name.
HOST, DIGITS = 100, 16


@dataclass
class Written(WriterCommitMessage):
    files: int


def _open(path: str):  # noqa: ANN202
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    where = "s3" + path[3:] if path.startswith("s3a:") else "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(where)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator) -> Written:
        from pyarrow import fs as types

        fs, root = _open(self.path)
        beside, files, made = f"{root}/_writing/{uuid.uuid4().hex}", 0, set()
        fs.create_dir(f"{root}/_writing")
        for batch in batches:
            for folder, name, html in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "html"))):
                if folder not in made:
                    fs.create_dir(f"{root}/{folder}")
                    made.add(folder)
                with fs.open_output_stream(beside) as out:
                    out.write(html.encode())
                try:
                    fs.move(beside, f"{root}/{folder}/{name}")
                except OSError:
                    # Some file systems rename onto no file; what is there has the same content.
                    if fs.get_file_info(f"{root}/{folder}/{name}").type != types.FileType.File:
                        raise
                    fs.delete_file(beside)
                files += 1
        return Written(files)

    def _clear(self):  # noqa: ANN202
        from pyarrow import fs as types

        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/_writing").type == types.FileType.Directory:
            fs.delete_dir(f"{root}/_writing")
        return fs, root

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._clear()
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class HtmlFiles(DataSource):
    """Sink for rows of (folder, name, html)."""

    @classmethod
    def name(cls) -> str:
        return "html_files"

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(self.options["path"])


def named(pages: DataFrame, folders: dict[str, str] | None = None) -> DataFrame:
    """folder, name, html of (label, host, html)."""
    of = F.create_map(*[F.lit(x) for kv in (folders or FOLDERS).items() for x in kv])
    host = F.lower(F.left(F.regexp_replace(slug(F.coalesce("host", F.lit(""))), "^_+|_+$", ""), F.lit(HOST)))
    name = F.concat(F.when(host == "", "page").otherwise(host), F.lit("_"), F.left(F.sha2("html", 256), F.lit(DIGITS)), F.lit(".html"))
    return pages.select(of[F.col("label")].alias("folder"), name.alias("name"), "html").where("folder is not null and html <> ''")


def export_html(pages: DataFrame, path: str, per_label: int | None = None, seed: str = "export", folders: dict[str, str] | None = None) -> None:
    """One file for each page of (label, host, html); with per_label, a uniform sample of so many files for each folder, equal in every run."""
    rows = named(pages, folders)
    if per_label is not None:
        rows = sample(rows.dropDuplicates(["folder", "name"]), per_label, seed, "name", "folder")
    pages.sparkSession.dataSource.register(HtmlFiles)
    rows.write.format("html_files").option("path", path).mode("append").save()
