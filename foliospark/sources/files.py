"""A file for each document, written and read by the executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import ship
from ..shared import shuffle_width

NAME = "foliospark_files"
_STAGING = "_staging"


def _open(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its folder and how many files it holds, never their names."""

    folder: str
    files: int


@dataclass
class Folder(InputPartition):
    name: str

    def __init__(self, name: str):
        self.name = name


class FileWriter(DataSourceWriter):
    """Each task writes its rows' files into a folder of its own under ``_staging``; the commit moves the
    folders of the tasks that succeeded, an abort removes the staging.  So what a lost or repeated task left is
    never seen."""

    def __init__(self, path: str, ending: str, overwrite: bool):
        self.path, self.ending, self.overwrite = path.rstrip("/"), ending, overwrite
        self.job = uuid.uuid4().hex

    def _staged(self) -> str:
        return f"{self.path}/{_STAGING}-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        folder = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        system, at = _open(f"{self._staged()}/{folder}")
        system.create_dir(at, recursive=True)
        taken: dict[str, int] = {}
        files = 0
        for row in iterator:
            name = quote(str(row[0]), safe="") if row[0] is not None else "%"
            taken[name] = again = taken.get(name, 0) + 1
            with system.open_output_stream(f"{at}/{name}{f'%~{again}' if again > 1 else ''}{self.ending}") as f:
                f.write((row[1] or "").encode())
            files += 1
        return Written(folder, files)

    def commit(self, messages: list) -> None:
        system, at = _open(self.path)
        if self.overwrite:
            for name in _folders(self.path):
                system.delete_dir(f"{at}/{name}")
        for m in messages:
            if m is not None and m.files:
                system.move(f"{at}/{_STAGING}-{self.job}/{m.folder}", f"{at}/{m.folder}")
        self.abort(messages)
        with system.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        system, at = _open(self._staged())
        try:
            system.delete_dir(at)
        except FileNotFoundError:
            pass


def _folders(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _open(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("part-"))


class FileReader(DataSourceReader):
    """Reads what ``FileWriter`` wrote, a task a folder."""

    def __init__(self, path: str, ending: str):
        self.path, self.ending = path.rstrip("/"), ending

    def partitions(self) -> list[Folder]:
        return [Folder(name) for name in _folders(self.path)] or [Folder("")]

    def read(self, partition: Folder) -> Iterator[tuple[str | None, str]]:
        from pyarrow import fs

        if not partition.name:
            return
        system, at = _open(f"{self.path}/{partition.name}")
        for f in system.get_file_info(fs.FileSelector(at)):
            if f.base_name.endswith(self.ending):
                name = f.base_name.removesuffix(self.ending).split("%~")[0]
                with system.open_input_stream(f.path) as data:
                    yield (None if name == "%" else unquote(name)), data.read().decode()


class Files(DataSource):
    """``id string, content string``; options ``path`` and ``ending``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "id string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("ending", ".md"), overwrite)

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"], self.options.get("ending", ".md"))


def write_files(contents: DataFrame, path: str, ending: str = ".md") -> None:
    """Write a file for each row of ``id, content``, in place of those that ``path`` had.

    Files lie in a folder per task, named by their ids with anything unusual escaped; null contents are
    empty files, and rows with an equal id, which meet in one task, get numbered names.  ``path`` must be where all executors
    can write.  Nothing of a text goes to the driver.
    """
    spark = contents.sparkSession
    ship(spark)
    spark.dataSource.register(Files)
    rows = contents.selectExpr("cast(id AS string) AS id", "cast(content AS string) AS content").repartition(shuffle_width(spark), "id")
    rows.write.format(NAME).option("ending", ending).mode("overwrite").save(path)


def read_files(spark: SparkSession, path: str, ending: str = ".md") -> DataFrame:
    """``id, content`` of the files that ``write_files`` wrote."""
    ship(spark)
    spark.dataSource.register(Files)
    return spark.read.format(NAME).option("ending", ending).load(path)
