"""Zip archives as a Spark source, and a streaming writer of them.

format("archive") reads an archive's directory by range, at the archive's end, and gives each
member a partition of its own, which reads that member by range and streams it: neither archive
nor member is ever whole in memory, and a lost task reads one member again. Files are opened by
pyarrow, so archives lie where pyarrow can open them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE, ROWS = 1 << 20, 5_000
#: Archives whose directories are read at once.
THREADS = 16


def opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:", uri) else (fs.LocalFileSystem(), uri)


def _archives(path: str, pattern: str) -> list[str]:
    from fnmatch import fnmatch

    from pyarrow import fs

    system, inner = opened(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = path[: path.index(":") + 1] if re.match(r"[a-z0-9]+:", path) else ""
    return [f"{scheme}{f.path}" for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)]


def _directory(uri: str) -> list:
    import zipfile

    system, inner = opened(uri)
    with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
        return [i for i in archive.infolist() if not i.is_dir()]


def _encoding(raw) -> str:
    """UTF-8, with or without a mark, if all of the member is; else Latin-1. Reading to the end also tests the checksum."""
    import codecs

    decoder, code = codecs.getincrementaldecoder("utf-8")(), "utf-8-sig"
    try:
        while part := raw.read(PIECE):
            if code == "utf-8-sig":
                try:
                    decoder.decode(part)
                except UnicodeDecodeError:
                    code = "latin-1"
        decoder.decode(b"", code == "utf-8-sig")
    except UnicodeDecodeError:
        code = "latin-1"
    return code


class ArchiveSource(DataSource):
    """Options: path; pattern of archive names (*.zip); members, a regular expression that a member's name must hold
    (\\.csv$, without regard to case); delimiter; directory: true for a row a member and none of its lines.

    A member that can't be read to its end gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, modified timestamp_ntz, size long, line long, fields map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*.zip")
        self.members, self.delimiter = options.get("members", r"\.csv$"), options.get("delimiter", ",")
        self.only_directory = options.get("directory", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        archives = _archives(self.path, self.pattern)
        if self.only_directory:
            return [InputPartition((a, None)) for a in archives] or [InputPartition(None)]
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(THREADS) as pool:
            found = zip(archives, pool.map(self._wanted, archives), strict=True)
            return [InputPartition((a, i.filename)) for a, some in found for i in some] or [InputPartition(None)]

    def _wanted(self, uri: str) -> list:
        return [i for i in _directory(uri) if re.search(self.members, i.filename, re.IGNORECASE)]

    def read(self, partition: InputPartition) -> Iterator:
        if partition.value is None:
            return
        uri, member = partition.value
        name = uri.rsplit("/", 1)[-1]
        if self.only_directory:
            for i in self._wanted(uri):
                yield (name, i.filename, _time(i), i.file_size, None, None)
        else:
            yield from self._lines(uri, name, member)

    def _lines(self, uri: str, name: str, member: str) -> Iterator:
        import csv
        import io
        import zipfile
        import zlib

        system, inner = opened(uri)
        with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
            info = archive.getinfo(member)
            try:
                with archive.open(info) as raw:
                    code = _encoding(raw)
            except (zipfile.BadZipFile, OSError, zlib.error):
                return
            time = _time(info)
            with archive.open(info) as raw:
                for n, row in enumerate(csv.DictReader(io.TextIOWrapper(raw, code, newline=""), delimiter=self.delimiter)):
                    yield (name, member, time, info.file_size, n, {(k or "").strip(): v for k, v in row.items() if isinstance(v, str)})


def _time(info):
    import datetime

    try:
        return datetime.datetime(*info.date_time)
    except ValueError:  # a month or day of 0, which some writers leave
        return None


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(path=path, **options).load()


def export_ends(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """archive and p, the month ordinal in which it was exported: that of its latest CSV member. Only directories are read."""
    last = read(spark, path, pattern=pattern, directory="true").groupBy("archive").agg(F.max("modified").alias("last"))
    return last.select("archive", (F.year("last") * 12 + F.month("last")).alias("p"))


def capped(observed: DataFrame, ends: DataFrame, key: str = "archive") -> DataFrame:
    """observed (with key and p) up to the month before its archive's export, which is the last whole one."""
    return observed.join(ends.select(key, F.col("p").alias("_end")), key).where(F.col("p") < F.col("_end")).drop("_end")


def station_members(codes: list[str]) -> str:
    """The members option for the CSVs of some stations of a network, by the code between underscores."""
    return f"_({'|'.join(map(re.escape, sorted(codes)))})_.*\\.csv$" if codes else "(?!)"


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Zip archives of rows (archive, member, modified, line, value): a text a member, lines in order; gives archive and members.

    A task writes one archive after another, line by line, under another name until it is whole,
    so a task that is tried again replaces what it wrote.
    """
    ordered = rows.select("archive", "member", "modified", "line", "value").repartition("archive").sortWithinPartitions("archive", "member", "line")

    def run(batches):
        import uuid
        import zipfile

        import pandas as pd

        now = file = archive = member = None
        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        counts: dict[str, int] = {}

        def closed():
            if archive is not None:
                member.close()
                archive.close()
                file.close()
                system.move(part, f"{inner}/{now[0]}")

        for b in batches:
            for r in b.itertuples(index=False):
                if now is None or r.archive != now[0]:
                    closed()
                    part = f"{inner}/.{r.archive}-{uuid.uuid4().hex}"
                    file = system.open_output_stream(part)
                    archive, now, member = zipfile.ZipFile(_Counted(file), "w", zipfile.ZIP_DEFLATED), (r.archive, None), None
                    counts[r.archive] = 0
                if r.member != now[1]:
                    if member is not None:
                        member.close()
                    member = archive.open(zipfile.ZipInfo(r.member, r.modified.timetuple()[:6]), "w", force_zip64=True)
                    now = (r.archive, r.member)
                    counts[r.archive] += 1
                member.write(f"{r.value}\n".encode())
        closed()
        yield pd.DataFrame({"archive": list(counts), "members": list(counts.values())})

    return ordered.mapInPandas(run, "archive string, members long")


class _Counted:
    """An output stream that can't be sought, which zipfile then writes to from front to end."""

    def __init__(self, file):
        self.write, self.flush = file.write, file.flush
