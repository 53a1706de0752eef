"""GeoJSON as a Spark sink: format("polygons") writes a folder of feature collections, one a task.

Tasks write under a hidden folder of the job; committing moves their files into place, and
aborting removes them, so a job that fails leaves nothing. Files are written by pyarrow.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from panelforge.sources.archives import opened


class PolygonSink(DataSource):
    """Columns: ring, a closed array of struct<x, y>, and any others, which become properties. Option: path.

    A null ring gives a feature without a geometry. A ring that isn't closed, or has fewer than
    four points, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "polygons"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PolygonWriter(self.options["path"], overwrite)


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    rows: int


class _PolygonWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.hidden = f"{self.path}/.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, hidden = opened(self.hidden)
        name, rows, file = f"part-{uuid.uuid4().hex}.geojson", 0, None
        for row in iterator:
            text = json.dumps(feature(row.asDict(recursive=True)), ensure_ascii=False, default=str)
            if file is None:
                system.create_dir(hidden, recursive=True)
                file = system.open_output_stream(f"{hidden}/{name}")
                file.write(b'{"type": "FeatureCollection", "features": [\n')
            file.write((",\n" if rows else "").encode() + text.encode())
            rows += 1
        if file is not None:
            file.write(b"\n]}\n")
            file.close()
        return _Part(name if rows else None, rows)

    def commit(self, messages: list) -> None:
        system, inner = opened(self.path)
        _, hidden = opened(self.hidden)
        from pyarrow import fs

        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(inner)):
                if old.type == fs.FileType.File:
                    system.delete_file(old.path)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{hidden}/{m.name}", f"{inner}/{m.name}")
        self._clear()
        with system.open_output_stream(f"{inner}/_SUCCESS") as done:
            done.write(b"")

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes the hidden folder with what tasks that were tried again have left."""
        system, hidden = opened(self.hidden)
        from pyarrow import fs

        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


def feature(row: dict) -> dict:
    ring = row.pop("ring")
    geometry = None
    if ring is not None:
        points = [[p["x"], p["y"]] for p in ring]
        if len(points) < 4 or points[0] != points[-1]:
            raise ValueError(f"not a closed ring: {points[:5]}")
        geometry = {"type": "Polygon", "coordinates": [points]}
    return {"type": "Feature", "properties": row, "geometry": geometry}


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(PolygonSink)
    df.write.format("polygons").option("path", path).mode(mode).save()
