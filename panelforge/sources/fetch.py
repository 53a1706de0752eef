"""Asking a service for many cells, a lane at a time, so that a run that was stopped goes on where it ended."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.tables import stored

#: Answers that are worth another try, and the longest wait between two in seconds.
AGAIN, LONGEST_WAIT = (429, 500, 502, 503, 504), 300.0
ANSWER = "cell string, lat double, lon double, status string, body string"


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(ANSWER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def missing(cells: DataFrame, cache: str) -> DataFrame:
    """The cells (cell, lat, lon) that the cache has no answer of, each once. Without a cache, all of them."""
    cells = cells.where("cell IS NOT NULL").dropDuplicates(["cell"])
    known = _rows(cells.sparkSession, cache)
    return cells if known is None else cells.join(known.select("cell"), "cell", "left_anti")


def adopt(spark: SparkSession, cache: str) -> None:
    """Puts the answers of runs that were stopped before their end into the cache, and removes these runs' folders."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}.run-*")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(pattern) or []:
        path = found.getPath()
        rows = _rows(spark, path.toString()) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")) else None
        if rows is not None:
            missing(rows.where("status = 'done'"), cache).select(rows.columns).write.mode("append").parquet(cache)
        system.delete(path, True)


def asked(cells: DataFrame, ask: Callable, lanes: int, pause: float, refusals: int = 5, attempts: int = 8) -> DataFrame:
    """cell, lat, lon, status and body by ask(lat, lon) -> (code, seconds to wait or None, body).

    A lane is one task that pauses before each call, so the service sees at most lanes / pause
    calls a second. After so many 429 answers to one cell the lane's circuit opens: that cell
    and the lane's rest are 'paused', for a later run. Other codes, and cells that never get
    an answer, are 'failed'; a failed cell doesn't stop the others.
    """

    def one(lat: float, lon: float) -> tuple[str, str | None]:
        refused = 0
        for attempt in range(attempts):
            time.sleep(pause)
            try:
                code, wait, body = ask(lat, lon)
            except OSError:
                code, wait, body = 503, None, None
            if code == 200:
                return "done", body
            if code not in AGAIN:
                return "failed", None
            refused += code == 429
            if refused >= refusals:
                return "paused", None
            time.sleep(min(LONGEST_WAIT, pause * 2**attempt if wait is None else wait))
        return "failed", None

    def run(frames: Iterator) -> Iterator:
        open_ = False
        for rows in frames:
            status, bodies = [], []
            for lat, lon in zip(rows["lat"], rows["lon"], strict=True):
                s, body = ("paused", None) if open_ else one(lat, lon)
                open_ = open_ or s == "paused"
                status.append(s)
                bodies.append(body)
            yield rows.assign(status=status, body=bodies)[["cell", "lat", "lon", "status", "body"]]

    return cells.select("cell", "lat", "lon").repartition(lanes).mapInPandas(run, ANSWER)


def resumed(cells: DataFrame, cache: str, ask: Callable, lanes: int = 1, pause: float = 12.0, batch: int = 200, **limits: int) -> dict[str, int]:
    """Asks for what the cache lacks and adds the answers to it; how many cells have each status, cached ones too.

    Cells go in rounds of about batch a lane. A round's answers are written before they go to the
    cache, and what a stopped run has written is taken up first, so a stop loses one round at
    most. Once a lane's circuit has opened, the cells of later rounds are paused. Speculative
    copies of tasks would ask twice, so they are refused; a task that is tried again asks anew.
    """
    spark = cells.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("spark.speculation would ask for cells twice")
    adopt(spark, cache)
    todo = stored(missing(cells, cache).select("cell", "lat", "lon"), "cells")
    n = todo.count()
    rounds = max(1, -(-n // (lanes * batch)))
    counts: dict[str, int] = {}
    for i in range(rounds):
        run = f"{cache}.run-{time.time_ns()}"
        part = todo.where(F.pmod(F.xxhash64("cell"), F.lit(rounds)) == i)
        asked(part, ask, lanes, pause, **limits).write.parquet(run)
        for r in spark.read.schema(ANSWER).parquet(run).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a status
            counts[r["status"]] = counts.get(r["status"], 0) + r["n"]
        adopt(spark, cache)
        if counts.get("paused"):
            counts["paused"] += n - sum(counts.values())
            break
    counts["cached"] = cells.where("cell IS NOT NULL").select("cell").distinct().count() - sum(counts.values())
    return counts
