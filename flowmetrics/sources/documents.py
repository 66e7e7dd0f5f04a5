"""The report as documents, one per sheet: a Python data source whose files count only once the driver commits them.

Rows arrive ordered by sheet and line. A task writes one file per sheet of its range, under a name of its own attempt, and
reports a constant amount to the driver: its first and last sheet, and how many lines of them it has. The commit adds up
where every task's first sheet goes on, writes that list, and then puts the new list in the old one's place, so readers see
either the report before or the whole new one. Files of attempts that failed or ran twice are on no list and are never read; an
aborted write removes those it knows of. A sheet of very many lines is written, and read, by several tasks.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

LIST = "_commit.json"
LINES = "hoja string, fila bigint, bloque string, contenido string"


def opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its list of files, lines of its first and its last sheet, and whether those are the same."""

    partition: int
    listed: str
    first: str | None
    first_lines: int
    last: str | None
    last_lines: int


class DocumentsWriter(DataSourceWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, rows: Iterator) -> Written:
        files, root = opened(self.path)
        task = TaskContext.get()
        own = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        parts, stream = [], None
        for row in rows:
            if not parts or parts[-1]["hoja"] != row["hoja"]:
                if stream:
                    stream.close()
                folder = f"{root}/{self.run}/{quote(row['hoja'], safe='')}"
                files.create_dir(folder, recursive=True)
                parts.append({"hoja": row["hoja"], "archivo": f"{folder}/{own}.jsonl", "filas": 0})
                stream = files.open_output_stream(parts[-1]["archivo"])
            stream.write((json.dumps([row["bloque"], row["contenido"]], ensure_ascii=False) + "\n").encode())
            parts[-1]["filas"] += 1
        if stream:
            stream.close()
        files.create_dir(f"{root}/{self.run}/_tasks", recursive=True)
        listed = f"{self.run}/_tasks/{own}.json"
        with files.open_output_stream(f"{root}/{listed}") as out:
            out.write(json.dumps([p | {"archivo": p["archivo"].removeprefix(f"{root}/")} for p in parts]).encode())
        ends = [parts[i] if parts else {"hoja": None, "filas": 0} for i in (0, -1)]
        return Written(task.partitionId(), listed, ends[0]["hoja"], ends[0]["filas"], ends[1]["hoja"], ends[1]["filas"])

    def commit(self, messages: list) -> None:
        tasks, sheet, lines = [], None, 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            if m.first is None:
                continue
            before = lines if m.first == sheet else 0
            tasks.append({"lista": m.listed, "desde": before})
            sheet, lines = m.last, m.last_lines + (before if m.first == m.last else 0)
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        temporary = f"{root}/{self.run}.json"
        with files.open_output_stream(temporary) as out:
            out.write(json.dumps(tasks).encode())
        files.move(temporary, f"{root}/{LIST}")

    def abort(self, messages: list) -> None:
        files, root = opened(self.path)
        for m in messages:
            if m is not None:
                with files.open_input_stream(f"{root}/{m.listed}") as stream:
                    parts = json.loads(stream.read())
                for name in [*[p["archivo"] for p in parts], m.listed]:
                    files.delete_file(f"{root}/{name}")


@dataclass
class TaskFiles(InputPartition):
    listed: str
    start: int


class DocumentsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        with files.open_input_stream(f"{root}/{LIST}") as stream:
            return [TaskFiles(t["lista"], t["desde"]) for t in json.loads(stream.read())] or [TaskFiles("", 0)]

    def read(self, partition: TaskFiles) -> Iterator[tuple]:
        if not partition.listed:
            return
        files, root = opened(self.path)
        with files.open_input_stream(f"{root}/{partition.listed}") as stream:
            parts = json.loads(stream.read())
        start = partition.start
        for part in parts:
            number = start
            with files.open_input_stream(f"{root}/{part['archivo']}") as stream:
                for line in iter(_lines(stream)):
                    number += 1
                    block, content = json.loads(line)
                    yield part["hoja"], number, block, content
            start = 0


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(1 << 20):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole


class ReportDocuments(DataSource):
    """Lines ``(hoja, fila, bloque, contenido)``: sheet, place in it from 1, block, and the row as JSON."""

    @classmethod
    def name(cls) -> str:
        return "report_documents"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return DocumentsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentsWriter(self.options["path"], f"run-{uuid.uuid4().hex}")


def _register(spark: SparkSession) -> None:
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(ReportDocuments)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def write_report_documents(campaigns: DataFrame, clients: DataFrame, out: str) -> None:
    """Write both display tables of :func:`lifecycle.report_tables` as one document a sheet: the client's row, then its
    campaigns, newest first (without a date last; equal dates by name). ``out``: a folder; a report there is replaced."""
    _register(clients.sparkSession)

    def lines(table: DataFrame, block: str, at: int, date, name) -> DataFrame:
        content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns if c not in ("hoja", "orden_fecha")]), {"ignoreNullFields": "false"})
        return table.select("hoja", F.lit(at).alias("_at"), date.alias("_date"), name.alias("_name"), F.lit(block).alias("bloque"), content.alias("contenido"))

    whole = lines(clients, "cliente", 0, F.lit(None).cast("timestamp"), F.lit(None).cast("string")).unionByName(
        lines(campaigns, "campaña", 1, F.col("orden_fecha").cast("timestamp"), F.col("Campaña").cast("string"))
    )
    ordered = whole.orderBy("hoja", "_at", F.desc_nulls_last("_date"), "_name", "contenido")
    ordered.select("hoja", F.lit(None).cast("bigint").alias("fila"), "bloque", "contenido").write.format("report_documents").mode("overwrite").option("path", out).save()


def read_report_documents(spark: SparkSession, path: str) -> DataFrame:
    """The committed report below ``path`` as lines ``(hoja, fila, bloque, contenido)``."""
    _register(spark)
    return spark.read.format("report_documents").option("path", path).load()
