"""Sets of CSV extracts that appear together or not at all.

A set is written to a folder of its own and then named in a manifest, whose replacement
is one rename. Readers go by the manifest, so they see the old set until the new one
is whole, and go on seeing it when a write fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_MANIFEST.json"
#: Extracts that are written at the same time, and sets that stay on disk.
AT_ONCE, KEPT = 4, 2
_IN_PARTITION = (1 << 33) - 1


@dataclass(frozen=True)
class Extract:
    """A table and the header lines above its rows (default: its column names)."""

    rows: DataFrame
    header: Sequence[Sequence[str]] = field(default_factory=tuple)

    @property
    def lines(self) -> list[list[str]]:
        return [list(line) for line in self.header] or [list(self.rows.columns)]


def _cell(text: str) -> str:
    quoted = any(c in text for c in ',"\n\r')
    return '"' + text.replace('"', '""') + '"' if quoted else text


def write_lines(extract: Extract, path: str) -> None:
    """CSV files under ``path``, one for each task, each with all header lines.

    Cells with a comma, a quote or a line break are quoted, and quotes doubled. NULL is
    an empty cell. A table without rows gives one file with the header alone.
    """
    rows = extract.rows
    header = "\n".join(",".join(_cell(c) for c in line) for line in extract.lines)
    cells = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(rows.columns)]
    csv = F.to_csv(F.struct(*cells), {"quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)) == 0
    lines = rows.select(F.when(first, F.concat(F.lit(header + "\n"), csv)).otherwise(csv).alias("value"))
    lines.write.text(path)
    spark = rows.sparkSession
    if spark.read.text(path).isEmpty():
        spark.range(1).coalesce(1).select(F.lit(header).alias("value")).write.mode("overwrite").text(path)


class Folder:
    """Files of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path
        self.store = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        if not self.store.exists(self._at(name)):
            return None
        stream = self.store.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The file ``name`` with a new text, by one rename over the old one."""
        part = f".{name}.{uuid.uuid4().hex}"
        stream = self.store.create(self._at(part))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options
        over = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.OVERWRITE.getClass(), 1)
        over[0] = options.Rename.OVERWRITE
        there = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.conf)
        there.rename(self._at(part), self._at(name), over)

    def remove(self, name: str) -> None:
        self.store.delete(self._at(name), True)


def remove_folder(spark: SparkSession, path: str) -> None:
    Folder(spark, path).remove("")


def write_set(spark: SparkSession, path: str, extracts: Mapping[str, Extract]) -> str:
    """All ``extracts`` under ``path`` as one new set; returns its folder.

    The extracts are written several at a time. If one fails, what was written of the
    set goes and the manifest stays as it was. Of earlier sets the last one is kept, for
    readers that are at it.
    """
    place = Folder(spark, path)
    name = f"sets/{uuid.uuid4().hex}"
    try:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            jobs = [
                pool.submit(inheritable_thread_target(spark)(write_lines), one, f"{path}/{name}/{key}")
                for key, one in extracts.items()
            ]
            for job in jobs:
                job.result()
    except BaseException:
        place.remove(name)
        raise
    earlier = json.loads(place.read(MANIFEST) or "{}").get("sets", [])
    headers = {key: one.lines for key, one in extracts.items()}
    place.replace(MANIFEST, json.dumps({"sets": [name, *earlier][:KEPT], "extracts": headers}, ensure_ascii=False))
    for old in earlier[KEPT - 1 :]:
        place.remove(old)
    return f"{path}/{name}"


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of each extract of the current set; none before the first."""
    manifest = json.loads(Folder(spark, path).read(MANIFEST) or "{}")
    return {key: f"{path}/{manifest['sets'][0]}/{key}" for key in manifest.get("extracts", {})}


def read_published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of an extract of the current set, all columns text, named by its first header line.

    Names of several header lines are joined by ``|``; lines of a header are left out.
    """
    manifest = json.loads(Folder(spark, path).read(MANIFEST) or "{}")
    header = manifest["extracts"][name]
    names = ["|".join(part for part in parts if part) for parts in zip(*header, strict=True)]
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    options = {"quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST"}
    rows = spark.read.schema(schema).options(**options).csv(f"{path}/{manifest['sets'][0]}/{name}")
    for line in header:
        same = [F.coalesce(F.col(f"c{i}"), F.lit("")) == c for i, c in enumerate(line)]
        rows = rows.filter(~F.forall(F.array(*same), lambda x: x))
    return rows.toDF(*names)
