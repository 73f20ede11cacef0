"""Archives read by their members: listed in tasks, dealt out in lots, and each lot read by the task that has it.

The scan names the archives without reading them. A task opens those it has by ranges and lists their members (a zip's
directory; a tar's headers, skipping what lies between), in lots of LOT_BYTES; lots are dealt over tasks, so that one
archive of many members is read by many. A compressed tar can only be read from its start: it is one lot, read as a
stream, a member at a time. No archive is held in memory. Members over `most_bytes` and archives that cannot be read are
rows with an error; what was read of an archive before stays.
"""

from __future__ import annotations

import fnmatch
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import MAX_BYTES, SYSTEM_FILES

#: Bytes of members that one lot holds, unless one member has more.
LOT_BYTES = 32 * 1024 * 1024
_LOTS = "path string, members array<struct<name:string,at:long,size:long>>, bytes long, error string"
_ROWS = "path string, member string, size long, content binary, error string"


def opened(path: str):
    """A file, by ranges, of any file system that Arrow knows; a path without a scheme is a local one."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}")
    return system.open_input_file(inner)


def _wanted(name: str, patterns: list[str]) -> bool:
    return not re.search(SYSTEM_FILES, name) and ".." not in name.split("/") and any(fnmatch.fnmatch(name, p) for p in patterns)


def _packed(path: str) -> bool:
    return bool(re.search(r"\.(t?gz|tgz|bz2|xz)$", path))


def _listed(path: str, patterns: list[str]) -> Iterator[tuple[str, int, int]]:
    """(name, place, size) of an archive's members; at what byte a tar's member begins, a zip's by name alone."""
    if _packed(path):
        yield "*", -1, 0
        return
    with opened(path) as f:
        if zipfile.is_zipfile(f):
            f.seek(0)
            with zipfile.ZipFile(f) as z:
                yield from ((i.filename, -1, i.file_size) for i in z.infolist() if not i.is_dir() and _wanted(i.filename, patterns))
        else:
            f.seek(0)
            with tarfile.open(fileobj=f, mode="r:") as t:
                for i in t:
                    t.members = []  # else it remembers all
                    if i.isfile() and _wanted(i.name, patterns):
                        yield i.name, i.offset_data, i.size


def lots(archives: DataFrame, patterns: list[str], lot_bytes: int = LOT_BYTES) -> DataFrame:
    """archives (path) as lots of members: path, members, bytes, error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path in f["path"]:
                held, size = [], 0
                try:
                    for name, at, n in _listed(path, patterns):
                        if held and size + n > lot_bytes:
                            rows.append((path, held, size, None))
                            held, size = [], 0
                        held.append({"name": name, "at": at, "size": n})
                        size += n
                except Exception as e:  # noqa: BLE001  reported in the row
                    rows.append((path, [], 0, f"{type(e).__name__}: {e}"))
                if held:
                    rows.append((path, held, size, None))
            yield pd.DataFrame(rows, columns=["path", "members", "bytes", "error"])

    return archives.select("path").mapInPandas(run, _LOTS)


def _read(path: str, wanted: list[dict], patterns: list[str], most_bytes: int) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    with opened(path) as f:
        if wanted and wanted[0]["name"] == "*":
            with tarfile.open(fileobj=f, mode="r|*") as t:
                for i in t:
                    t.members = []
                    if i.isfile() and _wanted(i.name, patterns):
                        yield (i.name, i.size, t.extractfile(i).read(), None) if i.size <= most_bytes else (i.name, i.size, None, "member exceeds its limit")
            return
        z = zipfile.ZipFile(f) if wanted and wanted[0]["at"] < 0 else None
        for x in wanted:
            if x["size"] > most_bytes:
                yield x["name"], x["size"], None, "member exceeds its limit"
            elif z:
                yield x["name"], x["size"], z.read(x["name"]), None
            else:
                f.seek(x["at"])
                yield x["name"], x["size"], f.read(x["size"]), None


def members(spark: SparkSession, path: str, patterns: list[str] | None = None, pattern: str = "*", lot_bytes: int = LOT_BYTES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """path, member, size, content, error of the archives below path whose names fit pattern; patterns: which members (all)."""
    wanted = patterns or ["*"]
    archives = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    dealt = lots(archives, wanted, lot_bytes)
    # Names and sizes alone. A task has LOT_BYTES or so, as one lot or several; what a compressed tar holds is not known.
    told = dealt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bytes") > 0, F.col("bytes")).otherwise(LOT_BYTES)).alias("bytes")).first()
    tasks = min(told["n"], max(4 * spark.sparkContext.defaultParallelism, (told["bytes"] or 0) // LOT_BYTES + 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, held, error in zip(f["path"], f["members"], f["error"], strict=True):
                if error:
                    yield pd.DataFrame([(where, None, None, None, error)], columns=["path", "member", "size", "content", "error"])
                    continue
                rows, size = [], 0
                try:
                    for name, k, content, wrong in _read(where, list(held), wanted, most_bytes):
                        rows.append((where, name, k, content, wrong))
                        size += k
                        if size > LOT_BYTES:  # of a stream, so much at a time
                            yield _frame(rows)
                            rows, size = [], 0
                except Exception as e:  # noqa: BLE001  reported in the row
                    rows.append((where, None, None, None, f"{type(e).__name__}: {e}"))
                yield _frame(rows)

    return dealt.repartition(max(1, min(tasks, 100_000))).mapInPandas(run, _ROWS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "member", "size", "content", "error"], dtype=object).astype({"size": "Int64"})


def texts(found: DataFrame) -> DataFrame:
    """path, member, size, text, error of members(): each member's text by its kind's parser."""
    from .files import PARSERS, _kind_of_name

    parsers = dict(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, member, size, content, error in zip(f["path"], f["member"], f["size"], f["content"], f["error"], strict=True):
                text, kind = None, _kind_of_name(member) if member else None
                if error is None and kind not in parsers:
                    error = f"no parser for {member}"
                elif error is None:
                    try:
                        text = "\n".join(t for _, t in parsers[kind](member, content))
                    except Exception as e:  # noqa: BLE001  reported in the row
                        error = f"{type(e).__name__}: {e}"
                rows.append((path, member, size, text, error))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "text", "error"], dtype=object).astype({"size": "Int64"})

    return found.select("path", "member", "size", "content", "error").mapInPandas(run, "path string, member string, size long, text string, error string")
