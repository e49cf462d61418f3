"""Archives of articles of any size: a tar is read in ranges by many tasks, a compressed one as a stream.

A first pass walks the headers of each plain archive, seeking over what lies between, and emits the
ranges that a second pass reads: a few numbers for each RANGE_BYTES.  A task holds one range's current
member and a batch of texts, never an archive.
"""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import stored

TAR = r"(?i)\.(?:tar(?:\.[a-z0-9]+)?|t[gbx]z2?)$"
XML = re.compile(r"\.n?xml$", re.IGNORECASE)
_XML_FILES = "*.{[xX][mM][lL],[nN][xX][mM][lL]}"  # a path filter has no flags
#: Members are read in ranges of about so many bytes.
RANGE_BYTES = 64 << 20
#: Texts leave a task in batches of about so many characters.
BATCH_CHARS = 4_000_000
FILE = "path string, member long, text string"
# ``stop`` is null for archives that can only be read from their start
_RANGE = "archive string, start long, stop long, member long, headers map<string,string>"
_PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00")  # fixed values: how gzip, bzip2 and xz files begin


def opened(path: str, write: bool = False):
    """The file at a path as Spark names it: open for reading at any place, or for writing, with its folder."""
    found = re.fullmatch(r"(?s)([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)/(.*)", path)
    if found is None or found[1] == "file":
        system, own = afs.LocalFileSystem(), "/" + re.sub("^(?:file:)?/+", "", path)
    else:
        scheme, host, rest = found.groups()
        system, base = afs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}/")
        own = f"{base.rstrip('/')}/{rest}"
    if not write:
        return system.open_input_file(own)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    return system.open_output_stream(own, compression=None)  # by default the name would decide


class _Header(tarfile.TarInfo):
    """A header that is damaged or cut is an error wherever it stands, not the end of the archive."""

    @classmethod
    def fromtarfile(cls, tar):
        try:
            return super().fromtarfile(tar)
        except (tarfile.InvalidHeaderError, tarfile.TruncatedHeaderError) as e:
            raise tarfile.ReadError(f"a damaged archive, at byte {tar.offset}: {e}") from e


def _members(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The members one after the other, none of them kept."""
    while (member := tar.next()) is not None:
        tar.members.clear()
        yield member


def _wanted(member: tarfile.TarInfo) -> bool:
    return member.isfile() and XML.search(member.name) is not None


def archive_ranges(archive: str, range_bytes: int) -> Iterator[tuple]:
    """Rows of _RANGE: each begins at a member, knows how many articles are before it, and the headers that hold for all."""
    with opened(archive) as file:
        packed = file.read(6).startswith(_PACKED)
        file.seek(0)
        if packed:
            yield archive, 0, None, 0, {}
            return
        with tarfile.open(fileobj=file, mode="r:", tarinfo=_Header) as tar:
            start, before, count, headers, had = 0, 0, 0, {}, False
            for member in _members(tar):
                if member.offset - start >= range_bytes and had:
                    yield archive, start, member.offset, before, headers
                    start, before, headers, had = member.offset, count, dict(tar.pax_headers), False
                count += _wanted(member)
                had = had or _wanted(member)
            if had:
                yield archive, start, tar.offset, before, headers


def range_texts(archive: str, start: int, stop: int | None, member: int, headers: dict[str, str]) -> Iterator[tuple[str, int, str]]:
    """(path, member, text) of the articles of one range."""
    with opened(archive) as file:
        file.seek(start)
        tar = tarfile.open(fileobj=file, mode="r|*", tarinfo=_Header) if stop is None else tarfile.open(fileobj=file, mode="r:", pax_headers=headers, tarinfo=_Header)
        with tar:
            for own in _members(tar):
                if stop is not None and own.offset >= stop:
                    return
                if _wanted(own):
                    yield f"{archive}!{own.name}", member, tar.extractfile(own).read().decode("utf-8", "replace")
                    member += 1


def _batches(rows: Iterator[tuple[str, int, str]]) -> Iterator[pd.DataFrame]:
    columns, held, size = ["path", "member", "text"], [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > BATCH_CHARS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    yield pd.DataFrame(held, columns=columns)


def archive_files(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, member, text) of the article files of archives (path); bad UTF-8 is replaced.

    ``member`` numbers the articles of an archive from 0 and ``path`` is archive!name.  Archives that
    are compressed (gzip, bzip2, xz) have no places to begin at: one task streams each.  A damaged
    or cut archive is an error.  The ranges are dealt to all tasks, so the walk over headers is the
    only work that one task does for a whole archive; it reads headers alone.
    """
    spark = archives.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _RANGE.split(", ")]
        for frame in frames:
            for path in frame["path"]:
                held = []
                for row in archive_ranges(path, range_bytes):
                    held.append(row)
                    if len(held) == 10_000:
                        yield _ranges(held, columns)
                        held = []
                yield _ranges(held, columns)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, start, stop, member, headers in frame.itertuples(index=False):
                yield from _batches(range_texts(archive, start, None if pd.isna(stop) else int(stop), member, dict(headers or {})))

    ranges = archives.select("path").repartition(partitions, "path").mapInPandas(walk, _RANGE)
    return ranges.repartition(partitions, "archive", "start").mapInPandas(read, FILE)


def write_archives(files: DataFrame, folder: str, packed: bool = False) -> DataFrame:
    """Writes files (path, text) to tar archives in ``folder``, one a task, and returns the stored list of archives (path).

    A task that runs twice leaves two archives; only the one of the run that counted is in the list.
    Null texts are empty files.  Nothing larger than a text is held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/{uuid.uuid4().hex}.tar{'.gz' if packed else ''}"
        with opened(path, write=True) as file, tarfile.open(fileobj=file, mode="w|gz" if packed else "w|") as tar:
            for frame in frames:
                for name, text in zip(frame["path"], frame["text"], strict=True):
                    body = (text or "").encode()
                    header = tarfile.TarInfo(name)
                    header.size = len(body)
                    tar.addfile(header, io.BytesIO(body))
        yield pd.DataFrame({"path": [path]})

    return stored(files.select("path", "text").mapInPandas(run, "path string"), "archives")


def _ranges(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"stop": "Int64"})


def listed(spark: SparkSession, paths: str | list[str], files: str | None = None) -> DataFrame:
    """(path, length, content) of the files below ``paths``, but for empty ones, which Spark does not list; no content is read unless it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", files) if files else reader).load(paths)


def article_files(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, member, text) of all article files below ``paths``, in folders and in archives; a file of its own is member 0."""
    alone = listed(spark, paths, _XML_FILES).select("path", F.lit(0).cast("long").alias("member"), "content").mapInPandas(_alone, FILE)
    tars = listed(spark, paths).where(F.col("path").rlike(TAR)).select("path")
    return alone.unionByName(archive_files(tars, range_bytes))


def _alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(text=[c.decode("utf-8", "replace") for c in frame["content"]])[["path", "member", "text"]]


def checksums(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, file, bytes, sha256) of the files at ``paths``, of any size: each is read in pieces, by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = []
            for path in frame["path"]:
                sha = hashlib.sha256()
                with opened(path) as file:
                    while piece := file.read(8 << 20):
                        sha.update(piece)
                sums.append(sha.hexdigest())
            yield frame.assign(sha256=sums)

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = listed(spark, paths, pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    return rows.repartition(spread, "path").mapInPandas(run, "path string, file string, bytes long, sha256 string")
