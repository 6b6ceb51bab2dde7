"""Source trees and archives as a files table: scan, ignore rules, language, size, lines, text."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rootweave.functions.text import content_key, defines_main, detect_language, line_count

# What is never source code.
IGNORED_SUFFIXES = (
    ".exe", ".dll", ".so", ".dylib", ".a", ".lib", ".o", ".obj", ".class", ".jar", ".bin", ".dat", ".db", ".sqlite", ".sqlite3", ".pyc", ".pyo",
    ".whl", ".zip", ".tar", ".gz", ".xz", ".bz2", ".7z", ".rar", ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".bmp", ".tiff", ".webp",
    ".mp3", ".mp4", ".wav", ".ogg", ".woff", ".woff2", ".ttf", ".eot",
)
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "node_modules",
    "bower_components", "dist", "build", ".next", ".nuxt", ".output", "target", "out", "bin", "obj", ".idea", ".vscode", ".gradle",
)
IGNORED_FILES = (".DS_Store", "Thumbs.db")


def pattern_regex(pattern: str) -> tuple[str, bool]:
    """A gitignore pattern as a regular expression over root-relative paths, and whether it is negated."""
    negated = pattern.startswith("!")
    body = pattern.lstrip("!").replace("\\", "/")
    only_directory, body = body.endswith("/"), body.rstrip("/")
    anchored = "/" in body
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|[^*?\[/]+|/|\[", body.lstrip("/")):
        simple = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        if part in simple:
            out += simple[part]
        elif part.startswith("[") and part.endswith("]"):
            out += part.replace("[!", "[^")
        else:
            out += re.escape(part)
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*" if only_directory else "(?:/.*)?") + "$", negated


def is_ignored(path: Column, patterns: list[str] = ()) -> Column:
    """Fixed tables, then gitignore patterns, of which the last that matches decides."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.element_at(parts, -1)
    suffix = "(?i)(?:" + "|".join(map(re.escape, IGNORED_SUFFIXES)) + ")$"
    fixed = name.isin(*IGNORED_FILES) | name.rlike(suffix) | F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    listed = F.lit(False)
    for regex, negated in map(pattern_regex, patterns):
        listed = F.when(path.rlike(regex), F.lit(not negated)).otherwise(listed)
    return fixed | listed


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 with replacement of malformed bytes."""
    return content.map(lambda b: bytes(b).decode("utf-8", "replace"))


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative, with slashes), size_bytes and content of all files under a folder that Spark can read; dot files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^\w+:/*", "", root).strip("/")
    relative = F.regexp_replace("path", r"^\w+:/*" + re.escape(base) + "/+", "")
    return found.select(relative.alias("path"), F.col("length").alias("size_bytes"), "content")


def ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """Patterns of all .gitignore files of the tree, at root scope; Spark's sources list no dot files."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, texts = system.listFiles(top, True), {}
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName() == ".gitignore":
            stream = system.open(path)
            texts[path.toString()] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
    lines = [line.strip() for name in sorted(texts) for line in texts[name].splitlines()]
    return [line for line in lines if line and not line.startswith("#")]


def scan(spark: SparkSession, root: str, max_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """The files table: path, language, size_bytes, text, lines. `root` is a folder; see `listed` for archives."""
    return listed(raw_files(spark, root), ignore_patterns(spark, root), max_bytes)


def listed(raw: DataFrame, patterns: list[str] = (), max_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """The files table of raw(path, size_bytes, content), without what is ignored."""
    kept = raw.filter(~is_ignored(F.col("path"), patterns))
    total = kept.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    if total > max_bytes:
        raise ValueError(f"the tree holds {total} bytes; the limit is {max_bytes}")
    files = kept.select("path", detect_language(F.col("path")).alias("language"), "size_bytes", decoded("content").alias("text"))
    return files.withColumn("lines", line_count(F.col("text")))


def in_order(files: DataFrame) -> DataFrame:
    """Paths in order; texts do not move."""
    return files.drop("text", "content").orderBy("path")


def _members(archive: str, content: bytes, max_bytes: int) -> pd.DataFrame:
    """Members as the archive's directory lists them, still packed; no member is unpacked here."""
    with zipfile.ZipFile(io.BytesIO(content)) as opened:
        listed = [m for m in opened.infolist() if not m.is_dir()]
    if any(m.filename.startswith("/") or ".." in re.split(r"[\\/]", m.filename) for m in listed):
        raise ValueError(f"{archive} has a member outside its folder")
    if sum(m.file_size for m in listed) > max_bytes:
        raise ValueError(f"{archive} is too large unpacked")
    if any(m.flag_bits & 1 or m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for m in listed):
        raise ValueError(f"{archive} has a member that is encrypted or packed in an unknown way")
    shared = len({m.filename.partition("/")[0] for m in listed}) == 1 and all("/" in m.filename for m in listed)
    rows = []
    for number, m in enumerate(listed):
        # A member's own header has 30 bytes, its name and extra fields, whose lengths stand at 26 and 28.
        name_size, extra_size = struct.unpack_from("<HH", content, m.header_offset + 26)
        start = m.header_offset + 30 + name_size + extra_size
        name = m.filename.partition("/")[2] if shared else m.filename
        rows.append((archive, number, name, m.file_size, m.CRC, m.compress_type == zipfile.ZIP_DEFLATED, content[start : start + m.compress_size]))
    return pd.DataFrame(rows, columns=["archive", "number", "path", "size_bytes", "crc", "deflated", "packed"])


def _unpacked(name: str, size: int, crc: int, deflated: bool, packed: bytes) -> bytes:
    raw = zlib.decompressobj(-zlib.MAX_WBITS).decompress(packed, size + 1) if deflated else bytes(packed)
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise ValueError(f"{name} is damaged")
    return raw


def zipped_files(spark: SparkSession, path: str, max_bytes: int = 200 * 1024 * 1024, parts: int | None = None) -> DataFrame:
    """`members_of` for the archives that a path names."""
    return members_of(spark.read.format("binaryFile").load(path), max_bytes, parts)


#: Members that a task has unpacked at once.
AT_ONCE = 64


def members_of(archives: DataFrame, max_bytes: int = 200 * 1024 * 1024, parts: int | None = None) -> DataFrame:
    """archive, path, size_bytes and content of the members of zip archives(path, length, content); a single top folder is left out.

    A task reads an archive's directory and hands its members on as they are, an archive at a time; they are unpacked after a shuffle by
    member, in `parts` tasks, `AT_ONCE` at a time. An archive that is too large, packed or unpacked, is none, is damaged, encrypted, or has a
    member outside its folder fails the read.
    """

    def directory(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for archive, size, content in zip(frame["path"], frame["length"], frame["content"], strict=True):
            if size > max_bytes:
                raise ValueError(f"{archive} is too large")
            found.append(_members(archive, content, max_bytes))
        return pd.concat(found) if len(found) > 1 else found[0]

    def unpacked(frames):
        for whole in frames:
            for start in range(0, len(whole), AT_ONCE):
                frame = whole.iloc[start : start + AT_ONCE]
                columns = (frame[c] for c in ("path", "size_bytes", "crc", "deflated", "packed"))
                yield frame[["archive", "path", "size_bytes"]].assign(content=[_unpacked(*row) for row in zip(*columns, strict=True)])

    packed = archives.select("path", "length", "content").groupBy("path").applyInPandas(directory, "archive string, number int, path string, size_bytes long, crc long, deflated boolean, packed binary")
    by = ("archive", "number")
    spread = packed.repartition(parts, *by) if parts else packed.repartition(*by)
    return spread.mapInPandas(unpacked, "archive string, path string, size_bytes long, content binary")


def entry_points(files: DataFrame) -> DataFrame:
    """language, path of the program to run: by name, else (compiled) a file that defines main, else the only file."""
    # Entry names by priority.
    names = {"Python": ("__main__.py", "main.py", "app.py", "run.py", "entrypoint.py"), "compiled": ("main.c", "main.cpp", "main.cc", "main.cxx")}
    python = F.col("language") == "Python"
    key = F.when(python, F.col("path")).otherwise(F.lower("path"))
    by_name = F.when(python, F.array_position(F.array(*map(F.lit, names["Python"])), key)).otherwise(F.array_position(F.array(*map(F.lit, names["compiled"])), key))
    rank = F.when(by_name > 0, by_name).when(~python & defines_main(F.col("text")), F.lit(50)).otherwise(F.lit(99))
    found = files.filter(F.col("language").isNotNull()).groupBy("language").agg(F.min_by(F.struct("path", rank.alias("rank")), F.struct(rank, F.col("path"))).alias("e"), F.count(F.lit(1)).alias("n"))
    return found.filter((F.col("e.rank") < 99) | (F.col("n") == 1)).select("language", F.col("e.path").alias("path"))


def unchanged(files: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) against parsed(language, path, content_key): only misses need a parse."""
    keyed = files.withColumn("content_key", content_key(F.col("text")))
    on = ["language", "path", "content_key"]
    return keyed.join(parsed.select(*on), on, "left_semi"), keyed.join(parsed.select(*on), on, "left_anti")
