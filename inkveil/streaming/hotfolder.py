"""A watched folder as a stream: every version of a file is converted and redacted once, then put into an archive.

The source (``versions``) gives out versions that two listings agree on. A micro-batch reads the contents of just these files, writes
its rows, and only then moves the files. A batch that is run again overwrites what it wrote and finds files that were moved already in the
archive. A file that fails is a row with an error; a file that is gone when its turn comes is one too.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from ..operators.engine import redact
from ..operators.options import Options
from ..sources.files import convert
from ..sources.sinks import scrub_paths
from .versions import FolderVersions

LEAST_INTERVAL = 0.5
_WRITTEN = "path string, modificationTime timestamp, output string, batch long"


def written(spark: SparkSession, output: str) -> DataFrame:
    """(path, modificationTime, output, batch) of what batches have written."""
    try:
        return spark.read.schema(_WRITTEN).parquet(output)
    except AnalysisException:  # nothing is there yet
        return spark.createDataFrame([], _WRITTEN)


def name_outputs(paths: list[str], taken: dict[str, str], own: dict[str, str]) -> dict[str, str]:
    """path to output name: stem.md, for further files of a stem stem-ext.md, then stem-ext-2.md and so on.

    ``own``: names that paths have already and keep; ``taken``: names with the path that has them.
    """
    taken = dict(taken) | {v: k for k, v in own.items()}
    named = dict(own)
    for path in sorted(set(paths) - set(own)):
        name = path.rsplit("/", 1)[-1]
        stem, _, extension = name.rpartition(".")
        n, output = 1, f"{stem}.md"
        while output in taken:
            output = f"{stem}-{extension}.md" if n == 1 else f"{stem}-{extension}-{n}.md"
            n += 1
        named[path], taken[output] = output, path
    return named


def _names(spark: SparkSession, output: str, number: int, paths: list[str]) -> dict[str, str]:
    """Names for a batch's files. Only rows of the same paths or stems are read from what is written: filters that reach the scan."""
    done = written(spark, output).filter(F.col("batch") != number)
    own = {r["path"]: r["output"] for r in done.filter(F.col("path").isin(paths)).select("path", "output").distinct().collect()}
    stems = {path.rsplit("/", 1)[-1].rpartition(".")[0] for path in paths}
    near = F.lit(False)
    for stem in sorted(stems):
        near = near | F.startswith("output", F.lit(stem))
    taken = {r["output"]: r["path"] for r in done.filter(near).select("path", "output").distinct().collect()} if stems else {}
    return name_outputs(paths, taken, own)


def _literal(path: str) -> str:
    """A path without the characters that choose several."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _located(paths: list[str], archive: str | None) -> tuple[dict[str, str], list[str]]:
    """Where the files of ``paths`` are now: in place or already in the archive; and those that are in neither."""
    found, gone = {}, []
    for path in paths:
        places = [path, *([f"{archive.rstrip('/')}/{path.rsplit('/', 1)[-1]}"] if archive else [])]
        here = next((p for p in places if _info(p).type == fs.FileType.File), None)
        if here:
            found[path] = here
        else:
            gone.append(path)
    return found, gone


def _info(path: str) -> fs.FileInfo:
    # the folder is a URI, a file's own name is not
    folder, _, name = path.rpartition("/")
    files, root = fs.FileSystem.from_uri(folder)
    return files.get_file_info(f"{root.rstrip('/')}/{name}")


def contents(spark: SparkSession, located: dict[str, str]) -> DataFrame:
    """path, name, extension, content of these files only; ``located`` tells where each path lies now."""
    files = spark.read.format("binaryFile").load([_literal(p) for p in located.values()])
    # the reader may spell a path differently; names are unique in a folder
    original = F.create_map(*[F.lit(x) for path in located for x in (path.rsplit("/", 1)[-1], path)])
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    decoded = F.when(F.contains(name, F.lit("%")), F.expr(r"try_url_decode(replace(regexp_extract(path, '([^/\\\\]+)$', 1), '+', '%2B'))")).otherwise(name)
    real = F.coalesce(original[name], original[decoded])
    named = files.withColumn("path", real).withColumn("name", F.regexp_extract("path", r"([^/\\]+)$", 1))
    return named.withColumn("extension", T.extension(F.col("name"))).select("path", "name", "extension", "content")


def archive_files(paths: list[str], archive: str, versions: dict[str, int]) -> None:
    """Move files away, unless they have changed since: a newer version stays and gets its turn. A file that is gone is no error."""
    for path in paths:
        info = _info(path)
        if info.type != fs.FileType.File or info.size != versions[path]:
            continue
        files, root = fs.FileSystem.from_uri(archive)
        files.create_dir(root, recursive=True)
        files.move(info.path, f"{root.rstrip('/')}/{path.rsplit('/', 1)[-1]}")


def start(spark: SparkSession, folder: str, output: str, checkpoint: str, options: Options | None = None, interval: float = 2.0,
          once: bool = False, settled_seconds: float = 0, most_files: int = 100, archive: str | None = None, pause: float = 0.0) -> StreamingQuery:
    """Convert and redact what arrives into Parquet under ``output``.

    Columns: path, name, extension, modificationTime, markdown, engine, prose, error, output, redacted, report and the batch. Names of outputs differ over
    all batches; a new version of a path keeps its name. ``archive``: a folder for files that are done. ``once``: work until two listings
    show nothing new, ``pause`` seconds apart, and stop.
    """
    if interval < LEAST_INTERVAL:
        raise ValueError(f"the interval is at least {LEAST_INTERVAL} s")
    spark.dataSource.register(FolderVersions)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # at most most_files rows; of several versions of a path the last one is what can be read
        chosen = {r["path"]: r for r in batch.orderBy("modificationTime").collect()}
        if not chosen:
            return
        names = _names(session, output, number, list(chosen))
        located, gone = _located(list(chosen), archive)
        rows = [(path, r["modificationTime"], names[path], "the file is gone" if path in gone else None) for path, r in chosen.items()]
        facts = session.createDataFrame(rows, "path string, modificationTime timestamp, output string, missing string")
        if located:
            read = convert(contents(session, located)).drop("content")
        else:
            read = convert(session.createDataFrame([], "path string, name string, extension string, content binary")).drop("content")
        joined = facts.join(read, "path", "left").withColumn("error", scrub_paths(F.coalesce("missing", "error"))).drop("missing")
        joined = joined.withColumn("name", F.coalesce("name", F.regexp_extract("path", r"([^/\\]+)$", 1)))
        # a batch that is run again overwrites what it wrote before
        redact(joined, "markdown", options).write.mode("overwrite").parquet(f"{output}/batch={number}")
        if archive:
            archive_files(list(located), archive, {path: r["length"] for path, r in chosen.items()})

    source = spark.readStream.format("folder_versions").option("path", folder).option("mostFiles", most_files).option("settledSeconds", settled_seconds)
    writer = source.option("pauseSeconds", pause).load().writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if not once:
        return writer.trigger(processingTime=f"{interval} seconds").start()
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
