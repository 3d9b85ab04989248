"""Walking a tree of files as Spark jobs, one per level of folders.

Spark's own listing runs over the whole tree, leaves out names that begin with `.` or `_`, and cannot be
told to stay out of a folder. Here a level is a table of folders; tasks list them, and the folders found
make the next level. Folders that are skipped are never entered, so what lies below `node_modules`
costs nothing. Contents are read by tasks as well, file by file.

Tasks open stores with pyarrow: local and mounted paths, s3 (also as s3a or s3n), gs, abfss, and what
the Hadoop client library opens where a cluster has it. For any other store the driver lists one folder
level after the other with Spark's own file systems, and Spark reads the contents; Spark's readers do
not open hidden files, so these are listed, but not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintharbor.functions.scale import stored

LISTED = "project string, root string, path string, location string, size bigint, is_dir boolean"
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):(//[^/]*)?")


def plain_root(path: str) -> str:
    """Path without scheme and authority, as `files.plain_path` gives for a column."""
    found = _SCHEME.match(path)
    rest = path[found.end():] if found else os.path.abspath(path)
    return "/" + rest.strip("/")


def _opener():
    """A function from a root to (store, path in it). It is made here so that tasks get it by value."""
    aliases = {"s3a": "s3", "s3n": "s3"}
    opened: dict = {}

    def open_store(root: str):
        from pyarrow import fs

        if root not in opened:
            scheme, sep, rest = root.partition(":")
            local = not sep or "/" in scheme
            uri = os.path.abspath(root) if local else f"{aliases.get(scheme, scheme)}:{rest}"
            store, base = fs.FileSystem.from_uri(uri)
            opened[root] = store, base.rstrip("/") or "/"
        return opened[root]

    return open_store


def opens_in_tasks(root: str) -> bool:
    import pyarrow as pa

    try:
        _opener()(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as error:
        if isinstance(error, FileNotFoundError):
            raise
        return False
    return True


def _lister(skip: frozenset[str], hidden: bool, is_root: bool):
    open_store = _opener()

    def entries(root: str, folder: str | None):
        from pyarrow import fs

        store, base = open_store(root)
        at = base if folder is None else folder
        if is_root:
            info = store.get_file_info(at)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
            if info.is_file:
                yield info
                return
        for info in store.get_file_info(fs.FileSelector(at)):
            name = info.base_name
            is_dir = info.type == fs.FileType.Directory
            if is_dir and (name in skip or (isinstance(store, fs.LocalFileSystem) and os.path.islink(info.path))):
                continue
            if hidden or name[0] not in "._":
                yield info

    def listed(batches):
        import pyarrow as pa
        from pyarrow import fs

        kinds = [pa.string()] * 4 + [pa.int64(), pa.bool_()]
        names = ["project", "root", "path", "location", "size", "is_dir"]
        for batch in batches:
            for project, root, folder in zip(*(batch.column(i).to_pylist() for i in range(3))):
                base = open_store(root)[1]
                rows = [
                    (project, root, plain_root(root).rstrip("/") + info.path[len(base.rstrip("/")):], info.path, info.size,
                     info.type == fs.FileType.Directory) for info in entries(root, folder)]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return listed


def _by_driver(folders: DataFrame, skip: frozenset[str], hidden: bool) -> DataFrame:
    """A level listed with the session's file systems; one folder at a time is held."""
    spark = folders.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for project, root, folder in folders.toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(folder or root)
        store = at.getFileSystem(conf)
        found = store.listStatusIterator(at)
        while found.hasNext():
            status = found.next()
            path, is_dir = status.getPath().toString(), status.isDirectory()
            name = path.rsplit("/", 1)[-1]
            if (is_dir and name in skip) or not (hidden or name[0] not in "._"):
                continue
            rows.append((project, root, plain_root(path), path, status.getLen(), is_dir))
    return spark.createDataFrame(rows, LISTED)


def walk(roots: DataFrame, skip: Collection[str] = (), hidden: bool = True, tasks: int | None = None) -> DataFrame:
    """Files below the roots of (project, root): project, root, path, location, size.

    `path` is without scheme and authority, `location` is what `contents` opens. Folders whose name is
    in `skip` are not entered, nor are links to folders; a root itself may have any name, and may be a
    file. `hidden` keeps names that begin with `.` or `_`.
    """
    spark = roots.sparkSession
    known = [r.root for r in roots.select("root").distinct().limit(1000).collect()]
    in_tasks = all(opens_in_tasks(r) for r in known)
    names = frozenset(skip)
    level, levels, first = roots.select("project", "root", F.lit(None).cast("string").alias("folder")), [], True
    while True:
        if in_tasks:
            n = level.count()
            spread = level.repartition(max(1, min(n, tasks or 4 * spark.sparkContext.defaultParallelism)))
            found = stored(spread.mapInArrow(_lister(names, hidden, first), LISTED))
        else:
            found = stored(_by_driver(level, names, hidden))
        levels.append(found.filter("NOT is_dir").drop("is_dir"))
        level, first = found.filter("is_dir").select("project", "root", F.col("location").alias("folder")), False
        if level.isEmpty():
            return reduce(DataFrame.union, levels)


def contents(files: DataFrame, flush: int = 8 << 20) -> DataFrame:
    """`files` of `walk` with their whole `text`, opened by the tasks, a few MB or one file at a time."""
    spark = files.sparkSession
    known = [r.root for r in files.select("root").distinct().limit(1000).collect()]
    if not all(opens_in_tasks(r) for r in known):
        visible = files.filter(~F.substring_index("location", "/", -1).rlike("^[._]"))
        paths = [r.location for r in visible.select("location").toLocalIterator()]
        if not paths:
            return files.limit(0).withColumn("text", F.lit(""))
        texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("location"), F.col("value").alias("text"))
        return visible.join(texts, "location").select(*files.columns, "text")
    open_store = _opener()
    names = list(files.columns)

    def opened(batches):
        import pyarrow as pa

        for batch in batches:
            roots, locations = batch.column("root").to_pylist(), batch.column("location").to_pylist()
            start, held, texts = 0, 0, []
            for i, (root, location) in enumerate(zip(roots, locations)):
                with open_store(root)[0].open_input_stream(location) as stream:
                    texts.append(stream.read().decode("utf-8", "replace"))
                held += len(texts[-1])
                if held > flush or i + 1 == len(roots):
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "text"])
                    start, held, texts = i + 1, 0, []

    schema = ", ".join(f"{n} {t}" for n, t in files.dtypes)
    spread = files.repartition(4 * spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(opened, f"{schema}, text string")
