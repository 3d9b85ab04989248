"""A Spark data source that writes each document as one file under a given name.

Rows are (folder, file, text), sorted by file and place, with all rows of a file in one partition. A task
streams them to a folder of its own attempt, so a document is never held in memory. Only when every task
has succeeded are the files of the successful attempts moved to their names; what failed attempts left
behind goes with the staging folder, also when the whole job fails. A document is written by one task, as
one file has one writer; what is expensive, building its pieces, is spread over all tasks before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMAT = "lintharbor_documents"


def document_source():
    """The data source class. It is made here so that tasks get it by value and need no copy of the package."""
    import uuid

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    def opened(root):
        import os

        from pyarrow import fs

        scheme, sep, rest = root.partition(":")
        if not sep or "/" in scheme:
            return fs.LocalFileSystem(), os.path.abspath(root)
        alias = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        store, base = fs.FileSystem.from_uri(f"{alias}:{rest}")
        return store, base.rstrip("/")

    class Documents(DataSourceWriter):
        def __init__(self, root):
            self.root = root
            self.staging = f"_staging-{uuid.uuid4().hex}"

        def write(self, rows):
            from pyspark import TaskContext

            store, base = opened(self.root)
            folder = f"{base}/{self.staging}/{TaskContext.get().taskAttemptId()}"
            store.create_dir(folder, recursive=True)
            moves, current, stream = [], None, None
            try:
                for folder_of, file, text in rows:
                    if (folder_of, file) != current:
                        if stream is not None:
                            stream.close()
                        current = (folder_of, file)
                        staged = f"{folder}/{len(moves)}"
                        stream = store.open_output_stream(staged)
                        moves.append((staged, f"{base}/{folder_of}", file))
                    stream.write((text + "\n").encode())
            finally:
                if stream is not None:
                    stream.close()
            done = WriterCommitMessage()
            done.moves = moves
            return done

        def _clear(self, store, base):
            from pyarrow import fs

            if store.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
                store.delete_dir(f"{base}/{self.staging}")

        def commit(self, messages):
            store, base = opened(self.root)
            for message in messages:
                for staged, folder, file in getattr(message, "moves", ()):
                    store.create_dir(folder, recursive=True)
                    store.move(staged, f"{folder}/{file}")
            self._clear(store, base)

        def abort(self, messages):
            self._clear(*opened(self.root))

    class DocumentSource(DataSource):
        @classmethod
        def name(cls):
            return "lintharbor_documents"

        def schema(self):
            return "folder string, file string, text string"

        def writer(self, schema, overwrite):
            return Documents(self.options["path"])

    return DocumentSource


def register(spark: SparkSession) -> None:
    spark.dataSource.register(document_source())


def write_files(rows: DataFrame, path: str, order: list[str]) -> None:
    """Write rows (folder, file, text, and the columns of `order`) as one file each below `path`."""
    register(rows.sparkSession)
    keys = ["folder", "file"]
    (
        rows.repartition(*keys).sortWithinPartitions(*keys, *order)
        .select(*keys, "text")
        .write.format(FORMAT).mode("append").option("path", path).save()
    )
