"""Documents as ordered pieces.

A scan may hold any share of all findings, so a document is never gathered into one row. It is a
set of rows (project, scan_id, slot, section, chunk, text); the texts of a scan, joined in the
order of slot, section and chunk, are the document. A piece holds the findings of one block of
`2**chunk_bits` consecutive `seq` values, so its size is bounded by construction and no numbering
or sorting of a whole scan is needed. Small scans come out as a handful of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor.schemas import SCAN_KEYS
from lintharbor.sinks.single_file import write_files

CHUNK_BITS = 10
PIECE_KEYS = [*SCAN_KEYS, "slot", "section", "chunk"]


def chunk_pieces(items: DataFrame, section: int, glue: str = ",",
                 chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Join item texts (project, scan_id, slot, seq, text) into pieces, in seq order.

    Every piece but the first of its slot starts with the glue. The first chunk per slot comes
    from a narrow aggregate and is matched on the full piece key, which the pieces are already
    partitioned by: they are not shuffled again, and a large scan stays spread out.
    """
    keys = [*SCAN_KEYS, "slot", "chunk"]
    blocks = items.withColumn("chunk", F.shiftright("seq", chunk_bits))
    first = blocks.groupBy(*SCAN_KEYS, "slot").agg(F.min("chunk").alias("chunk")).withColumn(
        "_first", F.lit(True))
    joined = blocks.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("_items"))
    body = F.array_join(F.transform("_items", lambda x: x["text"]), glue)
    return (
        joined.select(*keys, body.alias("_body")).join(first, keys, "left")
        .select(*SCAN_KEYS, "slot", F.lit(section).alias("section"), "chunk",
                F.when(F.col("_first"), F.col("_body")).otherwise(F.concat(F.lit(glue), "_body"))
                .alias("text"))
    )


def frame_pieces(rows: DataFrame, *pieces: tuple[Column | int, int, Column]) -> DataFrame:
    """Fixed pieces (slot, section, text) around the chunks, for every row of `rows`."""
    structs = [
        F.struct((slot if isinstance(slot, Column) else F.lit(slot)).alias("slot"),
                 F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("chunk"),
                 text.alias("text"))
        for slot, section, text in pieces]
    return rows.select(*SCAN_KEYS, F.inline(F.array(*structs)))


def folder_of_scan() -> Column:
    """Folder of a scan below the output of a format, spelled as Spark spells partition folders."""
    def safe(name: str) -> Column:
        # Whatever a path or a partition name could misread is written as %XX.
        return F.regexp_replace(F.url_encode(F.col(name)), r"\+", "%20")

    return F.concat(F.lit("project="), safe("project"), F.lit("/scan_id="), safe("scan_id"))


def write_named_documents(pieces: DataFrame, names: DataFrame, path: str) -> None:
    """One file per scan, `project=…/scan_id=…/<file>`, under the name in `names` (project, scan_id, file).

    A scan written again replaces its file. Pieces are built by all tasks; the bytes of a document are
    then appended by one.
    """
    named = pieces.join(names.select(*SCAN_KEYS, "file"), SCAN_KEYS).select(
        folder_of_scan().alias("folder"), "file", "slot", "section", "chunk", "text")
    write_files(named, path, ["slot", "section", "chunk"])


def write_documents(pieces: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per scan; its files in name order hold the document. For documents too large for one writer.

    Range partitioning on the piece key spreads a large scan over several tasks and files. The
    writer keeps this sort because it starts with the folder columns. Were one of them a constant,
    the optimizer would drop it from the sort and the writer would sort anew by folder only; as a
    document is always a union of frames and chunks, its columns are not constants.
    """
    (
        pieces.repartitionByRange(*PIECE_KEYS).sortWithinPartitions(*PIECE_KEYS)
        .select(*SCAN_KEYS, "text")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*SCAN_KEYS).text(path)
    )
