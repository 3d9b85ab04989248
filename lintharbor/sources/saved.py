"""Re-reading saved result documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintharbor import schemas
from lintharbor.functions import text as tx
from lintharbor.functions.scale import stored


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Saved result documents below `path`, one row each; the file path is the id."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("document"))


def _scan_of(file: Column) -> list[Column]:
    """Project and scan of a written document, from the folders it lies in.

    Folder names have their special characters escaped, and Spark escapes the path it reports once more.
    """
    def decoded(c: Column) -> Column:
        return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))

    return [decoded(decoded(F.regexp_extract(file, f"/{k}=([^/]*)/", 1))).alias(k) for k in schemas.SCAN_KEYS]


def read_written_results(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the result documents that `sinks.pieces` wrote below `path`, in one file or in many.

    A written document has a line for each piece: a line opens a list, holds findings, or ends the
    document. Lines are the seams: each is parsed by itself, wherever Spark splits the file, so no task
    sees a whole document. Which list a line belongs to is the last one opened before it, found within
    blocks of a file first and then over the blocks, of which there are few; the position of a finding
    comes from counts taken alike. Columns as in `read_results_doc`, with project, scan_id and seq.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    # Files of a document are in the order of their names; a block is a split of one of them.
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    scan = F.regexp_extract("file", r"/project=[^/]*/scan_id=[^/]*/", 0)
    opened = F.nullif(F.regexp_extract("value", r'"([a-z_]+)":\[$', 1), F.lit(""))
    listed = F.from_json(
        F.when(F.col("value").rlike(r"^,?\{") & opened.isNull(), F.concat(
            F.lit("["), F.ltrim("value", F.lit(",")), F.lit("]"))), f"array<{schemas.SAVED_FINDING}>")
    head = F.when(F.col("value").startswith("{") & opened.isNotNull(), F.from_json(
        F.concat("value", F.lit("]}")), "target_path string"))
    read = stored(lines.select(
        scan.alias("scan"), *_scan_of(F.col("file")), "file", "at", "line", opened.alias("opened"),
        head["target_path"].alias("target_path"), listed.alias("found"),
        F.greatest(F.size(F.coalesce(listed, F.array().cast(f"array<{schemas.SAVED_FINDING}>"))), F.lit(0)).alias("n")))

    block = ["scan", "file", "at"]
    upto = Window.unboundedPreceding, Window.currentRow
    blocks = read.groupBy(*block).agg(F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("line"))).alias("last"))
    earlier = Window.partitionBy("scan").orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*block, F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = Window.partitionBy(*block).orderBy("line").rowsBetween(*upto)
    placed = (
        read.join(carried, block)
        .withColumn("list", F.coalesce(F.last("opened", ignorenulls=True).over(within), F.col("carried")))
        .filter("list = 'all_vulnerabilities' AND n > 0"))
    sums = placed.groupBy(*block).agg(F.sum("n").alias("sum"))
    base = sums.select(*block, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    counted = placed.join(base, block).withColumn("before", F.col("base") + F.sum("n").over(within) - F.col("n"))
    heads = read.filter("target_path IS NOT NULL").groupBy("scan").agg(F.first("target_path").alias("target"))
    return (
        counted.drop("target_path").join(heads, "scan", "left")
        .select(*schemas.SCAN_KEYS, F.coalesce("target", F.lit(".")).alias("target_path"), "before",
                F.posexplode("found").alias("i", "f"))
        .select(F.concat_ws("/", *schemas.SCAN_KEYS).alias("doc_id"), "target_path", *schemas.SCAN_KEYS,
                (F.col("before") + F.col("i")).alias("seq"), "f.*"))


def results_as_findings(results: DataFrame) -> DataFrame:
    """Rows of `read_results_doc` as findings that SARIF and HTML documents are made of.

    The document is the project, `saved` its scan, unless the rows say otherwise.
    """
    given = set(results.columns)
    values = {
        "project": F.col("project") if "project" in given else F.col("doc_id").cast("string"),
        "scan_id": F.col("scan_id") if "scan_id" in given else F.lit("saved"),
        "seq": F.col("seq" if "seq" in given else "pos").cast("bigint")}
    return results.select(*[c.alias(n) for n, c in values.items()],
                          *[c for c in results.columns if c not in (*values, "pos", "doc_id")])


def unreadable_documents(docs: DataFrame) -> DataFrame:
    """Ids of documents (doc_id, document) that are no JSON; `read_results_doc` has no rows of them."""
    return docs.filter(~tx.is_json(F.coalesce("document", F.lit("")))).select("doc_id")


def _list(name: str) -> Column:
    empty = F.array().cast(f"array<{schemas.SAVED_FINDING}>")
    return F.coalesce(F.col(f"doc.{name}"), empty)


def _tag(items: Column, tool: str) -> Column:
    """Legacy lists are bound to a tool by their key, whatever the entry says."""
    return F.transform(items, lambda x: x.withField("tool", F.lit(tool)))


def read_results_doc(docs: DataFrame) -> DataFrame:
    """Findings of documents (doc_id, document): the full list, else the four severity lists.

    A legacy list fills in for each tool family the chosen list has nothing of.
    """
    parsed = docs.select("doc_id", F.from_json("document", schemas.SAVED_RESULT).alias("doc"))
    severity_lists = F.concat(*[
        _list(f"{s}_vulnerabilities") for s in ("critical", "high", "medium", "low")])
    full = _list("all_vulnerabilities")
    chosen = parsed.withColumn("main", F.when(F.size(full) > 0, full).otherwise(severity_lists))

    def legacy(tools: list[str], key: str, tag: str) -> Column:
        present = F.exists("main", lambda x: F.coalesce(x["tool"].isin(*tools), F.lit(False)))
        return F.when(present, F.array().cast(f"array<{schemas.SAVED_FINDING}>")).otherwise(
            _tag(_list(key), tag))

    parts = [
        F.col("main"),
        legacy(["Bandit"], "python_vulnerabilities", "Bandit"),
        legacy(["ESLint", "ESLint Security", "npm audit"], "javascript_vulnerabilities",
               "ESLint Security"),
        legacy(["Secret Scanner"], "secrets", "Secret Scanner"),
    ]
    together = reduce(lambda a, b: F.concat(a, b), parts)
    return (
        chosen.select("doc_id", F.coalesce("doc.target_path", F.lit(".")).alias("target_path"),
                      F.posexplode(together).alias("pos", "f"))
        .select("doc_id", "target_path", "pos", "f.*")
    )
