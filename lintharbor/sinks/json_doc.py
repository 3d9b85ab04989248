"""The full result document of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor.functions import severity as sev
from lintharbor.schemas import SCAN_KEYS
from lintharbor.sinks import pieces as pc

FIELDS = ["tool", "severity", "title", "description", "file", "line", "column", "code", "fix",
          "rule_id", "cwe", "owasp", "references"]


def finding_json() -> Column:
    """NULL fields are left out, as absent keys."""
    return F.to_json(F.struct(*[F.col(f).alias(f) for f in FIELDS]))


def json_document(findings: DataFrame, summary: DataFrame,
                  chunk_bits: int = pc.CHUNK_BITS) -> DataFrame:
    """Result documents as pieces: scalars of `summary`, all findings, then the four lists.

    `findings` is deduplicated and stored; every row of `summary` gives a document.
    """
    rank = sev.bucket_rank(sev.severity_bucket(F.col("severity")))
    texts = findings.select(*SCAN_KEYS, "seq", rank.alias("rank"), finding_json().alias("text"))
    # Each finding goes into the full list (slot 1) and the list of its severity (slots 2 to 5).
    listed = texts.select(*SCAN_KEYS, "seq", "text",
                          F.explode(F.array(F.lit(1), F.col("rank") + 2)).alias("slot"))

    scalars = F.to_json(F.struct(*[F.col(c) for c in summary.columns if c not in SCAN_KEYS]))
    # The scalars' closing brace moves to the end of the document.
    head = F.concat(F.substr(scalars, F.lit(1), F.length(scalars) - 1),
                    F.lit(',"all_vulnerabilities":['))
    frames = pc.frame_pieces(
        summary, (0, 0, head),
        *[(i + 2, 0, F.lit(f'],"{b}_vulnerabilities":[')) for i, b in enumerate(sev.BUCKETS)],
        (6, 0, F.lit("]}")))
    return frames.unionByName(pc.chunk_pieces(listed, 1, chunk_bits=chunk_bits))
