"""Status documents kept as JSON files, one folder per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from invoicefields import schemas
from invoicefields.sources.storage import stored

CORRUPT = "_corrupt_record"


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<batch>/status.json`` files; what is no JSON arrives in ``_corrupt_record``."""
    return (
        spark.read.schema(f"{schemas.STATUS}, {CORRUPT} STRING")
        .option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "status.json")
        .json(root)
    )


def split_unreadable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status rows, the raw text of documents that could not be read).  The files are parsed once: what was
    read is stored, as Spark refuses to read raw JSON for its unreadable part alone."""
    documents = stored(documents)
    return (
        documents.filter(documents[CORRUPT].isNull()).drop(CORRUPT),
        documents.filter(documents[CORRUPT].isNotNull()).select(CORRUPT),
    )
