"""Uploads into the documents of their batches: expanded, judged, and taken in as a whole or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicefields.functions.text import base_name, suffix
from invoicefields.operators.admission import admit_uploads, archive_verdicts, last_of_each_name
from invoicefields.sources.archives import archive_documents, expand_archives
from invoicefields.sources.storage import stored


def upload_documents(uploads: DataFrame, requests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, documents ``upload_id, file, ordinal, filename, content``) of the uploaded files
    ``upload_id, ordinal, filename, content``.

    An archive is unpacked once, into a stored copy that both the verdicts and the documents
    read; the verdicts do not read its contents.  An upload that is rejected gives no documents.
    A member that cannot be unpacked stays as a document without content, to be rejected.
    """
    named = uploads.select("upload_id", "ordinal", "filename", "content")
    is_archive = suffix(base_name(F.coalesce("filename", F.lit("")))) == ".zip"
    archives = named.filter(is_archive).select(F.col("upload_id").alias("archive"), "content")
    members = stored(expand_archives(archives, only_documents=True))
    sized = named.select("upload_id", "ordinal", "filename", F.octet_length("content").alias("length"))
    decided = admit_uploads(sized, archive_verdicts(members), requests)
    packed = archive_documents(members).select(
        F.col("archive").alias("upload_id"), F.col("member_no").alias("ordinal"),
        F.col("member_name").alias("filename"), "content")
    single = named.filter(~is_archive).withColumn("ordinal", F.col("ordinal").cast("int"))
    accepted = decided.filter("accepted").select("upload_id")
    every = single.unionByName(packed).join(accepted, "upload_id", "left_semi")
    return decided, last_of_each_name(every)
