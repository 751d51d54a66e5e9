"""Which uploads and archive members are taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicefields import fixed_values as fv
from invoicefields.functions.text import base_name, is_pdf, suffix


def is_junk_member(name: Column) -> Column:
    return F.startswith(name, F.lit("__MACOSX/")) | F.endswith(name, F.lit(".DS_Store"))


def is_admissible_member(name: Column, is_dir: Column) -> Column:
    """A file with a name, no system junk, and a PDF by extension."""
    named = F.coalesce(base_name(name), F.lit(""))
    return (
        ~F.coalesce(is_dir, F.lit(False)) & ~is_junk_member(name)
        & (named != "") & (suffix(named) == ".pdf")
    )


def escapes_target(name: Column) -> Column:
    """Does the member path leave the folder it is unpacked into?

    Walks the path elements and keeps the depth and the lowest depth so far.  A path that
    leaves and comes back by naming the folder is counted as leaving.
    """
    step = (
        lambda part: F.when(part.isin("", "."), F.lit(0)).when(part == "..", F.lit(-1)).otherwise(F.lit(1))
    )
    walk = F.aggregate(
        F.split(name, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda at, part: F.struct(
            (at["depth"] + step(part)).alias("depth"),
            F.least(at["lowest"], at["depth"] + step(part)).alias("lowest"),
        ),
        lambda at: at["lowest"] < 0,
    )
    return F.startswith(name, F.lit("/")) | walk


def archive_verdicts(members: DataFrame) -> DataFrame:
    """Per archive: is it a ZIP, does a member escape, how many documents does it hold."""
    counted = is_admissible_member(F.col("member_name"), F.col("is_dir"))
    return (
        members.withColumn("_counted", F.coalesce(counted, F.lit(False)))
        .withColumn("_escapes", F.when(F.col("_counted"), escapes_target(F.col("member_name"))).otherwise(F.lit(False)))
        .groupBy("archive")
        .agg(
            F.bool_and("is_zip").alias("is_zip"),
            F.bool_or("_escapes").alias("escapes"),
            F.count_if("_counted").alias("pdfs"),
        )
    )


def admit_uploads(uploads: DataFrame, archives: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Accept or reject each upload as a whole.

    ``uploads``: upload_id, ordinal, filename, length.  ``archives``: the verdicts, keyed by
    upload_id in ``archive``.  ``requests``: all upload ids, to answer those without files.
    Result: upload_id, accepted, extracted_pdfs, reason.  The first broken rule in upload order
    is found by partial aggregation, so an upload of very many files is no hot spot.
    """
    empty = F.coalesce(F.col("length"), F.lit(0)) == 0
    name = F.coalesce(F.col("filename"), F.lit(""))
    ext = suffix(base_name(name))
    alone = (
        F.when(empty, fv.MSG_EMPTY_FILE)
        .when(~ext.isin(".zip", ".pdf"), F.concat(F.lit(fv.MSG_BAD_TYPE[0]), ext, F.lit(fv.MSG_BAD_TYPE[1])))
    )
    among = F.when(empty, F.concat(F.lit(fv.MSG_EMPTY_AMONG_SEVERAL), name)).when(
        ext != ".pdf", F.concat(F.lit(fv.MSG_NOT_PDF_AMONG_SEVERAL), name)
    )
    broken_at = F.when(among.isNotNull(), F.col("ordinal"))
    per_upload = (
        uploads.select("upload_id", "ordinal", ext.alias("_ext"), alone.alias("_alone"),
                       among.alias("_among"), broken_at.alias("_broken_at"))
        .groupBy("upload_id")
        .agg(
            F.count("*").alias("_files"),
            F.max("_ext").alias("_ext"),
            F.max("_alone").alias("_alone"),
            F.min_by("_among", "_broken_at").alias("_among"),
        )
    )
    if requests is not None:
        per_upload = requests.select("upload_id").join(per_upload, "upload_id", "left")
    joined = per_upload.join(archives.withColumnRenamed("archive", "upload_id"), "upload_id", "left")

    files = F.coalesce(F.col("_files"), F.lit(0))
    lone_zip = (files == 1) & (F.col("_ext") == ".zip") & F.col("_alone").isNull()
    reason = (
        F.when(files == 0, fv.MSG_NO_FILES)
        .when(lone_zip & ~F.coalesce(F.col("is_zip"), F.lit(False)), fv.MSG_NOT_A_ZIP)
        .when(lone_zip & F.col("escapes"), fv.MSG_ZIP_ESCAPE)
        .when(lone_zip & (F.col("pdfs") == 0), fv.MSG_ZIP_WITHOUT_PDF)
        .when(files == 1, F.col("_alone"))
        .otherwise(F.col("_among"))
    )
    accepted = F.col("reason").isNull()
    return joined.select(
        "upload_id", reason.alias("reason"), lone_zip.alias("_lone_zip"), files.alias("_files"), "pdfs"
    ).select(
        "upload_id", accepted.alias("accepted"),
        F.when(accepted, F.when(F.col("_lone_zip"), F.col("pdfs")).otherwise(F.col("_files")))
        .otherwise(F.lit(0)).cast("bigint").alias("extracted_pdfs"),
        "reason",
    )


def precheck_selection(uploads: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The check made before an upload: none selected, a ZIP among several, a bad extension."""
    name = F.lower(F.coalesce(F.col("filename"), F.lit("")))
    is_zip = F.endswith(name, F.lit(".zip"))
    bad_at = F.when(~(is_zip | F.endswith(name, F.lit(".pdf"))), F.col("ordinal"))
    per_upload = (
        uploads.select("upload_id", "filename", is_zip.alias("_zip"), bad_at.alias("_bad_at"))
        .groupBy("upload_id")
        .agg(
            F.count("*").alias("_files"),
            F.bool_or("_zip").alias("_zip"),
            F.min_by("filename", "_bad_at").alias("_bad_name"),
            F.min("_bad_at").alias("_bad_at"),
        )
    )
    if requests is not None:
        per_upload = requests.select("upload_id").join(per_upload, "upload_id", "left")
    files = F.coalesce(F.col("_files"), F.lit(0))
    return per_upload.select(
        "upload_id",
        F.when(files == 0, fv.MSG_SELECT_NONE)
        .when((files > 1) & F.col("_zip"), fv.MSG_SELECT_ZIP_AMONG_SEVERAL)
        .when(
            F.col("_bad_at").isNotNull(),
            F.concat(F.lit(fv.MSG_SELECT_BAD_TYPE[0]), F.col("_bad_name"), F.lit(fv.MSG_SELECT_BAD_TYPE[1])),
        )
        .alias("reason"),
    )


def upload_responses(accepted: DataFrame, status_prefix: str, batch_id: Column) -> DataFrame:
    """The answer to each accepted upload: batch id, number of documents, where its status is."""
    return accepted.filter("accepted").withColumn("batch_id", batch_id).select(
        "batch_id", "extracted_pdfs",
        F.concat(F.lit(status_prefix.rstrip("/") + "/"), F.col("batch_id"), F.lit("/status")).alias("status_url"),
    )


def last_of_each_name(uploads: DataFrame) -> DataFrame:
    """Files of an upload as they end up in its batch: of equal base names the last one stays."""
    named = uploads.withColumn("file", base_name(F.col("filename")))
    payload = [c for c in named.columns if c not in ("upload_id", "file")]
    return (
        named.groupBy("upload_id", "file")
        .agg(F.max_by(F.struct(*payload), "ordinal").alias("_last"))
        .select("upload_id", "file", "_last.*")
    )


def pdf_count(name: Column) -> Column:
    """Aggregate: how many of the files are PDFs."""
    return F.count_if(is_pdf(name))
