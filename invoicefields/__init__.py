"""Batches of business documents into tables, as PySpark DataFrame operators.

functions/   Column -> Column: text, numbers, field finders, names and dates
operators/   DataFrame -> DataFrame: extraction, totals, reports, admission, batches, status, notifications
sources/     file, archive, page and status readers, report and status writers
streaming/   inbox stream, batch closing, the run of a closed batch
plans/       the registered queries, their rendered corpus and their check SQL
"""
