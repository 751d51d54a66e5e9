"""Check SQL for the registered queries, for a separate SQL engine over the same tables.

Expected fields are computed from the numbers the texts were rendered from.  The rule for
repeated digits is spelled out over all unit lengths, not by a search as on the Spark side.
"""

from __future__ import annotations

from invoicefields import fixed_values as fv

INVOICES = """
inv AS (
  SELECT k, boxes, pallets, gross, gross - boxes AS net, total, k % 6 AS style
  FROM (
    SELECT l_orderkey AS k, count(*) AS boxes,
           CAST(1 + sum(l_linenumber) % 40 AS BIGINT) AS pallets,
           CAST(sum(l_quantity) AS BIGINT) AS gross,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
    FROM lineitem GROUP BY l_orderkey
  )
)"""


def text_of(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def unit(s: str) -> str:
    """Smallest unit whose repetition is the string."""
    return (
        f"left({s}, coalesce(list_min([n for n in range(1, length({s}) // 2 + 1) "
        f"if length({s}) % n = 0 and repeat(left({s}, n), length({s}) // n) = {s}]), length({s})))"
    )


def weight(s: str) -> str:
    return (
        f"CAST(CASE WHEN length({s}) >= 2 AND repeat(left({s}, 1), length({s})) = {s} THEN "
        f"CASE WHEN length({s}) <= 5 THEN {s} WHEN length({s}) % 3 = 0 THEN left({s}, 3) "
        f"WHEN length({s}) % 2 = 0 THEN left({s}, 2) ELSE left({s}, 3) END "
        f"ELSE {unit(s)} END AS DOUBLE)"
    )


def whole(x: str) -> str:
    return f"CAST({unit(text_of(x))} AS BIGINT)"


def thrice(x: str) -> str:
    return f"repeat({text_of(x)}, 3)"


def grouped(x: str) -> str:
    """12345.67 as 12,345.67."""
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


CENTS = "CAST(total * 100 AS BIGINT)"
FIELDS = f"""
fields AS (
  SELECT k, style, printf('DM%06d.pdf', k) AS file, printf('DM%06d', k) AS invoice_no,
    CASE style WHEN 5 THEN NULL WHEN 3 THEN pallets ELSE {whole('pallets')} END AS pallets,
    CASE style WHEN 3 THEN boxes ELSE {whole('boxes')} END AS boxes,
    CASE style WHEN 5 THEN NULL WHEN 3 THEN {weight(thrice('gross'))} ELSE {weight(text_of('gross'))} END AS gross_weight,
    CASE style WHEN 5 THEN NULL WHEN 3 THEN {weight(thrice('net'))} ELSE {weight(text_of('net'))} END AS net_weight,
    CASE WHEN style <> 5 THEN CAST(total AS DOUBLE)
         WHEN {CENTS} < 1000000 THEN CAST({CENTS} AS DOUBLE) / 1000 END AS total_invoice
  FROM inv
),
rows AS (
  SELECT printf('B%02d', o_custkey % 50) AS batch_id, fields.* EXCLUDE (k, style)
  FROM fields JOIN orders ON k = o_orderkey
)"""
WITH_ROWS = f"WITH {INVOICES}, {FIELDS}"

V17 = f"""
fields AS (
  SELECT k, style, printf('DM%06d.pdf', k) AS file, printf('DM%06d', k) AS invoice_no,
    CASE WHEN style IN (4, 5) THEN NULL WHEN style = 3 THEN pallets ELSE {whole('pallets')} END AS pallets,
    CASE style WHEN 4 THEN NULL WHEN 3 THEN boxes ELSE {whole('boxes')} END AS boxes,
    CASE WHEN style IN (4, 5) THEN NULL WHEN style = 3 THEN CAST({unit(thrice('gross'))} AS DOUBLE)
         ELSE CAST({unit(text_of('gross'))} AS DOUBLE) END AS gross_weight,
    CASE WHEN style <> 2 THEN NULL WHEN total >= 1000000 THEN NULL WHEN total < 1000 THEN CAST(total AS DOUBLE)
         ELSE CAST({CENTS} AS DOUBLE) / 100000 END AS taxable_amount,
    CASE WHEN style IN (0, 1, 3) THEN CAST(total AS DOUBLE)
         WHEN style = 5 AND {CENTS} < 1000000 THEN CAST({CENTS} AS DOUBLE) / 1000
         WHEN style <> 2 OR total >= 1000000 THEN NULL WHEN total < 1000 THEN CAST(total AS DOUBLE)
         ELSE CAST({CENTS} AS DOUBLE) / 100000 END AS total_invoice
  FROM inv
),
rows AS (
  SELECT printf('B%02d', o_custkey % 50) AS batch_id, fields.* EXCLUDE (k, style)
  FROM fields JOIN orders ON k = o_orderkey
)"""
WITH_V17 = f"WITH {INVOICES}, {V17}"


def exact(x: str) -> str:
    return f"coalesce(sum(CAST({x} AS DECIMAL(28,10))), 0)"


def fixed(x: str, places: int) -> str:
    return f"CAST(CAST(round({exact(x)}, {places}) AS DECIMAL(38,{places})) AS VARCHAR)"


SUMS = f"""CAST(coalesce(sum(pallets), 0) AS BIGINT) AS pallets, CAST(coalesce(sum(boxes), 0) AS BIGINT) AS boxes,
  {fixed('gross_weight', 4)} AS gross_weight, {fixed('net_weight', 4)} AS net_weight,
  {fixed('total_invoice', 2)} AS total_invoice"""
TOTAL_ROW = f"""SELECT batch_id, true AS is_total, 'TOTAL' AS file, CAST(NULL AS VARCHAR) AS invoice_no, {SUMS}
  FROM rows GROUP BY batch_id"""

BATCH_SUMMARY = f"""{WITH_ROWS}
SELECT batch_id, count(*) AS count_files, count(gross_weight) AS count_with_gross_weight,
  count(total_invoice) AS count_with_total_invoice, {fixed('gross_weight', 4)} AS total_gross_weight,
  {fixed('total_invoice', 2)} AS total_total_invoice
FROM rows GROUP BY batch_id"""


def summed(x: str, scale: int) -> str:
    """The sum of doubles by their shortest decimal text."""
    return f"CAST(CAST(round(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18))), {scale}) AS DECIMAL(38,{scale})) AS VARCHAR)"


# How a double is written: 191.0, not 191; the amounts stay below 10 million.
def as_java(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


PROSE_CENTS = "((doc_id * 7919 + 100) % 10000000)"
UPLOADS = """
uploads AS (
  SELECT o_custkey * 8 + o_orderkey % 8 AS upload_id, o_orderkey AS ordinal,
    CASE WHEN o_orderkey % 11 = 0 THEN '.txt' WHEN o_orderkey % 11 < 5 THEN '.ZIP' ELSE '.Pdf' END AS ext,
    concat('in/f', o_orderkey, ext) AS filename, o_orderkey % 17 AS length
  FROM orders
),
requests AS (SELECT upload_id FROM uploads UNION SELECT c_custkey * 8 FROM customer)"""
DECIDED = f"""
per_file AS (
  SELECT *,
    CASE WHEN length = 0 THEN '{fv.MSG_EMPTY_FILE}'
         WHEN ext = '.txt' THEN '{fv.MSG_BAD_TYPE[0]}.txt{fv.MSG_BAD_TYPE[1]}' END AS alone,
    CASE WHEN length = 0 THEN concat('{fv.MSG_EMPTY_AMONG_SEVERAL}', filename)
         WHEN ext <> '.Pdf' THEN concat('{fv.MSG_NOT_PDF_AMONG_SEVERAL}', filename) END AS among
  FROM uploads
),
per_upload AS (
  SELECT upload_id, count(*) AS files, min(ext) AS ext, min(alone) AS alone,
         arg_min(among, ordinal) FILTER (WHERE among IS NOT NULL) AS among
  FROM per_file GROUP BY upload_id
),
judged AS (
  SELECT r.upload_id, files, ext,
    CASE WHEN files IS NULL THEN '{fv.MSG_NO_FILES}'
         WHEN files > 1 THEN among
         WHEN alone IS NOT NULL THEN alone
         WHEN ext = '.ZIP' AND r.upload_id % 5 = 0 THEN '{fv.MSG_NOT_A_ZIP}'
         WHEN ext = '.ZIP' AND r.upload_id % 7 = 0 THEN '{fv.MSG_ZIP_ESCAPE}'
         WHEN ext = '.ZIP' AND r.upload_id % 4 = 0 THEN '{fv.MSG_ZIP_WITHOUT_PDF}' END AS reason
  FROM requests r LEFT JOIN per_upload p ON r.upload_id = p.upload_id
),
decided AS (
  SELECT upload_id, reason IS NULL AS accepted,
    CAST(CASE WHEN reason IS NOT NULL THEN 0 WHEN files = 1 AND ext = '.ZIP' THEN upload_id % 4 ELSE files END AS BIGINT) AS extracted_pdfs,
    reason
  FROM judged
)"""
MEMBERS = """
members AS (
  SELECT page_id, CAST(floor(page_id / 6) AS BIGINT) AS archive,
    page_id % 8 IN (0, 2, 3, 6) AND NOT ends_with(url, '/') AS counted, page_id % 8 IN (2, 3, 7) AS escapes
  FROM pages
)"""
LOG = """
log AS (
  SELECT user_id AS batch_id, event_id AS seq, ts,
    CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' ELSE 'PROCESSING' END AS state,
    CASE event_type WHEN 'signup' THEN 'WAITING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'emailing' ELSE 'RUNNING_EXTRACTOR' END AS stage,
    CAST(event_id % 5 AS INTEGER) AS total_files, CAST(event_id % 7 AS INTEGER) AS processed_files, event_type AS message
  FROM events
),
latest AS (
  SELECT batch_id, state, stage, total_files, processed_files, message, started_at, ts AS updated_at
  FROM (SELECT *, min(ts) OVER (PARTITION BY batch_id) AS started_at,
               row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, seq DESC) AS newest FROM log)
  WHERE newest = 1
)"""
EVENT_FILES = """
files AS (
  SELECT concat('u', user_id) AS batch_id, user_id, ts,
    CASE event_type WHEN 'signup' THEN '_DONE' WHEN 'error' THEN concat('sub/', event_id, '.PDF')
      WHEN 'view' THEN 'sub/_DONE' ELSE concat('sub/', event_id, '.pdf') END AS rel_path
  FROM events
)"""
# No percent by file count: a figure for the stage.
def percent(stage_of_view: str, stage_of_other: str) -> str:
    return f"""CAST(CASE WHEN total_files > 0 THEN least(100, floor(processed_files / total_files * 100 + 0.5))
      ELSE CASE state WHEN 'UPLOADED' THEN 5 WHEN 'DONE' THEN 100 WHEN 'ERROR' THEN 100
      ELSE CASE stage WHEN 'emailing' THEN {stage_of_view} ELSE {stage_of_other} END END END AS INTEGER)"""


# Fields found in a text that holds only these.
def found(**values: str) -> str:
    listed = ", ".join(f"{v} AS {n}" for n, v in values.items())
    return f"WITH {INVOICES} SELECT k, {listed} FROM inv"


TOTAL = "CAST(total AS DOUBLE)"
LAYERED = f"repeat({text_of('pallets')}, CAST(k % 3 + 1 AS BIGINT))"
SAME_DIGIT = "repeat(CAST(k % 10 AS VARCHAR), boxes)"
ORDER_AMOUNT = "CAST(o_totalprice AS DECIMAL(18,2))"
ORDER_KEY = text_of("o_orderkey")
EU_V17 = f"""CASE WHEN {ORDER_AMOUNT} < 1000 THEN CAST({ORDER_AMOUNT} AS DOUBLE) WHEN {ORDER_AMOUNT} < 1000000
  THEN CAST(CAST({ORDER_AMOUNT} * 100 AS BIGINT) AS DOUBLE) / 100000 END"""

PAGE_FILES = """
files AS (
  SELECT page_id, page_id % 6 AS kind,
    CASE WHEN page_id % 6 = 5 THEN concat('m', page_id) ELSE concat('b', page_id % 20) END AS batch_id,
    CASE page_id % 6 WHEN 0 THEN concat(page_id, '.pdf') WHEN 1 THEN concat('_', page_id, '.pdf') WHEN 2 THEN concat('.x/', page_id, '.PDF')
      WHEN 3 THEN concat('sub/', page_id, '.pdf') WHEN 4 THEN concat(page_id, '.txt') ELSE '_DONE' END AS rel_path,
    CASE WHEN page_id % 6 IN (3, 5) THEN '' ELSE coalesce(html, '') END AS text
  FROM pages
)"""

ARCHIVE_EXPANSION = """
SELECT CAST(page_id AS VARCHAR) AS archive, concat('in/', page_id, '.pdf') AS member_name, strlen(html) AS size, html AS text
FROM pages WHERE page_id % 9 <> 0
UNION ALL
SELECT CAST(page_id AS VARCHAR), concat('more/', page_id, '.PDF'), strlen(left(html, length(html) // 2)), left(html, length(html) // 2)
FROM pages WHERE page_id % 9 <> 0 AND page_id % 2 = 1"""

ORACLES = {
    "invoice_fields": f"{WITH_ROWS} SELECT * FROM rows",
    "page_fields": f"{WITH_ROWS} SELECT * FROM rows",
    "document_fields": f"""
SELECT doc_id, lang AS batch_id, printf('DM%06d.pdf', doc_id) AS file, printf('DM%06d', doc_id) AS invoice_no,
  {whole('(doc_id % 40 + 1)')} AS pallets, {whole('(doc_id % 23 + 1)')} AS boxes,
  {weight(text_of('(doc_id % 977 + 10)'))} AS gross_weight, {weight(text_of('(doc_id % 97 + 10)'))} AS net_weight,
  {PROSE_CENTS} / 100.0::DOUBLE AS total_invoice
FROM documents""",
    "page_assembly": """SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
    "normalise_text": "SELECT doc_id, md5(text) AS digest, length(text) AS chars FROM documents",
    "selected_documents": """
WITH docs AS (
  SELECT o_orderkey % 5 = 0 AS cmr, o_orderkey % 3 <> 0 AS small, o_orderkey % 3 = 0 OR o_orderkey % 11 <> 0 AS pdf,
    concat(CASE WHEN o_orderkey % 5 = 0 THEN 'CMR' WHEN o_orderkey % 7 = 0 THEN 'cmr' ELSE 'DM' END, o_orderkey,
      CASE WHEN o_orderkey % 3 = 0 THEN '.PDF' WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.pdf' END) AS file
  FROM orders
)
SELECT 'live' AS rule, file FROM docs WHERE pdf
UNION ALL SELECT 'strict', file FROM docs WHERE pdf AND small
UNION ALL SELECT 'v17', file FROM docs WHERE pdf AND NOT cmr""",
    "rejected_documents": """
SELECT lang AS batch_id, CASE WHEN doc_id % 7 = 0 OR text IS NULL THEN 'unreadable text' WHEN doc_id % 13 = 0 THEN 'no file name'
  ELSE 'kept' END AS reason, count(*) AS documents
FROM documents GROUP BY ALL""",
    "invoice_no_from_file": r"""
SELECT o_orderkey, upper(regexp_replace(concat('inv ', o_orderpriority, '_', o_orderkey, 'v2'), '[^A-Za-z0-9_-]+', '', 'g')) AS invoice_no
FROM orders""",
    "int_after_label": found(pallets=whole("pallets"), boxes=whole("boxes")),
    "int_repeated_layers": found(boxes=f"""CAST(CASE WHEN k % 4 > 0 AND length({LAYERED}) % (k % 4 + 1) = 0
  THEN left({LAYERED}, length({LAYERED}) // (k % 4 + 1)) ELSE {unit(LAYERED)} END AS BIGINT)"""),
    "weight_after_label": found(gross_weight=weight(text_of("gross")), net_weight=weight(text_of("net"))),
    "weight_same_digit": found(gross_weight=weight(SAME_DIGIT)),
    "float_after_label": found(amount=TOTAL),
    "float_before_marker": found(amount=TOTAL),
    "total_tier1": found(total_invoice=TOTAL),
    "total_tier2": found(total_invoice=TOTAL),
    "total_tier3": found(total_invoice=TOTAL),
    "total_tier4": found(total_invoice=TOTAL),
    "total_cascade": found(total_invoice=f"CASE WHEN k % 5 < 4 THEN {TOTAL} END"),
    "euro_amounts_last": found(amount=f"""CASE WHEN k % 3 <> 0 THEN {TOTAL}
  ELSE CAST({unit(text_of('boxes'))} AS DOUBLE) END"""),
    "reduce_repetition": f"""
SELECT p_partkey, {unit('s')} AS unit
FROM (SELECT p_partkey, repeat(CAST(p_size AS VARCHAR), p_partkey % 4 + 1) AS s FROM part)""",
    "number_tokens": f"""
SELECT o_orderkey, CAST({ORDER_AMOUNT} AS DOUBLE) AS plain, plain AS us, plain AS eu, plain AS layered,
  CAST({unit(ORDER_KEY)} AS DOUBLE) AS whole, true AS cents
FROM orders""",
    "weight_tokens": f"""
SELECT o_orderkey, {weight(ORDER_KEY)} AS once, {weight(ORDER_KEY)} AS blank, {weight(f'repeat({ORDER_KEY}, 2)')} AS twice
FROM orders""",
    "amount_tokens_v17": f"""
SELECT o_orderkey, CAST({ORDER_AMOUNT} AS DOUBLE) AS us, {EU_V17} AS eu, us AS comma FROM orders""",
    "batch_totals": f"{WITH_ROWS} SELECT batch_id, count(*) AS count_files, {SUMS} FROM rows GROUP BY batch_id",
    "grand_totals": f"{WITH_ROWS} SELECT count(*) AS count_files, {SUMS} FROM rows",
    "batch_summary": BATCH_SUMMARY,
    "batch_report": f"""{WITH_ROWS}
SELECT batch_id, is_total, file, invoice_no, pallets, boxes, gross_weight, net_weight, total_invoice
FROM (
  SELECT batch_id, false AS is_total, file, invoice_no, pallets, boxes, {as_java('gross_weight')} AS gross_weight,
    {as_java('net_weight')} AS net_weight, {as_java('total_invoice')} AS total_invoice FROM rows
  UNION ALL {TOTAL_ROW}
)""",
    "batch_report_total_row": f"{WITH_ROWS} {TOTAL_ROW}",
    "batch_report_v17": f"""{WITH_V17}
SELECT batch_id, false AS is_total, file, invoice_no, pallets, boxes, {as_java('gross_weight')} AS gross_weight,
  {as_java('taxable_amount')} AS taxable_amount, {as_java('total_invoice')} AS total_invoice FROM rows
UNION ALL
SELECT batch_id, true AS is_total, 'TOTAL' AS file, CAST(NULL AS VARCHAR) AS invoice_no,
  CAST(coalesce(sum(pallets), 0) AS BIGINT) AS pallets, CAST(coalesce(sum(boxes), 0) AS BIGINT) AS boxes,
  {fixed('gross_weight', 4)} AS gross_weight, {fixed('taxable_amount', 2)} AS taxable_amount,
  {fixed('total_invoice', 2)} AS total_invoice
FROM rows GROUP BY batch_id""",
    "exact_totals": f"""
SELECT printf('B%02d', o_custkey % 50) AS batch_id, count(*) AS count_files, count(*) AS pallets, 2 * count(*) AS boxes,
  {summed('o_totalprice / 3', 4)} AS gross_weight, {summed('o_totalprice / 7e6', 4)} AS net_weight,
  {summed('o_totalprice * 1e7 / 3', 2)} AS total_invoice
FROM orders GROUP BY o_custkey % 50""",
    "large_counts": f"""WITH {INVOICES}
SELECT k, concat('12345678901234567890', k) AS pallets, concat('98765432109876543210', k) AS boxes FROM inv""",
    "large_count_totals": f"""WITH {INVOICES}
SELECT printf('B%02d', o_custkey % 50) AS batch_id, count(*) AS count_files,
  CAST(sum(CAST(concat('12345678901234567890', k) AS DECIMAL(38,0))) AS VARCHAR) AS pallets,
  CAST(sum(CAST(concat('98765432109876543210', k) AS DECIMAL(38,0))) AS VARCHAR) AS boxes
FROM inv JOIN orders ON k = o_orderkey GROUP BY o_custkey % 50""",
    "detail_json_roundtrip": f"""{WITH_ROWS}
SELECT batch_id, file, invoice_no, pallets, boxes, gross_weight, net_weight, total_invoice FROM rows""",
    "summary_json_roundtrip": BATCH_SUMMARY,
    "rejected_roundtrip": """
SELECT source AS batch_id, CASE WHEN doc_id % 13 = 0 THEN '/' ELSE printf('DM%06d.pdf', doc_id) END AS file,
  CASE WHEN doc_id % 7 = 0 OR text IS NULL THEN 'unreadable text' ELSE 'no file name' END AS reason, count(*) AS documents
FROM documents WHERE doc_id % 7 = 0 OR doc_id % 13 = 0 OR text IS NULL GROUP BY ALL""",
    "admission_decision": f"WITH {UPLOADS}, {DECIDED} SELECT * FROM decided",
    "selection_precheck": f"""WITH {UPLOADS},
per_upload AS (
  SELECT upload_id, count(*) AS files, bool_or(ext = '.ZIP') AS has_zip,
    arg_min(filename, ordinal) FILTER (WHERE ext = '.txt') AS bad_name
  FROM uploads GROUP BY upload_id
)
SELECT r.upload_id, CASE WHEN files IS NULL THEN '{fv.MSG_SELECT_NONE}'
  WHEN files > 1 AND has_zip THEN '{fv.MSG_SELECT_ZIP_AMONG_SEVERAL}'
  WHEN bad_name IS NOT NULL THEN concat('{fv.MSG_SELECT_BAD_TYPE[0]}', bad_name, '{fv.MSG_SELECT_BAD_TYPE[1]}') END AS reason
FROM requests r LEFT JOIN per_upload p ON r.upload_id = p.upload_id""",
    "upload_responses": f"""WITH {UPLOADS}, {DECIDED}
SELECT concat('b', upload_id) AS batch_id, extracted_pdfs, concat('/api/batches/b', upload_id, '/status') AS status_url
FROM decided WHERE accepted""",
    "last_of_each_name": """
SELECT o_custkey AS upload_id, concat(o_orderpriority, '.pdf') AS file, max(o_orderkey) AS ordinal,
  arg_max(concat('d', o_orderkey % 3, '/', o_orderpriority, '.pdf'), o_orderkey) AS filename,
  arg_max(o_totalprice, o_orderkey) AS length
FROM orders GROUP BY o_custkey, o_orderpriority""",
    "archive_members": f"WITH {MEMBERS} SELECT page_id, counted, escapes FROM members",
    "archive_verdicts": f"""WITH {MEMBERS}
SELECT archive, true AS is_zip, bool_or(counted AND escapes) AS escapes, count(*) FILTER (WHERE counted) AS pdfs
FROM members GROUP BY archive""",
    "archive_expansion": ARCHIVE_EXPANSION,
    "archive_validity": """
SELECT CAST(page_id AS VARCHAR) AS archive, page_id % 9 <> 0 AS is_zip, false AS escapes,
  CAST(CASE WHEN page_id % 9 = 0 THEN 0 ELSE 1 + page_id % 2 END AS BIGINT) AS pdfs
FROM pages""",
    "batch_activity": f"""WITH {EVENT_FILES}
SELECT batch_id, count(*) AS files, count(*) FILTER (WHERE ends_with(rel_path, '.pdf')) AS total_files,
  max(ts) AS last_change, bool_or(rel_path = '_DONE') AS has_marker
FROM files GROUP BY batch_id""",
    "batch_ready": f"""WITH {EVENT_FILES}
SELECT batch_id, bool_or(rel_path = '_DONE' AND user_id % 3 <> 0) OR TIMESTAMP '2024-01-31 00:00:00' - max(ts) >= INTERVAL 6 HOUR AS ready
FROM files GROUP BY batch_id""",
    "batch_sessions": """
WITH paused AS (
  SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS starts, event_id
  FROM events
),
numbered AS (
  SELECT user_id, ts, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM paused
)
SELECT user_id AS batch_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS files
FROM numbered GROUP BY user_id, session_no""",
    "batch_id_roundtrip": """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S_') AS time_part, date_trunc('second', o_orderdate) AS created,
  true AS well_formed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso
FROM orders""",
    "path_sort_rank": """
SELECT page_id, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS ord FROM pages""",
    "status_latest": f"WITH {LOG} SELECT * FROM latest",
    "status_first_start": """
SELECT user_id AS batch_id, event_id AS seq, min(ts) OVER (PARTITION BY user_id) AS started_at FROM events""",
    "status_with_default": f"""WITH {LOG}
SELECT c_custkey AS batch_id, coalesce(state, 'PENDING') AS state, coalesce(stage, 'WAITING') AS stage,
  coalesce(total_files, 0) AS total_files, coalesce(processed_files, 0) AS processed_files, started_at,
  coalesce(updated_at, TIMESTAMP '2024-01-31 00:00:00') AS updated_at,
  CASE WHEN state IS NULL THEN '' ELSE 'a@x' END AS recipients, coalesce(message, '{fv.MSG_PENDING}') AS message
FROM customer LEFT JOIN latest ON c_custkey = batch_id""",
    "status_seed_missing": f"""
SELECT o_custkey AS batch_id, 'UPLOADED' AS state, 'WAITING' AS stage, CAST(count(*) AS INTEGER) AS total_files,
  CAST(0 AS INTEGER) AS processed_files, TIMESTAMP '2024-01-31 00:00:00' AS started_at,
  TIMESTAMP '2024-01-31 00:00:00' AS updated_at, 'a@x,b@x' AS recipients, '{fv.MSG_UPLOADED}' AS message
FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey""",
    "status_progress": f"""WITH {LOG}
SELECT seq AS event_id, {percent('85', '10')} AS percent, {percent('85', '55')} AS percent_aliased,
  CAST(CASE WHEN total_files > 0 THEN floor(processed_files / total_files * 100 + 0.5) ELSE 0 END AS INTEGER) AS percent_uncapped
FROM log""",
    "status_terminal": f"""WITH {LOG}
SELECT batch_id, state IN ('DONE', 'ERROR') AS terminal, terminal AS terminal_state,
  concat('/api/batches/', batch_id, '/status') AS status_url
FROM latest""",
    "recipients": """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat(c_name, '@x|', c_mktsegment) END AS recipients,
  CAST(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n
FROM customer""",
    "notification_rows": """
SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, concat('[Test] Lote procesado: ', o_orderkey) AS subject,
  concat('Lote ', o_orderkey, ' procesado correctamente.', chr(10), 'Adjuntos: r.JSON, r.csv, r.xlsx, r.bin') AS body,
  CASE WHEN o_orderkey % 4 = 1 THEN 'own@example' ELSE 'a@example|b@example' END AS recipients,
  'r.JSON=application/json|r.csv=text/csv|r.xlsx=application/vnd.openxmlformats-officedocument.spreadsheetml.sheet|r.bin=application/octet-stream' AS attachments
FROM orders WHERE o_orderkey % 4 <> 0""",
    "v17_fields": f"{WITH_V17} SELECT batch_id, file, invoice_no, pallets, boxes, gross_weight, taxable_amount, total_invoice FROM rows",
    "v17_invoice_no": """
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN concat('DM', s) WHEN 1 THEN concat('inv-', s) WHEN 2 THEN printf('%08d', o_orderkey)
  WHEN 3 THEN concat('A-', s, '/x') WHEN 4 THEN concat('inv-', s) WHEN 5 THEN concat('DM', s)
  WHEN 6 THEN concat('F', s) WHEN 7 THEN concat('inv-', s) END AS invoice_no
FROM (SELECT o_orderkey, printf('%06d', o_orderkey) AS s FROM orders)""",
    "v17_taxable": f"""WITH {INVOICES}
SELECT k, CASE WHEN k % 5 < 4 OR k % 2 = 0 THEN {TOTAL} END AS taxable_amount,
  CASE k % 5 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN {TOTAL} END
    WHEN 1 THEN CASE WHEN k % 2 = 0 THEN {TOTAL} END
    WHEN 2 THEN CAST({unit(text_of('gross'))} AS DOUBLE)
    WHEN 3 THEN {TOTAL} ELSE CASE WHEN k % 2 = 0 THEN {TOTAL} END END AS total_invoice
FROM inv""",
    "v17_max_euro": found(amount=f"greatest({TOTAL}, 99.5)"),
    "v17_labels": found(gross_weight=TOTAL, boxes=whole("pallets")),
    "stream_closed_batches": """
SELECT CAST(user_id AS VARCHAR) AS batch_id, CASE WHEN bool_or(marker) THEN 'marker' ELSE 'quiet' END AS reason,
  count(*) AS files, count(*) FILTER (WHERE NOT marker AND event_type <> 'error') AS total_files,
  epoch_us(max(ts)) AS last_change, epoch_us(date_trunc('hour', min(ts))) AS first_landed,
  epoch_us(date_trunc('hour', max(ts))) AS last_landed
FROM (SELECT *, event_type = 'signup' AND event_id % 29 = 0 AS marker FROM events) GROUP BY user_id""",
    "stream_sessions": """
WITH paused AS (
  SELECT user_id, event_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS starts
  FROM events
),
numbered AS (
  SELECT user_id, ts, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM paused
)
SELECT user_id AS batch_id, count(*) AS files, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS last_change
FROM numbered GROUP BY user_id, session_no
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_status": f"""WITH {LOG}
SELECT batch_id, seq, state, stage, ts AS updated_at FROM log WHERE state IN ('DONE', 'ERROR')""",
    "inbox_scan": f"WITH {PAGE_FILES} SELECT batch_id, rel_path, strlen(text) AS size FROM files",
    "inbox_batches": f"""WITH {PAGE_FILES}
SELECT batch_id, count(*) AS files, count(*) FILTER (WHERE kind IN (0, 1, 3)) AS total_files, bool_or(kind = 5) AS has_marker
FROM files GROUP BY batch_id""",
    "inbox_documents": f"""WITH {PAGE_FILES}
SELECT batch_id, rel_path AS file, CASE WHEN text <> '' THEN md5(replace(text, chr(12), chr(10))) END AS digest,
  CASE WHEN text = '' THEN 'unreadable text' END AS reason
FROM files WHERE kind IN (0, 1, 3)""",
    "inbox_resend": f"""WITH {PAGE_FILES}
SELECT batch_id, rel_path, strlen(text) + 1 AS size FROM files WHERE page_id % 5 = 0""",
    "batch_run": f"""{WITH_ROWS},
documents AS (
  SELECT *, CAST(replace(invoice_no, 'DM', '') AS BIGINT) % 11 = 0 AS empty, CAST(batch_id[2:] AS BIGINT) % 3 = 0 AS marked FROM rows
)
SELECT batch_id, 'processed' AS outcome, CASE WHEN bool_or(marked) THEN 'marker' ELSE 'quiet' END AS reason, count(*) AS total_files,
  count(*) FILTER (WHERE empty) AS rejected_files, CAST(NULL AS VARCHAR) AS error, true AS notified, 'DONE' AS state,
  CAST(count(*) AS INTEGER) AS processed_files, count(*) FILTER (WHERE NOT empty) AS count_files,
  CAST(CAST(round(coalesce(sum(CAST(total_invoice AS DECIMAL(28,10))) FILTER (WHERE NOT empty), 0), 2) AS DECIMAL(38,2)) AS VARCHAR) AS total_total_invoice
FROM documents GROUP BY batch_id
UNION ALL
SELECT concat('N', n_nationkey), 'error', 'marker', 0, 0, 'Extractor falló (rc=2).', false, 'ERROR', 0, NULL, NULL FROM nation""",
    "upload_decisions": f"""
SELECT CAST(page_id AS VARCHAR) AS upload_id, page_id % 7 IN (0, 1, 5) AS accepted,
  CAST(CASE WHEN page_id % 7 < 2 THEN 2 WHEN page_id % 7 = 5 THEN 1 ELSE 0 END AS BIGINT) AS extracted_pdfs,
  CASE page_id % 7 WHEN 2 THEN '{fv.MSG_ZIP_ESCAPE}' WHEN 3 THEN '{fv.MSG_ZIP_WITHOUT_PDF}' WHEN 4 THEN '{fv.MSG_NOT_A_ZIP}'
    WHEN 6 THEN '{fv.MSG_EMPTY_FILE}' END AS reason
FROM pages""",
    "upload_documents": """
SELECT CAST(page_id AS VARCHAR) AS upload_id, CASE WHEN page_id % 7 < 2 THEN 'first.pdf' ELSE concat(page_id, '.pdf') END AS file,
  CASE WHEN page_id % 7 < 2 THEN 'b/first.pdf' ELSE concat('up/', page_id, '.pdf') END AS filename,
  CAST(strlen(coalesce(html, '')) + 1 AS INTEGER) AS size, md5(concat(coalesce(html, ''), '.')) AS digest
FROM pages WHERE page_id % 7 IN (0, 1, 5)""",
    "report_csv_roundtrip": f"""{WITH_ROWS},
lines AS (
  SELECT batch_id, false AS is_total, concat(right(invoice_no, 1), '/', file) AS path, file, invoice_no, pallets, boxes,
    {as_java('gross_weight')} AS gross_weight, {as_java('net_weight')} AS net_weight, {as_java('total_invoice')} AS total_invoice FROM rows
  UNION ALL SELECT batch_id, true, NULL, file, invoice_no, pallets, boxes, gross_weight, net_weight, total_invoice FROM ({TOTAL_ROW})
)
SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY is_total, string_split(path, '/')) AS line_no,
  file, invoice_no, pallets, boxes, gross_weight, net_weight, total_invoice FROM lines""",
    "rerun_replaces": f"""{WITH_ROWS}, numbered AS (SELECT batch_id, CAST(replace(invoice_no, 'DM', '') AS BIGINT) AS k FROM rows)
SELECT batch_id, CAST(2 AS BIGINT) AS epoch, count(*) AS total_files, count(*) FILTER (WHERE k % 7 = 0 AND k % 14 <> 0) AS rejected_files,
  count(*) FILTER (WHERE k % 7 = 0) AS rejected_before, count(*) FILTER (WHERE k % 7 <> 0 OR k % 14 = 0) AS rows,
  rejected_files AS rejected, 'DONE' AS state, true AS start_kept
FROM numbered GROUP BY batch_id""",
    "one_failing_batch": f"""{WITH_ROWS}
SELECT batch_id, 'processed' AS outcome, count(*) AS total_files, CAST(NULL AS VARCHAR) AS error, CAST(1 AS INTEGER) AS runs, 'DONE' AS state,
  '{fv.MSG_DONE}' AS message FROM rows GROUP BY batch_id
UNION ALL
SELECT concat('R', r_regionkey), 'error', 0, 'listing failed: NotADirectoryError', 1, 'ERROR',
  '{fv.MSG_ERROR_PREFIX}listing failed: NotADirectoryError' FROM region""",
    "status_snapshot": f"""WITH {LOG},
reads AS (
  SELECT user_id, CAST(count(*) FILTER (WHERE event_id % 5 = 4) + CAST(bool_or(event_id % 5 < 4) AS INTEGER) AS BIGINT) AS rows_read
  FROM events GROUP BY user_id
)
SELECT CAST(batch_id AS VARCHAR) AS batch_id, state, stage, total_files, processed_files, message, rows_read, started_at, updated_at
FROM latest JOIN reads ON user_id = batch_id""",
    "status_documents": """
WITH last AS (
  SELECT user_id, arg_max(event_id, (ts, event_id)) AS e, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id
)
SELECT CASE WHEN user_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS batch_id,
  CASE WHEN user_id % 7 <> 0 THEN CASE WHEN kind = 'purchase' THEN 'DONE' ELSE 'PROCESSING' END END AS state,
  CAST(CASE WHEN user_id % 7 <> 0 THEN e % 5 END AS INTEGER) AS total_files,
  CAST(CASE WHEN user_id % 7 <> 0 THEN e % 3 END AS INTEGER) AS processed_files,
  CASE WHEN user_id % 7 <> 0 THEN kind END AS message,
  CASE WHEN user_id % 7 = 0 THEN trim(concat('{"batch_id": "', user_id, '", "state": ')) END AS raw
FROM last""",
    "given_paths": """
WITH page AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS folder, page_id % 4 = 0 AS upper_case,
    concat(page_id, CASE WHEN page_id % 4 = 0 THEN '.PDF' ELSE '.pdf' END) AS file, page_id % 50 + 1 AS length
  FROM pages WHERE page_id % 4 <> 1 AND page_id % 8 <> 3
),
given AS (
  SELECT i AS input_no, concat(folder, '/', file) AS name, length, upper_case
  FROM page JOIN (VALUES (0, 'a'), (1, 'b'), (2, 'a')) AS v(i, f) ON folder = f
  UNION ALL
  SELECT i, concat('c/n', n_nationkey, '.Pdf'), strlen(n_name), false FROM nation JOIN (VALUES (4, 6), (5, 12)) AS v(i, n) ON n_nationkey = n
)
SELECT CAST(input_no AS INTEGER) AS input_no, name, length, row_number() OVER (ORDER BY input_no, upper_case, string_split(name, '/')) AS ord FROM given""",
    "unit_suffix": """
SELECT p_partkey, regexp_replace(concat(p_size, CASE p_partkey % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'KGS' WHEN 2 THEN 'g' WHEN 3 THEN ' kG'
  WHEN 4 THEN 'lb' ELSE 'kg5' END), '(?i)(kg|kgs|g)$', '') AS stripped FROM part""",
    "notification_gate": """
SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, concat(CASE WHEN o_orderkey % 5 = 0 THEN '[P] ' ELSE '' END, 'Lote procesado: ', o_orderkey) AS subject,
  CASE WHEN o_orderkey % 5 = 0 THEN 'nothing' ELSE 'subject_prefix' END AS without
FROM orders WHERE o_orderkey % 5 IN (0, 4)""",
    "inbox_versions": f"""WITH {PAGE_FILES}
SELECT batch_id, rel_path, strlen(text) AS size, CAST(0 AS BIGINT) AS epoch FROM files
UNION ALL SELECT batch_id, rel_path, strlen(text) + 1, 1 FROM files WHERE page_id % 5 = 0
UNION ALL SELECT batch_id, rel_path, strlen(text), 4 FROM files WHERE batch_id = 'b7'""",
    "archive_ranges": ARCHIVE_EXPANSION,
    "stream_waiters": """
WITH mark AS (
  SELECT least(max(ts) FILTER (WHERE event_type = 'signup'), max(ts) FILTER (WHERE event_type IN ('purchase', 'error'))) - INTERVAL 1 HOUR AS w
  FROM events
),
answered AS (
  SELECT a.event_id AS waiter, a.user_id AS batch_id, a.ts AS asked_at, arg_min(e.event_type, (e.ts, e.event_type)) AS state, min(e.ts) AS ended_at
  FROM events a LEFT JOIN events e ON e.user_id = a.user_id AND e.event_type IN ('purchase', 'error')
    AND e.ts >= a.ts AND e.ts <= a.ts + INTERVAL 24 HOUR
  WHERE a.event_type = 'signup' GROUP BY a.event_id, a.user_id, a.ts
)
SELECT waiter, batch_id, CASE WHEN state IS NULL THEN 'timeout' ELSE 'ended' END AS answer, state, epoch_us(ended_at) AS ended_at
FROM answered, mark WHERE asked_at + INTERVAL 24 HOUR < w""",
    "stream_findings": """
WITH change AS (
  SELECT CAST(user_id AS VARCHAR) AS batch_id, event_id AS seq, epoch_us(ts) AS t,
    CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' ELSE 'PROCESSING' END AS state,
    CASE event_type WHEN 'signup' THEN 'WAITING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'SENDING_EMAIL'
      ELSE 'RUNNING_EXTRACTOR' END AS stage
  FROM events
),
pair AS (
  SELECT *, lag(state) OVER w AS from_state, lag(stage) OVER w AS from_stage, lag(t) OVER w AS since, lead(t) OVER w AS next
  FROM change WINDOW w AS (PARTITION BY batch_id ORDER BY t, seq)
),
mark AS (SELECT epoch_us(max(ts) - INTERVAL 1 HOUR) AS w FROM events)
SELECT batch_id, 'unknown transition' AS finding, from_state, from_stage, state AS to_state, stage AS to_stage, since, t AS "at", seq FROM pair
WHERE concat(coalesce(from_stage, 'new'), '>', stage) NOT IN (
  'new>WAITING', 'new>RUNNING_EXTRACTOR', 'new>ERROR', 'WAITING>RUNNING_EXTRACTOR', 'WAITING>ERROR', 'RUNNING_EXTRACTOR>SENDING_EMAIL',
  'RUNNING_EXTRACTOR>ERROR', 'SENDING_EMAIL>DONE', 'SENDING_EMAIL>ERROR', 'DONE>RUNNING_EXTRACTOR', 'DONE>WAITING',
  'ERROR>RUNNING_EXTRACTOR', 'ERROR>WAITING')
UNION ALL
SELECT batch_id, 'stuck', state, stage, NULL, NULL, t, t + 129600000000, seq FROM pair, mark
WHERE state NOT IN ('DONE', 'ERROR') AND coalesce(next, w) - t >= 129600000000""",
}
