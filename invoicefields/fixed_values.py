"""Values that must be exactly these for the results to agree with existing data and clients.

Everything here is a fixed value: labels printed on the invoices, column orders, file names,
states, and the message texts that clients of the service already show.
"""

# --- fixed values: labels on the invoices (regular expressions, tried in this order) ---------
PALLET_LABELS = [r"Pallets", r"Nombre\s+de\s+Palettes"]
BOX_LABELS = [r"Boxes"]
GROSS_LABELS = [r"Gross\s+Weight", r"Poid\s+brute", r"Poids\s+brut", r"Poids\s+brute"]
NET_LABELS = [r"Net\s+Weight", r"NetWeight", r"Poids\s+net", r"Poid\s+net"]

# --- fixed values: labels of the earlier version (literal text) ------------------------------
V17_PALLET_LABELS = ["Pallets", "Nombre de Palettes"]
V17_BOX_LABELS = ["Boxes", "Nombre de Colis"]
V17_GROSS_LABELS = ["Gross Weight", "Poid brute", "Poids brut"]
V17_TAXABLE_LABELS = ["Taxable Amount", "Total HT"]
V17_TOTAL_LABELS = ["Total Facture en Euro", "Total TTC"]
V17_TAXABLE_MARKER = r"Vat\s*%"
V17_SIMPLE_TOTAL_TEXT = "Total Facture"
V17_SIMPLE_NUMBER_PREFIX = "inv-"

# --- fixed values: invoice number patterns of the earlier version, tried in this order --------
V17_NUMBER_PATTERNS = [
    r"\bInvoice\s*Number\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{2,})\b",
    r"\bInvoice\s*No\.?\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{2,})\b",
    r"\bInvoice\b[\s\S]{0,60}?\bNumber\s*[:#]?\s*(\d{6,})\b",
    r"\bInvoice\s*:\s*Date\s*:\s*\n\s*([A-Za-z0-9][A-Za-z0-9\-_/]{2,})\b",
    r"\bInvoice\s*:\s*([A-Za-z0-9][A-Za-z0-9\-_/]{2,})\b",
    r"\bN\s*(?:º|°|o)?\s*Facture\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{2,})\b",
    r"\bNum(?:e|é)ro\s*Facture\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{2,})\b",
]
V17_NUMBER_STOP_WORDS = ["invoice", "date", "number"]

# --- fixed values: characters removed from or blanked in page text ---------------------------
BLANKED_CHARACTERS = "\u00a0\u202f"
DELETED_CHARACTERS = (
    "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
    "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
)

# The first UTF-8 bytes of all of these.
MARK_LEAD_BYTES = [b"\xc2\xa0", b"\xe2\x80", b"\xe2\x81", b"\xef\xbb\xbf"]

# --- fixed values: how far around the French total label amounts are looked for --------------
EURO_WINDOW = 250

# --- fixed values: report columns and names --------------------------------------------------
REPORT_COLUMNS = ["file", "invoice_no", "pallets", "boxes", "gross_weight", "net_weight", "total_invoice"]
V17_REPORT_COLUMNS = [
    "file", "invoice_no", "pallets", "boxes", "gross_weight", "taxable_amount", "total_invoice",
]
TOTAL_ROW_NAME = "TOTAL"
WEIGHT_SCALE = 4
MONEY_SCALE = 2
CMR_PREFIX = "CMR"
DONE_MARKER = "_DONE"

# --- fixed values: states and stages of a batch ----------------------------------------------
STATE_PENDING, STATE_UPLOADED, STATE_PROCESSING = "PENDING", "UPLOADED", "PROCESSING"
STATE_DONE, STATE_ERROR = "DONE", "ERROR"
STAGE_WAITING, STAGE_EXTRACTOR, STAGE_EMAIL = "WAITING", "RUNNING_EXTRACTOR", "SENDING_EMAIL"
STAGE_PERCENT = {"WAITING": 5, "EXTRACTING": 55, "EMAILING": 85, "DONE": 100, "ERROR": 100}
STAGE_PERCENT_OTHER = 10
STAGE_ALIASES = {"RUNNING_EXTRACTOR": "EXTRACTING", "SENDING_EMAIL": "EMAILING"}

# --- fixed values: status messages -----------------------------------------------------------
MSG_PENDING = "Sin estado aún (pendiente)."
MSG_UPLOADED = "Lote subido. En espera de procesamiento."
MSG_PROCESSING = "Procesando lote..."
MSG_EMAIL = "Extractor OK. Enviando email..."
MSG_DONE = "Lote procesado y email enviado."
MSG_ERROR_PREFIX = "Error procesando lote: "

# --- fixed values: upload answers ------------------------------------------------------------
MSG_NO_FILES = "No se recibieron archivos."
MSG_EMPTY_FILE = "Archivo vacío."
MSG_NOT_A_ZIP = "El fichero no es un ZIP válido."
MSG_ZIP_ESCAPE = "ZIP contiene rutas no permitidas (zip slip)."
MSG_ZIP_WITHOUT_PDF = "No se encontraron PDFs en el ZIP."
MSG_BAD_TYPE = ("Tipo de archivo no permitido: ", ". Solo se aceptan .pdf o .zip")
MSG_EMPTY_AMONG_SEVERAL = "Archivo vacío detectado: "
MSG_NOT_PDF_AMONG_SEVERAL = (
    "Cuando se suben múltiples archivos, todos deben ser PDF. Archivo inválido: "
)

# --- fixed values: answers of the check made before an upload --------------------------------
MSG_SELECT_NONE = "Selecciona uno o más archivos PDF, o un archivo ZIP."
MSG_SELECT_ZIP_AMONG_SEVERAL = (
    "Cuando subes múltiples archivos, no puedes incluir ZIP. Sube solo PDFs o un único ZIP."
)
MSG_SELECT_BAD_TYPE = ("Archivo no permitido: ", ". Solo se aceptan .pdf o .zip")

# --- fixed values: notification texts and attachment types ------------------------------------
SUBJECT_TEXT = "Lote procesado: "
BODY_TEXT = ("Lote ", " procesado correctamente.\nAdjuntos: ")
DEFAULT_ATTACHMENTS = ["invoices_extracted.xlsx"]
MEDIA_TYPES = {
    ".json": "application/json",
    ".csv": "text/csv",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
MEDIA_TYPE_OTHER = "application/octet-stream"
