"""File types, signatures, markup tag sets, thresholds.

Everything here is a constant the results depend on; nothing here is computed.
The largest table has under forty rows, so these are the only tables the
library ever broadcasts without asking for their size.
"""

# --- fixed values: extension -> file type -------------------------------------
EXTENSION_TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".xlsx": "xlsx", ".xls": "xls",
    ".pptx": "pptx", ".ppt": "ppt", ".html": "html", ".htm": "html",
    ".jpg": "image", ".jpeg": "image", ".png": "image", ".gif": "image",
    ".bmp": "image", ".tiff": "image", ".tif": "image", ".webp": "image",
    ".wav": "audio", ".mp3": "audio", ".m4a": "audio", ".flac": "audio", ".ogg": "audio",
    ".epub": "epub", ".json": "json", ".xml": "xml", ".csv": "csv", ".zip": "zip",
    ".msg": "msg",
}

# --- fixed values: extension -> type that routes are registered under ------------
ROUTABLE_EXTENSION_TYPES = {
    ".pdf": "pdf", ".html": "html", ".htm": "html", ".docx": "docx", ".doc": "docx",
    ".xlsx": "xlsx", ".xls": "xlsx", ".pptx": "pptx", ".ppt": "pptx",
    ".jpg": "image", ".jpeg": "image", ".png": "image", ".gif": "image",
    ".bmp": "image", ".tiff": "image", ".wav": "audio", ".mp3": "audio",
    ".m4a": "audio", ".epub": "epub", ".json": "json", ".xml": "xml", ".csv": "csv",
    ".zip": "zip", ".msg": "msg",
}

# --- fixed values: extensions the upload entry point accepts -------------------
UPLOAD_EXTENSIONS = [".pdf", ".html", ".htm", ".docx", ".xlsx"]

# --- fixed values: MIME type -> file type ---------------------------------------
MIME_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.ms-powerpoint": "ppt",
    "text/html": "html",
    "image/jpeg": "image", "image/png": "image", "image/gif": "image",
    "image/bmp": "image", "image/tiff": "image", "image/webp": "image",
    "audio/wav": "audio", "audio/mpeg": "audio", "audio/mp4": "audio",
    "audio/flac": "audio", "audio/ogg": "audio",
    "application/epub+zip": "epub", "application/json": "json",
    "application/xml": "xml", "text/xml": "xml", "text/csv": "csv",
    "application/zip": "zip", "application/vnd.ms-outlook": "msg",
}

# --- fixed values: (signature name, routable type, leading bytes), in test order --
# The ZIP signature appears once here; package_subtype tells its five users apart.
SIGNATURES = [
    ("pdf", "pdf", b"%PDF-"),
    ("html", "html", b"<!DOCTYPE"),
    ("html", "html", b"<html"),
    ("zip", "zip", b"PK\x03\x04"),
    ("png", "image", b"\x89PNG\r\n\x1a\n"),
    ("jpg", "image", b"\xff\xd8\xff"),
    ("gif", "image", b"GIF87a"),
    ("gif", "image", b"GIF89a"),
    ("bmp", "image", b"BM"),
    ("tiff", "image", b"II*\x00"),
    ("tiff", "image", b"MM\x00*"),
    ("wav", "audio", b"RIFF"),
    ("mp3", "audio", b"\xff\xfb"),
    ("mp3", "audio", b"\xff\xf3"),
    ("mp3", "audio", b"\xff\xf2"),
    ("mp3", "audio", b"ID3"),
    ("json", "json", b"{"),
    ("json", "json", b"["),
    ("xml", "xml", b"<?xml"),
    ("xml", "xml", b"<"),
]
ZIP_BASED_TYPES = ["docx", "xlsx", "pptx", "epub", "zip"]
HTML_MARKERS = ["<!doctype", "<html", "<head", "<body", "<div"]
SNIFF_CHARS = 1024
HEADER_BYTES = 512

# --- fixed values: option vocabularies ---------------------------------------------
STRATEGIES = ["auto", "fast", "accurate", "ocr", "markitdown"]
IMAGE_MODES = ["embed", "link", "separate"]
TABLE_FORMATS = ["github", "pipe", "grid", "html"]
WORKBOOK_MODES = ["combined", "separate", "selected"]

# --- fixed values: thresholds ---------------------------------------------------------
SCAN_PAGES = 3
SCAN_MEAN_CHARS = 50
PARAGRAPHS_PER_PAGE = 25
GALLERY_PAGE = 12
PREVIEW_CHARS = 200
SHEET_COLUMNS = 100
CACHE_HOURS = 24
UPLOAD_LIMIT_BYTES = 50 * 1024 * 1024
PAGE_BREAK = "---"
FEW_WORDS = 10

# --- fixed values: messages ----------------------------------------------------------------
MSG_LITTLE_TEXT = (
    "Very little text extracted - document may be scanned or contain mostly images"
)
MSG_SCANNED_HINT = "This PDF appears to be scanned. Use --ocr flag for conversion."
EMPTY_SHEET = "*Empty sheet*"
BROKEN_SHEET = "*Sheet could not be read*"

# --- fixed values: seconds per MB and floor, by extension ------------------------------------
COST_RULES = [
    ([".pdf"], 1.0, 0.5),
    ([".docx", ".xlsx", ".pptx"], 1.0, 0.3),
    ([".wav", ".mp3", ".m4a"], 5.0, 2.0),
    ([".jpg", ".jpeg", ".png"], 2.0, 1.0),
]
COST_DEFAULT = (1.0, 0.5)
COST_ANY_DOCUMENT = (1.0, 1.0)
COST_PER_PAGE = {"text": (0.1, 10.0), "ocr": (3.0, 30.0)}

# --- fixed values: tag sets of the markup jobs -----------------------------------------------------
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "source", "track", "wbr",
]
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "div",
    "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre",
    "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
]
SEMANTIC_TAGS = ["article", "section", "aside", "nav"]
SECTION_TAGS = ["article", "section"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`"}
