"""Thresholds, words and layouts that stored rows and reports must carry exactly."""

# Extraction methods.
DIRECT = "direct"
OCR = "ocr"
DIRECT_PARTIAL = "direct_partial"
ERROR = "error"
METHODS = [DIRECT, OCR, DIRECT_PARTIAL, ERROR]

# Trimmed bytes: above this a direct text stands on its own, below it the alternative text is tried.
SUBSTANTIAL_BYTES = 50

# Bytes at each end of a file that enter the fast fingerprint.
FINGERPRINT_BYTES = 1024

# Characters shown for a search hit.
PREVIEW_CHARS = 200

# Characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Page layout in assembled text.
PAGE_LABEL = "--- Page %d ---\n"
OCR_PAGE_LABEL = "--- Page %d (OCR) ---\n"
PAGE_END = "\n\n"

# Error messages.
LOAD_FAILED = "Failed to load PDF document"
OCR_DISABLED = "OCR disabled (text-only mode)"
NO_IMAGES = "No images generated from PDF"
RENDER_NOT_RUN = "Failed to run pdftoppm"
RENDER_FAILED = "pdftoppm failed: "
OCR_ONLY_FAILED = "OCR failed: "
DIRECT_PART = "Direct: "
OCR_PART = ", OCR: "

# Text report.
REPORT_TITLE = "PDF Text Extraction Results (Rust Edition)"
RULE = "=" * 80
