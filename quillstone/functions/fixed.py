"""What results must agree on. Patterns are in Java's dialect, with Unicode classes switched on."""

from __future__ import annotations

# Kinds of identifiers from the strongest to the weakest, with the label of their placeholders.
KINDS = {
    "PERSONNUMMER": "PERSONNUMMER",
    "RECORD_ID": "RECORD_ID",
    "EMAIL": "EMAIL",
    "PHONE": "PHONE",
    "DATE": "DATE",
    "AGE": "AGE",
    "PATIENT_MALE": "NAME_PATIENT_MALE",
    "PATIENT_FEMALE": "NAME_PATIENT_FEMALE",
    "PATIENT": "NAME_PATIENT",
    "PERSON": "NAME",
    "ADDRESS": "ADDRESS",
    "POSTAL_CODE": "POSTAL_CODE",
    "LOCATION": "LOCATION",
    "ORG": "ORGANISATION",
    "OTHER_ID": "IDENTIFIER",
}

# Identifier patterns (kind, pattern, captured group). A captured group ends where its match ends.
_CAPITAL = "[A-ZÅÄÖ][a-zåäöéü]+(?:[-'][A-ZÅÄÖa-zåäöéü]+)*"
RULES = (
    ("PERSONNUMMER", r"(?U)(?<!\d)(?:(?:19|20)\d{2}|\d{2})[01]\d[0-9]\d[-+ ]?\d{4}(?!\d)", 0),
    ("EMAIL", r"(?U)(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-zÅÄÖåäö]{2,}\b", 0),
    ("DATE", r"(?U)\b(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])\b", 0),
    ("DATE", r"(?iuU)\b\d{1,2}\s+(?:januari|februari|mars|april|maj|juni|juli|augusti|september|oktober|november|december)\s+(?:19|20)\d{2}\b", 0),
    ("PHONE", r"(?U)(?<!\w)(?:\+46[ -]?(?:\(0\)[ -]?)?|0[1-9])(?:[ -]?\d){7,10}(?!\d)", 0),
    ("RECORD_ID", r"(?iuU)\b(?:journal[- ]?id|patient[- ]?id|ärende[- ]?id|reservnummer)\s*[:#]?\s*([A-Z0-9][A-Z0-9/-]{3,})", 1),
    ("POSTAL_CODE", r"(?iuU)\b(?:postnummer|postnr|postadress)\s*:?\s*(\d{3}[ ]?\d{2})\b", 1),
    ("POSTAL_CODE", r"(?U)\b(\d{3} \d{2})(?=[ \t]+[A-ZÅÄÖ][a-zåäö]+)", 1),
    ("PERSON", r"(?U)(?iu:\b(?:patient(?:namn|en)?|namn|läkare|doktor|dr|sjuksköterska|kontaktperson))\s*:?\s*(" + _CAPITAL + r"(?:[ \t]+" + _CAPITAL + r"){1,3})", 1),
    ("ADDRESS", r"(?U)\b(?:[A-ZÅÄÖ][\wåäöÅÄÖé-]*[ \t]+){0,2}[\wåäöÅÄÖé-]+(?:gatan|vägen|gränden|stigen|allén|torget)\s+\d+[A-Za-z]?\b", 0),
    ("AGE", r"(?iuU)\b\d{1,3}[- ]?(?:årig|år gammal|års ålder)\b", 0),
)
TOKEN = r"\[(?:" + "|".join(KINDS.values()) + r")_\d+\]"
PLACEHOLDER = r"(?iu)\[(?:" + "|".join(KINDS.values()) + r")[^\]\n]*\]"

# Text patterns.
PAGE_MARKER = r"(?md)^--- (?:Sida|Document) \d+ ---[ \t]*\r?$"
DOCUMENT_MARKER = r"^--- Document (\d+) ---"
CRITICAL = (
    r"(?iuU)(?:[<>≤≥]\s*)?[-−]?\d+(?:[.,:/+−-]\d+)*(?:\s*(?:mg|µg|ug|mcg|g/l|mmol/l|ml|mmhg|%))?"
    r"|\b(?:ingen|inga|inget|ej|inte|utan|nekar)\b"
)
DEGENERATE = r"([0-9A-Za-zÅÄÖåäö])\1{19,}"
LOOP = r"(?d)(.{20,}\n)(?:\1){4,}"
NUMBER = r"(?U)\b\d+(?:[.,]\d+)?\b"
WORD = r"(?U)\w+"
TABLE_HEADER = r"(?iu)(?:analys|resultat|enhet|prov|referens(?:intervall)?|result|unit)"
UNREADABLE = "[OLÄSLIGT]"

# Limits.
CHUNK_CHARS, UNIT_CHARS, UNIT_LEAST = 3500, 1800, 600
MAX_SENTENCES, MAX_WORDS, MAX_SENTENCE_CHARS, MAX_EVIDENCE, MAX_NOTES, MAX_NOTE_CHARS = 16, 200, 1200, 8, 8, 400
CONTEXT_SIZES = (8192, 16384, 24576, 32768, 49152, 65536, 98304, 131072, 196608, 262144)
DEFAULT_CONTEXT, LEAST_CONTEXT, MOST_CONTEXT, RESERVE_TOKENS = 131072, 4096, 262144, 768
OUTPUT_BUDGETS = (4096, 8192, 16384)
DOES_NOT_FIT, STOPPED_EARLY = "the record does not fit the context", "the model repeatedly stopped early"
RUNTIME_TOO_OLD, NO_CONTEXT = "the runtime is too old", "the model did not report a usable context capacity"
LEAST_RUNTIME = (0, 32, 1)
MAX_DOCUMENTS, MAX_UPLOAD_BYTES, MAX_NAME_CHARS, MAX_IDENTIFIERS = 10, 64 * 1024 * 1024, 180, 50
EXTENSIONS = (".pdf", ".docx", ".txt", ".json", ".png", ".jpg", ".jpeg")
MODES = ("balanced", "thorough", "fast")

# Limits of page readings. Confidence in percent; shares of words, letters, widths and heights; lines and words.
LOW, CRITICAL_LOW, RELIABLE, MOST_LOW, REJECT, PREFER_LAST, COVERAGE = 75, 88, 91, 0.08, 35, 70, 0.65
LEAST_COLUMN, MOST_ACROSS, GUTTER, SHARED_HEIGHT, LABEL_WORDS, SOME_NUMBERS, MOSTLY_NUMBERS = 3, 2, 0.05, 0.5, 4, 0.25, 0.5

# Limits of page images. Grey levels, shares of pixels, degrees.
DARK_BELOW, INK_PERCENTILE, INK_STEP, BLANK_INK = 220, 90, 25, 0.00001
SKEW_PIXELS, MOST_PIXELS, MOST_IMAGE_PIXELS, INVERT_PERCENTILE, INVERT_BELOW = 1100, 14_000_000, 80_000_000, 60, 128
MAX_PAGES, LARGE_IMAGE, COVERED_IMAGE, SURE_OF_ORIENTATION = 500, 0.04, 0.55, 4
LEAST_INK, MOST_INK, SKEW_GAIN, SKEW_RANGE, SKEW_STEP, SKEW_STEPS = 0.001, 0.35, 1.15, 5, 0.2, 3

# Phrases that a model server uses for an input over its context.
OVERFLOW_PHRASES = (
    "exceeds the context", "exceeds context", "exceed context", "context length exceeded",
    "exceeds the available context", "exceed_context_size_error",
    "context size exceeded", "larger than the context", "longer than the context",
    "input is too long", "context window exceeded", "context shift is disabled",
)

# Codebook restoration.
DETECT_TYPES = ("PER", "PERSONNUMMER", "ORG", "ADDRESS")
IDENTITY_WEIGHT, LEAST_SCORE = 3, 2
TITLES = ("dr", "st", "läk", "md", "leg", "ssk", "usk", "doktor", "läkare", "överläkare", "dl", "vc")

# Messages.
BAD_SUMMARY = "The model did not return a complete summary."
BAD_NOTES = "The model returned invalid uncertainty notes."
TOO_MANY_NOTES = "The model exceeded the uncertainty note limits."
BAD_REFERENCES = "The model returned missing or invalid source references."
TOO_LONG_SENTENCE = "The model exceeded the sentence or source reference limits."
TOO_LONG_SUMMARY = "The model exceeded the summary length limit."
READERS_DIFFER_CRITICAL = "OCR readers disagree on numbers, units, dates or negation. Verify this page against the original."
READERS_DIFFER_WORDS = "OCR readers disagree on wording or reading order. Check names, medical terms and table rows against the original."
READERS_DIFFER_COVERAGE = "OCR readers disagree substantially on page coverage. Verify that no text is missing."
LOW_CONFIDENCE = "Some OCR text has low confidence. Check names, medications, numbers and units against the original."
NO_SECOND_READER = "PaddleOCR is not installed with local models; this page could not receive a second-reader check."
UNREADABLE_MARKERS = "The transcription contains unreadable text markers."
VISION_NOTHING = "The local vision reader returned no usable transcription."
VISION_STOPPED = "The vision reader stopped before finishing the page."
VISION_LOOPS = "The vision reader produced a repetition loop."
REPLACE_SCAN = " Replace the scan or transcribe the page manually."
VISION_READ = "A generative vision reader transcribed this page. Check it against the original."
READER_FAILED = "%s failed on this page."
PAGE_REJECTED = "This page could not be transcribed reliably. Replace the scan or paste a checked transcription."
LAYER_VALUES_LOST = "Some values in the embedded text are absent from OCR. Review this page."
SCAN_RESIZED = "A very large scan was resized; check small text against the original."
IMAGE_TOO_LARGE = "This image is too large to process safely. Use a smaller scan."
BAD_IMAGE = "This image could not be opened."
TOO_MANY_PAGES = "This PDF has more than %d pages. Split it into smaller documents."
REVIEW_BEFORE_SHARING = "Automatic pseudonymisation can miss identifiers. Review the document before sharing."
DETECTOR_FAILED = "The local identifier model failed for %d of %d passages; rules were used for those passages."
SUGGESTIONS_DISCARDED = "%d invalid identifier suggestions were discarded."
IDENTIFIERS_REMAIN = "Possible identifiers remain in the pseudonymised text. Review is required."
