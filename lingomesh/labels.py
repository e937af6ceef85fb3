"""Fixed values of the output contract.

Everything in this module is a fixed value that must equal what users of the
matcher already rely on: drop reasons, review reasons, method and confidence
words, column-name hints and lookup tables.  They are written out plainly and
kept together here so that no other module hard-codes a string.
"""

from __future__ import annotations

# --- fixed values: match vocabulary -------------------------------------------------
METHOD_SLUG = "slug"
METHOD_EMBEDDING = "embedding"
CONF_SURE = "sicher"
CONF_REVIEW = "prüfen"
NO_MATCH_CONFIDENCE = "kein Treffer"
NO_MATCH_REASON = "kein Treffer über Threshold"
FALLBACK_YES = "ja"
FALLBACK_NO = "nein"
X_DEFAULT = "x-default"

# --- fixed values: review reasons (printf patterns) ----------------------------------
REASON_NEAR_THRESHOLD = "knapp über Threshold (%.3f)"
REASON_NOT_RECIPROCAL = "nicht reziprok"
REASON_AMBIGUOUS = "mehrdeutig (Margin %.3f)"
REASON_SEPARATOR = "; "

# --- fixed values: drop reasons --------------------------------------------------------
DROP_EMPTY_URL = "leere URL"
DROP_STATUS = "Status Code"                      # followed by " <n>" when numeric
DROP_NOT_INDEXABLE = "nicht indexierbar ({})"
DROP_EMB_MISSING = "Embedding fehlt"
DROP_EMB_MISSING_NOTE = "Embedding fehlt ({}: {})"
DROP_EMB_UNREADABLE = "Embedding nicht lesbar"
DROP_EMB_INVALID = "Embedding ungültig"
DROP_DIMENSION = "Dimension {} statt {} (vermutlich abgeschnitten)"
DROP_DUPLICATE = "Duplikat nach Normalisierung von {}"
DROP_ZERO = "Nullvektor oder ungültige Werte"
DROP_NO_TEXT = "kein Text in den gewählten Spalten"
DROP_EMBED_FAILED = "Embedding-Anfrage fehlgeschlagen: {}"

# --- fixed values: URL normalization --------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "mc_cid", "mc_eid", "pk_campaign", "pk_kwd",
]
NUMBER_PATTERN = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
CODE_PATTERN = r"^[a-z]{2}(-[a-z]{2})?$"        # matched case-insensitively

# --- fixed values: column detection ----------------------------------------------------
URL_COL_NAMES = ["address", "url", "urls", "adresse", "page", "seite", "landing page", "landingpage"]
EMB_COL_HINTS = ["embed", "vector", "vektor"]
STATUS_COL_NAMES = ["status code", "statuscode"]
INDEX_COL_NAMES = ["indexability", "indexierbarkeit"]
NOTE_COL_NAMES = ["prompt request status", "request status", "prompt status"]
TEXT_COL_HINTS = ["main content", "content extraction", "body", "text", "title", "h1", "meta description"]
TEXT_COL_EXCLUDE = ["length", "pixel", "ratio", "width", "count", "occurrences"]
DELIMITERS = [",", ";", "\t", "|"]
SINGLE_COLUMN_SEP = "\x1f"
# --- fixed values: words that a delimited file uses for a missing value -------------------
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]
FILE_EMPTY = "Datei ist leer."

# --- fixed values: ccTLD -> language ("" = region without one language) ----------------
CCTLD_LANG = {
    "de": "de", "fr": "fr", "it": "it", "es": "es", "nl": "nl", "pl": "pl", "pt": "pt",
    "cz": "cs", "dk": "da", "se": "sv", "no": "no", "fi": "fi", "ru": "ru", "jp": "ja",
    "cn": "zh", "uk": "en", "us": "en", "hu": "hu", "ro": "ro", "gr": "el", "tr": "tr",
    "at": "", "ch": "", "be": "", "ca": "", "com": "", "net": "", "org": "", "eu": "",
}
GENERIC_TLDS = ["com", "net", "org", "eu"]

# --- fixed values: page responses and address guard ------------------------------------
PAGE_HTTP = "HTTP {}"
PAGE_NOT_HTML = "kein HTML ({})"
PAGE_TOO_BIG = "Seite zu groß (> 5 MB)"
PAGE_NO_TEXT = "kein Text extrahiert"
PAGE_MAX_BYTES = 5_000_000
REDIRECT_STATUSES = [301, 302, 303, 307, 308]
MAX_REDIRECTS = 5
REDIRECT_FORBIDDEN = "Weiterleitung zu unzulässiger Adresse"
REDIRECT_TOO_MANY = "zu viele Weiterleitungen"
GUARD_INVALID = "ungültige URL"
GUARD_SCHEME = "nur http/https erlaubt"
GUARD_NO_HOST = "Host fehlt"
GUARD_UNRESOLVED = "Host nicht auflösbar"
GUARD_INTERNAL = "interne oder lokale Adresse nicht erlaubt"

# --- fixed values: matching defaults ------------------------------------------------------
DEFAULT_THRESHOLD = 0.80
DEFAULT_BAND = 0.05
DEFAULT_MIN_MARGIN = 0.02
DEFAULT_K = 5
EMBED_MAX_CHARS = 20_000
# --- fixed values: embedding endpoint ------------------------------------------------------
TEXT_TOO_LONG = "context length|maximum context|too long|max.*tokens|input length"    # matched case-insensitively
EMBED_WRONG_COUNT = "Endpunkt lieferte {} Vektoren für {} Texte"
EMBED_NOTHING = "keine Vektoren erhalten"
# --- fixed values: set validation ----------------------------------------------------------
SETS_TOO_FEW = "Mindestens zwei Sprachsets mit gültigem Code nötig."
SETS_NO_PIVOT = "Pivot-Sprache '{}' nicht in den Sprachsets."
SETS_EMPTY = "Mindestens eine Sprachvariante hat keine gültigen URLs."
SETS_DIMENSIONS = "Die Embedding-Dimensionen unterscheiden sich zwischen den Dateien ({}). Alle Dateien müssen mit demselben Modell erzeugt sein."
SETS_INVALID_CODE = "Ungültiger Sprachcode: {}"
DROP_NO_CODE = "kein Sprachcode"
# --- fixed values: special-purpose address blocks (never a public page) --------------------
IPV4_LOOPBACK = ["127.0.0.0/8"]
IPV4_NEVER = ["0.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "240.0.0.0/4"]
IPV4_PRIVATE = [
    "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.8/32", "192.0.0.11/32", "192.0.0.12/30", "192.0.0.16/28", "192.0.0.32/27", "192.0.0.64/26",
    "192.0.0.128/25", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
]
IPV4_SHARED = ["100.64.0.0/10"]
IPV6_LOOPBACK = ["::1/128"]
IPV6_NEVER = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5",
    "f800::/6", "fe00::/9", "fe80::/10", "ff00::/8",
]
IPV6_PRIVATE = ["64:ff9b:1::/48", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7"]
IPV6_PUBLIC_INSIDE = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
EMBED_BATCH_SIZE = 64
EMBED_WAITS = [2, 4, 8]                          # seconds between attempts

# --- fixed values: report column labels ---------------------------------------------------
COL_LANGUAGE = "Sprache"
COL_URL = "URL"
COL_REASON = "Grund"
COL_SCORE = "Score"
COL_METHOD = "Methode"
COL_CONFIDENCE = "Konfidenz"
COL_SECOND_URL = "Zweitbeste URL"
COL_SECOND_SCORE = "Zweitbester Score"
COL_PREF_URL = "Bevorzugte Pivot-URL"
COL_PREF_SCORE = "Score bevorzugte Pivot-URL"
COL_CLUSTER_CONF = "Cluster-Konfidenz"
COL_FALLBACK = "x-default-Fallback"
COL_PIVOT_URL = "Pivot-URL ({})"
