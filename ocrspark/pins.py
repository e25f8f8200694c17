"""Fixed values and pinned semantics, kept in one place."""

# Confidence thresholds of the document defaults.
CONF_HIGH = 85
CONF_MED = 75

# A box belongs to a region / partner when more than this share of it is covered.
OVERLAP = 0.5

# Reading-order priority of a line that lies in no order region.
DEFAULT_PRIORITY = 10

# Slider position that stands for "baseline not moved".
BASELINE_ZERO = 25

# More selected languages than this raise the warning flag.
MAX_QUIET_LANGS = 2
DEFAULT_LANG = "eng"

# Version labels with a fixed meaning.
GROUND_TRUTH = "Ground Truth"
ACTIVE = "active"
NO_VERSION = "None"
INTERNAL_VERSIONS = ("Tesseract Latest", "Tesseract Combined Temp")
RESERVED_LABELS = (GROUND_TRUTH, ACTIVE, NO_VERSION, *INTERNAL_VERSIONS)

# Characters that count as white space when a value is trimmed.
TRIM_CLASS = (
    r"[\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

# Word style flags and the fields an edit may touch.
STYLE_FLAGS = ("bold", "italic", "small_caps", "sup", "underline")

# Address of a word: one row per word within a version.
PAGE_KEY = ("doc_id", "page_no")
LINE_KEY = (*PAGE_KEY, "line_no")
WORD_KEY = (*LINE_KEY, "word_no")
BOX = ("l", "t", "r", "b")
