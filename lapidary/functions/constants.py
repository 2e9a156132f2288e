"""Thresholds, word lists, patterns and formats of the refinement rules."""

# Formats and sizes.
FORMATS = ["csv", "xlsx", "xls", "parquet", "json", "tsv"]
COMPRESSED = [".gz", ".zip", ".bz2"]
SAMPLE_BYTES = 50_000
ENCODING_CONFIDENCE = 0.80
SAMPLE_ROWS = 1_000
SPLIT_ROWS = 10_000

# Strings that mean null, compared after trimming and lower-casing.
HIDDEN_NULLS = ["na", "n/a", "n.a.", "n.a", "none", "null", "nil", "nan", "-", "--", "---", "?", "unknown", "unk", "not available", "not applicable", "missing", "undefined", "void", "#n/a", "#null!", ""]
# Strings that a text reader takes for null, compared as they are.
READER_NULLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Booleans.
TRUE_WORDS = ["yes", "true", "1", "y", "on", "t", "si", "oui"]
FALSE_WORDS = ["no", "false", "0", "n", "off", "f", "non"]

# Ranges by column name.
CONSTRAINTS = {
    "age": {"min": 0, "max": 120},
    "salary": {"min": 0},
    "revenue": {"min": 0},
    "price": {"min": 0},
    "rating": {"min": 0, "max": 5},
    "percentage": {"min": 0, "max": 100},
    "quantity": {"min": 0},
    "discount": {"min": 0, "max": 100},
}
# Rules by column name, the first whose token stands in the name holds.
COLUMN_RULES = {
    "age": {"min": 0, "max": 120},
    "email": {"pattern": r"^[\w.\-+]+@[\w.\-]+\.\w+$"},
    "name": {"no_digits_ratio": 0.8},
    "salary": {"min": 0},
    "revenue": {"min": 0},
    "phone": {"pattern": r"^[+\d\s\-()]+$"},
}
# Personal data.
PII = {
    "email": r"[\w.\-+]+@[\w.\-]+\.\w{2,}",
    "phone": r"[6-9]\d{9}",
    "aadhaar": r"\d{4}[\s\-]?\d{4}[\s\-]?\d{4}",
    "pan": r"[A-Z]{5}[0-9]{4}[A-Z]",
    "ssn": r"\d{3}-\d{2}-\d{4}",
}
# Date patterns, in the order in which they are tried: ISO forms, month first, day first.
DATE_PATTERNS = [
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy-M-d HH:mm:ss",
    "yyyy-M-d'T'HH:mm:ss",
    "yyyy-M-d'T'HH:mm:ssX",
    "M/d/yyyy",
    "d/M/yyyy",
    "d/M/yyyy HH:mm:ss",
    "d-M-yyyy",
    "d.M.yyyy",
]
# Units: grams and seconds.
GRAMS = {"kg": 1000.0, "g": 1.0, "lb": 453.592, "oz": 28.3495, "mg": 0.001}
SECONDS = {"ms": 0.001, "s": 1.0, "sec": 1.0, "min": 60.0, "hr": 3600.0, "h": 3600.0}
# Cities and states.
CITIES = ["Mumbai", "Delhi", "Bangalore", "Chennai", "Kolkata", "Hyderabad", "Pune", "Ahmedabad", "Jaipur", "Surat", "Lucknow", "Kanpur"]
STATES = {
    "mh": "Maharashtra",
    "dl": "Delhi",
    "ka": "Karnataka",
    "tn": "Tamil Nadu",
    "wb": "West Bengal",
    "gj": "Gujarat",
    "up": "Uttar Pradesh",
    "ts": "Telangana",
    "ap": "Andhra Pradesh",
    "hr": "Haryana",
    "pb": "Punjab",
    "mp": "Madhya Pradesh",
    "rj": "Rajasthan",
}
# Shares and limits.
SUCCESS = 0.90
BOOL_RATE = 0.85
PATTERN_RATE = 0.60
DATE_RATE = 0.80
NUMBER_RATE = 0.85
CATEGORY_RATIO = 0.50
CATEGORY_MOST = 1_000
OUTLIER_ROWS = 30
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
FUZZY = 0.80
FUZZY_GROUPS = 150
UNUSED_NULLS = 0.95
CORRUPT_NULLS = 0.90
MANY_VALUES = 500
RARE_SHARE = 0.005
BLOB_CHARS = 250
EPOCH_MEAN = 1e9
