"""Fixed values.

Everything here is data that results depend on (codes, word lists, palettes,
limits). There is no logic in this module.
"""

# Market codes in column order of a copy sheet, with the language they stand for.
MARKETS = {
    "EN": "English (source)",
    "UK": "English (United Kingdom)",
    "NL": "Dutch (Netherlands)",
    "BENL": "Dutch (Belgium / Flemish)",
    "BEFR": "French (Belgium)",
    "FR": "French (France)",
    "LU": "French (Luxembourg)",
    "CHFR": "French (Switzerland)",
    "CHDE": "German (Switzerland)",
    "DE": "German (Germany)",
    "AT": "German (Austria)",
    "DK": "Danish (Denmark)",
    "ES": "Spanish (Spain)",
    "SE": "Swedish (Sweden)",
    "NO": "Norwegian (Norway)",
}
SOURCE_MARKET = "EN"
TARGET_MARKETS = [m for m in MARKETS if m != SOURCE_MARKET]
MARKET_ALIASES = {"NOR": "NO"}

# Copy-sheet metadata labels (lower case) and the key each one fills.
METADATA_LABELS = {
    "email": "email",
    "requestor": "requestor",
    "date email": "date_email",
    "due": "due",
    "notes": "notes",
}
# The same keys with the label an export prints.
EXPORT_LABELS = {
    "email": "Email",
    "requestor": "Requestor",
    "date_email": "Date email",
    "due": "Due",
    "notes": "Notes",
}
HEADER_SEARCH_ROWS = 8
NUMERIC_SHARE = 0.8
MAX_COLUMN_NAME = 48
MAX_TABLE_NAME = 60
GLOSSARY_HITS = 60
GLOSSARY_LIST_ROWS = 500
GLOSSARY_SAMPLES = 3
SQL_MAX_ROWS = 500
SAMPLE_ROWS = 5
TOP_WORKSPACES = 10
MAX_PAGE_SIZE = 100
STUCK_AFTER = "1 hour"
# How long a stream remembers an upload to drop its copies.
UPLOAD_RETENTION = "30 days"
TRAILING_DAYS = 180
CLIP_GAP_TOLERANCE = 0.01
RATIO_TOLERANCE = 0.02
PROGRESS_CHARS = 200
NOT_SPECIFIED = "(not specified)"
SKIP_TOKEN = "(no assignment)"
DEFAULT_TARGET = "Answer the overall research question using the plan above."
HASH_SEPARATOR = "\x01"

# Cells that a sheet reader treats as missing.
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Characters that str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Spark functions that reach outside the tables.
FORBIDDEN_FUNCTIONS = ["reflect", "try_reflect", "java_method"]

# Refusal of a batch sheet.
MISSING_COLUMNS = "Missing required columns: "

# Line patterns of research documents: headings and list items.
HEADING = r"^\s*#{1,6}\s+(.*\S)\s*$"
LIST_ITEM = r"^\s*(?:[0-9]+[.)]|[-*•])\s+(.*\S)\s*$"

# Refusals of the SQL gate.
NOT_ONE_STATEMENT = "only a single statement is allowed (no ';')."
NOT_A_QUERY = "only SELECT/WITH queries are allowed."
FORBIDDEN = "query contains a forbidden keyword (read-only access)."
DISABLED_TABLES = "query references tables disabled in this session: "
FOREIGN_TABLES = "query references tables outside this warehouse: "

# Colours given to new tags, in turn.
TAG_COLORS = [
    "#FADBD8", "#EBDEF0", "#E8F8F5", "#FEF9E7", "#FBEEE6", "#EAEDED",
    "#D4EFDF", "#FCF3CF", "#D6EAF8", "#F5CBA7", "#E6B0AA", "#D7BDE2",
    "#A2D9CE", "#F9E79F", "#EDBB99", "#D5D8DC", "#ABEBC6", "#FAD7A0",
    "#AED6F1", "#F1948A",
]

# Supported aspect ratios; the order breaks ties.
ASPECT_RATIOS = [
    "9:16", "16:9", "1:1", "3:4", "4:3", "2:3", "3:2", "4:5", "5:4", "21:9",
    "1:4", "4:1", "1:8", "8:1",
]
OTHER_RATIO = "other"

ASSET_TYPES = [
    "generic_image", "generic_video", "vto_product", "vto_person_female",
    "vto_person_male", "vto_top", "vto_bottom", "vto_dress", "vto_shoe",
]
# Asset types shown in the try-on picker and the bucket each belongs to.
TRY_ON_BUCKETS = {
    "vto_person_male": "male_models",
    "vto_person_female": "female_models",
    "vto_top": "tops",
    "vto_bottom": "bottoms",
    "vto_dress": "dresses",
    "vto_shoe": "shoes",
}

# File extension per mime type, of those a plain installation knows; others give "bin".
MIME_EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "video/mp4": "mp4",
    "audio/mpeg": "mp3",
    "application/pdf": "pdf",
}

# Types of step fields whose values name media.
MEDIA_FIELDS = ["image", "audio", "video"]

# Final status of a run by the state its executor reports.
RUN_STATUS = {
    "SUCCEEDED": "completed",
    "FAILED": "failed",
    "CANCELLED": "canceled",
}

# Wording of a translation request.
PROMPT_RULES = [
    "- Keep it natural, on-brand and concise.",
    "- Preserve any HTML tags (e.g. <b>) and placeholders such as [Name] exactly as-is.",
    "- Respect the max character limit when one is given.",
    "- Do not translate the field names; only the text values.",
]
PROMPT_INTRO = (
    "You are a senior marketing copy translator. Translate the following email "
    "campaign copy from English into %s."
)
PROMPT_TONE = "- Use a %s tone of voice / form of address."
PROMPT_GLOSSARY = "- Use these established translations for specific terms:"
PROMPT_FORMAT = (
    "Return ONLY a JSON object mapping each item index (as a string) to its "
    'translated text. Example: {"0": "...", "1": "..."}.'
)
PROMPT_ITEMS = "Items to translate:"
