"""Fixed values that must equal the reference's for identical results.

FIXED VALUES — stated plainly, in their natural order.
"""

# Station-name aliases (lower-case feed name -> station name).
STATION_NAME_ALIASES = [
    ("edgware road (h & c)", "Edgware Road (Circle Line)"),
    ("hammersmith (c&h)", "Hammersmith (H&C Line)"),
    ("hammersmith (h&c)", "Hammersmith (H&C Line)"),
    ("hammersmith (d&p)", "Hammersmith (Dist&Picc Line)"),
    ("heathrow terminals 123", "Heathrow Terminals 2 & 3"),
    ("heathrow terminal 1,2,3", "Heathrow Terminals 2 & 3"),
    ("watford junction", "Watford"),
]

# Seed rows of the lines dimension (code, name, colour).
SEED_LINES = [
    ("B", "Bakerloo", "#B36305"),
    ("C", "Central", "#E32017"),
    ("D", "District", "#00782A"),
    ("H", "Hammersmith & Circle", "#F3A9BB"),
    ("J", "Jubilee", "#A0A5A9"),
    ("M", "Metropolitan", "#9B0056"),
    ("N", "Northern", "#000000"),
    ("P", "Piccadilly", "#003688"),
    ("V", "Victoria", "#0098D4"),
    ("W", "Waterloo & City", "#95CDBA"),
]

# Map marker colour per line code; anything else gets DEFAULT_LINE_COLOR.
LINE_COLORS = [
    ("B", "#B36305"), ("C", "#E32017"), ("D", "#00782A"), ("H", "#F3A9BB"),
    ("J", "#A0A5A9"), ("M", "#9B0056"), ("N", "#000000"), ("P", "#003688"),
    ("V", "#0098D4"), ("W", "#95CDBA"),
]
DEFAULT_LINE_COLOR = "#888888"

# Line feature split: code H is drawn as two features.
LINE_SPLITS = [
    ("H", "Hammersmith & City", "#F3A9BB", -2),
    ("H", "Circle", "#FFD300", 2),
]

# Line id -> code, station import variant (no "circle").
STATION_LINE_CODE_MAP = [
    ("bakerloo", "B"), ("central", "C"), ("district", "D"), ("hammersmith-city", "H"),
    ("jubilee", "J"), ("metropolitan", "M"), ("northern", "N"), ("piccadilly", "P"),
    ("victoria", "V"), ("waterloo-city", "W"),
]
# Line id -> code, adjacency build variant (has "circle" -> H).
ADJACENCY_LINE_CODE_MAP = [
    ("bakerloo", "B"), ("central", "C"), ("circle", "H"), ("district", "D"),
    ("hammersmith-city", "H"), ("jubilee", "J"), ("metropolitan", "M"), ("northern", "N"),
    ("piccadilly", "P"), ("victoria", "V"), ("waterloo-city", "W"),
]

DEFAULT_TRAVEL_TIME_SECONDS = 120
LATEST_WINDOW = "2 minutes"
UNKNOWN_COUNTDOWN_RANK = 999999
ETA_SHIFT_TOLERANCE_S = 20
TRAIN_RETENTION_S = 90
OVERLAP_OFFSET_DEG = 0.00015
PLATFORM_DWELL_S = 30
PREDICTED_DEPARTURE_CAP = 0.35
DEFAULT_FRACTION_APPROACHING = 0.9
DEFAULT_FRACTION_LEFT = 0.1
DEFAULT_FRACTION_BETWEEN = 0.5
MAX_CODE_LEN = 20
MAX_NAME_LEN = 100
