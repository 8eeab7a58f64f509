"""Stored data and results depend on them, so they are kept as text."""

# Columns of the similarity vector, in vector order.
FEATURES = (
    "distance_km",
    "vertical_meters",
    "climb_ratio",
    "profile_score",
    "nb_climbs",
    "nb_hard_climbs",
    "max_altitude",
    "avg_steepness_pct",
    "km_last_climb_to_finish",
)

# Axes of the percentile profile, in display order.
RADAR_FEATURES = (
    "distance_km",
    "vertical_meters",
    "climb_ratio",
    "nb_hard_climbs",
    "max_altitude",
    "avg_steepness_pct",
)

HARD_CATEGORIES = ("1", "HC")

# Outcome classification.
BUNCH_SPRINT = "bunch_sprint"
REDUCED_SPRINT = "reduced_group_sprint"
SOLO = "solo_or_breakaway"
BUNCH_MIN_GROUP = 20
SOLO_MIN_GAP_SECONDS = 20

VICTORY_LABELS = {
    "bunch_sprint": "Sprint massif",
    "reduced_group_sprint": "Sprint groupe réduit",
    "solo_or_breakaway": "Solo / échappée",
}
NO_LABEL = "—"

# Defaults of the search, match-up and listing.
TWINS_K = 8
MATCHUP_K = 10
MATCHUP_TOP_N = 10
MATCHUP_ROWS = 15
PAGE_SIZE = 25
INTENSITY_SCALE = 40.0

# Elevation polyline: valley height as a share of the highest summit; drawing box.
VALLEY_SHARE = 0.22
XY_WIDTH = 1000.0
XY_HEIGHT = 120.0
XY_PAD = 8.0

# Snapshot log and failure log.
CHALLENGE_MARKERS = ("Just a moment", "cf-browser-verification")
PAGELOAD_TIMER = r"Pageload \d+\.\d+s"
PAGELOAD_START = "Pageload "
NOISE_IDS = ("cmpbox", "cmpbox2")
NOISE_CLASS_PART = "-ad"
NOISE_ID_PART = "-ad-"
REASON_LIMIT = 2000
DEFAULT_SOURCE = "pcs"
STARTLIST_SOURCE = "startlist"
CLIMBS_SOURCE = "enrich_climbs"

# URL forms.
STAGE_URL = r"^race/([^/]+)/(\d{4})/(?:stage-)?(.+)"
STARTLIST_SUFFIX = "/startlist"
CLIMBS_SUFFIX = "/route/climbs"
