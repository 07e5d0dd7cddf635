"""Published and agreed values that results depend on. Plain data, no logic."""
from __future__ import annotations

# --- fixed values: grid definition --------------------------------------------------------------
GRID_TAG = "wa5070"
GRID_ORIGIN_X = -2_240_000
GRID_ORIGIN_Y = 2_656_000
RESOLUTION_LADDER = (125, 250, 500, 1000, 2000, 4000, 8000)
ENVELOPE = (-125.5, 45.0, -116.0, 49.5)  # min lon, min lat, max lon, max lat
MAX_ANALYSIS_CELLS = 150
MAX_DISPLAY_CELLS = 12_000

# --- fixed values: metres per degree ------------------------------------------------------------
M_PER_DEG_LAT = 110_574.0
M_PER_DEG_LON_EQUATOR = 111_320.0

# --- fixed values: weights per target mineral ---------------------------------------------------
SCORER_WEIGHTS = {
    "gold": {"structure": 0.30, "lithology": 0.25, "geochemistry": 0.20, "historical": 0.15,
             "remote_sensing": 0.07, "proximity": 0.03},
    "copper": {"lithology": 0.30, "structure": 0.20, "geochemistry": 0.25, "remote_sensing": 0.15,
               "proximity": 0.07, "historical": 0.03},
    "silver": {"lithology": 0.25, "structure": 0.25, "geochemistry": 0.20, "historical": 0.15,
               "proximity": 0.10, "remote_sensing": 0.05},
    "uranium": {"lithology": 0.35, "structure": 0.20, "geochemistry": 0.25, "historical": 0.10,
                "proximity": 0.07, "remote_sensing": 0.03},
    "lithium": {"lithology": 0.35, "geochemistry": 0.25, "structure": 0.15, "proximity": 0.15,
                "remote_sensing": 0.07, "historical": 0.03},
}
EQUAL_WEIGHTS = {"lithology": 1.0, "structure": 1.0, "geochemistry": 1.0, "historical": 1.0,
                 "proximity": 1.0, "remote_sensing": 1.0}

# --- fixed values: weights-of-evidence model ----------------------------------------------------
WOFE_RESOLUTION = 250
#: unit -> (contrast, training sites, area km2, formation)
CONTRASTS = {
    "Eck": (4.55, 4, 26.3, "Klondike Mountain Fm — volcaniclastic rocks"),
    "Evkct": (3.62, 5, 43.1, "Klondike Mountain Fm — conglomerate & tuffs"),
    "Evst": (3.42, 5, 50.6, "Sanpoil Volcanics — tuffs"),
    "Evsf": (3.21, 30, 302.5, "Sanpoil Volcanics — flows"),
    "Evkf": (2.56, 3, 45.3, "Klondike Mountain Fm — flows"),
    "Eco": (1.96, 2, 35.2, "O'Brien Creek Fm — metasediments"),
}
FAULT_TYPES = {
    0: "unknown fault type",
    1: "fault, unknown offset",
    2: "fault, unknown offset (approximate location)",
    3: "fault, unknown offset (concealed)",
    4: "fault, unknown offset (queried)",
    7: "thrust fault",
    8: "thrust fault (approximate location)",
    9: "thrust fault (concealed)",
    10: "thrust fault (queried)",
    31: "low-angle normal fault",
    33: "low-angle normal fault (concealed)",
    43: "normal fault",
    44: "normal fault (concealed)",
    45: "normal fault (concealed)",
}
FOLD_TYPES = {
    1: "anticline",
    2: "anticline (approximate location)",
    3: "anticline (concealed)",
    7: "overturned anticline",
    8: "overturned anticline (approximate location)",
    9: "overturned anticline (concealed)",
    13: "syncline",
    15: "syncline (concealed)",
    19: "overturned syncline",
    20: "overturned syncline (approximate location)",
    21: "overturned syncline (concealed)",
    31: "monocline, anticlinal bend",
    32: "monocline, anticlinal bend (approximate location)",
    33: "monocline, anticlinal bend (concealed)",
}
PREDICTOR_FAULTS = (43, 44, 45)
FAULT_BUFFER_M = 1700.0
LITHOLOGY_BUFFER_M = 150.0
PLACER_BUFFER_M = 4000.0
TRAINING_SITES = 50
FAULT_CONTRAST = 1.0
TRACTS = ("favourable", "permissive", "non_permissive")
TRACT_BANDS = {"favourable": (0.70, 0.95), "permissive": (0.35, 0.65), "non_permissive": (0.00, 0.30)}
#: tract, minimum posterior, published area share in percent, training sites
TRACT_TABLE = (("favourable", 0.024, 4.6, 49), ("permissive", 0.000167, 3.4, 1),
               ("non_permissive", 0.0, 92.0, 0))
BAND_WEIGHTS = {"evidence": 0.75, "closeness": 0.15, "trend": 0.10}
MIN_COVERAGE = 0.5
MODEL_MINERAL = "gold"
CITE_RASTER = "USGS_OF00_495"
CITE_MODEL = "USGS_OF01_501"
CITE_GEOLOGY = "WA_DNR_WGS_Surface_Geology_24k"
REFUSED_OUTSIDE = (
    "outside the OF-00-495 study area (NE Washington); the published "
    "weights-of-evidence model does not apply here"
)
REFUSED_PARTIAL = (
    "less than half the cell is inside the OF-00-495 study area; scoring it "
    "would extrapolate from a sliver"
)
REFUSED_BAD_ID = "not a parseable fixed-grid cell id"
REFUSED_MINERAL = (
    "target mineral '%s' is out of scope — OF01-501 was fitted on "
    "50 epithermal *gold* training sites and says nothing about anything else"
)

# --- fixed values: ranking ----------------------------------------------------------------------
PERCENTILE_TIERS = (("high", 0.90), ("medium", 0.65), ("low", 0.35))
DISPLAY_TIERS = (("high", 0.65), ("medium", 0.40), ("low", 0.20))
DOCUMENTED_TIERS = (("high", 0.70), ("medium", 0.45), ("low", 0.20))
UNIFORM_EPSILON = 1e-9
MAX_EVIDENCE = 20

# --- fixed values: occurrence records -----------------------------------------------------------
ACCURACY_CLASSES = {
    "GPS coordinates": "survey",
    "located from orthophoto": "survey",
    "USGS 7.5-minute topographic map": "topo",
    "generally from USGS 7.5-minute topographic map": "topo",
    "coordinates estimated from location description": "derived",
    "coordinates estimated from legal description": "derived",
    "coordinate accuracy highly variable": "variable",
    "mining district centroid": "district_centroid",
}
ACCURACY_RANK = {"survey": 0, "topo": 1, "derived": 2, "variable": 3, "district_centroid": 4, "unknown": 5}
ACCURACY_QUALITY = {"survey": 0.95, "topo": 0.85, "derived": 0.60, "variable": 0.45,
                    "district_centroid": 0.20, "unknown": 0.50}
ACCURACY_KM = {"survey": 0.02, "topo": 0.15, "derived": 0.4, "variable": 1.0,
               "district_centroid": 3.0, "unknown": 1.0}
POSITION_LABELS = {
    "survey": "GPS/orthophoto",
    "topo": "7.5' topo",
    "derived": "from description",
    "variable": "ACCURACY VARIABLE",
    "district_centroid": "DISTRICT CENTROID — not a site position",
    "unknown": "accuracy unknown",
}
ROUGH_POSITIONS = ("variable", "district_centroid", "unknown")
GROUND_TRUTH_ACCURACY = ("survey", "topo")
PROMPT_FIELDS = ("name", "commodity_primary", "commodities", "ore_minerals", "gangue", "district",
                 "assays", "production", "accuracy_class", "doc_count")
SEARCH_RADIUS_KM = 5.0
MAX_RECORDS_PER_CELL = 6
NOVELTY_CONFIRMS_KM = 0.5
NOVELTY_EXTENDS_KM = 2.0
DISTRICT_REACH_KM = 2.0
NEW_SITE_KM = 0.2
DOCS_PER_SITE = 3
DEFAULT_AOI_RADIUS_KM = 6.0
RUN_MATCH_DEGREES = 0.15

# --- fixed values: structure lines --------------------------------------------------------------
STRUCTURE_BUFFER_M = 1700.0
STRUCTURE_KINDS = ("fault", "fold", "dike", "vent")

# --- fixed values: field pins -------------------------------------------------------------------
ROLES = ("display", "truth", "evidence")
PROVENANCES = ("field_visit", "literature", "inference", "hearsay", "unknown")
POSITION_CONFIDENCES = ("gps", "map_estimate", "rough")
TRUE_WORDS = ("y", "yes", "true", "t", "1")
FALSE_WORDS = ("n", "no", "false", "f", "0", "")
ANNOTATION_FIELDS = ("role", "provenance", "visited", "observed", "position_confidence", "date", "source_note")
TEMPLATE_COLUMNS = ("pin_id", "name", "folder") + ANNOTATION_FIELDS + ("source_description",)

# --- fixed values: scoring batches and model prices (USD per million tokens) --------------------
BATCH_SIZE = 50
RESPONSE_PREVIEW_CHARS = 400
TOKEN_PRICES = {"input": 3.00, "output": 15.00, "cache_read": 0.30, "cache_write": 3.75}
SECRET_FIELDS = ("anthropic_api_key", "api_key", "apikey", "secret_key", "authorization")

# --- fixed values: documents --------------------------------------------------------------------
TEXT_LAYER_CHARS = 100
SAMPLE_PAGES = 5
EXCERPT_CHARS = 400

# --- fixed values: place-name lexicon for gold in Washington ------------------------------------
LEXICON_TIER_NAMES = {1: "direct_workings", 2: "mining_culture", 3: "ore_and_gangue",
                      4: "alteration_and_gossan", 5: "anti_signal"}
LEXICON_TERMS = {
    1: ("Mine", "Mines", "Mining", "Adit", "Shaft", "Stamp", "Arrastra", "Arastra", "Smelter",
        "Concentrator", "Assay", "Placer", "Sluice", "Diggings", "Claim", "Prospector", "Miner",
        "Miners", "Glory Hole", "Highgrade", "High Grade", "Payday", "Pay Streak", "Tunnel",
        "Prospect", "Discovery"),
    2: ("Bonanza", "Eldorado", "El Dorado", "Klondike", "Comstock", "Mother Lode", "Motherlode",
        "Bullion", "Nugget", "Gold", "Golden", "Goldie", "Silver", "Ruby", "Treasure", "Lucky",
        "Independence", "Monte Cristo", "Cleopatra", "Sultan", "Emerald", "Jackpot"),
    3: ("Quartz", "Galena", "Pyrite", "Sulphur", "Sulfur", "Cinnabar", "Copper", "Iron", "Lead",
        "Antimony", "Arsenic", "Mica", "Marble", "Lime", "Limestone", "Graphite", "Molybdenum",
        "Talc", "Asbestos", "Chrome", "Chromite"),
    4: ("Red", "Rusty", "Rust", "Ochre", "Ocher", "Vermilion", "Vermillion", "Painted", "Alum",
        "Yellow", "Brimstone", "Sulphur Springs"),
    5: ("Goldmyer", "Goldsmith", "Goldsborough", "Goldendale", "Goldbar", "Gold Bar", "Silverdale",
        "Silverton", "Silvernail", "Silvers", "Ironwood", "Coppermine Road", "Mill", "Millpond",
        "Mill Creek", "Milltown", "Sawmill", "Silver Salmon", "Silverside", "Discovery Bay",
        "Port Discovery", "Discovery Peak", "Discovery Junction", "Camp Discovery",
        "Discovery Creek", "Discovery Lake", "Tunnel Creek", "Tunnel Island", "Tunnel Flat",
        "Tunnel Point", "Prospect Point", "Prospect Peak", "Prospect Ridge", "Prospect Canyon"),
}
ANTI_SIGNAL_TIER = 5
LANDFORM_ONLY_TIERS = (4,)
LANDFORM_CLASSES = ("Summit", "Ridge", "Cliff", "Range", "Slope", "Pillar", "Bench", "Basin", "Gap")
EXCLUDED_CLASSES = ("Civil", "Census", "Military")
CORROBORATED_KM = 1.5
UNCORROBORATED_KM = 5.0
CAP_STRONG = 0.45
CAP_WEAK = 0.30
CLUSTER_BONUS = 0.10
CLUSTER_NAMES = 3
CAP_LIMIT = 0.6
LEXICON_VERSION = "2026-08-01-draft"

# --- fixed values: mineral service layers -------------------------------------------------------
LAYER_NAMES = {0: "Gold_Silver_Locations", 1: "Metallic_Mineral_Locations", 2: "IAML_Sites",
               3: "IAML_Features", 4: "Mining_Distircts_WA"}
LAYER_PREFIXES = {"Gold_Silver_Locations": "gs", "Metallic_Mineral_Locations": "mm",
                  "IAML_Sites": "iaml", "IAML_Features": "iamlf", "Mining_Distircts_WA": "dist"}

# Letters of the latitude bands of the UTM grid, south to north (fixed values).
UTM_BANDS = "CDEFGHJKLMNPQRSTUVWX"

# Sentences of evidence (fixed values: they are compared word for word). Each {} is filled in, in order.
SENTENCES = {
    "unit_in_buffer_only": "within the {} lithologic buffer (adjacent 250 m cell); no favourable unit in the {} itself",
    "unit_in_cell": "mapped in the {} ({}% of it)",
    "unit_beside": "in the {} buffer; the {} itself holds {}",
    "unit_with_sites": "OF-00-495 unit {} ({}) {}; OF01-501 contrast {} from {} of {} training sites",
    "unit_without_sites": "OF-00-495 unit {} — zero training sites in OF01-501, ranked 'Outside'",
    "unit_unknown": "No OF-00-495 lithology label in this cell (nodata)",
    "fault_none": "No OF-00-495 mapped fault within {} (published optimum buffer {})",
    "fault_inside": "Nearest OF-00-495 mapped fault {} m — inside the published {} optimum buffer (its contrast is ASSUMED {}, not published)",
    "fault_outside": "Nearest OF-00-495 mapped fault {} m — outside the published {} optimum buffer",
    "trend_unknown": "Fault azimuth unknown: the OF-00-495 raster carries no orientation and the 1:24k geology does not map "
                     "this cell, so the published 345°-030° trend filter could not be applied",
    "trend_yes": "A 1:24k mapped fault within 1.7 km trends in the OF01-501 favourable 345°-030° band",
    "trend_no": "No 1:24k mapped fault within 1.7 km trends in the favourable 345°-030° band",
    "tract": "Tract: {} (published score guidance {}); posterior {} — reported for transparency only, the published posteriors "
             "are not reproducible from this raster",
    "scaled": "Scored natively on {} × 250 m cell(s) and {} this {} m cell — the WofE predictors are presence tests and saturate "
              "if applied at coarse resolution",
    "partial": "Only {}% of the cell is inside the study area",
    "refused": "No WofE baseline: {}",
    "no_workings": "no known_workings — assign workings first; if there are still none, this AOI has no survey- or topo-grade gold "
                   "occurrence within its radius",
    "not_verified": "{} working(s) present but workings_verified is false — for a null/control AOI that means the workings contradict "
                    "the label and a human has to resolve it before the numbers mean anything",
    "toponym": 'Toponym: "{}" (GNIS {}, Tier {} {}; matched "{}") {} km from cell centre.',
    "corroborated": "Recorded occurrence '{}' {} km away — corroborated.",
    "uncorroborated": "No recorded occurrence within 5 km — uncorroborated.",
    "not_looked": "Occurrence data unavailable — corroboration unknown.",
}
