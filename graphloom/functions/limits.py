"""Fixed values of the engine: caps, weights and thresholds."""

# Search.
BUDGET, MAX_HITS, MAX_NEIGHBORS = 2000, 20, 12
PREFIX_LENGTH, TRIGRAM_LENGTH, TRIGRAM_DICE = 3, 5, 0.5
EXACT, PREFIX, TRIGRAM, IDF_BASE = 1.0, 0.7, 0.4, 0.1
DOTTED_WEIGHT, STUB_WEIGHT, TEST_WEIGHT = 0.2, 0.25, 0.5
# Names.
SUGGEST_DICE, SUGGESTIONS, CANDIDATES = 0.3, 3, 5
# Graph.
AFFECTED_DEPTH, HUBS, LIST_CAP = 2, 10, 15
ROUNDS, LEVELS, MIN_COMMUNITY, COMMUNITY_HUBS, COMMUNITY_DIRS = 20, 10, 5, 5, 3
PLAN_CALLERS, PLAN_IMPACTS, PLAN_TESTS, PLAN_COCHANGES = 10, 15, 10, 8
# Co-change.
COMMITS, COMMIT_FILES, MIN_SUPPORT, MAX_PAIRS = 500, 20, 3, 200
# Store.
QUARANTINE_RATIO, SHRINK_FACTOR = 0.05, 2
# Pages.
WIKI_HUBS, WIKI_RELATION, WIKI_SUBSYSTEMS, NAVIGATOR_HUBS = 20, 30, 30, 100
# Feedback and usage.
HALF_LIFE_DAYS, MIN_CORROBORATION = 30, 2
REPLACED_TOKENS, USD_PER_MTOK = 7600, 3.0
# Files.
CODE_BYTES, CONFIG_BYTES, MANIFEST_BYTES, MINIFIED_LINE = 2 << 20, 256 << 10, 256 << 10, 50 << 10
SIGNATURE_CHARS, DOC_CHARS, IMPORT_CHARS = 160, 500, 120
BODY_LINES, BODY_BYTES = 30, 1600
SCAN_DEPTH = 5
SOURCE_TTL_SECONDS = 24 * 3600
# Viewer.
VIEW_LIMIT, VIEW_MAX, VIEW_EXTRA, VIEW_SAMPLE = 600, 5000, 2000, 60
SPECIAL_KINDS = ("route", "dependency", "task", "resource", "image", "config")
