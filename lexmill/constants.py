"""Fixed values the results depend on: word lists, patterns and limits."""

# Words that mark a storefront or a forum, and how many distinct
# ones a body may hold before it counts as one.
NOISE_WORDS = [
    "sale", "sales", "discount", "deal", "bundle", "price", "store", "buy",
    "purchase", "community", "forum", "thread", "discussion",
]
NOISE_DENSITY = 3

# Whole-word patterns that mark time-bound text.
TEMPORAL_PATTERNS = [
    r"20(2[3-9]|[3-9][0-9])", "patch", "update", "hotfix", "changelog", "release notes",
]

# Fixed values: (refuse, weak) relevance floors per scorer; None = uncalibrated.
FLOORS = {
    "local": (-3.0, 2.0),
    "hfspace": (-3.0, 2.0),
    "cloudflare": (0.02, 0.90),
    "voyage": None,
}

# Whole-word patterns of the intent families.
INTENT_PATTERNS = {
    "comparison": [
        "vs", "versus", "compare", "comparison", r"difference(s)?", r"similarit(y|ies)",
        "contrast", r"better\s+than", r"between\s+.+?\s+and\s+.+",
    ],
    "listicle": [r"top\s+\d+", "best", "worst", "ranking", "recommendations", r"list\s+of"],
    "factual": [r"what\s+is", r"who\s+is", r"when\s+was", r"release\s+date", "specs", "developer"],
    "temporal": ["latest", "recent", "current", r"history\s+of", "timeline", "update"],
    "explanatory": ["explain", r"how\s+does", r"why\s+is", r"reason\s+for"],
}

# Fixed values: (task, widened, limit, window, decompose, web rule).
STRATEGIES = [
    ("comparison", False, 5, False, True, "temporal"),
    ("listicle", False, 10, True, False, "temporal"),
    ("factual", False, 5, False, False, "temporal"),
    ("factual", True, 7, True, False, "temporal"),
    ("open", False, 5, False, False, "always"),
]

# Words a name span never starts on.
SPAN_STOPWORDS = [
    "the", "a", "an", "what", "which", "who", "whose", "where", "when", "why",
    "how", "is", "are", "was", "were", "can", "could", "should", "would",
    "will", "does", "do", "did", "i", "in", "on", "for", "of", "to", "and",
    "or", "about", "me", "you", "it", "playing", "play",
]
# Numerals and connectors that continue a span.
ROMAN_NUMERALS = [
    "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii",
]
CONNECTORS = ["of", "to", "the", "in", "on", "for", "at"]
# Left, right, reversed and modifier apostrophes.
CURLY_APOSTROPHES = "‘’‛ʼ"

# Words ignored when two texts are compared.
COMPARE_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "of", "to", "and", "or",
    "for", "in", "on", "with", "by", "from", "that", "this", "as",
]
JACCARD_LIMIT = 0.5
CONTEXT_CHARS = 4000
PROMPT_CHARS = 4500

# Chunk windows and chunk filter.
CHUNK_WORDS = 300
CHUNK_OVERLAP = 50
GIANT_WORD = 2000
MAX_CHUNK_WORDS = 1000
PRICE_SYMBOLS = ["$", "€", "£"]
PRICE_DENSITY = 0.01
MIN_LINE_CHARS = 30

# Name spaces of the deterministic ids.
ENTITY_NAMESPACE = "12345678-1234-5678-1234-567812345678"
CHUNK_NAMESPACE = "87654321-4321-6789-4321-678987654321"

# Retrieval depths.
BRANCH_DEPTH = 20
FETCH_FACTOR = 4
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75

# Web evidence rules.
WEB_MIN_SCORE = 0.5
WEB_UGC_DOMAINS = ["steamcommunity.com", "reddit.com", "twitter.com"]
WEB_UGC_SCORE = 0.8
WEB_KEEP = 3

# Follow-up questions.
ANAPHORA = ["it", "its", "that", "they", "them", "their", "this", "these", "those", "there"]
MIN_TOKENS = 4
HISTORY_TURNS = 4
HISTORY_CHARS = 500

# Citations, answers and refusals.
CITATION = r"\(Source:\s*'([^']+)'\)"
PARTIAL_SECTION = "Unsupported or Missing Parts:"
REFUSAL_CHARS = 600

# Headings whose sections hold no prose.
BOILERPLATE = [
    "references", "external links", "see also", "notes", "further reading", "bibliography",
]
SUMMARY_CHARS = 500

# Name parts of media fields, for the first and the second source.
MEDIA_FIELDS = [
    "image", "screenshot", "clip", "movie", "logo", "thumbnail", "background", "icon", "cover",
    "images", "video", "videos", "thumbnails", "poster", "banner", "avatar",
]
# Whole names of media fields of the third source.
MEDIA_NAMES = ["artworks", "cover", "screenshots", "videos"]

# Names under which the first matching child is looked up.
PC_NAMES = ["pc", "pc (microsoft windows)", "windows", "pc dos"]

# Vector drift.
DRIFT_GAP = 0.2
DRIFT_SAMPLE = 3
IMBALANCE = 3

# Daily request limits and token prices per million.
DAILY_LIMITS = {"gemini": 1500, "groq": 14400}
PRICES = {
    "llama-3.1-8b-instant": (0.05, 0.08),
    "openai/gpt-oss-120b": (0.15, 0.60),
    "gemini-flash-lite-latest": (0.0, 0.0),
    "gemini-flash-latest": (0.0, 0.0),
}
