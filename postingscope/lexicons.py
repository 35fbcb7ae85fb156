"""Default lexicons, weights and cut-offs.

Every operator takes these as parameters; the defaults below are what a
user of the original application gets when passing nothing.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: must equal the original application's defaults for equal
# scores.  Stated as plain text, in their original order.
# ---------------------------------------------------------------------------

# Corporate buzzwords (genericness feature).
GENERIC_BUZZWORDS = [
    "fast-paced environment",
    "wear many hats",
    "dynamic team",
    "competitive salary",
    "growth opportunity",
    "self-starter",
    "results-driven",
    "detail-oriented",
    "team player",
    "hit the ground running",
    "fast paced",
    "passionate individual",
    "exciting opportunities",
    "work hard play hard",
    "think outside the box",
    "synergy",
    "flexible mindset",
    "fast-growing company",
    "great culture",
    "career growth",
    "unmatched opportunity",
    "market-competitive",
    "industry leading",
    "fast-growing",
    "dynamic environment",
    "competitive compensation",
    "fast growing",
    "fast pace",
    "multi-tasker",
    "high energy",
]

# Vague common nouns (vagueness feature, used with a noun table).
VAGUE_NOUNS = [
    "opportunity",
    "environment",
    "team",
    "role",
    "position",
    "candidate",
    "responsibilities",
    "requirements",
    "stuff",
    "things",
    "task",
    "tasks",
    "work",
    "duties",
    "people",
    "individual",
    "person",
    "culture",
    "value",
    "values",
    "experience",
    "background",
    "company",
    "organization",
    "chance",
    "ability",
    "skills",
]

# Evergreen / urgency phrases (urgency feature), the shipped lexicon file.
URGENCY_PHRASES = [
    "always hiring",
    "immediate start",
    "ongoing opportunities",
    "apply now",
    "pool of candidates",
    "continuous hiring",
    "future opportunities",
    "accepting applications on an ongoing basis",
    "talent pool",
    "future consideration",
    "rolling basis",
    "urgently hiring",
    "immediate opening",
    "open pipeline",
    "evergreen posting",
    "standing opening",
    "continuous recruitment",
    "hiring continuously",
    "talent pipeline",
    "resume submission for future openings",
    "open requisitions",
    "accepting resumes for future roles",
    "ongoing talent search",
]

# Hiring-frustration phrases with severity weights, the shipped CSV.
# (Phrases are lower-cased when loaded.)
FRUSTRATION_PHRASES = [
    ("never heard back", 0.85),
    ("ghosted after", 0.95),
    ("interviewed for a job that didn't exist", 1.00),
    ("position was already filled", 0.90),
    ("no response after final round", 0.95),
    ("fake job posting", 1.00),
    ("waste of time", 0.80),
    ("radio silence", 0.85),
    ("phantom listing", 0.95),
    ("never replied", 0.80),
    ("job wasn't real", 1.00),
    ("no response from recruiter", 0.75),
    ("automatic rejection email", 0.60),
    ("listing posted again", 0.85),
    ("reposted the exact same role", 0.90),
    ("endless interview rounds", 0.75),
    ("unresponsive HR", 0.80),
    ("misleading job description", 0.85),
    ("no intention of hiring", 0.95),
    ("resume harvesting", 0.95),
    ("data collection posting", 0.90),
    ("applied 3 months ago", 0.70),
    ("ghosted by recruiter", 0.90),
    ("cancelled the position", 0.75),
    ("cold rejection", 0.70),
]

# Boilerplate patterns removed by the cleaner, applied in this order.
BOILERPLATE_PATTERNS = [
    r"(?i)equal\s+opportunity\s+employer",
    r"(?i)all\s+qualified\s+applicants\s+will\s+receive\s+consideration",
    r"(?i)click\s+here\s+to\s+apply",
    r"(?i)apply\s+now\b",
    r"(?i)all\s+rights\s+reserved\.?",
    r"(?i)privacy\s+policy",
    r"(?i)terms\s+of\s+service",
]

# Tags whose whole element (content included) the markup stripper drops.
DROPPED_ELEMENTS = ["script", "style", "noscript", "header", "footer", "nav", "form", "svg"]

# Sub-score weights of the 0-100 score.
DEFAULT_WEIGHTS = {
    "genericness": 0.20,
    "vagueness": 0.20,
    "repost": 0.20,
    "urgency": 0.15,
    "bert_classifier": 0.15,
    "company_sentiment": 0.10,
}

# Feature constants.
GENERICNESS_SCALE = 25.0
URGENCY_SCALE = 30.0
MIN_WORDS = 15
RULE_WEIGHTS = (0.30, 0.30, 0.20, 0.20)  # genericness, vagueness, repost, urgency
BOOTSTRAP_CUT = 0.70
REPOST_BASE, REPOST_STEP = 0.4, 0.15
NEGATIVITY_BLEND = (0.7, 0.3)             # compound-negativity, neg share
FRUSTRATION_BLEND = (0.40, 0.60)          # baseline, phrase density
FRUSTRATION_DENSITY = (3.0, 0.85)         # cap on matched count, scale
DECAY_LAMBDA = 0.03
SIMILARITY_THRESHOLD = 0.92
REPOST_WINDOW = 20
MIN_DESCRIPTION = 10
REPORT_THRESHOLD = 60.0
HIGH_RISK = 60.0
DEFAULT_INDUSTRY = "General Tech"

# Signal cut-offs (repost, genericness, vagueness, urgency, sentiment).
SIGNAL_CUTS = {"repost": 0.3, "genericness": 0.2, "vagueness": 0.15,
               "urgency": 0.15, "sentiment": 0.25}

# Complaint-theme keyword groups, checked in this order.
THEME_KEYWORDS = [
    ["ghost", "response", "reply"],
    ["repost", "exist", "fake"],
    ["time", "round", "long"],
]

# Relative-time units (days per unit).
RELATIVE_UNITS = [("day", 1), ("week", 7), ("month", 30)]

# Ingest defaults for absent fields.
DEFAULT_COMPANY = "Unknown"
DEFAULT_TITLE = "Untitled Position"
DEFAULT_POSTING_SOURCE = "Unknown"
DEFAULT_REVIEW_SOURCE = "reddit"

# ---------------------------------------------------------------------------
# Our own wording for report text (not required to match anything).
# ---------------------------------------------------------------------------
THEME_TEXT = [
    "Slow or missing replies from recruiters after candidates apply or interview",
    "Roles that are listed again and again with no sign of anyone being hired",
    "Long hiring timelines with many interview stages",
]
THEME_FILLER = "Nothing else stands out in the reviews"
THEME_DEFAULTS = [
    "No candidate has reviewed this employer yet",
    "How quickly applicants hear back is not known",
    "Whether listed openings are filled is not known",
]
SIGNAL_TEXT = {
    "repost": ("Frequent re-listing", "This role has been listed about {n} times as often as a typical opening."),
    "genericness": ("Buzzword-heavy text", "The description leans on stock phrases rather than specifics."),
    "vagueness": ("Unclear requirements", "Requirements are open-ended instead of naming concrete deliverables."),
    "urgency": ("Always-open language", "The listing talks about pipelines and future openings."),
    "sentiment": ("Candidate frustration", "Reviews of this employer mention poor communication with applicants."),
    "standard": ("No unusual signals", "Text and posting frequency look like an ordinary opening."),
}
