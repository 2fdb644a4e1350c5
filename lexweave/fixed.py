"""Vocabularies, patterns and constants of the data model.

Everything here is a value that must be exactly this for results to be right
(tag names, word lists, weights, regular expressions, output formats). They are
kept together and in natural order; no logic lives in this module.
"""

# -- document tags ---------------------------------------------------------
LEVELS = [
    "division", "title", "subtitle", "part", "subpart", "chapter", "subchapter",
    "section", "subsection", "paragraph", "subparagraph", "clause", "subclause",
    "item", "subitem",
]
WRAPPERS = ["quoted-block", "quoted-content"]
BODY_TAGS = ["legis-body", "main", "resolution-body"]
ENUM_TAGS = ["enum", "num"]
HEADING_TAGS = ["header", "heading"]
USLM_MARKER = "schemas.gpo.gov/xml/uslm"
CITED_DOCS = ["usc", "usc-chapter", "usc-appendix"]

# -- bill types ------------------------------------------------------------
BILL_TYPE_LABELS = {
    "hr": "H.R.", "s": "S.",
    "hjres": "H.J. Res.", "sjres": "S.J. Res.",
    "hconres": "H. Con. Res.", "sconres": "S. Con. Res.",
    "hres": "H. Res.", "sres": "S. Res.",
}
IN_SCOPE_TYPES = ["hr", "s", "hjres", "sjres", "hconres", "sconres"]
HOUSE_TYPES = ["hr", "hres", "hjres", "hconres"]
SENATE_TYPES = ["s", "sres", "sjres", "sconres"]
UNTITLED_TYPE_LABELS = {
    "hr": "H.R.", "s": "S.", "hres": "H.Res.", "sres": "S.Res.",
    "hjres": "H.J.Res.", "sjres": "S.J.Res.",
}
BILL_TYPE_PROSE = {
    "hr": r"H\.?\s*R\.?",
    "s": r"S\.?",
    "hjres": r"H\.?\s*J\.?\s*Res\.?",
    "sjres": r"S\.?\s*J\.?\s*Res\.?",
    "hconres": r"H\.?\s*Con\.?\s*Res\.?",
    "sconres": r"S\.?\s*Con\.?\s*Res\.?",
}
# mentions in running prose allow at most one blank and know eight types
BILL_MENTION_PROSE = {
    "hr": r"H\.?\s?R\.?",
    "s": r"S\.?",
    "hres": r"H\.?\s?Res\.?",
    "sres": r"S\.?\s?Res\.?",
    "hjres": r"H\.?\s?J\.?\s?Res\.?",
    "sjres": r"S\.?\s?J\.?\s?Res\.?",
    "hconres": r"H\.?\s?Con\.?\s?Res\.?",
    "sconres": r"S\.?\s?Con\.?\s?Res\.?",
}

# -- id formats ------------------------------------------------------------
LEGACY_BILL = r"^(\d+)-([a-z]+)-(\d+)$"
URN_BILL = r"^bill:us/([^/]+)/([^/]+)/([^/]+)$"
ANY_BILL_TYPE = (
    r"H\.?\s*R\.?|S\.?|H\.?\s*J\.?\s*Res\.?|S\.?\s*J\.?\s*Res\.?"
    r"|H\.?\s*Con\.?\s*Res\.?|S\.?\s*Con\.?\s*Res\.?"
)
PROSE_BILL = (
    r"(?i)^\s*(" + ANY_BILL_TYPE + r")\s*(\d+)"
    r"(?:[,\s(]+(\d+)(?:st|nd|rd|th)?(?:\s*Cong(?:ress)?\.?)?\)?)?\s*$"
)
SECTION_OF_BILL = (
    r"(?i)(?:Sec\.?|Section)\s*(\d+[a-z]?)((?:\([0-9a-zA-Z]+\))*)\s*of\s*"
    r"(" + ANY_BILL_TYPE + r")\s*(\d+)(?:,?\s*(\d+)(?:st|nd|rd|th)?\s*Cong)?"
)
PACKAGE_ID = r"^BILLS-(\d{3})(hr|s|hjres|sjres|hconres|sconres|hres|sres)(\d+)([a-z]+)$"
USC_CITE = r"^usc(?:-chapter|-appendix)?/([^/]+)/(.+)$"
STATUTE_PROSE = r"(?i)^(\d+)\s*U\.?\s*S\.?\s*C\.?\s*[§\.]?\s*(\S+)$"

# -- defaults of the metadata record ---------------------------------------
DEFAULT_STREAM = "legislation"
DEFAULT_TOPIC = "ai_governance"
CORPUS_META = {
    "corpus_version": "v1.0",
    "criteria_version": "v1.0",
    "streams_in_scope": "legislation",
    "streams_out_of_scope": "regulatory,executive",
}
FRESHNESS_SOURCES = ["govinfo", "congress.gov"]
TIERS = ["A", "B"]

# -- defined terms ---------------------------------------------------------
DEFINITIONS_HEADING = r"(?i)^\s*Definitions?\b"
SCOPE_HINTS = [
    (r"(?i)\bIn this Act\b", "bill_local"),
    (r"(?i)\bIn this title\b", "title_local"),
    (r"(?i)\bIn this subtitle\b", "title_local"),
    (r"(?i)\bIn this section\b", "section_local"),
    (r"(?i)\bIn this part\b", "section_local"),
]
DEFAULT_SCOPE = "section_local"
BY_REFERENCE = [
    r"(?i)\bhas the meaning given (?:such term|the term|that term|to such term)\b",
    r"(?i)\bhas the same meaning as\b",
    r"(?i)\bshall have the meaning given (?:such term|the term)\b",
]

# -- amendments ------------------------------------------------------------
OPERATIONS = [
    (r"(?i)\bby striking\b.*\band inserting\b", "strike_and_insert"),
    (r"(?i)\bby inserting (?:after|before|in)\b", "insert"),
    (r"(?i)\bby adding (?:at the end )?the following\b", "add_at_end"),
    (r"(?i)\bby amending\b.*\bto read as follows\b", "replace"),
    (r"(?i)\bto read as follows\b", "replace"),
    (r"(?i)\bby striking\b", "strike"),
    (r"(?i)\bby redesignating\b", "redesignate"),
    (r"(?i)\bis repealed\b", "repeal"),
    (r"(?i)\bby inserting\b", "insert"),
]
DEFAULT_OPERATION = "other"
BEFORE_TEXT = (
    r'(?i)by striking (?:the (?:phrase|word|term|paragraph))?\s*[“"]([^”"]+)[”"]'
)
OPERATION_DISPLAY = {
    "strike": "strike", "insert": "insert", "strike_and_insert": "replace",
    "replace": "replace", "add_at_end": "add-end", "redesignate": "replace",
    "repeal": "strike", "other": "insert",
}

# -- text limits -----------------------------------------------------------

# -- version priority ------------------------------------------------------
STAGE_PRIORITY = {
    "pl": 99, "enr": 90, "eas": 80, "eah": 80, "es": 70, "eh": 70,
    "rs": 60, "rh": 60, "is": 50, "ih": 50, "ats": 40, "ath": 40,
}
VERSION_ORDER = [
    "pl", "enr", "eah", "eas", "es", "eh", "rh", "rs", "pcs", "pp",
    "ath", "ats", "ih", "is",
]

# -- relevance criteria ----------------------------------------------------
ANCHORS = ["artificial intelligence", "machine learning"]
ANCHOR_TOKEN = r"\bAI\b"
EXTRA_TERMS = [
    "facial recognition", "generative ai", "generative artificial intelligence",
    "frontier model", "automated decision systems", "automated decision system",
]
LOCATION_WEIGHTS = {
    "title": 4.0, "short_title": 3.0, "policy_area": 2.5, "subjects": 2.0,
    "summary": 1.0,
}
REVIEW_COLUMNS = [
    "bill_id", "centrality_score", "proposed_tier", "title", "sponsor",
    "introduced_date", "policy_area", "match_locations", "summary_first_200",
    "include (y/n)", "tier (A/B)", "notes",
]

# -- search ----------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
FUSION_K = 60
VECTOR_DIM = 384
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
QUERY_OPERATORS = r'["*]|\b(AND|OR|NOT|NEAR)\b'

# -- shared-term graph -----------------------------------------------------
TERM_DF_MIN = 2
TERM_DF_MAX = 12
MIN_EDGE_WEIGHT = 2
MAX_NODES = 60

# -- answer scoring --------------------------------------------------------
ANSWER_BILL_TYPES = (
    r"(?:H\.R\.|S\.|H\.J\. Res\.|S\.J\. Res\.|H\. Con\. Res\.|S\. Con\. Res\.)"
)
CITE_HEAD = r"Sec\.\s+\d+[a-zA-Z]?"
CITE_SUBS = r"(?:\([^)]+\))*"
CITE_TAIL = r"\s+of\s+" + ANSWER_BILL_TYPES + r"\s+\d+,?\s+\d+(?:st|nd|rd|th)?\s+Cong\."
ANSWER_CITATION = CITE_HEAD + CITE_SUBS + CITE_TAIL
ABSTAIN_SIGNALS = [
    "not in the corpus", "not in my corpus", "outside the corpus",
    "outside the scope", "outside this corpus", "out of scope",
    "out of v1 scope", "not covered", "i don't have", "i don't know",
    "cannot find", "i do not have", "no information", "regulatory",
    "executive order",
]
VALID_CONGRESSES = ["118", "119"]
CONGRESS_AFTER_CHARS = 60
CONGRESS_BEFORE_CHARS = 2000
CONGRESS_AFTER = r"\b(\d{3})(?:st|nd|rd|th)?\b"
CONGRESS_HEADING = r"(?i)\b(\d{3})(?:st|nd|rd|th)\s*Cong(?:ress)?\b"

# -- turn display mode -----------------------------------------------------
MODE_TOOLS = {
    "definition": ["get_defined_terms", "find_bills_defining", "find_definitions_of"],
    "amendment": ["get_amendments", "get_amendments_targeting", "find_bills_amending"],
    "citation": ["get_citation_graph"],
}
MODE_PRIORITY = ["definition", "amendment", "citation", "structure"]
TOOL_LIST_KEYS = ["hits", "amendments", "terms", "edges", "resolved"]

# -- readability breaks ----------------------------------------------------
HEADING_MARKERS = [
    r"\b(?:Sec|SEC)\.\s+\d",
    r"\bTITLE\s+[IVXLC]+",
    r"\bSubtitle\s+[A-Z]\b",
    r"\bPART\s+[IVXLC]+",
    r"\bDIVISION\s+[A-Z]\b",
    r"\bCHAPTER\s+\d",
]
PROVISION_MARKER = r"[.;—]\s+(\((?:\d{1,3}|[A-Za-z]{1,4})\)\s)"
