"""Closed vocabularies. The meaning of stored data depends on them."""

SOURCE_OK = "SOURCE_OK"
SOURCE_CODES = (
    "SOURCE_OK", "SOURCE_UNREACHABLE", "SOURCE_DEAD_LINK", "SOURCE_BOT_BLOCKED", "SOURCE_EMPTY", "SOURCE_PAYWALLED",
    "SOURCE_DRIFTED", "SOURCE_ROBOTS_EXCLUDED", "SOURCE_NOT_HTML", "SOURCE_NO_TEXT_LAYER", "SOURCE_UNREADABLE_ENCODING",
)
VERDICTS = ("SUPPORTED", "PARTIALLY_SUPPORTED", "NOT_FOUND_IN_SOURCE", "CONTRADICTED")
SPAN_REQUIRED = ("SUPPORTED", "PARTIALLY_SUPPORTED", "CONTRADICTED")
REFUSED = "JUDGE_REFUSED"
FABRICATED = "JUDGE_FABRICATED_SPAN"
SUSPECT = "EXTRACTION_SUSPECT"
ADDED_LATER = "SPAN_ADDED_AFTER_GENERATION"
LABELS = (*VERDICTS, "UNAUDITABLE", "UNDECIDABLE")
DRIFT = ("NONE", "PAGE_CHANGED", "PAGE_REPLACED", "NO_SNAPSHOT", "NOT_CHECKED")
STATES = ("SUPPORTED", "PARTIALLY_SUPPORTED", "NOT_SUPPORTED", "MIXED", "COULD_NOT_VERIFY", "NOT_CHECKED")
NO_CITATIONS = "NO_CITATIONS"
NO_CALIBRATION = "NO_CALIBRATION"
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"
UNPUBLISHABLE = "UNPUBLISHABLE_SOURCE"
CONFLICTED = "CONFLICTED_PRODUCT"
BINDINGS = ("CAPTURE_UNBOUND", "QUERY_NOT_FROZEN", "QUERY_UNKNOWN")
#: Substrings of key names that no published schema may hold.
BANNED_KEYS = ("confidence", "certainty", "probability", "trust_score", "score")
#: 97.5 % point of the normal distribution.
Z95 = 1.959963984540054
#: At least so many blind labels that compare before an answer's rate is published, and so many standing pairs for a publisher's.
MIN_BLIND = 30
MIN_STANDING = 2
EMPTY_CHARS = 200
THIN_BYTES, THIN_RATIO = 50_000, 0.002
BOT_BYTES = 8_000
CHANGED_BELOW, REPLACED_BELOW, SHINGLE_WORDS = 0.80, 0.10, 5

DEAD_STATUSES = (404, 410)
BLOCKED_STATUSES = (401, 403, 429)
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "igshid")
TWO_PART_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "nhs.uk", "sch.uk", "com.au", "gov.au", "edu.au", "org.au", "co.nz",
    "govt.nz", "co.jp", "go.jp", "ac.jp", "com.br", "gov.br", "co.in", "gov.in", "nic.in", "ac.in", "com.cn",
    "gov.cn", "edu.cn", "co.za", "gov.za",
)
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml", "text/plain")
PDF_TYPES = ("application/pdf", "application/x-pdf")
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XML_TYPES = ("application/xml", "text/xml", "application/rss+xml", "application/atom+xml")
PAYWALL_MARKERS = (
    "subscribe to continue", "subscribe to read", "this article is for subscribers", "subscribers only",
    "already a subscriber", "create an account to continue reading", "to continue reading", "metered paywall", "paywall",
)
CONSENT_MARKERS = (
    "accept all cookies", "we value your privacy", "manage your cookie preferences", "before you continue to",
    "enable javascript and cookies to continue", "consent to the use of cookies",
)
BOT_MARKERS = (
    "abuse-detection", "abuse detection", "excessive-requests", "excessive requests", "/apology_objects/",
    "unusual traffic", "are you a robot", "verify you are human", "checking your browser before accessing",
    "cf-browser-verification",
)
PICTURE_TAGS = ("<img", "<svg", "<picture", "<canvas", "<figure")
FURNITURE = (
    "give feedback", "copy", "share", "sources", "retry", "edit", "regenerate", "show more", "show less", "read more",
    "learn more", "see all", "expand", "was this helpful", "good response", "bad response", "related", "people also ask",
)
STOPWORDS = tuple(
    "a an and are as at be been but by for from had has have in is it its of on or that the their there these they this "
    "to was were which will with would".split()
)
URL_KEYS = ("url", "uri", "link", "source_url", "sourceUrl", "web_url", "canonical_url")
TITLE_KEYS = ("title", "name", "site", "domain", "source", "publisher", "displayed_text")
LIST_KEYS = ("citations", "sources", "references", "search_results", "urls", "links")
SIGNATURE_IGNORED = ("et", "al", "the", "and", "study", "paper", "trial", "report", "review", "analysis")
#: Products whose vendor also makes the default judge.
CONFLICTED_PRODUCTS = ("google", "google_aio", "gemini")
#: Punctuation that a reader takes for the same, by character; what isn't visible is dropped.
FOLDED = {
    "\u2018": "'",  # left single quotation mark
    "\u2019": "'",  # right single quotation mark
    "\u201a": "'",  # single low-9 quotation mark
    "\u201b": "'",  # single high-reversed-9 quotation mark
    "\u2032": "'",  # prime
    "\u02bc": "'",  # modifier letter apostrophe
    "\u201c": '"',  # left double quotation mark
    "\u201d": '"',  # right double quotation mark
    "\u201e": '"',  # double low-9 quotation mark
    "\u201f": '"',  # double high-reversed-9 quotation mark
    "\u2033": '"',  # double prime
    "\u00ab": '"',  # left-pointing double angle quotation mark
    "\u00bb": '"',  # right-pointing double angle quotation mark
    "\u2010": '-',  # hyphen
    "\u2011": '-',  # non-breaking hyphen
    "\u2012": '-',  # figure dash
    "\u2013": '-',  # en dash
    "\u2014": '-',  # em dash
    "\u2015": '-',  # horizontal bar
    "\u2212": '-',  # minus sign
    "\u2043": '-',  # hyphen bullet
    "\u2026": '...',  # horizontal ellipsis
    "\u00ad": '',  # soft hyphen
    "\u200b": '',  # zero width space
    "\u200c": '',  # zero width non-joiner
    "\u200d": '',  # zero width joiner
    "\u2060": '',  # word joiner
    "\ufeff": '',  # zero width no-break space
}
#: Kinds of works named in prose, and the forms they take.
NAMED = (
    ("AUTHOR_ETAL_YEAR", r"\b[A-Z][A-Za-z'’\-]+(?:,\s+[A-Z][A-Za-z'’\-]+){0,5}\s+et\s+al\.?,?\s*[^.;)\n]{0,80}?\b(?:19|20)\d{2}\b"),
    ("AUTHOR_ETAL_YEAR", r"\b(?:19|20)\d{2}\b[^.;)\n]{0,60}?\b[A-Z][A-Za-z'’\-]+(?:,\s+[A-Z][A-Za-z'’\-]+){0,5}\s+et\s+al\.?"),
    ("TRIAL_ID", r"\bNCT\d{8}\b"),
    ("DOI", r"\b10\.\d{4,9}/[^\s,;)\]]+"),
    ("PUBLICATION_ID", r"\bPMID:?\s*\d{7,8}\b"),
    ("PUBLICATION_ID", r"\bPMC\d{6,8}\b"),
    ("PUBLICATION_ID", r"\barXiv:\s?(?:\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})\b"),
    ("PUBLISHED_IN", r"\bpublished\s+in\s+[A-Z][A-Za-z&\-]+(?:\s+[A-Z][A-Za-z&\-]+){0,4}[^.\n]{0,30}?\b(?:19|20)\d{2}\b"),
    ("YEAR_JOURNAL_STUDY", r"\b(?:19|20)\d{2}\s+[A-Z][A-Za-z&\-]+(?:\s+[A-Z][A-Za-z&\-]+){0,3}\s+(?:study|paper|trial|analysis|report|review)\b"),
)

#: Where each product's pages hold an answer: selectors in the order they are tried. Fixed values.
ADAPTERS = {
    "claude": (".bg-surface-3 .standard-markdown", ".font-claude-response", "[data-testid='chat-stale-nav-inert'] .standard-markdown"),
    "chatgpt": ('[data-message-author-role="assistant"]', "div.markdown.prose"),
    "perplexity": (".prose", '[class*="answer"]'),
    "google-ai-overviews": ('[data-attrid*="AIOverview"]', "#rcnt div[data-async-type]"),
    "generic": ("article", "main", "body"),
}

#: Hosts of the products' own pages, which no answer cites. Fixed values.
OWN_HOSTS = (
    "support.anthropic.com", "claude.ai", "chatgpt.com", "chat.openai.com", "help.openai.com", "www.perplexity.ai", "perplexity.ai",
    "policies.google.com", "support.google.com", "accounts.google.com",
)
