"""Word lists, codes, patterns and texts whose content defines the results.

Everything here is data that must be exactly as it is for results to be right.
No logic lives in this module.
"""

# --- Event contract -------------------------------------------------------
SCHEMA_VERSION = 1
EVENT_TYPE = "browser_navigation"
BROWSER = "edge"
EVENT_SOURCE = "edge_extension"
NAVIGATION_KINDS = ["committed", "history_state"]
INTEGRATION = "edge-phishing-classifier"
WEB_SCHEMES = ["http", "https"]
MAX_URL_LENGTH = 8192
MAX_ID_LENGTH = 128
MAX_TRANSITION_LENGTH = 64
MAX_QUALIFIERS = 16

# --- Redaction ------------------------------------------------------------
REDACTED = "[REDACTED]"
SENSITIVE_PARAMETERS = [
    "access_token", "api_key", "apikey", "auth", "authorization", "code",
    "key", "password", "session", "session_id", "token",
]
SEARCH_PARAMETERS = ["p", "pq", "q", "query", "search", "text"]
SEARCH_DOMAINS = ["bing.com", "google.com", "duckduckgo.com", "search.yahoo.com"]

# --- Lexical features -----------------------------------------------------
MODERN_FEATURES = [
    "url_length", "hostname_length", "path_length", "query_length",
    "digit_ratio", "special_character_count", "subdomain_count", "path_depth",
    "hostname_is_ip", "contains_at", "contains_punycode", "hostname_has_dash",
    "character_entropy", "suspicious_token_count", "known_shortener",
    "uses_https", "explicit_port", "query_parameter_count",
]
SUSPICIOUS_TOKENS = [
    "account", "auth", "confirm", "credential", "invoice", "login", "password",
    "payment", "recover", "secure", "signin", "support", "suspend", "update",
    "verify", "wallet",
]
SHORTENER_HOSTS = [
    "bit.ly", "buff.ly", "cutt.ly", "is.gd", "lnkd.in", "ow.ly", "rebrand.ly",
    "shorturl.at", "t.co", "tiny.cc", "tinyurl.com", "v.gd",
]
LEGACY_FEATURES = [
    "have_ip", "have_at", "url_length", "url_depth", "redirection",
    "https_domain", "tiny_url", "prefix_suffix", "dns_record", "domain_age",
    "domain_end", "iframe", "mouse_over", "right_click", "web_forwards",
]
# Column names of the labelled feature files written from the legacy features.
FEATURE_FILE_COLUMNS = [
    "Domain", "Have_IP", "Have_At", "URL_Length", "URL_Depth", "Redirection",
    "https_Domain", "TinyURL", "Prefix/Suffix", "DNS_Record", "Domain_Age",
    "Domain_End", "iFrame", "Mouse_Over", "Right_Click", "Web_Forwards", "Label",
]
# Services looked for anywhere in a URL, ignoring case.
SHORTENING_SERVICES = [
    "bit.ly", "goo.gl", "shorte.st", "go2l.ink", "x.co", "ow.ly", "t.co",
    "tinyurl", "tr.im", "is.gd", "cli.gs", "yfrog.com", "migre.me", "ff.im",
    "tiny.cc", "url4.eu", "twit.ac", "su.pr", "twurl.nl", "snipurl.com",
    "short.to", "budurl.com", "ping.fm", "post.ly", "just.as", "bkite.com",
    "snipr.com", "fic.kr", "loopt.us", "doiop.com", "short.ie", "kl.am",
    "wp.me", "rubyurl.com", "om.ly", "to.ly", "bit.do", "lnkd.in", "db.tt",
    "qr.ae", "adf.ly", "bitly.com", "cur.lv", "ity.im", "q.gs", "po.st",
    "bc.vc", "twitthis.com", "u.to", "j.mp", "buzurl.com", "cutt.us", "u.bb",
    "yourls.org", "prettylinkpro.com", "scrnch.me", "filoops.info",
    "vzturl.com", "qr.net", "1url.com", "tweez.me", "v.gd", "link.zip.net",
]
LONG_URL_LENGTH = 54
REDIRECT_POSITION = 7

# --- Page content patterns (the first is a character class on purpose) ----
IFRAME_PATTERN = r"[<iframe>|<frameBorder>]"
MOUSE_OVER_PATTERN = r"<script>[^\n]+onmouseover[^\n]+</script>"
RIGHT_CLICK_PATTERN = r"event[^\n]button ?== ?2"
MAX_CLEAN_REDIRECTS = 2
PAGE_MAX_BYTES = 1024 * 1024

# --- Reputation -----------------------------------------------------------
PROVIDERS = ["phishtank", "google_webrisk", "disabled"]
PHISHTANK = "phishtank"
WEB_RISK = "google_webrisk"
THREAT_TYPES = ["SOCIAL_ENGINEERING", "MALWARE", "UNWANTED_SOFTWARE"]
TRUE_WORDS = ["true", "yes", "y", "1"]
PHISHTANK_MAX_BYTES = 1024 * 1024
WEB_RISK_MAX_BYTES = 65536

# --- URL lists ------------------------------------------------------------
UNVERIFIED_WORDS = ["0", "false", "n", "no", "u", "unverified"]
VERIFIED_WORDS = ["1", "true", "y", "yes", "verified"]
LIST_KEYS = ["results", "entries", "urls"]

# --- Alert policy: role, level, staging level, groups, technique, text ----
TECHNIQUE = "T1566.002"
ALERT_LEVELS = {
    "navigation": 5, "base": 0, "reputation": 10, "ml": 9, "review": 7,
    "error": 5, "negative": 0,
}
STAGING_NEGATIVE_LEVEL = 3
NAVIGATION_RULE_ID = "100100"
ALERT_RULE_OFFSETS = {
    "base": 10, "reputation": 11, "error": 12, "negative": 13, "ml": 14, "review": 15,
}
ALERT_GROUPS = {
    "navigation": ["browser_navigation", "pilot_transport"],
    "phishtank": ["phishing", "confirmed_phishing", "phishtank"],
    "google_webrisk": ["phishing", "confirmed_phishing", "google_web_risk"],
    "ml": ["phishing", "ml_detection"],
    "review": ["phishing", "ml_review"],
    "error": ["phishing_detection_error"],
    "negative": [],
    "base": [],
}
NEGATIVE_STATUSES = ["not_found", "listed_inactive", "unlikely"]
# {name} is replaced by the field of that name.
ALERT_TEXTS = {
    "navigation": "URL was opened in Microsoft Edge: {url_host} [event_id={event_id}]",
    "phishtank": "A URL opened by a user on {url_host} was verified as phishing by PhishTank.",
    "google_webrisk": "A URL opened by a user on {url_host} was identified as {threat_types} by Google Web Risk.",
    "ml": "ML detected a suspicious URL on {url_host} with score {score} [model={model_kind}, calibrated={calibrated}].",
    "review": "ML marked a URL on {url_host} for review with score {score} [review_threshold={review_threshold}, suspicious_threshold={threshold}].",
    "error": "URL classification failed: {error}",
    "negative": "URL was not classified as phishing: {url_host}",
    "base": "Edge phishing classification result.",
}

# --- Special-purpose address blocks that are not globally reachable ----------
# Blocks and exceptions of the public IANA special-purpose address registry.
NON_GLOBAL_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8",
    "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
GLOBAL_IPV4_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]

NON_GLOBAL_IPV6 = [
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64",
    "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7",
    "fe80::/10",
]
GLOBAL_IPV6_EXCEPTIONS = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
]

# --- Characters a host may not hold because they fold to URL delimiters ---
HOST_FOLDING_CHARACTERS = (
    "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖"
    "﹟﹫＃／：？＠"
)
# Digits outside the decimal-number category (superscripts, circled digits, …).
EXTRA_DIGIT_CLASS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}"
    r"\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}"
    r"\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)

# --- Model bundle ---------------------------------------------------------
MODEL_KIND = "calibrated_url_classifier"
LEGACY_MODEL_KIND = "legacy_svr"
DEFAULT_THRESHOLD = 0.8
LEGACY_THRESHOLD = 0.5
REVIEW_THRESHOLD = 0.07

# Texts that name why a lookup was not made.
CIRCUIT_TEXT = "Google Web Risk circuit breaker is open"
QUOTA_TEXT = "Google Web Risk monthly request guard reached"
REQUEST_TEXT = "Google Web Risk request failed"
DISABLED_TEXT = "reputation provider is disabled"
