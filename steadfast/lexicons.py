"""Fixed values. Results depend on these exact lists, patterns and grids."""

import math

# ---------------------------------------------------------------- severities
SEVERITIES = (0.0, 0.25, 0.5, 0.75, 1.0)
REWRITE_SEVERITIES = (0.25, 0.5, 0.75, 1.0)
AUGMENT_SEVERITIES = (0.5, 1.0)

SEED = 42
TEST_FRACTION = 0.2
CV_FOLDS = 5
DETECT_THRESHOLD = 0.5
TARGET_FPR = 0.01
N_BOOTSTRAP = 1000
CI_LEVEL = 0.95
N_PERMUTATIONS = 10_000
ROBUST_DROP = 0.03
ALPHA = 0.05
MAX_TERMS = 20_000
MIN_DOC_FREQ = 2
MIN_CONTENT_TOKENS = 5

# ---------------------------------------------------------------- whitespace
# Unicode whitespace as the body of a character class, spelled out because the
# shorthand \s covers different characters in different regex engines.
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters as a plain string, for trimming.
SPACE_LIST = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
SPACES = f"[{SPACE_CHARS}]+"
NOT_SPACE = f"[^{SPACE_CHARS}]"

# ---------------------------------------------------------------------- URLs
# Greedy form: feature counts, masking, defanging.
GREEDY_URL = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
GREEDY_URL_DEFANGED = rf"hxxps?://{NOT_SPACE}+|www\[\.\]{NOT_SPACE}+"
# Strict form, ends at quotes and brackets: retention checks only.
STRICT_URL = (
    rf"https?://[^{SPACE_CHARS}<>\x22\x27)\]]+|www\.[^{SPACE_CHARS}<>\x22\x27)\]]+"
)
URL_TRAILING = "/.,;:!?)]}>\"'"
URL_HOST = rf"^(?:https?://)?(?:www\.)?([^/{SPACE_CHARS}:]+)"
IPV4_HOST = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
ASSET_SUFFIX = r"\.(?:png|jpe?g|gif|css|js|ico|svg|woff2?)(?:\?|$)"

INCIDENTAL_HOSTS = (
    "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com",
    "pinterest.com", "plus.google.com", "t.me", "whatsapp.com", "doubleclick.net",
    "sendgrid.net", "rds.yahoo.com", "list-manage.com", "mailchimp.com", "exct.net",
    "sparkpostmail.com", "mcsv.net", "w3.org", "verisign.com", "validator.w3.org",
    "sourceforge.net", "apache.org", "adobe.com", "monkey.org",
)
INCIDENTAL_PATHS = (
    "unsubscribe", "optout", "opt-out", "listinfo", "mailman", "/list/", "preferences",
    "manage-subscription", "email-preferences", "remove?",
)
ASK_PATHS = (
    "login", "signin", "sign-in", "verify", "secure", "account", "update", "confirm",
    "webscr", "cmd=", "banking", "password", "auth", "session", "validate", "unlock",
    "resolve", "billing", "payment", "wp-admin", "/r/", "redirect", "logon",
    "authenticate", "ebayisapi",
)
KNOWN_BRANDS = (
    "paypal.com", "ebay.com", "ebay.co.uk", "amazon.com", "apple.com", "microsoft.com",
    "google.com", "yahoo.com", "ncua.gov", "usaa.com", "wellsfargo.com", "chase.com",
    "bankofamerica.com", "citi.com", "hsbc.com", "barclays.co.uk", "natwest.com",
    "halifax.co.uk", "scotiabank.com", "creditunions.com", "irs.gov", "fdic.gov",
)

# ------------------------------------------------------------------ refusals
REFUSAL_MARKERS = (
    "i appreciate you testing", "i can't help", "i cannot help", "i'm unable",
    "i am unable", "doesn't contain", "does not contain", "could you provide",
    "please provide the", "as an ai", "i'm not able", "i am not able",
    "appears to be corrupted", "appears to be incomplete", "i need a complete",
    "no identifiable",
)

# ------------------------------------------------------------------- urgency
URGENCY_WORDS = (
    "urgent", "immediately", "verify", "suspend", "suspended", "expire", "expires",
    "act now", "account", "confirm", "password", "click here", "limited time",
    "warning", "alert", "important", "required", "update",
)

# ---------------------------------------------------------------------- HTML
ANY_TAG = r"</?[a-zA-Z][^>]*>"
LISTED_TAG = rf"<[{SPACE_CHARS}]*(html|body|table|div|span|a|br|p|img|font)\b"
LINK_ATTRIBUTES = (("a", "href"), ("area", "href"), ("form", "action"))
SKIPPED_LINKS = ("mailto:", "javascript:", "tel:", "data:", "#")

# -------------------------------------------------------------------- tokens
TERM = r"[\p{L}\p{N}_]{2,}"

# P(X <= k), k = 0, 1, 2, ... of the unit-rate Poisson law. A uniform u maps to the
# number of entries that are <= u.
POISSON_CDF = tuple(
    round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 15) for k in range(13)
)

HANDCRAFTED = (
    "hc_char_len", "hc_word_len", "hc_url_count", "hc_urgency_count",
    "hc_exclaim_count", "hc_digit_ratio", "hc_caps_ratio", "hc_had_html",
)
METRICS = ("roc_auc", "pr_auc", "f1", "precision", "recall")
