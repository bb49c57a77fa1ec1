"""Results depend on these exact words, patterns, numbers and sentences."""

# --- fixed values: indicator and verdict vocabulary -----------------------------------
INPUT_TYPES = ["url", "domain", "ip", "hash", "unknown"]
VERDICT_ORDER = ["phishing", "malicious", "suspicious", "safe"]
CLEAN_VERDICTS = ["clean", "harmless", "safe"]
SECOND_FEED_NAME = "URLhaus"
SECOND_FEED_METADATA = ["urlhaus_status", "urlhaus_threat", "urlhaus_blacklists"]
FIRST_FEED_REASON = "VirusTotal: %d malicious, %d suspicious detections"
SECOND_FEED_REASON = "URLhaus: Detected as "
SECOND_FEED_CONFIDENCE = 0.8
BROWSER_SCHEMES = ["chrome", "chrome-extension", "about", "data", "javascript", "file"]
DOMAIN_PATTERN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"
HINT_HASH = r"^[a-fA-F0-9]{32,64}$"
HINT_IP = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
HINT_URL = r"(?i)^(https?://|ftp://|www\.)"
HINT_DOMAIN = r"^[a-zA-Z0-9][a-zA-Z0-9-]{1,61}[a-zA-Z0-9]\.[a-zA-Z]{2,}$"

# --- fixed values: URL rules ----------------------------------------------------------
URL_PATTERN = r"https?://[!$-_a-z]+"
MODEL_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq"]
MODEL_PATH_WORDS = r"(signin|login|account|verify|secure|banking|password)"
MODEL_ACTION_PAGE = r"(update|confirm|verify|secure|account).*\.(php|html)"
PARSE_PATH_WORDS = r"(password|login|account|bank|verify|security)"
IP_URL = r"https?://\d+\.\d+\.\d+\.\d+"
AT_URL = r"https?://.*?@"
SHORTENERS = ["bit.ly", "tinyurl", "t.co", "goo.gl"]

# --- fixed values: e-mail lexicon -----------------------------------------------------
LEXICON = {
    "urgent": ["urgent", "immediate", "action required", "account suspended", "verify now",
               "limited time", "expires soon"],
    "financial": ["bank", "account", "credit card", "payment", "transfer", "transaction",
                  "money", "billing"],
    "security": ["password", "login", "verify", "security", "update required", "unauthorized",
                 "suspicious activity"],
    "personal": ["ssn", "social security", "date of birth", "personal details", "confidential",
                 "identity"],
    "threat": ["suspended", "blocked", "unauthorized", "suspicious", "limited", "locked",
               "terminated"],
    "action": ["click here", "sign in", "confirm", "verify", "validate", "update", "download",
               "open attachment"],
}
SENSITIVE_KEYWORDS = ["password", "credit card", "social security", "bank account",
                      "login credentials"]

# --- fixed values: greeting and signature patterns ------------------------------------
GREETINGS = [
    r"^\s*hi,?\s+[a-z\s]+!?",
    r"^\s*dear\s+\w+",
    r"^\s*hello\s+\w+",
    r"^\s*good\s+(?:morning|afternoon|evening)[,\s]+\w+",
    r"^\s*greetings",
    r"^\s*to\s+whom\s+it\s+may\s+concern",
    r"^\s*hi\s+(?:all|team|everyone)",
    r"^\s*dear\s+(?:sir|madam|team)",
]
PERSONAL_GREETING = (
    r"^\s*(?:dear|hi|hello|hey|good\s+(?:morning|afternoon|evening))\s+[a-z]+\b")
SIGNATURES = [
    r"copyright\s+©.*reserved",
    r"this\s+is\s+a\s+system-generated",
    r"(?:regards|sincerely|yours|best|cheers)[,\s]*(?:\r?\n|\s*$)",
    r"(?:^|\n)\s*(?:regards|sincerely|yours|best),?\s*\n\s*[a-z\s.]+$",
    r"(?:^|\n)\s*[-_]{2,}\s*\n.*?(?:@|phone|tel|www)",
    r"(?:^|\n)\s*[a-z\s.]+\n.*?(?:department|division|team|inc\.|corp\.)",
    r"(?:^|\n)\s*(?:office|cell|tel|fax|email):\s*[0-9@a-z.]+",
    r"(?:^|\n)\s*www\.[a-z0-9-]+\.[a-z]{2,}",
]
COMPANY_SIGNATURES = [
    r"(?:inc\.|corp\.|ltd\.|limited|company)",
    r"(?:department|division|team)",
    r"(?:www\.[a-z0-9-]+\.[a-z]{2,})",
]

# --- fixed values: service e-mail patterns --------------------------------------------
SERVICE_SENDER = r"^.*?support@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}$"
SERVICE_BODY = [
    r"account information|your account",
    r"help center|customer support|contact us",
    r"hi\s+[a-z\s]+|dear\s+[a-z\s]+",
    r"unsubscribe|opt.?out",
]
SERVICE_LANGUAGE = [
    r"subscription|premium|plan|renewal|account",
    r"welcome to|thank you for|you're all set",
    r"help center|customer support|contact us",
    r"account information|your account",
    r"renewal date|expiration date",
]

# --- fixed values: mail headers -------------------------------------------------------
REQUIRED_HEADERS = ["From", "To", "Subject", "Date"]
SUSPICIOUS_HEADERS = ["X-PHP-Script", "X-Mailer"]

# --- fixed values: model vector order and learner settings ----------------------------
MODEL_FEATURES = [
    "text_length", "word_count", "avg_word_length", "url_count", "suspicious_url_count",
    "url_to_text_ratio", "contains_urgent", "contains_financial", "contains_security",
    "contains_personal", "contains_threat", "contains_action", "uppercase_ratio",
    "digit_ratio", "punctuation_ratio", "has_greeting", "has_signature", "contains_html",
    "html_tag_count", "mismatched_links", "has_multipart", "html_to_text_ratio",
    "has_base64", "has_script", "has_iframe", "has_form",
]
TFIDF = {"max_terms": 2000, "min_df": 5, "max_df": 0.95}
FOREST = {"numTrees": 300, "maxDepth": 15, "minInstancesPerNode": 4, "seed": 42}
BOOSTED = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
           "featureSubsetStrategy": "0.8", "seed": 42}
BOOSTED_RETRAIN = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "seed": 42}

# --- fixed values: displayed feature weights ------------------------------------------
FEATURE_WEIGHTS = {
    "url_structure": {"length": 0.15, "special_chars": 0.10, "subdomain_depth": 0.08,
                      "path_depth": 0.07},
    "domain_analysis": {"age": 0.12, "registration_length": 0.08, "suspicious_tld": 0.09},
    "security_indicators": {"ssl_valid": 0.10, "whois_privacy": 0.06, "dns_records": 0.08},
    "content_analysis": {"forms_present": 0.07, "external_links": 0.06, "obfuscation": 0.05},
}
