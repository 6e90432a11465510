"""Word lists, thresholds and defaults that results depend on."""

# --- fixed values: vendors -------------------------------------------------
VENDORS = [
    "WORKDAY", "GREENHOUSE", "LEVER", "SMARTRECRUITERS", "ICIMS", "TALEO", "SUCCESSFACTORS",
]
UNKNOWN_VENDOR = "UNKNOWN"

# host fragments that identify a vendor, first match wins
VENDOR_HOSTS = [
    ("WORKDAY", ["workdayjobs"]),
    ("GREENHOUSE", ["greenhouse.io", "grnh.se"]),
    ("LEVER", ["jobs.lever.co", "api.lever.co", "apply.lever.co"]),
    ("SMARTRECRUITERS", ["smartrecruiters.com"]),
    ("ICIMS", ["icims.com"]),
    ("TALEO", ["taleo.net"]),
    ("SUCCESSFACTORS", ["successfactors", "jobs.sap.com"]),
]

# markers in page text that identify a vendor, first match wins
VENDOR_HTML_MARKERS = [
    ("WORKDAY", ["workdayjobs", "/wday/cxs/"]),
    ("GREENHOUSE", ["greenhouse.io", "grnh.se/"]),
    ("LEVER", ["lever.co"]),
    ("SMARTRECRUITERS", ["smartrecruiters.com"]),
    ("ICIMS", ["icims.com/jobs", "careers.icims.com", "jobs.icims.com"]),
    ("TALEO", ["taleo.net/careersection/", "taleo.net/careersection2/"]),
    ("SUCCESSFACTORS", ["successfactors", "jobs.sap.com"]),
]

# hosts treated as a vendor landing page by the URL classifier
VENDOR_LANDING_HOSTS = [
    "workdayjobs", "greenhouse.io", "grnh.se", "jobs.lever.co", "api.lever.co", "apply.lever.co",
    "smartrecruiters.com", "icims.com", "taleo.net", "successfactors.com", "jobs.sap.com",
]

# --- fixed values: URL hints -----------------------------------------------
JOB_PATH_HINTS = [
    "/careers", "/jobs", "/job", "/openings", "/positions", "/job-search", "/search-jobs",
]
JOB_LIKE_PATH_HINTS = [
    "/careers", "/career", "/jobs", "/job", "/join-us", "/opportunit", "/vacanc",
    "/open-positions", "/work-with-us",
]
ASSET_EXTENSIONS = [
    ".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".pdf", ".zip", ".xml", ".gz",
]
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["gclid", "fbclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi"]
CANDIDATE_TRACKING_KEYS = ["ref", "source", "gh_src", "lever-source"]
INVALID_POSTING_PREFIX = "https://community.workday.com/invalid-url"

# --- fixed values: careers pages -------------------------------------------
CAREER_LINK_KEYWORDS = [
    "careers", "career", "jobs", "job", "join", "talent", "opportunit", "work-with-us",
    "open-positions",
]
LANDING_FALLBACK_PATHS = [
    "/careers", "/careers/", "/jobs", "/jobs/", "/about/careers", "/careers/jobs",
]
CAREERS_COMMON_PATHS = [
    "/careers", "/jobs", "/careers/jobs", "/about/careers", "/join-us", "/careers/search",
    "/careers/opportunities", "/careers/openings", "/jobs/search",
]
ATTEMPT_VENDOR_HOSTS = [
    "boards.greenhouse.io", "job-boards.greenhouse.io", "jobs.lever.co", "apply.lever.co",
    "myworkdayjobs.com", "smartrecruiters.com",
]
ATTEMPT_COMMON_PATHS = ["/careers", "/jobs", "/about/careers", "/careers/jobs"]

# --- fixed values: company names and domains -------------------------------
NON_EMPLOYER_WORDS = [
    "etf", "fund", "trust", "acquisition", "spac", "lp", "holdings trust", "depositary",
    "depository", "notes", "warrant", "unit", "units",
]
CORPORATE_SUFFIXES = [
    "INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC", "LLC", "LP", "AG",
    "SA", "NV", "HOLDING", "HOLDINGS", "GROUP", "TRUST",
]
WEAK_NAME_TOKENS = [
    "the", "and", "company", "group", "holdings", "holding", "inc", "corp", "co", "plc", "ltd",
    "llc",
]
DOMAIN_TLDS = ["com", "io", "ai", "co", "net", "org"]
MAX_DOMAIN_CANDIDATES = 6
TOP_SLUGS_ON_ALL_TLDS = 2
PARKED_PAGE_HINTS = [
    "domain for sale", "buy this domain", "this domain may be for sale", "sedo domain parking",
    "godaddy", "dan.com", "domaineasy", "afternic", "hugedomains", "parkingcrew", "bodis",
    "parked free",
]
PARKED_HOSTS = [
    "domaineasy.com", "dan.com", "sedo.com", "afternic.com", "hugedomains.com",
    "parkingcrew.net", "bodis.com",
]
INFOBOX_VENDOR_HOSTS = [
    "boards.greenhouse.io", "greenhouse.io", "jobs.lever.co", "lever.co", "myworkdayjobs.com",
    "workdayjobs.com", "smartrecruiters.com", "icims.com", "jobvite.com", "breezy.hr",
    "ashbyhq.com",
]
KNOWLEDGE_BASE_CONFIDENCE = 0.95
INFOBOX_CONFIDENCE = 0.9
HEURISTIC_CONFIDENCE = 0.7

# --- fixed values: eligibility and retry -----------------------------------
SEMI_PERMANENT_RESOLUTION = ["NO_ITEM", "NO_P856", "INVALID_WEBSITE_URL"]
SEMI_PERMANENT_DISCOVERY = [
    "DISCOVERY_NO_MATCH", "DISCOVERY_ATS_DETECTED_NO_ENDPOINT", "DISCOVERY_SITEMAP_NO_URLS",
    "DISCOVERY_SITEMAP_FETCH_FAILED", "DISCOVERY_HOMEPAGE_TOO_LARGE",
]
CACHE_TTL_MINUTES = 720
SEMI_PERMANENT_RETRY_HOURS = 168
BACKOFF_MINUTES = [5, 15, 60, 360, 1440]
ROBOTS_COOLDOWN_DAYS = 14
SUCCESS_INTERVAL_MINUTES = 60
RUN_ACTIVE_MINUTES = 10
RATE_LIMIT_MAX_STATE = 6
RATE_LIMIT_BASE_SECONDS = 30
RATE_LIMIT_MAX_SECONDS = 3600
TRANSIENT_MAX_STATE = 4
TRANSIENT_BASE_SECONDS = 15
TRANSIENT_MAX_SECONDS = 600
OTHER_ERROR_SECONDS = 20
PER_HOST_DELAY_MS = 1000

# --- fixed values: statuses ------------------------------------------------
STATUS_RANK = {"RUNNING": 4, "SUCCEEDED": 3, "FAILED": 2, "SKIPPED": 1}
STAGE_RANK = {"ATS_ADAPTER": 4, "JSONLD": 3, "ROBOTS_SITEMAP": 2, "DOMAIN": 1}
BENIGN_FETCH_STATUSES = [
    "discovered", "jobposting_found", "ats_detected", "ats_detected_probe_failed",
    "ats_detected_from_hint", "ats_fetch_success", "no_jobposting_structured_data",
    "skipped_known_no_structured_data",
]
RETRYABLE_REASONS = ["TIMEOUT", "DNS_FAILURE", "TLS_FAILURE", "HTTP_429_RATE_LIMIT", "HTTP_5XX"]

# raw discovery reason -> (reason code, stage)
DISCOVERY_REASONS = {
    "discovery_homepage_blocked_by_robots": ("ROBOTS_BLOCKED", "HOMEPAGE"),
    "discovery_sitemap_blocked_by_robots": ("ROBOTS_BLOCKED", "SITEMAP"),
    "discovery_careers_blocked_by_robots": ("ROBOTS_BLOCKED", "ROBOTS_SITEMAP"),
    "discovery_blocked_by_robots": ("ROBOTS_BLOCKED", "ROBOTS_SITEMAP"),
    "discovery_sitemap_fetch_failed": ("SITEMAP_NOT_FOUND", "SITEMAP"),
    "discovery_sitemap_no_urls": ("SITEMAP_NOT_FOUND", "SITEMAP"),
    "discovery_homepage_too_large": ("PARSING_FAILED", "HOMEPAGE"),
    "discovery_host_cooldown": ("HOST_COOLDOWN", "COOLDOWN"),
    "discovery_company_cooldown": ("HOST_COOLDOWN", "COOLDOWN"),
    "discovery_host_failure_cutoff": ("HOST_COOLDOWN", "COOLDOWN"),
    "discovery_time_budget_exceeded": ("TIMEOUT", "BUDGET"),
    "discovery_no_domain": ("NO_DOMAIN", "DOMAIN"),
    "discovery_ats_detected_no_endpoint": ("ATS_NOT_FOUND", "ATS_DETECTED"),
    "discovery_no_match": ("ATS_NOT_FOUND", "PAGE_SCAN"),
}
ROBOTS_DISCOVERY_REASONS = [
    "discovery_blocked_by_robots", "discovery_homepage_blocked_by_robots",
    "discovery_sitemap_blocked_by_robots", "discovery_careers_blocked_by_robots",
]

# confidence of an endpoint by how it was found, in the order methods are tried
ENDPOINT_METHODS = {
    "homepage_link": 0.95,
    "sitemap": 0.92,
    "careers_landing": 0.9,
    "vendor_probe": 0.9,
    "link": 0.85,
    "careers_path": 0.85,
}

# --- fixed values: limits and gates ----------------------------------------
MAX_POSTINGS_PER_FEED = 400
WORKDAY_PAGE_SIZE = 20
SITEMAP_MAX_DEPTH = 3
SITEMAP_MAX_DOCUMENTS = 50
SITEMAP_MAX_URLS = 200
SITEMAP_CANDIDATE_BUDGET = 300
PROBE_LIMIT = 25
ERROR_DETAIL_CHARS = 1000
BUDGET_MAX_TOTAL = 5000
BUDGET_MAX_PER_HOST = 75
BUDGET_MAX_429_RATE = 0.08
BUDGET_MIN_REQUESTS_FOR_429 = 25
BUDGET_MAX_CONSECUTIVE_ERRORS = 25
GATE_MIN_HOSTS = 1000
GATE_MIN_URLS = 2000
GATE_MIN_ATTEMPTS_PER_MINUTE = 10.0
GATE_SUCCESS_RATE = 0.45
GATE_MIN_PROCESSED = 20

# --- fixed values: vendor links in pages -----------------------------------
# (vendor, pattern, endpoint with the pattern's groups), in the order they are tried
VENDOR_LINKS = [
    ("GREENHOUSE", r"(?i)(?:https?:)?//boards\.greenhouse\.io/([A-Za-z0-9._-]+)",
     "https://boards.greenhouse.io/{1}"),
    ("GREENHOUSE", r"(?i)(?:https?:)?//job-boards\.greenhouse\.io/([A-Za-z0-9._-]+)",
     "https://boards.greenhouse.io/{1}"),
    ("GREENHOUSE", r"(?i)(?:https?:)?//(?:boards-api|api)\.greenhouse\.io/v1/boards/([A-Za-z0-9._-]+)",
     "https://boards.greenhouse.io/{1}"),
    ("GREENHOUSE", r"(?i)(?:https?:)?//boards\.greenhouse\.io/embed/job_board[^\"'\s>]*",
     "https://boards.greenhouse.io/{for}"),
    ("LEVER", r"(?i)(?:https?:)?//jobs\.lever\.co/([A-Za-z0-9._-]+)", "https://jobs.lever.co/{1}"),
    ("LEVER", r"(?i)(?:https?:)?//apply\.lever\.co/([A-Za-z0-9._-]+)", "https://jobs.lever.co/{1}"),
    ("LEVER", r"(?i)(?:https?:)?//api\.lever\.co/v0/postings/([A-Za-z0-9._-]+)",
     "https://jobs.lever.co/{1}"),
    ("WORKDAY", r"(?i)(?:https?:)?//([A-Za-z0-9-]+\.[A-Za-z0-9.-]*myworkdayjobs\.com)(/[^\"'\s<>]*)?",
     "https://{1}{site}"),
    ("SMARTRECRUITERS", r"(?i)(?:https?:)?//jobs\.smartrecruiters\.com/([A-Za-z0-9._-]+)",
     "https://careers.smartrecruiters.com/{1}"),
    ("SMARTRECRUITERS", r"(?i)(?:https?:)?//careers\.smartrecruiters\.com/([A-Za-z0-9._-]+)",
     "https://careers.smartrecruiters.com/{1}"),
    ("SMARTRECRUITERS", r"(?i)(?:https?:)?//www\.smartrecruiters\.com/([A-Za-z0-9._-]+)",
     "https://careers.smartrecruiters.com/{1}"),
    ("SMARTRECRUITERS", r"(?i)(?:https?:)?//api\.smartrecruiters\.com/v1/companies/([A-Za-z0-9._-]+)",
     "https://careers.smartrecruiters.com/{1}"),
    ("ICIMS", r"(?i)(?:https?:)?//([A-Za-z0-9.-]*icims\.com)/jobs(?:/search[^\"'\s<>]*)?",
     "https://{1}/jobs/search"),
    ("ICIMS", r"(?i)(?:https?:)?//careers\.icims\.com/jobs/([A-Za-z0-9._-]+)(?:/[^\"'\s<>]*)?",
     "https://careers.icims.com/jobs/{1}/jobs"),
    ("TALEO", r"(?i)(?:https?:)?//([A-Za-z0-9.-]*taleo\.net)/careersection/([A-Za-z0-9._-]+)/jobsearch\.ftl[^\"'\s<>]*",
     "https://{1}/careersection/{2}/jobsearch.ftl"),
    ("SUCCESSFACTORS", r"(?i)(?:https?:)?//([A-Za-z0-9.-]*(?:successfactors\.[A-Za-z.]+|jobs\.sap\.com))/career[^\"'\s<>]*",
     "https://{1}/career"),
]
VENDOR_SHORT_LINK = r"(?i)(?:https?:)?//grnh\.se/([A-Za-z0-9._-]+)"
VENDOR_LINK_HINT = r"(?i)greenhouse\.io|lever\.co|myworkdayjobs\.com|smartrecruiters\.com|icims\.com|taleo\.net|successfactors\.|jobs\.sap\.com"
LOCALE_SEGMENT = r"^[a-z]{2}-[A-Z]{2}$"

# --- fixed values: vendor payload fields, in the order they are tried ------
WORKDAY_URL_FIELDS = [
    "externalPath", "externalUrl", "jobPostingUrl", "jobUrl", "url", "applyUrl", "externalApplyUrl",
]
WORKDAY_TOTAL_FIELDS = [
    "total", "totalResults", "totalCount", "resultsCount", "totalRecords", "jobCount",
]
WORKDAY_PAGING_TOTAL_FIELDS = ["total", "totalCount", "resultsCount"]

# --- fixed values: English words as the Snowball project publishes them ----
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now").split()
STEM_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
STEM_LEFT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEM_PREFIXES = ["gener", "commun", "arsen"]
# endings by step: what an ending in the first region becomes
STEM_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able",
    "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEM_STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic",
    "ness": "", "ful": "",
}
# endings that go from the second region
STEM_STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive",
               "ize", "ion", "al", "er", "ic"]
