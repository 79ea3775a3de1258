"""Fixed values of the data model: word lists, weights, routing and limits."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------------------

CATEGORIES = ("contact", "organisation", "product", "action", "location", "event", "review", "regulation")

PAGE_TYPES = (
    "homepage", "about_page", "contact_page", "staff_directory", "legal_page",
    "product_landing", "product_listing", "product_catalog", "pricing_page",
    "business_service_landing", "business_service_hub",
    "blog_article", "news_article", "encyclopedia_article", "case_study", "faq_page",
    "resource_hub", "review_page", "discussion_thread",
    "booking_page", "calculator_page", "checkout_page", "login_page", "search_results", "category_page",
    "government_regulation", "government_directory", "event_page", "social_profile", "course_listing",
    "unknown",
)

ALL_EXTRACTORS = ("contacts", "products", "actions", "general")

EXTRACTOR_ROUTES = {
    "contact_page": ("contacts", "general"),
    "staff_directory": ("contacts", "general"),
    "about_page": ("contacts", "general"),
    "product_landing": ("products", "actions", "general"),
    "product_listing": ("products", "general"),
    "product_catalog": ("products", "general"),
    "pricing_page": ("products", "actions"),
    "business_service_landing": ("contacts", "actions", "general"),
    "business_service_hub": ("contacts", "products", "general"),
    "booking_page": ("actions", "general"),
    "calculator_page": ("actions",),
    "checkout_page": ("actions",),
    "homepage": ("contacts", "products", "actions", "general"),
    "blog_article": ("general",),
    "news_article": ("general",),
    "case_study": ("contacts", "general"),
    "faq_page": ("general",),
    "review_page": ("general",),
    "resource_hub": ("general",),
    "government_regulation": ("general",),
    "government_directory": ("contacts", "general"),
    "event_page": ("general",),
    "course_listing": ("actions", "general"),
}
CLOUD_BELOW_CONFIDENCE = 0.7

SCORE_WEIGHTS = {
    "action_richness": 0.30,
    "semantic_clarity": 0.25,
    "agent_reliability": 0.20,
    "freshness_coverage": 0.15,
    "trust_legitimacy": 0.10,
}
ACTION_SIGNALS = {
    "form_completeness": 0.30,
    "api_discoverability": 0.25,
    "action_diversity": 0.20,
    "flow_completeness": 0.15,
    "reliability_history": 0.10,
}
KNOWLEDGE_SIGNALS = {
    "information_density": 0.25,
    "structure_quality": 0.25,
    "entity_richness": 0.20,
    "authority_citations": 0.15,
    "extraction_ease": 0.15,
}
INTENT_BLENDS = {  # intent: (knowledge weight, action weight)
    "knowledge": (0.90, 0.10),
    "action": (0.05, 0.95),
    "research": (0.65, 0.35),
    "compound": (0.40, 0.60),
    "navigation": (0.50, 0.50),
}
RECRAWL_MS = {"hourly": 3_600_000, "daily": 86_400_000, "weekly": 604_800_000, "monthly": 2_592_000_000}

SENIORITY_RULES = (  # first hit wins, most senior first
    ("executive", r"\b(ceo|coo|cfo|cto|managing director|owner|founder)\b"),
    ("director", r"\b(director|vp)\b"),
    ("manager", r"\b(manager|head of)\b"),
    ("senior", r"\b(senior|lead|principal)\b"),
    ("mid", r"\b(specialist|consultant|advisor|engineer)\b"),
    ("junior", r"\b(graduate|assistant|coordinator|associate)\b"),
)

RELATIONSHIP_KINDS = (
    ("works_at", "contact", "organisation"),
    ("located_at", "organisation", "location"),
    ("offers", "organisation", "product"),
    ("has_action", "organisation", "action"),
    ("reviewed_by", "organisation", "review"),
    ("regulated_by", "product", "regulation"),
    ("hosts_event", "organisation", "event"),
)

PRIMARY_ACTION_ORDER = ("form_submit", "booking", "phone_link", "chat_widget", "calculator", "callback")

JS_MARKERS = (
    "react", "angular", "vue", "__next_data__", "__nuxt__", "ng-app", "data-reactroot",
    "window.__initial_state__", "ember", "backbone", "knockout",
)

CHALLENGES = (  # pattern, ignore case, type, resolves by itself, needs a service
    (r"just a moment", True, "cloudflare_challenge", True, False),
    (r"cf-browser-verification", False, "cloudflare_challenge", True, False),
    (r"cf_chl_opt", False, "cloudflare_challenge", True, False),
    (r"cloudflare ray id", True, "cloudflare_challenge", True, False),
    (r"turnstile\.cloudflare\.com", False, "cloudflare_turnstile", False, True),
    (r"google\.com\/recaptcha", False, "recaptcha_v2", False, True),
    (r"recaptcha\/api2", False, "recaptcha_v2", False, True),
    (r"grecaptcha\.execute", False, "recaptcha_v3", False, False),
    (r"hcaptcha\.com", False, "hcaptcha", False, True),
    (r"data-hcaptcha-sitekey", False, "hcaptcha", False, True),
    (r"arkoselabs\.com", False, "arkose_labs", False, True),
    (r"funcaptcha", True, "arkose_labs", False, True),
    (r"incapsula\.com", False, "imperva_incapsula", False, False),
    (r"_Incapsula_Resource", False, "imperva_incapsula", False, False),
    (r"datadome\.co", False, "datadome", False, False),
    (r"dd_cookie_test", False, "datadome", False, False),
    (r"perimeterx\.net", False, "perimeterx", False, False),
    (r"_pxAppId", False, "perimeterx", False, False),
    (r"ak_bmsc", False, "akamai_bot_manager", False, False),
    (r"bm_sz", False, "akamai_bot_manager", False, False),
)
GENERIC_CHALLENGE = r"(?i)captcha|bot.?check|human.?verification"

EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
VALID_EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"

SEED_PRIORITY = {"personal": 1, "on-demand": 2, "seed": 3, "discovered": 6}
PERSONAL_URL_CAP = {"basic": 100, "pro": 500}

SUBMISSION_STATUSES = ("pending_approval", "approved", "rejected", "executed", "failed", "skipped")
TRUST_THRESHOLD = 2
APPROVAL_TTL_MINUTES = 30

ALERT_RULES = (  # metric, operator, threshold
    ("classification_accuracy", "<", 88.0),
    ("extraction_f1", "<", 80.0),
    ("contact_recall", "<", 80.0),
    ("form_success_rate", "<", 90.0),
    ("crawl_error_rate", ">", 5.0),
    ("escalation_rate", ">", 10.0),
    ("cache_hit_rate", "<", 70.0),
    ("query_latency_p95_ms", ">", 500.0),
    ("queue_depth", ">", 5000.0),
)

LEGAL_SUFFIXES = ("pty ltd", "pty limited", "proprietary limited", "ltd", "limited", "inc", "llc", "corp",
                  "corporation", "company", "co", "australia")

#: fixed values: words of addresses and their usual short forms
ADDRESS_WORDS = {
    "avenue": "ave", "boulevard": "blvd", "building": "bldg", "court": "ct", "drive": "dr", "floor": "fl", "highway": "hwy",
    "lane": "ln", "level": "lvl", "parade": "pde", "place": "pl", "road": "rd", "square": "sq", "street": "st", "suite": "ste",
    "terrace": "tce",
}
