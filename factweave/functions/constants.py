"""Closed vocabularies and rule tables that results depend on."""

# ---- fixed values: statuses and states -------------------------------------------------
EVIDENCE_STATUSES = ("available", "not_found", "not_applicable", "not_fetched", "source_error", "blocked")
TERMINAL_STATES = (
    "complete", "not_applicable", "not_found", "blocked_policy", "blocked_robots",
    "source_error", "budget_exhausted", "submission_error",
)
AVAILABILITY = {
    "available": "available",
    "not_found": "not_available",
    "not_applicable": "not_applicable",
    "blocked": "blocked",
    "blocked_robots": "blocked",
    "blocked_policy": "blocked",
    "source_error": "failed",
    "failed": "failed",
    "not_fetched": "failed",
}
MODULES = (
    "registry", "accounting_obligation", "registry_live", "financials", "financial_history",
    "roles", "group", "locations", "website",
)

# ---- fixed values: accounting-obligation forms -----------------------------------------
FORMS_ALWAYS_OBLIGED = ("AS", "ASA", "BRL", "BBL", "STI", "SF", "VPFO")
FORMS_CONDITIONAL = ("ENK", "ANS", "DA", "SA", "FLI", "ESEK", "NUF", "UTLA", "ORGL", "SAM", "SPA", "KS", "BO")

# ---- fixed values: observation vocabulary ----------------------------------------------
PLATFORMS = (
    "company_site", "google_places", "linkedin", "facebook", "instagram", "x", "youtube", "tiktok",
    "glassdoor", "indeed", "job_board", "news", "openstreetmap", "brreg", "apple_app_store",
    "google_play", "wikidata", "wikipedia", "company_directory",
)
SIGNAL_TYPES = (
    "company_profile", "profile_handle", "profile_metrics", "place_summary", "review", "review_summary",
    "job_posting", "workforce_snapshot", "public_post", "public_mention", "buzz_metrics",
)
PUBLISHABLE_MODES = ("official_api", "licensed_api", "company_authorized_export", "permitted_public_page")
EXPERIMENTAL_MODES = ("jobspy_experiment", "unofficial_api_experiment", "rights_review_experiment")
SPAN_SIGNALS = ("review", "public_post", "public_mention")
SENTIMENT_LABELS = ("positive", "neutral", "negative", "mixed")
OBSERVATION_SENTIMENT_CLASSES = ("customer_review", "employee_review", "licensed_news", "public_news", "public_mention")
ROLLUP_SENTIMENT_CLASSES = ("licensed_news", "public_news", "official_notice", "licensed_review")
STRATEGIES = (
    "company_site_feed", "company_site_identity", "company_site_activity", "company_directory_identity",
    "verified_handle_extraction", "registry_workforce_snapshot", "about_contact_deep_pages",
    "youtube_channel_feed", "places_identity_resolution", "places_rating_reviews", "jobs_feed_discovery",
    "linkedin_workforce_snapshot", "annual_report_workforce_snapshot", "social_profile_metrics",
    "independent_news_discovery", "exact_entity_article_capture", "independent_sentiment",
    "buzz_peer_normalization",
)
# reasons in the order the validator reports them
OBSERVATION_REASONS = (
    "missing observation id",
    "missing or invalid organisation number",
    "unsupported platform",
    "unsupported signal type",
    "missing or invalid source URL",
    "missing retrieval time",
    "missing content hash",
    "exact legal entity is not verified",
    "missing exact-entity proof",
    "acquisition mode is not approved for publication",
    "source rights are not approved",
    "missing evidence span",
    "unsupported sentiment label",
    "sentiment source is not independent",
    "missing sentiment model version",
)

# ---- fixed values: score weights -------------------------------------------------------
SCORE_MAXIMA = {
    "exact_external_identity": 20.0,
    "verified_handles": 15.0,
    "profile_metrics": 10.0,
    "places_identity": 5.0,
    "places_reviews": 10.0,
    "workforce_jobs": 10.0,
    "public_buzz": 10.0,
    "independent_sentiment": 15.0,
    "freshness_evidence": 5.0,
}
FOUNDATION_WEIGHTS = {
    "official_identity": 5.0,
    "annual_accounts": 10.0,
    "roles": 5.0,
    "locations": 5.0,
    "website_terminal_state": 5.0,
}
ENRICHMENT_WEIGHTS = {
    "exact_external_identity": 8.0,
    "verified_handles": 8.0,
    "profile_metrics": 8.0,
    "places_identity": 4.0,
    "places_reviews": 8.0,
    "workforce_jobs": 8.0,
    "public_buzz": 8.0,
    "independent_sentiment": 12.0,
    "freshness_evidence": 6.0,
}

# ---- fixed values: name tokens that carry no identity ----------------------------------
STOP_IDENTITY = (
    "as", "asa", "ans", "da", "enk", "iks", "sa", "sam", "sti", "stiftelsen", "nuf", "ab", "b", "v",
    "limited", "ltd", "inc", "plc", "the", "og", "and",
)
STOP_SEARCH_NAME = (
    "as", "asa", "ans", "da", "enk", "sa", "nuf", "company", "norge", "norway", "gruppen", "group",
)
STOP_PLACES = (
    "as", "asa", "ans", "sa", "da", "enk", "iks", "nuf", "sti", "stiftelsen", "the", "og", "and",
    "norge", "norway",
)
STOP_MAP_DATA = STOP_PLACES + ("holding", "group", "gruppen")
STOP_LISTING = (
    "as", "asa", "sa", "enk", "nuf", "da", "ans", "ba", "stiftelsen", "sameiet", "avd", "avdeling",
)
STOP_CHANNEL = ("as", "asa", "sa", "ba", "da", "ans", "enk", "nuf", "sti")
STOP_DOMAIN = ("as", "asa", "ans", "da", "nuf", "sa", "ba", "og")
LEGAL_SUFFIXES = ("as", "asa", "ba", "da", "enk", "nuf", "sa", "stiftelsen")
GENERIC_LISTING_TOKENS = ("holding", "eiendom", "invest", "bolig", "service", "drift", "gruppen", "group")
# (organisation number, listing name) pairs whose trading name was checked by hand
VERIFIED_TRADE_NAMES = (
    ("932083108", "privatmegleren premium", "https://www.proff.no/selskap/privatmegleren-premium/oslo/eiendomsmegling/IFEXRXG00B1"),
    ("963430663", "mobit kanalveien", "https://www.mobit.no/forhandlere/bergen/kanalveien"),
    ("967292907", "lunsj service og orebekk fisk vilt", "https://www.starina.no/"),
)
MENTION_PREDECESSORS = ("av", "for", "fra", "hos", "i", "med", "om", "på", "til", "og", "kjøper", "velger")
ALIAS_BANNED = ("home", "homepage", "forside", "welcome", "velkommen", "official site")
LEADER_ROLES = ("DAGL", "LEDE", "INNH")

# ---- fixed values: hosts and paths -----------------------------------------------------
SOCIAL_HOSTS = {
    "linkedin.com": "linkedin",
    "facebook.com": "facebook",
    "instagram.com": "instagram",
    "x.com": "x",
    "twitter.com": "x",
    "youtube.com": "youtube",
    "youtu.be": "youtube",
    "tiktok.com": "tiktok",
}
SOCIAL_REJECTED_SEGMENTS = {
    "facebook": ("sharer", "sharer.php", "share.php", "dialog", "policy.php", "privacy", "events", "groups", "plugins", "profile.php"),
    "instagram": ("p", "reel", "reels", "stories", "explore"),
    "x": ("intent", "share", "home", "search", "i"),
}
BLOCKED_SITE_HOSTS = (
    "proff.no", "purehelp.no", "1881.no", "gulesider.no", "firmalisten.no", "companywall.no",
    "firmadatabasen.no", "sokfirma.no", "yra.no", "northdata.com", "nor47business.com",
    "linkedin.com", "facebook.com", "instagram.com", "x.com", "twitter.com", "youtube.com", "tiktok.com",
)
SKIPPED_HOST_PARTS = (
    "linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com",
    "wikipedia.org", "wikidata.org", "proff.no", "gulesider.no", "1881.no", "firmenabc", "glassdoor",
    "indeed", "bloomberg", "crunchbase", "dnb.com", "skatteetaten.no", "brreg.no", "arbeidsplassen.no",
    "google.com", "g2.com", "trustpilot", "yelp", "tripadvisor", "openstreetmap", "allabolag",
    "companieshouse", "rakuten", "amazon.",
)
FREE_MAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "hotmail.com", "hotmail.no", "outlook.com", "live.com", "live.no",
    "yahoo.com", "yahoo.no", "icloud.com", "me.com", "online.no", "broadpark.no", "start.no",
    "getmail.no", "c2i.net",
)
PRIORITY_TERMS = (
    "om-oss", "om_oss", "about", "kontakt", "contact", "ledelse", "management", "team", "people",
    "locations", "lokasjoner", "avdelinger", "butikker", "news", "press", "aktuelt", "nyheter",
    "careers", "career", "jobb", "jobber", "ledige-stillinger", "stilling", "vacancies", "karriere",
    "investor", "investors",
)
PROBE_PATHS = (
    "careers", "karriere", "jobb", "ledige-stillinger", "aktuelt", "nyheter", "siste-nytt", "blogg",
    "pressemeldinger", "presserom", "news", "press",
)
CAREERS_TERMS = (
    "careers", "career", "jobb", "jobber", "ledige-stillinger", "stilling", "stillinger", "vacancies",
    "karriere", "arbeid-hos-oss",
)
ARTICLE_PATH_TERMS = (
    "/nyhet", "/aktuelt", "/news", "/press", "/blog", "/artikkel", "/story", "/siste-nytt", "/blogg",
    "/pressemelding", "/presserom",
)
NEWS_PATH = r"(?i)/(?:news|press|aktuelt|nyheter|artikler|blog)(?:/|$)"
PARKED_MARKERS = (
    "domain is for sale", "domain for sale", "hugedomains", "parked at", "miss hosting",
    "her flytter snart en ny gjest", "has been informing visitors",
    "find the best information and most relevant links on all topics related to",
)
# public suffixes of more than one label; every other suffix is one label
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.nz", "com.au", "net.au", "org.au", "co.jp", "com.br",
    "com.cn", "com.tr", "com.mx", "co.in", "co.za", "co.kr", "com.sg", "com.pl", "kommune.no",
    "priv.no", "fhs.no", "museum.no", "oslo.no", "gs.oslo.no",
)
ORGANISATION_TYPES = ("Organization", "Corporation", "LocalBusiness", "Store", "Restaurant")
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "Report", "PressRelease")

# ---- fixed values: knowledge-base social properties ------------------------------------
KB_SOCIAL = {
    "P2013": ("facebook", "https://facebook.com/"),
    "P2003": ("instagram", "https://instagram.com/"),
    "P2002": ("x", "https://x.com/"),
    "P2397": ("youtube", "https://youtube.com/channel/"),
    "P4264": ("linkedin", "https://linkedin.com/company/"),
}

# ---- fixed values: checksum weights ----------------------------------------------------
ORGNR_WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)

# ---- fixed values: extra registry columns and the claim each one becomes ---------------
REGISTRY_EXTRA_CLAIMS = (
    ("organisasjonsform.kode", "legal_form_code"),
    ("naeringskode1.kode", "industry_code"),
    ("naeringskode2.kode", "industry_code_2"),
    ("naeringskode2.beskrivelse", "industry_2"),
    ("naeringskode3.kode", "industry_code_3"),
    ("naeringskode3.beskrivelse", "industry_3"),
    ("hjelpeenhetskode.kode", "auxiliary_unit_code"),
    ("hjelpeenhetskode.beskrivelse", "auxiliary_unit"),
    ("institusjonellSektorkode.kode", "institutional_sector_code"),
    ("forretningsadresse.kommune", "municipality"),
    ("forretningsadresse.kommunenummer", "municipality_number"),
    ("forretningsadresse.postnummer", "postal_code"),
    ("forretningsadresse.landkode", "country_code"),
    ("harRegistrertAntallAnsatte", "employees_registered_flag"),
    ("registreringsdatoAntallAnsatteEnhetsregisteret", "employees_registered_date"),
    ("registreringsdatoantallansatteNAVAaregisteret", "employees_nav_date"),
    ("registreringsdatoMerverdiavgiftsregisteret", "vat_registered_date"),
    ("registreringsdatoFrivilligMerverdiavgiftsregisteret", "voluntary_vat_date"),
    ("registrertIForetaksregisteret", "foretaksregisteret_registered"),
    ("registreringsdatoForetaksregisteret", "foretaksregisteret_date"),
    ("registrertIFrivillighetsregisteret", "voluntary_register_registered"),
    ("registrertIStiftelsesregisteret", "foundation_register_registered"),
    ("registrertIPartiregisteret", "party_register_registered"),
    ("maalform", "language_form"),
    ("vedtektsdato", "articles_date"),
    ("aktivitet", "activity_description"),
    ("kapital.antallAksjer", "share_count"),
    ("kapital.type", "share_capital_type"),
    ("kapital.innfortDato", "share_capital_date"),
    ("konkursdato", "bankruptcy_date"),
    ("underAvviklingDato", "liquidation_date"),
    ("fravalgRevisjonDato", "audit_opt_out_date"),
    ("registreringsdatoEnhetsregisteret", "registered_at"),
)

# ---- fixed values: tracked refresh fields ----------------------------------------------
TRACKED_FIELDS = (
    "registry.name", "registry.legal_form", "registry.employees", "registry.municipality",
    "registry.website", "registry.latest_submitted_accounts", "financials.records",
    "financial_history.years", "roles.roles", "locations.locations", "website.title",
    "website.description", "website.social_links", "website.job_postings", "website.news_articles",
    "website.structured_facts",
)

# ---- fixed values: workforce phrases ---------------------------------------------------
WORKFORCE_PATTERNS = (
    (0, "full_time_equivalents", r"(?i)(?:antall|tal\s+p[aå])\s+(?:aarsverk|arsverk|årsverk)\s+i\s+(?:regnskapsaret|rekneskapsaret)\s*(?:er|:|=)?\s*((?-i:\b[0-9O][0-9O .,-]{0,8}))"),
    (0, "full_time_equivalents", r"(?i)antall\s+(?:aarsverk|arsverk|årsverk)(?:\s+sysselsatt\s+i\s+regnskapsaret)?\s*(?:er|:|=)?\s*((?-i:\b[0-9O][0-9O .,-]{0,8}))"),
    (0, "full_time_equivalents", r"(?i)selskapet\s+har(?:\s+[i1]\s+\d{4})?\s+sysselsatt\s+((?-i:\b[0-9O][0-9O .,-]{0,8}))\s+(?:aarsverk|arsverk|årsverk)"),
    (0, "full_time_equivalents", r"(?i)selskapet\s+har\s+((?-i:\b[0-9O][0-9O .,-]{0,8}))\s+(?:aarsverk|arsverk|årsverk)"),
    (0, "full_time_equivalents", r"(?i)antall\s+(?:aarsverk|arsverk|årsverk)\s+(?:sysselsatt|syssetsatt)\s+i\s+regnskapsaret\s*(?:er|:|=)?\s*((?-i:\b[0-9O][0-9O .,-]{0,8}))"),
    (1, "employees", r"(?i)gjennomsnittlig(?:e)?\s+antall\s+ansatte(?:\s+i\s+regnskapsaret)?\s*(?:er|:|=)?\s*((?-i:\b[0-9O][0-9O .,-]{0,8}))"),
    (1, "employees", r"(?i)antall\s+ansatte\s*(?:er|:|=)?\s*((?-i:\b[0-9O][0-9O .,-]{0,8}))"),
    (2, "employees", r"(?i)((?-i:\b[0-9O][0-9O .,-]{0,8}))\s+(?:heltids)?ansatte\b"),
)
WORKFORCE_WORDS = {"ingen": 0, "en": 1, "ett": 1, "to": 2, "tre": 3, "fire": 4, "fem": 5}
WORKFORCE_WORD_PATTERN = r"(?i)\b(?:det\s+er|selskapet\s+har)\s+(ingen|en|ett|to|tre|fire|fem)\s+ansatte\b"
WORKFORCE_ZERO_PATTERN = r"(?i)\b(?:selskapet|stiftelsen|legatet|sameiet|det)\s+(?:har\s+ingen\s+(?:ansatte|(?:aarsverk|arsverk|årsverk))|har\s+ikke\s+hatt\s+(?:noen\s+)?ansatte|hadde\s+ingen\s+ansatte|ikke\s+har\s+ansatte)\b"
#: What a word or number of the patterns above may begin with: a phrase goes on after a line break only there.
WORKFORCE_NEXT = r"[0-9O:=\d]|antall|tal|p[aå]|aarsverk|arsverk|årsverk|i|regnskapsaret|rekneskapsaret|er|sysselsatt|syssetsatt|selskapet|har|hadde|hatt|gjennomsnittlig|(?:heltids)?ansatte|det|en|ett|to|tre|fire|fem|stiftelsen|legatet|sameiet|noen"
WORKFORCE_TERMS = r"(?iu)ansatt|aarsverk|arsverk|årsverk|sysselsatt"
#: What each of these terms holds, cheap to look for.
WORKFORCE_STEMS = r"[rRsSſ](?iu:sverk|att)"

# ---- fixed values: order-book fees and volatility --------------------------------------
PROTOCOL_FEE = 0.07
OVERLAY_FEE = 0.01
SECONDS_PER_YEAR = 365 * 24 * 3600
VOL_WINDOW_SECONDS = 600
VOL_MIN_SAMPLES = 8
VOL_FLOOR = 0.25
VOL_CAP = 3.0
