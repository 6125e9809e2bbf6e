"""Fixed values.

Word lists, lookup tables, patterns and limits that results depend on. They are
kept together here as plain text; logic that uses them lives in the other modules.
"""

# ---- fixed values: categories -------------------------------------------------
CATEGORIES = [
    "NGO & Development", "Government", "Private Sector",
    "Remote & International", "Internships", "Gigs",
]
INFERRED_CATEGORIES = CATEGORIES[:5]

# Category rules in priority order; the first category with a matching term wins.
CATEGORY_TERMS = {
    "Internships": [
        "intern", "internship", "graduate trainee", "attachment", "trainee", "student placement",
    ],
    "Remote & International": [
        "remote", "home based", "home-based", "work from home", "hybrid", "anywhere", "emea",
        "africa remote", "international", "global", "distributed", "timezone", "time zone",
        "sast", "utc", "contractor",
    ],
    "Government": [
        "ministry", "government", "parliament", "municipality", "city council", "local authority",
        "public service", "civil service", "zimbabwe republic", "zimra", "zesa", "nssa", "zrp",
        "council",
    ],
    # "who" alone counts as an organisation name here.
    "NGO & Development": [
        "ngo", "non-governmental", "non governmental", "unicef", "undp", "unops", "unfpa", "unhcr",
        "who", "world vision", "care international", "oxfam", "plan international", "red cross",
        "save the children", "usaid", "fhi 360", "icap", "egpaf", "humanitarian", "development",
        "donor", "grant", "peacebuilding", "livelihoods", "wash", "gender", "climate",
        "community based", "impactpool", "relief", "foundation",
    ],
    "Private Sector": [
        "company", "sales", "marketing", "accountant", "finance", "software", "developer",
        "engineer", "business", "retail", "bank", "customer", "operations", "administration",
        "logistics", "procurement", "meraki labs",
    ],
}

OLD_CATEGORY_NAMES = {
    "remote": "Remote & International",
    "remote jobs": "Remote & International",
    "ngo": "NGO & Development",
    "ngo & international development": "NGO & Development",
    "ngo & development": "NGO & Development",
    "development": "NGO & Development",
    "government": "Government",
    "internship": "Internships",
    "internships": "Internships",
    "technology": "Private Sector",
    "finance": "Private Sector",
    "healthcare": "NGO & Development",
    "education": "Private Sector",
    "engineering": "Private Sector",
    "sales & marketing": "Private Sector",
    "administration": "Private Sector",
    "other": "",
}

# ---- fixed values: employment, workplace, seniority ---------------------------
EMPLOYMENT_TERMS = [
    ("full time", "Full-time"), ("full-time", "Full-time"), ("permanent", "Full-time"),
    ("part time", "Part-time"), ("part-time", "Part-time"), ("contract", "Contract"),
    ("fixed term", "Contract"), ("consultancy", "Consultancy"), ("consultant", "Consultancy"),
    ("internship", "Internship"), ("intern", "Internship"), ("temporary", "Temporary"),
    ("volunteer", "Volunteer"), ("roster", "Roster"),
]
WORKPLACE_TERMS = [
    ("remote", "Remote"), ("home based", "Remote"), ("home-based", "Remote"),
    ("work from home", "Remote"), ("fully remote", "Remote"), ("hybrid", "Hybrid"),
    ("on-site", "On-site"), ("onsite", "On-site"),
]
FORM_EMPLOYMENT_TYPES = ["Full-time", "Part-time", "Contract", "Internship", "Gig"]
FORM_REMOTE_STATUSES = ["On-site", "Hybrid", "Remote"]
FORM_EXPERIENCE_LEVELS = ["Entry level", "Mid level", "Senior", "Management"]

PUBLISHED_EMPLOYMENT_CODES = {
    "full time": "FULL_TIME", "full-time": "FULL_TIME", "part time": "PART_TIME",
    "part-time": "PART_TIME", "contract": "CONTRACTOR", "contractor": "CONTRACTOR",
    "consultancy": "CONTRACTOR", "consultant": "CONTRACTOR", "internship": "INTERN",
    "intern": "INTERN", "temporary": "TEMPORARY", "temp": "TEMPORARY", "volunteer": "VOLUNTEER",
    "per diem": "PER_DIEM", "per-diem": "PER_DIEM", "gig": "OTHER", "roster": "OTHER",
}

# ---- fixed values: places ------------------------------------------------------
NAMED_PLACES = [
    "Harare", "Bulawayo", "Mutare", "Gweru", "Masvingo", "Chitungwiza",
    "Zimbabwe", "South Africa", "Africa", "EMEA",
]
HYBRID_PLACES = ["Harare", "Bulawayo", "Zimbabwe", "South Africa"]
REMOTE_HINT = "remote|home[- ]based|work from home|fully remote"
REMOTE_COUNTRY_HINT = "zimbabwe|harare|bulawayo"
REMOTE_REGION_HINT = "africa|emea|south african standard time|sast|global south"
COUNTRIES = [
    ("zimbabwe", "Zimbabwe", "ZW"), ("south africa", "South Africa", "ZA"),
    ("united states", "United States", "US"), ("usa", "United States", "US"),
    ("us", "United States", "US"), ("united kingdom", "United Kingdom", "GB"),
    ("uk", "United Kingdom", "GB"), ("canada", "Canada", "CA"), ("kenya", "Kenya", "KE"),
    ("zambia", "Zambia", "ZM"), ("botswana", "Botswana", "BW"),
]
HOME_CITIES = [
    "harare", "bulawayo", "mutare", "gweru", "masvingo", "chitungwiza", "kwekwe", "kadoma",
    "victoria falls", "hwange", "marondera", "bindura", "chinhoyi", "kariba",
]
NOT_A_LOCALITY = ["worldwide", "global", "anywhere", "africa", "emea"]

# ---- fixed values: titles ------------------------------------------------------
TITLE_TAILS = [
    r"\s*\|\s*(?:apply by|deadline|closing date|applications? close).*?$",
    r"\s*[-–—]\s*(?:apply by|deadline|closing date|applications? close).*?$",
    r"\s*\((?:apply by|deadline|closing date|applications? close)[^)]+\)\s*$",
    r"\s*\bapply\s+by\s+\d{1,2}\s+[A-Za-z]+\s+20\d{2}.*$",
    r"\s*\bdeadline\s*:?.*$",
    r"\s*\bclosing\s+date\s*:?.*$",
    r"\s*\|\s*(?:earn|salary|pay|compensation)\b.*$",
    r"\s*[-–—]\s*(?:earn|salary|pay|compensation)\b.*$",
    r"\s*\|\s*(?:remote|work from home|home based)\b.*$",
]
TITLE_WORKPLACE_TAG = r"\s*\((?:remote|hybrid|onsite|on-site|home[- ]based|work from home)\)\s*"
ROLE_WORDS = [
    "officer", "coordinator", "manager", "assistant", "associate", "analyst", "specialist",
    "developer", "engineer", "designer", "accountant", "consultant", "advisor", "adviser", "lead",
    "director", "administrator", "clerk", "driver", "nurse", "teacher", "lecturer", "intern",
    "trainee", "technician", "supervisor", "representative", "executive", "researcher", "auditor",
    "cashier", "receptionist", "operator", "monitor", "enumerator", "facilitator", "controller",
    "agent", "architect", "scientist", "drivers", "operators", "agronomist", "mechanic",
    "mechanics", "apprentice", "apprenticeship", "learnership", "consultants", "guard", "guards",
    "salesperson", "sales", "artisan", "fitter", "turner", "radiographer", "sergeant",
]
GENERIC_TITLE = (
    r"^(?:jobs?\s*\|\s*somewhere|jobs?|vacanc(?:y|ies)|multiple\s+vacanc(?:y|ies)|"
    r"\d+\s+(?:new\s+)?job\s+positions?|career\s+opportunities?|open\s+positions?|"
    r"various\s+positions?|latest\s+jobs?|remote\s+jobs?|talent\s+on[- ]demand|"
    r"hire\s+remote\s+professionals)"
)
TASK_VERB_START = (
    r"^(?:manage|monitor|examine|develop|conduct|provide|coordinate|ensure|maintain|prepare|"
    r"assist|work|report|oversee|implement|facilitate|perform|review|analy[sz]e|deliver|"
    r"carry\s+out)"
)
TITLE_REQUIREMENT_WORDS = (
    r"(?:qualification|qualifications|required|responsible for|duties include|minimum of|"
    r"experience in|such as)"
)
ROLE_LABELS = [
    "Job Title", "Position Title", "Position", "Role Title", "Role", "Vacancy", "Post", "Title",
    "Job Opportunity",
]
MERGED_TITLE_LABELS = [
    "Job Title", "Position Title", "Position", "Role Title", "Role", "Vacancy", "Post",
]
LOW_VALUE_TITLES = [
    "jobs", "job", "categories", "category", "employers", "employer", "cookies policy",
    "cookie policy", "privacy policy", "terms", "terms and conditions", "disclaimer",
]

# ---- fixed values: companies ---------------------------------------------------
BAD_COMPANY_START = (
    r"^(?:is|are|was|were|be|being|been|to|and|or|the\s+organisation|the\s+organization|the\s+job|"
    r"implementing|inviting|seeking|looking|hiring|operating|aimed|based|committed|dedicated)"
)
BAD_COMPANY_VERB = r"(?:is|are|was|were|aimed|inviting|seeking|implementing|operating|supporting)"
NOT_A_COMPANY = ["confidential", "n/a", "unknown", "we", "us", "our", "they", "them", "their"]
FREE_MAIL_DOMAINS = [
    "aol.com", "gmail.com", "googlemail.com", "hotmail.com", "icloud.com", "live.com", "mail.com",
    "me.com", "outlook.com", "proton.me", "protonmail.com", "yahoo.com", "yandex.com", "zoho.com",
]
GENERIC_DOMAIN_LABELS = [
    "admin", "apply", "career", "careers", "email", "employment", "enquiries", "hr", "info",
    "jobs", "mail", "recruitment", "vacancies", "vacancy",
]
TWO_LEVEL_SUFFIXES = ["ac.zw", "co.zw", "gov.zw", "org.zw", "co.uk", "com.au", "co.za"]
COMPANY_NAME_ENDINGS = [
    "communications", "construction", "technologies", "enterprises", "engineering", "industries",
    "investments", "properties", "solutions", "logistics", "services", "holdings", "supplies",
    "resources", "products", "trading", "transport", "consulting", "retail", "brands", "foods",
    "group", "mining", "motors", "trust",
]
DOMAIN_ACRONYMS = ["ngo", "nssa", "zimra", "zesa", "zimplats"]
KNOWN_ORGANISATIONS = [
    "ActionAid", "CARE International", "Caritas", "Christian Aid", "FHI 360", "GOAL", "Oxfam",
    "Plan International", "Save the Children", "Trócaire", "UNDP", "UNFPA", "UNHCR", "UNICEF",
    "Welthungerhilfe", "World Vision",
]
ORGANISATION_ENDINGS = (
    r"Agency|Association|Bank|Brands|Centre|Center|Church|Clinic|College|Company|Corporation|"
    r"Council|Foundation|Fund|Group|Holdings|Hospital|Institute|International|Limited|Ltd|"
    r"Mission|Network|Organisation|Organization|Pvt\s+Ltd|Society|Trust|University"
)
AGGREGATOR_ALIAS = "vacancymail"
AGGREGATOR_SOURCE = "vacancymail_zimbabwe"
AGGREGATOR_HOST = "vacancymail.co.zw"

# ---- fixed values: text lines --------------------------------------------------
NOISE_LINE = (
    r"^(?:"
    r"home|menu|jobs?|latest jobs?|all jobs?|browse jobs?|job search|search jobs?|search results|"
    r"job categories|categories|category\s*:?.*|"
    r"showing\s+\d+.*|(?:\d+\s+)?jobs?\s+found|sort by|filter by|filters?|"
    r"load more|read more|view details?|previous|next|back to jobs?|"
    r"login|register|sign in|candidate login|employer login|"
    r"privacy policy|terms(?: of use)?|cookie policy|all rights reserved|"
    r"subscribe.*|newsletter|share(?: on)?(?: facebook| twitter| linkedin| whatsapp)?|copy link|"
    r"save job|apply now|apply on official site|always apply on the official source.*"
    r")$"
)
# first words of everything that NOISE_LINE, CATEGORY_HEADING_LINE and INFERRED_CATEGORIES take, digits apart
NOISE_STARTS = [
    "home", "menu", "job", "latest", "all", "browse", "search", "categor", "showing", "sort", "filter", "load", "read",
    "view", "previous", "next", "back", "login", "register", "sign", "candidate", "privacy", "terms", "cookie", "subscribe",
    "newsletter", "share", "copy", "save", "apply", "always", "employer", "ngo", "government", "private", "remote", "internship",
]
CATEGORY_HEADING_LINE = r"^(?:NGO|Government|Private Sector|Remote|Internship)s?\s+Jobs?$"
SECTION_HEADING_LINE = (
    r"^(?:contents|key responsibilities|responsibilities|required skills|"
    r"qualifications and experience|working arrangements|compensation and benefits|"
    r"application process|important dates|selection process|about the role|about this role|"
    r"job description|duties and responsibilities|requirements|how to apply)$"
)
NEXT_SECTION = (
    r"responsibilities|duties|requirements|qualifications|skills|experience|education|"
    r"how to apply|application process|deadline|closing date|about|benefits|salary|location|"
    r"job description|key competencies|selection process"
)
REQUIREMENT_HEADINGS = [
    "Requirements", "Qualifications", "Qualifications and Experience", "Required Skills",
    "Skills and Experience", "Education and Experience", "Candidate Profile",
]
DEPARTMENT_LABELS = ["Department", "Team", "Unit", "Programme", "Program"]
COMPANY_LABELS = ["Company", "Organisation", "Organization", "Employer", "Hiring Organization"]
LOCATION_LABELS = ["Location", "Opportunity Location", "Duty Station", "Work Location"]
POSTED_LABELS = ["Posted", "Date Posted", "Publication Date"]
EMPLOYMENT_LABELS = ["Employment Type", "Job Type", "Contract", "Contract Type", "Opportunity Type"]
SALARY_LABELS = ["Salary", "Compensation", "Pay"]
SUMMARY_BOILERPLATE = [
    r"By using this site, you agree to the Privacy Policy and Terms of Use\.?.*?$",
    r"Disclaimer: ApplyNOW is not the hiring organization.*?end\.",
    r"Master the recruitment process of the impact sector!.*?Get started",
    r"Subscribe to .*? job alerts.*?$",
]
SUMMARY_BOILERPLATE_STARTS = ["by using this site", "disclaimer: applynow", "master the recruitment", "subscribe to "]
SUMMARY_FACT_LABELS = (
    r"Job Title|Location|Closing Date|Deadline|Contract Type|Employment Type|Salary|"
    r"Expected Start Date"
)
STOP_WORDS = [
    "and", "are", "but", "can", "for", "from", "has", "have", "hire", "job", "jobs", "must", "not",
    "our", "the", "this", "via", "with", "work", "will", "you", "your", "years", "required",
    "requireds", "experience", "skills", "strong", "apply", "official", "site",
]

# ---- fixed values: unsafe content ----------------------------------------------
BAD_MARKER = "RMTUyLjU1LjE3Ny44Mw=="
BAD_PHRASES = [
    "please mention the word", "show you read the job post completely",
    "beta feature to avoid spam applicants", "companies can search these words",
    "see this and similar jobs on linkedin",
]
BAD_PHRASE_REASONS = [
    "spam verification phrase", "spam verification phrase", "spam applicant filter boilerplate",
    "spam applicant filter boilerplate", "linkedin snippet boilerplate",
]
BAD_MARKER_PATTERN = r"(?s)please mention the word\b.{0,240}\btag\s+[a-z0-9+/=]{12,}"
BAD_URL_FRAGMENT = "remoteok.com/remote-jobs"
BAD_URL_PREFIXES = [
    "https://remoteok.com/remote-jobs", "http://remoteok.com/remote-jobs",
    "https://www.remoteok.com/remote-jobs", "http://www.remoteok.com/remote-jobs",
]
REMOTE_RESTRICTED = (
    r"\b(?:u\.?s\.?\s+only|usa\s+only|united\s+states\s+only|"
    r"must\s+be\s+(?:based|located|resident)\s+in\s+(?:the\s+)?(?:u\.?s\.?|usa|united\s+states)|"
    r"uk\s+only|united\s+kingdom\s+only|canada\s+only|europe\s+only|eu\s+only|australia\s+only|"
    r"new\s+zealand\s+only|"
    r"only\s+(?:candidates|applicants)\s+(?:based|located|resident)\s+in\s+(?:the\s+)?"
    r"(?:u\.?s\.?|usa|united\s+states|uk|united\s+kingdom|canada|europe|eu|australia|new\s+zealand))\b"
)
REMOTE_ALLOWED = (
    r"\b(?:worldwide|anywhere\s+in\s+the\s+world|global|international|emea|africa|zimbabwe|sast|"
    r"south\s+african\s+standard\s+time|utc\+?2)\b"
)
SPAM_WORDS = r"casino|betting|adult|crypto giveaway|get rich quick"
MARKETING_WORDS = r"talent on[- ]demand|hire remote professionals on demand|browser manage security"

# ---- fixed values: lengths -----------------------------------------------------
RECORD_MAX_LENGTHS = {
    "title": 140, "company": 120, "location": 120, "category": 40, "summary": 1100,
    "apply_url": 2048, "source_url": 2048, "department": 120, "employment_type": 40,
    "salary_range": 160, "remote_status": 40, "requirements": 1800, "job_description": 12000,
    "external_job_id": 160,
}
FORM_MAX_LENGTHS = {
    "title": 140, "company": 120, "location": 120, "category": 40, "summary": 2000,
    "apply_url": 2048, "employment_type": 40, "salary_range": 160, "remote_status": 40,
    "experience_level": 40, "expires_at": 10, "posted_at": 32, "department": 120,
    "job_description": 12000, "requirements": 4000, "tags": 300,
}
FORM_REQUIRED = ["title", "company", "location", "category", "summary", "apply_url"]
OFFER_FIELDS = [
    "name", "offer_category", "audience_type", "job_category_targets", "placement_locations",
    "affiliate_url", "display_title", "description", "cta_text", "image_url", "disclosure_text",
    "tracking_id",
]
OFFER_REQUIRED = [
    "name", "offer_category", "audience_type", "placement_locations", "affiliate_url",
    "display_title", "description", "cta_text",
]

# ---- fixed values: columns that count as a material change ---------------------
MERGE_COLUMNS = [
    "title", "company", "location", "category", "summary", "apply_url", "source_name",
    "source_url", "posted_at", "expires_at", "department", "employment_type", "salary_range",
    "remote_status", "job_description", "requirements", "external_job_id", "content_hash",
]
REQUIRED_COLUMNS = ["title", "company", "location", "category", "summary", "apply_url"]
PUBLISH_COLUMNS = [
    "title", "company", "location", "category", "summary", "apply_url", "employment_type",
    "salary_range", "remote_status", "experience_level", "expires_at", "posted_at", "department",
    "job_description", "requirements", "tags",
]

# ---- fixed values: URLs --------------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid",
]
PRIVATE_PREFIXES = [
    "/admin", "/account", "/login", "/register", "/logout", "/dashboard", "/api/", "/internal/",
    "/preview/", "/staging/", "/affiliate/", "/alerts/", "/health", "/healthz/",
]
URL_BATCH_SIZE = 10000
SENSITIVE_KEY_PARTS = [
    "authorization", "cookie", "set-cookie", "token", "secret", "password", "passwd", "api-key",
    "apikey", "x-api-key", "csrf", "session",
]
LINK_EXCLUDES = [
    "#", "mailto:", "tel:", "javascript:", r"/login\b", r"/register\b", "/privacy", "/terms",
    "/contact", "/wp-login", "/feed/?$", "/author/", "/tag/",
]
LISTING_URL = r"(/page/\d+/?|\bpage=\d+\b|\bpaged=\d+\b|\boffset=\d+\b)"
DETAIL_PATH = r"/jobs/|/job/|/careers/|/career/|/vacanc|/position|/202|/opportun"
DETAIL_ANCHOR = r"job|vacanc|hiring|apply|career|opportun|opening|position"
PAGE_ANCHOR = r"^(?:next|older|more|load more|>|>>|»|next page)$"
APPLY_ANCHOR = r"apply|view full|job call|application|official site"
SOCIAL_HOSTS = ["facebook.com", "linkedin.com", "instagram.com", "twitter.com"]
LISTING_TITLE_WORDS = r"\b(?:jobs?|vacancies|careers|opportunities|search results|category)\b"
LISTING_PHRASES = r"\b(?:showing\s+\d+|jobs found|filter by|sort by|load more)\b"
NOISE_CONTAINER_TOKEN = (
    r"(?:^|[-_\s])(?:breadcrumb|pagination|pager|sidebar|widget|menu|nav|footer|header|related|"
    r"similar|recommended|latest|more[-_\s]?jobs|job[-_\s]?list|jobs[-_\s]?list|search|filter|sort|"
    r"share|social|comment|newsletter|cookie|advert|ads?)(?:$|[-_\s])"
)
CARD_CONTAINER_TOKEN = r"(?:list|grid|container|wrapper|search|filter|header|sidebar|nav|menu)"
CARD_CLASSES = [
    "job-card", "job_card", "job-listing", "job_listing", "job-item", "job_item", "vacancy-card",
    "vacancy-item",
]
DETAIL_CLASSES = [
    "job-detail", "job-details", "job-description", "job_description", "single_job_listing",
]

# ---- fixed values: search, ranking, limits -------------------------------------
PAGE_SIZE = 20
SIMILAR_LIMIT = 4
SIMILAR_WEIGHTS = {          # points of similar listings; *_max bounds how many words count
    "category": 24, "remote_cat": 8, "employment_type": 8, "remote_status": 8, "experience_level": 6,
    "title": 8, "tag": 10, "text": 2, "text_max": 10, "place": 3, "place_max": 2,
}
FEED_SIZE = 30
ALERT_FREQUENCIES = ["instant", "daily", "weekly"]
REQUEST_LIMITS = {           # scope: (admitted requests, window seconds)
    "login": (10, 600), "register": (10, 3600), "post_job": (20, 3600), "search": (120, 60),
    "email_alert": (20, 3600),
}
LANDING_PAGES = [            # name, category, workplace, location, any of these terms
    ("harare", None, None, "Harare", []),
    ("ngo-jobs-zimbabwe", "NGO & Development", None, None, []),
    ("internships-zimbabwe", "Internships", None, None,
     ["intern", "internship", "attachment", "graduate"]),
    ("government-jobs-zimbabwe", "Government", None, None,
     ["government", "ministry", "council", "parastatal"]),
    ("industrial-attachment-zimbabwe", "Internships", None, None,
     ["attachment", "industrial attachment", "work related learning", "student placement"]),
    ("graduate-trainee-zimbabwe", None, None, None,
     ["graduate trainee", "graduate", "entry level", "junior"]),
    ("remote-jobs-zimbabweans", "Remote & International", "Remote", None,
     ["remote", "worldwide", "international", "virtual"]),
]
RESOURCE_PAGES = [
    "career-resources", "resume-tools", "interview-prep", "online-courses", "remote-work-tools",
    "employer-resources", "before-you-apply",
]
# Keyword bonus for offers, first matching line wins: offer categories, words, points.
OFFER_KEYWORD_BONUS = [
    (["certifications", "bootcamps"],
     ["software", "developer", "engineer", "data", "cloud", "python", "javascript", "it ", "ict",
      "cyber", "systems"], 30),
    (["certifications"],
     ["nurse", "clinical", "medical", "health", "pharmacy", "doctor", "midwife", "patient"], 28),
    (["remote_work"], ["remote", "virtual", "worldwide", "freelance"], 26),
    (["portfolio"], ["designer", "developer", "writer", "creative", "remote"], 18),
    (["salary"], ["senior", "manager", "lead", "director", "management"], 20),
    (["resume", "cv_review", "interview"], ["intern", "graduate", "junior", "entry"], 16),
]
DETAIL_PLACEMENT_BONUS = (["resume", "cv_review", "interview"], 12)

# ---- fixed values: named character references the cleaner knows ----------------
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·",
    "hellip": "…", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "laquo": "«",
    "raquo": "»", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü",
    "ouml": "ö", "auml": "ä", "ntilde": "ñ",
}
