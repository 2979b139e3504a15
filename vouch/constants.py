"""Word lists and tables that results depend on, in one place."""

HONORIFICS = ["dr", "prof", "professor", "mr", "ms"]
#: Transliterations of a surname; a parameter wherever names are compared.
SURNAME_VARIANTS = {"chaubey": "choubey", "choubey": "chaubey"}

GENERIC_MAILBOXES = [
    "info", "contact", "support", "customerservice", "customer.service", "billing", "office", "admin", "sales", "service",
    "media", "press", "webmaster", "outage", "emergency", "noreply", "no-reply",
]
NON_PERSON_WORDS = [
    "division", "department", "services", "service", "city", "county", "office", "staff", "contact", "email", "utility",
    "utilities", "public", "support", "water", "billing", "information", "director", "team", "administration", "finance",
    "communications", "community", "planning", "works", "customer", "board", "council", "member", "membership",
    "association", "about", "development", "accounting", "financial", "she", "he", "his", "her", "their", "our",
]
ROLE_WORDS = ["superintendent", "administrator", "manager", "president", "ceo", "cfo", "cio"]
TITLE_WORDS = [
    "general", "chief", "senior", "executive", "assistant", "deputy", "vice", "acting", "interim", "finance", "billing",
    "operations", "director", "manager", "officer", "clerk", "treasurer", "engineer", "secretary",
]

#: Encyclopedias, networks and brokers: never a source of contacts, never an organization's own site.
BROKER_HOSTS = [
    "wikipedia.org", "linkedin.com", "facebook.com", "x.com", "twitter.com", "instagram.com", "yelp.com", "zoominfo.com",
    "dnb.com", "bloomberg.com", "rocketreach.co", "apollo.io", "signalhire.com", "contactout.com", "lusha.com", "hunter.io",
    "spokeo.com", "whitepages.com",
]
NOT_OWN_SITES = [*BROKER_HOSTS, "wikidata.org"]

PATH_HINTS = [
    "team", "people", "leadership", "about", "staff", "bio", "profile", "board", "contact", "directory", "management",
    "utility", "department",
]
PROFILE_HINTS = ["faculty", "profile", "staff", "resume", "_cv", "-cv"]
DOCUMENT_HINTS = [
    "staff", "directory", "contact", "personnel", "organization", "org-chart", "orgchart", "annual", "report", "board",
    "commission", "council", "roster", "leadership", "management", "budget",
]
CONTACT_HINTS = ["staff", "contact", "directory", "personnel", "leadership", "team", "email"]
RESERVED_PROFILES = ["topics", "orgs", "search", "features", "settings", "login"]
RESERVED_HANDLES = ["login", "share", "sharer", "posts", "watch"]

#: What lists abbreviate, with all its full forms.
ABBREVIATIONS = {
    "elec": ["electric", "electrical", "electricity"], "coop": ["cooperative", "co-op"], "co-op": ["cooperative"],
    "assn": ["association"], "assoc": ["association"], "dist": ["district"], "util": ["utility", "utilities"],
    "utils": ["utilities"], "auth": ["authority"], "corp": ["corporation"], "dept": ["department"], "muni": ["municipal"],
    "mun": ["municipal"], "pwr": ["power"], "wtr": ["water"], "svc": ["service", "services"], "svcs": ["services"],
    "natl": ["national"], "intl": ["international"], "twp": ["township"], "cnty": ["county"], "mtn": ["mountain"],
    "ft": ["fort"], "st": ["saint"], "sys": ["system", "systems"], "comm": ["commission"], "bd": ["board"],
    "pud": ["public utility district"],
}
SAME_KIND = {
    "university": ["vishwavidyalaya", "viswavidyalaya", "vishwavidyalay", "vidyapeeth", "vidyapith"],
    "college": ["mahavidyalaya", "mahavidyalay"],
    "institute": ["sansthan", "sansthaan"],
}
NAME_STOP_WORDS = [
    "city", "of", "the", "inc", "llc", "ltd", "company", "co", "annual", "conference", "and", "exhibition", "exposition",
    "sys", "dept",
]
BRAND_STOP_WORDS = [
    "city", "county", "company", "association", "council", "government", "governments", "utility", "utilities",
    "department", "district", "annual", "conference",
]
OTHER_INSTITUTIONS = [
    "schools", "school district", "school", "church", "library", "hospital", "college", "university",
    "chamber of commerce", "bank", "credit union", "museum", "realty", "law firm", "newspaper",
]
FOREIGN_ENDINGS = ["ng", "uk", "au", "in", "ca", "za", "nz"]
HEADINGS = [
    "leadership", "meet", "our", "contact", "contacts", "about", "staff", "board", "team", "management", "executive",
    "the", "directors", "officers", "departments", "department", "general", "welcome", "message", "from", "by", "and",
    "with", "skip", "content", "menu", "navigation", "home", "login", "search", "main", "news", "read", "more", "view",
    "click", "page", "blog", "entry", "job", "open", "jobs", "events", "calendar", "privacy", "terms",
]
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine",
    "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri",
    "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}

EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PERSON_NAME = r"(?:[A-Z][a-zA-Z'’-]+\.?\s+){1,3}[A-Z][a-zA-Z'’-]+\.?"

#: How relevant a contact is, the first line that fits deciding: the score, what the title must hold, what the
#: text around must hold, and what it mustn't ("" asks for nothing). Generic mailboxes score 0, what fits no line OTHER_RANK.
CONTACT_RANKS = [
    (10, "", r"(?i)\b(?:animal services|animal shelter|recreation|police|fire department|library|building permits)\b", ""),
    (25, "^(?:manager|director)$", "", r"(?i)\b(?:utility|utilities|water|gas|electric|billing|finance|information|technology)\b"),
    (10, "media|communications|public relations|human resources|recruit|customer service", "", ""),
    (90, "billing|information|technology|finance|general manager|utility director|utilities director|executive director|president"
         "|chief|ceo|cfo|cio|administrator|superintendent", "", ""),
    (55, "(?s).", "", ""),
]
OTHER_RANK = 25
#: Letters that a name's word must have to count in a mailbox, and short forms of names there, each as (which
#: word, how many letters of it, all for None).
NAME_WORD = 3
LOCAL_FORMS = [((0, 1), (-1, None)), ((-1, None), (0, 1)), ((0, None), (-1, 1))]
