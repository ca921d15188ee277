"""Fixed values that results depend on.

FIXED VALUES — these lists, patterns, weights and thresholds must stay exactly
as written for results to match the reference pipeline's behaviour. They are
given in their natural order; nothing else in the package hard-codes them.
"""

from __future__ import annotations

# --- FIXED VALUES: platforms and tiers -------------------------------------
PLATFORMS = ["Greenhouse", "Ashby", "BambooHR", "Lever", "Workday", "iCIMS", "Paylocity"]
# FIXED VALUE: the run summary's name for each platform's source.
PLATFORM_SOURCES = "greenhouse_api, ashby_api, bamboohr_api, lever_api, workday_api, icims_sitemap, paylocity_scrape"
TIERS = ["intern", "entry", "mid", "senior"]

# --- FIXED VALUES: title tier rules (pattern on lower(title), weight) -------
# Each rule counts at most once. Thresholds: sum <= -50 intern, <= -5 entry,
# >= 15 senior, otherwise mid.
TIER_RULES = [
    (r"\b(?:chief|cto|ceo|cfo|vp|vice president|director)\b", 50),
    (r"\b(?:principal|distinguished|fellow)\b", 40),
    (r"\b(?:staff|lead|head of)\b", 30),
    (r"\b(?:senior|sr\.?)\b", 20),
    (r"\b(?:architect|manager)\b", 15),
    (r"\b(?:iii|iv|v|vi)\b", 15),
    (r"\blevel\s*[4-9]\b", 15),
    (r"\bengr?\s*[4-6]\b", 15),
    (r"\b(?:counsel|of\s*counsel)\b", 20),
    (r"\b(?:attending|charge)\b", 20),
    (r"\b(?:ii|2)\b", 5),
    (r"\blevel\s*3\b", 5),
    (r"\b(?:associate)\b", -10),
    (r"\b(?:junior|jr\.?)\b", -20),
    (r"\bentry[\s-]?level\b", -25),
    (r"\b(?:i|1)\b(?!\s*-|\d)", -15),
    (r"\b(?:trainee|graduate|new\s*grad)\b", -25),
    (r"\b(?:paralegal|clerk)\b", -15),
    (r"\b(?:resident|clinical\s*fellow)\b", -15),
    (r"\b(?:aide|assistant|tech)\b", -10),
    (r"\bintern(?:ship)?\b", -100),
]
TIER_INTERN_MAX = -50
TIER_ENTRY_MAX = -5
TIER_SENIOR_MIN = 15

# --- FIXED VALUES: recruiter terms (substring of lower(company)) ------------
RECRUITER_TERMS = [
    "recruit", "recruiting", "recruiter", "staffing", "staff", "talent",
    "talenthub", "talentgroup", "solutions", "consulting", "placement",
    "search", "resources", "agency",
]

# --- FIXED VALUES: titles the clean step rejects (after trim + lower) -------
INVALID_TITLES = ["not specified", "n/a", "unknown", ""]

# --- FIXED VALUES: default role preset (case-insensitive, title only) ------
ROLE_PRESET = {
    "name": "Software / Cloud / DevOps",
    "levels": ["entry", "mid"],
    "preferred_country": "US",
    "include": [
        r"\bsoftware (engineer|developer|development engineer|dev)\b",
        r"\bswe\b",
        r"\bsde\b",
        r"\bprogrammer\b",
        r"\bfront[ -]?end\b",
        r"\bback[ -]?end\b",
        r"\bfull[ -]?stack\b",
        r"\bweb (developer|engineer)\b",
        r"\bui engineer\b",
        r"\bapi (developer|engineer)\b",
        r"\bapplications? developer\b",
        r"\bweb application (developer|engineer)\b",
        r"\bdev ?ops\b",
        r"\bsre\b",
        r"\bsite reliability\b",
        r"\bplatform (engineer|developer)\b",
        r"\binfrastructure (engineer|developer)\b",
        r"\bcloud (engineer|developer|architect|infrastructure|operations|native|platform)\b",
        r"\baws\b",
        r"\bazure\b",
        r"\bgcp\b",
        r"\bgoogle cloud\b",
        r"\bkubernetes\b",
        r"\bk8s\b",
        r"\bterraform\b",
        r"\bansible\b",
        r"\b(build|release) engineer\b",
        r"\bci/?cd\b",
        r"\b(java|python|javascript|typescript|node|ruby|php|golang|scala|kotlin|rust) (developer|engineer)\b",
        r"\b(react|angular|vue|django|rails|spring boot|node\.?js) (developer|engineer)\b",
        r"\b\.net (developer|engineer)\b",
        r"\bc\+\+ (developer|engineer)\b",
    ],
    "exclude": [
        r"\bsales\b",
        r"\baccount (executive|manager|director)\b",
        r"\bbusiness development\b",
        r"\bpre[ -]?sales\b",
        r"\bsolutions? engineer\b",
        r"\bcustomer success\b",
        r"\btechnical support\b",
        r"\bhelp ?desk\b",
        r"\bdesktop support\b",
        r"\b(mechanical|electrical|civil|chemical|structural|aerospace|environmental)\b",
        r"\b(industrial|manufacturing|process|quality|packaging|hvac|plant) engineer\b",
        r"\b(clinical|nurse|nursing|physician|pharmacy|pharmacist|dental|therapist|medical)\b",
        r"\b(teacher|professor|instructor|faculty|tutor|adjunct|lecturer)\b",
        r"\b(recruiter|recruiting|talent acquisition)\b",
        r"\bfield (service|engineer|technician|applications?)\b",
        r"\b(electrification|vfd|semiconductor|automotive|infotainment)\b",
        r"\btechnician\b",
        r"\b(marketing|copywriter|content writer)\b",
        r"\b(driver|warehouse|janitor|cashier|barista|server)\b",
        r"\b(graphic|ux|ui|product) designer\b",
        r"\btalent pool\b",
        r"\bai trainer\b",
        r"\bexpression of interest\b",
        r"\bgeneral application\b",
        r"\bspeculative application\b",
    ],
}

# --- FIXED VALUES: search / merge / trend parameters ------------------------
CHUNK_SIZE = 25_000
RETENTION_DAYS = 30
FUZZY_THRESHOLD = 0.75
HEAT_MIN_COUNT = 75
MARKER_LIMIT = 26
NEW_MATCHING_LIMIT = 60
PAGE_SIZES = [25, 50, 100]
ANOMALY_LOOKBACK = 7
ANOMALY_Z = 3
ANOMALY_MIN_DAYS = 5
ANOMALY_FLAT_BAND = 0.10
HEALTH_BLOCK_PCT = 50
HEALTH_LOW_PCT = 80
HISTORY_ROWS = 14
FRESH_DANGER_HOURS = 26
FRESH_WARNING_HOURS = 8
DEAD_STATUSES = [404, 410]
SALARY_DEFAULT_LEVEL = "mid"
LOCATION_CUT = 50

# --- FIXED VALUES: ISO code -> display name (country dropdown) --------------
COUNTRY_NAMES = {
    "US": "United States", "CA": "Canada", "GB": "United Kingdom", "IN": "India",
    "AU": "Australia", "DE": "Germany", "FR": "France", "BR": "Brazil",
    "MX": "Mexico", "SG": "Singapore", "NL": "Netherlands", "AR": "Argentina",
    "ES": "Spain", "IT": "Italy", "JP": "Japan", "CN": "China", "IE": "Ireland",
    "PL": "Poland", "SE": "Sweden", "CH": "Switzerland", "IL": "Israel",
    "PH": "Philippines", "ZA": "South Africa", "AE": "UAE", "NZ": "New Zealand",
    "PT": "Portugal", "BE": "Belgium", "DK": "Denmark", "NO": "Norway",
    "FI": "Finland", "AT": "Austria", "CZ": "Czechia", "RO": "Romania",
    "HU": "Hungary", "GR": "Greece", "TR": "Turkey", "KR": "South Korea",
    "HK": "Hong Kong", "MY": "Malaysia", "ID": "Indonesia", "TH": "Thailand",
    "VN": "Vietnam", "CO": "Colombia", "CL": "Chile", "PE": "Peru",
    "CR": "Costa Rica", "UA": "Ukraine", "RU": "Russia", "EG": "Egypt",
    "NG": "Nigeria", "KE": "Kenya", "PK": "Pakistan", "BD": "Bangladesh",
}


# =============================================================================
# FIXED VALUES: location parsing vocabularies (lower-case, normalised forms)
# =============================================================================
REMOTE_KEYWORDS = ["remote", "anywhere", "worldwide", "work from home", "wfh"]
TIMEZONE_KEYWORDS = ["time zone", "timezone", "time zones", "timezones"]
GARBAGE_LOCATIONS = [
    "", "not specified", "n/a", "none", "tbd", "unspecified", "multiple locations", "various",
    "flexible", "other", "global", "multiple", "varies", "various locations", "2 locations",
    "3 locations", "4 locations", "5 locations", "6 locations", "7 locations", "8 locations",
    "9 locations", "10 locations",
]
WORK_ARRANGEMENT_PREFIXES = [
    "hybrid in ", "hybrid - ", "hybrid: ", "hybrid, ", "on-site in ", "on site in ", "onsite in ",
    "in-office in ", "in office in ", "based in ", "located in ",
]
DIRECTION_EXPANSIONS = [
    (" n ", " north "), (" s ", " south "), (" e ", " east "), (" w ", " west "),
    (" nw ", " northwest "), (" ne ", " northeast "), (" sw ", " southwest "), (" se ", " southeast "),
]
ABBREVIATION_EXPANSIONS = [(" ft ", " fort "), (" mt ", " mount "), (" pt ", " port ")]
COUNTRY_ALIASES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US",
    "united states": "US", "united states of america": "US", "america": "US",
    "can": "CA", "canada": "CA",
    "mx": "MX", "mex": "MX", "mexico": "MX",
    "gb": "GB", "gbr": "GB", "uk": "GB", "u.k.": "GB",
    "united kingdom": "GB", "england": "GB", "scotland": "GB",
    "wales": "GB", "northern ireland": "GB", "britain": "GB", "great britain": "GB",
    "ie": "IE", "irl": "IE", "ireland": "IE",
    "deu": "DE", "ger": "DE", "germany": "DE", "deutschland": "DE",
    "fr": "FR", "fra": "FR", "france": "FR",
    "es": "ES", "esp": "ES", "spain": "ES",
    "it": "IT", "ita": "IT", "italy": "IT",
    "nl": "NL", "nld": "NL", "netherlands": "NL", "holland": "NL",
    "be": "BE", "bel": "BE", "belgium": "BE",
    "ch": "CH", "che": "CH", "switzerland": "CH",
    "at": "AT", "aut": "AT", "austria": "AT",
    "se": "SE", "swe": "SE", "sweden": "SE",
    "no": "NO", "nor": "NO", "norway": "NO",
    "dk": "DK", "dnk": "DK", "denmark": "DK",
    "fi": "FI", "fin": "FI", "finland": "FI",
    "pl": "PL", "pol": "PL", "poland": "PL",
    "pt": "PT", "prt": "PT", "portugal": "PT",
    "cz": "CZ", "cze": "CZ", "czech republic": "CZ", "czechia": "CZ",
    "gr": "GR", "grc": "GR", "greece": "GR",
    "ro": "RO", "rou": "RO", "romania": "RO",
    "ua": "UA", "ukr": "UA", "ukraine": "UA",
    "ind": "IN", "india": "IN",
    "cn": "CN", "chn": "CN", "china": "CN",
    "jp": "JP", "jpn": "JP", "japan": "JP",
    "kr": "KR", "kor": "KR", "korea": "KR", "south korea": "KR",
    "sg": "SG", "sgp": "SG", "singapore": "SG",
    "my": "MY", "mys": "MY", "malaysia": "MY",
    "ph": "PH", "phl": "PH", "philippines": "PH",
    "idn": "ID", "indonesia": "ID",
    "th": "TH", "tha": "TH", "thailand": "TH",
    "vn": "VN", "vnm": "VN", "vietnam": "VN",
    "hk": "HK", "hkg": "HK", "hong kong": "HK",
    "tw": "TW", "twn": "TW", "taiwan": "TW",
    "au": "AU", "aus": "AU", "australia": "AU",
    "nz": "NZ", "nzl": "NZ", "new zealand": "NZ",
    "isr": "IL", "israel": "IL",
    "ae": "AE", "are": "AE", "united arab emirates": "AE", "uae": "AE",
    "sau": "SA", "saudi arabia": "SA",
    "tr": "TR", "tur": "TR", "turkey": "TR",
    "za": "ZA", "zaf": "ZA", "south africa": "ZA",
    "eg": "EG", "egy": "EG", "egypt": "EG",
    "ng": "NG", "nga": "NG", "nigeria": "NG",
    "ke": "KE", "ken": "KE", "kenya": "KE",
    "br": "BR", "bra": "BR", "brazil": "BR", "brasil": "BR",
    "ar": "AR", "arg": "AR", "argentina": "AR",
    "cl": "CL", "chl": "CL", "chile": "CL",
    "col": "CO", "colombia": "CO",
    "pe": "PE", "per": "PE", "peru": "PE",
}
US_STATES = {
    "al": "AL", "alabama": "AL", "ak": "AK", "alaska": "AK", "az": "AZ", "arizona": "AZ",
    "ar": "AR", "arkansas": "AR", "ca": "CA", "california": "CA", "co": "CO", "colorado": "CO",
    "ct": "CT", "connecticut": "CT", "de": "DE", "delaware": "DE", "fl": "FL", "florida": "FL",
    "ga": "GA", "georgia": "GA", "hi": "HI", "hawaii": "HI", "id": "ID", "idaho": "ID",
    "il": "IL", "illinois": "IL", "in": "IN", "indiana": "IN", "ia": "IA", "iowa": "IA",
    "ks": "KS", "kansas": "KS", "ky": "KY", "kentucky": "KY", "la": "LA", "louisiana": "LA",
    "me": "ME", "maine": "ME", "md": "MD", "maryland": "MD", "ma": "MA", "massachusetts": "MA",
    "mi": "MI", "michigan": "MI", "mn": "MN", "minnesota": "MN", "ms": "MS", "mississippi": "MS",
    "mo": "MO", "missouri": "MO", "mt": "MT", "montana": "MT", "ne": "NE", "nebraska": "NE",
    "nv": "NV", "nevada": "NV", "nh": "NH", "new hampshire": "NH", "nj": "NJ", "new jersey": "NJ",
    "nm": "NM", "new mexico": "NM", "ny": "NY", "new york": "NY", "nc": "NC", "north carolina": "NC",
    "nd": "ND", "north dakota": "ND", "oh": "OH", "ohio": "OH", "ok": "OK", "oklahoma": "OK",
    "or": "OR", "oregon": "OR", "pa": "PA", "pennsylvania": "PA", "ri": "RI", "rhode island": "RI",
    "sc": "SC", "south carolina": "SC", "sd": "SD", "south dakota": "SD", "tn": "TN", "tennessee": "TN",
    "tx": "TX", "texas": "TX", "ut": "UT", "utah": "UT", "vt": "VT", "vermont": "VT",
    "va": "VA", "virginia": "VA", "wa": "WA", "washington": "WA", "wv": "WV", "west virginia": "WV",
    "wi": "WI", "wisconsin": "WI", "wy": "WY", "wyoming": "WY",
    "dc": "DC", "d c": "DC", "district of columbia": "DC", "washington dc": "DC", "washington d c": "DC",
}
CITY_ALIASES = {
    "bangalore": "bengaluru", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata",
    "peking": "beijing",
    "new york": "new york city", "nyc": "new york city", "ny city": "new york city",
    "la": "los angeles", "sf": "san francisco", "san fran": "san francisco",
    "london city of": "london", "city of london": "london",
    "bay area": "san francisco", "sf bay area": "san francisco", "san francisco bay area": "san francisco",
    "greater boston": "boston", "boston metro": "boston",
    "nyc metro": "new york city", "ny metro": "new york city", "greater new york": "new york city",
    "new york metro": "new york city",
    "dc metro": "washington", "washington metro": "washington",
    "la metro": "los angeles", "greater los angeles": "los angeles",
    "greater chicago": "chicago", "chicago metro": "chicago",
    "greater seattle": "seattle", "seattle metro": "seattle",
    "greater london": "london", "london metro": "london",
}
NYC_BOROUGHS = ["bronx", "brooklyn", "queens", "staten island", "manhattan"]
JUNK_TOKEN_SUFFIXES = ["hq", "office", "headquarters", "hub", "campus", "location", "site", "center",
                       "centre", "area", "township", "twp"]
FAMOUS_CITY_DEFAULTS = {
    "london": "GB", "paris": "FR", "san francisco": "US", "moscow": "RU", "berlin": "DE",
    "madrid": "ES", "rome": "IT", "sydney": "AU", "toronto": "CA", "dublin": "IE", "athens": "GR",
    "vienna": "AT", "cairo": "EG", "boston": "US", "chicago": "US", "seattle": "US", "denver": "US",
    "portland": "US", "columbus": "US", "richmond": "US", "springfield": "US",
    "los angeles": "US", "san diego": "US", "san jose": "US", "santa clara": "US", "dallas": "US",
    "houston": "US", "miami": "US", "cleveland": "US", "sacramento": "US", "rochester": "US",
    "albany": "US", "arlington": "US", "salem": "US", "phoenix": "US", "atlanta": "US",
    "detroit": "US", "baltimore": "US", "milwaukee": "US", "nashville": "US", "memphis": "US",
    "pittsburgh": "US", "cincinnati": "US", "minneapolis": "US", "philadelphia": "US",
}
FAMOUS_CITY_ADMIN = {
    "houston": "tx", "dallas": "tx", "san jose": "ca", "san diego": "ca", "santa clara": "ca",
    "los angeles": "ca", "sacramento": "ca", "arlington": "va", "albany": "ny", "rochester": "ny",
    "salem": "or", "portland": "or", "columbus": "oh", "cleveland": "oh", "cincinnati": "oh",
    "richmond": "va", "springfield": "il", "miami": "fl", "phoenix": "az", "atlanta": "ga",
    "detroit": "mi", "baltimore": "md", "milwaukee": "wi", "nashville": "tn", "memphis": "tn",
    "pittsburgh": "pa", "philadelphia": "pa", "minneapolis": "mn", "denver": "co", "seattle": "wa",
    "boston": "ma", "chicago": "il", "san francisco": "ca",
}
