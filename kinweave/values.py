"""Word lists, lookup tables and constants that results depend on."""

from __future__ import annotations

# Null literals of the raw reader.
NULLS = ["", "null", "NULL", "nan", "NaN", "None", "N/A", "NA"]
NULLS_CLEAN = ["", "null", "NULL", "nan", "NaN", "None"]
NULLS_FOLDED = ["null", "nan", "none", "n/a", "na", ""]

# Blocking caps, weights and budgets.
NAME_CAP, PREFIX_CAP, ADDR_CAP, NUM_CAP, GRAM_CAP = 25_000, 8_000, 3_000, 4_000, 12_000
RARE_DF, MEDIUM_DF = 250, 6_000
MIN_TOKEN, PREFIX_LENGTH = 3, 5
W_RARE, W_NAME, W_COMMON, W_COMPOSITE, W_NUM, W_ADDR, W_PREFIX, W_GRAM = 16, 6, 1, 14, 6, 2, 3, 6
BOOST_NAMES, BOOST_POSTAL, BOOST_COMPOSITE = 20, 18, 16
BUDGET_BASE, BUDGET_MAX, QUALITY, FALLBACK_TRIGGER, FALLBACK_ADD = 800, 2_000, 8, 10, 100

# Words that carry no identity in names (blocking).
NAME_STOPS = [
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "pvt", "private", "co", "company", "llp", "plc", "gmbh", "ag", "the", "of", "and",
    "for", "group", "holdings", "enterprise", "enterprises", "com", "www", "http", "https", "org", "net", "sa", "sas", "sarl", "sci", "eurl", "bv", "nv",
    "pty", "pte", "groupe", "societe", "association", "ets", "cie", "sasu", "snc", "scs", "ste", "direction", "service", "services",
]

# Words that carry no identity in addresses (blocking).
ADDR_STOPS = [
    "near", "behind", "opp", "opposite", "beside", "above", "below", "floor", "fl", "block", "shop", "flat", "unit", "apt", "apartment", "no", "number",
    "plot", "house", "building", "bldg", "tower", "room", "road", "rd", "street", "st", "avenue", "ave", "drive", "dr", "lane", "ln", "boulevard", "blvd",
    "highway", "hwy", "way", "path", "place", "plaza", "square", "sq", "court", "ct", "circle", "cir", "po", "box", "null", "none", "na", "nil", "unknown",
    "north", "south", "east", "west", "new", "old", "central", "nagar", "colony", "marg", "sector", "phase", "zone", "area", "district", "dist", "tehsil",
    "taluk", "mandal", "ward", "chowk", "bazaar", "complex", "enclave", "vihar", "puram", "gram", "ville", "rue", "chemin", "allee", "impasse", "route",
    "rte", "quai", "cours", "passage", "cedex", "bp", "cs", "immeuble", "batiment", "bat", "porte", "residence", "res", "lotissement", "zi", "za", "zac",
]

# Legal suffixes of the cleaner, with their canonical forms.
LEGAL_SUFFIXES = {
    "corporation": "corp", "corp": "corp", "corp.": "corp", "incorporated": "inc", "inc": "inc", "inc.": "inc", "llc": "llc", "l.l.c.": "llc", "l.l.c": "llc",
    "llc.": "llc", "llp": "llp", "l.l.p.": "llp", "l.l.p": "llp", "limited": "ltd", "ltd": "ltd", "ltd.": "ltd", "ltda": "ltd", "private": "pvt",
    "pvt": "pvt", "pvt.": "pvt", "pvte": "pvt", "public": "pub", "pub": "pub", "company": "co", "co": "co", "co.": "co", "partners": "partners",
    "partnership": "partners", "associates": "associates", "assoc": "associates", "assoc.": "associates", "association": "assn", "assn": "assn",
    "society": "society", "sarl": "sarl", "s.a.r.l.": "sarl", "s.a.r.l": "sarl", "sas": "sas", "s.a.s.": "sas", "s.a.s": "sas", "sasu": "sasu",
    "eurl": "eurl", "sa": "sa", "s.a.": "sa", "sci": "sci", "s.c.i.": "sci", "nidhi": "nidhi", "opc": "opc", "section-8": "sec8",
}
LEGAL_PREFIXES = [
    "llc", "l.l.c.", "llp", "l.l.p.", "inc", "inc.", "corp", "corp.", "sarl", "sas", "sasu", "eurl", "gmbh",
]
LEGAL_PHRASES = {
    "pvt ltd": "pvt ltd", "private limited": "pvt ltd", "pvt. ltd.": "pvt ltd", "pvt. ltd": "pvt ltd", "pvt ltd.": "pvt ltd", "pub ltd": "pub ltd",
    "public limited": "pub ltd", "pub. ltd.": "pub ltd", "pub. ltd": "pub ltd", "pub ltd.": "pub ltd",
}
NAME_FILLERS = [
    "dba", "smt", "shri", "shree", "sri", "m/s", "ms", "mr", "mrs", "dr", "the",
]

# Street words of the cleaner.
STREETS = {
    "st": "street", "st.": "street", "ave": "avenue", "ave.": "avenue", "blvd": "boulevard", "blvd.": "boulevard", "bd": "boulevard", "bd.": "boulevard",
    "dr": "drive", "dr.": "drive", "rd": "road", "rd.": "road", "ct": "court", "ct.": "court", "ln": "lane", "ln.": "lane", "pl": "place", "pl.": "place",
    "pkwy": "parkway", "pkwy.": "parkway", "hwy": "highway", "hwy.": "highway", "cir": "circle", "cir.": "circle", "trl": "trail", "trl.": "trail",
    "ter": "terrace", "ter.": "terrace", "sq": "square", "sq.": "square", "aly": "alley", "aly.": "alley", "rte": "route", "rte.": "route", "ste": "suite",
    "ste.": "suite", "apt": "apartment", "apt.": "apartment", "fl": "floor", "fl.": "floor", "bldg": "building", "bldg.": "building", "dept": "department",
    "dept.": "department", "imp": "impasse", "imp.": "impasse", "ch": "chemin", "ch.": "chemin", "expy": "expressway", "fwy": "freeway", "rue": "rue",
}

# States and regions of the cleaner.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc", "puerto rico": "pr",
}
INDIA_STATES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ct": "chhattisgarh", "dl": "delhi", "ga": "goa",
    "gj": "gujarat", "hp": "himachal pradesh", "hr": "haryana", "jh": "jharkhand", "jk": "jammu and kashmir", "ka": "karnataka", "kl": "kerala",
    "mh": "maharashtra", "ml": "meghalaya", "mn": "manipur", "mp": "madhya pradesh", "mz": "mizoram", "nl": "nagaland", "od": "odisha", "or": "odisha",
    "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tg": "telangana", "tn": "tamil nadu", "tr": "tripura", "ts": "telangana", "uk": "uttarakhand",
    "up": "uttar pradesh", "wb": "west bengal", "tamilnadu": "tamil nadu", "tamil": "tamil nadu", "karnatak": "karnataka", "maharastra": "maharashtra",
    "orrisa": "odisha", "orissa": "odisha", "pondicherry": "puducherry", "uttaranchal": "uttarakhand", "chattisgarh": "chhattisgarh",
    "chhatisgarh": "chhattisgarh", "hriyaannaa": "haryana", "hriyanaa": "haryana", "uttr prdesh": "uttar pradesh", "uttar prdesh": "uttar pradesh",
    "uttara pradesha": "uttar pradesh", "mhaaraassttrraa": "maharashtra", "maharashttra": "maharashtra", "tmiilnnaaddu": "tamil nadu",
    "tamilnaadu": "tamil nadu", "krnaattk": "karnataka", "karnaatak": "karnataka", "rjaasthaan": "rajasthan", "rjaasthan": "rajasthan", "gujaraat": "gujarat",
    "gujarata": "gujarat", "pnjaab": "punjab", "pnjab": "punjab", "pschm bnggaal": "west bengal", "dillii": "delhi", "dilli": "delhi", "keral": "kerala",
    "kerla": "kerala", "mdhy prdesh": "madhya pradesh", "madhya prdesh": "madhya pradesh", "bihaar": "bihar", "jhaarkhnd": "jharkhand",
    "chhaattiisgdh": "chhattisgarh", "aandhr prdesh": "andhra pradesh", "tlnggaanaa": "telangana", "telangaanaa": "telangana", "oddishaa": "odisha",
    "uttaraakhndd": "uttarakhand", "andhra pradesh": "andhra pradesh", "arunachal pradesh": "arunachal pradesh", "assam": "assam", "bihar": "bihar",
    "chhattisgarh": "chhattisgarh", "delhi": "delhi", "goa": "goa", "gujarat": "gujarat", "himachal pradesh": "himachal pradesh", "haryana": "haryana",
    "jharkhand": "jharkhand", "jammu and kashmir": "jammu and kashmir", "karnataka": "karnataka", "kerala": "kerala", "maharashtra": "maharashtra",
    "meghalaya": "meghalaya", "manipur": "manipur", "madhya pradesh": "madhya pradesh", "mizoram": "mizoram", "nagaland": "nagaland", "odisha": "odisha",
    "punjab": "punjab", "rajasthan": "rajasthan", "sikkim": "sikkim", "telangana": "telangana", "tamil nadu": "tamil nadu", "tripura": "tripura",
    "uttarakhand": "uttarakhand", "uttar pradesh": "uttar pradesh", "west bengal": "west bengal", "puducherry": "puducherry", "chandigarh": "chandigarh",
    "dadra and nagar haveli": "dadra and nagar haveli", "daman and diu": "daman and diu", "lakshadweep": "lakshadweep",
    "andaman and nicobar": "andaman and nicobar", "ladakh": "ladakh",
}
FRANCE_REGIONS = {
    "ile-de-france": "ile-de-france", "ile de france": "ile-de-france", "idf": "ile-de-france", "nouvelle-aquitaine": "nouvelle-aquitaine",
    "nouvelle aquitaine": "nouvelle-aquitaine", "hauts-de-france": "hauts-de-france", "hauts de france": "hauts-de-france",
    "pays de la loire": "pays de la loire", "bretagne": "bretagne", "normandie": "normandie", "occitanie": "occitanie",
    "auvergne-rhone-alpes": "auvergne-rhone-alpes", "auvergne rhone alpes": "auvergne-rhone-alpes",
    "provence-alpes-cote d'azur": "provence-alpes-cote d'azur", 'paca': "provence-alpes-cote d'azur", "grand est": "grand est",
    "bourgogne-franche-comte": "bourgogne-franche-comte", "centre-val de loire": "centre-val de loire", "corse": "corse",
}
STATES = {"us": US_STATES | {c: c for c in US_STATES.values()}, "india": INDIA_STATES, "france": FRANCE_REGIONS}

# Patterns of the cleaner (for lower-case ASCII text).
URL = r"(?i)(?:https?://)?(?:www\.)?[\w\-]+\.(?:com|org|net|in|co\.in|co|io)\b"
PHONE = r"\b\d[\d\s\-\.]{6,}\d\b"
NULL_WORD = r"(?i)\b(?:null|nan|none|n/a|na)\b"
BRACKETS = "<>[]{}«»"
HOUSE = r"(?i)\b(?:h\.?\s*no\.?|kh\.?\s*no\.?|door\s*no\.?|d\.?\s*no\.?|plot\s*no\.?|flat\s*no\.?|shop\s*no\.?|block\s*no\.?)\s*"
LANDMARK = r"(?i)\b(?:near|opp\.?|opposite|behind|beside|adjacent\s+to|next\s+to|in\s+front\s+of|c/o|care\s+of)\s+[^,]*"
HYPHEN_SUFFIX = r"(?i)-(?=l\.?l\.?c|l\.?l\.?p|inc|ltd|corp|pvt|pub|llc|llp)"
PIN_INDIA = r"\b(\d{6})\b"
ZIP_US = r"(\b[a-zA-Z]+\s+|,\s*)(\d{5})(?:-\d{4})?\b"
POSTAL_FRANCE = r"(,\s*|^\s*)(\d{5})\b"
#: The same codes past the address' first word: a number that opens an address is its house number where a code follows.
PIN_INDIA_LATER, POSTAL_FRANCE_LATER = r"(?<!^)" + PIN_INDIA, r"(,\s*)(\d{5})\b"

# Suffixes of the matcher, in the order of trial; the first that ends the text is cut.
MATCH_SUFFIXES = [
    "private limited", "pvt limited", "pvt ltd", "pvt. ltd.", "pvt. ltd", "pvt ltd.", "private ltd", "private ltd.", "priv ltd",
    "société par actions simplifiée", "société à responsabilité limitée", "société anonyme", "société civile immobilière", "sarl", "sasu", "sas", "sa", "sci",
    "eurl", "snc", "limited liability partnership", "limited liability company", "limited partnership", "limited", "incorporated", "corporation", "company",
    "l.l.c.", "llc", "llp", "l.l.p.", "l.p.", "lp", "ltd.", "ltd", "inc.", "inc", "corp.", "corp", "co.", "co", "p.c.", "pc", "p.a.", "pa", "pllc",
    "p.l.l.c.", "nidhi limited", "opc private limited",
]
MATCH_PREFIXES = ["the ", "shri ", "shree ", "sri ", "smt "]
MATCH_URL = r"https?://\S+|www\.\S+|\S+\.(?:com|org|net|co\.in)\b"
# Abbreviations of the matcher.
MATCH_STREETS = {
    "st": "street", "ave": "avenue", "rd": "road", "dr": "drive", "blvd": "boulevard", "ct": "court", "ln": "lane", "cir": "circle", "pl": "place",
    "pkwy": "parkway", "hwy": "highway", "apt": "apartment", "ste": "suite", "fl": "floor", "bldg": "building", "mt": "mount", "ft": "fort", "n": "north",
    "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
}
MATCH_INDIA = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ga": "goa", "gj": "gujarat", "hr": "haryana",
    "hp": "himachal pradesh", "jk": "jammu and kashmir", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh", "mh": "maharashtra",
    "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "od": "odisha", "or": "orissa", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim",
    "tn": "tamil nadu", "ts": "telangana", "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand", "wb": "west bengal", "dl": "delhi",
    "py": "puducherry", "ch": "chandigarh",
}

# The features' names, in order.
FEATURES = [
    "name_jaro_winkler", "name_levenshtein", "name_jaccard", "name_token_sort", "name_token_set", "name_containment", "name_exact", "name_length_ratio",
    "name_aggressive_jw", "name_soundex_overlap", "addr_jaro_winkler", "addr_jaccard", "addr_token_sort", "addr_number_overlap", "addr_postal_match",
    "addr_length_ratio", "addr_containment", "addr_any_empty", "country_match", "source_type", "geo_mean_name_addr", "min_name_addr_sim", "max_name_addr_sim",
]
SHORT_CIRCUIT = 0.40
