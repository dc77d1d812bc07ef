"""Lookup tables, patterns and vocabulary that results depend on."""

# --- fixed values: whitespace stripped from text cells (Unicode white space) ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: vocabulary ---
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = XSD + "string"
XSD_INTEGER = XSD + "integer"
XSD_DOUBLE = XSD + "double"
XSD_BOOLEAN = XSD + "boolean"
XSD_DATE_TIME = XSD + "dateTime"
SCHEMA_ARTICLE = "http://schema.org/Article"
SCHEMA_ABOUT = "http://schema.org/about"
SCHEMA_IN_LANGUAGE = "http://schema.org/inLanguage"
SCHEMA_NAME = "http://schema.org/name"
SCHEMA_IS_PART_OF = "http://schema.org/isPartOf"
WIKI_GROUP = "http://wikiba.se/ontology#wikiGroup"
ITEM_ENTITY = "http://www.wikidata.org/entity/"
MEDIA_ENTITY = "https://commons.wikimedia.org/entity/"
FILE_PATH = "https://commons.wikimedia.org/wiki/Special:FilePath/"

# --- fixed values: record keys with a meaning of their own ---
ROW_HINT_KEYS = ["id", "pageid", "title", "len", "namespace", "nstext", "qid", "wikidata", "wiki"]
DATE_KEYS = ["img_timestamp", "touched", "gil_link_rev_timestamp"]
IDENTIFIER_KEYS = ["id", "pageid", "title", "qid", "wikidata"]
META_KEYS = ["wikidata", "image", "coordinates"]
QID_KEYS = ["wikidata_id", "qid", "q", "wikidata"]
TITLE_PREFIXES = ["page", "ar", "rd", "pt", "wl", "rc", "log", "tl", "pl", "lt"]
FILE_TITLE_COLUMNS = {"img_name": "img_uri", "oi_name": "oi_uri", "fa_name": "fa_uri"}
CATEGORY_TITLE_COLUMNS = {"cl_to": "cl_uri"}
ITEM_PROPERTY = "wikibase_item"
ITEM_CATEGORY = "Maintenance:Wikidata_interwiki_links"

# --- fixed values: characters left alone when a path, a file name or an identifier is quoted ---
SAFE_PATH = ":_/()-.,"
SAFE_FILE = "_-().,:"
SAFE_NONE = ""

# --- fixed values: patterns ---
QID_PATTERN = r"(?i)Q([1-9][0-9]*)"
HOST_LABEL_PATTERN = r"^(?!-)[a-z0-9-]{1,63}(?<!-)$"
SITE_TOKEN_PATTERN = r"^[a-z0-9_-]+$"
LANGUAGE_TAG_PATTERN = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"
RUN_VARS_PATTERN = r"(?is)var\s+vars\s*=\s*(\{.*?\})\s*;"
RUN_ID_PATTERN = r'(?i)"qrun_id"\s*:\s*(\d+)'
INPUT_TAG_PATTERN = r"(?is)<input\b[^>]*>"
INPUT_ID_PATTERN = r"""(?is)\bid\s*=\s*(["'])query-db\1"""
INPUT_VALUE_PATTERN = r"""(?is)\bvalue\s*=\s*(["'])(.*?)\1"""

# --- fixed values: wiki names, groups and domains ---
INCUBATOR_DOMAIN = "incubator.wikimedia.org"
META_DOMAIN = "meta.wikimedia.org"
COMMONS_DOMAIN = "commons.wikimedia.org"
WIKIDATA_DOMAIN = "www.wikidata.org"
FILE_NAMESPACE = 6
CATEGORY_NAMESPACE = 14
SPECIAL_SITES = {
    "commonswiki": "commons.wikimedia.org",
    "wikidatawiki": "www.wikidata.org",
    "metawiki": "meta.wikimedia.org",
    "outreachwiki": "outreach.wikimedia.org",
    "specieswiki": "species.wikimedia.org",
    "incubatorwiki": "incubator.wikimedia.org",
    "mediawikiwiki": "www.mediawiki.org",
}
SITE_SUFFIX_DOMAINS = {
    "wikivoyage": "wikivoyage.org",
    "wikiversity": "wikiversity.org",
    "wikisource": "wikisource.org",
    "wiktionary": "wiktionary.org",
    "wikiquote": "wikiquote.org",
    "wikibooks": "wikibooks.org",
    "wikinews": "wikinews.org",
    "wiki": "wikipedia.org",
}
SITE_TOKEN_GROUPS = {
    "commonswiki": "commons",
    "wikidatawiki": "wikidata",
    "metawiki": "wikimedia",
    "mediawikiwiki": "wikimedia",
    "specieswiki": "wikimedia",
    "outreachwiki": "wikimedia",
    "incubatorwiki": "wikimedia",
}
SITE_SUFFIX_GROUPS = {
    "wiktionary": "wiktionary",
    "wikiquote": "wikiquote",
    "wikibooks": "wikibooks",
    "wikinews": "wikinews",
    "wikiversity": "wikiversity",
    "wikivoyage": "wikivoyage",
    "wikisource": "wikisource",
    "wiki": "wikipedia",
}
SITE_CODE_GROUPS = {
    "wiki": "wikipedia",
    "wiktionary": "wiktionary",
    "wikiquote": "wikiquote",
    "wikibooks": "wikibooks",
    "wikinews": "wikinews",
    "wikiversity": "wikiversity",
    "wikivoyage": "wikivoyage",
    "wikisource": "wikisource",
    "commons": "commons",
    "wikidata": "wikidata",
    "meta": "wikimedia",
    "mediawiki": "wikimedia",
    "species": "wikimedia",
    "outreach": "wikimedia",
    "incubator": "wikimedia",
}
PROJECT_CODE_GROUPS = {
    "Wp": "wikipedia",
    "Wt": "wiktionary",
    "Wq": "wikiquote",
    "Wb": "wikibooks",
    "Wn": "wikinews",
    "Wy": "wikivoyage",
    "Ws": "wikisource",
    "Wv": "wikiversity",
}
SUPPORTED_GROUPS = [
    "wikipedia",
    "wiktionary",
    "wikibooks",
    "wikinews",
    "wikiquote",
    "wikisource",
    "wikiversity",
    "wikivoyage",
    "wikidata",
    "commons",
]
SUPPORTED_SPECIAL_DOMAINS = [INCUBATOR_DOMAIN, META_DOMAIN]
GROUP_PREFIXES = {
    "wikipedia": "w",
    "wiktionary": "wikt",
    "wikibooks": "b",
    "wikinews": "n",
    "wikiquote": "q",
    "wikisource": "s",
    "wikiversity": "v",
    "wikivoyage": "voy",
    "wikidata": "d",
    "commons": "commons",
}
GROUP_DOMAIN_SUFFIXES = {
    "wikipedia": ".wikipedia.org",
    "wiktionary": ".wiktionary.org",
    "wikibooks": ".wikibooks.org",
    "wikinews": ".wikinews.org",
    "wikiquote": ".wikiquote.org",
    "wikisource": ".wikisource.org",
    "wikiversity": ".wikiversity.org",
    "wikivoyage": ".wikivoyage.org",
}
PREFIX_GROUPS = {
    "w": "wikipedia",
    "wikipedia": "wikipedia",
    "wikt": "wiktionary",
    "wiktionary": "wiktionary",
    "b": "wikibooks",
    "wikibooks": "wikibooks",
    "n": "wikinews",
    "wikinews": "wikinews",
    "q": "wikiquote",
    "wikiquote": "wikiquote",
    "s": "wikisource",
    "wikisource": "wikisource",
    "v": "wikiversity",
    "wikiversity": "wikiversity",
    "voy": "wikivoyage",
    "wikivoyage": "wikivoyage",
    "d": "wikidata",
    "wikidata": "wikidata",
    "commons": "commons",
    "c": "commons",
}
PREFIX_SPECIAL_DOMAINS = {"meta": META_DOMAIN, "m": META_DOMAIN, "incubator": INCUBATOR_DOMAIN}
TOKEN_ALIASES = {
    "commons": "commons",
    "c": "commons",
    "wikidata": "wikidata",
    "d": "wikidata",
    "meta": "meta",
    "m": "meta",
    "incubator": "incubator",
}
SPECIAL_TOKEN_DOMAINS = {
    "commons": COMMONS_DOMAIN,
    "wikidata": WIKIDATA_DOMAIN,
    "meta": META_DOMAIN,
    "incubator": INCUBATOR_DOMAIN,
}
SPECIAL_DOMAIN_TOKENS = {
    COMMONS_DOMAIN: "commons",
    WIKIDATA_DOMAIN: "wikidata",
    "wikidata.org": "wikidata",
    META_DOMAIN: "meta",
    INCUBATOR_DOMAIN: "incubator",
}
TIMESTAMP_LENGTHS = [4, 6, 8, 10, 12, 14]

# --- fixed values: limits ---
EDITED_WINDOW_DAYS = 60
PRECHECK_WINDOW_DAYS = 30
MEMBER_WINDOW_DAYS = 30
MAX_PREFIXES = 10
MAX_PREFIX_LENGTH = 10
CATALOG_FRESH_MINUTES = 30
CATALOG_RETENTION_DAYS = 1
REDIRECT_PAGE_LENGTH = 250
