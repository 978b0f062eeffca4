"""Registry of the linkage queries and their SQL counterparts, over the test tables' stand-in records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import values as V
from kinweave.functions import block as B
from kinweave.functions import clean as C
from kinweave.functions import match as M
from kinweave.functions import similarity as S
from kinweave.functions.block import squeeze
from kinweave.functions.fold import transliterate
from kinweave.operators import blocking, evaluate, model, sampling, validate
from kinweave.sources import sinks, tables
from kinweave.sources.sinks import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: SQL with marks such as @rare@ where the profile's constants stand.
TEMPLATES: dict[str, str] = {}
FULL = blocking.Profile()


def filled(sql: str, p: blocking.Profile = FULL) -> str:
    """A template's SQL for one profile."""
    constants = {f"cap_{k}": v for k, v in p.caps.items()} | {k: getattr(p, k) for k in ("rare", "medium", "base", "most", "trigger", "add")}
    for k, v in constants.items():
        sql = sql.replace(f"@{k}@", str(v))
    return sql


def query(sql: str | None = None):
    """Registers a query, and its SQL with the method's own caps and budgets."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            TEMPLATES[f.__name__], ORACLES[f.__name__] = sql, filled(sql)
        return f

    return add


# ---- SQL building blocks
def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join("WHEN '{}' THEN '{}'".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in table.items()) + " END"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _latin(x: str) -> str:
    return f"replace(replace(replace(strip_accents({x}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"


def _names(x: str) -> str:
    keep = f"lambda t: length(t) >= 3 AND t NOT IN {_in(V.NAME_STOPS)} AND NOT regexp_full_match(t, '[0-9]+')"
    own, other = f"list_filter(string_split({_norm(x)}, ' '), {keep})", f"list_filter(string_split({_norm(_latin(x))}, ' '), {keep})"
    # An order-keeping distinct; the order is of no account to any result.
    return f"CASE WHEN {_norm(_latin(x))} NOT IN ('', {_norm(x)}) THEN list_distinct(list_concat({own}, {other})) ELSE {own} END"


ENT = rf"""ent AS (SELECT 'S' || (page_id % 3 + 1) || '-' || page_id AS entity_id, regexp_extract(html, '{tables.TITLE}', 1) AS name,
  trim(regexp_replace(url, '[^A-Za-z0-9]+', ' ', 'g')) || ' St. ' || (10000 + page_id % 97) AS addr, coalesce({_case(tables.LANDS, f"regexp_extract(url, '{tables.LANG}', 1)")}, '') AS country FROM pages)"""
#: Whole documents, for the queries that show a normaliser alone.
DOC = "ent AS (SELECT doc_id AS entity_id, text AS name, text AS addr, lang AS country FROM documents)"
TOK = f"""{ENT},
tok AS (SELECT entity_id, country, addr, name, {_names('name')} AS names,
  list_filter(string_split({_norm('addr')}, ' '), lambda t: length(t) >= 3 AND t NOT IN {_in(V.ADDR_STOPS)}) AS addrs,
  list_filter(string_split({_norm('addr')}, ' '), lambda t: length(t) >= 2 AND regexp_matches(t, '[0-9]')) AS nums FROM ent),
pre AS (SELECT *, list_transform(list_filter(names, lambda t: length(t) >= 5), lambda t: substr(t, 1, 5)) AS prefixes FROM tok)"""
TRUTH = f"""{ENT},
truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM ent a JOIN ent b ON a.country = b.country AND {_norm('a.name')} = {_norm('b.name')}
  WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%')"""
POST = f"""{TOK},
bags AS (SELECT country, entity_id, 'name' AS channel, unnest(names) AS token FROM pre
  UNION ALL SELECT country, entity_id, 'prefix', unnest(CASE WHEN entity_id LIKE 'S1-%' THEN prefixes ELSE list_distinct(prefixes) END) FROM pre
  UNION ALL SELECT country, entity_id, 'addr', unnest(addrs) FROM pre UNION ALL SELECT country, entity_id, 'num', unnest(nums) FROM pre),
tf AS (SELECT country, entity_id, channel, token, count(*) AS tf FROM bags WHERE trim(country) <> '' GROUP BY ALL),
df AS (SELECT country, channel, token, CAST(sum(tf) AS BIGINT) AS df FROM tf WHERE entity_id NOT LIKE 'S1-%' GROUP BY ALL)"""
_CAPS = "CASE channel " + " ".join(f"WHEN '{k}' THEN @cap_{k}@" for k in FULL.caps) + " END"
TOKD = TOK.replace(ENT, DOC)
PAIRS = f"""{POST},
cap AS (SELECT * FROM df WHERE df <= {_CAPS}),
hit AS (SELECT q.entity_id AS s1_id, t.entity_id AS cand_id, q.channel, q.tf * t.tf AS n, CASE q.channel
    WHEN 'name' THEN CASE WHEN df <= @rare@ THEN {V.W_RARE} WHEN df <= @medium@ THEN {V.W_NAME} ELSE {V.W_COMMON} END
    WHEN 'prefix' THEN {V.W_PREFIX} WHEN 'addr' THEN {V.W_ADDR} ELSE {V.W_NUM} END AS w
  FROM tf q JOIN tf t ON q.country = t.country AND q.channel = t.channel AND q.token = t.token JOIN cap ON cap.country = q.country AND cap.channel = q.channel AND cap.token = q.token
  WHERE q.entity_id LIKE 'S1-%' AND t.entity_id NOT LIKE 'S1-%'),
sums AS (SELECT s1_id, cand_id, CAST(coalesce(sum(n * w) FILTER (WHERE channel IN ('name', 'prefix')), 0) AS BIGINT) AS sa, CAST(coalesce(sum(n * w) FILTER (WHERE channel IN ('addr', 'num')), 0) AS BIGINT) AS sb,
  CAST(coalesce(sum(n) FILTER (WHERE channel = 'name'), 0) AS BIGINT) AS hits, bool_or(channel = 'num') AS postal FROM hit GROUP BY s1_id, cand_id),
comp AS (SELECT *, CAST(CASE WHEN sa > 0 AND sb > 0 THEN sa + sb + {V.W_COMPOSITE} ELSE 0 END AS BIGINT) AS composite FROM sums),
scored AS (SELECT *, CAST(CASE WHEN composite > 0 THEN composite ELSE sa + sb END + CASE WHEN hits >= 2 THEN {V.BOOST_NAMES} ELSE 0 END
  + CASE WHEN sa >= 6 AND postal THEN {V.BOOST_POSTAL} ELSE 0 END + CASE WHEN composite >= 22 THEN {V.BOOST_COMPOSITE} ELSE 0 END AS BIGINT) AS score FROM comp)"""


def _grams(x: str) -> str:
    solid = f"replace({x}, ' ', '')"
    return f"CASE WHEN {solid} = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, greatest(1, length({solid}) - 2) + 1), lambda i: substr({solid}, i, 3)) END"


FALL = f"""{PAIRS},
g AS (SELECT DISTINCT country, entity_id, unnest(list_concat({_grams(_norm('name'))}, CASE WHEN {_norm(_latin('name'))} <> {_norm('name')} THEN {_grams(_norm(_latin('name')))} ELSE CAST([] AS VARCHAR[]) END)) AS token FROM ent WHERE trim(country) <> ''),
many AS (SELECT s1_id FROM scored WHERE sa > 0 GROUP BY s1_id HAVING count(*) >= @trigger@),
gdf AS (SELECT country, token FROM g WHERE entity_id NOT LIKE 'S1-%' GROUP BY ALL HAVING count(*) <= @cap_gram@),
share AS (SELECT q.entity_id AS s1_id, t.entity_id AS cand_id, count(*) AS n FROM g q JOIN g t ON q.country = t.country AND q.token = t.token JOIN gdf ON gdf.country = q.country AND gdf.token = q.token
  WHERE q.entity_id LIKE 'S1-%' AND t.entity_id NOT LIKE 'S1-%' AND q.entity_id NOT IN (SELECT s1_id FROM many) GROUP BY ALL HAVING count(*) >= 2),
fall AS (SELECT s1_id, cand_id, n * {V.W_GRAM} AS gram_score FROM (SELECT share.*, row_number() OVER (PARTITION BY s1_id ORDER BY n DESC, cand_id) AS k FROM share ANTI JOIN (SELECT * FROM scored WHERE sa > 0) USING (s1_id, cand_id)) WHERE k <= @add@)"""
BUDGET = f"""{FALL},
merged AS (SELECT coalesce(scored.s1_id, fall.s1_id) AS s1_id, coalesce(scored.cand_id, fall.cand_id) AS cand_id, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb, coalesce(composite, 0) AS composite,
  CAST(coalesce(score, 0) + coalesce(gram_score, 0) AS BIGINT) AS score FROM scored FULL JOIN fall USING (s1_id, cand_id)),
m1 AS (SELECT *, substr(cand_id, 1, 2) AS source, count(*) OVER (PARTITION BY s1_id) AS n, sum(CAST(score >= {V.QUALITY} AS INT)) OVER (PARTITION BY s1_id) AS good FROM merged),
m2 AS (SELECT *, CAST(CASE WHEN good <= @base@ THEN @base@ ELSE least(good, @most@) END AS BIGINT) AS budget, row_number() OVER (PARTITION BY s1_id, source ORDER BY score DESC, cand_id) AS by_source FROM m1),
m3 AS (SELECT *, by_source <= budget // 2 AS quota FROM m2),
m4 AS (SELECT *, sum(CAST(quota AS INT)) OVER (PARTITION BY s1_id) AS taken, row_number() OVER (PARTITION BY s1_id, quota ORDER BY score DESC, cand_id) AS by_rest FROM m3),
cand AS (SELECT s1_id, cand_id, source, sa, sb, composite, score, budget FROM m4 WHERE n <= budget OR quota OR by_rest <= budget - taken)"""


# ---- Spark building blocks
def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tables.sources(spark, d)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return tables.entities(spark, d)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("name"), F.col("text").alias("addr"), F.col("lang").alias("country"))


def _truth(spark: SparkSession, d: str, keep=lambda df: df) -> DataFrame:
    """``keep`` may write the entities' normalised names (``stored``), for pairs that are asked more than once."""
    q, t = _sources(spark, d)
    key = lambda df, name: keep(df.select(F.col("entity_id").alias(name), "country", B.norm(F.col("name")).alias("key")))
    return key(q, "s1_id").join(key(t, "cand_id"), ["country", "key"]).select("s1_id", "cand_id")


def _candidates(spark: SparkSession, d: str, p: blocking.Profile = FULL) -> DataFrame:
    return blocking.candidates(*_sources(spark, d), p, stored)


def _listed(df: DataFrame, **arrays) -> DataFrame:
    return df.select("entity_id", *[F.array_join(F.array_sort(v), " ").alias(k) for k, v in arrays.items()])


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


# ---- scans
@query(f"WITH {ENT} SELECT * FROM ent")
def scan_entities(spark, d):
    return _entities(spark, d)


@query(f"SELECT c_custkey, CASE WHEN c_mktsegment IS NULL OR c_mktsegment IN {_in(V.NULLS)} THEN '' ELSE c_mktsegment END AS segment, CASE WHEN lower(trim(x)) IN {_in(V.NULLS_FOLDED)} THEN '' ELSE trim(x) END AS safe FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'n/a' WHEN 2 THEN 'None' ELSE ' ' || c_name || ' ' END AS x FROM customer)")
def scan_null_literals(spark, d):
    x = F.when(F.col("c_custkey") % 5 == 0, " NaN ").when(F.col("c_custkey") % 5 == 1, "n/a").when(F.col("c_custkey") % 5 == 2, "None").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.null_to_empty(F.col("c_mktsegment")).alias("segment"), C.safe_str(x).alias("safe"))


@query(f"WITH {TRUTH} SELECT * FROM truth")
def ground_truth_exploded(spark, d):
    return _truth(spark, d)


@query(f"WITH {TRUTH} SELECT entity_id, name FROM ent WHERE entity_id IN (SELECT cand_id FROM truth)")
def semi_join_needed(spark, d):
    return tables.needed(_entities(spark, d), _truth(spark, d).select(F.col("cand_id").alias("entity_id"))).select("entity_id", "name")


@query("SELECT DISTINCT 'C' || c_custkey AS entity_id FROM customer UNION SELECT 'C' || o_custkey FROM orders")
def known_ids(spark, d):
    of = lambda t, k: spark.read.parquet(f"{d}/{t}.parquet").select(F.concat(F.lit("C"), F.col(k).cast("string")).alias("entity_id"))
    return tables.known_ids(of("customer", "c_custkey"), of("orders", "o_custkey"))


# ---- blocking normaliser
@query(f"WITH {DOC} SELECT entity_id, {_norm('name')} AS name_norm, {_norm('addr')} AS addr_norm, {_norm(_latin('name'))} AS name_latin FROM ent")
def norm_block(spark, d):
    return _documents(spark, d).select("entity_id", B.norm(F.col("name")).alias("name_norm"), B.norm(F.col("addr")).alias("addr_norm"), B.translit_norm(F.col("name")).alias("name_latin"))


@query(f"WITH {TOKD} SELECT entity_id, {_sorted('names')} AS tokens FROM tok")
def name_tokens(spark, d):
    return _listed(_documents(spark, d), tokens=B.name_tokens(F.col("name")))


@query(f"WITH {TOKD} SELECT entity_id, {_sorted('addrs')} AS tokens FROM tok")
def addr_tokens(spark, d):
    return _listed(_documents(spark, d), tokens=B.addr_tokens(F.col("addr")))


@query(rf"WITH p AS (SELECT page_id AS entity_id, list_filter(string_split({_norm('url')}, ' '), lambda t: length(t) >= 2 AND regexp_matches(t, '[0-9]')) AS nums FROM pages) SELECT entity_id, {_sorted('nums')} AS tokens FROM p")
def numeric_tokens(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumnRenamed("page_id", "entity_id")
    return _listed(pages, tokens=B.numeric_tokens(F.col("url")))


@query(f"WITH {DOC}, n AS (SELECT entity_id, replace({_norm('name')}, ' ', '') AS solid FROM ent) SELECT entity_id, CASE WHEN solid = '' THEN '' ELSE array_to_string(list_transform(range(1, greatest(1, length(solid) - 2) + 1), lambda i: substr(solid, i, 3)), ' ') END AS grams FROM n")
def char_trigrams(spark, d):
    return _documents(spark, d).select("entity_id", F.array_join(B.char_grams(F.col("name")), " ").alias("grams"))


@query(f"WITH {TOKD} SELECT entity_id, {_sorted('list_distinct(prefixes)')} AS prefixes FROM pre")
def name_prefixes(spark, d):
    return _listed(_documents(spark, d), prefixes=F.array_distinct(B.prefixes(B.name_tokens(F.col("name")))))


# ---- cleaner
_FLAT = "replace(replace(url || ' | ' || html, chr(10), ' '), chr(13), ' ')"


def _pages(spark, d):
    flat = F.replace(F.replace(F.concat("url", F.lit(" | "), "html"), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html", flat.alias("flat"))


@query(rf"SELECT page_id, regexp_replace({_FLAT}, '{V.URL}', '', 'g') AS text FROM pages")
def strip_urls(spark, d):
    return _pages(spark, d).select("page_id", C.strip_urls(F.col("flat")).alias("text"))


@query(rf"SELECT c_custkey, regexp_replace(x, '{V.PHONE}', '', 'g') AS text FROM (SELECT c_custkey, c_name || ' tel ' || (c_custkey * 7919 + 10000000) || ' no ' || c_custkey || ' 12-34 56.78-90' AS x FROM customer)")
def strip_phones(spark, d):
    x = F.concat("c_name", F.lit(" tel "), (F.col("c_custkey") * 7919 + 10000000).cast("string"), F.lit(" no "), F.col("c_custkey").cast("string"), F.lit(" 12-34 56.78-90"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.strip_phones(x).alias("text"))


@query(rf"SELECT page_id, regexp_replace(translate(url || replace(html, chr(10), ' '), '{V.BRACKETS}', ''), '\|[^\n]*$', '') AS text, translate({_FLAT}, '{V.BRACKETS}', '') AS bare FROM pages")
def strip_brackets_pipe(spark, d):
    x = F.concat("url", F.replace("html", F.lit("\n"), F.lit(" ")))
    return _pages(spark, d).select("page_id", C.strip_pipe(C.strip_brackets(x)).alias("text"), C.strip_brackets(F.col("flat")).alias("bare"))


@query("SELECT p_partkey, replace(replace(p_name || ' & ' || p_brand || '+' || p_type, '&', ' and '), '+', ' and ') AS text FROM part")
def conjunctions(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.conjunctions(F.concat("p_name", F.lit(" & "), "p_brand", F.lit("+"), "p_type")).alias("text"))


_LAST = ["corp", "inc.", "pvt", "limited", "co", "sarl", "gmbh", "works"]
_HEADS = ["llc", "sas", "alpha", "the"]


@query(f"""WITH n AS (SELECT s_suppkey, ({_case(dict(zip('0123', _HEADS)), "CAST(s_suppkey % 4 AS VARCHAR)")}) || ' ' || lower(s_name) || ' ' || ({_case(dict(zip('01234567', _LAST)), "CAST(s_suppkey % 8 AS VARCHAR)")}) AS x FROM supplier),
s AS (SELECT s_suppkey, string_split(regexp_replace(x, '#', ' ', 'g'), ' ') AS w FROM n),
k AS (SELECT s_suppkey, w, {_case(V.LEGAL_SUFFIXES, 'w[-1]')} AS tail, CASE WHEN w[1] IN {_in(V.LEGAL_PREFIXES)} THEN coalesce({_case(V.LEGAL_SUFFIXES, 'w[1]')}, w[1]) END AS head FROM s)
SELECT s_suppkey, array_to_string(w[CASE WHEN head IS NULL THEN 1 ELSE 2 END : CASE WHEN tail IS NULL THEN len(w) ELSE len(w) - 1 END], ' ') AS core, concat_ws(' ', tail, CASE WHEN head = tail THEN NULL ELSE head END) AS suffix FROM k""")
def legal_suffix(spark, d):
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), (F.col("s_suppkey") % k).cast("int"))
    x = F.concat_ws(" ", pick(_HEADS, 4), F.lower("s_name"), pick(_LAST, 8))
    df = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.split(F.replace(x, F.lit("#"), F.lit(" ")), " ").alias("w"))
    return df.select("s_suppkey", C.legal_parts(F.col("w")).alias("p")).select("s_suppkey", F.array_join("p.core", " ").alias("core"), F.col("p.suffix").alias("suffix"))


_ROADS = ["st", "ave,", "blvd.", "rd", "pkwy", "lane", "ste", "fl."]


@query(f"""WITH a AS (SELECT c_custkey, string_split(c_custkey || ' Main ' || ({_case(dict(zip('01234567', _ROADS)), "CAST(c_custkey % 8 AS VARCHAR)")}) || ' ' || c_mktsegment, ' ') AS w FROM customer)
SELECT c_custkey, array_to_string(list_transform(w, lambda t: coalesce(({_case(V.STREETS, "lower(rtrim(t, ','))")}) || CASE WHEN t LIKE '%,' THEN ',' ELSE '' END, t)), ' ') AS text FROM a""")
def street_expand(spark, d):
    road = F.get(F.array(*map(F.lit, _ROADS)), (F.col("c_custkey") % 8).cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.expand_streets(F.concat_ws(" ", F.col("c_custkey").cast("string"), F.lit("Main"), road, "c_mktsegment")).alias("text"))


_PLACES = [("us", "Texas"), ("us", "wa"), ("india", "UP"), ("india", "orissa"), ("france", "idf"), ("france", "Texas"), ("peru", "lima"), ("india", "Tamilnadu")]


@query(f"""WITH p AS (SELECT c_custkey, {_case({str(k): c for k, (c, _) in enumerate(_PLACES)}, 'CAST(c_custkey % 8 AS VARCHAR)')} AS country, {_case({str(k): s for k, (_, s) in enumerate(_PLACES)}, 'CAST(c_custkey % 8 AS VARCHAR)')} AS state FROM customer)
SELECT c_custkey, country, coalesce(CASE country WHEN 'us' THEN {_case(V.STATES['us'], 'lower(trim(state))')} WHEN 'india' THEN {_case(V.STATES['india'], 'lower(trim(state))')} WHEN 'france' THEN {_case(V.STATES['france'], 'lower(trim(state))')} END, '') AS canonical FROM p""")
def state_canon(spark, d):
    k = (F.col("c_custkey") % 8).cast("int")
    country, state = (F.get(F.array(*[F.lit(p[i]) for p in _PLACES]), k) for i in (0, 1))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", country.alias("country"), F.coalesce(C.state_of(state, country), F.lit("")).alias("canonical"))


_CODES = {"us": "12 main street, seattle wa 98101-1234", "india": "plot 7, pune 411001 mh", "france": "3 rue x, 75001 paris"}


@query(f"""WITH p AS (SELECT c_custkey, k, replace({_case(_CODES, 'k')}, '1', CAST(c_custkey % 10 AS VARCHAR)) AS x FROM (SELECT c_custkey, ['us', 'india', 'france'][c_custkey % 3 + 1] AS k FROM customer))
SELECT c_custkey, CASE WHEN k = 'us' THEN regexp_extract(x, '{V.ZIP_US}', 2) WHEN k = 'france' THEN regexp_extract(x, '{V.POSTAL_FRANCE}', 2) WHEN regexp_extract(x, '{V.PIN_INDIA}', 1) LIKE '0%' THEN '' ELSE regexp_extract(x, '{V.PIN_INDIA}', 1) END AS code,
  CASE WHEN k = 'us' THEN regexp_replace(x, '{V.ZIP_US}', '\\1, ') WHEN k = 'france' THEN regexp_replace(x, '{V.POSTAL_FRANCE}', '\\1, ') WHEN regexp_extract(x, '{V.PIN_INDIA}', 1) LIKE '0%' THEN x ELSE regexp_replace(x, '{V.PIN_INDIA}', '') END AS rest FROM p""".replace("\\\\1", "\\1"))
def postal_code(spark, d):
    land = F.get(F.array(*[F.lit(k) for k in _CODES]), (F.col("c_custkey") % 3).cast("int"))
    x = F.replace(F.get(F.array(*[F.lit(v) for v in _CODES.values()]), (F.col("c_custkey") % 3).cast("int")), F.lit("1"), (F.col("c_custkey") % 10).cast("string"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.postal_split(x, land).alias("p")).select("c_custkey", "p.code", "p.rest")


#: Raw customers by country, and what is left of them when they are clean.
_RAW = {
    "us": ("The {name} Inc.", "{k} Main St, Suite 4, Seattle, WA 9{code4}", "{core} inc.", "{core}", "inc", "{k} main street, suite 4", "seattle", "wa", "9{code4}"),
    "India": ("Smt {name} Pvt. Ltd.", "Plot No. {k}, Link Rd, Pune, Maharashtra 41{code4}", "{core} pvt. ltd.", "{core}", "pvt ltd", "{k}, link road", "pune", "maharashtra", "41{code4}"),
    "France": ("SARL {name}", "{k} Rue de l'Île, 7{code4} Orléans, Ile-de-France", "sarl {core}", "{core}", "sarl", "{k} rue de l ile", "orleans", "ile-de-france", "7{code4}"),
}
_RAW_LANDS = list(_RAW)


def _raw_sql(i: int) -> str:
    parts = lambda text: " || ".join(f"'{p}'" if not p.startswith("{") else {"{name}": "name", "{core}": "lower(name)", "{k}": "c_custkey", "{code4}": "lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"}[p] for p in re.split(r"(\{\w+\})", text.replace("'", "''")) if p)
    return f"CASE c_custkey % 3 " + " ".join(f"WHEN {k} THEN {parts(v[i])}" for k, v in enumerate(_RAW.values())) + " END"


_CLEAN_SQL = f"""WITH c AS (SELECT c_custkey, replace(c_name, '#', ' No') AS name FROM customer),
cl AS (SELECT 'S1-' || c_custkey AS entity_id, lower(({_case(dict(zip('012', _RAW_LANDS)), "CAST(c_custkey % 3 AS VARCHAR)")})) AS country, {_raw_sql(0)} AS business_name, {_raw_sql(1)} AS business_address, {_raw_sql(2)} AS name_clean, {_raw_sql(3)} AS name_core, {_raw_sql(4)} AS legal_suffix,
  {_raw_sql(5)} AS addr_clean, {_raw_sql(6)} AS addr_city, {_raw_sql(7)} AS addr_state, {_raw_sql(8)} AS addr_postal_code FROM c)"""


def _raw(spark, d):
    k = F.col("c_custkey")
    known = {"{name}": F.replace("c_name", F.lit("#"), F.lit(" No")), "{k}": k.cast("string"), "{code4}": F.lpad((k % 10000).cast("string"), 4, "0")}
    text = lambda i: F.get(F.array(*[F.concat(*[known.get(p, F.lit(p)) for p in re.split(r"(\{\w+\})", v[i]) if p]) for v in _RAW.values()]), (k % 3).cast("int"))
    land = F.get(F.array(*map(F.lit, _RAW_LANDS)), (k % 3).cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("S1-"), k.cast("string")).alias("entity_id"), text(0).alias("business_name"), text(1).alias("business_address"), land.alias("country"))


@query(f"{_CLEAN_SQL} SELECT * FROM cl")
def preprocess(spark, d):
    return C.preprocess(_raw(spark, d)).drop("name_original", "name_translit", "addr_original", "addr_translit")


@query(f"{_CLEAN_SQL} SELECT entity_id, country, addr_postal_code AS postal_code, addr_city || '_' || addr_state AS city_state, string_split(name_core, ' ')[1] AS name_first_token FROM cl")
def blocking_keys(spark, d):
    return C.blocking_keys(C.preprocess(_raw(spark, d)))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(" + _latin("text") + r"), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS latin FROM documents")
def transliterate_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", squeeze(transliterate(F.col("text"))).alias("latin"))


# ---- files: written as TSV, read by the scans
def _written(df, writer=sinks.write_lists):
    path = sinks.shared_path(df.sparkSession)
    writer(df, path)
    return path


_RAWNULL = "CASE c_custkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN 'N/A' WHEN 2 THEN 'he said \"x' ELSE c_name END"


@query(f"SELECT 'S1-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS entity_id, CASE WHEN x IN ('null', 'N/A') THEN '' ELSE x END AS name, c_mktsegment AS addr, '' AS country FROM (SELECT *, {_RAWNULL} AS x FROM customer)")
def scan_raw_files(spark, d):
    k = F.col("c_custkey")
    x = F.when(k % 7 == 0, "null").when(k % 7 == 1, "N/A").when(k % 7 == 2, 'he said "x').otherwise(F.col("c_name"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("S1-"), F.lpad(k.cast("string"), 6, "0")).alias("entity_id"), x.alias("business_name"), F.col("c_mktsegment").alias("business_address"), F.lit("NaN").alias("country"))
    return tables.load_matching(spark, _written(rows))


_LISTS = "SELECT 'S1-' || o_custkey AS s1_id, string_agg('S2-' || (o_orderkey % 40), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1"


def _id_lists(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda o: F.concat(F.lit("S2-"), (o % 40).cast("string"))), ",")
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("s1_id")).agg(ids.alias("ids"))


@query(f"WITH l AS ({_LISTS}) SELECT DISTINCT s1_id, unnest(string_split(ids, ',')) AS cand_id FROM l")
def scan_truth_files(spark, d):
    return tables.pairs_of(tables.load_ground_truth(spark, _written(_id_lists(spark, d))))


@query(f"WITH l AS ({_LISTS}), p AS (SELECT s1_id, string_split(ids, ',') AS c FROM l) SELECT s1_id, CAST(k AS INT) AS position, c[k + 1] AS cand_id FROM (SELECT s1_id, c, unnest(range(len(c))) AS k FROM p)")
def scan_list_files(spark, d):
    return tables.load_lists(spark, _written(_id_lists(spark, d)))


@query(f"{_CLEAN_SQL} SELECT entity_id, name_core, addr_city, addr_postal_code FROM cl")
def scan_clean_files(spark, d):
    return tables.load_clean(spark, _written(C.preprocess(_raw(spark, d)), sinks.write_clean), ["entity_id", "name_core", "addr_city", "addr_postal_code"])


# ---- matching normaliser
def _mname(x: str) -> str:
    text = rf"regexp_replace(regexp_replace(replace(replace(lower({x}), '&', ' and '), '+', ' and '), '{V.MATCH_URL}', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    end = rf"regexp_replace({{}}, '\s+$', '')"
    cut = "CASE " + " ".join(f"WHEN ends_with(e, '{s}') THEN substr(e, 1, length(e) - {len(s)})" for s in V.MATCH_SUFFIXES) + " ELSE t END"
    head = "CASE " + " ".join(f"WHEN starts_with(b, '{p}') THEN substr(b, {len(p) + 1})" for p in V.MATCH_PREFIXES) + " ELSE u END"
    return rf"(SELECT trim(regexp_replace({head}, '\s+', ' ', 'g')) FROM (SELECT u, regexp_replace(u, '^\s+', '') AS b FROM (SELECT {cut} AS u FROM (SELECT t, {end.format('t')} AS e FROM (SELECT {text} AS t)))))"


def _maddr(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


_ASCII = rf"trim(regexp_replace(regexp_replace(strip_accents(n), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH {DOC}, m AS (SELECT entity_id, {_mname('name')} AS n FROM ent) SELECT entity_id, n AS name_norm, {_ASCII} AS name_ascii FROM m")
def match_name_norm(spark, d):
    df = _documents(spark, d).select("entity_id", M.match_name(F.col("name")).alias("name_norm"))
    return df.withColumn("name_ascii", M.match_name_ascii(F.col("name_norm")))


@query(f"WITH {DOC}, m AS (SELECT entity_id, {_maddr('addr')} AS a FROM ent) SELECT entity_id, a AS addr_norm, array_to_string(list_transform(list_filter(string_split(a, ' '), lambda t: t <> ''), lambda t: coalesce({_case(V.MATCH_STREETS, 't')}, t)), ' ') AS expanded FROM m")
def match_addr_norm(spark, d):
    df = _documents(spark, d).select("entity_id", M.match_address(F.col("addr")).alias("addr_norm"))
    return df.withColumn("expanded", M.expand_address(F.col("addr_norm"), F.lit("us")))


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(url, '[^\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[0-9]+')))), ' ') AS numbers FROM pages")
def numbers_set(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.array_join(F.array_sort(M.numbers(F.col("url"))), " ").alias("numbers"))


# ---- document frequency and scores
@query(f"WITH {POST} SELECT country, channel, token, df FROM df")
def token_df(spark, d):
    return blocking.document_frequency(blocking.token_table(_sources(spark, d)[1]))


@query(f"WITH {POST} SELECT country, channel, token, df FROM df WHERE df <= {_CAPS}")
def token_df_capped(spark, d, p=FULL):
    return blocking.capped(blocking.document_frequency(blocking.token_table(_sources(spark, d)[1])), p)


@query(f"WITH {POST} SELECT country, token, df FROM df WHERE channel = 'name' AND df <= @rare@")
def rare_tokens(spark, d, p=FULL):
    return blocking.document_frequency(blocking.token_table(_sources(spark, d)[1])).where((F.col("channel") == "name") & (F.col("df") <= p.rare)).select("country", "token", "df")


def _scores(spark, d, p=FULL):
    return blocking.pair_scores(*_sources(spark, d), p)


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, sa, hits FROM scored WHERE sa > 0")
def score_name(spark, d, p=FULL):
    return _scores(spark, d, p).where("sa > 0").select("s1_id", "cand_id", "sa", "hits")


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, sb, postal FROM scored WHERE sb > 0")
def score_addr_postal(spark, d, p=FULL):
    return _scores(spark, d, p).where("sb > 0").select("s1_id", "cand_id", "sb", "postal")


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, CAST(sum(n) AS BIGINT) AS n FROM hit WHERE channel = 'prefix' GROUP BY s1_id, cand_id")
def score_prefix(spark, d, p=FULL):
    q, t = _sources(spark, d)
    keys = ["country", "channel", "token"]
    posts = blocking.token_table(t).where("channel = 'prefix'")
    kept = posts.join(blocking.capped(blocking.document_frequency(posts), p), keys).select(*keys, F.col("entity_id").alias("cand_id"), F.col("tf").alias("t_tf"))
    asked = blocking.token_table(q, query=True).where("channel = 'prefix'").withColumnRenamed("entity_id", "s1_id")
    return asked.join(kept, keys).groupBy("s1_id", "cand_id").agg(F.sum(F.col("tf") * F.col("t_tf")).alias("n"))


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, composite, score FROM scored")
def score_composite(spark, d, p=FULL):
    return _scores(spark, d, p).select("s1_id", "cand_id", F.col("composite").cast("long").alias("composite"), F.col("score").cast("long").alias("score"))


@query(f"WITH {FALL} SELECT s1_id, cand_id, CAST(gram_score AS BIGINT) AS gram_score FROM fall")
def fallback_trigrams(spark, d, p=FULL):
    q, t = _sources(spark, d)
    return blocking.fallback(q, t, blocking.pair_scores(q, t, p), p).select("s1_id", "cand_id", F.col("gram_score").cast("long").alias("gram_score"))


@query(f"WITH {BUDGET} SELECT s1_id, cand_id, source, score, budget FROM cand")
def budget_topk(spark, d, p=FULL):
    return _candidates(spark, d, p).select("s1_id", "cand_id", "source", "score", F.col("budget").cast("long").alias("budget"))


@query(f"""WITH {BUDGET} SELECT ent.entity_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY CASE WHEN source = 'S3' THEN -CAST(substr(cand_id, 4) AS BIGINT) ELSE CAST(substr(cand_id, 4) AS BIGINT) END), '') AS candidate_entity_ids
FROM ent LEFT JOIN cand ON entity_id = s1_id WHERE entity_id LIKE 'S1-%' GROUP BY entity_id""")
def candidate_lists(spark, d, p=FULL):
    return blocking.candidate_lists(_sources(spark, d)[0], _candidates(spark, d, p))


# ---- features over the candidates
def _sides(spark, d):
    """Normalised queries and targets, stored; small ones are broadcast, so that no pair is shuffled with its texts."""
    return [sinks.small(stored(S.normalised(x))) for x in _sources(spark, d)]


def _features(spark, d, p=FULL):
    return S.pair_features(_candidates(spark, d, p).select("s1_id", "cand_id"), *_sides(spark, d))


def _split(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


_EXPANDED = f"""array_to_string(list_transform(list_filter(string_split_regex(addr, '\\s+'), lambda t: t <> ''), lambda t: coalesce(
    CASE WHEN lower(country) IN ('us', 'france', '') THEN {_case(V.MATCH_STREETS, "regexp_replace(lower(t), '[.]+$', '')")} END, CASE WHEN lower(country) IN ('india', '') THEN {_case(V.MATCH_INDIA, "regexp_replace(lower(t), '[.]+$', '')")} END, t)), ' ')"""
_FIVE, _SIX = (rf"regexp_extract(addr, '\b([0-9]{{{n}}})\b', 1)" for n in (5, 6))
NORMED = f"""{BUDGET},
n0 AS (SELECT entity_id, addr AS raw, lower(trim(country)) AS land, {_mname('name')} AS n, {_maddr('addr')} AS a, {_maddr(_EXPANDED)} AS x,
  CASE WHEN lower(country) IN ('us', 'france') THEN {_FIVE} WHEN lower(country) = 'india' THEN {_SIX} WHEN {_FIVE} <> '' THEN {_FIVE} ELSE {_SIX} END AS post FROM ent),
nrm AS (SELECT *, {_ASCII} AS g, {_split('n')} AS w, {_split('x')} AS aw FROM n0),
fp AS (SELECT c.s1_id, c.cand_id, x.n AS n1, y.n AS n2, x.g AS g1, y.g AS g2, x.a AS a1, y.a AS a2, x.x AS x1, y.x AS x2, x.w AS w1, y.w AS w2, x.aw AS aw1, y.aw AS aw2, x.raw AS r1, y.raw AS r2, x.land AS land1, y.land AS land2, x.post AS p1, y.post AS p2
  FROM cand c JOIN nrm x ON x.entity_id = c.s1_id JOIN nrm y ON y.entity_id = c.cand_id)"""


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct({a}), list_distinct({b}))) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"


def _con(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct({a}), list_distinct({b}))) AS DOUBLE) / least(len(list_distinct({a})), len(list_distinct({b}))) END"


def _len(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE CAST(least(length({a}), length({b})) AS DOUBLE) / greatest(length({a}), length({b})) END"


#: DuckDB compares bytes: each accented letter gets one ASCII sign of its own, which changes no equality.
def _jw(a: str, b: str) -> str:
    one = lambda x: f"translate({x}, 'áàâäãåçéèêëíìîïñóòôöõúùûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({one(a)}, {one(b)}) END"


def _lcs(a: str, b: str) -> str:
    """The longest common subsequence of strings of at most 126 characters, bit-parallel over a 128-bit row."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    marks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(length({a})), lambda k: CASE WHEN substr({a}, k + 1, 1) = c THEN CAST(1 AS HUGEINT) << CAST(k AS INT) ELSE CAST(0 AS HUGEINT) END)))"
    row = f"list_reduce(list_prepend({full}, {marks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({row}) END"


def _ratio(lcs: str, a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * {lcs} / (length({a}) + length({b})) END"


def _codes(g: str) -> str:
    """Distinct Soundex codes of a text's words of two letters and more."""
    word = f"list_filter(list_transform(string_split({g}, ' '), lambda t: regexp_replace(t, '[^a-z]', '', 'g')), lambda t: length(t) >= 2)"
    digits = "translate(substr(t, 1, 1) || regexp_replace(substr(t, 2), '[hw]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202')"
    for k in "123456":
        digits = f"regexp_replace({digits}, '{k}+', '{k}', 'g')"
    return f"list_distinct(list_transform({word}, lambda t: upper(substr(t, 1, 1)) || rpad(substr(replace(substr({digits}, 2), '0', ''), 1, 3), 3, '0')))"


_NUMS = r"list_distinct(list_filter(string_split_regex({}, '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[0-9]+')))"
_joined = lambda words: f"array_to_string(list_sort({words}), ' ')"
FEATS = f"""{NORMED},
f1 AS (SELECT *, {_jw('n1', 'n2')} AS jw, {_jw('x1', 'x2')} AS aw, {_joined('w1')} AS s1, {_joined('w2')} AS s2, {_joined('aw1')} AS t1, {_joined('aw2')} AS t2, length(array_to_string(list_distinct(list_intersect(w1, w2)), ' ')) AS common,
  {_joined('list_distinct(list_filter(w1, lambda t: NOT list_contains(w2, t)))')} AS o1, {_joined('list_distinct(list_filter(w2, lambda t: NOT list_contains(w1, t)))')} AS o2 FROM fp),
f2 AS (SELECT *, jw < {V.SHORT_CIRCUIT} AND aw < {V.SHORT_CIRCUIT} AS short, {_lcs('n1', 'n2')} AS l_name, {_lcs('s1', 's2')} AS l_sort, {_lcs('o1', 'o2')} AS l_set, {_lcs('t1', 't2')} AS l_addr, CAST(common > 0 AS INT) AS gap FROM f1),
f3 AS (SELECT *, {_ratio('l_sort', 's1', 's2')} AS nsort, {_ratio('l_addr', 't1', 't2')} AS asort, common + gap + length(o1) AS n_left, common + gap + length(o2) AS n_right, length(o1) + length(o2) - 2 * l_set AS indel FROM f2),
f4 AS (SELECT s1_id, cand_id, short, jw AS name_jaro_winkler, {_ratio('l_name', 'n1', 'n2')} AS name_levenshtein, {_jac('w1', 'w2')} AS name_jaccard, nsort AS name_token_sort,
  CASE WHEN len(w1) = 0 OR len(w2) = 0 THEN 0.0 WHEN common > 0 AND (o1 = '' OR o2 = '') THEN 1.0 WHEN common > 0 THEN greatest(1 - CAST(indel AS DOUBLE) / (n_left + n_right), 1 - CAST(gap + length(o1) AS DOUBLE) / (common + n_left), 1 - CAST(gap + length(o2) AS DOUBLE) / (common + n_right))
    ELSE 1 - CAST(indel AS DOUBLE) / (n_left + n_right) END AS name_token_set,
  {_con('w1', 'w2')} AS name_containment, CAST(n1 = n2 AND n1 <> '' AS INT) AS name_exact, {_len('n1', 'n2')} AS name_length_ratio, {_jw('g1', 'g2')} AS name_aggressive_jw, {_jac(_codes('g1'), _codes('g2'))} AS name_soundex_overlap,
  aw AS addr_jaro_winkler, {_jac('aw1', 'aw2')} AS addr_jaccard, asort AS addr_token_sort, {_jac(_NUMS.format('r1'), _NUMS.format('r2'))} AS addr_number_overlap, CASE WHEN short OR (p1 = '' AND p2 = '') THEN 0.5 WHEN p1 = p2 THEN 1.0 ELSE 0.0 END AS addr_postal_match,
  {_len('x1', 'x2')} AS addr_length_ratio, {_con('aw1', 'aw2')} AS addr_containment, CAST(a1 = '' OR a2 = '' AS INT) AS addr_any_empty, CAST(land1 = land2 AND land1 <> '' AS INT) AS country_match, CAST(cand_id NOT LIKE 'S2%' AS INT) AS source_type,
  sqrt(jw * aw) AS geo_mean_name_addr, CASE WHEN short THEN least(jw, aw) ELSE least(nsort, asort) END AS min_name_addr_sim, CASE WHEN short THEN greatest(jw, aw) ELSE greatest(nsort, asort) END AS max_name_addr_sim FROM f3)"""
#: What pairs that are far apart in name and address still have.
_FAR = ["name_jaro_winkler", "addr_jaro_winkler", "addr_postal_match", "addr_any_empty", "country_match", "source_type", "geo_mean_name_addr", "min_name_addr_sim", "max_name_addr_sim"]
_SHOWN = ", ".join(f"round(CAST(CAST({f if f in _FAR else f'CASE WHEN short THEN 0.0 ELSE {f} END'} AS FLOAT) AS DOUBLE), 5) AS {f}" for f in V.FEATURES)


def _five(feature: str):
    """Five decimals, half up, as ``round`` has them, without its decimals of any size: a float's product with 100,000 is exact in a double, and the ties that are floats are exact."""
    return F.floor(F.col(feature).cast("double") * 100_000 + 0.5) / 100_000


@query(f"WITH {FEATS} SELECT s1_id, cand_id, {_SHOWN} FROM f4")
def pair_features(spark, d, p=FULL):
    return _features(spark, d, p).select("s1_id", "cand_id", *[_five(f).alias(f) for f in V.FEATURES])


# ---- evaluation, with the score as a stand-in probability
_PROB = "least(score, 100) / 100.0"
EVAL = f"""{BUDGET},
truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM ent a JOIN ent b ON a.country = b.country AND {_norm('a.name')} = {_norm('b.name')} WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'),
s1 AS (SELECT entity_id AS s1_id FROM ent WHERE entity_id LIKE 'S1-%'),
nt AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY s1_id)"""


def _f05(tp: str, p: str, t: str) -> str:
    return f"CASE WHEN {p} = 0 AND {t} = 0 THEN 1.0 WHEN {p} = 0 OR {t} = 0 OR {tp} = 0 THEN 0.0 ELSE 1.25 * (CAST({tp} AS DOUBLE) / {p}) * (CAST({tp} AS DOUBLE) / {t}) / (0.25 * (CAST({tp} AS DOUBLE) / {p}) + CAST({tp} AS DOUBLE) / {t}) END"


BY = f"""{EVAL},
pr AS (SELECT s1_id, count(*) AS n_pred, count(truth.s1_id) AS tp FROM (SELECT s1_id, cand_id FROM cand WHERE score >= 50) c LEFT JOIN truth USING (s1_id, cand_id) GROUP BY s1_id),
by_e AS (SELECT s1_id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM s1 LEFT JOIN nt USING (s1_id) LEFT JOIN pr USING (s1_id)),
fe AS (SELECT *, {_f05('tp', 'n_pred', 'n_true')} AS f05 FROM by_e)"""
BY = BY.replace("count(truth.s1_id) AS tp", "count(hit_id) AS tp").replace("LEFT JOIN truth USING (s1_id, cand_id) GROUP BY", "LEFT JOIN (SELECT *, cand_id AS hit_id FROM truth) USING (s1_id, cand_id) GROUP BY")


def _by_entity(spark, d, p=FULL):
    ids = _sources(spark, d)[0].select(F.col("entity_id").alias("s1_id"))
    return evaluate.f05_by_entity(ids, _candidates(spark, d, p).where("score >= 50"), _truth(spark, d))


@query(f"WITH {BY} SELECT s1_id, n_true, n_pred, tp, round(f05, 6) AS f05 FROM fe")
def f05_entity(spark, d, p=FULL):
    return _by_entity(spark, d, p).withColumn("f05", F.round("f05", 6))


@query(f"WITH {BY} SELECT count(*) AS entities, round(avg(f05), 6) AS macro_f05 FROM fe")
def f05_macro(spark, d, p=FULL):
    return evaluate.macro(_by_entity(spark, d, p)).withColumn("macro_f05", F.round("macro_f05", 6))


SWEEP = f"""{EVAL},
th AS (SELECT unnest({evaluate.COARSE}) AS percent),
pp AS (SELECT s1_id, percent, count(*) AS n_pred, count(hit_id) AS tp FROM (SELECT s1_id, cand_id, {_PROB} AS p FROM cand) c JOIN th ON p >= percent / 100.0 LEFT JOIN (SELECT *, cand_id AS hit_id FROM truth) USING (s1_id, cand_id) GROUP BY s1_id, percent),
sw AS (SELECT percent, avg({_f05('coalesce(tp, 0)', 'coalesce(n_pred, 0)', 'coalesce(n_true, 0)')}) AS macro_f05, CAST(sum(coalesce(n_pred, 0)) AS BIGINT) AS n_pred FROM s1 CROSS JOIN th LEFT JOIN nt USING (s1_id) LEFT JOIN pp USING (s1_id, percent) GROUP BY percent)"""


def _sweep(spark, d, p=FULL):
    scored = _candidates(spark, d, p).select("s1_id", "cand_id", (F.least("score", F.lit(100)) / 100.0).alias("probability"))
    return evaluate.threshold_sweep(_sources(spark, d)[0].select(F.col("entity_id").alias("s1_id")), scored, _truth(spark, d), evaluate.COARSE)


@query(f"WITH {SWEEP} SELECT percent, round(macro_f05, 6) AS macro_f05, n_pred FROM sw")
def threshold_sweep(spark, d, p=FULL):
    return _sweep(spark, d, p).withColumn("macro_f05", F.round("macro_f05", 6))


@query(f"WITH {SWEEP} SELECT percent, round(macro_f05, 6) AS macro_f05 FROM sw ORDER BY round(sw.macro_f05, 9) DESC, percent LIMIT 1")
def threshold_best(spark, d, p=FULL):
    return evaluate.best_threshold(_sweep(spark, d, p)).select("percent", F.round("macro_f05", 6).alias("macro_f05"))


@query(f"WITH {EVAL}, t AS (SELECT s1_id, count(cand_id) AS n FROM s1 LEFT JOIN (SELECT * FROM cand WHERE score >= 50) USING (s1_id) GROUP BY s1_id) SELECT count(*) AS entities, CAST(sum(n) AS BIGINT) AS matches, round(avg(n), 6) AS per_entity FROM t")
def match_totals(spark, d, p=FULL):
    ids = _sources(spark, d)[0].select(F.col("entity_id").alias("s1_id"))
    return evaluate.match_totals(ids, _candidates(spark, d, p).where("score >= 50")).withColumn("per_entity", F.round("per_entity", 6))


_BEST = f"(SELECT percent FROM sw WHERE percent IN {tuple(evaluate.COARSE)} ORDER BY round(macro_f05, 9) DESC, percent LIMIT 1)"


@query(f"""WITH {SWEEP.replace(f'unnest({evaluate.COARSE})', 'unnest(range(5, 96))')}, near AS (SELECT * FROM sw WHERE percent IN {tuple(evaluate.COARSE)} OR abs(percent - {_BEST}) <= 8),
fine AS (SELECT percent, macro_f05 FROM near WHERE percent NOT IN {tuple(evaluate.COARSE)} ORDER BY round(macro_f05, 9) DESC, percent LIMIT 1),
best AS (SELECT coalesce((SELECT f.percent FROM fine f, sw WHERE sw.percent = {_BEST} AND round(f.macro_f05, 9) > round(sw.macro_f05, 9)), {_BEST}) AS percent)
SELECT near.percent, round(macro_f05, 6) AS macro_f05, n_pred, near.percent = best.percent AS chosen FROM near, best""")
def threshold_optimum(spark, d, p=FULL):
    scored = _candidates(spark, d, p).select("s1_id", "cand_id", (F.least("score", F.lit(100)) / 100.0).alias("probability"))
    percent, sweeps = evaluate.optimise_threshold(_sources(spark, d)[0].select(F.col("entity_id").alias("s1_id")), stored(scored), _truth(spark, d))
    return sweeps.select("percent", F.round("macro_f05", 6).alias("macro_f05"), "n_pred", (F.col("percent") == percent).alias("chosen"))


@query(f"WITH {BY} SELECT round(avg(f05) FILTER (WHERE n_true = 0), 6) AS single_mean, round(avg(f05) FILTER (WHERE n_true > 0), 6) AS matched_mean, round(quantile_cont(f05, 0.25), 6) AS p25, round(quantile_cont(f05, 0.5), 6) AS median, round(quantile_cont(f05, 0.75), 6) AS p75, count(*) FILTER (WHERE f05 = 1) AS perfect, count(*) FILTER (WHERE f05 = 0) AS zero FROM fe")
def score_percentiles(spark, d, p=FULL):
    df = evaluate.score_distribution(_by_entity(spark, d, p))
    return df.select(*[F.round(c, 6).alias(c) for c in ("single_mean", "matched_mean", "p25", "median", "p75")], "perfect", "zero")


@query(f"WITH {EVAL} SELECT substr(cand_id, 1, 2) AS source, count(*) AS n_true, count(hit_id) AS n_found, round(count(hit_id) / count(*), 6) AS recall FROM truth LEFT JOIN (SELECT s1_id, cand_id, cand_id AS hit_id FROM cand) USING (s1_id, cand_id) GROUP BY 1")
def recall_by_source(spark, d, p=FULL):
    return evaluate.recall_by_source(_candidates(spark, d, p), _truth(spark, d)).withColumn("recall", F.round("recall", 6))


@query(f"WITH {EVAL} SELECT CASE WHEN composite > 0 THEN 'C' WHEN sa > 0 THEN 'A' WHEN sb > 0 THEN 'B' ELSE 'D' END AS channel, count(*) AS n FROM cand SEMI JOIN truth USING (s1_id, cand_id) GROUP BY 1")
def attribution(spark, d, p=FULL):
    return evaluate.attribution(_candidates(spark, d, p), _truth(spark, d))


@query(f"""WITH {BUDGET}, nc AS (SELECT entity_id, country, count(cand_id) AS n, count(*) FILTER (WHERE source = 'S2') AS n2 FROM ent LEFT JOIN cand ON entity_id = s1_id WHERE entity_id LIKE 'S1-%' GROUP BY ALL)
SELECT country, count(*) AS queries, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(n2) AS BIGINT) AS from_s2, count(*) FILTER (WHERE n = 0) AS without, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most FROM nc GROUP BY ROLLUP (country)""")
def candidate_report(spark, d, p=FULL):
    df = evaluate.candidate_report(_sources(spark, d)[0], _candidates(spark, d, p))
    return df.withColumns({c: F.round(c, 6) for c in ("median", "p90", "p95", "p99")})


@query("SELECT CAST(count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS negatives, CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS positives, round(count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1), 6) AS scale_pos_weight FROM labels")
def class_weight(spark, d):
    df = evaluate.class_weight(spark.read.parquet(f"{d}/labels.parquet").select(F.col("toxic").alias("label")))
    return df.select("negatives", "positives", F.round("scale_pos_weight", 6).alias("scale_pos_weight"))


# ---- splits and samples
@query(f"WITH {ENT} SELECT country, count(*) AS n FROM ent WHERE entity_id LIKE 'S1-%' GROUP BY country")
def country_counts(spark, d):
    return _sources(spark, d)[0].groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENT} SELECT entity_id, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY entity_id) AS k FROM ent WHERE entity_id LIKE 'S1-%') WHERE k <= 5")
def sample_per_country(spark, d):
    return sampling.per_country(_sources(spark, d)[0].select("entity_id", "country"), 5)


@query(f"""WITH {TRUTH}, c AS (SELECT s1_id, count(DISTINCT cand_id) AS n FROM truth GROUP BY s1_id),
b AS (SELECT entity_id, country, CASE WHEN coalesce(n, 0) = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' ELSE '6+' END AS bucket FROM ent LEFT JOIN c ON s1_id = entity_id WHERE entity_id LIKE 'S1-%')
SELECT entity_id, country, bucket, row_number() OVER (PARTITION BY country, bucket ORDER BY md5(entity_id || '|42'), entity_id) <= floor(count(*) OVER (PARTITION BY country, bucket) * 0.15 + 0.5) AS validation FROM b""")
def stratified_split(spark, d):
    return sampling.stratified_split(_sources(spark, d)[0], _truth(spark, d))


@query(f"""WITH {EVAL}, l AS (SELECT s1_id, cand_id, CAST(hit_id IS NOT NULL AS INT) AS label FROM cand LEFT JOIN (SELECT *, cand_id AS hit_id FROM truth) USING (s1_id, cand_id))
SELECT s1_id, cand_id, label FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, label ORDER BY md5(s1_id || '|' || cand_id || '|42'), cand_id) AS k FROM l) WHERE label = 1 OR k <= 60""")
def hard_negatives(spark, d, p=FULL):
    return sampling.hard_negatives(_candidates(spark, d, p), _truth(spark, d), 60).select("s1_id", "cand_id", "label")


@query(f"""WITH {TRUTH}, tr AS (SELECT DISTINCT s1_id, cand_id FROM truth),
pool AS (SELECT country, substr(entity_id, 1, 2) AS source, entity_id AS cand_id, row_number() OVER (PARTITION BY country, substr(entity_id, 1, 2) ORDER BY substr(md5(entity_id), 1, 2), entity_id) - 1 AS place FROM ent WHERE entity_id NOT LIKE 'S1-%'),
sizes AS (SELECT country, source, count(*) AS n_all FROM pool GROUP BY ALL), nt AS (SELECT s1_id, count(*) AS n_true FROM tr GROUP BY 1),
wanted AS (SELECT entity_id AS s1_id, country, coalesce(n_true, 0) AS n_true, greatest(coalesce(n_true, 0), 1) * 4 AS need FROM ent LEFT JOIN nt ON s1_id = entity_id WHERE entity_id LIKE 'S1-%'),
asked AS (SELECT *, unnest(range(least(n_all, need + n_true))) AS j, least(n_all, need + n_true) AS draws FROM wanted JOIN sizes USING (country)),
drawn AS (SELECT s1_id, source, need, cand_id FROM (SELECT *, (j * n_all) // draws + CAST('0x' || substr(md5(s1_id || '|' || source || '|' || j || '|42'), 1, 8) AS BIGINT) % (((j + 1) * n_all) // draws - (j * n_all) // draws) AS place FROM asked) JOIN pool USING (country, source, place) ANTI JOIN tr USING (s1_id, cand_id)),
turns AS (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY md5(s1_id || '|' || cand_id || '|42'), cand_id) AS turn FROM drawn),
taken AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY turn, md5(s1_id || '|' || source || '|42')) AS k FROM turns)
SELECT s1_id, cand_id, 1 AS label FROM tr UNION ALL SELECT s1_id, cand_id, 0 FROM taken WHERE k <= need""")
def random_pairs(spark, d):
    return sampling.random_pairs(*_sources(spark, d), _truth(spark, d))


# ---- validation, over lists with planted faults
_BAD = """bad AS (SELECT 'S1-' || o_custkey AS s1_id, string_agg(CASE WHEN o_orderkey % 11 = 0 THEN 'S1-' WHEN o_orderkey % 13 = 0 THEN 'X-' WHEN o_orderkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END || (o_orderkey % 50), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey),
lists AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE CAST(substr(s1_id, 4) AS BIGINT) % 100 = 0), req AS (SELECT 'S1-' || c_custkey AS entity_id FROM customer),
ex AS (SELECT s1_id, unnest(string_split(ids, ',')) AS cand_id FROM lists)"""


def _bad(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    key = F.col("o_orderkey")
    cand = F.concat(F.when(key % 11 == 0, "S1-").when(key % 13 == 0, "X-").when(key % 2 == 0, "S2-").otherwise("S3-"), (key % 50).cast("string"))
    lists = orders.groupBy(F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("s1_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cand.alias("c")))), lambda x: x["c"]), ",").alias("ids"))
    required = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return lists.union(lists.where(F.substring("s1_id", 4, 20).cast("long") % 100 == 0)), required


@query(f"WITH {_BAD} SELECT s1_id, count(*) AS n FROM lists GROUP BY s1_id HAVING count(*) > 1")
def validate_duplicate_rows(spark, d):
    return validate.duplicate_rows(_bad(spark, d)[0])


@query(f"WITH {_BAD} SELECT s1_id, cand_id, count(*) AS n FROM ex GROUP BY ALL HAVING count(*) > 1")
def validate_duplicate_ids(spark, d):
    return validate.duplicate_ids(_bad(spark, d)[0])


@query(f"WITH {_BAD} SELECT s1_id, cand_id, CASE WHEN cand_id LIKE 'S1-%' THEN 'self' ELSE 'prefix' END AS problem FROM ex WHERE NOT regexp_matches(cand_id, '^S[23]-')")
def validate_prefix(spark, d):
    return validate.wrong_prefix(_bad(spark, d)[0])


@query(f"WITH {_BAD} SELECT entity_id AS s1_id FROM req WHERE entity_id NOT IN (SELECT s1_id FROM lists)")
def validate_missing(spark, d):
    return validate.missing_rows(*_bad(spark, d))


@query(f"WITH {_BAD} SELECT s1_id FROM lists WHERE s1_id NOT IN (SELECT entity_id FROM req WHERE CAST(substr(entity_id, 4) AS BIGINT) % 3 = 0)")
def validate_extra(spark, d):
    lists, required = _bad(spark, d)
    return validate.extra_rows(lists, required.where(F.substring("entity_id", 4, 20).cast("long") % 3 == 0))


@query(f"WITH {_BAD} SELECT s1_id, cand_id FROM ex WHERE cand_id NOT IN (SELECT 'S2-' || (l_orderkey % 40) FROM lineitem UNION SELECT 'S3-' || (l_orderkey % 40) FROM lineitem)")
def validate_unknown(spark, d):
    n = (F.col("l_orderkey") % 40).cast("string")
    ids = spark.read.parquet(f"{d}/lineitem.parquet").select(F.explode(F.array(F.concat(F.lit("S2-"), n), F.concat(F.lit("S3-"), n))).alias("entity_id")).distinct()
    return validate.unknown_ids(_bad(spark, d)[0], ids)


@query(f"WITH {_BAD} SELECT DISTINCT s1_id, cand_id FROM ex WHERE length(cand_id) <> 4")
def validate_subset(spark, d):
    lists = _bad(spark, d)[0]
    some = validate.exploded(lists).where(F.length("cand_id") == 4).groupBy("s1_id").agg(F.array_join(F.collect_list("cand_id"), ",").alias("ids"))
    return validate.not_subset(lists, some)


@query(f"""WITH {_BAD}, bad_rows AS (
  SELECT 'duplicate row' AS rule, s1_id AS who FROM (SELECT s1_id FROM lists GROUP BY s1_id HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate id', s1_id || ' ' || cand_id FROM (SELECT s1_id, cand_id FROM ex GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT CASE WHEN cand_id LIKE 'S1-%' THEN 'self match' ELSE 'wrong prefix' END, s1_id || ' ' || cand_id FROM ex WHERE NOT regexp_matches(cand_id, '^S[23]-')
  UNION ALL SELECT 'missing row', entity_id FROM req WHERE entity_id NOT IN (SELECT s1_id FROM lists)
  UNION ALL SELECT 'extra row', s1_id FROM lists WHERE s1_id NOT IN (SELECT entity_id FROM req)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY who) AS k FROM bad_rows)
SELECT rule, 'error' AS severity, count(*) AS n, string_agg(who, '; ' ORDER BY who) FILTER (WHERE k <= 5) AS examples FROM ranked GROUP BY rule""")
def validate_report(spark, d):
    return validate.report(*_bad(spark, d))


# ---- resume, model
@query(f"WITH {ENT} SELECT entity_id FROM ent WHERE entity_id LIKE 'S1-%' AND CAST(substr(entity_id, 4) AS BIGINT) % 2 = 1")
def resume_anti_join(spark, d):
    q = _sources(spark, d)[0]
    done = q.where(F.substring("entity_id", 4, 20).cast("long") % 2 == 0).select(F.col("entity_id").alias("source1_entity_id"))
    return sinks.remaining(q, done).select("entity_id")


@query(f"WITH {ENT} SELECT country, count(*) AS finished FROM ent WHERE entity_id LIKE 'S1-%' AND CAST(substr(entity_id, 4) AS BIGINT) % 2 = 0 GROUP BY country")
def resume_finished(spark, d):
    q = _sources(spark, d)[0]
    done = q.where(F.substring("entity_id", 4, 20).cast("long") % 2 == 0).select(F.col("entity_id").alias("source1_entity_id"))
    return sinks.finished_by_country(q, done)


_FITTED: dict = {}


def _trained(spark, d, p=FULL):
    """Model, worked out once per session and folder, and the features of the queries that were held out; four of five queries train. Candidates are written nowhere, only the training pairs' features."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        (q, t), truth = map(stored, _sources(spark, d)), _truth(spark, d, stored)
        split = stored(sampling.stratified_split(q, truth, 0.2).select("entity_id", "validation"))
        index, sides = blocking.index(t, p, stored), [sinks.small(stored(S.normalised(x))) for x in (q, t)]
        pairs = lambda part: blocking.candidates(q.join(split.where(part), "entity_id", "left_semi"), index, p, stored).select("s1_id", "cand_id")
        rows = sampling.hard_negatives(pairs("not validation"), truth)
        fitted = model.train(stored(S.pair_features(rows.select("s1_id", "cand_id", "label"), *sides)))
        _FITTED[key] = fitted, S.pair_features(evaluate.labelled(pairs("validation"), truth), *sides)
    return _FITTED[key]


@query()
def score_gbt(spark, d, p=FULL):
    """All candidates of the held-out queries."""
    fitted, held = _trained(spark, d, p)
    return model.predict(fitted, held).select("s1_id", "cand_id", "label", "probability")


@query()
def train_gbt(spark, d, p=FULL):
    return model.importances(_trained(spark, d, p)[0], spark)
