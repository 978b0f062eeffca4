import pytest
from pyspark.sql import functions as F

from kinweave.functions import clean as C
from kinweave.functions.fold import fold_text, transliterate_any, transliterate_text

NAMES = [
    ("ACME  SOLUTIONS   INC.", {"name_core": "acme solutions", "name_clean": "acme solutions inc.", "legal_suffix": "inc"}),
    ("Infosys Technologies Private Limited", {"name_core": "infosys technologies", "legal_suffix": "pvt ltd"}),
    ("Boutique de Paris SASU", {"name_core": "boutique de paris", "legal_suffix": "sasu"}),
    ("Acme Solutions-L.L.C.", {"name_core": "acme solutions", "legal_suffix": "llc"}),
    ("MyStore www.mystore.com LLC", {"legal_suffix": "llc", "name_core": "mystore"}),
    ("Shri Ram Enterprises", {"name_core": "ram enterprises"}),
    ("LLC Crystal", {"name_core": "crystal", "legal_suffix": "llc"}),
    ("Alpha Co Ltd", {"name_core": "alpha", "legal_suffix": "co ltd"}),
    ("Société Générale | site", {"name_core": "societe generale"}),
    ("", {"name_core": "", "name_clean": "", "legal_suffix": ""}),
    (None, {"name_core": "", "name_original": ""}),
]
ADDRESSES = [
    ("123 Main St, Suite 400, Seattle, WA 98101", "US", {"addr_postal_code": "98101", "addr_state": "wa", "addr_city": "seattle", "addr_clean": "123 main street, suite 400"}),
    ("Plot 42, Hitech City, Hyderabad, Telangana 500081", "india", {"addr_postal_code": "500081", "addr_state": "telangana", "addr_city": "hyderabad"}),
    ("15 Rue de Rivoli, 75001 Paris", "France", {"addr_postal_code": "75001", "addr_city": "paris"}),
    ("456 Oak Ave, Apt 3, Dallas, TX", "us", {"addr_state": "tx", "addr_city": "dallas", "addr_clean": "456 oak avenue, apartment 3"}),
    ("near the park, 12 High St", "uk", {"addr_clean": "", "addr_city": "12 high street"}),
    ("", "us", {"addr_clean": "", "addr_city": "", "addr_original": ""}),
    (None, None, {"addr_clean": "", "addr_postal_code": ""}),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(f"n{k}", n, None, "us") for k, (n, _) in enumerate(NAMES)] + [(f"a{k}", "x", a, c) for k, (a, c, _) in enumerate(ADDRESSES)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    return {r["entity_id"]: r.asDict() for r in C.preprocess(df).collect()}


@pytest.mark.parametrize("k", range(len(NAMES)))
def test_name(cleaned, k):
    assert {c: cleaned[f"n{k}"][c] for c in NAMES[k][1]} == NAMES[k][1]


@pytest.mark.parametrize("k", range(len(ADDRESSES)))
def test_address(cleaned, k):
    assert {c: cleaned[f"a{k}"][c] for c in ADDRESSES[k][2]} == ADDRESSES[k][2]


def test_columns_and_raw_values(cleaned):
    assert list(cleaned["n0"]) == C.CLEAN
    assert cleaned["n0"]["business_name"] == "ACME  SOLUTIONS   INC."
    assert cleaned["a0"]["country"] == "us"


def test_blocking_keys(spark):
    df = spark.createDataFrame([("1", "Reliance Retail Ltd", "Bandra Kurla Complex, Mumbai, Maharashtra 400051", "India")], "entity_id string, business_name string, business_address string, country string")
    row = C.blocking_keys(C.preprocess(df)).first()
    assert (row.country, row.postal_code, row.city_state, row.name_first_token) == ("india", "400051", "mumbai_maharashtra", "reliance")


def test_conjunctions_and_nulls(spark):
    df = spark.createDataFrame([("A & B + C", "N/A", " Null ")], "a string, b string, c string")
    row = df.select(C.conjunctions(F.col("a")), C.null_to_empty(F.col("b")), C.safe_str(F.col("c"))).first()
    assert tuple(row) == ("A  and  B  and  C", "", "")


def test_transliteration(spark):
    assert transliterate_text("संजय ट्रेडर्स").startswith("snjy")
    assert transliterate_text("उत्तर प्रदेश") == "uttr prdesh"
    assert transliterate_text("Æther Straße") == "aether strasse"
    assert fold_text("Société") == "Societe"
    got = spark.createDataFrame([("टाटा मोटर्स",), (None,), ("",)], "s string").select(transliterate_any("s")).collect()
    assert got[0][0].isascii() and got[0][0] and got[1][0] is None and got[2][0] == ""


@pytest.mark.parametrize(
    ("addr", "country", "parts"),
    [
        ("10001 Rue de l'Île, 70001 Orléans, Ile-de-France", "France", ("10001 rue de l ile", "orleans", "ile-de-france", "70001")),
        ("75001 Paris", "France", ("", "paris", "", "75001")),
        ("Plot No. 123456, Link Rd, Pune, Maharashtra 413456", "India", ("123456, link road", "pune", "maharashtra", "413456")),
        ("411001 Pune, Maharashtra", "India", ("", "pune", "maharashtra", "411001")),
    ],
)
def test_house_number_is_no_postal_code(spark, addr, country, parts):
    row = C.preprocess(spark.createDataFrame([("1", "x", addr, country)], "entity_id string, business_name string, business_address string, country string")).first()
    assert (row.addr_clean, row.addr_city, row.addr_state, row.addr_postal_code) == parts


_LONG = [("1", "SARL Quai", "10001 Rue de l'Île, 70001 Orléans, Ile-de-France", "France"), ("2", "Smt Ram Pvt. Ltd.", "Plot No. 123456, Link Rd, Pune, Maharashtra 413456", "India")]


def test_blocking_keys_with_long_house_numbers(spark):
    df = spark.createDataFrame(_LONG, "entity_id string, business_name string, business_address string, country string")
    rows = {r.entity_id: (r.postal_code, r.city_state) for r in C.blocking_keys(C.preprocess(df)).collect()}
    assert rows == {"1": ("70001", "orleans_ile-de-france"), "2": ("413456", "pune_maharashtra")}


def test_clean_files_with_long_house_numbers(spark, tmp_path):
    from kinweave.sources import sinks, tables

    df = spark.createDataFrame(_LONG, "entity_id string, business_name string, business_address string, country string")
    sinks.write_clean(C.preprocess(df), f"{tmp_path}/clean")
    rows = {r.entity_id: (r.addr_city, r.addr_postal_code) for r in tables.load_clean(spark, f"{tmp_path}/clean", ["entity_id", "addr_city", "addr_postal_code"]).collect()}
    assert rows == {"1": ("orleans", "70001"), "2": ("pune", "413456")}
