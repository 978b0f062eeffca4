import unicodedata

from pyspark.sql import functions as F

from kinweave.functions import block as B
from kinweave.functions import clean as C
from kinweave.functions import match as M
from kinweave.functions.fold import transliterate_script, transliterate_text
from kinweave.operators import blocking

SCHEMA = "entity_id string, name string, addr string, country string"
NAMES = ["टाटा मोटर्स", "Кораблин Верфь", "Ακρόπολη Μάρμαρα"]


def test_names_meet_their_latin_spelling(spark):
    assert transliterate_text(NAMES[1]) == "korablin verf'" and transliterate_text(NAMES[2]) == "akropole marmara"
    queries = spark.createDataFrame([(f"S1-{k}", n, "", "X") for k, n in enumerate(NAMES)], SCHEMA)
    targets = spark.createDataFrame([(f"S2-{k}", transliterate_text(n), "", "X") for k, n in enumerate(NAMES)], SCHEMA)
    got = {(r.s1_id, r.cand_id, r.hits) for r in blocking.pair_scores(queries, targets).collect()}
    assert got == {(f"S1-{k}", f"S2-{k}", 2) for k in range(3)}


def test_columns_of_mixed_scripts(spark):
    rows = [("Société Générale",), (unicodedata.normalize("NFD", "Société Générale"),), ("Ωmega ２",), (None,)]
    c = F.col("x")
    got = spark.createDataFrame(rows, "x string").select(B.norm(c), C.address_text(transliterate_script(c)), M.match_name(c), M.match_name_ascii(M.match_name(c))).collect()
    assert [r[0] for r in got] == ["societe generale", "societe generale", "ωmega 2", ""]
    assert got[0][1] == got[1][1] and got[2][1] == "omega 2"
    assert [r[2] for r in got[:2]] == ["société générale"] * 2 and [r[3] for r in got[:2]] == ["societe generale"] * 2
