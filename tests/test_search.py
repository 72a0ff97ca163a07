"""The search index gives the scan's rows, from its own folders and the candidates' years."""

import os
import random

import pytest

from cohortlens.operators import reports as R
from cohortlens.operators import search
from cohortlens.sources.tables import FrameTables, StoredTables, materialize
from conftest import rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    names = ["Adebayo", "ADEBOLA", "O'Neil", "Okafor", "ok", "", None, "Ünal", "de Baye", "A%b_c", "back\\slash", "İnci"]
    data = [(f"R{rng.randint(0, 99999):05}{'x' if i % 7 else '%Y'}{i}", rng.choice(names), f"F{i}", "F", i, 2018 + i % 4) for i in range(400)]
    data += [("zz99only", "Uniquename", "Q", "M", 1, 2030), (None, "Nobody", "Q", "M", 1, 2031)]
    t = FrameTables(spark, candidate=spark.createDataFrame(data, "regnumber string, surname string, firstname string, gender string, aggregate int, year int"))
    out = str(tmp_path_factory.mktemp("search"))
    materialize(t, out, tables=["candidate"], buckets=2)
    search.write_index(t, os.path.join(out, "index"))
    return StoredTables(spark, out, tables=["candidate"]), os.path.join(out, "index"), data


TERMS = ["ade", "ADEB", "AdeBayo", "bay", "e_ay", "ade%a", "%", "_", "ok", "R1", "R12", "123", "%Y", "x12", "okaf%r", "o'n", "ünal", "nothing at all", "a\\%b", "A%b", "slash", "zz99", "uniq", "İn", "___", ""]


def test_same_rows_as_the_scan(spark, stored):
    t, index, _ = stored
    for term in TERMS:
        want, got = (rows(f) for f in (R.search_candidates(t, term, 1000), search.search_candidates(spark, t, index, term, 1000)))
        assert got == want, term
    assert len(rows(search.search_candidates(spark, t, index, "ade", 5))) == 5


def test_only_folders_and_years_of_the_term_are_read(spark, stored):
    t, index, data = stored
    df = search.search_candidates(spark, t, index, "uniquename")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "gram_folder" in plan and "dynamicpruning" in plan
    # Whatever is not needed may be gone.
    grams = set(search.term_grams("uniquename"))
    used = {r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(search._folder("g")).collect()}
    for folder in os.listdir(index):
        if folder.startswith("gram_folder=") and int(folder.split("=")[1]) not in used:
            for f in os.listdir(os.path.join(index, folder)):
                with open(os.path.join(index, folder, f), "wb") as out:
                    out.write(b"spoilt")
                crc = os.path.join(index, folder, f".{f}.crc")
                if os.path.exists(crc):
                    os.remove(crc)
    schema = "field int, gram string, regnumber string, year int, gram_folder int"
    spoilt = spark.read.schema(schema).parquet(index)
    assert spoilt.where(spoilt.gram_folder.isin(sorted(used)) & spoilt.gram.isin(sorted(grams))).select("regnumber").distinct().count() == 1


def test_grams_of_terms():
    assert search.term_grams("abcd") == ["abc", "bcd"] and search.term_grams("ab%cd") == [] and search.term_grams("abc%d_efg") == ["abc", "efg"]
    assert search.term_grams("ab\\%cde") == ["cde"] and search.term_grams("") == []
