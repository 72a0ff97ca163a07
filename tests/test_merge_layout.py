"""Merges into bucketed tables: what is read and rewritten, recovery, laws."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import upsert
from conftest import rows

TARGET = "regnumber string, surname string, aggregate int, year int"
BATCH = TARGET + ", _seq int"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_ino for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def folders(names):
    return {os.path.dirname(n) for n in names}


def table(spark, path, n=400, buckets=16):
    df = spark.range(n).select(F.format_string("R%d", "id").alias("regnumber"), F.lit("Ade").alias("surname"), F.col("id").cast("int").alias("aggregate"),
                               (2020 + F.col("id") % 4).cast("int").alias("year"))
    upsert.create_table(df, path, buckets=buckets)
    return df


def test_a_small_batch_reads_and_rewrites_its_buckets_only(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    before_rows = {r["regnumber"]: r for r in rows(table(spark, path))}
    before = files(path)
    batch = spark.createDataFrame([("R5", "New", None, 2021, 1), ("R6", None, 7, 2023, 1), ("NEW", "Obi", 1, 2024, 1)], BATCH)
    home = {r["regnumber"]: r[upsert.BUCKET] for r in upsert.read_table(spark, path).where(F.col("regnumber").isin("R5", "R6")).collect()}
    allowed = {f"year=2021/{upsert.BUCKET}={home['R5']}"} | {f"year={y}/{upsert.BUCKET}={home['R6']}" for y in (2022, 2023)}
    # Whatever is not touched can't be read: a merge that opened it would fail.
    spoilt = [n for n in before if os.path.dirname(n) not in allowed
              and os.path.dirname(n).split("=")[-1] not in {str(home["R5"]), str(home["R6"]), str(bucket_of(spark, path, "NEW"))}]
    assert len(spoilt) > 40
    kept = {}
    for n in spoilt:
        with open(os.path.join(path, n), "rb") as f:
            kept[n] = f.read()
        with open(os.path.join(path, n), "wb") as f:
            f.write(b"spoilt")
    upsert.write_upsert(spark, path, batch)
    for n in spoilt:
        with open(os.path.join(path, n), "wb") as f:
            f.write(kept[n])
        crc = os.path.join(path, os.path.dirname(n), f".{os.path.basename(n)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    after = files(path)
    rewritten = folders(n for n, _ in set(before.items()) ^ set(after.items()))
    assert rewritten == allowed | {f"year=2024/{upsert.BUCKET}={bucket_of(spark, path, 'NEW')}"}
    got = {r["regnumber"]: (r["surname"], r["aggregate"], r["year"]) for r in rows(upsert.read_table(spark, path))}
    want = {k: (r["surname"], r["aggregate"], r["year"]) for k, r in before_rows.items()}
    want |= {"R5": ("New", 5, 2021), "R6": ("Ade", 7, 2023), "NEW": ("Obi", 1, 2024)}
    assert got == want and not [d for d in os.listdir(path) if d.startswith(upsert.STAGE)]
    upsert.write_upsert(spark, path, batch)
    assert {r["regnumber"]: (r["surname"], r["aggregate"], r["year"]) for r in rows(upsert.read_table(spark, path))} == want


def bucket_of(spark, path, key):
    layout = upsert.layout_of(spark, path)
    return spark.range(1).select(layout.bucket(F.lit(key))).first()[0]


@pytest.mark.parametrize("moves", [0, 1, 2])
def test_a_merge_that_dies_is_finished_by_the_next(spark, tmp_dir, monkeypatch, moves):
    path = os.path.join(tmp_dir, "t")
    table(spark, path, 60, 4)
    batch = spark.createDataFrame([(f"R{i}", "NEW", None, 2030, 1) for i in range(0, 60, 3)] + [("R1", "ONE", None, 2021, 1)], BATCH)
    real, count = upsert._delete_path, [0]

    def dies(spark_, p):
        if "year=" in p:
            count[0] += 1
            if count[0] > moves:
                raise KeyboardInterrupt
        real(spark_, p)
    monkeypatch.setattr(upsert, "_delete_path", dies)
    with pytest.raises(KeyboardInterrupt):
        upsert.write_upsert(spark, path, batch)
    monkeypatch.setattr(upsert, "_delete_path", real)
    assert upsert.recover(spark, path) is True and upsert.recover(spark, path) is False
    got = {r["regnumber"]: (r["surname"], r["year"]) for r in rows(upsert.read_table(spark, path))}
    assert got == {f"R{i}": ("NEW", 2030) if i % 3 == 0 else ("ONE", 2021) if i == 1 else ("Ade", 2020 + i % 4) for i in range(60)}


def test_rows_without_a_partition_or_key(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    table(spark, path, 8, 2)
    with pytest.raises(ValueError, match="without a year"):
        upsert.write_upsert(spark, path, spark.createDataFrame([("X", "a", 1, None, 1)], BATCH))
    before = files(path)
    upsert.write_upsert(spark, path, spark.createDataFrame([(None, "a", 1, 2024, 1)], BATCH))
    assert files(path) == before


KEYS = st.sampled_from(["A", "B", "C", "D", "E"])
ROW = st.tuples(KEYS, st.sampled_from([None, "", "x", "y"]), st.sampled_from([None, 1, 2]), st.sampled_from([2020, 2021, None]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.lists(ROW, min_size=1, max_size=6), min_size=1, max_size=2))
def test_merges_equal_a_dictionary(spark, tmp_path_factory, batches):
    path = str(tmp_path_factory.mktemp("m") / "t")
    start = [("A", "s", 0, 2019), ("Z", "z", 0, 2019)]
    upsert.create_table(spark.createDataFrame(start, TARGET), path, buckets=3)
    state = {k: (s, a, y) for k, s, a, y in start}
    for batch in batches:
        seen = set(state)
        batch = [(k, s, a, y if k in seen or y else 2022) for k, s, a, y in batch]
        for k, s, a, y in batch:
            old = state.get(k, (None, None, None))
            state[k] = (s or old[0], old[1] if a is None else a, old[2] if y is None else y)
        upsert.write_upsert(spark, path, spark.createDataFrame([(*r, i) for i, r in enumerate(batch)], BATCH))
    assert {r["regnumber"]: (r["surname"], r["aggregate"], r["year"]) for r in rows(upsert.read_table(spark, path))} == state
