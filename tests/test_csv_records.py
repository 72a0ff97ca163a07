"""Records of split CSV files against one sequential reader of the same text."""

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortlens.operators import ingest
from cohortlens.sources import csv_records
from cohortlens.streaming import incremental
from conftest import rows


def sequential(text):
    """(good records as lists, bad records' first lines), read character by
    character: a quote opens a value at its start only; a record with text
    beside its quotes ends with its line; blank lines between records are skipped."""
    lines = [ln[:-1] if ln.endswith("\r") else ln for ln in text.split("\n")]
    if lines and lines[-1] == "":
        lines.pop()
    out, i = [], 0
    while i < len(lines):
        start = i
        if lines[i].strip(" ") == "":
            i += 1
            continue
        values, rest, bad = [], lines[i], False
        while True:
            if rest.startswith('"'):
                rest, value, closed = rest[1:], "", False
                while not closed:
                    cut = rest.find('"')
                    if cut < 0:
                        if i + 1 == len(lines):
                            bad = True
                            break
                        value, i = value + rest + "\n", i + 1
                        rest = lines[i]
                    elif rest[cut:cut + 2] == '""':
                        value, rest = value + rest[:cut] + '"', rest[cut + 2:]
                    else:
                        value, rest, closed = value + rest[:cut], rest[cut + 1:], True
                values.append(value)
                if bad or (rest and not rest.startswith(",")):
                    bad = True
                    break
            else:
                value, comma, tail = rest.partition(",")
                if '"' in value:
                    bad = True
                    break
                values.append(value or None)
                rest = comma + tail
            if not rest:
                break
            rest = rest[1:]
        out.append((lines[start], None if bad else values))
        i += 1
    return out


def read(spark, folder, split=None):
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return rows(ingest.parse_lines(csv_records.text_lines(spark.read, folder)), *csv_records.PLACE)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf[0])
        spark.conf.set("spark.sql.files.openCostInBytes", conf[1])


def compare(spark, folder, texts, splits):
    want = {}
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(text)
        (_, head), *body = sequential(text)
        want[name] = [(first, v if v is not None and len(v) == len(head) else None) for first, v in body]
    for split in splits:
        got = {}
        for r in read(spark, folder, split):
            name = os.path.basename(r["source_file"])
            cols = [c for c in r if c not in ("_corrupt_record", "source_file", *csv_records.PLACE)]
            values = [r[c] for c in cols] if r["_corrupt_record"] is None else None
            got.setdefault(name, []).append((r["_corrupt_record"], values))
        for name, mine in want.items():
            seen = got.get(name, [])
            assert [v for _, v in seen] == [v for _, v in mine], (name, split)
            for (raw, v), (first, _) in zip(seen, mine):
                assert v is not None or raw.split("\n")[0] == first


PIECES = ["a", "1", ",", ",", '"', '"', '""', "\n", "\n", "\r\n", " ", "é", "\n\n", 'x,"y', '",', ',"', "\r"]


@pytest.mark.parametrize("seed", [1])
def test_any_split_size_reads_as_one_sequential_reader(spark, tmp_dir, seed):
    rng = random.Random(seed)
    texts = {}
    for k in range(12):
        body = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 10, 80, 300])))
        good = "\n".join(f'{i},"v {i}\n{"" if i % 3 else chr(34) * 2}w",{i}' for i in range(rng.choice([0, 5, 40])))
        texts[f"{k:02}.csv"] = "a,b,c\n" + (body + "\n" + good if rng.random() < 0.7 else good + body)
    compare(spark, tmp_dir, texts, [None, 50])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(body=st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
def test_property_records(spark, tmp_path_factory, body):
    compare(spark, str(tmp_path_factory.mktemp("csv")), {"x.csv": "a,b\n" + body}, [7])


def test_inside_of_a_quoted_value_is_never_a_row(spark, tmp_dir):
    path = os.path.join(tmp_dir, "q.csv")
    with open(path, "w") as f:
        f.write('REGNUMBER,SURNAME,ADDRESS\nR1,Obi,"12 Road\nR9,Evil,Faked\nLagos"\nR2,Ade,x\nR3,Eze,"open\nR8,Evil,Faked\n')
    for split in (None, 16, 30):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split or 134217728))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = rows(ingest.read_candidate_csv(spark, path), *csv_records.PLACE)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [(r["REGNUMBER"], r["ADDRESS"]) for r in got if r["_corrupt_record"] is None] == [("R1", "12 Road\nR9,Evil,Faked\nLagos"), ("R2", "x")]
        assert [r["_corrupt_record"] for r in got if r["_corrupt_record"]] == ['R3,Eze,"open']


def test_stream_reads_values_with_line_breaks(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    os.makedirs(src)
    for k in range(3):
        with open(os.path.join(src, f"{k}.csv"), "w") as f:
            f.write(f'ADDRESS,REGNUMBER\n"{k} Road\nR9,Evil\nLagos",R{k}\n')
    q = incremental.start_import(spark, src, out, out + "-e", ingest.ImportOptions(year=2024), checkpoint=out + "-c", max_files_per_trigger=2)
    q.awaitTermination()
    got = rows(spark.read.parquet(out), "regnumber")
    assert [(r["regnumber"], r["address"]) for r in got] == [(f"R{k}", f"{k} Road\nR9,Evil\nLagos") for k in range(3)]


def test_many_headers_are_one_plan(spark, tmp_dir):
    rng = random.Random(3)
    names = ["REGNUMBER", "SURNAME", "FIRSTNAME", "GENDER"]
    want = {}
    for k in range(60):
        order = rng.sample(names, 4) + [f"EXTRA{k}"]
        rng.shuffle(order)
        want[f"R{k}"] = f"S{k}"
        with open(os.path.join(tmp_dir, f"{k}.csv"), "w") as f:
            f.write(",".join(order) + "\n" + ",".join({"REGNUMBER": f"R{k}", "SURNAME": f"S{k}"}.get(n, "M") for n in order) + "\n")
    df = ingest.read_candidate_csv(spark, tmp_dir)
    assert {r["REGNUMBER"]: r["SURNAME"] for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan text") == 1


def test_headers(spark, tmp_dir):
    def file(name, text):
        with open(os.path.join(tmp_dir, name), "w", encoding="utf-8") as f:
            f.write(text)
        return os.path.join(tmp_dir, name)
    one = rows(ingest.read_candidate_csv(spark, file("bom.csv", '﻿"REGNUMBER", Surname \r\nR1,"a\r\nb"\r\n\r\n')))
    assert [(r["REGNUMBER"], r["SURNAME"]) for r in one] == [("R1", "a\nb")]
    assert rows(ingest.read_candidate_csv(spark, file("only.csv", "\n\nREGNUMBER,SURNAME\n"))) == []
    with pytest.raises(ValueError, match="no CSV record"):
        ingest.read_candidate_csv(spark, file("open.csv", 'REGNUMBER,"SUR\nNAME"\nR1,x\n'))
    with pytest.raises(ValueError, match="repeats"):
        ingest.read_candidate_csv(spark, file("twice.csv", "REGNUMBER,A,a\nR1,x,y\n"))
