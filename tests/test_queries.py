"""Registered queries beside their SQL on the smallest tables."""

import hashlib
import json
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidemill.plans import registry

SF = "/root/testdata/sf0.001"
SOME = "q_A1 q_A3 q_A5 q_A7 q_B1_B2_B3 q_B7 q_B10 q_C4 q_C5 q_C7 q_C12 q_D3 q_D4 q_D9 q_D13 q_D18 q_E3 q_E7 q_E13 q_E18 q_F05 q_F10 q_F02 q_G1 q_G9 q_H2 q_I8 q_I12 q_J4 q_J7 q_K2_K4 q_K3 q_B11 q_D8_certified q_D8_boundary q_D14 q_D19 q_C13 q_H3 q_H4 q_H5 q_J11 q_J13_control q_J15 q_J15_nine q_J16_segments q_L1 q_F31_F33 q_A10_once q_D2 q_D8 q_D10 q_D18_tree q_E16 q_E17 q_F04 q_F24 q_G5 q_I14 q_J15_cycles q_J15_evidence q_C9 q_C11_archives q_D15_pairs q_I15_faults q_E23_errors q_K1_errors q_J16_stress q_L3_sides".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if v != v else round(float(v), 6)
    return v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == columns
    assert got == want


def test_event_ids(spark):
    """Each id is the hash of its event's compact JSON with sorted keys, nulls included."""
    from tidemill.plans import quality_queries

    rows = quality_queries.events(spark, SF).collect()
    for r in rows:
        body = {k: v.strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] if isinstance(v, datetime) else v for k, v in r.asDict().items() if k != "event_id"}
        assert r.event_id == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    got = registry.queries()["q_D17"](spark, SF).collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in rows) and len(rows) > 20


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
