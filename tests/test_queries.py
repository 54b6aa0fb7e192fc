"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that are quick on the smallest tables; the rest take the same tables through the same helpers.
QUICK = """a1_token_counts p5_literals p12_inventory t13_chat_search t14_terms t15_history s17_turns a25_content_dedupe w8_delta w2_energy w3_spatial w9_blocks w1_ema a22_dedupe h2_symbols
    t1_neighbors t16_score j1_relations j17_review_queue f1_lanes i9_frames f5_blocked f6_gate f12_gates z1_query_frame i17_frame z13_slots i10_length f16_headings z25_fact_text j10_recognition d4_approve
    d6_assign_pending d9_import z43_misspelled h1_labels h11_rebuild p18_windows s4_tables s6_json s8_html s3_encodings s1_scan s19_images s22_audio p14_repair k2_cells k7_symbols j4_sequences s29_rows
    p21_locators w4_frequency w5_derived w7_resize w10_cells w16_scene j21_overlaps v2_reading v1_ink_box z80_aspect t12_spans t21_choose z56_threads z57_trees o1_intake k1_map z94_parity""".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_equal_to_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    done = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in done.fetchall())


def test_entry_and_keys(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
