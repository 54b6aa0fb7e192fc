"""Canonical JSON against json.dumps, contracts on valid and broken records."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import records as R

KIND = T.StructType([T.StructField("z", T.StringType()), T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("s", T.StructType([T.StructField("y", T.BooleanType()), T.StructField("x", T.IntegerType())]))])


def dumped(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_canonical_against_the_library(spark):
    texts = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from('\\"\n\t\x00\x1f/é')), max_size=8)
    row = st.tuples(st.none() | texts, st.none() | st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=4), st.none() | st.dictionaries(texts, st.integers(-(2**62), 2**62), max_size=3), st.none() | st.tuples(st.none() | st.booleans(), st.none() | st.integers(-9, 9)))
    seen = []

    @settings(max_examples=300, deadline=None)
    @given(row)
    def collect(r):
        seen.append(r)

    collect()
    seen += [("", [1e16, 1e15, 123456789.125, 1e-4, 1e-5, 1.5e-7, 0.001, 1e22, 5e-324, -2.5e10, 0.0, 12345678.0], {}, (True, None))]
    df = spark.createDataFrame(seen, KIND)
    got = df.select(R.canonical(F.struct(*KIND.names), KIND).alias("c")).collect()
    for r, g in zip(seen, got, strict=True):
        want = {"z": r[0], "a": r[1], "m": r[2], "s": None if r[3] is None else dict(zip("yx", r[3], strict=True))}
        assert g.c == dumped(want), (g.c, dumped(want))
    sums = R.checksums(df.limit(3).withColumn("checksum", F.lit("old"))).select("checksum").collect()
    assert [s.checksum for s in sums] == [hashlib.sha256(g.c.encode()).hexdigest() for g in got[:3]]
    assert [s.checksum for s in R.checksums(df.limit(3).select("s", "m", "a", "z")).collect()] == [s.checksum for s in sums]


GOOD = {"contract_version": "v@1", "visual_record_id": "p", "region_map_id": "r", "source_hash": "h", "coordinate_space": "grid_cells", "relations": [], "approval_status": "candidate",
        "writes_allowed": {"maps": False, "counts": False}, "regions": [{"region_id": "1", "shape": "box", "bounds": {"x": 1}, "kind_candidate": "k", "backend_id": "b", "approval_status": "c"}]}


def test_contracts(spark):
    bad = lambda **kw: json.dumps({**GOOD, **kw})
    without = json.dumps({k: v for k, v in GOOD.items() if k != "source_hash"})
    cases = [
        (json.dumps(GOOD), []), (without, ["region map: source_hash is missing"]), (bad(contract_version="v@2"), ["region map: contract_version is not v@1"]), (bad(coordinate_space=None), ["region map: coordinate_space is none of native_pixels, grid_cells"]),
        (bad(writes_allowed={"maps": False, "counts": True}), ["region map: writes_allowed allows writes"]), (bad(writes_allowed=False), ["region map: writes_allowed allows writes"]), (bad(regions={}), ["region map: regions is no list"]),
        (bad(regions=[GOOD["regions"][0], {"shape": "blob", "bounds": 3}]), [f"region: {f} is missing" for f in ("region_id", "kind_candidate", "backend_id", "approval_status")] + ["region: shape is none of box, polygon, point, line, mask_ref", "region: bounds is no object"]),
        ("[1]", ["region map: is no object"]), ("{oops", ["region map: is no object"]), (None, ["region map: is no object"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, record string").withColumn("f", R.faults(F.col("record"), R.region_map("v@1")))
    assert {r.i: r.f for r in df.collect()} == {i: c[1] for i, c in enumerate(cases)}


def test_built_records_keep_their_contracts(spark):
    maps = R.empty_region_maps(spark.createDataFrame([("p1", "h1")], "visual_record_id string, source_hash string"), "v@1")
    row = maps.withColumn("f", R.faults(F.col("record"), R.region_map("v@1"))).first()
    assert row.f == [] and json.loads(row.record)["region_map_id"] == "region_map_" + hashlib.sha256(b"v@1::p1::h1").hexdigest()[:16]
    pairs = spark.createDataFrame([("1", "p", "r1", "a \"b\"", None, "source_layout_only", 0.0), ("1", "p", "r2", "a", "b", "fine", 0.1)], "page_id string, visual_record_id string, region_id string, source_text string, visual_text string, agreement string, score double")
    got = {r.region_id: r.f for r in R.two_sided_records(pairs, "b@1").withColumn("f", R.faults(F.col("record"), R.two_sided("b@1"))).collect()}
    assert got["r1"] == [] and len(got["r2"]) == 1 and got["r2"][0].startswith("agreement: status is none of")
