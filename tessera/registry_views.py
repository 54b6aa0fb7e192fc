"""Queries of frames, pictures of text, searches, graphs and look-ahead.

Grids are ``embeddings`` as 8 x 8; pixels take three neighbouring values as colours; boxes are ``lineitem`` as rectangles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import frames, graph, lookahead, phrases, questions, relations, search, visual
from tessera.registry import _CELL_SQL, _GLUE_SQL, PAIRS, QUESTION, TOKS, _tokens, docs, grids, query, table

_ASK = ", ".join(f"'{a}'" for a in QUESTION)


@query("w3_spatial", f"""WITH {_CELL_SQL}, g AS (SELECT dl.*, i // 8 AS r, i % 8 AS c FROM dl),
    n AS (SELECT a.*, b.d AS rd, e.d AS bd FROM g a LEFT JOIN g b ON b.stream_id = a.stream_id AND b.frame_number = a.frame_number AND b.r = a.r AND b.c = a.c + 1
          LEFT JOIN g e ON e.stream_id = a.stream_id AND e.frame_number = a.frame_number AND e.r = a.r + 1 AND e.c = a.c)
    SELECT stream_id, frame_number, round(coalesce(sum(d) FILTER (WHERE r BETWEEN 2 AND 4 AND c BETWEEN 2 AND 4), 0) / (sum(d) + 1e-8), 6) AS center_energy_ratio,
        round(sum(d) FILTER (WHERE r IN (0, 7) OR c IN (0, 7)) / (sum(d) + 1e-8), 6) AS edge_energy_ratio, round(sum(abs(rd - d)) / (sum(abs(bd - d)) + 1e-8), 6) AS horizontal_vs_vertical_ratio,
        round((sum(d) FILTER (WHERE r < 4) - sum(d) FILTER (WHERE r >= 4)) / (sum(d) + 1e-8), 6) AS vertical_bias,
        round((var_pop(x) FILTER (WHERE r IN (0, 7) OR c IN (0, 7)) - var_pop(x) FILTER (WHERE r BETWEEN 2 AND 4 AND c BETWEEN 2 AND 4))
            / (var_pop(x) FILTER (WHERE r IN (0, 7) OR c IN (0, 7)) + var_pop(x) FILTER (WHERE r BETWEEN 2 AND 4 AND c BETWEEN 2 AND 4) + 1e-8), 6) AS tunnel_index FROM n GROUP BY ALL""")
def _(spark, sf):
    got = frames.spatial(grids(spark, sf), 8, 8)
    return got.select("stream_id", "frame_number", *(F.round(c, 6).alias(c) for c in got.columns[2:]))


_SERIES = """o AS (SELECT label::VARCHAR AS s, vec_id AS f, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
    e AS (SELECT s, f, k, x, x AS p, x AS fast, x AS slow, 0.0::DOUBLE AS before, 0.0::DOUBLE AS now FROM o WHERE k = 1
          UNION ALL SELECT o.s, o.f, o.k, o.x, e.x, list_transform(range(1, 65), lambda i: 0.3 * o.x[i] + 0.7 * e.fast[i]), list_transform(range(1, 65), lambda i: 0.1 * o.x[i] + 0.9 * e.slow[i]), e.now,
              list_sum(list_transform(range(1, 65), lambda i: abs(o.x[i] - e.x[i]))) FROM e JOIN o ON o.s = e.s AND o.k = e.k + 1),
    m AS (SELECT s, f, k, now, before, list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - slow[i]))) AS hi, list_sum(list_transform(range(1, 65), lambda i: abs(fast[i] - slow[i]))) AS lo,
              list_max(list_transform(range(1, 65), lambda i: abs(x[i] - p[i]))) AS peak, list_stddev_pop(list_transform(range(1, 65), lambda i: abs(x[i] - p[i]))) AS sd, list_var_pop(x) AS vx, list_var_pop(slow) AS vs,
              list_sum(list_transform(list_filter(range(0, 64), lambda i: i // 8 BETWEEN 2 AND 4 AND i % 8 BETWEEN 2 AND 4), lambda i: abs(x[i + 1] - p[i + 1]))) AS ce,
              list_sum(list_transform(list_filter(range(0, 64), lambda i: i // 8 BETWEEN 2 AND 4 AND i % 8 BETWEEN 2 AND 4), lambda i: abs(x[i + 1] - slow[i + 1]))) AS hc FROM e)"""


@query("w4_frequency", f"""WITH RECURSIVE {_SERIES} SELECT s AS stream_id, f AS frame_number, round(hi, 6) AS highfreq_energy, round(lo, 6) AS lowfreq_energy, round(CASE WHEN k = 1 THEN 0 ELSE hi / (lo + 1e-8) END, 4) AS high_to_low_ratio,
    round(1 / (1 + sd), 6) AS smoothness_index, round(CASE WHEN abs(before) > 1e-8 THEN abs(now - before) / (before + 1e-8) ELSE 0 END, 6) AS stutter_score FROM m""")
def _(spark, sf):
    got = frames.feature_series(grids(spark, sf), 8, 8)
    return got.select("stream_id", "frame_number", F.round("highfreq_energy", 6).alias("highfreq_energy"), F.round("lowfreq_energy", 6).alias("lowfreq_energy"), F.round("high_to_low_ratio", 4).alias("high_to_low_ratio"), F.round("smoothness_index", 6).alias("smoothness_index"), F.round("stutter_score", 6).alias("stutter_score"))


@query("w5_derived", f"""WITH RECURSIVE {_SERIES} SELECT s AS stream_id, f AS frame_number, round(peak, 6) AS flash_intensity, round(CASE WHEN peak > 0.3 THEN ce / (now + 1e-8) ELSE 0 END, 6) AS focus_ratio, round(abs(hc - ce), 6) AS jitter_band_energy,
    round(abs(vx - vs), 6) AS contrast_shift_score, round(CASE WHEN k = 1 THEN 0 ELSE ce / (now + 1e-8) * (1 / (1 + sd)) * (1 - least(1.0, hi / 10)) END, 6) AS lock_score FROM m""")
def _(spark, sf):
    got = frames.feature_series(grids(spark, sf), 8, 8)
    return got.select("stream_id", "frame_number", *(F.round(c, 6).alias(c) for c in ("flash_intensity", "focus_ratio", "jitter_band_energy", "contrast_shift_score", "lock_score")))


@query("w7_resize", f"""WITH {_CELL_SQL}, g AS (SELECT *, i // 8 AS r, i % 8 AS q FROM c), n AS (SELECT nr, nc FROM range(3) a(nr) CROSS JOIN range(5) b(nc)),
    w AS (SELECT stream_id, frame_number, nr, nc, x, greatest(0, least(r + 1, (nr + 1) * 8 / 3) - greatest(r, nr * 8 / 3)) * greatest(0, least(q + 1, (nc + 1) * 8 / 5) - greatest(q, nc * 8 / 5)) AS a FROM g CROSS JOIN n)
    SELECT stream_id, frame_number, nr::INT AS r, nc::INT AS c, round(sum(x * a) / sum(a), 6) AS x FROM w WHERE a > 0 GROUP BY ALL""")
def _(spark, sf):
    return frames.resized(grids(spark, sf), 8, 8, 3, 5).withColumn("x", F.round("x", 6))


_PIX = """px AS (SELECT stream_id, frame_number, i // 8 AS r, i % 8 AS c, round((x + 1) * 127.5)::DOUBLE AS red, round((y + 1) * 127.5)::DOUBLE AS green, round((z + 1) * 127.5)::DOUBLE AS blue FROM (
    SELECT label::VARCHAR AS stream_id, vec_id AS frame_number, unnest(range(64)) AS i, embedding[unnest(range(64)) + 1]::DOUBLE AS x, embedding[(unnest(range(64)) + 1) % 64 + 1]::DOUBLE AS y, embedding[(unnest(range(64)) + 2) % 64 + 1]::DOUBLE AS z FROM embeddings))"""


def pixels(spark, sf):
    g = grids(spark, sf).select("stream_id", "frame_number", "cells", F.posexplode("cells").alias("i", "x"))
    tone = lambda k: F.round((F.get("cells", (F.col("i") + k) % 64) + 1) * 127.5)
    return g.select("stream_id", "frame_number", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c"), tone(0).alias("red"), tone(1).alias("green"), tone(2).alias("blue"))


@query("w10_cells", f"""WITH {_PIX}, t AS (SELECT *, 0.299 * red + 0.587 * green + 0.114 * blue AS luma, greatest(red, green, blue) AS hi, least(red, green, blue) AS lo FROM px),
    h AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = red THEN (green - blue) / (hi - lo) * 30 WHEN hi = green THEN (blue - red) / (hi - lo) * 30 + 60 ELSE (red - green) / (hi - lo) * 30 + 120 END AS hue FROM t),
    a AS (SELECT stream_id, frame_number, r // 4 AS cr, c // 4 AS cc, avg(red) AS rm, stddev_pop(red) AS rs, avg(green) AS gm, stddev_pop(green) AS gs, avg(blue) AS bm, stddev_pop(blue) AS bs, avg(luma) AS lm, stddev_pop(luma) AS ls,
              avg(CASE WHEN hue < 0 THEN hue + 180 ELSE hue END) AS hm, avg(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi * 255 END) AS sm, avg(hi) AS vm FROM h GROUP BY ALL)
    SELECT stream_id, frame_number, cr, cc, round(rm, 7) AS red_mean, round(rs, 7) AS red_std, round(gm, 7) AS green_mean, round(gs, 7) AS green_std, round(bm, 7) AS blue_mean, round(bs, 7) AS blue_std, round(lm, 7) AS luma_mean, round(ls, 7) AS luma_std,
        round(hm, 7) AS hue_mean, round(sm, 7) AS saturation_mean, round(vm, 7) AS value_mean, round(abs(lm - coalesce(lag(lm) OVER (PARTITION BY stream_id, cr, cc ORDER BY frame_number), lm)), 7) AS delta_luma FROM a""")
def _(spark, sf):
    got = frames.cell_features(pixels(spark, sf), 4)
    return got.select("stream_id", "frame_number", "cr", "cc", *(F.round(c, 7).alias(c) for c in got.columns[4:]))


@query("z84_luma", f"WITH {_PIX} SELECT stream_id, frame_number, round(avg(0.299 * red + 0.587 * green + 0.114 * blue), 6) AS luma FROM px GROUP BY ALL")
def _(spark, sf):
    return pixels(spark, sf).groupBy("stream_id", "frame_number").agg(F.round(F.avg(frames.luma(F.col("red"), F.col("green"), F.col("blue"))), 6).alias("luma"))


@query("z85_cell_std", f"WITH {_PIX} SELECT stream_id, frame_number, r // 2 AS cr, c // 2 AS cc, round(avg(red), 6) AS mean, round(stddev_pop(red), 6) AS std FROM px GROUP BY ALL")
def _(spark, sf):
    got = frames.cell_features(pixels(spark, sf), 2)
    return got.select("stream_id", "frame_number", "cr", "cc", F.round("red_mean", 6).alias("mean"), F.round("red_std", 6).alias("std"))


@query("z86_cell_rgb", f"WITH {_PIX} SELECT stream_id, frame_number, r // 4 AS cr, c // 4 AS cc, round(avg(red), 6) AS red, round(avg(green), 6) AS green, round(avg(blue), 6) AS blue FROM px GROUP BY ALL")
def _(spark, sf):
    got = frames.cell_features(pixels(spark, sf), 4)
    return got.select("stream_id", "frame_number", "cr", "cc", *(F.round(f"{c}_mean", 6).alias(c) for c in ("red", "green", "blue")))


_SCENE = f"""WITH {_CELL_SQL}, ce AS (SELECT stream_id, frame_number, (x + 1) * 127.5 AS luma, d AS motion, abs(x) AS edge, x * x AS texture, i FROM dl),
    b AS (SELECT stream_id, frame_number, (i // 8) // 2 AS br, (i % 8) // 2 AS bc, avg(d) AS m FROM dl GROUP BY ALL),
    bs AS (SELECT stream_id, frame_number, sum(m) AS t, avg(m) AS em, stddev_pop(m) AS es, coalesce(sum(m) FILTER (WHERE br = 1 AND bc = 1), 0) AS ct, max(m) - avg(m) AS st FROM b GROUP BY ALL),
    cs AS (SELECT stream_id, frame_number, max(luma) / 255 AS fl, avg((motion <= 0.001)::INT) AS sr, sum(edge) AS hf, avg(texture) AS lf FROM ce GROUP BY ALL)"""


@query("w16_scene", _SCENE + """ SELECT bs.stream_id, bs.frame_number, round(t, 6) AS energy_total, round(em, 6) AS energy_mean, round(es, 6) AS energy_std, round(CASE WHEN t <> 0 THEN ct / t ELSE 0 END, 6) AS center_energy_ratio,
    round(fl, 6) AS flash, round(sr, 6) AS static_ratio, round(hf, 6) AS highfreq, round(lf, 6) AS lowfreq, round(st, 6) AS stutter FROM bs JOIN cs ON cs.stream_id = bs.stream_id AND cs.frame_number = bs.frame_number""")
def _(spark, sf):
    d = frames.deltas(grids(spark, sf))
    own = d.select("stream_id", "frame_number", F.explode(F.arrays_zip(F.col("cells").alias("x"), F.col("delta").alias("d"))).alias("v")).select("stream_id", "frame_number", ((F.col("v.x") + 1) * 127.5).alias("luma"), F.col("v.d").alias("motion"), F.abs("v.x").alias("edge"), (F.col("v.x") * F.col("v.x")).alias("texture"))
    got = frames.scene_resonance(own, frames.blocks(d.select("stream_id", "frame_number", F.col("delta").alias("cells")), 8, 2), 4, 4)
    return got.select("stream_id", "frame_number", *(F.round(c, 6).alias(c) for c in got.columns[2:]))


@query("z83_motion_blocks", f"WITH {_CELL_SQL} SELECT stream_id, frame_number, (i // 8) // 4 AS br, (i % 8) // 4 AS bc, round(avg(d), 6) AS mean FROM dl GROUP BY ALL")
def _(spark, sf):
    d = frames.deltas(grids(spark, sf)).select("stream_id", "frame_number", F.col("delta").alias("cells"))
    return frames.blocks(d, 8, 4).withColumn("mean", F.round("mean", 6))


@query("z88_statistics", f"WITH {_CELL_SQL}, e AS (SELECT stream_id, frame_number, sum(d) AS t FROM dl GROUP BY ALL) SELECT stream_id, count(*)::BIGINT AS frames, round(avg(t), 6) AS mean_energy, round(max(t), 6) AS peak FROM e GROUP BY stream_id")
def _(spark, sf):
    e = frames.energy(grids(spark, sf))
    return e.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("energy_total"), 6).alias("mean_energy"), F.round(F.max("energy_total"), 6).alias("peak"))


_BOX = "bx AS (SELECT l_orderkey AS page_id, l_linenumber AS component_id, l_quantity::INT * 4 AS x1, l_suppkey % 7 * 20 AS y1, l_quantity::INT * 4 + 60 AS x2, l_suppkey % 7 * 20 + 30 AS y2, l_returnflag AS display FROM lineitem)"


def boxes(spark, sf):
    q, y = F.col("l_quantity").cast("int") * 4, F.col("l_suppkey") % 7 * 20
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("component_id"), q.alias("x1"), y.alias("y1"), (q + 60).alias("x2"), (y + 30).alias("y2"), F.col("l_returnflag").alias("display"))


@query("j21_overlaps", f"WITH {_BOX} SELECT DISTINCT a.page_id, a.component_id AS a, b.component_id AS b FROM bx a JOIN bx b ON a.page_id = b.page_id AND a.component_id < b.component_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2")
def _(spark, sf):
    return visual.overlaps(boxes(spark, sf))


@query("v2_reading", f"""WITH {_BOX}, s AS (SELECT page_id, y1 AS line, x1, x2, display, CASE WHEN x1 - lag(x2) OVER w >= 8 THEN ' ' ELSE '' END || display AS piece FROM bx WINDOW w AS (PARTITION BY page_id, y1 ORDER BY x1, x2, display))
    SELECT page_id, line, string_agg(piece, '' ORDER BY x1, x2, display, piece) AS text FROM s GROUP BY ALL""")
def _(spark, sf):
    b = boxes(spark, sf)
    return visual.reading_text(b.withColumn("line", F.col("y1"))).select("page_id", "line", "text")


_BITS = "bm AS (SELECT c_custkey, list_transform(range(3), lambda i: list_aggregate(list_transform(range(6), lambda j: CASE WHEN (c_custkey >> (i * 6 + j)) % 2 = 1 THEN '#' ELSE '.' END), 'string_agg', '')) AS p FROM customer)"
_BOXED = """ik AS (SELECT c_custkey, p, list_filter(range(1, 4), lambda i: contains(p[i], '#')) AS rs, list_filter(range(1, 7), lambda j: len(list_filter(p, lambda r: substr(r, j::INT, 1) = '#')) > 0) AS cs FROM bm),
    ib AS (SELECT c_custkey, CASE WHEN len(rs) = 0 THEN '' ELSE array_to_string(list_transform(p[rs[1]:rs[-1]], lambda r: substr(r, cs[1]::INT, (cs[-1] - cs[1] + 1)::INT)), chr(10)) END AS box FROM ik)"""


def bitmaps(spark, sf):
    bit = lambda i, j: F.when((F.col("c_custkey") / F.lit(float(2 ** (i * 6 + j)))).cast("long") % 2 == 1, "#").otherwise(".")
    rows = F.array(*(F.concat(*(bit(i, j) for j in range(6))) for i in range(3)))
    return table(spark, sf, "customer").select("c_custkey", rows.alias("pattern"))


@query("v1_ink_box", f"WITH {_BITS}, {_BOXED} SELECT c_custkey, box FROM ib")
def _(spark, sf):
    return bitmaps(spark, sf).select("c_custkey", F.array_join(visual.ink_box(F.col("pattern")), "\n").alias("box"))


@query("j20_glyphs", f"WITH {_BITS}, {_BOXED}, k AS (SELECT box, min('g' || c_custkey) AS display FROM ib WHERE c_custkey <= 40 GROUP BY box) SELECT c_custkey, sha256(ib.box) AS hash, coalesce(display, '') AS display FROM ib LEFT JOIN k ON k.box = ib.box")
def _(spark, sf):
    own = bitmaps(spark, sf)
    glyphs = own.select("pattern", F.concat(F.lit("g"), "c_custkey").alias("display"), (F.col("c_custkey") <= 40).alias("approved"))
    return visual.recognise(own, glyphs).select("c_custkey", "hash", "display")


@query("z80_aspect", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_partkey > 0 THEN (p_partkey // gcd(p_partkey, p_size))::VARCHAR || ':' || (p_size // gcd(p_partkey, p_size))::VARCHAR ELSE 'unknown' END AS aspect FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", visual.aspect_ratio(F.col("p_partkey"), F.col("p_size")).alias("aspect"))


@query("z76_order", """SELECT doc_id, list_filter(s, lambda t: list_contains(v, t))[1:len(list_filter(v, lambda t: list_contains(s, t)))] = list_filter(v, lambda t: list_contains(s, t)) AS same FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s, list_sort(string_split(coalesce(text, ''), chr(10))) AS v FROM documents)""")
def _(spark, sf):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs(spark, sf).select("doc_id", visual.order_matches(lines, F.array_sort(lines)).alias("same"))


@query("i21_agreement")
def _(spark, sf):
    first = F.get(F.split("text", "\n"), F.lit(0))
    pairs = docs(spark, sf).select("doc_id", first.alias("source_text"), F.regexp_replace(first, "e", "c").alias("visual_text"))
    return visual.agreement_kind(pairs).select("doc_id", "agreement")


@query("t10_evidence", f"""WITH b AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents), bb AS (SELECT d * 100000 + k AS bid, text FROM b), {_tokens("bb", "bid", "t")},
    s AS (SELECT source_id AS bid, list(anchor ORDER BY pos) AS a, count(DISTINCT anchor) AS n FROM t GROUP BY ALL), h AS (SELECT bid, a, n, list_sort(list_filter([{_ASK}], lambda x: list_contains(a, x))) AS h FROM s),
    p AS (SELECT source_id AS bid, pos, anchor FROM t WHERE anchor IN ({_ASK})), e AS (SELECT bid FROM h WHERE len(h) = {len(QUESTION)}),
    o AS (SELECT x.bid, x.pos, y.anchor AS other, arg_min(y.pos, (abs(y.pos - x.pos), y.pos)) AS near FROM p x JOIN e ON e.bid = x.bid JOIN p y ON y.bid = x.bid AND y.anchor <> x.anchor GROUP BY ALL),
    sp AS (SELECT bid, min(greatest(hi, pos) - least(lo, pos) + 1) AS span FROM (SELECT bid, pos, max(near) AS hi, min(near) AS lo FROM o GROUP BY ALL) GROUP BY bid),
    sc AS (SELECT h.bid // 100000 AS source_id, h.bid % 100000 AS block_id, array_to_string(h, ' ') AS hits, round(len(h) * 100 + len(h) / greatest(1, n) + coalesce(greatest(0.0, 90.0 - span * 12), 0.0), 6) AS score FROM h LEFT JOIN sp USING (bid) WHERE len(h) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, block_id) AS k FROM sc) SELECT source_id, block_id::INT AS block_id, hits, score FROM r WHERE k <= 8 ORDER BY score DESC, source_id, block_id LIMIT 12""")
def _(spark, sf):
    blocks = docs(spark, sf).select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("block_id", "text"))
    return search.evidence(blocks, QUESTION)


@query("t12_spans", f"""WITH {TOKS}, p AS (SELECT source_id, pos, anchor FROM toks WHERE anchor IN ({_ASK})), e AS (SELECT source_id FROM p GROUP BY source_id HAVING count(DISTINCT anchor) = {len(QUESTION)}),
    o AS (SELECT x.source_id, x.pos, y.anchor AS other, arg_min(y.pos, (abs(y.pos - x.pos), y.pos)) AS near FROM p x JOIN e ON e.source_id = x.source_id JOIN p y ON y.source_id = x.source_id AND y.anchor <> x.anchor GROUP BY ALL)
    SELECT source_id, min(greatest(hi, pos) - least(lo, pos) + 1)::INT AS span FROM (SELECT source_id, pos, max(near) AS hi, min(near) AS lo FROM o GROUP BY ALL) GROUP BY source_id""")
def _(spark, sf):
    return search.spans(relations.placed_anchors(docs(spark, sf)), QUESTION, ["source_id"])


@query("t26_excerpts", """SELECT conv_id, turn, substr(text, greatest(1, CASE WHEN instr(lower(text), 'the') > 0 THEN instr(lower(text), 'the') WHEN instr(lower(text), 'of') > 0 THEN instr(lower(text), 'of') ELSE 1 END - 180), 500) AS excerpt FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", search.excerpt(F.col("text"), ["the", "of"]).alias("excerpt"))


@query("t21_choose", f"""WITH {TOKS}, {PAIRS}, nr AS (SELECT anchor, neighbor, sum(observations)::BIGINT AS n FROM rel GROUP BY ALL),
    f AS (SELECT neighbor AS anchor, sum(n)::BIGINT AS n FROM nr WHERE anchor IN ({_ASK}) AND neighbor NOT IN ({_ASK}, {_GLUE_SQL}) GROUP BY neighbor ORDER BY n DESC, neighbor LIMIT 18),
    pool AS (SELECT anchor, row_number() OVER (ORDER BY n DESC, anchor) AS place, n / max(n) OVER () AS current FROM f),
    a AS (SELECT nr.*, neighbor NOT IN ({_GLUE_SQL}) AND neighbor <> anchor AS solid FROM nr WHERE anchor IN (SELECT anchor FROM pool)),
    rk AS (SELECT *, CASE WHEN solid THEN row_number() OVER (PARTITION BY anchor ORDER BY solid DESC, n DESC, neighbor) END AS r FROM a),
    h AS (SELECT anchor, count_if(r <= 6 AND neighbor NOT IN ({_ASK}))::BIGINT AS content, sum(CASE WHEN neighbor IN ({_GLUE_SQL}) THEN n ELSE 0 END) / sum(n) AS glue, count_if(neighbor IN ({_ASK}))::BIGINT AS backlinks FROM rk GROUP BY anchor)
    SELECT anchor, content, backlinks, content >= 2 AND glue <= 0.45 AS healthy, round(current + content / 6 + backlinks * 0.12::DOUBLE - glue * 0.6::DOUBLE - CASE WHEN content >= 2 AND glue <= 0.45 THEN 0.0::DOUBLE ELSE 0.55::DOUBLE END, 4) AS score
    FROM pool JOIN h USING (anchor) ORDER BY score DESC, place, anchor LIMIT 6""")
def _(spark, sf):
    near = lookahead.totals(relations.corpus_relations(docs(spark, sf)))
    return lookahead.choose(near, QUESTION).select("anchor", "content", "backlinks", "healthy", "score")


@query("t20_skim", f"""WITH {TOKS}, {PAIRS}, nr AS (SELECT anchor, neighbor, sum(observations)::BIGINT AS n FROM rel GROUP BY ALL),
    a AS (SELECT neighbor AS w, sum(n) AS n FROM nr WHERE anchor IN ({_ASK}) AND neighbor NOT IN ({_ASK}, {_GLUE_SQL}) GROUP BY ALL ORDER BY n DESC, w LIMIT 6),
    b AS (SELECT neighbor AS w, sum(n) AS n FROM nr WHERE anchor IN (SELECT w FROM a) AND neighbor NOT IN ({_ASK}, {_GLUE_SQL}) AND neighbor NOT IN (SELECT w FROM a) GROUP BY ALL ORDER BY n DESC, w LIMIT 6),
    c AS (SELECT neighbor AS w, sum(n) AS n FROM nr WHERE anchor IN (SELECT w FROM b) AND neighbor NOT IN ({_ASK}, {_GLUE_SQL}) AND neighbor NOT IN (SELECT w FROM a) AND neighbor NOT IN (SELECT w FROM b) GROUP BY ALL ORDER BY n DESC, w LIMIT 6)
    SELECT 1 AS level, w AS anchor FROM a UNION ALL SELECT 2, w FROM b UNION ALL SELECT 3, w FROM c""")
def _(spark, sf):
    levels, _why = lookahead.skim(lambda front: lookahead.totals(relations.corpus_relations(docs(spark, sf), asked=front)), QUESTION)
    return spark.createDataFrame([(i, a) for i, level in enumerate(levels, 1) for a in level], "level int, anchor string")


@query("g4_debug", f"""WITH {TOKS}, l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents), n AS (SELECT 'document' AS type, doc_id::VARCHAR AS id FROM documents UNION ALL SELECT 'line', doc_id || '/' || l FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS k FROM n) SELECT type, count(*)::BIGINT AS n, string_agg(id, ' ' ORDER BY id) FILTER (WHERE k <= 25) AS "first" FROM r GROUP BY type""")
def _(spark, sf):
    nodes, _e = graph.document_graph(docs(spark, sf))
    return graph.debug_export(nodes.where("type in ('document', 'line')")).withColumn("first", F.array_join("first", " "))


@query("t27_slice", """WITH d AS (SELECT min(doc_id) AS d FROM documents), l AS (SELECT generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l, doc_id FROM documents WHERE doc_id = (SELECT d FROM d))
    SELECT 'document-line' AS type, doc_id::VARCHAR AS a, doc_id || '/' || l AS b FROM l""")
def _(spark, sf):
    _n, edges = graph.document_graph(docs(spark, sf))
    first = docs(spark, sf).agg(F.min("doc_id")).first()[0]
    return graph.graph_slice(edges, str(first), 1, 500)[1]


@query("f10_decompose", f"WITH {TOKS} SELECT anchor, length(anchor) >= 2 AND regexp_matches(anchor, '[\\p{{L}}\\p{{N}}]') AS taken FROM (SELECT DISTINCT anchor FROM toks)")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf)).select("anchor", X.may_decompose(F.col("anchor")).alias("taken"))


@query("p22_snippets")
def _(spark, sf):
    from tessera.operators import edits

    return edits.snippets(docs(spark, sf).select("doc_id", "text"), QUESTION).select("doc_id", "snippet")


@query("z31_kinds", f"""SELECT p_name AS phrase, CASE WHEN len(list_filter(w, lambda x: x IN ({_GLUE_SQL}))) = 0 THEN 'concept' WHEN w[1] IN ({_GLUE_SQL}) OR w[-1] IN ({_GLUE_SQL}) THEN 'director_or_structure' ELSE 'concept_with_director' END AS kind FROM (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part)""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("phrase")).distinct()
    found = rows.select("phrase", F.size(F.split("phrase", " ")).alias("n"), F.lit(2).alias("occurrences"), F.lit(1).alias("sources"), F.lit(1.0).alias("stability"))
    return phrases.scored(found).select("phrase", "kind")


@query("z59_transcript", """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    return search.transcripts(table(spark, sf, "conversations"))


@query("a35_status", "SELECT role, count(*)::BIGINT AS messages, count(DISTINCT conv_id)::BIGINT AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.char_length("text")).alias("chars"))


@query("h10_row_hash", "SELECT conv_id, turn, sha256(conv_id || chr(31) || turn || chr(31) || role || chr(31) || text) AS hash, left(sha256(conv_id || chr(31) || turn || chr(31) || role || chr(31) || text), 12) AS short FROM conversations")
def _(spark, sf):
    return search.row_hashes(table(spark, sf, "conversations"), ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", "hash", "short")


@query("z62_lanes", "SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 255 END AS lane FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("lang").distinct()
    return d.select("lang", X.coded(F.col("lang"), {"en": 0, "de": 1, "es": 2}, 255).alias("lane"))


@query("z63_offsets", "SELECT o_orderkey, CASE WHEN o_custkey % 400 BETWEEN 1 AND 127 THEN (o_custkey % 400)::INT END AS \"offset\" FROM orders")
def _(spark, sf):
    told = F.concat(F.lit("+"), (F.col("o_custkey") % 400).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", X.parsed_offset(told).alias("offset"))


@query("z55_normal", r"SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS text FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.lower(X.collapse(F.coalesce("text", F.lit("")))).alias("text"))


@query("z73_wanted", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS at FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 60")
def _(spark, sf):
    from tessera.operators.lexicon import numbered

    d = table(spark, sf, "documents").where("lang = 'en'")
    return numbered(d, "doc_id").select("doc_id", F.col("i").alias("at")).where("at < 60")


@query("z74_pending_sources", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("z19_focus", "SELECT conv_id, turn, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE w END, ' ') AS focus FROM (SELECT *, list_filter(w, lambda x: x NOT IN ('what', 'does', 'the', 'document', 'say', 'to', 'tell', 'me')) AS f FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM conversations))")
def _(spark, sf):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(questions.focused(words, "what does the document say to tell me".split()), " ").alias("focus"))
