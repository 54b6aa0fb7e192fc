"""Queries of sources and sinks on files made from table rows: a row is one file's name and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.operators import counts, edits, qa, relations, reports
from tessera.registry import _CELLS, KNOWN, PAIRS, QUESTION, TOKS, _hash, cell_rows, docs, known, query, rows_hash, table
from tessera.sources import binary, binary_source, cell_store, counts_json, documents, sinks, steps

_ASK = ", ".join(f"'{a}'" for a in QUESTION)


def made(rows, name, text, charset: str = "UTF-8"):
    """path, content from column expressions."""
    return rows.select(name.alias("path"), F.encode(text, charset).alias("content"))


def read(rows, name, text, charset: str = "UTF-8"):
    return documents.converted(made(rows, name, text, charset)).select("source_name", "text", "converter")


@query("s4_tables", """SELECT n_nationkey || '.csv' AS source_name, 'key | name' || chr(10) || n_nationkey || ' | ' || n_name || chr(10) || 'region | ' || n_regionkey AS text, 'delimited-table' AS converter FROM nation
    UNION ALL SELECT n_nationkey || '.tsv', n_name || ' | ' || n_regionkey, 'delimited-table' FROM nation""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    comma = F.concat(F.lit("key,name\n"), "n_nationkey", F.lit(", "), "n_name", F.lit('\n"region",'), "n_regionkey")
    tabs = F.concat("n_name", F.lit("\t"), "n_regionkey")
    return read(n, F.concat("n_nationkey", F.lit(".csv")), comma).unionByName(read(n, F.concat("n_nationkey", F.lit(".tsv")), tabs))


@query("s6_json", """SELECT c_custkey || '.json' AS source_name, 'root.id | int | ' || c_custkey || chr(10) || 'root.name | str | ' || c_name || chr(10) || 'root.tags.0 | str | ' || c_mktsegment || chr(10) || 'root.tags.1 | object | empty' AS text, 'json-structure' AS converter FROM customer""")
def _(spark, sf):
    body = F.concat(F.lit('{"id": '), "c_custkey", F.lit(', "name": "'), "c_name", F.lit('", "tags": ["'), "c_mktsegment", F.lit('", {}]}'))
    return read(table(spark, sf, "customer"), F.concat("c_custkey", F.lit(".json")), body)


@query("s7_xml", """SELECT s_suppkey || '.xml' AS source_name, s_name || chr(10) || s_nationkey || chr(10) || 'tail' AS text, 'xml-structure' AS converter FROM supplier""")
def _(spark, sf):
    body = F.concat(F.lit("<r><a>"), "s_name", F.lit("</a> <b k='x'>"), "s_nationkey", F.lit("</b>tail</r>"))
    return read(table(spark, sf, "supplier"), F.concat("s_suppkey", F.lit(".xml")), body)


@query("s8_html", """SELECT n_nationkey || '.html' AS source_name, n_name || chr(10) || n_nationkey || ' | ' || n_regionkey AS text, 'html-text' AS converter FROM nation""")
def _(spark, sf):
    body = F.concat(F.lit("<html><style>p{}</style><p>"), "n_name", F.lit("</p><script>x()</script><table><tr><td>"), "n_nationkey", F.lit("</td><th> "), "n_regionkey", F.lit("</th></tr></table></html>"))
    return read(table(spark, sf, "nation"), F.concat("n_nationkey", F.lit(".html")), body)


@query("s12_rtf", """SELECT r_regionkey || '.rtf' AS source_name, r_name || ' bold' AS text, 'rtf-text' AS converter FROM region""")
def _(spark, sf):
    body = F.concat(F.lit("{\\rtf1\\ansi "), "r_name", F.lit(" \\b bold}"))
    return read(table(spark, sf, "region"), F.concat("r_regionkey", F.lit(".rtf")), body)


@query("s3_encodings", """SELECT doc_id || '.txt' AS source_name, regexp_replace(text, '[─-╿]+', ' ', 'g') AS text, 'plain-text' AS converter FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    """Texts as UTF-8, with its mark, and as UTF-16."""
    d = docs(spark, sf).where(F.col("text").isNotNull())
    name, kind = F.concat("doc_id", F.lit(".txt")), F.pmod(F.xxhash64("doc_id"), F.lit(3))
    body = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-16"))
    return documents.converted(d.select(name.alias("path"), body.alias("content"))).select("source_name", "text", "converter")


_KINDS = [(".csv", "delimited-table"), (".html", "html-text"), (".xyz", "plain-text"), (".md", "plain-text"), (".mp4", "video-manifest"), (".mp3", "audio-manifest"), (".gif", "image-metadata"), (".json", "plain-text-fallback"), (".docx", "plain-text-fallback")]


@query("s1_scan", "WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _KINDS) + ") t(suffix, converter)) SELECT p_partkey || suffix AS source_name, converter, sha256(p_name || suffix) AS source_id, strlen(p_name || suffix)::BIGINT AS size FROM part CROSS JOIN k")
def _(spark, sf):
    kinds = F.explode(F.array(*(F.lit(k) for k, _ in _KINDS))).alias("suffix")
    rows = table(spark, sf, "part").select("p_partkey", "p_name", kinds)
    return documents.converted(made(rows, F.concat("p_partkey", "suffix"), F.concat("p_name", "suffix"))).select("source_name", "converter", "source_id", "size")


@query("a20_audit", "WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _KINDS) + ") t(extension, converter)), n AS (SELECT count(*)::BIGINT AS n, sum(strlen(p_name))::BIGINT AS b FROM part) SELECT extension, converter, n AS files, CASE WHEN converter LIKE '%fallback' THEN n ELSE 0 END::BIGINT AS failed, (b + n * strlen(extension))::BIGINT AS bytes FROM k CROSS JOIN n")
def _(spark, sf):
    kinds = F.explode(F.array(*(F.lit(k) for k, _ in _KINDS))).alias("suffix")
    rows = table(spark, sf, "part").select("p_partkey", "p_name", kinds)
    return reports.intake_audit(documents.converted(made(rows, F.concat("p_partkey", "suffix"), F.concat("p_name", "suffix"))))


@query("z95_probe", "WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _KINDS) + ") t(extension, converter)) SELECT extension, converter, (SELECT count(*) FROM part)::BIGINT AS files FROM k")
def _(spark, sf):
    kinds = F.explode(F.array(*(F.lit(k) for k, _ in _KINDS))).alias("suffix")
    rows = table(spark, sf, "part").select("p_partkey", "p_name", kinds)
    return reports.intake_audit(documents.converted(made(rows, F.concat("p_partkey", "suffix"), F.concat("p_name", "suffix")))).select("extension", "converter", "files")


@query("s21_video", "SELECT p_partkey || '.mp4' AS source_name, 'video | bytes=' || strlen(p_name) || ' | sha256=' || sha256(p_name) AS text, 'video-manifest' AS converter FROM part")
def _(spark, sf):
    return read(table(spark, sf, "part"), F.concat("p_partkey", F.lit(".mp4")), F.col("p_name"))


@query("s19_images", "SELECT p_partkey || '.gif' AS source_name, 'GIF | ' || (p_partkey % 65536) || ' | ' || p_size AS probe FROM part")
def _(spark, sf):
    two = lambda c: F.concat(F.substring(F.lpad(F.hex(c % 65536), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c % 65536), 4, "0"), 1, 2))
    body = F.unhex(F.concat(F.lit("474946383961"), two(F.col("p_partkey").cast("long")), two(F.col("p_size").cast("long"))))
    rows = table(spark, sf, "part").select(F.concat("p_partkey", F.lit(".gif")).alias("path"), body.alias("content"))
    return documents.converted(rows).select("source_name", F.regexp_extract("text", r"(GIF .*)$", 1).alias("probe"))


@query("s22_audio", "SELECT s_suppkey || '.wav' AS source_name, '8000 | 2 | ' || (s_suppkey / 16000)::DOUBLE AS probe FROM supplier")
def _(spark, sf):
    """Headers of 44 bytes for two channels at 8,000 samples of 8 bits, and as many bytes of sound as the supplier's key."""
    head = F.unhex(F.lit("524946460000000057415645666D74201000000001000200401F0000803E00000200080064617461" + "00000000"))
    rows = table(spark, sf, "supplier").select(F.concat("s_suppkey", F.lit(".wav")).alias("path"), F.concat(head, F.unhex(F.repeat(F.lit("00"), F.col("s_suppkey").cast("int")))).alias("content"))
    return documents.converted(rows).select("source_name", F.regexp_extract("text", r"\| (8000 \| .*)$", 1).alias("probe"))


@query("p14_repair", "SELECT doc_id, source || ' ’“–é fi' AS text FROM documents")
def _(spark, sf):
    """Texts read in the wrong encoding, mended by the converter's pass over XML."""
    good = F.udf(lambda t: documents.repair(t), "string")  # one short call a row; the converter calls it inside its batch
    bad = "".join(bytes([x]).decode("cp1252") for x in "’“–é".encode())
    return docs(spark, sf).select("doc_id", good(F.concat("source", F.lit(f" {bad} ﬁ"))).alias("text"))


def symbol_cells(spark, sf):
    """Corpus relations whose both ends are in the lexicon, as symbol cells."""
    lex = known(spark, sf)
    rel = relations.corpus_relations(docs(spark, sf))
    both = rel.join(lex.withColumnRenamed("symbol", "root"), "anchor").join(lex.select(F.col("anchor").alias("n"), F.col("symbol").alias("s")), F.col("neighbor") == F.col("n"))
    return both.select("root", F.lit(0).cast("long").alias("root_lane"), F.col("offset").cast("long").alias("offset"), F.col("s").alias("neighbor"), F.lit(1).cast("long").alias("lane"), F.lit(0).cast("long").alias("flags"), F.col("observations").alias("count"))


_SYM = """sy AS (SELECT a.symbol AS root, "offset", b.symbol AS neighbor, sum(observations)::BIGINT AS n FROM rel JOIN lex a ON a.anchor = rel.anchor JOIN lex b ON b.anchor = rel.neighbor GROUP BY ALL)"""
_ROWS = f"""SELECT root, count(*)::BIGINT AS relations, {_hash('"offset"', 'neighbor', 'n')} AS digest FROM sy GROUP BY root"""


def by_root(rows):
    good = rows.where("error is null") if "error" in rows.columns else rows
    return good.groupBy("root").agg(F.count(F.lit(1)).alias("relations"), F.sum(rows_hash(F.col("offset"), F.col("neighbor"), F.col("count"))).alias("digest"))


@query("k2_cells", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} {_ROWS}")
def _(spark, sf):
    """Cells written as bytes, one a root, and read again."""
    files = sinks.cell_files(symbol_cells(spark, sf)).select(F.col("name").alias("path"), "content")
    return by_root(binary.parsed(files, "cell"))


@query("k2_split_cells", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} {_ROWS}")
def _(spark, sf):
    """Cells of 500 rows at most: a frequent root is many files."""
    files = sinks.cell_files(symbol_cells(spark, sf), most=500).select(F.col("name").alias("path"), "content")
    return by_root(binary.parsed(files, "cell"))


@query("k4_maps", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} {_ROWS}")
def _(spark, sf):
    own = symbol_cells(spark, sf).withColumn("part", F.pmod(F.xxhash64("root"), F.lit(32)).cast("string"))
    return by_root(binary.parsed(binary.packed(own, "part", "map", ["root", "offset", "neighbor"]), "map"))


@query("k6_records", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} {_ROWS}")
def _(spark, sf):
    own = symbol_cells(spark, sf).withColumn("part", F.pmod(F.xxhash64("root", "offset"), F.lit(32)).cast("string"))
    return by_root(binary.parsed(binary.packed(own, "part", "records", ["root", "offset", "neighbor"]), "records"))


@query("k16_verify", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} SELECT count(DISTINCT root)::BIGINT AS files, 0::BIGINT AS broken FROM sy")
def _(spark, sf):
    files = sinks.cell_files(symbol_cells(spark, sf)).select(F.col("name").alias("path"), "content")
    return binary.verify(binary.parsed(files, "cell"))


def symbol_stream(spark, sf):
    """The known tokens of each document as a symbol stream; others keep their place, blocked; a line opens a sequence."""
    rows = relations.placed_anchors(docs(spark, sf)).join(known(spark, sf), "anchor", "left")
    return rows.select(F.col("source_id").cast("string").alias("stream_id"), F.col("position").cast("long").alias("ordinal"), F.coalesce("symbol", F.lit(0)).alias("symbol"), F.lit(1).cast("long").alias("lane"), F.lit(0).cast("long").alias("flags"), (F.col("position") % 50 == 0).alias("starts"), F.col("symbol").isNull().alias("blocked"))


@query("k7_symbols", f"""WITH {TOKS}, {KNOWN} SELECT source_id::VARCHAR AS path, count(*)::BIGINT AS symbols, {_hash('pos', 'coalesce(symbol, 0)', 'symbol IS NULL', 'pos % 50 = 0')} AS digest FROM toks LEFT JOIN lex ON lex.anchor = toks.anchor GROUP BY source_id""")
def _(spark, sf):
    got = binary.parsed(binary.packed(symbol_stream(spark, sf), "stream_id", "symbols", ["ordinal"]), "symbols")
    return got.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.sum(rows_hash(F.col("ordinal"), F.col("symbol"), F.col("blocked"), F.col("starts"))).alias("digest"))


@query("j4_sequences", f"""WITH {TOKS}, {KNOWN}, q AS (SELECT source_id, pos, symbol, pos // 50 AS part FROM toks JOIN lex ON lex.anchor = toks.anchor),
    f AS (SELECT a.symbol AS l, (b.pos - a.pos) AS d, b.symbol AS r, count(*)::BIGINT AS n FROM q a JOIN q b ON a.source_id = b.source_id AND a.part = b.part AND b.pos - a.pos BETWEEN 1 AND 6 GROUP BY ALL),
    sy AS (SELECT l AS root, d AS "offset", r AS neighbor, n FROM f UNION ALL SELECT r, -d, l, n FROM f) {_ROWS}""")
def _(spark, sf):
    return by_root(relations.sequence_relations(symbol_stream(spark, sf)))


@query("s28_mirror", f"""WITH {TOKS}, {PAIRS} SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS observations FROM rel WHERE anchor IN ({_ASK}) GROUP BY ALL""")
def _(spark, sf):
    """Counts written as a JSON mirror, a file a group of anchors, and read again."""
    rel = relations.corpus_relations(docs(spark, sf), asked=QUESTION)
    inner = rel.groupBy("anchor", "offset").agg(F.map_from_entries(F.collect_list(F.struct("neighbor", "observations"))).alias("n"))
    outer = inner.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct(F.col("offset").cast("string"), "n"))).alias("o"))
    path = steps.new_folder(spark)
    outer.select("anchor", F.to_json(F.create_map("anchor", "o")).alias("value")).write.partitionBy("anchor").text(path)
    return counts_json.read_count_mirror(spark, f"{path}/*/*.txt")


@query("s29_rows", f"""WITH {TOKS}, {PAIRS} SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS observations FROM rel WHERE anchor IN ({_ASK}) GROUP BY ALL""")
def _(spark, sf):
    """Relation rows as JSON lines, some of them not valid, and the valid ones read again."""
    rel = relations.corpus_relations(docs(spark, sf), asked=QUESTION)
    told = rel.select("anchor", F.concat(F.when(F.col("offset") > 0, "+").otherwise(""), "offset").alias("offset"), "neighbor", F.col("observations").cast("string").alias("observations"))
    bad = spark.createDataFrame([("the", "0", "x", "1"), ("the", "x", "y", "1"), ("", "1", "y", "1"), ("the", "300", "y", "1"), ("the", "1", "y", "none")], told.schema)
    path = steps.new_folder(spark)
    told.unionByName(bad).write.json(path)
    return counts_json.read_relation_rows(spark, path)


@query("s27_packs", "SELECT lower(n_name) AS word, '0x' || lpad(upper(to_hex(n_nationkey)), 10, '0') AS symbol, CASE WHEN n_regionkey = 0 THEN 'AVAILABLE' ELSE 'ASSIGNED' END AS status, n_regionkey::BIGINT AS frequency FROM nation")
def _(spark, sf):
    path = steps.new_folder(spark)
    rows = table(spark, sf, "nation").select(F.lower("n_name").alias("word"), S.symbol_hex(F.col("n_nationkey").cast("long")).alias("hex"), F.when(F.col("n_regionkey") == 0, "AVAILABLE").otherwise("ASSIGNED").alias("status"), F.col("n_regionkey").alias("frequency"))
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)  # the few rows of one pack
    return counts_json.read_packs(spark, path).select("word", "symbol", "status", "frequency")


@query("k8_jsonl", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(spark, sf):
    path = steps.new_folder(spark)
    sinks.write_review(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.schema("c_custkey long, c_name string, c_nationkey int").json(path)


@query("k9_review", "SELECT count(*)::BIGINT AS n FROM part")
def _(spark, sf):
    """Rows of a phrase review by its manifest."""
    told = sinks.write_review(table(spark, sf, "part").select("p_partkey", "p_name"), steps.new_folder(spark))
    return spark.createDataFrame([(told["rows"],)], "n long")


@query("k10_lanes", "SELECT source AS lane, count(*)::BIGINT AS n FROM documents GROUP BY source")
def _(spark, sf):
    path = steps.new_folder(spark)
    sinks.write_lanes(table(spark, sf, "documents").select(F.col("source").alias("lane"), "doc_id"), path)
    return spark.read.json(path).groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


@query("a3_native_merge", f"""WITH {TOKS}, {PAIRS}, {_CELLS} SELECT root, count(*)::BIGINT AS relations, {_hash('"offset"', 'neighbor', 'lane', '"count" * 2')} AS digest FROM cells GROUP BY root""")
def _(spark, sf):
    rows = cell_rows(spark, sf)
    got = counts.merge_into(rows, rows)
    return got.groupBy("root").agg(F.count(F.lit(1)).alias("relations"), F.sum(rows_hash(F.col("offset"), F.col("neighbor"), F.col("lane"), F.col("count"))).alias("digest"))


@query("k3_replace", f"""WITH {TOKS}, {PAIRS}, {_CELLS} SELECT root, count(*)::BIGINT AS relations, sum("count" * CASE WHEN root IN ({_ASK}) THEN 3 ELSE 1 END)::BIGINT AS n FROM cells GROUP BY root""")
def _(spark, sf):
    rows = cell_rows(spark, sf)
    new = rows.where(F.col("root").isin(QUESTION)).withColumn("count", F.col("count") * 3)
    return counts.merge_into(rows, new, "replace").groupBy("root").agg(F.count(F.lit(1)).alias("relations"), F.sum("count").alias("n"))


@query("k3_generations", f"""WITH {TOKS}, {PAIRS}, {_CELLS}, grown AS (SELECT root, "offset", neighbor, "count" * CASE WHEN root IN ({_ASK}) THEN 4 ELSE 2 END AS n FROM cells)
    SELECT root, count(*)::BIGINT AS relations, {_hash('"offset"', 'neighbor', 'n')} AS digest FROM grown GROUP BY root""")
def _(spark, sf):
    """A store of cells after four generations: all rows, some roots replaced by three times theirs, a compaction, all rows again."""
    rows = steps.settled(cell_rows(spark, sf))
    store = cell_store.CellStore(spark, steps.new_folder(spark))
    store.merge(rows)
    store.merge(rows.where(F.col("root").isin(QUESTION)).withColumn("count", F.col("count") * 3), "replace")
    store.compact(2)
    store.merge(rows)
    return by_root(store.rows())


@query("k3_lookup", f"""WITH {TOKS}, {PAIRS}, {_CELLS} SELECT root, count(*)::BIGINT AS relations, {_hash('"offset"', 'neighbor', '"count"')} AS digest FROM cells WHERE root IN ({_ASK}) GROUP BY root""")
def _(spark, sf):
    """Some roots of a store, from their buckets alone."""
    return by_root(cell_store.stored(cell_rows(spark, sf), steps.new_folder(spark)).rows(QUESTION))


def by_format(spark, rows, kind, split=1 << 16):
    """Rows written by the data source and read again by ranges of ``split`` bytes."""
    path = steps.new_folder(spark)
    binary_source.write(rows, path, kind, rows_per_file=1 << 16)
    return binary_source.read(spark, path, kind, split)


@query("s30_maps", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} {_ROWS}")
def _(spark, sf):
    return by_root(by_format(spark, symbol_cells(spark, sf), "map"))


@query("s32_cells", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} {_ROWS}")
def _(spark, sf):
    return by_root(by_format(spark, steps.settled(symbol_cells(spark, sf)), "cell"))


@query("s33_records", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} {_ROWS}")
def _(spark, sf):
    return by_root(by_format(spark, symbol_cells(spark, sf), "records"))


@query("s33_filtered", f"WITH {TOKS}, {PAIRS}, {KNOWN}, {_SYM} SELECT root, neighbor, n AS \"count\" FROM sy WHERE \"offset\" = 1 AND root IN (68719476736, 68719476737, 68719476740)")
def _(spark, sf):
    """Records that an offset and some roots ask for: the reader drops the others before they become rows of Spark."""
    return by_format(spark, symbol_cells(spark, sf), "records").where("offset = 1 and root in (68719476736, 68719476737, 68719476740)").select("root", "neighbor", "count")


@query("s34_symbols", f"""WITH {TOKS}, {KNOWN} SELECT coalesce(symbol, 0)::BIGINT AS symbol, count(*)::BIGINT AS n, count(*) FILTER (WHERE symbol IS NULL)::BIGINT AS blocked, count(*) FILTER (WHERE pos % 50 = 0)::BIGINT AS starts FROM toks LEFT JOIN lex ON lex.anchor = toks.anchor GROUP BY ALL""")
def _(spark, sf):
    got = by_format(spark, symbol_stream(spark, sf).sortWithinPartitions("stream_id", "ordinal"), "symbols")
    return got.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked"), F.count_if("starts").alias("starts"))


@query("a4_conflicts", f"""WITH {TOKS}, {PAIRS} SELECT anchor AS root, 2::BIGINT AS lanes FROM rel GROUP BY anchor HAVING count(DISTINCT "offset" > 0) = 2""")
def _(spark, sf):
    rows = relations.corpus_relations(docs(spark, sf)).select(F.col("anchor").alias("root"), (F.col("offset") > 0).cast("int").alias("root_lane"))
    return counts.root_lane_conflicts(rows)


@query("a8_merge_indexes", f"WITH {TOKS} SELECT anchor, (count(*) * 2)::BIGINT AS n FROM toks GROUP BY anchor")
def _(spark, sf):
    c = relations.token_counts(docs(spark, sf))
    return counts.union_counts(c, c, keys=["anchor"], count="n")


@query("a21_readiness", "SELECT (SELECT count(*) FROM documents)::BIGINT AS raw, (SELECT count(DISTINCT doc_id) FROM labels)::BIGINT AS maps, (SELECT count(*) FROM documents WHERE lang = 'en')::BIGINT AS flat, (SELECT count(*) FROM documents d WHERE d.lang <> 'en' OR d.lang IS NULL OR d.doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS missing")
def _(spark, sf):
    d, own = table(spark, sf, "documents").withColumnRenamed("doc_id", "source_id"), table(spark, sf, "labels").withColumnRenamed("doc_id", "source_id")
    return reports.readiness(d, own, d.where("lang = 'en'"))


@query("p21_locators", r"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)),
    b AS (SELECT *, regexp_matches(line, '\S') AS solid FROM l), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b WHERE solid)
    SELECT doc_id AS source_id, (row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1)::INT AS paragraph_id, min(i)::INT AS line_start, max(i)::INT AS line_end FROM g GROUP BY doc_id, g""")
def _(spark, sf):
    return edits.paragraph_lines(docs(spark, sf))


@query("p23_edits", r"""SELECT doc_id, regexp_replace(text, '(?i)(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])', '\1\2') = text AS untouched FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    rows = edits.edit_mentions(docs(spark, sf).where(F.col("text").isNotNull()), {"the": None})
    return rows.select("doc_id", (F.col("n_edits") == 0).alias("untouched"))


@query("p24_choices", """SELECT p_name || '?' AS question_text, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS answer_text, CASE WHEN p_brand = p_type THEN '' WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS others FROM part""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.concat("p_name", F.lit("?")).alias("question"), F.array(F.lit("A"), F.lit("B")).alias("labels"), F.array("p_brand", "p_type").alias("texts"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("1").alias("answer_key"))
    return qa.multiple_choice(rows, "part").select("question_text", "answer_text", F.array_join("blocked_alternatives", " ").alias("others"))


@query("p27_final_answers", "SELECT o_orderkey::VARCHAR AS question_text, o_custkey::VARCHAR AS answer_text FROM orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("question"), F.concat(F.lit("so it is\n#### "), "o_custkey", F.lit(" ")).alias("answer"))
    return qa.word_problems(rows, "orders").select("question_text", "answer_text")
