"""The queries opN_<name> and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat import conversation_digests, format_conversations, read_back
from tessera.llm.cover_tree import near_vectors
from tessera.llm.decontaminate import contaminated
from tessera.llm.html_text import extract_text
from tessera.llm.impact import search
from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.merkle import digest, fold, manifest, siblings_digest
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.pieces import digests, encode_documents
from tessera.llm.ppm import score_documents
from tessera.llm.surrogates import surrogate_documents
from tessera.llm.toxicity import default_categories, fit_chain, score_chain
from tessera.llm.url_rank import Rule, judge

#: For the test tables only; a run on real data sets spark.tessera.surrogateKey.
TEST_KEY = "key of the test tables"
URL_RULES = [
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), default_categories())
    return score_chain(docs, chain, "toxic").drop("text")


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_documents(table(spark, sf_dir, "documents"), held_out, order=5)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_hash", "group_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_documents(docs, decoded_col="decoded"))


def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op8_url_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES).drop("url", "html")


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.tessera.surrogateKey", TEST_KEY)
    return surrogate_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is made of control strings, formatted to ids and read back from them."""
    hostile = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(hostile, "conv_id long, turn long, role string, text string"))
    return conversation_digests(read_back(format_conversations(turns)))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def manifest_of_documents(docs: DataFrame) -> DataFrame:
    """Each document's leaf, roots and proof digest, and the root that follows once every second document (by the crc32 of its
    id) has lost its line ends; a null id sorts first and is not tampered with."""
    fields = lambda text: digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    bad = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", fields(F.col("text")).alias("leaf"), F.when(F.contains("text", F.lit("\n")), fields(bad)).alias("tampered"))
    folded = manifest(leaves, "source", "doc_id").withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it verifies after the tampering."""
    return manifest_of_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_ppm_score": op2_ppm_score,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_html_crf": op7_html_crf,
    "op8_url_rank": op8_url_rank,
    "op9_cover_tree": op9_cover_tree,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_chat_format": op11_chat_format,
    "op12_impact_search": op12_impact_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op11_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (
            SELECT *, len(regexp_extract_all(role || chr(10) || text,
                '<\\*(?:/?s>|unk>|<SYS>>|</SYS>>|\|(?:turn|text|end|im_start|im_end|endoftext)\|>)|\[\\*/?INST\]')) AS more FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               (7 + sum(length('<|turn|><|text|><|end|>') + length(role) + length(text) + more))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    # CRC-32 bit by bit; a node's parent is its place divided by three; proofs and folds go up one level at a time.
    "op13_merkle_manifest": r"""
        WITH RECURSIVE f AS (
            SELECT row_number() OVER () AS rid, doc_id, source, coalesce('s' || source, '') AS grp,
                   list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS head, text,
                   list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: (ord(c)::BIGINT >> k::INT) & 1)))),
                               lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
            FROM documents),
        leaves AS (
            SELECT rid, doc_id, grp, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(array_to_string(head, '') || coalesce(strlen(bad) || ':' || bad, '-')) AS tampered
            FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bad FROM f)),
        laid AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
        low AS (
            SELECT grp, 0 AS level, idx, n, leaf AS d FROM laid
            UNION ALL SELECT grp, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY grp, level, idx // 3, n),
        tops AS (SELECT grp, level AS height, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
        high AS (
            SELECT 0 AS level, place AS idx, n, subroot AS d FROM tops
            UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 3, n),
        nodes AS (SELECT grp, level, idx, n, d FROM low UNION ALL SELECT t.grp, t.height + h.level, h.idx, h.n, h.d FROM tops t, high h),
        runs AS (SELECT grp, level, idx // 3 AS run, list(d ORDER BY idx) AS ds FROM nodes WHERE n > 1 GROUP BY grp, level, idx // 3),
        climb AS (
            SELECT rid, l.grp, 0 AS level, CASE WHEN height = 0 THEN place ELSE idx END AS idx, tampered AS d, '' AS proof FROM laid l JOIN tops USING (grp)
            UNION ALL
            SELECT rid, c.grp, c.level + 1, CASE WHEN c.level + 1 = height THEN place ELSE c.idx // 3 END,
                   sha256(array_to_string(ds[:c.idx % 3], '') || c.d || array_to_string(ds[c.idx % 3 + 2:], '')), proof || array_to_string(ds[:c.idx % 3], '') || array_to_string(ds[c.idx % 3 + 2:], '')
            FROM (SELECT c.*, height, place FROM climb c JOIN tops USING (grp)) c JOIN runs r ON r.grp = c.grp AND r.level = c.level AND r.run = c.idx // 3),
        ends AS (SELECT rid, arg_max(d, level) AS folded_root, arg_max(proof, level) AS proof FROM climb GROUP BY rid),
        root AS (SELECT d AS root FROM high WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM laid JOIN ends USING (rid) JOIN tops USING (grp), root""",
    "op12_impact_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        i AS (
            SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
        size AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
        asked AS (SELECT iid, item_id, unnest(w) AS t FROM i),
        tf AS (
            SELECT rid, doc_id, t, count(*)::BIGINT AS tf, any_value(100 - 50 + (50 * n * big_n) // big_l)::BIGINT AS m
            FROM (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d), size GROUP BY rid, doc_id, t),
        df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
        weight AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, size),
        scored AS (
            SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM asked JOIN tf USING (t) JOIN weight USING (t) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    # For items of five words or more, as all of the benchmark's are.
    "op3_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        iw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        ds AS (
            SELECT doc_id, len(w) - 4 AS t, unnest(range(0, len(w) - 4)) AS pos, array_to_string(w[unnest(range(0, len(w) - 4)) + 1:unnest(range(0, len(w) - 4)) + 5], ' ') AS g
            FROM dw WHERE len(w) >= 5),
        sh AS (
            SELECT item_id, n_words, n_words - 4 AS n, g, count(*) AS c FROM (
                SELECT item_id, len(w) AS n_words, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM iw WHERE len(w) >= 5)
            GROUP BY ALL),
        m AS (SELECT doc_id, item_id, n_words, n, t, pos, g, c FROM ds JOIN sh USING (g)),
        starts AS (
            SELECT DISTINCT doc_id, item_id, n_words, n, t, unnest(CASE WHEN t <= n THEN [0::BIGINT] ELSE range(greatest(0, pos - n + 1), least(pos, t - n) + 1) END) AS s FROM m),
        hits AS (
            SELECT a.doc_id, a.item_id, a.n_words, a.n, a.t, a.s, m.g, least(count(*), m.c) AS k FROM starts a
            JOIN m ON m.doc_id = a.doc_id AND m.item_id = a.item_id AND m.pos BETWEEN a.s AND a.s + a.n - 1 GROUP BY a.doc_id, a.item_id, a.n_words, a.n, a.t, a.s, m.g, m.c),
        sim AS (SELECT doc_id, item_id, n_words, s, sum(k)::DOUBLE / (n + least(n, t) - sum(k)) AS similarity FROM hits GROUP BY doc_id, item_id, n_words, n, t, s),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM sim WHERE similarity >= 0.8)
        SELECT doc_id, item_id, similarity, s AS first_word, n_words FROM best WHERE r = 1""",
    "op5_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT low.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, low.doc_id = component_id AS kept
        FROM low LEFT JOIN n ON n.doc_id = low.doc_id""",
    "op9_cover_tree": """
        WITH RECURSIVE e AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT low.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, component_id, low.vec_id = component_id AS kept
        FROM low LEFT JOIN deg ON low.vec_id = deg.vec_id""",
    "op4_line_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (
            SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM docs),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(common.k)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common ON keyed.k = common.k
        GROUP BY rid, doc_id""",
}
