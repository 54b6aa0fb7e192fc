"""Queries of questions and answer candidates; the candidates are the corpus neighbours of the tokens of QUESTION."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import inference, phrases, questions, relations
from tessera.registry import _FOLD, _GRAMS, COUNTS, PAIRS, QUESTION, TOKS, _tokens, docs, query, table

SEEDS = ["the", "of"]
_LIST = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_STOP, _ASK, _SEEDS = _LIST(["", *questions.ANSWER_STOP]), _LIST(QUESTION), _LIST(SEEDS)
_SLOTS = _LIST([w for words in questions.SLOT_WORDS.values() for w in words])


def talk(spark, sf):
    """Conversation turns as queries: conv_id, turn, distinct tokens in order."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", X.surfaces(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", F.array_distinct(X.anchors(F.col("s"))).alias("anchors"))


_TALK = rf"""cv AS (SELECT conv_id * 1000 + turn AS cid, text FROM conversations), {_tokens("cv", "cid", "ct")},
    own AS (SELECT source_id AS cid, anchor, min(pos) AS p FROM ct GROUP BY ALL),
    tk AS (SELECT cid // 1000 AS conv_id, cid % 1000 AS turn, coalesce(a, []) AS a FROM (SELECT conv_id * 1000 + turn AS cid FROM conversations)
           LEFT JOIN (SELECT cid, list(anchor ORDER BY p) AS a FROM own GROUP BY cid) USING (cid))"""
_Q = r"q AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS q FROM conversations)"


@query("i9_frames", rf"""WITH {_Q}, k AS (SELECT *, CASE WHEN regexp_matches(q, '(?i)^why\s+(.+?)\??$') THEN 1 WHEN regexp_matches(q, '(?i)^how\s+(?:does|do|did|is|are|can|could|should)?\s*(.+?)\??$') THEN 2
        WHEN regexp_matches(q, '(?i)^what\s+(?:is|are|was|were)?\s*(.+?)\??$') THEN 3 WHEN regexp_matches(q, '(?i)^which\s+(.+?)\??$') THEN 4 WHEN regexp_matches(q, '(?i)^who\s+(?:is|was)?\s*(.+?)\??$') THEN 5
        WHEN regexp_matches(q, '(?i)^when\s+(.+?)\??$') THEN 6 WHEN regexp_matches(q, '(?i)^where\s+(.+?)\??$') THEN 7
        WHEN regexp_matches(q, '(?i)^(?:compare|contrast)\s+(.+?)\s+(?:and|with|to)\s+(.+?)\??$') THEN 8
        WHEN regexp_matches(q, '(?i)^does\s+(.+?)\s+(imply|mean|cause|prove|show)\s+(.+?)\??$') THEN 9 ELSE 10 END AS k FROM q),
    s AS (SELECT *, trim(CASE k WHEN 1 THEN regexp_extract(q, '(?i)^why\s+(.+?)\??$', 1) WHEN 2 THEN regexp_extract(q, '(?i)^how\s+(?:does|do|did|is|are|can|could|should)?\s*(.+?)\??$', 1)
        WHEN 3 THEN regexp_extract(q, '(?i)^what\s+(?:is|are|was|were)?\s*(.+?)\??$', 1) WHEN 4 THEN regexp_extract(q, '(?i)^which\s+(.+?)\??$', 1)
        WHEN 5 THEN regexp_extract(q, '(?i)^who\s+(?:is|was)?\s*(.+?)\??$', 1) WHEN 6 THEN regexp_extract(q, '(?i)^when\s+(.+?)\??$', 1) WHEN 7 THEN regexp_extract(q, '(?i)^where\s+(.+?)\??$', 1)
        WHEN 8 THEN regexp_replace(q, '\?+$', '') WHEN 9 THEN regexp_extract(q, '(?i)^does\s+(.+?)\s+(imply|mean|cause|prove|show)\s+(.+?)\??$', 1) ELSE q END) AS subject,
        CASE WHEN k = 8 THEN regexp_extract(q, '(?i)^(?:compare|contrast)\s+(.+?)\s+(?:and|with|to)\s+(.+?)\??$', 1) ELSE '' END AS l,
        CASE WHEN k = 8 THEN regexp_extract(q, '(?i)^(?:compare|contrast)\s+(.+?)\s+(?:and|with|to)\s+(.+?)\??$', 2) ELSE '' END AS r,
        CASE WHEN k = 9 THEN regexp_extract(q, '(?i)^does\s+(.+?)\s+(imply|mean|cause|prove|show)\s+(.+?)\??$', 2) ELSE '' END AS rel,
        CASE WHEN k = 9 THEN regexp_extract(q, '(?i)^does\s+(.+?)\s+(imply|mean|cause|prove|show)\s+(.+?)\??$', 3) ELSE '' END AS o FROM k)
    SELECT conv_id, turn, ['why_causal', 'how_process', 'what_definition', 'which_selection', 'who_identity', 'when_time', 'where_place', 'compare_two', 'does_imply', 'fallback_open'][k] AS pattern,
        ['causal_explanation', 'process_explanation', 'definition', 'selection_check', 'identity', 'time_lookup', 'place_lookup', 'comparison', 'implication_check', 'open_educational_frame'][k] AS frame_type,
        subject, l AS "left", r AS "right", rel AS relation, o AS object,
        CASE k WHEN 1 THEN 'Explain why ' || subject || ' happens and what evidence supports it.' WHEN 2 THEN 'Explain how ' || subject || ' works, including the main steps or mechanism.'
            WHEN 3 THEN 'Identify what ' || subject || ' is and give the category or defining property.' WHEN 4 THEN 'Select which statement or candidate fits ' || subject || ' and explain the basis.'
            WHEN 5 THEN 'Identify who ' || subject || ' refers to and why that identity fits.' WHEN 6 THEN 'Identify when ' || subject || ' occurred or what time/date relation is requested.'
            WHEN 7 THEN 'Identify where ' || subject || ' is located or where the event belongs.' WHEN 8 THEN 'Compare ' || l || ' and ' || r || ' by shared and differing properties.'
            WHEN 9 THEN 'Check whether ' || subject || ' implies ' || rel || ' and explain the evidence.' ELSE 'Determine what kind of answer ' || subject || ' requests before gathering facts.' END AS reasoning,
        round(CASE WHEN k = 10 THEN 0.55::DOUBLE ELSE 0.72::DOUBLE END + 0.03::DOUBLE + CASE WHEN ends_with(q, '?') THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 3) AS confidence FROM s""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", questions.frame(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


@query("z70_cloud_keys", f"""SELECT conv_id, turn, CASE {" ".join(f"WHEN starts_with(q, '{k} ') THEN '{k}'" for k in "why how what which who when where does".split())}
    WHEN starts_with(q, 'compare ') OR starts_with(q, 'contrast ') THEN 'compare' ELSE 'open' END AS key FROM (SELECT conv_id, turn, trim({_FOLD.format("lower(coalesce(text, ''))")}) AS q FROM conversations)""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", questions.cloud_key(F.col("text")).alias("key"))


@query("a27_frame_rules", rf"""WITH q AS (SELECT conv_id * 1000 + turn AS cid, trim({_FOLD.format("lower(coalesce(text, ''))")}) AS q FROM conversations),
    k AS (SELECT *, CASE WHEN regexp_matches(q, '^(why|how|what|which|who|when|where|does) ') THEN split_part(q, ' ', 1) WHEN regexp_matches(q, '^(compare|contrast) ') THEN 'compare' ELSE 'open' END AS key FROM q),
    w AS (SELECT key, unnest(list_filter(regexp_extract_all(q, '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_LIST(questions.CLOUD_STOP)}))) AS w FROM k),
    n AS (SELECT key, w, count(*)::BIGINT AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, w) AS r FROM n)
    SELECT k.key, k.rows_n, coalesce(t.terms, '') AS terms FROM (SELECT key, count(*)::BIGINT AS rows_n FROM k GROUP BY key) k
    LEFT JOIN (SELECT key, string_agg(w || ':' || n, ' ' ORDER BY r) AS terms FROM r WHERE r <= 40 GROUP BY key) t USING (key)""")
def _(spark, sf):
    from tessera.operators import reports

    rows = table(spark, sf, "conversations").select(questions.cloud_key(F.col("text")).alias("key"), "text")
    told = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["w"], t["n"])), " ")
    return reports.frame_rules(rows).select("key", F.col("rows").alias("rows_n"), F.coalesce(told, F.lit("")).alias("terms"))


@query("z71_content_words", f"""SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all({_FOLD.format("lower(coalesce(text, ''))")}, '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_LIST(questions.CLOUD_STOP)})), ' ') AS words FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(questions.content_words(F.col("text")), " ").alias("words"))


_GATE = rf"""CASE WHEN § IN ({_ASK}) THEN 'query_echo' WHEN § IN ({_STOP}) THEN 'glue_as_content' WHEN regexp_matches(§, '[^\p{{L}}\p{{N}}''\-]') OR § IN ('''', '-') THEN 'punctuation_as_content'
    WHEN regexp_full_match(§, '\p{{Nd}}+') THEN 'number_as_content' ELSE '' END""".replace("§", _FOLD.format("anchor"))


@query("f5_blocked", rf"""WITH {TOKS}, {COUNTS} SELECT anchor, ({_FOLD.format("anchor")} IN ({_STOP}) OR starts_with(anchor, '<') OR ends_with(anchor, '>') OR contains(anchor, 'xml')
    OR regexp_full_match(anchor, '[^\p{{L}}\p{{N}}]') OR regexp_full_match(anchor, '\p{{Nd}}+')) AS blocked FROM cnt""")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf)).select("anchor", questions.blocked_answer(F.col("anchor")).alias("blocked"))


@query("f6_gate", f"WITH {TOKS}, {COUNTS} SELECT anchor, {_GATE} AS reason FROM cnt")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf)).select("anchor", questions.gate_reason(F.col("anchor"), QUESTION).alias("reason"))


@query("f7_content", rf"""WITH {_TALK}, b AS (SELECT conv_id, turn, a, list_filter(a, lambda x: NOT ({_FOLD.format("x")} IN ({_STOP}) OR starts_with(x, '<') OR ends_with(x, '>') OR contains(x, 'xml')
    OR regexp_full_match(x, '[^\p{{L}}\p{{N}}]') OR regexp_full_match(x, '\p{{Nd}}+'))) AS c FROM tk) SELECT conv_id, turn, array_to_string(CASE WHEN len(c) > 0 THEN c ELSE a END, ' ') AS content FROM b""")
def _(spark, sf):
    return talk(spark, sf).select("conv_id", "turn", F.array_join(questions.content(F.col("anchors")), " ").alias("content"))


_DIRECTS = _LIST([*questions.AUXILIARY, *questions.RELATION, *questions.ARTICLES, *questions.DIRECTORS, *questions.PRONOUNS, *questions.MARKS])


@query("z1_query_frame", f"""WITH {_TALK} SELECT conv_id, turn, CASE WHEN list_contains(a, 'how') THEN 'method_question' WHEN len(list_filter(a, lambda x: x IN ('what', 'why', 'when', 'where', 'who'))) > 0 THEN 'question' ELSE 'statement' END AS frame,
    array_to_string(list_filter(a, lambda x: x NOT IN ({_DIRECTS})), ' ') AS content, array_to_string(list_filter(a, lambda x: x IN ({_DIRECTS})), ' ') AS directors FROM tk""")
def _(spark, sf):
    rows = questions.query_frame(talk(spark, sf).select(F.struct("conv_id", "turn").alias("query_id"), "anchors"))
    return rows.select("query_id.*", "frame", F.array_join("content", " ").alias("content"), F.array_join("directors", " ").alias("directors"))


@query("z1_roles", f"""WITH {TOKS}, {COUNTS} SELECT anchor, CASE WHEN anchor IN ({_LIST(questions.AUXILIARY)}) THEN 'auxiliary' WHEN anchor IN ({_LIST(questions.RELATION)}) THEN 'relation_director' WHEN anchor IN ({_LIST(questions.ARTICLES)}) THEN 'article_glue'
    {" ".join(f"WHEN anchor = '{k}' THEN '{v}'" for k, v in (questions.DIRECTORS | questions.PRONOUNS).items())} WHEN anchor IN ({_LIST(questions.MARKS)}) THEN 'punctuation' ELSE 'content' END AS role,
    CASE WHEN anchor IN ({_LIST(questions.AUXILIARY)}) THEN 0.2::DOUBLE WHEN anchor IN ({_LIST(questions.RELATION)}) THEN 0.35::DOUBLE WHEN anchor IN ({_LIST(questions.ARTICLES)}) THEN 0.1::DOUBLE
         WHEN anchor IN ({_LIST(questions.DIRECTORS)}) THEN 1.0::DOUBLE WHEN anchor IN ({_LIST(questions.PRONOUNS)}) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM cnt""")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf)).select("anchor", questions.token_role(F.col("anchor")).alias("r")).select("anchor", "r.*")


@query("i17_frame", rf"""WITH {_TALK} SELECT conv_id, turn, CASE WHEN len(list_intersect(a, [{_LIST(questions.DOCUMENT_TERMS)}])) > 0 THEN 'document_question' WHEN len(list_intersect(a, [{_LIST(questions.SYSTEM_TERMS)}])) > 0 THEN 'system_question' ELSE 'educational_question' END AS activity,
    CASE WHEN a[1] = 'why' THEN 'causal_explanation' WHEN a[1] = 'how' THEN 'process_explanation' WHEN a[1] = 'who' THEN 'who_entity' WHEN a[1] IN ('what', 'which') THEN 'definition'
         WHEN a[1] IN ('does', 'do', 'is', 'are') THEN 'implication_check' WHEN list_contains(a, 'compare') THEN 'comparison' ELSE 'open_educational_frame' END AS frame_type,
    array_to_string(list_filter(a, lambda x: x NOT IN ({_LIST(questions.SUBJECT_GLUE)}) AND NOT regexp_matches(x, '\p{{Nd}}'))[1:8], ' ') AS subject,
    CASE frame_type WHEN 'causal_explanation' THEN 'purpose mechanism consequence' WHEN 'process_explanation' THEN 'steps mechanism' WHEN 'definition' THEN 'category defining_property'
         WHEN 'implication_check' THEN 'claim evidence_for evidence_against' WHEN 'comparison' THEN 'left right basis' WHEN 'who_entity' THEN 'entity identity_support' ELSE 'support' END AS required FROM tk""")
def _(spark, sf):
    rows = talk(spark, sf).select("conv_id", "turn", questions.inference_frame(F.col("anchors")).alias("f")).select("conv_id", "turn", "f.*")
    return rows.withColumn("required", F.array_join("required", " "))


def candidates(spark, sf):
    """anchor, context (roots), offsets, n, of the neighbours of QUESTION in the corpus."""
    rel = relations.corpus_relations(docs(spark, sf), asked=QUESTION)
    return rel.groupBy(F.col("neighbor").alias("anchor")).agg(F.array_sort(F.collect_set("anchor")).alias("context"), F.array_sort(F.collect_set("offset")).alias("offsets"), F.sum("observations").alias("n"))


_CAND = f"""c AS (SELECT neighbor AS anchor, list_sort(list_distinct(list(anchor))) AS context, list_sort(list_distinct(list("offset"))) AS offsets, sum(observations)::BIGINT AS n FROM rel WHERE anchor IN ({_ASK}) GROUP BY neighbor)"""
_DIRECTION = """least(1.0, CASE WHEN offsets[1] < 0 OR offsets[-1] > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN offsets[1] < 0 AND offsets[-1] > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    + least(0.25::DOUBLE, list_sum(list_transform(offsets, lambda o: 1.0::DOUBLE / abs(o))) / len(offsets)))"""
_SCORE = f"round((0.3::DOUBLE * (len(context) / 3) + 0.05::DOUBLE * least(1.0::DOUBLE, n / 100)) * 0.45::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE + ({_DIRECTION}) * 0.2::DOUBLE + least(1.0::DOUBLE, len(context) / 3 + least(1.0::DOUBLE, n / 100) * 0.25::DOUBLE) * 0.15::DOUBLE, 6)"


def scored(rows):
    told = F.transform("offsets", X.offset_text)
    parts = {"question_fit": F.size("context") / 3.0, "source_support": F.least(F.lit(1.0), F.col("n") / 100.0)}
    return rows.withColumn("score", questions.cloud_match(parts, F.lit(0.5), told, F.col("context")))


@query("i11_scores", f"WITH {TOKS}, {PAIRS}, {_CAND} SELECT anchor, {_SCORE} AS score FROM c")
def _(spark, sf):
    return scored(candidates(spark, sf)).select("anchor", "score")


@query("i12_directional", f"WITH {TOKS}, {PAIRS}, {_CAND} SELECT anchor, round({_DIRECTION}, 6) AS score FROM c")
def _(spark, sf):
    return candidates(spark, sf).select("anchor", F.round(questions.directional_score(F.transform("offsets", X.offset_text)), 6).alias("score"))


def judged(spark, sf):
    none = F.array().cast("array<string>")
    held = questions.coherence(F.col("context"), none, none, none, F.array(*map(F.lit, SEEDS)))["coherent"]
    rows = scored(candidates(spark, sf)).withColumns({
        "health": F.when(F.col("n") >= 3, "supported").otherwise("thin"), "coherent": held, "rejected": questions.gate_reason(F.col("anchor"), QUESTION),
        "pattern_health": F.when(F.array_max("offsets") < 0, "anomalous").otherwise("healthy"), "subject": F.lit("the force of"), "frame_type": F.lit("definition"),
    })
    return questions.gated(rows)


_JUDGED = f"""j AS (SELECT anchor, {_SCORE} AS score, CASE WHEN n < 3 THEN 'unsupported_answer_health' WHEN len(list_intersect(context, [{_SEEDS}])) = 0 THEN 'query_field_mismatch'
    WHEN {_GATE} <> '' THEN {_GATE} WHEN offsets[-1] < 0 THEN 'anomalous_future_shape'
    WHEN anchor NOT IN ({_LIST(questions.DOMAIN_TERMS)}) AND len(list_intersect(context, ['the', 'force', 'of'])) < 2 THEN 'off_frame_domain' ELSE 'candidate_passed_inference_gates' END AS reason FROM c)"""


@query("f12_gates", f"""WITH {TOKS}, {PAIRS}, {_CAND}, {_JUDGED} SELECT anchor, reason, CASE reason WHEN 'unsupported_answer_health' THEN 'R_FACT_SUPPORT' WHEN 'query_field_mismatch' THEN 'R_QUERY_FIELD' WHEN 'anomalous_future_shape' THEN 'R_LOOKAHEAD_HEALTH'
    WHEN 'off_frame_domain' THEN 'R_FRAME_DOMAIN' WHEN 'candidate_passed_inference_gates' THEN 'R_ADMIT_SUPPORTED_CANDIDATE' ELSE 'R_PREVIOUS_REJECTION' END AS rule, reason = 'candidate_passed_inference_gates' AS accepted FROM j""")
def _(spark, sf):
    return judged(spark, sf).select("anchor", "reason", "rule", "accepted")


@query("f14_domain", f"""WITH {TOKS}, {PAIRS}, {_CAND} SELECT anchor, anchor NOT IN ({_LIST(questions.DOMAIN_TERMS)}) AND len(list_intersect(context, ['the', 'force', 'of'])) < 2 AS off FROM c""")
def _(spark, sf):
    return candidates(spark, sf).select("anchor", questions.off_domain(F.col("anchor"), F.lit("the force of?"), F.col("context")).alias("off"))


@query("i13_inference", f"""WITH {TOKS}, {PAIRS}, {_CAND}, {_JUDGED}, r AS (SELECT anchor, score, row_number() OVER (ORDER BY score DESC, anchor) AS k FROM j WHERE reason = 'candidate_passed_inference_gates')
    SELECT anchor, score, k::INT AS "rank" FROM r WHERE k <= 6""")
def _(spark, sf):
    top = judged(spark, sf).where("accepted").orderBy(F.desc("score"), "anchor").limit(6)  # the plan names so many
    from pyspark.sql import Window as W

    return top.select("anchor", "score", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "anchor")).alias("rank"))


@query("a31_metrics", f"""WITH {TOKS}, {PAIRS}, {_CAND}, {_JUDGED}, a AS (SELECT *, reason = 'candidate_passed_inference_gates' AS ok FROM j)
    SELECT count_if(ok)::BIGINT AS admitted, count_if(NOT ok)::BIGINT AS rejected, coalesce(round(avg(score) FILTER (WHERE ok), 6), 0) AS mean_score, count_if(ok) = 0 AS no_admitted_answer_path,
           count_if(NOT ok) > 0 AS some_count_candidates_rejected_by_inference, count_if(ok AND score < 0.35) > 0 AS weak_cloud_match_support FROM a""")
def _(spark, sf):
    return questions.support_metrics(judged(spark, sf))


@query("a31_rejections", f"""WITH {TOKS}, {PAIRS}, {_CAND}, {_JUDGED} SELECT reason, count(*)::BIGINT AS n FROM j WHERE reason <> 'candidate_passed_inference_gates' GROUP BY reason""")
def _(spark, sf):
    return judged(spark, sf).where("not accepted").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("z8_coherence", f"""WITH {TOKS}, {PAIRS}, {_CAND} SELECT anchor, len(list_intersect(context, [{_SEEDS}])) > 0 AS coherent, CASE WHEN len(list_intersect(context, [{_SEEDS}])) > 0 THEN 'candidate_attached_to_query_field' ELSE 'no_query_seed_support' END AS reason FROM c""")
def _(spark, sf):
    none = F.array().cast("array<string>")
    return candidates(spark, sf).select("anchor", questions.coherence(F.col("context"), none, none, none, F.array(*map(F.lit, SEEDS))).alias("c")).select("anchor", "c.*")


@query("z9_support_fit", f"WITH {TOKS}, {PAIRS}, {_CAND} SELECT anchor, round(least(1.0::DOUBLE, len(context) / 3), 6) AS fit FROM c")
def _(spark, sf):
    return candidates(spark, sf).select("anchor", F.round(questions.support_fit(F.col("context"), F.array(*map(F.lit, QUESTION))), 6).alias("fit"))


@query("i2_penalties", f"""WITH {TOKS}, {PAIRS}, {_CAND} SELECT anchor, CASE WHEN anchor IN ('first', 'second') THEN 1.25::DOUBLE ELSE 0.0::DOUBLE END AS ordinal, CASE WHEN anchor NOT IN ({_ASK}, {_SLOTS}) THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS question_drift,
    CASE WHEN anchor NOT IN ('the', {_SLOTS}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS phrase_drift FROM c""")
def _(spark, sf):
    own, phrase, none = F.array(*map(F.lit, QUESTION)), F.array(F.lit("the")), F.array().cast("array<string>")
    return candidates(spark, sf).select(
        "anchor", questions.ordinal_penalty(F.col("anchor"), F.array(F.lit("the"), F.lit("third"))).alias("ordinal"), questions.drift_penalty(F.col("anchor"), own, none, F.lit(True)).alias("question_drift"),
        questions.drift_penalty(F.col("anchor"), own, phrase, F.lit(True)).alias("phrase_drift"))


@query("i8_guidance", f"""WITH {TOKS}, {PAIRS}, {_CAND} SELECT anchor, round(CASE WHEN anchor IN ('force', 'of') THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN list_contains(context, 'of') THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN list_contains(context, 'the') THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN anchor IN ({_LIST(questions.FITTING[("definition",)][0])}) THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END, 6) AS boost,
    CASE WHEN len(list_intersect(list_append(context, anchor), ['force', 'of', 'the'])) = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM c""")
def _(spark, sf):
    none = F.array().cast("array<string>")
    g = questions.guidance(F.col("anchor"), F.lit("definition"), F.lit("force of"), F.col("context"), F.array(F.lit("the")), none)
    return candidates(spark, sf).select("anchor", g.alias("g")).select("anchor", "g.*")


@query("z13_slots", f"""WITH {_TALK}, h AS (SELECT conv_id, turn, len(a) > 0 AS s, len(list_intersect(a, [{_LIST(questions.SLOT_WORDS["category"])}])) > 0 AS c, len(list_intersect(a, [{_LIST(questions.SLOT_WORDS["mechanism"])}])) > 0 AS m,
    len(list_intersect(a, ['first', 'second', 'third', 'three'])) >= 2 AS p FROM tk) SELECT conv_id, turn, concat_ws(' ', CASE WHEN s THEN 'subject' END, CASE WHEN c THEN 'category' END, CASE WHEN m THEN 'mechanism' END, CASE WHEN p THEN 'parts' END) AS satisfied,
    concat_ws(' ', CASE WHEN NOT s THEN 'subject' END, CASE WHEN NOT c THEN 'category' END) AS missing FROM h""")
def _(spark, sf):
    state = questions.slot_state(F.array(F.lit("subject"), F.lit("category")), F.col("anchors"), F.array().cast("array<string>"))
    return talk(spark, sf).select("conv_id", "turn", state.alias("s")).select("conv_id", "turn", F.array_join("s.satisfied", " ").alias("satisfied"), F.array_join("s.missing", " ").alias("missing"))


@query("i10_length", f"""WITH {_TALK}, n AS (SELECT conv_id, turn, len(a) AS n, len(list_intersect(a, [{_LIST(questions.SLOT_WORDS["mechanism"])}])) > 0 AS ok FROM tk)
    SELECT conv_id, turn, n >= 3 AND (ok OR n >= 12) AND n >= 6 AS stop, CASE WHEN n >= 12 THEN 'max_anchor_count_reached' WHEN n < 3 THEN 'below_min_anchor_count' WHEN NOT ok THEN 'required_slots_missing'
    WHEN n < 6 THEN 'below_target_anchor_count' ELSE 'stop_allowed' END AS reason FROM n""")
def _(spark, sf):
    none = F.array().cast("array<string>")
    done = F.size(questions.slot_state(F.array(F.lit("mechanism")), F.col("anchors"), none)["missing"]) == 0
    state = questions.length_state(questions.length_policy(6, 3, None, 12), F.size("anchors"), done)
    return talk(spark, sf).select("conv_id", "turn", state.alias("s")).select("conv_id", "turn", "s.*")


@query("z14_policy", "SELECT * FROM (VALUES (1, 0, 6, 6), (2, 3, 6, 12), (3, 2, 2, 2), (4, 0, 1, 1), (5, 4, 9, 9)) t(k, least, target, most)")
def _(spark, sf):
    asked = [(), (6, 3, None, 12), (6, 5, 9, 2), (0, None, None, 0), (20, 4, 30, 9)]
    return spark.createDataFrame([(k, *questions.length_policy(*a)) for k, a in enumerate(asked, 1)], "k int, least int, target int, most int")


@query("f16_headings", rf"""WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), l AS (SELECT doc_id * 100000 + i AS lid, text FROM ln), {_tokens("l", "lid", "lt")},
    c AS (SELECT source_id AS lid, count_if(regexp_matches(anchor, '\p{{L}}')) AS n FROM lt GROUP BY ALL), s AS (SELECT lid, trim(text) AS s, coalesce(n, 0) AS n, trim(regexp_replace(lower(trim(text)), '^[# ]+', '')) AS low FROM l LEFT JOIN c USING (lid))
    SELECT lid // 100000 AS doc_id, count(*)::BIGINT AS lines, count_if(s = '' OR CASE WHEN starts_with(s, '#') OR starts_with(low, 'lesson ') OR starts_with(low, 'answered checks') OR starts_with(low, 'compact answer field') THEN n <= 8 ELSE ends_with(low, ':') AND n <= 4 END)::BIGINT AS headings FROM s GROUP BY ALL""")
def _(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("text")).withColumn("s", X.surfaces(F.col("text")))
    letters = F.size(F.filter(X.anchors(F.col("s")), lambda a: a.rlike(r"\p{L}")))
    rows = lines.select("doc_id", questions.heading_only(F.col("text"), letters).alias("h"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("h").alias("headings"))


@query("z25_fact_text", r"""WITH s AS (SELECT doc_id, trim(replace(replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 'Question:', ''), 'Answer:', ''), ' -') AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 420 THEN s ELSE regexp_replace(CASE WHEN contains(left(s, 420), ' ') THEN regexp_replace(left(s, 420), ' [^ ]*$', '') ELSE left(s, 420) END, '[ ,;:]+$', '') || '.' END AS fact FROM s""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", questions.fact_text(F.col("text")).alias("fact"))


CATEGORIES = [("license", ["license", "copyright"]), ("german", [" und ", " der "]), ("spanish", [" que ", " de la "])]


@query("f17_category", """SELECT doc_id, CASE WHEN contains(h, 'license') OR contains(h, 'copyright') THEN 'license' WHEN contains(h, ' und ') OR contains(h, ' der ') THEN 'german'
    WHEN contains(h, ' que ') OR contains(h, ' de la ') THEN 'spanish' ELSE 'general_documents' END AS category FROM (SELECT doc_id, coalesce(source, '') || chr(10) || coalesce(text, '') AS h FROM documents)""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", questions.content_category(F.col("source"), F.col("text"), CATEGORIES, "general_documents").alias("category"))


@query("j23_match_phrase", f"""WITH {TOKS}, {_GRAMS}, ph AS (SELECT phrase AS pid, g AS s, len(g) AS n FROM cand WHERE n IN (3, 4) AND occurrences >= 5),
    cv AS (SELECT conv_id * 1000 + turn AS cid, text FROM conversations), {_tokens("cv", "cid", "ct")}, qa AS (SELECT source_id AS cid, list(anchor ORDER BY pos) AS a FROM ct GROUP BY source_id),
    p1 AS (SELECT cid, pid, s, n, a, list_position(a, s[1]) AS p FROM (SELECT DISTINCT source_id AS cid, anchor FROM ct) t JOIN ph ON s[1] = anchor JOIN qa USING (cid)),
    p2 AS (SELECT *, list_position(a[p + 1:], s[2]) AS d2 FROM p1), p3 AS (SELECT *, CASE WHEN coalesce(d2, 0) > 0 THEN list_position(a[p + d2 + 1:], s[3]) END AS d3 FROM p2),
    p4 AS (SELECT *, CASE WHEN coalesce(d3, 0) > 0 AND n = 4 THEN list_position(a[p + d2 + d3 + 1:], s[4]) END AS d4 FROM p3),
    h AS (SELECT cid, pid, n, 1 + (coalesce(d2, 0) > 0)::INT + (coalesce(d3, 0) > 0)::INT + (coalesce(d4, 0) > 0)::INT AS hits FROM p4),
    b AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY hits * 10 + n DESC, pid) AS k FROM h WHERE hits >= greatest(2, n - 1))
    SELECT (cid // 1000) || '/' || (cid % 1000) AS query_id, pid AS phrase_id, hits::INT AS hits FROM b WHERE k = 1""")
def _(spark, sf):
    top = phrases.mined(phrases.streams(docs(spark, sf)), 3, 4, 5).select(F.col("phrase").alias("phrase_id"), F.split("phrase", " ").alias("sequence"))
    asked = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), X.surfaces(F.col("text")).alias("s")).select("query_id", X.anchors(F.col("s")).alias("anchors"))
    return inference.match_phrase(asked, top)
