"""Questions: the frame a question asks for, roles of its tokens, and the gates, scores and limits of answer candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import casefold

# Words that can't be an answer, stop words of frame clouds, words of a document request, and terms of one domain.
ANSWER_STOP = """ . , ? ! : ; ( ) [ ] { } a an and about able also are as at be but by can could did do does for following from had has
    have how i if in information into is it learning may more one of on only or other our own questions should source that the their
    these they this to was were we what when where which who why with would will using your you""".split()
CLOUD_STOP = "a an and are as at be by can did do does for from how in is it of on or that the this to what when where which who why with would".split()
DOMAIN_TERMS = "acceleration accelerate energy force forces gravity inertia law laws mass motion newton object physics velocity".split()
DIRECTORS = {"how": "question_method", "what": "question_identity", "why": "question_cause", "when": "question_time", "where": "question_place", "who": "question_actor"}
AUXILIARY = "do does did is are was were can should would could".split()
RELATION = "of to for with from in on by as at into over under".split()
ARTICLES = "the a an".split()
PRONOUNS = {"i": "speaker_subject", "me": "speaker_object", "you": "user_target", "we": "speaker_group", "it": "reference_subject", "they": "reference_group"}
MARKS = list(""".,?!:;()[]{}"'-/\\""")
SUBJECT_GLUE = "a an the about of to for from in on with and or is are was were be being been do does did why what how who when where which ?".split()
SYSTEM_TERMS = "status server ui settings lexicon counts ingest intake".split()
DOCUMENT_TERMS = "source document docs citation evidence passage".split()
REQUIRED_SLOTS = {
    "causal_explanation": ["purpose", "mechanism", "consequence"], "process_explanation": ["steps", "mechanism"], "definition": ["category", "defining_property"],
    "implication_check": ["claim", "evidence_for", "evidence_against"], "comparison": ["left", "right", "basis"], "who_entity": ["entity", "identity_support"],
}
SLOT_WORDS = {
    "category": "law laws principle principles rule rules".split(),
    "mechanism": "force forces mass acceleration accelerate motion move object objects".split(),
    "parts": "first second third three pair pairs".split(),
}
#: Question patterns in order: id, frame type, template and expression; the first that fits decides.
PATTERNS = [
    ("why_causal", "causal_explanation", "Explain why <subject> happens and what evidence supports it.", r"^why\s+(.+?)\??$"),
    ("how_process", "process_explanation", "Explain how <subject> works, including the main steps or mechanism.", r"^how\s+(?:does|do|did|is|are|can|could|should)?\s*(.+?)\??$"),
    ("what_definition", "definition", "Identify what <subject> is and give the category or defining property.", r"^what\s+(?:is|are|was|were)?\s*(.+?)\??$"),
    ("which_selection", "selection_check", "Select which statement or candidate fits <subject> and explain the basis.", r"^which\s+(.+?)\??$"),
    ("who_identity", "identity", "Identify who <subject> refers to and why that identity fits.", r"^who\s+(?:is|was)?\s*(.+?)\??$"),
    ("when_time", "time_lookup", "Identify when <subject> occurred or what time/date relation is requested.", r"^when\s+(.+?)\??$"),
    ("where_place", "place_lookup", "Identify where <subject> is located or where the event belongs.", r"^where\s+(.+?)\??$"),
    ("compare_two", "comparison", "Compare <left> and <right> by shared and differing properties.", r"^(?:compare|contrast)\s+(.+?)\s+(?:and|with|to)\s+(.+?)\??$"),
    ("does_imply", "implication_check", "Check whether <subject> implies <relation> and explain the evidence.", r"^does\s+(.+?)\s+(imply|mean|cause|prove|show)\s+(.+?)\??$"),
]
OPEN = ("fallback_open", "open_educational_frame", "Determine what kind of answer <subject> requests before gathering facts.")
CLOUD_WEIGHTS = {"question_fit": 0.30, "rear_fit": 0.25, "answer_fit": 0.25, "forward_fit": 0.15, "source_support": 0.05}


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def frame(text: Column, support: dict[str, int] | None = None) -> Column:
    """struct<pattern, frame_type, subject, left, right, relation, object, reasoning, confidence> of a question.

    ``support``: how many corpus rows go with each pattern's key (why, how, ..., open), which raises the confidence.
    """
    q, support = cleaned(text), support or {}
    bare = F.regexp_replace(q, r"\?+$", "")
    part = lambda p, g: cleaned(F.regexp_extract(q, f"(?i){p}", g))

    def row(pattern: str, kind: str, template: str, slots: dict[str, Column]) -> Column:
        told = F.lit(template)
        for name, value in slots.items():
            told = F.replace(told, F.lit(f"<{name}>"), value)
        key = "open" if pattern == OPEN[0] else pattern.split("_")[0]
        n = support.get(key, 0)
        sure = (0.55 if pattern == OPEN[0] else 0.72) + min(0.18, n / 5000) + 0.03
        sure = F.round(F.least(F.lit(0.95), F.lit(sure) + F.when(q.endswith("?"), 0.05).otherwise(0.0)), 3)
        get = lambda s: slots.get(s, F.lit(""))
        return F.struct(F.lit(pattern).alias("pattern"), F.lit(kind).alias("frame_type"), get("subject").alias("subject"), get("left").alias("left"), get("right").alias("right"), get("relation").alias("relation"), get("object").alias("object"), told.alias("reasoning"), sure.alias("confidence"))

    out = None
    for pattern, kind, template, p in PATTERNS:
        if kind == "comparison":
            slots = {"left": part(p, 1), "right": part(p, 2), "subject": bare}
        elif kind == "implication_check":
            slots = {"subject": part(p, 1), "relation": part(p, 2), "object": part(p, 3)}
        else:
            slots = {"subject": part(p, 1)}
        fits, got = q.rlike(f"(?i){p}"), row(pattern, kind, template, slots)
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out.otherwise(row(*OPEN, {"subject": F.when(q == "", "").otherwise(q)}))


def cloud_key(text: Column) -> Column:
    """The leading word of a question that has a frame cloud, compare, or open."""
    q = F.trim(casefold(F.coalesce(text, F.lit(""))))
    out = None
    for key in "why how what which who when where does".split():
        out = F.when(q.startswith(f"{key} "), key) if out is None else out.when(q.startswith(f"{key} "), key)
    return out.when(q.startswith("compare ") | q.startswith("contrast "), "compare").otherwise("open")


def token_role(anchor: Column) -> Column:
    """struct<role, weight>: how a token directs a question; role content for all others."""
    as_row = lambda role, w: F.struct(F.lit(role).alias("role"), F.lit(w).alias("weight"))
    out = F.when(anchor.isin(AUXILIARY), as_row("auxiliary", 0.2)).when(anchor.isin(RELATION), as_row("relation_director", 0.35)).when(anchor.isin(ARTICLES), as_row("article_glue", 0.1))
    for word, role in DIRECTORS.items():
        out = out.when(anchor == word, as_row(role, 1.0))
    for word, role in PRONOUNS.items():
        out = out.when(anchor == word, as_row(role, 0.4))
    return out.when(anchor.isin(MARKS), as_row("punctuation", 0.0)).otherwise(as_row("content", 0.0))


def query_frame(queries: DataFrame) -> DataFrame:
    """(query_id, anchors) -> query_id, frame, content, directors: distinct tokens in order, those that direct apart."""
    own = F.array_distinct("anchors")
    director = lambda a: a.isin([*AUXILIARY, *RELATION, *ARTICLES, *DIRECTORS, *PRONOUNS, *MARKS])
    asks = F.exists("own", lambda a: a.isin([d for d in DIRECTORS if d != "how"]))
    kind = F.when(F.array_contains("own", "how"), "method_question").when(asks, "question").otherwise("statement")
    rows = queries.select("query_id", own.alias("own"))
    return rows.select("query_id", kind.alias("frame"), F.filter("own", lambda a: ~director(a)).alias("content"), F.filter("own", director).alias("directors"))


def inference_frame(anchors: Column, mode: str = "") -> Column:
    """struct<activity, frame_type, subject, required> of a query's tokens."""
    has = lambda words: F.arrays_overlap(anchors, _array(words))
    first = F.get(anchors, F.lit(0))
    activity = (
        F.when(has(DOCUMENT_TERMS) | F.lit(mode in ("documents", "document", "maps", "mapped")), "document_question").when(F.lit(mode in ("counts", "count")), "count_question")
        .when(has(SYSTEM_TERMS), "system_question").otherwise("educational_question")
    )
    kind = (
        F.when(first == "why", "causal_explanation").when(first == "how", "process_explanation").when(first == "who", "who_entity").when(first.isin("what", "which"), "definition")
        .when(first.isin("does", "do", "is", "are"), "implication_check").when(F.array_contains(anchors, "compare"), "comparison").otherwise("open_educational_frame")
    )
    kept = F.slice(F.filter(anchors, lambda a: ~a.isin(SUBJECT_GLUE) & ~a.rlike(r"\p{Nd}")), 1, 8)
    required = reduce(lambda c, k: c.when(kind == k, _array(REQUIRED_SLOTS[k])), list(REQUIRED_SLOTS)[1:], F.when(kind == "causal_explanation", _array(REQUIRED_SLOTS["causal_explanation"])))
    return F.struct(activity.alias("activity"), kind.alias("frame_type"), F.array_join(kept, " ").alias("subject"), required.otherwise(_array(["support"])).alias("required"))


def blocked_answer(anchor: Column) -> Column:
    """Whether a token can't be an answer by itself: a stop word, markup, a lone mark or a number."""
    a = casefold(F.trim(F.coalesce(anchor, F.lit(""))))
    return (a == "") | a.isin(ANSWER_STOP) | a.startswith("<") | a.endswith(">") | a.contains("xml") | a.rlike(r"^[^\p{L}\p{N}]$") | a.rlike(r"^\p{Nd}+$")


def gate_reason(anchor: Column, blocked: list[str]) -> Column:
    """Why a token isn't taken as content; empty if it is."""
    a = casefold(F.trim(F.coalesce(anchor, F.lit(""))))
    return (
        F.when(a.isin(blocked), "query_echo").when((a == "") | a.isin(ANSWER_STOP), "glue_as_content").when(a.rlike(r"[^\p{L}\p{N}'\-]") | a.rlike("^['-]$"), "punctuation_as_content")
        .when(a.rlike(r"^\p{Nd}+$"), "number_as_content").otherwise("")
    )


def content(anchors: Column) -> Column:
    """The tokens that can be answers; all of them if none can."""
    kept = F.filter(anchors, lambda a: ~blocked_answer(a))
    return F.when(F.size(kept) > 0, kept).otherwise(anchors)


def content_words(text: Column) -> Column:
    """Lower-case words and numbers of two characters or more that aren't stop words of frame clouds."""
    words = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(CLOUD_STOP))


def directional_score(offsets: Column) -> Column:
    """A half for any direction, a quarter for both, and up to a quarter for nearness; offsets are texts such as +1."""
    near = F.filter(F.transform(offsets, lambda o: F.expr("1").cast("int") * F.replace(o, F.lit("+"), F.lit("")).try_cast("int")), lambda o: o.isNotNull())
    ahead, behind = F.exists(near, lambda o: o > 0), F.exists(near, lambda o: o < 0)
    base = F.when(ahead | behind, 0.5).otherwise(0.0) + F.when(ahead & behind, 0.25).otherwise(0.0)
    close = F.aggregate(near, F.lit(0.0), lambda a, o: a + 1.0 / F.greatest(F.lit(1), F.abs(o))) / F.greatest(F.lit(1), F.size(near))
    return F.when(F.size(near) > 0, F.least(F.lit(1.0), base + F.least(F.lit(0.25), close))).otherwise(0.0)


def cloud_match(parts: dict[str, Column], lookahead: Column, offsets: Column, context: Column) -> Column:
    """The four parts of a candidate's match with the cloud, weighted .45, .20, .20 and .15."""
    local = reduce(lambda a, b: a + b, (F.coalesce(parts[k], F.lit(0.0)) * w for k, w in CLOUD_WEIGHTS.items() if k in parts), F.lit(0.0))
    layered = F.least(F.lit(1.0), F.greatest(F.lit(0.0), lookahead))
    support = F.least(F.lit(1.0), F.size(F.array_distinct(context)) / 3.0 + F.coalesce(parts.get("source_support", F.lit(0.0)), F.lit(0.0)) * 0.25)
    return F.round(local * 0.45 + layered * 0.20 + directional_score(offsets) * 0.20 + support * 0.15, 6)


def off_domain(anchor: Column, subject: Column, context: Column) -> Column:
    """Whether a subject of the domain gets a candidate outside it that fewer than two subject terms support."""
    terms = F.array_distinct(F.filter(F.split(F.translate(subject, "?.", "  "), r"\s+"), lambda t: t != ""))
    return F.arrays_overlap(terms, _array(DOMAIN_TERMS)) & (anchor != "") & ~anchor.isin(DOMAIN_TERMS) & (F.size(F.array_intersect(context, terms)) < 2)


def gated(candidates: DataFrame) -> DataFrame:
    """Candidates (anchor, health, coherent, rejected, pattern_health, subject, frame_type, context) with rule, reason and
    accepted: the first gate that rejects. Null health or coherence: not asked."""
    said = lambda rule, reason: F.struct(F.lit(rule).alias("rule"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    needs = F.col("frame_type").isin("causal_explanation", "process_explanation", "implication_check", "definition", "who_entity")
    got = (
        F.when(F.col("health").isNotNull() & ~F.col("health").isin("supported", "accepted"), said("R_FACT_SUPPORT", "unsupported_answer_health"))
        .when(~F.coalesce("coherent", F.lit(True)), said("R_QUERY_FIELD", "query_field_mismatch"))
        .when(F.coalesce("rejected", F.lit("")) != "", said("R_PREVIOUS_REJECTION", F.col("rejected")))
        .when(F.coalesce("pattern_health", F.lit("healthy")) == "anomalous", said("R_LOOKAHEAD_HEALTH", "anomalous_future_shape"))
        .when(off_domain(F.col("anchor"), F.col("subject"), F.col("context")), said("R_FRAME_DOMAIN", "off_frame_domain"))
        .when(needs & (F.size("context") == 0), said("R_FACT_SUPPORT", "no_context_support"))
        .otherwise(said("R_ADMIT_SUPPORTED_CANDIDATE", "candidate_passed_inference_gates"))
    )
    rows = candidates.withColumn("__g", got)
    return rows.select(*candidates.columns, F.col("__g.rule").alias("rule"), F.col("__g.reason").alias("reason"), (F.col("__g.rule") == "R_ADMIT_SUPPORTED_CANDIDATE").alias("accepted"))


def support_metrics(judged: DataFrame, score: str = "score") -> DataFrame:
    """admitted, rejected, mean_score and the three uncertainty notes over judged candidates."""
    zero = F.lit(0).cast("long")
    row = judged.agg(F.count_if("accepted").alias("admitted"), F.count_if(~F.col("accepted")).alias("rejected"), F.round(F.avg(F.when(F.col("accepted"), F.col(score))), 6).alias("mean"), F.count_if(F.col("accepted") & (F.col(score) < 0.35)).alias("weak"))
    return row.select(
        F.coalesce("admitted", zero).alias("admitted"), F.coalesce("rejected", zero).alias("rejected"), F.coalesce("mean", F.lit(0.0)).alias("mean_score"),
        (F.col("admitted") == 0).alias("no_admitted_answer_path"), (F.col("rejected") > 0).alias("some_count_candidates_rejected_by_inference"), (F.col("weak") > 0).alias("weak_cloud_match_support"),
    )


def slot_state(required: Column, content_anchors: Column, emitted: Column) -> Column:
    """struct<satisfied, missing>: slots that the query's content or the answer so far fills; parts need two ordinals."""
    own = F.array_distinct(F.concat(content_anchors, emitted))
    hits = {k: F.array_intersect(own, _array(w)) for k, w in SLOT_WORDS.items()}
    two = F.size(F.array_intersect(own, _array(["first", "second", "third", "three"]))) >= 2
    tests = [("subject", F.array_contains(required, "subject") & (F.size(content_anchors) > 0)), ("category", F.size(hits["category"]) > 0), ("mechanism", F.size(hits["mechanism"]) > 0), ("parts", two)]
    done = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests)))
    return F.struct(done.alias("satisfied"), F.array_except(required, done).alias("missing"))


def length_policy(limit: int = 6, least: int | None = None, target: int | None = None, most: int | None = None) -> tuple[int, int, int]:
    """Least, target and most tokens of an answer, each within the next."""
    high = max(1, most if most is not None else limit or 6)
    low = min(max(0, least or 0), high)
    return low, max(low, min(high, target if target is not None else max(low, min(high, limit or high)))), high


def length_state(policy: tuple[int, int, int], emitted: Column, slots_done: Column) -> Column:
    """struct<stop, reason> after so many tokens."""
    low, target, high = policy
    reason = (
        F.when(emitted >= high, "max_anchor_count_reached").when(emitted < low, "below_min_anchor_count").when(~slots_done, "required_slots_missing")
        .when(emitted < target, "below_target_anchor_count").otherwise("stop_allowed")
    )
    stop = (emitted >= low) & (slots_done | (emitted >= high)) & ((emitted >= target) | (emitted >= high))
    return F.struct(stop.alias("stop"), reason.alias("reason"))


def coherence(context: Column, question: Column, rear: Column, answer: Column, seeds: Column) -> Column:
    """struct<coherent, reason>: whether a candidate hangs on the query's seeds or on the answer so far."""
    direct = F.array_intersect(F.array_union(context, question), seeds)
    onward = F.array_union(answer, F.array_except(rear, seeds))
    ok = (F.size(direct) > 0) | (F.size(onward) > 0)
    reason = F.when(F.size(seeds) == 0, "no_seed_field_required").when(ok, "candidate_attached_to_query_field").otherwise("no_query_seed_support")
    return F.struct((ok | (F.size(seeds) == 0)).alias("coherent"), reason.alias("reason"))


def support_fit(supporting: Column, cloud: Column) -> Column:
    """Distinct supporters over distinct cloud members, one at most; nothing for an empty cloud."""
    n = F.size(F.array_distinct(cloud))
    return F.when(n > 0, F.least(F.lit(1.0), F.size(F.array_distinct(supporting)) / n)).otherwise(0.0)


def ordinal_penalty(anchor: Column, question: Column) -> Column:
    has = lambda w: F.array_contains(question, w)
    return F.when((has("first") & (anchor == "second")) | (has("second") & (anchor == "first")) | (has("third") & anchor.isin("first", "second")), 1.25).otherwise(0.0)


def drift_penalty(anchor: Column, content_anchors: Column, phrase: Column, is_question: Column) -> Column:
    """A point outside the phrase and the slot words; without a phrase .75 outside the question's content, if it has two."""
    slots = anchor.isin([w for words in SLOT_WORDS.values() for w in words])
    by_phrase = F.when((F.size(phrase) > 0) & ~F.array_contains(phrase, anchor) & ~slots, 1.0).otherwise(0.0)
    by_content = F.when(is_question & (F.size(F.array_distinct(content_anchors)) >= 2) & ~F.array_contains(content_anchors, anchor) & ~slots, 0.75).otherwise(0.0)
    return F.when(by_phrase > 0, by_phrase).otherwise(by_content)


# Words that fit an answer of a frame, and the boost they give.
FITTING = {
    ("causal_explanation", "process_explanation"): ("because cause causes caused force forces change changes affect depends".split(), 0.07),
    ("definition",): ("is are means called known type kind category".split(), 0.06),
    ("comparison",): ("similar different same both than whereas compare contrast".split(), 0.07),
    ("selection_check",): ("true best correct statement choice fits".split(), 0.06),
}


def guidance(anchor: Column, frame_type: Column, subject: Column, support: Column, question: Column, answer: Column) -> Column:
    """struct<boost, penalty> of a candidate by the learned frame."""
    own = F.array_distinct(F.filter(F.split(casefold(subject), " "), lambda t: t != ""))
    boost = F.when(F.array_contains(own, anchor), 0.08).otherwise(0.0) + F.when(F.arrays_overlap(support, own), 0.06).otherwise(0.0) + F.when(F.arrays_overlap(support, question), 0.04).otherwise(0.0)
    for kinds, (words, more) in FITTING.items():
        boost = boost + F.when(frame_type.isin(list(kinds)) & anchor.isin(words), more).otherwise(0.0)
    near = F.arrays_overlap(F.array_append(support, anchor), F.array_union(F.array_union(own, question), answer))
    return F.struct(F.round(boost, 6).alias("boost"), F.when((frame_type != OPEN[1]) & ~near, 0.05).otherwise(0.0).alias("penalty"))


def heading_only(text: Column, letters: Column) -> Column:
    """Whether a fact is only a heading; ``letters``: how many of its tokens hold a letter."""
    s = F.trim(F.coalesce(text, F.lit("")))
    low = F.trim(F.regexp_replace(casefold(s), "^[# ]+", ""))
    titled = s.startswith("#") | low.startswith("lesson ") | low.startswith("answered checks") | low.startswith("compact answer field")
    return (s == "") | F.when(titled, letters <= 8).otherwise(low.endswith(":") & (letters <= 4))


def fact_text(text: Column, most: int = 420) -> Column:
    """A fact on one line without labels, cut at a blank to at most ``most`` characters and a full stop."""
    s = F.regexp_replace(F.replace(F.replace(cleaned(text), F.lit("Question:"), F.lit("")), F.lit("Answer:"), F.lit("")), r"^[ \-]+|[ \-]+$", "")
    head = F.substring(s, 1, most)
    cut = F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit(".")))


def content_category(name: Column, text: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """The category of the first rule of which a term occurs in name or text."""
    hay = F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(text, F.lit("")))
    out = None
    for category, terms in rules:
        hit = reduce(lambda a, b: a | b, (hay.contains(t) for t in terms))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(other) if out is not None else F.lit(other)


def focused(anchors: Column, wrappers: list[str]) -> Column:
    """The tokens without words that only wrap a request; all of them if nothing is left."""
    kept = F.filter(anchors, lambda a: ~a.isin(wrappers))
    return F.when(F.size(kept) > 0, kept).otherwise(anchors)


def code_only(text: Column) -> Column:
    """Whether a passage is a fenced code block without an answer in it."""
    s, low = F.trim(F.coalesce(text, F.lit(""))), casefold(F.coalesce(text, F.lit("")))
    return s.startswith("```") & ~low.contains("answer:") & ~low.contains("compact answer field")


def policy(rows: DataFrame) -> DataFrame:
    """(list, symbol) -> list, symbols: the distinct symbols of each policy list, case folded, in order."""
    low = casefold(F.trim("symbol"))
    return rows.where(F.trim("symbol") != "").groupBy("list").agg(F.array_sort(F.collect_set(low)).alias("symbols"))
