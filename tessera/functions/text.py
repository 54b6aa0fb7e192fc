"""Column expressions on text: tokens, paragraphs, identities and ids."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMOJI, NULL_TOKEN = "__EMOJI__", "__NULL__"
LITERAL_CHARS = 32
_BASE = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
_TAIL = rf"(?:[\x{{1F3FB}}-\x{{1F3FF}}\x{{FE0E}}\x{{FE0F}}]|\x{{200D}}{_BASE})*"
_EMOJI_RUN = rf"[\x{{1F1E6}}-\x{{1F1FF}}]+|{_BASE}{_TAIL}"


def _caseless() -> str:
    """Ranges of the letters called lower or title case that have no capital."""
    own = [c for c in range(0x80, 0x1F000) if unicodedata.category(chr(c)) in ("Ll", "Lt") and chr(c).upper() == chr(c)]
    first = [c for c in own if c - 1 not in set(own)]
    last = [c for c in own if c + 1 not in set(own)]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(first, last, strict=True))


#: A letter that is its own capital; an apostrophe inside a word (between letters or digits, or after an s).
_CAPITAL = rf"[\p{{L}}&&[^\p{{Ll}}\p{{Lt}}]{_caseless()}]"
_JOIN = r"(?<=[\p{L}\p{N}])['’](?=[\p{L}\p{N}])|(?<=[sSſ])['’]"
#: A long run of letters and digits mixed, whole.
_LITERAL = rf"(?<!\S)(?=\S{{{LITERAL_CHARS}}})(?=[^\s\p{{L}}]*+\p{{L}})(?=[^\s\p{{Nd}}]*+\p{{Nd}})\S++"
#: One letter of an acronym: the first of two capitals or more that are a whole word, or the next after such a letter.
_LETTER = rf"(?:(?<!\p{{L}})(?={_CAPITAL}{{2,}}+(?!\p{{L}}|{_JOIN}))|\G(?<={_CAPITAL})){_CAPITAL}"
_WORD = rf"(?=['’]?\p{{L}})(?:\p{{L}}|{_JOIN})++"
#: The whole grammar as one expression, so a text is read once and without lambdas; group 1 is a letter of an acronym.
_TOKEN = rf"(?U)(?:{_LITERAL}|({_LETTER})|{_EMOJI_RUN}|{_WORD}|[^\s\p{{L}}'’])"
_LONE_EMOJI = rf"(?<![^ ])(?:{_EMOJI_RUN})(?![^ ])"


def _all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))


def paragraphs(text: Column) -> Column:
    """Blank-line separated parts in order, line ends made uniform; blank parts are dropped. Null text: none."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.filter(F.split(flat, r"\n\s*\n+"), lambda p: p.rlike(r"\S"))


def is_literal(run: Column) -> Column:
    """A long run of letters and digits mixed: an id, a hash or the like."""
    return (F.char_length(run) >= LITERAL_CHARS) & run.rlike(r"\p{L}") & run.rlike(r"\p{Nd}")


def is_acronym(run: Column) -> Column:
    return run.rlike(r"^\p{L}{2,}$") & (F.upper(run) == run)


def identity(surface: Column) -> Column:
    return F.lower(F.translate(surface, "‘’", "''"))


def surfaces(text: Column) -> Column:
    """array<string>: the tokens of a text as they stand, in reading order. Null text: none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def acronym_letters(text: Column) -> Column:
    """For each token of ``surfaces`` itself if it is a letter of an acronym, else the empty string."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(1))


def anchors(surface: Column) -> Column:
    """array<string>: the identities of an array of surfaces, which hold no blanks; emoji are one."""
    joined = identity(F.array_join(surface, " "))
    named = F.when(joined.rlike(_EMOJI_RUN), F.regexp_replace(joined, _LONE_EMOJI, EMOJI)).otherwise(joined)
    return F.when(F.size(surface) == 0, F.array().cast("array<string>")).otherwise(F.split(named, " "))


def eligible(anchor: Column) -> Column:
    """Whether a token takes part in counts. Of all tokens only literals are long and hold a digit."""
    return ~((F.char_length(anchor) >= LITERAL_CHARS) & anchor.rlike(r"\p{Nd}"))


def kind(anchor: Column, surface: Column, letter: Column) -> Column:
    return (
        F.when(~eligible(surface), "string_literal").when(letter != "", "letter").when(anchor == EMOJI, "emoji").when(surface.rlike(r"^\p{L}"), "word")
        .when(surface.rlike(r"^\p{Nd}$"), "digit").otherwise("symbol")
    )


def tokens(text: Column) -> Column:
    """array<struct<anchor, surface, kind, count_eligible>> of a text in reading order."""
    seen = surfaces(text)
    rows = F.arrays_zip(anchors(seen).alias("anchor"), seen.alias("surface"), acronym_letters(text).alias("letter"))
    return F.transform(rows, lambda t: F.struct(t.anchor.alias("anchor"), t.surface.alias("surface"), kind(t.anchor, t.surface, t.letter).alias("kind"), eligible(t.surface).alias("count_eligible")))


def atomic(anchor: Column) -> Column:
    """A token taken apart to digits, letters of acronyms and single marks; words stay whole."""
    return anchors(surfaces(anchor))


def decomposed(anchors: Column, chosen: Column) -> Column:
    """Tokens in ``chosen`` replaced by their characters."""
    return F.flatten(F.transform(anchors, lambda a: F.when(F.array_contains(chosen, a), _all(a, r"[\p{L}\p{N}]")).otherwise(F.array(a))))


def casefold(s: Column) -> Column:
    """Case folding for search; differs from lower() on sharp s and final sigma."""
    return F.replace(F.replace(F.lower(s), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def stable_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("::", *(p.cast("string") for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 16))


def offset_text(offset: Column) -> Column:
    return F.concat(F.when(offset > 0, "+").otherwise(""), offset.cast("string"))


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean_text(s: Column) -> Column:
    """Uniform line ends, single blanks, at most one empty line in a row, trimmed."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def search_terms(s: Column) -> Column:
    """Distinct lower-case terms in order; a plural s goes from terms of more than three characters."""
    raw = _all(casefold(F.coalesce(s, F.lit(""))), r"[a-z0-9]+(?:'[a-z0-9]+)?")
    return F.array_distinct(F.transform(raw, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.regexp_replace(t, "s$", "")).otherwise(t)))


def letter_bucket(word: Column) -> Column:
    first = F.upper(F.regexp_extract(F.lower(word), r"(\p{L})", 1))
    return F.when(first == "", "A").otherwise(F.coalesce(first, F.lit("A")))


def strip_leaders(s: Column) -> Column:
    """Box-drawing and block characters replaced by a blank."""
    return F.regexp_replace(s, "[─-╿]+", " ")


def rtf_text(s: Column) -> Column:
    """Visible text of an RTF source: escapes, control words and braces removed."""
    steps = [(r"\\'[0-9a-fA-F]{2}", " "), (r"\\[a-zA-Z]+-?\d* ?", " "), (r"[{}]", " ")]
    return collapse(reduce(lambda c, p: F.regexp_replace(c, *p), steps, s))


def final_answer(s: Column) -> Column:
    """What follows the last '####'; the whole text if there is none."""
    return F.trim(F.when(s.contains("####"), F.substring_index(s, "####", -1)).otherwise(s))


def payload_shape(s: Column) -> Column:
    """struct of figures and whether a message is a document rather than a question."""
    text = F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", "")
    lines = F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.length(F.trim(x)) > 0))
    terms, fences, marks = F.size(search_terms(text)), F.size(F.split(text, "```", -1)) - 1, F.length(text) - F.length(F.translate(text, ".?!", ""))
    chars = F.char_length(text)
    is_doc = (chars >= 1200) | (lines >= 12) | (fences >= 2) | ((chars >= 700) & (marks >= 8) & (terms >= 80))
    return F.struct(is_doc.alias("is_document"), chars.alias("char_count"), lines.alias("line_count"), terms.alias("term_count"), fences.alias("fence_count"), marks.alias("mark_count"))


def may_decompose(anchor: Column) -> Column:
    """Whether an unknown token is taken apart to characters: two or more, one a letter or digit."""
    return (F.char_length(anchor) >= 2) & anchor.rlike(r"[\p{L}\p{N}]")


def coded(value: Column, codes: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, code in codes.items():
        out = F.when(value == name, code).otherwise(out)
    return out


def parsed_offset(text: Column) -> Column:
    """An offset from text such as +3; null for 0, what doesn't fit in a signed byte, and what is no number."""
    n = F.regexp_replace(text, "^[+]", "").try_cast("int")
    return F.when((n != 0) & (F.abs(n) <= 127), n)


def holds_all(text: Column, markers: list[str]) -> Column:
    """Whether every marker stands in the text."""
    return reduce(lambda a, b: a & b, (F.coalesce(text, F.lit("")).contains(m) for m in markers), F.lit(True))
