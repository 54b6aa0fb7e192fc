"""Where a text's tokens and paragraphs are in its source, snippets round query tokens, and edits of all mentions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraph_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source_id, paragraph_id, line_start, line_end (from 1) of each non-blank paragraph."""
    flat = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n")
    lines = F.split(flat, "\n")
    blank = lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) == ""
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        n = (s["n"] + 1).alias("n")
        closed = F.when(s["a"] > 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["n"].alias("b"))))).otherwise(s["done"])
        return F.when(blank(line), F.struct(closed.alias("done"), F.lit(0).alias("a"), n)).otherwise(F.struct(s["done"].alias("done"), F.when(s["a"] > 0, s["a"]).otherwise(s["n"] + 1).alias("a"), n))

    spans = F.aggregate(F.concat(lines, F.array(F.lit(""))), start, step, lambda s: s["done"])
    return docs.select(F.col(id_col).alias("source_id"), F.posexplode(spans).alias("paragraph_id", "s")).select("source_id", "paragraph_id", F.col("s.a").alias("line_start"), F.col("s.b").alias("line_end"))


def centred(text: str | None, terms: list[str], most: int = 520) -> str:
    """The part of a text of about ``most`` characters round its first query term, cut at blanks, with dots where cut."""
    s = " ".join((text or "").split())
    if len(s) <= most:
        return s
    found = [m.start() for t in terms for m in [re.search(rf"(?<!\w){re.escape(t)}(?!\w)", s, re.I)] if m]
    a = max(0, min(found, default=0) - most // 3)
    b = min(len(s), a + most)
    a = s.find(" ", a) + 1 if a else 0
    b = s.rfind(" ", a + 1, b) if b < len(s) and " " in s[a + 1 : b] else b
    return ("..." if a else "") + s[a:b] + ("..." if b < len(s) else "")


def snippets(rows: DataFrame, terms: list[str], text_col: str = "text", most: int = 520) -> DataFrame:
    """Rows with ``snippet``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: centred(t, terms, most))

    return rows.withColumn("snippet", run(F.col(text_col)))


def edit_mentions(rows: DataFrame, edits: dict[str, str | None], text_col: str = "text") -> DataFrame:
    """Every mention of a token replaced (None: removed), case aside, and ``n_edits``. One pass over the text, so an edit
    never touches what another put in."""
    if not edits:
        return rows.withColumn("n_edits", F.lit(0).cast("long"))
    low = {k.lower(): v for k, v in edits.items()}
    any_ = "|".join(re.escape(k) for k in sorted(low, key=len, reverse=True))
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{any_})(?![\p{{L}}\p{{N}}])".replace("\\-", "-")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    new = F.create_map(*(F.lit(x) for k, v in low.items() for x in (k, v or "")))
    woven = F.array_join(F.transform(F.split(text, pattern, -1), lambda p, i: F.concat(p, F.coalesce(F.element_at(new, F.lower(F.coalesce(F.get(hits, i), F.lit("")))), F.lit("")))), "")
    return rows.withColumns({text_col: woven, "n_edits": F.size(hits).cast("long")})
