"""Conversations as token ids with a loss mask, assembled from separately encoded segments.

A turn is <|turn|> role <|text|> text <|end|>, a conversation <s> turns </s>. Marks are reserved ids that no text can give: <s> and
</s> of the vocabulary, the others numbered after its last piece. Role and text are encoded by themselves and the ids
spliced between the marks, so no piece spans a mark. A text's own U+2581, which the vocabulary takes for a blank, is a
reserved id as well. Which ids count towards the loss follows from the segments' lengths: one at a segment's first id and
minus one behind its last, summed from the left.

In the formatted text a control string that occurs in a role or text gets a backslash behind its first character, and one
more where backslashes stand there already, so every text comes back as it was.

Rows are encoded where they are read; turns are laid in order by ranges of (conversation, turn), so a conversation of any
number of turns is no single task's. Only reading a whole conversation's digest goes through its turns one by one, as a
digest must, without holding them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.pieces import default_model
from tessera.llm.places import placed
from tessera.llm.store import small_batches, stash

#: Control strings of the template and of others in use, which a text must not hold as they are.
CONTROLS = ("<s>", "</s>", "<unk>", "<|turn|>", "<|text|>", "<|end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
BLANK = "▁"


@dataclass(frozen=True)
class Template:
    """Whose texts are learnt, and the control strings (none may begin inside another)."""

    learnt: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        inside = [(a, b) for a in self.controls for b in self.controls for k in range(1, len(a)) if a[k:].startswith(b) or b.startswith(a[k:])]
        if inside or any(len(c) < 2 or "\\" in c or BLANK in c for c in self.controls) or not {"<s>", "</s>", "<|turn|>", "<|text|>", "<|end|>"} <= {*self.controls}:
            raise ValueError(f"control strings meet: {inside}" if inside else "control strings are two characters or more, without backslashes, and hold the template's own")

    def _pattern(self, behind: str) -> str:
        firsts = sorted({c[0] for c in self.controls})
        rest = lambda f: "|".join(re.escape(c[1:]) for c in self.controls if c[0] == f)
        return "|".join(f"({re.escape(f)}){behind}(?=\\\\*(?:{rest(f)}))" for f in firsts)

    def escaped(self, text: Column) -> Column:
        groups = "".join(f"${k + 1}" for k in range(len({c[0] for c in self.controls})))
        return F.regexp_replace(text, self._pattern(""), f"{groups}\\\\")

    def plain(self, text: Column) -> Column:
        groups = "".join(f"${k + 1}" for k in range(len({c[0] for c in self.controls})))
        return F.regexp_replace(text, self._pattern(r"\\"), groups)


class _Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        self.first, self.last = self.library.bos_id(), self.library.eos_id()
        self.turn, self.text, self.end, self.blank = range(n, n + 4)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; pieces between its U+2581 are encoded apart."""
        parts = [t.split(BLANK) for t in texts]
        flat = self.library.encode([p for x in parts for p in x], num_threads=1)
        out, at = [], 0
        for x in parts:
            own = flat[at : at + len(x)]
            at += len(x)
            out.append(np.array(own[0] if len(x) == 1 else [i for k, p in enumerate(own) for i in ([self.blank] if k else []) + p], np.int32))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        parts = [np.split(x, np.flatnonzero(x == self.blank)) for x in ids]
        flat = self.library.decode([[int(i) for i in p if i != self.blank] for x in parts for p in x], num_threads=1)
        out, at = [], 0
        for x in parts:
            out.append(BLANK.join(flat[at : at + len(x)]))
            at += len(x)
        return out


_CODECS: dict[bytes, _Codec] = {}


def _codec(model: bytes) -> _Codec:
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = _Codec(model)
    return _CODECS[key]


def assembled(segments: list[np.ndarray], learnt: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments in order, whether each is learnt and its row -> all ids, the mask over them, and the ids of each row."""
    size = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(size)
    step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(step, (ends - size)[learnt], 1)
    np.add.at(step, ends[learnt], -1)
    ids = np.concatenate(segments) if segments else np.zeros(0, np.int32)
    return ids, np.cumsum(step)[:-1] > 0, np.bincount(rows, weights=size).astype(np.int64) if len(size) else size


def _encode(model, names: list[str]):
    def run(batches):
        c = _codec(model.value)
        mark = {k: np.array([getattr(c, k)], np.int32) for k in ("turn", "text", "end")}
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            roles, texts = (batch.column(names.index(x)).cast(pa.string()).to_pylist() for x in ("shown_role", "shown_text"))
            known = {r: i for r, i in zip(dict.fromkeys(roles), c.encode(list(dict.fromkeys(roles))), strict=True)}
            wanted = batch.column(names.index("learnt")).to_pylist()
            segments = [s for r, t in zip(roles, c.encode(texts), strict=True) for s in (mark["turn"], known[r], mark["text"], t, mark["end"])]
            learnt = np.zeros((n, 5), bool)
            learnt[:, 3] = wanted
            ids, mask, sizes = assembled(segments, learnt.reshape(-1), np.repeat(np.arange(n), 5))
            at = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(mask))], names=[*names, "ids", "mask"])

    return run


def _model(spark, path: str | None):
    with open(path or default_model(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # one vocabulary file, of a fixed size


def format_conversations(turns: DataFrame, template: Template | None = None, model_path: str | None = None) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> a row for each turn of the formatted conversations: conv_id, place (from 0), n_turns,
    formatted, ids, mask, token_start, n_tokens and loss_start: where its ids begin among the conversation's, how many those
    are, and how many learnt ids stand before.

    Turns ascend by turn (null first), equal ones by role and text. Null roles and texts are empty; rows without conv_id are
    one conversation. <s> is with the first turn, </s> with the last. Other columns aren't read. No rows give no rows.
    """
    template = template or Template()
    small_batches(turns.sparkSession)
    model = _model(turns.sparkSession, model_path)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("grp"), "turn",
        template.escaped(text("role")).alias("shown_role"), template.escaped(text("text")).alias("shown_text"), text("role").isin(*template.learnt).alias("learnt"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ids array<int>, mask array<boolean>"
    coded = stash(rows.mapInArrow(_encode(model, rows.columns), schema).withColumns({"own": F.size("ids"), "own_loss": F.when(F.col("learnt"), F.size(F.filter("mask", lambda m: m))).otherwise(0)}))
    laid = placed(coded, "grp", ["turn", "shown_role", "shown_text"], ("own", "own_loss"))
    c = _codec(model.value)
    first, last = F.col("idx") == 0, F.col("idx") == F.col("n") - 1
    none_ids, none_mask = F.array().cast("array<int>"), F.array().cast("array<boolean>")
    body = F.concat(F.lit("<|turn|>"), "shown_role", F.lit("<|text|>"), "shown_text", F.lit("<|end|>"))
    between = lambda a, x, b, none: F.concat(F.when(first, a).otherwise(none), x, F.when(last, b).otherwise(none))
    return laid.select(
        "conv_id", F.col("idx").alias("place"), F.col("n").alias("n_turns"), between(F.lit("<s>"), body, F.lit("</s>"), F.lit("")).alias("formatted"),
        between(F.array(F.lit(c.first)), F.col("ids"), F.array(F.lit(c.last)), none_ids).alias("ids"),
        between(F.array(F.lit(False)), F.col("mask"), F.array(F.lit(False)), none_mask).alias("mask"),
        F.when(first, F.lit(0)).otherwise(F.col("before_own") + 1).cast("long").alias("token_start"), (F.col("total_own") + 2).cast("long").alias("n_tokens"), F.col("before_own_loss").cast("long").alias("loss_start"),
    )


def read_back(formatted: DataFrame, template: Template | None = None, model_path: str | None = None) -> DataFrame:
    """From ids and mask alone: conv_id, place, n_turns, formatted, role, text and learnt, the text under the mask."""
    template = template or Template()
    model = _model(formatted.sparkSession, model_path)

    def run(batches):
        c = _codec(model.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            segments = []
            for ids, mask in zip(batch.column(4), batch.column(5), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                turn, text, end = (int(np.flatnonzero(ids == x)[0]) for x in (c.turn, c.text, c.end))
                segments += [ids[turn + 1 : text], ids[text + 1 : end], ids[mask]]
            said = c.decode(segments)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(said[k::3], pa.string()) for k in range(3))], names=["conv_id", "place", "n_turns", "formatted", "role", "text", "learnt"])

    rows = formatted.select("conv_id", "place", "n_turns", "formatted", "ids", "mask").mapInArrow(run, "conv_id long, place long, n_turns long, formatted string, role string, text string, learnt string")
    return rows.withColumns({x: template.plain(F.col(x)) for x in ("role", "text", "learnt")})


def _digests(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, n, chars, loss, turns, learnt = None, 0, 0, 0, None, None
    row = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (now[0], n, turns.hexdigest(), loss, learnt.hexdigest(), chars), strict=True))], pa.schema([(x, pa.string() if x.endswith("sha256") else pa.int64()) for x in names]))
    for batch in batches:
        done = []
        for conv, role, text, own, formatted in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if now != (conv,):
                if now:
                    done.append(row())
                now, n, chars, loss, turns, learnt = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            n, chars, loss = n + 1, chars + formatted, loss + len(own)
            turns.update(f"{role}\n{text}\n".encode())
            learnt.update(own.encode())
        yield from done
    if now:
        yield row()


def conversation_digests(back: DataFrame) -> DataFrame:
    """Of read_back(): conv_id, n_turns, turns_sha256 (role, line end, text, line end of every turn), loss_chars and loss_sha256 (of
    the learnt texts, one after another) and formatted_chars."""
    small_batches(back.sparkSession)
    own = back.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text", "learnt", F.char_length("formatted").cast("long").alias("chars"))
    return own.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
