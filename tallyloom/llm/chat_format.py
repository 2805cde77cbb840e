"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole: each turn as START role line-feed text END line-feed, with the spans of its texts. The
rendered string is encoded once, with offsets; the loss mask comes from intersecting the sorted spans of assistant texts
with the token spans by binary search. A token that reaches over a span's end counts for the part inside it, so the masked
characters are the assistants' texts exactly. Control strings inside texts and roles are broken by a reversible escape, so
no text can open or close a turn.

A conversation is one unit of work (its rows meet in one task, as its output is one string); conversations are dealt out by
id. Defined cases: null texts and roles are empty; rows of one conversation are ordered by turn (null first), role and text,
and repeated rows stay; rows with a null conv_id form one conversation; an empty table gives an empty result (the query
adds conversation -1); extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, read, sha256, tidy

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that no text may bring into a rendered conversation.
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
_CONTROL = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROL))}))(.)", re.S)
_ESCAPED = re.compile(f"{ESCAPE}([0-2])")
_TURN = re.compile(f"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)
FORMATTED = "conv_id long, formatted string, tokens array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"


def escape(text: str, role: bool = False) -> str:
    """Break control strings after their first character; in roles, also line feeds."""
    out = _CONTROL.sub(rf"\1{ESCAPE}1", text.replace(ESCAPE, f"{ESCAPE}0"))
    return out.replace("\n", f"{ESCAPE}2") if role else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (ESCAPE, "", "\n")[int(m[1])], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The rendered conversation, and role, start and end of each text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, True)}\n", escape(text)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Whether each token meets a span, and the characters under the mask as merged spans. Both inputs are sorted."""
    mask = np.zeros(len(offsets), bool)
    if not len(offsets) or not spans:
        return mask, []
    start, end = np.array(spans, np.int64).T
    k = np.searchsorted(end, offsets[:, 0], "right")  # the first span that ends after the token's start
    inside = k < len(spans)
    at = np.minimum(k, len(spans) - 1)
    mask = inside & (offsets[:, 1] > start[at]) & (offsets[:, 1] > offsets[:, 0]) & (end[at] > start[at])
    out: list[tuple[int, int]] = []
    for t in np.flatnonzero(mask):
        s = int(at[t])
        while s < len(spans) and start[s] < offsets[t, 1]:
            lo, hi = max(int(start[s]), int(offsets[t, 0])), min(int(end[s]), int(offsets[t, 1]))
            if lo < hi:
                if out and lo <= out[-1][1] and _span_of(start, lo) == _span_of(start, out[-1][0]):
                    out[-1] = (out[-1][0], max(hi, out[-1][1]))
                else:
                    out.append((lo, hi))
            s += 1
    return mask, out


def _span_of(start: np.ndarray, place: int) -> int:
    return int(np.searchsorted(start, place, "right"))


_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
    return _LOADED[path]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Turns of consecutive rows with one conv_id, over batch limits."""
    now: object = _conversations
    turns: list[tuple[str, str]] = []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if conv != now:
                if turns:
                    yield now, turns
                now, turns = conv, []
            turns.append((role or "", text or ""))
    if turns:
        yield now, turns


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a conversation: formatted text, token ids, loss mask, and the characters under the mask."""
    schema = arrow_schema(FORMATTED, conversations.sparkSession)

    def run(batches):
        enc = _tokenizer(tokenizer)

        def emit(held):
            texts = [f for _, f, _ in held]
            rows = []
            for (conv, formatted, spans), e in zip(held, enc.encode_batch(texts, add_special_tokens=False), strict=True):
                mask, loss = loss_mask(np.array(e.offsets, np.int64).reshape(-1, 2), [(a, b) for role, a, b in spans if role == "assistant"])
                rows.append({"conv_id": conv, "formatted": formatted, "tokens": e.ids, "loss_mask": mask.tolist(), "loss_spans": [{"start": a, "end": b} for a, b in loss]})
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        held, size = [], 0
        for conv, turns in _conversations(batches):
            formatted, spans = render(turns)
            held.append((conv, formatted, spans))
            size += len(formatted)
            if size > 1 << 20:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(tidy(run), FORMATTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = arrow_schema(kind, spark)

    def digest(batches):
        for batch in batches:
            out = []
            for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = parse(formatted)
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()), "loss_chars": len(loss), "loss_sha256": sha256(loss.encode()), "formatted_chars": len(formatted)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return format_chats(rows).select("conv_id", "formatted", "loss_spans").mapInArrow(tidy(digest), kind)


def _added() -> str:
    found = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) / {len(c)} * 2" for c in CONTROL)
    return f"(length(t) - length(replace(t, '{ESCAPE}', ''))) + {found}"


ORACLE_SQL = f"""WITH rows AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
texts AS (SELECT conv_id, turn, role, text, COALESCE(role, '') AS r, COALESCE(text, '') AS t FROM rows),
sized AS (SELECT *, length(t) + {_added()} AS body FROM texts)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  COALESCE(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(r) + body)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
