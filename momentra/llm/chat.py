"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows are ordered inside their conversation and streamed: the machine keeps its state between rows, so
even one conversation with most of the table takes bounded memory. Each turn becomes text segments
(header, text, footer) with a loss flag. Control strings inside texts are escaped reversibly: a
backslash goes after the first character of a control string, and a backslash is doubled.

Defined cases: null text is empty; a null role is the empty role; rows with null ``conv_id`` form one
conversation with a null id; null turns sort first; equal turns are ordered by role, then text;
repeated rows are separate turns; an empty table gives no rows; further columns are ignored. A
conversation whose turn order breaks the machine's rules is formatted in full and marked invalid
from the first turn that breaks them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles are trained on, which may follow which, and what is escaped."""

    header: str = "<|im_start|>{role}\n"
    footer: str = "<|im_end|>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    #: state -> role -> next state; the state is the role of the turn before
    turns: dict = field(default_factory=lambda: {"": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: frozenset = frozenset({"assistant"})
    control: tuple = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>")


TEMPLATE = Template()


def escape(text: str, template: Template = TEMPLATE) -> str:
    pattern = "|".join(map(re.escape, sorted(template.control, key=len, reverse=True)))
    return re.sub(pattern, lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _role(role: str, template: Template) -> str:
    """A role inside a header: escaped, with line ends spelled out so that the header stays one line."""
    return escape(role, template).replace("%", "%25").replace("\n", "%0A")


def _unrole(text: str) -> str:
    return unescape(text.replace("%0A", "\n").replace("%25", "%"))


_SEGMENTS = "conv_id long, seq long, turn_no long, kind string, role string, text string, loss boolean, valid boolean"


def segments(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Text segments in order: ``conv_id, seq, turn_no, kind, role, text, loss, valid``.

    Concatenated by ``seq`` they are the formatted conversation; rows leave in that order, each
    conversation inside one partition. ``valid`` says that no turn so far broke the machine's rules.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, turn, seq, valid, first = None, "", 0, 0, True, True
        for b in batches:
            out = []
            for cid, role, text in zip(b["conv_id"].astype("Int64"), b["role"], b["text"], strict=True):
                cid = None if cid is pd.NA else int(cid)
                if first or cid != conv:
                    conv, state, turn, seq, valid, first = cid, "", 0, 0, True, False
                state_after = template.turns.get(state, {}).get(role)
                valid = valid and state_after is not None
                state = state_after if state_after is not None else role
                for kind, part, loss in (("header", template.header.replace("{role}", _role(role, template)), False), ("text", escape(text, template), role in template.loss_roles), ("footer", template.footer, False)):
                    out.append((cid, seq, turn, kind, role, part, loss, valid))
                    seq += 1
                turn += 1
            if out:
                frame = pd.DataFrame(out, columns=["conv_id", "seq", "turn_no", "kind", "role", "text", "loss", "valid"])
                yield frame.astype({"conv_id": "Int64"})

    return rows.mapInPandas(stream, _SEGMENTS)


def read_back(segs: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of each conversation, parsed from its formatted segments alone (text and loss flag)."""
    head, tail = template.header.split("{role}")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def done():
            cid, n, turns, chars, loss, length, valid, last = state
            return (cid, n, turns.hexdigest(), chars, loss.hexdigest(), length, valid and last in template.final)

        for b in batches:
            out = []
            for cid, seq, text, loss, valid in zip(b["conv_id"].astype("Int64"), b["seq"], b["text"], b["loss"], b["valid"], strict=True):
                cid = None if cid is pd.NA else int(cid)
                if seq == 0:
                    if state:
                        out.append(done())
                    state = [cid, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                state[5] += len(text)
                state[6] = bool(valid)
                if text == template.footer:
                    state[1] += 1
                    state[2].update(b"\n")
                elif text.startswith(head):
                    state[7] = _unrole(text[len(head) : len(text) - len(tail)])
                    state[2].update(state[7].encode() + b"\n")
                else:
                    plain = unescape(text)
                    state[2].update(plain.encode())
                    if loss:
                        state[3] += len(plain)
                        state[4].update(plain.encode())
            if out:
                yield frame(out)
        if state:
            yield frame([done()])

    def frame(rows):
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]).astype({"conv_id": "Int64"})

    return segs.select("conv_id", "seq", "text", "loss", "valid").mapInPandas(stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    talks = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(segments(talks))


OP10_SQL = r"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
parts AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(replace(text, '\', '\\'), '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|system\|>|<\|user\|>|<\|assistant\|>'))
    + length(role) + 13 + 11 AS chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS is_last
  FROM talks)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and((before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND bool_or(is_last AND role = 'assistant') AS valid
FROM parts GROUP BY conv_id
"""
