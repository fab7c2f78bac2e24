"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages to a string. Rendering successive prefixes of a conversation and comparing
consecutive outputs shows where each turn stands, without knowing the template; a template whose output for a prefix is not
a prefix of its output for more turns rewrites history, and is reported.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

#: What starts a control string or an escape in the output of bracket_template.
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.S)

#: Turns that one rendering of an additive template holds; longer conversations are rendered in blocks.
BLOCK_TURNS = 64


def escape(text: str) -> str:
    """So that no control string can stand in a text: a backslash before each character that could start one."""
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def additive(template: Template) -> Template:
    """Declares that a template's output for messages is its outputs for any parts of them put together."""
    template.additive = True
    return template


@additive
def bracket_template(messages: list[Message]) -> str:
    """Turns as <s>[ROLE]role[/ROLE]text</s>; users' texts stand between [INST] and [/INST]. Texts and roles are escaped."""
    out = []
    for role, text in messages:
        body = f"[INST] {escape(text)} [/INST]" if role == "user" else escape(text)
        out.append(f"<s>[ROLE]{escape(role)}[/ROLE]{body}</s>")
    return "".join(out)


def parse_turn(rendered: str) -> tuple[str, int, int]:
    """Role, and where the escaped text starts and ends, of one turn that bracket_template rendered."""
    head = rendered.index("[/ROLE]") + len("[/ROLE]")
    role = unescape(rendered[len("<s>[ROLE]") : head - len("[/ROLE]")])
    if role == "user":
        return role, head + len("[INST] "), len(rendered) - len(" [/INST]</s>")
    return role, head, len(rendered) - len("</s>")


@dataclass
class Spans:
    """text: the whole output; turns: each turn's span in it; rewrites: turns whose rendering changed earlier output."""

    text: str
    turns: list[tuple[int, int]]
    rewrites: list[int]


def _common(a: str, b: str) -> int:
    return len(a) if b.startswith(a) else len(os.path.commonprefix([a, b]))


def locate(messages: list[Message], template: Template, block: int = BLOCK_TURNS) -> Spans:
    """Spans of all turns by rendering each prefix once.

    Every prefix is the conversation's own, whatever its length, unless the template declares itself additive: then blocks are rendered alone,
    and the prefixes after all if the blocks put together are not what the template gives for the whole.
    """
    if len(messages) > block and getattr(template, "additive", False):
        text, turns, rewrites = [], [], []
        at = 0
        for k in range(0, len(messages), block):
            s = locate(messages[k : k + block], template, block)
            text.append(s.text)
            turns += [(a + at, b + at) for a, b in s.turns]
            rewrites += [k + r for r in s.rewrites]
            at += len(s.text)
        if "".join(text) == template(messages):
            return Spans("".join(text), turns, rewrites)
    last, turns, rewrites = "", [], []
    for k in range(1, len(messages) + 1):
        now = template(messages[:k])
        same = _common(last, now)
        if same < len(last):
            rewrites.append(k - 1)
        turns.append((same, len(now)))
        last = now
    return Spans(last, turns, rewrites)


def rewrites_history(template: Template, probes: list[list[Message]]) -> bool:
    """Whether any probe conversation makes the template change output that it gave for fewer turns."""
    return any(locate(p, template, block=10**9).rewrites for p in probes)


def format_conversation(messages: list[Message], template: Template = bracket_template) -> dict:
    """The formatted string, its turns' spans, the loss mask's spans (assistant texts) and what reading it back gives."""
    spans = locate(messages, template)
    if spans.rewrites:
        raise ValueError(f"the template rewrites history at turns {spans.rewrites[:5]}")
    mask, turns = [], []
    for a, b in spans.turns:
        role, c, d = parse_turn(spans.text[a:b])
        turns.append((role, unescape(spans.text[a + c : a + d])))
        if role == "assistant":
            mask.append((a + c, a + d))
    return {"text": spans.text, "spans": spans.turns, "mask": mask, "turns": turns}


#: The conversation that every run formats besides the table's: its texts are the control strings of common templates.
PROBE = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]


def _result(conv_id: int | None, messages: list[Message], with_text: bool) -> tuple:
    f = format_conversation(messages)
    turns = hashlib.sha256()
    for role, text in f["turns"]:
        turns.update(f"{role}\n{text}\n".encode())
    loss = [unescape(f["text"][a:b]) for a, b in f["mask"]]
    row = (conv_id, len(f["turns"]), turns.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(f["text"]))
    return (*row, f["text"], [[a, b] for a, b in f["mask"]]) if with_text else row


def format_conversations(df: DataFrame, with_text: bool = False) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text), and conversation -1 (PROBE).

    Turns are in order of turn, then role, then text; null text and role are empty; a null conv_id is a conversation; repeated rows are
    turns of their own; an empty table gives conversation -1 only. Rows come to a task sorted, and are formatted one conversation at a time.
    """
    spark = df.sparkSession
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    probe = spark.createDataFrame([(-1, i, r, t) for i, (r, t) in enumerate(PROBE)], "conv_id long, turn long, role string, text string")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "loss_spans"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
    width = 8 if with_text else 6

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(width)], names[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, messages = object(), []
        for b in batches:
            out = []
            for conv, role, text in zip(column(b, "conv_id").to_pylist(), column(b, "role").to_pylist(), column(b, "text").to_pylist()):
                if conv != here:
                    if messages:
                        out.append(_result(here, messages, with_text))
                    here, messages = conv, []
                messages.append((role, text))
            if out:
                yield batch(out)
        if messages:
            yield batch([_result(here, messages, with_text)])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long" + ", formatted string, loss_spans array<array<long>>" * with_text
    return rows.unionByName(probe).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)
