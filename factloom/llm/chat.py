"""Chat formatting by incremental black-box rendering.

A template's `render` is any function from a list of (role, text) turns to one string. To learn which characters belong to
which turn without looking inside it, successive prefixes of a conversation are rendered and consecutive outputs compared:
what is new after the common prefix is the turn's span; a closing part that each prefix ends with (such as a generation cue)
is found as the common suffix. A template that changes characters it had already put out (rewrites history) is detected,
since then an earlier span no longer stands where it was; such a conversation is flagged and gets no mask from this method.

A turn's text is located in its span the same way: the prefix is rendered once more with a probe sign in place of the text,
a sign that the text neither begins nor ends with, and what the two renderings share before and behind it lies outside the
text. The loss mask holds the texts of the trained role. Only if a template can say how it escapes texts (`unescape`) and how
to read turns back (`parse`) are these used, and only in reading a rendering back; without `parse`, turns are read back from
their spans. Control strings inside texts are escaped reversibly by the template here, so no text can forge a header or an end.

Rows reach a task sorted by conversation and turn and are worked off one conversation at a time, so memory is that of the
longest conversation. Defined results: null texts are empty, null roles are empty; rows of one conversation that tie in
turn are ordered by role, then text, null turns first; repeated rows are turns like any other; a null conv_id is a
conversation of its own; a template that leaves a text out, or trims it, gives the span of what it shows; an empty table
gives an empty result. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Render = Callable[[Turns], str]


@dataclass(frozen=True)
class Template:
    render: Render
    unescape: Callable[[str], str] = str
    parse: Callable[[str], Turns] | None = None


HEAD, END = "### ", "</turn>\n"
#: A backslash goes before each of these inside texts and roles; the first is the escape itself.
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_ESCAPED_OR_MARK = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def heading(turns: Turns) -> str:
    """`### role: text</turn>` for each turn. A role's own colons are escaped too, so the first bare one ends it."""
    return "".join(f"{HEAD}{escape(role).replace(':', chr(92) + ':')}: {escape(text)}{END}" for role, text in turns)


def spans(turns: Turns, render: Render) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The whole rendering, each turn's [start, end) in it, each text's, and whether the template rewrites what it had put out."""
    last, found, texts, rewrites = render([]), [], [], False
    for n in range(1, len(turns) + 1):
        now = render(turns[:n])
        if now.startswith(last):
            found.append((len(last), len(now)))
        else:
            same = _common(last, now)
            tail = _common(last[same:][::-1], now[same:][::-1])  # a closing part that moves along with the end
            if same + tail < len(last) or found and found[-1][0] > same:
                rewrites = True
            if found:
                found[-1] = (found[-1][0], min(found[-1][1], same))
            found.append((same, len(now) - tail))
        texts.append(located(now, turns[: n - 1], *turns[n - 1], render, last))
        last = now
    return last, found, texts, rewrites


#: Signs for the place of a text: private characters, of which a text begins or ends with two at most.
PROBES = "\ue000\ue001\ue002"


def located(now: str, before: Turns, role: str, text: str, render: Render, last: str) -> tuple[int, int]:
    """Where the last turn's text stands in its rendering `now`; `last` is the rendering without that turn."""
    probe = next(p for p in PROBES if not text.startswith(p) and not text.endswith(p))
    other = render([*before, (role, probe)])
    at = _common(now, other) if not now.startswith(last) or not other.startswith(last) else len(last) + _common(now[len(last) :], other[len(last) :])
    rest, shown = len(now) - at, len(other) - at
    behind = min(_common(now[at:][::-1], other[at:][::-1]), rest, shown)
    return at, at + rest - behind


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving: slices compare at memory speed."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def parse(formatted: str) -> Turns:
    """Read the turns back from a rendering of `heading`."""
    turns, at = [], 0
    while at < len(formatted):
        m = next(m for m in _ESCAPED_OR_MARK.finditer(formatted, at) if m[0] == END)
        role, text = _split(formatted[at : m.start()])
        turns.append((unescape(role.replace("\\:", ":")), unescape(text)))
        at = m.end()
    return turns


def _split(body: str) -> tuple[str, str]:
    m = re.match(r"### ((?:[^\\:]|\\.)*): ", body, re.DOTALL)
    return m[1], body[m.end() :]


HEADING = Template(heading, unescape, parse)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turns]]:
    now, turns, any_ = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if any_ and conv != now:
                yield now, turns
                turns = []
            now, any_ = conv, True
            turns.append((role, text))
    if any_:
        yield now, turns


FORMATTED = "conv_id long, n_turns long, formatted string, roles array<string>, text_start array<long>, text_end array<long>, mask_start array<long>, mask_end array<long>, rewrites_history boolean"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def format_conversations(rows: DataFrame, template: Template = HEADING, trained: str = "assistant") -> DataFrame:
    """One row per conversation: its rendering, and the ranges of its texts and of the loss mask in it (code points)."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = [], 0
        for conv, turns in _conversations(batches):
            text, _, texts, rewrites = spans(turns, template.render)
            mask = [] if rewrites else [t for t, (role, _) in zip(texts, turns) if role == trained]
            done.append((conv, len(turns), text, [r for r, _ in turns], [a for a, _ in texts], [b for _, b in texts], [a for a, _ in mask], [b for _, b in mask], rewrites))
            held += len(text)
            if held > 4_000_000 or len(done) >= 2000:
                yield _batch(done, FORMATTED)
                done, held = [], 0
        if done:
            yield _batch(done, FORMATTED)

    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(render, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def digests(formatted: DataFrame, template: Template = HEADING) -> DataFrame:
    """What is read back from renderings: turns, masked text, lengths. A template that rewrites history and cannot parse has
    null turns_sha256, as its spans say nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, whole, loss, n = r["formatted"], hashlib.sha256(), hashlib.sha256(), 0
                turns = template.parse(text) if template.parse else [(role, template.unescape(text[a:b])) for role, a, b in zip(r["roles"], r["text_start"], r["text_end"])]
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for a, b in zip(r["mask_start"], r["mask_end"]):
                    said = template.unescape(text[a:b])
                    loss.update(said.encode())
                    n += len(said)
                known = template.parse or not r["rewrites_history"]
                out.append((r["conv_id"], len(turns), whole.hexdigest() if known else None, n, loss.hexdigest(), len(text), r["rewrites_history"]))
            yield _batch(out, DIGESTS)

    return formatted.mapInArrow(read, DIGESTS)


PROBE = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts try to forge the template's marks."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(probe)))
