"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered as marked turns. Control strings inside texts are
escaped by one backslash between ``<`` and ``|``, which unescaping takes away
again. The rendering is encoded once with offsets; the sorted spans of the
assistant texts are intersected with the token spans by binary search. A token
is under the loss when it overlaps a span, and its part inside the span is what
is learned, so the learned text is exactly the assistant texts.

Rendering streams over rows sorted by (conversation, turn): a task holds one
conversation at a time. Long ones are encoded in blocks of whole turns; a block
ends after a line break that a marker follows, where the tokenizer's pattern
always cuts, so the tokens are those of the whole text.

Defined cases: a null text or role is empty; rows with equal turn numbers are
ordered by role and text, a null turn comes first; repeated rows are repeated
turns; rows with a null conversation id form one conversation; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import prepare

# --- fixed values: the template's markers ------------------------------------
START, END = "<|im_start|>", "<|im_end|>\n"
# ------------------------------------------------------------------------------
BLOCK = 200_000

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the sorted code point spans to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from their formatted text."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Loss flag of each token, and the learned parts as merged code point spans.

    Tokens of one character (bytes of it) share its offsets; both are learned.
    """
    learned = np.zeros(len(offsets), bool)
    parts: list[tuple[int, int]] = []
    starts, stops = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        first, last = int(np.searchsorted(stops, a, "right")), int(np.searchsorted(starts, b, "left"))
        learned[first:last] = True
        at = a
        for s, e in zip(np.maximum(starts[first:last], a).tolist(), np.minimum(stops[first:last], b).tolist()):
            if parts and parts[-1][1] >= s >= at:
                parts[-1] = (parts[-1][0], max(parts[-1][1], e))
            else:
                parts.append((s, e))
    return learned, parts


_TOKENIZERS: dict[int, object] = {}


def _tokenizer(spec: str):
    from tokenizers import Tokenizer
    from tokenizers.processors import ByteLevel

    key = hash(spec)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer.from_str(spec)
        _TOKENIZERS[key].encode_special_tokens = True
        _TOKENIZERS[key].post_processor = ByteLevel(trim_offsets=False)  # offsets keep their blanks
    return _TOKENIZERS[key]


def _blocks(turns: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for t in turns:
        block.append(t)
        size += len(t[1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def format_turns(turns: list[tuple[str, str]], tokenizer, learn: str) -> dict:
    """Formatted text, token ids, offsets, loss flags and learned spans of one conversation."""
    texts, ids, offsets, flags, spans, at = [], [], [], [], [], 0
    for block in _blocks(turns):
        text, wanted = render(block, learn)
        encoding = tokenizer.encode(text, add_special_tokens=False)
        where = np.array(encoding.offsets, np.int64).reshape(-1, 2)
        learned, parts = mask(where, wanted)
        texts.append(text)
        ids.append(np.array(encoding.ids, np.int32))
        offsets.append((where + at).ravel())
        flags.append(learned)
        for s, e in parts:
            spans += [s + at, e + at]
        at += len(text)
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return {"formatted": "".join(texts), "ids": join(ids, np.int32), "offsets": join(offsets, np.int32), "loss": join(flags, np.int32), "loss_spans": np.array(spans, np.int32)}


FIELDS = {"n_turns": "bigint", "formatted": "string", "ids": "array<int>", "offsets": "array<int>", "loss": "array<int>", "loss_spans": "array<int>"}
_KINDS = {"n_turns": pa.int64(), "formatted": pa.string()} | {k: pa.list_(pa.int32()) for k in ("ids", "offsets", "loss", "loss_spans")}


def format_conversations(turns: DataFrame, spec: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: n_turns, formatted, ids, offsets, loss, loss_spans.

    ``spec`` is a tokenizer file's JSON (fixed size, broadcast); ``offsets`` and
    ``loss_spans`` hold starts and ends in turn, in code points of ``formatted``.
    """
    prepare(turns.sparkSession)
    shared = turns.sparkSession.sparkContext.broadcast(spec)
    key = turns.select(conv).schema[0].dataType.simpleString()
    rows = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")
    )
    dealt = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key]

    def run(batches):
        tokenizer = _tokenizer(shared.value)
        ready, size = [], 0

        def table():
            arrays = [pa.array([r[0] for r in ready], kind), *[pa.array([r[1][k] for r in ready], v) for k, v in _KINDS.items()]]
            return pa.RecordBatch.from_arrays(arrays, names=[conv, *_KINDS])

        def finish(c, held):
            return c, {"n_turns": len(held)} | format_turns(held, tokenizer, learn)

        current, held = None, []
        for batch in batches:
            for c, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held and c != current:
                    ready.append(finish(current, held))
                    size += len(ready[-1][1]["formatted"])
                    held = []
                current = c
                held.append((r, t))
                if size > 2 << 20:
                    yield table()
                    ready, size = [], 0
        if held:
            ready.append(finish(current, held))
        if ready:
            yield table()

    return dealt.mapInArrow(run, f"`{conv}` {key}, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what the formatted output says: its turns and its learned text."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                said = hashlib.sha256()
                for r, t in parse(text):
                    said.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                learned = "".join(unescape(text[s:e]) for s, e in zip(spans[::2], spans[1::2]))
                for k, v in zip(out, (said.hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text))):
                    out[k].append(v)
            kinds = {"turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
            yield pa.RecordBatch.from_arrays([b.column(conv), b.column("n_turns"), *[pa.array(out[k], v) for k, v in kinds.items()]], names=[conv, "n_turns", *kinds])

    key = formatted.schema[conv].dataType.simpleString()
    return formatted.select(conv, "n_turns", "formatted", "loss_spans").mapInArrow(
        run, f"`{conv}` {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
