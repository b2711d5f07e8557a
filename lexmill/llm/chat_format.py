"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Running sums of turn tokens choose the spans: a window holds the leading
system turn again, then as many of the last turns before it as fit the history budget, then new turns while the window's
budget lasts. Tokens are those of the turn as it is written, marks and escapes included. Only assistant turns that are new in a
window are targets; repeated ones are masked, so over all windows every assistant text is a target once. Where a turn is large, the
history gives way from its oldest turn on; the system turn stays. A window that the system turn and one new turn alone bring above
the budget is marked ``over_budget``. Only a system turn that fills the whole budget itself is not repeated: no turn fits beside it.

Turns are marked by ``<|role|>`` and ``<|end|>``. Control strings inside texts are escaped by one more backslash after their
first character, which can be undone exactly.

Rows of a conversation are sorted by turn (null first), then role and text, and streamed: memory holds one window and the
history, not the conversation. A conversation is one stream in one task because its digest is sequential.

Edge cases: null text or role is empty; a null conv_id is a conversation; equal turns are all kept; extra columns are ignored;
an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch
from lexmill.llm.token_orc import WordCodec

#: Tokens of a window, and of the turns repeated in it.
BUDGET, HISTORY = 2048, 512
#: What follows the first character of a control string of this or another common template.
_TAIL = r"(?=\||/?s>|/?INST\]|/?SYS>)"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[])(\\*)" + _TAIL), re.compile(r"([<\[])\\(\\*)" + _TAIL)
_TURN, _END = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.DOTALL), "<|end|>\n"
WINDOW = "conv_id long, window long, n_turns int, n_repeated int, n_tokens long, over_budget boolean, text string, mask array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _write(role: str, text: str) -> tuple[str, str]:
    name = quote(role, safe="").replace("-", "%2D")  # "-" alone is the empty role
    return f"<|{name or '-'}|>\n", escape(text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted window."""
    return [("" if r == "-" else unquote(r), unescape(t)) for r, t in _TURN.findall(text)]


class _Windows:
    """Windows of one conversation, from its turns in order."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system, self.recent, self.recent_tokens = None, deque(), 0
        self.new: list[tuple] = []
        self.sum, self.base, self.n, self.seen = 0, 0, 0, 0  # running sum; the sum at which the new turns' room begins

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        out = None
        if self.new and self.sum + tokens - self.base > self.budget - self._carried():
            out = self.close()
        turn = (role, text, tokens)
        if not self.seen and role == "system" and tokens < self.budget:
            self.system = turn
        self.new.append(turn)
        self.sum += tokens
        self.seen += 1
        return out

    def _repeated(self) -> list[tuple]:
        return ([self.system] if self.system and self.n else []) + list(self.recent)

    def _carried(self) -> int:
        return sum(t for *_, t in self._repeated())

    def close(self) -> dict | None:
        if not self.new:
            return None
        old = self._repeated()
        fixed = len(old) - len(self.recent)  # the system turn
        while len(old) > fixed and sum(t for *_, t in [*old, *self.new]) > self.budget:  # a large turn: less history, oldest first
            del old[fixed]
        parts, mask, at = [], [], 0
        for i, (role, text, _) in enumerate([*old, *self.new]):
            head, body = _write(role, text)
            start = at + len(head)
            if role == "assistant" and i >= len(old):
                mask.append({"start": start, "end": start + len(body)})
            parts += [head, body, _END]
            at = start + len(body) + len(_END)
        tokens = sum(t for *_, t in [*old, *self.new])
        out = {"conv_id": self.conv_id, "window": self.n, "n_turns": len(old) + len(self.new), "n_repeated": len(old), "n_tokens": tokens, "over_budget": tokens > self.budget, "text": "".join(parts), "mask": mask}
        for turn in self.new:
            if turn is not self.system:
                self.recent.append(turn)
                self.recent_tokens += turn[2]
            while self.recent and self.recent_tokens > self.history:
                self.recent_tokens -= self.recent.popleft()[2]
        self.new, self.base, self.n = [], self.sum, self.n + 1
        return out


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _streamed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in names), strict=True)


def _format(tokenizer_path: str, budget: int, history: int):
    def run(batches):
        codec, now, out, size = WordCodec.load(tokenizer_path), None, [], 0
        for conv_id, role, text in _streamed(batches, ["conv_id", "role", "text"]):
            if now is None or conv_id != now.conv_id:
                out += [now.close()] if now and now.new else []
                now = _Windows(conv_id, budget, history)
            if (w := now.add(role, text, len(codec.encode("".join((*_write(role, text), _END)))) // 4)) is not None:
                out.append(w)
            size += len(text)
            if len(out) > 2000 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                out, size = [], 0
        out += [now.close()] if now and now.new else []
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return run


def format_windows(spark: SparkSession, conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation; ``mask`` has the code points of ``text`` that are targets."""
    if budget <= 0 or not 0 <= history <= budget // 2:
        raise ValueError("history must lie between 0 and half the budget")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(tokenizer_path, budget, history), WINDOW)


def _read_back(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state, done = None, []

    def flush():
        cols = list(zip(*done, strict=True)) if done else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def end(s):
        done.append((s["id"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"]))

    for conv_id, repeated, text, mask in _streamed(batches, ["conv_id", "n_repeated", "text", "mask"]):
        if state is None or state["id"] != conv_id:
            if state:
                end(state)
            state = {"id": conv_id, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
        for role, body in read_turns(text)[repeated:]:
            state["n"] += 1
            state["turns"].update(f"{role}\n{body}\n".encode())
        for span in mask:
            body = unescape(text[span["start"] : span["end"]])
            state["chars"] += len(body)
            state["loss"].update(body.encode())
        state["all"] += len(text)
        if len(done) > 5000:
            yield flush()
            done.clear()
    if state:
        end(state)
    yield flush()


def conversation_digests(spark: SparkSession, windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from windows."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = windows.select("conv_id", "window", "n_repeated", "text", "mask").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_format(spark: SparkSession, conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows written to the shared folder, and their digests read back."""
    windows = Scratch(spark, "chat").save(format_windows(spark, conversations, tokenizer_path, budget, history), "windows")
    return conversation_digests(spark, windows)
