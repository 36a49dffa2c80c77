"""Chat formatting by token-level assembly.

Every turn is escaped and encoded on its own; reserved ids are spliced in
around it, so markers never depend on how neighbouring text is merged.  The
loss mask of a conversation is the prefix sum of +1 / -1 steps at the
borders of its assistant texts.

Template: ``[INST]text[/INST]`` for a user, ``<s>text</s>`` for an
assistant, ``[ROLE]role[/ROLE]text[END]`` for any other role.  Control
strings inside a text get a backslash after their first character and every
backslash of the text is doubled, which ``unescape`` takes back.

Defined cases: a null text is empty, a null role is the empty role; rows
are ordered by (turn, role, text) with null turns first; repeated rows are
repeated turns; a null conversation id is a conversation of its own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Control strings; the n-th has the reserved id ``first_reserved + n``.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[END]")
_BOS, _EOS, _INST, _INST_END, _ROLE, _ROLE_END, _END = range(len(CONTROL))
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_MARK = re.compile(r"\\(\\?)")
_SEGMENT = ("conv_id bigint, seg int, role string, ids array<int>, loss_from int, loss_to int, chars bigint")


def escape(text: str) -> str:
    """Doubles backslashes and splits control strings; reversible."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _MARK.sub(r"\1", text)


def _tokenizer(path):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def segments(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """One encoded segment per turn, with its place in the conversation:
    (conv_id, seg, role, ids, loss_from, loss_to, chars, token_start).

    ``loss_from`` / ``loss_to`` are positions inside the segment.  Encoding
    is a map over rows, so a conversation of any length is encoded in
    parallel; ``token_start`` is a running sum that spills.
    """

    def encode(batches):
        tokenizer = _tokenizer(tokenizer_path)
        base = tokenizer.get_vocab_size()
        for batch in batches:
            conv, turn, role, text = (c.to_pylist() for c in batch.columns)
            escaped_text = [escape(t) for t in text]
            escaped_role = [escape(r) for r in role]
            ids_text = [e.ids for e in tokenizer.encode_batch(escaped_text, add_special_tokens=False)]
            ids_role = [e.ids for e in tokenizer.encode_batch(escaped_role, add_special_tokens=False)]
            ids, start, stop, chars = [], [], [], []
            for r, er, et, ir, it in zip(role, escaped_role, escaped_text, ids_role, ids_text):
                if r == "user":
                    head, tail, shown = [base + _INST], [base + _INST_END], len(CONTROL[_INST] + CONTROL[_INST_END])
                elif r == "assistant":
                    head, tail, shown = [base + _BOS], [base + _EOS], len(CONTROL[_BOS] + CONTROL[_EOS])
                else:
                    head, tail = [base + _ROLE, *ir, base + _ROLE_END], [base + _END]
                    shown = len(CONTROL[_ROLE] + er + CONTROL[_ROLE_END] + CONTROL[_END])
                ids.append([*head, *it, *tail])
                on = r == "assistant"
                start.append(len(head) if on else 0)
                stop.append(len(head) + len(it) if on else 0)
                chars.append(shown + len(et))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(chars, pa.int64())],
                names=["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to", "chars"])

    narrow = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    encoded = narrow.mapInArrow(encode, "conv_id bigint, turn bigint, role string, text string, ids array<int>, "
                                        "loss_from int, loss_to int, chars bigint")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.size("ids").cast("bigint")
    return (encoded.select("conv_id", F.row_number().over(order).alias("seg"), "role", "ids", "loss_from", "loss_to", "chars",
                           (F.sum(size).over(before) - size).alias("token_start")))


def loss_mask(lengths: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Mask over the concatenated segments: prefix sums of the border steps."""
    first = np.cumsum(lengths) - lengths
    steps = np.zeros(int(lengths.sum()) + 1, np.int32)
    np.add.at(steps, first + start, 1)
    np.add.at(steps, first + stop, -1)
    return np.cumsum(steps)[:-1].astype(bool)


class _Reader:
    """Reads turns and the masked text back from ids and mask alone."""

    def __init__(self, tokenizer):
        self.t, self.base = tokenizer, tokenizer.get_vocab_size()

    def text(self, ids) -> str:
        return unescape(self.t.decode(ids, skip_special_tokens=False)) if len(ids) else ""

    def turns(self, ids: np.ndarray, mask: np.ndarray):
        """(role, text, masked text) of every turn of a run of whole segments."""
        marks = np.flatnonzero(ids >= self.base)
        at = 0
        while at < len(marks):
            kind = ids[marks[at]] - self.base
            if kind == _ROLE:
                role = self.text(ids[marks[at] + 1: marks[at + 1]].tolist())
                lo, hi, at = marks[at + 1] + 1, marks[at + 2], at + 3
            else:
                role = "user" if kind == _INST else "assistant"
                lo, hi, at = marks[at] + 1, marks[at + 1], at + 2
            text = self.text(ids[lo:hi].tolist())
            inside = mask[lo:hi]
            masked = text if len(inside) and inside.all() else self.text(ids[lo:hi][inside].tolist())
            yield role, text, masked


def digest(segs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Read every conversation back from its ids and mask: (conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens).

    Segments stream in order through running digests, so memory does not
    grow with a conversation."""

    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint, n_tokens bigint")

    def read(batches):
        reader = _Reader(_tokenizer(tokenizer_path))
        state, done = None, []

        def close():
            c, n, turns, lc, loss, fc, nt = state
            done.append((c, n, turns.hexdigest(), lc, loss.hexdigest(), fc, nt))

        for batch in batches:
            conv = batch.column(0).to_pylist()
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            mask = loss_mask(lengths, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            chars = batch.column(4).to_pylist()
            ends = np.cumsum(lengths)
            i = 0
            while i < len(conv):
                j = i
                while j < len(conv) and conv[j] == conv[i]:
                    j += 1
                if state is None or state[0] != conv[i]:
                    if state is not None:
                        close()
                    state = [conv[i], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                lo, hi = int(ends[i] - lengths[i]), int(ends[j - 1])
                for role, text, masked in reader.turns(flat[lo:hi], mask[lo:hi]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += sum(chars[i:j])
                state[6] += hi - lo
                i = j
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=arrow)
                done.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=arrow)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    arrow = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    ordered = segs.select("conv_id", "ids", "loss_from", "loss_to", "chars", "seg").sortWithinPartitions("conv_id", "seg")
    return ordered.mapInArrow(read, schema)
