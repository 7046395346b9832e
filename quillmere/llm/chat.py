"""Chat formatting at the level of tokens.

A conversation is formatted as

    <turn>\\n ROLE \\n TEXT \\n</turn>\\n      for each turn

where the three control strings are single reserved ids spliced between segments that are encoded on their
own, so that no text can give them: OPEN ("<turn>\\n"), BODY ("\\n" after the role) and CLOSE
("\\n</turn>\\n"). The written-out form is as safe: wherever a control string occurs in a role or a text,
the backslashes before it, n of them, become 2n + 1. A control string of the template itself never follows a
backslash. Both steps are undone when the output is read back.

The loss mask covers exactly the ids of assistant texts. It is the running sum of +1 where such a text
begins and -1 after it, over the ids of a conversation.

The table written has one row a segment's chunk, in order: conv_id, pos (place of its first id within the
conversation), ids, mask. No row holds more than CHUNK ids, so one endless conversation is many rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import resting, saved, sent, text_slices
from .tokens import byte_decoder, word_cache

#: Fixed values of the template: strings that may not stand unescaped inside a text.
CONTROLS = ["<turn>", "</turn>", "### System:", "### User:", "### Assistant:", "<|endoftext|>"]
#: How the reserved ids are written out.
OPEN, BODY, CLOSE = "<turn>\n", "\n", "\n</turn>\n"
CHUNK = 65_536
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")
_ESCAPED = re.compile(r"(\\+)(" + "|".join(map(re.escape, CONTROLS)) + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def reserved_ids(tokenizer_size: int) -> dict[str, int]:
    """The ids of OPEN, BODY and CLOSE: the first three after the vocabulary's own."""
    return {"open": tokenizer_size, "body": tokenizer_size + 1, "close": tokenizer_size + 2}


def format_conversations(turns: DataFrame, tokenizer: str, size: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Return conv_id, pos (long), ids (array<int>), mask (array<byte>): the formatted conversations in chunks.

    Null roles and texts count as empty. Turns stand in the order of (turn, role, text), null turns first,
    so ties and repeated rows have a defined place too. Rows with a null conv_id are one conversation.
    Other columns are not read, and no turns give no rows. Every turn is encoded on its own, wherever its row
    lies. Turns are sorted over the cluster by (conversation, turn), so a conversation of a third of all rows is
    dealt over many tasks; a task adds up the ids of its own stretch of each conversation, and the stretches
    before it, a row a task and conversation, are added to that.
    """
    own = reserved_ids(size)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    # Sorted before they are encoded, for the bounds of the ranges come from a first pass over the rows.
    sorted_rows = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")

    @resting
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer)
        special = re.compile("|".join(map(re.escape, cache.special)) or r"(?!)")
        part, now, total = TaskContext.get().partitionId(), (), 0

        def segment(value: str) -> bytes:
            parts, at = [], 0
            value = escape(value)
            for m in special.finditer(value):  # a special token's string is ordinary text here: cut inside it
                parts.append(value[at : m.start() + 1])
                at = m.start() + 1
            return b"".join(cache.encode([*parts, value[at:]]))

        for batch in batches:
            for some in text_slices(batch):
                ids, size, begin, before = [], [], [], []
                for c, r, t in zip(*(some.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                    head, body = np.frombuffer(segment(r), "<u4"), np.frombuffer(segment(t), "<u4")
                    ids.append(np.concatenate([[own["open"]], head, [own["body"]], body, [own["close"]]]).astype(np.int32))
                    begin.append(len(head) + 2)
                    size.append(len(ids[-1]))
                    now, total = (c,), total if now == (c,) else 0
                    before.append(total)
                    total += size[-1]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(np.concatenate(ids)))
                numbers = [pa.array(begin, pa.int32()), pa.array(size, pa.int32()), pa.array([part] * len(size), pa.int32()), pa.array(before, pa.int64())]
                yield pa.RecordBatch.from_arrays([some.column("conv_id"), some.column("role"), flat, *numbers], names=["conv_id", "role", "ids", "begin", "size", "part", "pos"])

    added = saved(sorted_rows.mapInArrow(encode, "conv_id long, role string, ids array<int>, begin int, size int, part int, pos long"), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = added.groupBy("conv_id", "part").agg(F.sum("size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    # Only stretches that begin within a conversation have something before them: one a task at most.
    later = stretches.where("base > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "base")
    placed = added.join(sent(later), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").withColumn("pos", F.col("pos") + F.coalesce("base", F.lit(0)))

    @resting
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, pos, ids, masks = [], [], [], []
            for c, p, r, b, part in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "pos", "role", "begin")), batch.column("ids"), strict=True):
                part = part.values.to_numpy(zero_copy_only=False)
                change = np.zeros(len(part) + 1, np.int8)
                if r == trained:
                    change[b] += 1
                    change[len(part) - 1] -= 1
                covered = np.cumsum(change[:-1], dtype=np.int8)
                for at in range(0, len(part), CHUNK):
                    conv.append(c)
                    pos.append(p + at)
                    ids.append(part[at : at + CHUNK])
                    masks.append(covered[at : at + CHUNK])
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(pos, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))], names=["conv_id", "pos", "ids", "mask"])

    return placed.select("conv_id", "pos", "role", "begin", "ids").mapInArrow(mask, "conv_id long, pos long, ids array<int>, mask array<tinyint>")


class _Reader:
    """What has been read of one conversation. Texts of a turn are joined before they are decoded."""

    def __init__(self, conv, own: dict[str, int], table):
        self.conv, self.own, self.table = conv, own, table
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.held: list[np.ndarray] = []
        self.masks: list[np.ndarray] = []

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        begin = 0
        for end in np.flatnonzero(ids == self.own["close"]).tolist():
            self.held.append(ids[begin:end])
            self.masks.append(mask[begin:end])
            self._turn(np.concatenate(self.held), np.concatenate(self.masks))
            self.held, self.masks, begin = [], [], end + 1
        self.held.append(ids[begin:])
        self.masks.append(mask[begin:])

    def _text(self, ids: np.ndarray) -> str:
        return self.table.decode(ids).decode("utf-8", "replace")

    def _turn(self, ids: np.ndarray, mask: np.ndarray) -> None:
        cut = int(np.flatnonzero(ids == self.own["body"])[0])
        role, text = self._text(ids[1:cut]), self._text(ids[cut + 1 :])
        self.turns += 1
        self.chars += len(OPEN) + len(role) + len(BODY) + len(text) + len(CLOSE)
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        under = unescape(self._text(ids[mask > 0]))
        self.loss_chars += len(under)
        self.loss.update(under.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """Digest of each conversation, from the table of ids and masks alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Rows stream past sorted by (conv_id, pos); a task keeps the
    open turn only, however long a conversation is."""
    own = reserved_ids(size)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    @resting
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = byte_decoder(tokenizer), None
        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask"), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv, own, table)
                now.feed(ids.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), kinds, strict=True)], names=names)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def extra_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own strings."""
    hard = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
