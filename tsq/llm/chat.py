"""Chat formatting at token level (operator 10).

Every turn is assembled from parts that are encoded separately: reserved ids
for the marks of the template, byte-level BPE ids for the text.  Text can't
make a reserved id, and in the rendered form a control string that occurs in a
text is escaped: one backslash more after its first character (so the rule
also escapes its own results, and taking one away restores the text).

    system     <s>[SYS]text[/SYS]
    user       <s>[INST]text[/INST]
    assistant  <s>text</s>
    others     <s>[ROLE]role[/ROLE]text</s>

The loss mask of a turn is the prefix sum of +1 where an assistant's text
begins and -1 where it ends.  Turns are formatted where they lie, without a
shuffle, and written as one row each.  They are read back, rendered and
counted where they lie, too; then a conversation's rows are sorted and streamed
through its digests, so a long conversation needs little memory.

Defined cases: a null text or role is empty; a null turn comes first, equal
turns are ordered by role and then by text; rows with a null conv_id are one
conversation; a text of any length is encoded whole; an empty table has
conversation -1 alone in the query, and rows of the table that have that id
are turns of the same conversation.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.llm.base import partitions, plain, prepare

#: The vocabulary file, by the name that ``public_tokenizers.path`` takes.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Control strings in the order of their reserved ids, which follow the vocabulary's.
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"]
FIRST_MARK = 50256
BOS, EOS, INST, END_INST, SYS, END_SYS, ROLE, END_ROLE = range(FIRST_MARK, FIRST_MARK + len(MARKS))
#: White space of this length or more is encoded apart: the library's pattern
#: recurses along it.
LONG_SPACE = 10_000
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)

_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?(?:INST|SYS|ROLE)\])")

TURNS_DDL = "conv_id long, turn long, role string, ids binary, mask binary"
READ_DDL = "conv_id long, turn long, role string, text string, loss string, chars long"
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


_ENCODING: dict = {}


def encoding(name: str = TOKENIZER):
    if name not in _ENCODING:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        make = lambda pattern: tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _ENCODING[name], _ENCODING[name, "piece"] = make(public_tokenizers.PATTERN), make(r"[\s\S]+")
    return _ENCODING[name]


def encode_text(text: str) -> list[int]:
    """The ids of a whole text.  A long run of white space is one piece of the
    pattern, up to its last character if something follows."""
    enc, out, at = encoding(), [], 0
    for run in _SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[at:run.start()]) + _ENCODING[TOKENIZER, "piece"].encode_ordinary(text[run.start():stop])
        at = stop
    return out + enc.encode_ordinary(text[at:])


def format_turn(role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a turn and its loss mask."""
    body = encode_text(escape(text))
    marks = {"system": ([BOS, SYS], [END_SYS]), "user": ([BOS, INST], [END_INST]), "assistant": ([BOS], [EOS])}
    if role in marks:
        before, after = marks[role]
    else:
        before, after = [BOS, ROLE, *encode_text(escape(role)), END_ROLE], [EOS]
    ids = np.array([*before, *body, *after], np.uint16)
    step = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        step[len(before)] += 1
        step[len(before) + len(body)] -= 1
    return ids, np.cumsum(step[:-1]).astype(bool)


def render(ids: np.ndarray) -> str:
    """The formatted string that ids stand for: control strings for reserved
    ids, text in its escaped form."""
    enc, out, at = encoding(), [], 0
    for k in np.flatnonzero(ids >= FIRST_MARK).tolist():
        out += [enc.decode_bytes(ids[at:k].tolist()).decode(), MARKS[int(ids[k]) - FIRST_MARK]]
        at = k + 1
    return "".join([*out, enc.decode_bytes(ids[at:].tolist()).decode()])


def read_turn(ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
    """Role, text and text under the loss mask of a formatted turn, and the
    number of characters of its rendered form."""
    shown = render(ids)
    head = "".join(MARKS[int(i) - FIRST_MARK] for i in ids[:2] if i >= FIRST_MARK)
    tail = len(MARKS[int(ids[-1]) - FIRST_MARK])
    if ids[1] == SYS:
        role, begin = "system", len(head)
    elif ids[1] == INST:
        role, begin = "user", len(head)
    elif ids[1] == ROLE:
        end = MARKS[END_ROLE - FIRST_MARK]
        stop = shown.index(end)  # a role's own control strings are escaped
        role, begin = unescape(shown[len(head):stop]), stop + len(end)
    else:
        role, begin = "assistant", len(MARKS[0])
    text = unescape(shown[begin:len(shown) - tail])
    loss = unescape(encoding().decode_bytes(ids[mask].tolist()).decode())
    return role, text, loss, len(shown)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [format_turn(r, t) for r, t in zip(plain(batch.column(2)).to_pylist(), plain(batch.column(3)).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), plain(batch.column(2)), pa.array([i.astype("<u2").tobytes() for i, _ in made], pa.binary()),
             pa.array([np.packbits(m, bitorder="little").tobytes() for _, m in made], pa.binary())],
            names=["conv_id", "turn", "role", "ids", "mask"])


def write_chats(turns: DataFrame, path: str) -> None:
    """Format all rows (conv_id, turn, role, text) and write one row per turn to ``path``."""
    prepare(turns.sparkSession)
    (turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
     .mapInArrow(_format, TURNS_DDL).write.parquet(path))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted turns to what their ids and masks say (a null loss: the whole text)."""
    for batch in batches:
        got = []
        for raw, bits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            ids = np.frombuffer(raw, "<u2")
            mask = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little", count=len(ids)).astype(bool)
            role, text, loss, chars = read_turn(ids, mask)
            got.append((role, text, None if loss == text else loss, chars))
        cols = zip(*got) if got else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64())))],
                                         names=["conv_id", "turn", "role", "text", "loss", "chars"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to one row per conversation, hashed as they stream by."""
    conv, state, begun = None, None, False

    def close():
        n, turns, loss_chars, loss, chars = state
        return (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

    for batch in batches:
        out = []
        for c, role, text, loss, chars in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if not begun or c != conv:
                if begun:
                    out.append(close())
                conv, state, begun = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            loss = text if loss is None else loss
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, _DIGEST)], schema=_DIGEST)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(close(), _DIGEST)], schema=_DIGEST)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role, text, loss (null: the whole text), chars of every
    turn of the files at ``path``, read back from ids and mask where they lie."""
    prepare(spark)
    turns = spark.read.schema(TURNS_DDL).parquet(path)
    return turns.select("conv_id", "turn", "ids", "mask").mapInArrow(_read, READ_DDL)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation of the files at ``path``, read back from them:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Decoding is spread over all tasks; a conversation's task only hashes, as
    a digest needs its turns in order."""
    return (read_turns(spark, path).repartition(partitions(spark), "conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text", "loss", "chars")
            .mapInArrow(_digest, DIGEST_DDL))
