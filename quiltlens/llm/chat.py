"""Chat formatting by token-level assembly: segments encoded separately, reserved ids spliced in, masks by prefix sums."""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from quiltlens.llm.rows import partitions
from quiltlens.llm.token_orc import BYTE_LETTERS, encoder
from quiltlens.session import shared_dir

PIECE_TOKENS = 16_384
STRETCH_TURNS = 1_000  # turns of a conversation that one task assembles
STRETCH = 1_000_000  # characters encoded at once
_ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are marked. Reserved ids follow the vocabulary in the order of ``controls``.

    ``turns`` gives role, opening and closing string; other roles are spelled out between ``name`` and ``text`` and close
    with ``end``. ``foreign`` are strings that are no marks of the template but must not occur in content, either.
    """

    turns: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    name: str = "[ROLE]"
    text: str = "[TEXT]"
    end: str = "[/TEXT]"
    loss_roles: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = ("<|endoftext|>",)

    def __post_init__(self):
        every = [*self.controls, *self.foreign]
        if len(set(every)) < len(every) or any(len(c) < 2 or _ESCAPE in c for c in every):
            raise ValueError("control strings must differ, have two characters or more and no backslash")
        for a in every:
            for b in every:
                if any(b.startswith(a[i:]) for i in range(1, len(a))) or (a != b and a in b):
                    raise ValueError(f"control strings overlap: {a} {b}")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(c for _, a, b in self.turns for c in (a, b)) + (self.name, self.text, self.end)

    def pattern(self, escapes: str) -> str:
        """Matches a control string with ``escapes`` after its first character; groups: that character, the rest."""
        kinds: dict[str, list[str]] = {}
        for c in (*self.controls, *self.foreign):
            kinds.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"({re.escape(first)}{escapes})({'|'.join(rest)})" for first, rest in sorted(kinds.items()))

    def escape(self, text: str) -> str:
        """One more backslash after the first character of each control string and of what escaping has made of one."""
        return _subbed(self.pattern(r"\\*"), text, lambda a, b: a + _ESCAPE + b)

    def unescape(self, text: str) -> str:
        return _subbed(self.pattern(r"\\+"), text, lambda a, b: a[:-1] + b)


def _subbed(pattern: str, text: str, put) -> str:
    return re.sub(pattern, lambda m: put(*[g for g in m.groups() if g is not None]), text)


def _encode(text: str, path: str) -> bytes:
    """Ids of a segment as little-endian integers. Very long ones are cut before a space between two other characters,
    where no pre-token of a byte-level tokenizer can reach across."""
    enc, out, start = encoder(path), [], 0
    while len(text) - start > STRETCH:
        cut = _CUT.search(text, start + STRETCH)
        if not cut:
            break
        out.append(enc.encode(text[start:cut.start() + 1]))
        start = cut.start() + 1
    return b"".join(out) + enc.encode(text[start:])


_CUT = re.compile(r"\S \S")


def _turns(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    plain = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return rows.select(conv.alias("conv"), turn.alias("turn"), *plain)


def write_chats(rows: DataFrame, path: str, tokenizer: str, template: Template = Template(), piece_tokens: int = PIECE_TOKENS, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> None:
    """Write ``conv, part, at, n_turns, ids, loss`` as Parquet: token ids of whole turns and, per token, whether the loss counts it.

    Each turn's escaped text is encoded where its row lies, so a long conversation is encoded by many tasks. Then turns
    are range-partitioned by conversation and thousand of turn numbers and assembled in order: reserved ids are spliced
    in between, and the mask is the running sum of +1 at the first and -1 after the last token of each text of a loss
    role. A conversation is one row, but for those of more than ``piece_tokens`` tokens and those of more than a thousand
    turns, which several tasks may assemble: their pieces follow each other by ``part`` and ``at``. So memory is bounded,
    but for the longest text.

    Null text counts as empty, a null role as the role ''. Turns with a null number come first; equal numbers are ordered
    by role and a hash of the text, and repeated rows are turns of their own. Rows with a null conversation form one conversation. No
    rows give an empty table. Other columns are ignored.
    """
    spark = rows.sparkSession
    turns = _turns(rows, rows[conv_col], rows[turn_col], rows[role_col], rows[text_col])
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    opens = {role: (2 * i, 2 * i + 1) for i, (role, _, _) in enumerate(template.turns)}
    name, said, end = (2 * len(template.turns) + i for i in range(3))

    def encode(batches):
        base = encoder(tokenizer).tokenizer.get_vocab_size()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                ids, heads, tails = [], [], []
                for role, text in zip(piece.column("role").to_pylist(), piece.column("text").to_pylist()):
                    own = _encode(template.escape(text), tokenizer)
                    if role in opens:
                        head, tail = _id(base + opens[role][0]), _id(base + opens[role][1])
                    else:
                        head, tail = _id(base + name) + _encode(template.escape(role), tokenizer) + _id(base + said), _id(base + end)
                    ids.append(head + own + tail)
                    heads.append(len(head) // 4)
                    tails.append((len(head) + len(own)) // 4)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("conv", "turn", "role", "text")), pa.array(ids, pa.binary()), pa.array(heads, pa.int32()), pa.array(tails, pa.int32())],
                                                 names=["conv", "turn", "role", "text", "ids", "first", "last"])

    coded = turns.mapInArrow(encode, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, text string, ids binary, first int, last int")
    coded = coded.withColumn("tie", F.xxhash64("role", "text")).withColumn("counts", F.col("role").isin(*template.loss_roles)).drop("text")
    order = ["conv", "turn", "role", "tie"]
    stretch = F.floor(F.col("turn") / STRETCH_TURNS) if isinstance(turns.schema["turn"].dataType, NumericType) else F.col("turn")
    placed = coded.repartitionByRange(partitions(spark), F.col("conv"), stretch).sortWithinPartitions(*order).select("conv", F.spark_partition_id().alias("part"), "ids", "first", "last", "counts")

    def assemble(batches):
        held, key, part, at, tokens, made = [], None, None, 0, 0, []
        for batch in batches:
            for conv, part, ids, first, last, counts in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "ids", "first", "last", "counts"))):
                if held and ((conv,) != key or tokens + len(ids) // 4 > piece_tokens):
                    made.append((key[0], part, at, len(held), *assembled(held)))
                    held, at, tokens = [], at + 1, 0
                    if sum(len(m[4]) for m in made) >= 8 * piece_tokens:
                        yield _pieces(made, kind)
                        made = []
                key = (conv,)
                held.append((ids, first, last, counts))
                tokens += len(ids) // 4
        if held:
            made.append((key[0], part, at, len(held), *assembled(held)))
        if made:
            yield _pieces(made, kind)

    kind = to_arrow_type(placed.schema["conv"].dataType)
    made = placed.mapInArrow(assemble, f"conv {kinds['conv']}, part int, at long, n_turns long, ids array<int>, loss array<boolean>")
    made.write.mode("error").parquet(path)


def _id(i: int) -> bytes:
    return i.to_bytes(4, "little")


def assembled(turns: list[tuple[bytes, int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of turns put together: the mask is the running sum of +1 and -1 where counted texts begin and end."""
    lengths = np.array([len(t[0]) // 4 for t in turns], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    ids = np.frombuffer(b"".join(t[0] for t in turns), dtype="<i4")
    change = np.zeros(len(ids) + 1, dtype=np.int8)
    own = np.array([t[3] for t in turns], dtype=bool)
    np.add.at(change, (starts + [t[1] for t in turns])[own], 1)
    np.add.at(change, (starts + [t[2] for t in turns])[own], -1)
    return ids, np.cumsum(change[:-1], dtype=np.int8).astype(bool)


def _pieces(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, part, at, n, ids, loss = zip(*made)
    offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, kind), pa.array(part, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()),
         pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(loss)))],
        names=["conv", "part", "at", "n_turns", "ids", "loss"])


class Reader:
    """Turns token ids back into turns."""

    def __init__(self, tokenizer: str, template: Template):
        model = encoder(tokenizer).tokenizer
        letters = {chr(v): k for k, v in BYTE_LETTERS.items()}
        self.base, self.template = model.get_vocab_size(), template
        special = {i: t.content.encode() for i, t in model.get_added_tokens_decoder().items()}
        self.bytes = [b""] * self.base
        for token, i in model.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = special[i] if i in special else bytes(letters[c] for c in token)
        self.role_of = {self.base + 2 * i: role for i, (role, _, _) in enumerate(template.turns)}
        self.name = self.base + 2 * len(template.turns)

    def content(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")

    def turns(self, ids: np.ndarray):
        """``(role, text, n_formatted)`` of each turn, unescaped; n_formatted counts the characters with marks and escapes."""
        at = np.flatnonzero(ids >= self.base)
        i = 0
        while i < len(at):
            opening = int(ids[at[i]])
            marks, role, spelled = [opening], self.role_of.get(opening), 0
            if opening == self.name:
                inner = self.content(ids[at[i] + 1:at[i + 1]])
                role, spelled = self.template.unescape(inner), len(inner)
                i += 1
                marks.append(int(ids[at[i]]))
            inner = self.content(ids[at[i] + 1:at[i + 1]])
            marks.append(int(ids[at[i + 1]]))
            yield role, self.template.unescape(inner), spelled + len(inner) + sum(len(self.template.controls[m - self.base]) for m in marks)
            i += 2

    def counted(self, ids: np.ndarray, loss: np.ndarray):
        """The unescaped texts of the runs of tokens under the mask."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            yield self.template.unescape(self.content(ids[a:b]))

    def formatted(self, ids: np.ndarray) -> str:
        """The formatted text: marks spelled out, content escaped."""
        at = np.flatnonzero(ids >= self.base)
        out, start = [], 0
        for i in at:
            out += [self.content(ids[start:i]), self.template.controls[int(ids[i]) - self.base]]
            start = i + 1
        return "".join([*out, self.content(ids[start:])])


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def chat_digests(spark: SparkSession, path: str, tokenizer: str, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """From the files: ``conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Pieces are sorted by conversation and place and streamed: a digest is carried on from piece to piece, so no
    conversation is held as a whole. A digest runs over all its bytes in order, which ties each conversation to one task;
    what is streamed there are its token ids.
    """
    pieces = read_chats(spark, path)
    kind = pieces.schema["conv"].dataType
    ordered = pieces.repartition(partitions(spark), "conv").sortWithinPartitions("conv", "part", "at")

    def digest(batches):
        reader, out, state = Reader(tokenizer, template), [], None
        for batch in batches:
            ids, loss = batch.column("ids"), batch.column("loss")
            for i, conv in enumerate(batch.column("conv").to_pylist()):
                if state is None or state[0] != (conv,):
                    if state:
                        out.append(_told(state))
                    state = [(conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own = ids[i].values.to_numpy(zero_copy_only=False)
                for role, text, n in reader.turns(own):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[5] += n
                for text in reader.counted(own, loss[i].values.to_numpy(zero_copy_only=False)):
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
            if len(out) >= 1000:
                yield _batch(out, arrow)
                out = []
        if state:
            out.append(_told(state))
        yield _batch(out, arrow)

    arrow = to_arrow_type(kind)
    found = ordered.mapInArrow(digest, f"conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.withColumnRenamed("conv", conv_col)


def _told(state: list) -> tuple:
    return state[0][0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_chats(rows: DataFrame, tokenizer: str, template: Template = Template(), path: str | None = None, conv_col: str = "conv_id", **options) -> DataFrame:
    """Write all conversations (under the shared folder unless ``path`` is given) and return the digests read back from the files."""
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/quiltlens/chats-{uuid.uuid4().hex}"
    write_chats(rows, path, tokenizer, template, conv_col=conv_col, **options)
    return chat_digests(spark, path, tokenizer, template, conv_col)
