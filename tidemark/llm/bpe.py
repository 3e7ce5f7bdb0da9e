"""Byte-level BPE as a streaming transducer, and its inverse.

Why little lookahead is enough: the encoding of a byte string, cut at one of its token
ends, is the encoding of that prefix. So every prefix has one last token, and the
encoding of any longer string goes through a prefix that ends within the length of the
longest token before the current end. That length, taken from the merge list, is the
lookahead: once the token chains of all prefixes that close to the end go through one
common prefix, everything before it can never change and is emitted. A prefix's last
token is the one token that ends there and follows the last token of the prefix before
it without merging with it.

Texts are first cut into pieces by the tokenizer's pattern; a piece runs through the
transducer. While no more than the lookahead is held nothing can be emitted, so a piece
that ends within it is walked from its front (``whole``): same ids, in half the time. A
text of any length is cut, encoded and decoded in portions. Pieces repeat, so each worker keeps the ids of short pieces in a table of
bounded size.

Null text counts as empty: no ids, and decodes to the empty text. Extra columns are left
out of the result, repeated rows are encoded each for itself.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_parts, text_or_empty

# Fixed value: the pattern of byte-level tokenizers that cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, REMEMBERED, STEP, PORTION, LISTED = 64, 1 << 18, 4096, 1 << 14, 1 << 17
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves; the others, in order, take the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tables:
    """Tokens, merges and special strings of a tokenizer file."""

    def __init__(self, content: str) -> None:
        model = json.loads(content)
        letters = byte_letters()
        vocab = model["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in specials.items()}
        self.specials = specials
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        reachable = {bytes(letters[c] for c in t): i for t, i in vocab.items() if len(t) == 1}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merged = vocab[left + right]
            self.merge[vocab[left], vocab[right]] = (rank, merged)
            reachable[self.bytes_of[merged]] = merged
        self.id_of = reachable
        self.lookahead = max(map(len, reachable))
        self.longest: dict[bytes, int] = {}  # by first three bytes
        self.longest_back: dict[bytes, int] = {}  # by last three bytes
        for data in reachable:
            if len(data) > 2:
                self.longest[data[:3]] = max(len(data), self.longest.get(data[:3], 0))
                self.longest_back[data[-3:]] = max(len(data), self.longest_back.get(data[-3:], 0))

        # Parts of each token that touch its left or right end, with the ranks of the merges that make and consume them.
        made = {merged: (pair, rank) for pair, (rank, merged) in sorted(self.merge.items(), key=lambda x: -x[1][0])}
        self.left_parts = {t: self._parts(t, made, 0) for t in self.bytes_of}
        self.right_parts = {t: self._parts(t, made, 1) for t in self.bytes_of}

    @staticmethod
    def _parts(token: int, made: dict, side: int) -> list[tuple[int, int, int]]:
        parts, consumed = [], NEVER
        while True:
            pair, rank = made.get(token, (None, -1))
            parts.append((token, rank, consumed))
            if pair is None:
                return parts
            token, consumed = pair[side], rank

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, each complete, also come out when their bytes stand side by side.

        They do not if a part at the end of the first and a part at the start of the second
        exist at one time and merge with each other before either is merged into its own
        token. At equal rank the merge further left comes first.
        """
        for a, born_a, gone_a in self.right_parts[left]:
            for b, born_b, gone_b in self.left_parts[right]:
                found = self.merge.get((a, b))
                if found and found[0] < gone_a and found[0] <= gone_b and born_a < gone_b and born_b < gone_a:
                    return False
        return True


class Transducer:
    """Takes the bytes of one piece in any portions and gives out ids once they are stable."""

    def __init__(self, tables: Tables, apart: dict[tuple[int, int], bool]) -> None:
        self.tables, self.apart = tables, apart
        self.start()

    def start(self) -> None:
        self.held = b""  # bytes after the last stable token end
        self.last: list[int] = [-1]  # last token of each prefix of held
        self.back: list[int] = [0]  # where that token begins

    def _apart(self, left: int, right: int) -> bool:
        if len(self.apart) >= 4 * REMEMBERED:
            self.apart.clear()
        known = self.apart[left, right] = self.tables.stay_apart(left, right)
        return known

    def _advance(self) -> None:
        """Find the last token of every prefix that has none yet."""
        held, last, back, apart = self.held, self.last, self.back, self.apart.get
        id_of, longest = self.tables.id_of.get, self.tables.longest_back.get
        for end in range(len(last), len(held) + 1):
            reach = longest(held[end - 3 : end], 2) if end > 2 else end
            for at in range(end - reach if end > reach else 0, end):
                token = id_of(held[at:end])
                if token is None:
                    continue
                before = last[at]
                if before >= 0:
                    known = apart((before, token))
                    if not (self._apart(before, token) if known is None else known):
                        continue
                last.append(token)
                back.append(at)
                break

    def whole(self, piece: bytes) -> list[int]:
        """Ids of a piece no longer than the lookahead, whose end is therefore in view from the start.

        With the end in view tokens can be tried from the front, longest first, going back
        where none fits: the only row of tokens that all stay apart is the encoding.
        """
        id_of, apart, longest = self.tables.id_of.get, self.apart.get, self.tables.longest.get
        n, ids, begins, dead = len(piece), [], [], set()
        at, before = 0, -1
        end = min(n, longest(piece[:3], 2))
        while at < n:
            while end > at:
                token = id_of(piece[at:end])
                if token is not None and end not in dead:
                    if before < 0:
                        break
                    known = apart((before, token))
                    if self._apart(before, token) if known is None else known:
                        break
                end -= 1
            if end > at:
                ids.append(token)
                begins.append(at)
                at, before = end, token
                end = min(n, at + longest(piece[at : at + 3], 2))
            else:
                dead.add(at)
                end, at = at - 1, begins.pop()
                ids.pop()
                before = ids[-1] if ids else -1
        return ids

    def push(self, data: bytes) -> Iterator[int]:
        for begin in range(0, len(data), STEP):
            self.held += data[begin : begin + STEP]
            self._advance()
            yield from self._stable()

    def _chain(self, end: int) -> list[int]:
        """Token ends on the way back from ``end`` to the start."""
        ends = [end]
        while ends[-1]:
            ends.append(self.back[ends[-1]])
        return ends

    def _stable(self) -> Iterator[int]:
        n = len(self.held)
        common = n - self.tables.lookahead + 1
        if common <= 0:
            return
        on_chain = set(self._chain(common))
        for end in range(common + 1, n + 1):
            at = end
            while at not in on_chain:
                at = self.back[at]
            if at < common:
                common = at
        yield from self._emit(common)

    def _emit(self, end: int) -> Iterator[int]:
        ends = self._chain(end)[-2::-1]
        yield from [self.last[e] for e in ends]
        if end:
            context = self.last[end]
            self.held = self.held[end:]
            self.last = [context, *self.last[end + 1 :]]
            self.back = [0, *[max(0, b - end) for b in self.back[end + 1 :]]]

    def finish(self) -> Iterator[int]:
        yield from self._emit(len(self.held))
        self.start()


class Encoder:
    def __init__(self, content: str) -> None:
        self.tables = Tables(content)
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.transducer = Transducer(self.tables, {})

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as packed unsigned 32-bit integers."""
        machine, data = self.transducer, piece.encode()
        ids = machine.whole(data) if len(data) <= self.tables.lookahead else [*machine.push(data), *machine.finish()]
        packed = array("I", ids).tobytes()
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def _long(self, piece: str) -> Iterator[bytes]:
        """Packed ids of a piece of any length, as they become stable."""
        for begin in range(0, len(piece), STEP):
            if stable := array("I", self.transducer.push(piece[begin : begin + STEP].encode())):
                yield stable.tobytes()
        yield array("I", self.transducer.finish()).tobytes()

    def _between(self, text: str, begin: int, end: int) -> Iterator[bytes]:
        known, piece = self.known.get, self.piece
        if end - begin <= LISTED:  # characters whose pieces may be listed at once
            yield b"".join([known(p) or piece(p) for p in self.pieces.findall(text, begin, end)])
            return
        for found in self.pieces.finditer(text, begin, end):
            part = found[0]
            yield from (known(part) or piece(part),) if len(part) <= SHORT else self._long(part)

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, piece by piece."""
        done = 0
        for found in self.tables.special.finditer(text) if self.tables.special is not None else ():
            yield from self._between(text, done, found.start())
            yield array("I", [self.tables.specials[found[0]]]).tobytes()
            done = found.end()
        yield from self._between(text, done, len(text))

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream(text))


class Decoder:
    """Ids in any portions to text: bytes that are not yet a whole character are held back."""

    def __init__(self, tables: Tables) -> None:
        self.bytes_of = tables.bytes_of
        self.characters = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.characters.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        rest = self.characters.decode(b"", True)
        self.characters.reset()
        return rest


@lru_cache(maxsize=1)
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def _unpack(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    return ids


def _content(spark: SparkSession, path: str):
    """The tokenizer file, sent to every worker once: a vocabulary of a few megabytes whatever the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, carry: Sequence[str] = ("doc_id",), *, verify: bool = False) -> DataFrame:
    """The ``carry`` columns and ``ids`` (array of int) of the ``text`` of every row of ``docs``.

    With ``verify`` also ``decodes``: whether the ids, decoded in the same pass, give the text.
    """
    content = _content(docs.sparkSession, path)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        decoder = Decoder(encoder.tables)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            ids = [_unpack(encoder.encode(t.as_py())) for t in texts]
            columns, names = [*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names[:-1], "ids"]
            if verify:
                same = [decoder.push(x) + decoder.finish() == t.as_py() for x, t in zip(ids, texts, strict=True)]
                columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "decodes"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", decodes boolean" if verify else ""
    return in_parts(docs.select(*carry, text_or_empty().alias("_encoded")), run, f"{fields}, ids array<int>{more}")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows ``(doc_id, ids)``; no ids, or NULL, give the empty text."""
    content, key = _content(rows.sparkSession, path), rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_encoder(content.value).tables)
        for batch in batches:
            texts = [decoder.push(ids or ()) + decoder.finish() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_parts(rows.select("doc_id", "ids"), run, f"doc_id {key}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode, in one pass: ids and text stay in the worker, their digests come out."""
    content, key = _content(docs.sparkSession, path), docs.schema["doc_id"].dataType.simpleString()

    def digests(encoder: Encoder, decoder: Decoder, text: str) -> tuple[int, str, str]:
        ids, decoded, n, stream = hashlib.sha256(), hashlib.sha256(), 0, encoder.stream(text)
        while portion := b"".join(islice(stream, PORTION)):
            ids.update(portion)
            decoded.update(decoder.push(_unpack(portion)).encode())
            n += len(portion) // 4
        decoded.update(decoder.finish().encode())
        return n, ids.hexdigest(), decoded.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        decoder = Decoder(encoder.tables)
        for batch in batches:
            found = [digests(encoder, decoder, t.as_py()) for t in batch.column(1)]
            counts, ids, texts = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return in_parts(docs.select(F.col("doc_id"), text_or_empty()), run, schema)
