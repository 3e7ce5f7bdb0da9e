import hashlib
import random
from array import array

import public_tokenizers
import pytest
from texts import documents, frame
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def ids(encoder, text):
    return bpe._unpack(encoder.encode(text)).tolist()


def test_same_ids_as_the_library(encoder, library):
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "ß", "日本", "1", "23", "½", "²", "<|endoftext|>", "!", "-----", "\x1c", "\x85", "\u200b", "힣", "😀", "e\u0301", "aaaaaaa", "=", "\r\n", "Ⅷ", "\u3000", "\x00"]
    decoder = bpe.Decoder(encoder.tables)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        found = ids(encoder, text)
        assert found == library.encode(text, add_special_tokens=False).ids
        assert decoder.push(found) + decoder.finish() == library.decode(found, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000, "thethere" * 2000, "-" * 9000, "日本" * 2000])
def test_long_pieces_stream_in_bounded_memory(encoder, library, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids
    machine = bpe.Transducer(encoder.tables, {})
    out, most = [], 0
    data = text.encode()
    for at in range(0, len(data), 1000):
        out += machine.push(data[at : at + 1000])
        most = max(most, len(machine.held))
    out += machine.finish()
    assert out == library.encode(text, add_special_tokens=False).ids
    assert most < 4 * encoder.tables.lookahead


def test_short_pieces_go_through_the_transducer_to_the_same_ids(encoder):
    rng = random.Random(6)
    machine, tokens = bpe.Transducer(encoder.tables, {}), list(encoder.tables.id_of)
    pieces = [bytes(rng.choice(b"abeinst \xc3\xa9") for _ in range(rng.randint(1, encoder.tables.lookahead))) for _ in range(1000)]
    pieces += [b"".join(rng.choice(tokens) for _ in range(3))[: encoder.tables.lookahead] for _ in range(3000)]
    for data in pieces:
        assert machine.whole(data) == [*machine.push(data), *machine.finish()]


def test_long_texts_are_encoded_in_portions(encoder, library):
    text = "one 22 three's\n\n" * 9000 + "x" * 5000 + " end <|endoftext|>" + "\t" * 70
    portions = list(encoder.stream(text))
    assert b"".join(portions) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
    assert all(portions) and max(map(len, portions)) < 4 * bpe.STEP


def test_decoding_takes_ids_in_any_portions(encoder):
    found = ids(encoder, "日本語 😀 été")
    decoder = bpe.Decoder(encoder.tables)
    assert "".join(decoder.push([i]) for i in found) + decoder.finish() == "日本語 😀 été"
    assert decoder.push(found[:1]) + decoder.finish() != ""  # a cut character comes out as a replacement


def test_documents(spark, library):
    rows = {r["doc_id"]: r for r in bpe.round_trip(frame(spark), PATH).collect()}
    for doc_id, text, *_ in documents():
        expected = library.encode(text or "", add_special_tokens=False).ids
        row = rows[doc_id]
        assert row["n_tokens"] == len(expected)
        assert row["ids_sha256"] == hashlib.sha256(array("I", expected).tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(frame(spark), PATH)
    assert encoded.count() == len(documents())
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH).collect()}
    assert texts == {d[0]: d[1] or "" for d in documents()}
    assert bpe.round_trip(frame(spark, []), PATH).count() == 0
