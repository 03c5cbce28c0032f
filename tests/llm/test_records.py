import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sequela.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "",
    "one",
    " leading and  double   spaces ",
    "line\nline \n mixed\n\n\tend\n",
    "it's we'll I'd, numbers 12 345,6 and (marks)...!!",
    "é ü ñ 漢字     \x1c x\x00y 😀 　z",
    "<|endoftext|> is text here <|endoftext|>",
    "a\x0bb\x0cc\rd \r\n e",
]


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_encode_like_the_whole(text):
    enc = records.Encoder(PATH)
    texts = [text, None, *TEXTS, text + " " + text]
    for _ in range(2):
        got = [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(pa.array(texts))]
        assert got == [library().encode(x or "", add_special_tokens=False).ids for x in texts]


def test_frames_come_back_and_damage_is_seen():
    ids = np.arange(5, dtype="<u2").tobytes()
    data = records.frame(-7, ids, 2)
    doc_id, back = records.unframe(data)
    assert doc_id == -7 and back.tolist() == [0, 1, 2, 3, 4]
    assert records.unframe(records.frame(None, b"", 2))[0] is None
    for place in range(len(data)):
        bad = bytearray(data)
        bad[place] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_round_trip(spark, documents, tmp_path):
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)] + f" {i}") for i in range(50)]
    got = records.token_records(documents(rows), PATH, str(tmp_path / "out"))
    start, lib = 0, library()
    want = []
    for doc_id, text in sorted(rows):
        ids = [*lib.encode(text, add_special_tokens=False).ids, records.END_ID]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_odd_rows(odd, documents):
    got = sorted((tuple(r) for r in records.token_records(odd, PATH).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == [None, None, 1, 2, 3, 4, 4, 5, 6, 7]
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    assert {r[0]: r[2] for r in got if r[0] in (1, 2)} == {1: 1, 2: 1}
    assert records.token_records(documents([]), PATH).collect() == []
