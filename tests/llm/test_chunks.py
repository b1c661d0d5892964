"""Texts cut into chunks, each distinct one encoded once."""

import base64
import random

import public_tokenizers as P
import pyarrow as pa
import pytest

from rillbook.llm import chunks, prefix_bpe, record_files

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
AWKWARD = " \n\t\r\x0b\x1c\x85\xa0  　​ ab'sStreldñÉßд中😀!?,.-–…×÷09²٣́\x00"


def awkward(n=3000, longest=25):
    draw = random.Random(7)
    return ["".join(draw.choices(AWKWARD, k=draw.randint(0, longest))) for _ in range(n)]


def counted(encoder):
    """The number of chunks that reach ``encode_all``, in a list that grows."""
    inner, seen = encoder.encode_all, []
    encoder.encode_all = lambda part: (seen.extend(part), inner(part))[1]
    return seen


def test_records_encode_distinct_words_once():
    from tokenizers import Tokenizer

    draw, words = random.Random(3), [f"word{'xyz'[k % 3]}{chr(97 + k // 26)}{chr(97 + k % 26)}é" for k in range(300)]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", ", ", ".\n", "!  ", "\n\n"]) for _ in range(400)) for _ in range(50)]
    encoder = record_files.tokenizer.__wrapped__(JSON)
    seen = counted(encoder)
    tk = Tokenizer.from_file(JSON)
    for _ in range(2):
        assert [i.tolist() for i in encoder.encode(pa.array(texts))] == [tk.encode(t, add_special_tokens=False).ids for t in texts]
    # A word comes after a space, two, a line break, two, or at the start of a text: 20,000 uses, 5 forms and some marks.
    assert len(seen) == len(set(seen)) < 300 * 5 + 40


@pytest.mark.parametrize("options", [{}, {"limit": 40, "longest": 6}])
def test_record_chunks_like_the_library(options):
    from tokenizers import Tokenizer

    tk, known = Tokenizer.from_file(JSON), record_files.tokenizer(JSON)
    encoder = chunks.ChunkEncoder(known.encode_all, known.literals, group_bytes=1000, **options)
    texts = [*awkward(), "a <|endoftext|> b, c", "", "x" * 5000, None, "x<|endoftext|>, y\nz"]
    # Texts of a slice begin in the middle of its buffer.
    got = [i.tolist() for i in encoder.encode(pa.array(["cut off", *texts, "too"])[1:-1])]
    assert got == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(encoder.encode(pa.array([], pa.string()))) == []


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tables_share_beginnings(monkeypatch):
    built = []
    fill = prefix_bpe.PrefixTable._fill
    monkeypatch.setattr(prefix_bpe.PrefixTable, "_fill", lambda self, begin, stop: (built.append(stop - begin), fill(self, begin, stop))[1])
    encoder = prefix_bpe.Encoder(prefix_bpe.encoder(RANKS, P.PATTERN).vocabulary)
    stem = "unwordlikebeginningsofthesort"
    text = ", ".join(f"{stem}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)) + "\n"
    assert encoder.decode(encoder.encode(text * 3)).decode() == text * 3
    # Of 400 words that begin alike, one is built whole and one more without its space.
    assert sum(built) < 400 * 3 + 100
    encoder.encode(text)
    assert sum(built) < 400 * 3 + 100


def test_bpe_table_of_other_data():
    v = prefix_bpe.encoder(RANKS, P.PATTERN).vocabulary
    table = prefix_bpe.PrefixTable(v)
    for text in sorted(t.encode() for t in awkward(500)) + [b"", b"abc", b"abcd", b"ab", b"xb"]:
        assert table.become(text).last == prefix_bpe.PrefixTable(v, text).last and table.data == text


def test_bpe_chunks_like_the_library(library):
    encoder = prefix_bpe.Encoder(prefix_bpe.encoder(RANKS, P.PATTERN).vocabulary)
    encoder.chunks.limit, encoder.chunks.group_bytes = 40, 1000
    texts = [*awkward(), "", None, "x" * 5000]
    got = list(encoder.chunks.encode(pa.array(texts)))
    assert [i.tolist() for i in got] == [library.encode_ordinary(t or "") for t in texts]
    assert [encoder.decode(i.tobytes()) for i in got] == [(t or "").encode() for t in texts]


def test_bpe_ids_on_request(spark, library):
    texts = [*awkward(50), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in prefix_bpe.encode_documents(rows, RANKS, P.PATTERN, with_ids=True).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
