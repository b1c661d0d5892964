"""Phrases, word runs and token counts against plain Python, the library and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from rillbook.llm import phrases, token_counts, word_runs
from tests.conftest import SF
from tests.llm.test_operators import LONG

JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like the operators' own."""
    names = "doc_id bigint, text string, lang string, chunk bigint, word string, n bigint, r string, size int, start int"
    text = "the same text stands in two rows " * 9
    rows = [
        (1, text), (1, text), (2, text + "Yes."), (None, None), (None, "no id but some words"), (3, ""), (4, "  \n\t "),
        (5, LONG), (6, "x" * 50_000), (7, "퟿￿ 😀 ñ  z"), (8, None), (9, "one"), (10, "a " * 300),
    ]
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, 1, "w", 7, "r", 3, 0) for k, (i, t) in enumerate(rows)], names)


# 11


def plain_phrases(rows, least, covered=80, top=2000):
    uses = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3, 4):
                uses[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in uses.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= covered * f[p[i:j]]}
        rows = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_phrases_of_the_table(docs):
    got = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert got and got == plain_phrases(docs.select("lang", "text").collect(), 30)


def test_phrases_over_many_chunks(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["É", "ñ", "A", "a"]
    rows = []
    for _ in range(200):
        text = "".join(draw.choice(words)[: draw.randint(1, 4)] + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(draw.randint(0, 150)))
        text += " The Quick brown fox jumps over. " * draw.choice([0, 0, 3]) + " new york city hall , new york" * draw.choice([0, 2])
        rows.append((draw.choice(["en", "de", None]), text))
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(map(tuple, phrases.collocations(table, least=8, chunk=2000, top=50).collect()))
    want = plain_phrases(rows, 8, top=50)
    assert len(want) > 100 and got == want


def test_tile_counts():
    draw = np.random.default_rng(1)
    left, right = np.concatenate([draw.integers(0, 200, (2, 200_000)), draw.integers(0, 2**31, (2, 1000)), draw.integers(300, 9000, (2, 50_000))], 1)
    codes = phrases.address(left, right)
    want = collections.Counter(zip(left.tolist(), right.tolist()))
    found, counts = phrases.tile_counts(codes)
    assert (np.diff(found) > 0).all()
    low = (1 << phrases.SIDE) - 1
    i, j = found >> 40 << phrases.SIDE | found >> phrases.SIDE & low, (found >> 16 & (1 << 24) - 1) << phrases.SIDE | found & low
    assert dict(zip(zip(i.tolist(), j.tolist()), counts.tolist())) == want
    again, twice = phrases.tile_counts(np.concatenate([found, found]), np.concatenate([counts, counts << 40]))
    assert (again == found).all() and (twice == counts + (counts << 40)).all()
    assert [len(x) for x in phrases.tile_counts(np.zeros(0, np.int64))] == [0, 0]
    with pytest.raises(ValueError):
        phrases.address(np.array([1 << 31]), np.array([0]))


def test_phrases_of_odd_tables(odd):
    rows = [(r.lang, r.text) for r in odd.collect()]
    for table, want in ((odd, plain_phrases(rows, 30)), (odd.filter("false"), []), (odd.filter("text is null"), [])):
        assert sorted(map(tuple, phrases.collocations(table).collect())) == want


# 12


def plain_runs(words, min_length=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def test_runs_against_every_period():
    draw, seen = random.Random(3), 0
    for _ in range(1500):
        letters, words = draw.choice([1, 2, 3, 5, 50]), []
        while len(words) < draw.randint(0, 140):
            block = [draw.randrange(letters) for _ in range(draw.randint(1, 12))]
            words += (block * draw.choice([1, 1, 14]))[: draw.randint(1, 70)]
        for least, times in ((24, 3), (6, 3), (12, 4)):
            want = plain_runs(words, least, times)
            assert word_runs.find_runs(np.array(words, np.int64), least, times) == want
            assert not want or word_runs.with_repeats(np.array(words), np.array([len(words)]), -(-least * (times - 1) // times))[0]
            seen += len(want)
    assert seen > 1000


def test_long_runs_and_many_left_words():
    assert word_runs.find_runs(np.full(100_000, 7)) == [(0, 100_000, 1)]
    assert word_runs.find_runs(np.tile(np.arange(300), 200)) == [(0, 60_000, 300)]
    phrase = list(range(30))
    assert word_runs.find_runs(np.array([w for i in range(2000) for w in (100 + i, *phrase)])) == []


def run_row(doc_id, text, prepared):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if prepared and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), kept)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_runs_of_the_table(docs):
    short = docs.filter("length(text) < 12000")
    rows = _sorted(run_row(r.doc_id, r.text, True) for r in short.collect())
    got = word_runs.word_runs(short, word_runs.periodic_tail).collect()
    assert _sorted(got) == rows and sum(r.n_runs > 0 for r in got) > 10


def test_runs_of_odd_tables(odd):
    rows = [r for r in odd.collect() if r.doc_id != 5]
    table = odd.filter("doc_id is null or doc_id <> 5")
    for prepared in (None, word_runs.periodic_tail):
        assert _sorted(word_runs.word_runs(table, prepared).collect()) == _sorted(run_row(r.doc_id, r.text, prepared) for r in rows)
    long = word_runs.word_runs(odd.filter("doc_id = 5"), with_text=True).first()
    assert (long.n_runs, long.period, long.collapsed) == (1, 5, "lorem ipsum dolor sit amet")
    assert word_runs.word_runs(odd.filter("false")).collect() == []
    with pytest.raises(ValueError):
        word_runs.word_runs(odd, min_exponent=2)


# 13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(JSON)
    return lambda text: len(one.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_like_the_library(docs, odd, library):
    for table in (docs, odd):
        want = [(r.doc_id, len((r.text or "").encode()), n := library(r.text), n > 512) for r in table.collect()]
        assert _sorted(token_counts.token_counts(table, JSON).collect()) == _sorted(want)
    assert token_counts.token_counts(odd.filter("false"), JSON).collect() == []


def test_token_counts_of_odd_strings(library):
    parts = ["a", "s", "re", "r", "v", "ll", "'", "'s", "'re", " ", "  ", "\n", "\t", "　", "1", "²", "é", "日本", "!", "...", "<|endoftext|>", "<|endof", "E", "the", "ing", "Ֆ", "😀", "\x85", "\x1c", "----", "=="]
    draw = random.Random(1)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(8000)]
    assert token_counts.counter(JSON)(texts).tolist() == list(map(library, texts))


def test_chunks_compose_like_one_pass():
    draw = np.random.default_rng(2)
    kinds = draw.integers(0, token_counts.KINDS, 5000).astype(np.uint8)
    kinds[-1] = token_counts.END
    state, starts = token_counts.NEW, set()
    for i, kind in enumerate(kinds.tolist()):
        state, marks = token_counts.transition(state, kind)
        starts |= {i} if marks & token_counts.HERE else set()
        starts |= {i - 1} if marks & token_counts.BEFORE else set()
    for chunk, chunks in ((64, 16_384), (7, 5), (1, 3), (5000, 1)):
        assert token_counts.piece_starts(kinds, chunk, chunks).tolist() == sorted(starts)


def test_states_start_anew(library, monkeypatch):
    monkeypatch.setattr("rillbook.llm.automaton.MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "PIECES", 20)
    texts = [f"unbelievable {i} antidisestablishmentarianism{i}" for i in range(200)]
    assert token_counts.Counter(JSON)(texts).tolist() == list(map(library, texts))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(P.path("word_bpe_49k.json"))
