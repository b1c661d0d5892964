"""The operators against plain Python, exact round trips and awkward tables."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillbook.llm import (
    common, forest_search, html_text, licences, mixing, ngram_join, prefix_bpe, pseudonyms, record_files, secret_scan, weak_rules,
)
from rillbook.llm.queries import llm_oracle_sql, llm_queries
from rillbook.session import LONG_TEXT_CONF
from tests.conftest import SF
from tools.oracle_check import compare, duck_frame, spark_frame

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like the operators' own."""
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, row string, kept boolean, node int"
    text = "The same text stands here in two rows, and it has more than ten words."
    rows = [
        (1, text), (1, text), (2, text + " Yes."), (None, None), (None, "no id but some words"), (3, ""), (4, "  \n\t "),
        (5, LONG), (6, "x" * 50_000), (7, "퟿￿ 😀 ñ  z"), (8, None), (9, "one"),
    ]
    return spark.createDataFrame([(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None, 7, "r", False, 1) for k, (i, t) in enumerate(rows)], names)


OPERATORS = {
    "pii": pseudonyms.pseudonym_report,
    "secrets": secret_scan.secret_spans,
    "quality": weak_rules.quality_report,
    "mix": mixing.mix_report,
    "join": ngram_join.join_report,
    "records": lambda d: record_files.document_records(d, JSON, 2),
    "licences": licences.scanned,
    "bpe": lambda d: prefix_bpe.encode_documents(d, RANKS, P.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_of_an_awkward_table(odd, name):
    got = OPERATORS[name](odd).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.filter("false")).collect() == []


@pytest.mark.parametrize("stage", range(4))
def test_stage_keeps_columns(spark, odd, stage):
    _, step = corpus_pipeline.STAGES[stage]
    for table in (odd, odd.filter("false")):
        got = step(spark, table, SF)
        assert got.columns == odd.columns
        got.collect()


def test_pipeline_rows(spark, docs):
    good = {r.doc_id for r in weak_rules.quality_report(docs).filter("kept").collect()}
    kept = weak_rules.good_documents(docs)
    assert {r.doc_id for r in kept.collect()} == good
    one = ngram_join.one_of_each(kept)
    classes = ngram_join.join_report(kept).collect()
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.class_id for r in classes})
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} <= {r.doc_id for r in one.collect()}
    assert all(r.n_tokens > 0 for r in final)


@pytest.mark.parametrize("stage", range(5))
def test_stage_sends_few_long_texts_at_once(spark, stage):
    """Executors hold a batch of a task on both sides of Python, whatever the length of the texts."""
    before = {k: spark.conf.get(k, None) for k in LONG_TEXT_CONF}
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat("id", F.lit(" word" * 1000)).alias("text"), F.lit("s").alias("source"))
    at_once = F.pandas_udf(lambda texts: pd.Series([texts.str.len().sum()] * len(texts)), "bigint")
    try:
        corpus_pipeline.STAGES[stage][1](spark, rows, SF)
        assert rows.agg(F.max(at_once("text"))).first()[0] < 8 << 20
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", list(llm_oracle_sql()))
def test_sql(spark, duck, name):
    assert compare(spark_frame(llm_queries()[name](spark, SF)), duck_frame(duck, llm_oracle_sql()[name])) == ""


# 1


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_forest_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    ids, m = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = collections.defaultdict(list)
    for r in sorted(forest_search.nearest(table).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    hits = 0
    for i, v in rows:
        if i % 20 == 0:
            scores = m @ v
            order = [k for k in np.lexsort((ids, -scores)) if ids[k] != i][:20]
            hits += len({int(ids[k]) for k in order} & {j for j, _ in got[i]})
            assert got[i] == sorted(got[i], key=lambda x: (-x[1], x[0]))
            assert all(abs(s - float(v @ m[list(ids).index(j)])) < 1e-12 for j, s in got[i])
    assert hits >= 0.9 * 20 * len(got)


def test_forest_odd_vectors(spark):
    bad = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [float("nan"), 1.0], 0), (4, [None, 1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0], 0), (6, [], 0)]
    good = [(20, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (21, [3.0, 0.0], 0), (22, [3.0, 0.0], 0), (40, [0.0, 2.0], 0)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in forest_search.nearest(_vectors(spark, bad + good)).collect()}
    assert got[20, 1] == (21, 3.0) and got[20, 2] == (22, 3.0) and got[20, 3] == (40, 0.0)
    assert {q for q, _ in got} == {20, 40} and len(got) == 6
    assert forest_search.nearest(_vectors(spark, bad[:1])).collect() == []


@pytest.mark.parametrize("lengths", ["even", "lognormal", "few long"])
def test_forest_finds_all_on_other_vectors(spark, lengths):
    """Rows of unlike lengths, whose nearest are far from each other in the trees."""
    draw = np.random.default_rng(3)
    m = draw.normal(size=(6000, 32))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m *= {"even": 1, "lognormal": draw.lognormal(0, 1, (6000, 1)), "few long": np.where(draw.random((6000, 1)) < 0.004, 30, 1)}[lengths]
    m = m.astype(np.float32).astype(float)
    got = collections.defaultdict(list)
    for r in forest_search.nearest(_vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(m)])).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for i in range(0, 6000, 20):
        scores = m @ m[i]
        scores[i] = -np.inf
        assert got[i] == np.argsort(-scores, kind="stable")[:20].tolist()


def test_forest_many_copies(spark):
    """Copies that no plane can part; blocks cut their leaf."""
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(500)] + [(1000 + i, [1.0, 2.0, float(i % 7)], 0) for i in range(100)]
    got = forest_search.nearest(_vectors(spark, rows), block_rows=64).filter("query_id = 0").orderBy("rank").collect()
    want = sorted(((v[0] + 2 * v[1] + 3 * v[2], -i) for i, v, _ in rows if i), reverse=True)[:20]
    assert [(r.score, -r.vec_id) for r in got] == want


# 2


def test_pseudonyms(spark):
    text = (
        "hein.19@mail5.example.com +1 (743) 555-3824, 8.196.197.208; 4111 1111 1111 1111 4111111111111111 "
        "1985-03-04 04.03.1985 123-45-6789 999.1.1.1 4111111111111112 2023-02-30"
    )
    out = pseudonyms.pseudonym_report(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (out.n_email, out.n_ip, out.n_date, out.n_ssn, out.n_phone, out.n_card) == (1, 1, 2, 1, 1, 2)
    for old in ("hein.19@", "555-3824", "8.196.197.208", "4111 1111", "4111111111111111", "1985", "123-45"):
        assert old not in out.text
    assert "999.1.1.1 4111111111111112 2023-02-30" in out.text
    a, b = re.search(r"((?:\d{4} ){3}\d{4}) (\d{16}) ", out.text).groups()
    assert a.replace(" ", "") == b
    d = [int(c) for c in b[::-1]]
    assert sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) == sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])
    assert (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0
    y, m, day = re.search(r"(\d{4})-(\d\d)-(\d\d) ", out.text).groups()
    assert f"{day}.{m}.{y}" in out.text


def test_pseudonyms_are_permutations(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    moved = rows.select(pseudonyms.permuted_digits("k", "x", F.col("d")).alias("p")).collect()
    assert len({r.p for r in moved}) == 1000
    days = spark.range(5000).select(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("m"))
    assert len({r.p for r in days.select(pseudonyms._date("k", F.col("m")).alias("p")).collect()}) == 5000
    names = spark.range(26 * 10).select(F.concat(F.chr((F.col("id") % 26 + 97)), (F.col("id") / 26).cast("int").cast("string")).alias("m"))
    assert len({r.p for r in names.select(pseudonyms.permuted_name("k", "x", F.col("m")).alias("p")).collect()}) == 260


def _pseudonymised(spark, *texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    return [r for r in pseudonyms.pseudonym_report(table).sort("doc_id").collect()]


def test_one_number_has_one_pseudonym(spark):
    forms = {
        "826 555 4081": ["+1 826 555 4081", "+18265554081", "+1 (826) 555-4081", "+1-826-555-4081", "(826) 555-4081", "826-555-4081"],
        "30 12345678": ["+49 30 12345678", "+493012345678", "+49 (30) 1234 5678", "+49-30-1234-5678"],
        "1 53 55 78": ["+353 1 535 5782", "+35315355782"],
    }
    digits = lambda t: re.sub("[^0-9]", "", t)
    for written in forms.values():
        got = _pseudonymised(spark, *written)
        assert all(r.n_phone == 1 for r in got), [r.text for r in got]
        code = "1" if "826" in written[0] else digits(written[0])[: 3 if written[0].startswith("+353") else 2]
        new = {digits(r.text)[len(code) :] if r.text.startswith("+") else digits(r.text) for r in got}
        assert len(new) == 1 and new != {digits(written[0])[len(code) :]}
        assert all(digits(r.text).startswith(code) for r in got if r.text.startswith("+"))
        assert [re.sub("[0-9]", "9", r.text) for r in got] == [re.sub("[0-9]", "9", w) for w in written]


def test_social_security_numbers_stay_valid(spark):
    rows = spark.range(10_000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 665 + 1, F.col("id") % 99 + 1, F.col("id") % 9999 + 1).alias("m"))
    new = [r.p for r in rows.select(pseudonyms._ssn("k", F.col("m")).alias("p")).collect()]
    assert len(set(new)) == rows.distinct().count() and all(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", p) for p in new)


def test_addresses_in_other_scripts(spark):
    names = ["иван", "jürgen.müller", "山田太郎", "αλέξης"]
    got = _pseudonymised(spark, *[f"{n}@example.com" for n in names])
    for name, r in zip(names, got):
        new = r.text.removesuffix("@example.com")
        assert r.n_email == 1 and new != name and len(new) == len(name) and new.count(".") == name.count(".")
    rows = spark.range(1024).select(F.concat(*[F.decode(F.unhex(F.lpad(F.hex(0x430 + F.floor(F.col("id") / d) % 32), 4, "0")), "UTF-16BE") for d in (1, 32)]).alias("m"))
    moved = {r.p for r in rows.select(pseudonyms.permuted_name("k", "x", F.col("m")).alias("p")).collect()}
    assert len(moved) == 1024 and all(re.fullmatch("[а-я]{2}", p) for p in moved)


def test_pseudonyms_of_neighbours(spark):
    phone, ip, card = "+1 (826) 555-4081", "190.137.223.204", "4111 1111 1111 1111"
    got = _pseudonymised(
        spark, phone, ip, card, f"{phone} {ip}", f"{card} 123", "12 4111111111111111", f"{card} 123-45-6789 1985-02-29",
        f"+49 30 1234567 1985-03-04 {card}", "41111111 11111111", f"{card} 2nd", "7 " * 30_000, "+49 30 123456 2019-02-30",
    )
    new = [r.text for r in got]
    assert not {phone, ip, card} & set(new)
    assert new[3] == f"{new[0]} {new[1]}" and new[4] == f"{new[2]} 123" and new[5] == "12 " + new[2].replace(" ", "")
    assert new[6].startswith(new[2] + " ") and new[6].endswith(" 1985-02-29") and (got[6].n_card, got[6].n_ssn, got[6].n_date) == (1, 1, 0)
    assert new[7].endswith(" " + new[2]) and (got[7].n_phone, got[7].n_date, got[7].n_card) == (1, 1, 1)
    assert new[8].replace(" ", "") == new[2].replace(" ", "") and new[9] == f"{new[2]} 2nd" and new[10] == "7 " * 30_000
    assert new[11].startswith("+49 ") and new[11].endswith(" 2019-02-30") and got[11].n_phone == 1


def test_pseudonyms_behind_marks(spark):
    texts = {
        "seen 8.8.8.8 here": "ip", "http://10.12.1.2/x": "ip", "-10.12.1.2": "ip", "10.12.1.2-10.12.1.9": "ip", "1985-03-04T10:00": "date",
        "a/1985-03-04": "date", ".04.03.1985": "date", "/123-45-6789": "ssn", "(123-45-6789)": "ssn", "card/4111111111111111": "card",
        "-4111 1111 1111 1111": "card", "(555-123-4567)": "phone", "电话10.1.1.1是": "ip", "a=1,b=8.8.8.8": "ip",
        "v10.2.3.4": "", "1.10.2.3.4": "", "10.2.3.4.5": "", "12-123-45-6789": "", "0.4111111111111111": "", "f4111111111111111": "",
    }
    for r in _pseudonymised(spark, *texts):
        old, kind = list(texts.items())[r.doc_id]
        assert [k for k in pseudonyms.KINDS if r[f"n_{k}"]] == [kind] * bool(kind) and (r.text != old) == bool(kind), old
        assert r.n_ip == (2 if old.count("10.12") == 2 else kind == "ip"), old


def test_pseudonyms_of_an_address_behind_a_phone(spark):
    rows = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet").filter("doc_id in (1377, 7052)")
    old = {r.doc_id: r.text for r in rows.collect()}
    pairs = {i: re.search(r"(\+1 \(\d{3}\) \d{3}-\d{4}) (\d+\.\d+\.\d+\.\d+)", t).groups() for i, t in old.items()}
    alone = [r.text for r in _pseudonymised(spark, *(v for i in sorted(pairs) for v in pairs[i]))]
    got = {r.doc_id: r.text for r in pseudonyms.pseudonym_report(rows).collect()}
    for k, i in enumerate(sorted(pairs)):
        assert " ".join(alone[2 * k : 2 * k + 2]) in got[i] and " ".join(pairs[i]) not in got[i]
    assert len(got) == 2


def test_nothing_personal_nothing_changed(docs):
    rows = docs.join(pseudonyms.pseudonym_report(docs).withColumnRenamed("text", "new"), "doc_id")
    free = rows.filter("n_email + n_ip + n_date + n_ssn + n_phone + n_card = 0")
    assert free.count() > 0 and free.filter("text <> new").count() == 0


# 3


def test_secrets_base(docs, plain):
    rx = {
        "assign": re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile("AKIA[A-Z0-9]+"),
        "hex": re.compile("[0-9a-f]+"),
    }
    got = {r.doc_id: r for r in secret_scan.secret_spans(docs).collect()}
    for i, text in plain:
        spans = []
        for k, (kind, r) in enumerate(rx.items()):
            for m in r.finditer(text or ""):
                if len(m[2] if kind == "assign" else m[0]) >= (8, 16, 32)[k]:
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        want = ",".join(s for _, _, s in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))


def test_guess_cost():
    cost = lambda v: secret_scan.guess_cost(v)[0]
    assert cost("") == 0 and cost("password") < cost("password1") < cost("xK9#mQ2$vL")
    assert cost("aaaaaaaaaaaa") < 6 and cost("1990-05-12") < 6 and cost("qwertyuiop") < cost("qmvxwzkypr")
    total, parts = secret_scan.guess_cost("password1990x")
    assert parts[0][0] == 0 and parts[-1][1] == 13 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_guess_spans():
    row = secret_scan.scan_text("pwd: xK9#mQ2$vL auth: plainword passphrase = password1 token=abc")
    assert row[3] == 1 and row[5] == "guess:5:15"


@pytest.mark.parametrize("text", [
    "pwd: qmvxwzkyprhgjdk", "passphrase=XKQJVBZMWPFH", "auth: Qmvxwzkyprhgjdk", "aws_secret_access_key = wJalrXUtnFEMI/K7MDENGbPxRfiCY",
    "DB_PWD=xK9#mQ2$vL", "STRIPE_AUTH=sk9xQz81LmPw77", "my.pw-value: xK9#mQ2$vL", "auth_key: xK9#mQ2$vL",
])
def test_guess_spans_of_names_and_one_case(text):
    value = re.split(" ?[=:] ?", text, maxsplit=1)[1]
    assert secret_scan.scan_text(text)[5] == f"guess:{text.index(value)}:{len(text)}"


@pytest.mark.parametrize("text", ["auth: required for everything", "The secret is understanding people.", "pin: somewhere", "login: Disabled", "xpwd: xK9#mQ2$vL"])
def test_prose_is_no_secret(text):
    assert secret_scan.scan_text(text)[3] == 0


# 4


def test_quality_counts(docs, plain):
    got = {r.doc_id: r for r in weak_rules.quality_report(docs).collect()}
    for i, text in plain:
        words, lines = WORDS.findall(text or ""), (text or "").split("\n")
        full = [x for x in lines if WORDS.search(x)]
        windows = collections.defaultdict(list)
        for k in range(len(words) - 4):
            windows[tuple(words[k : k + 5])].append(k)
        repeat = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(full) - len(set(full)), len(repeat))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeat) > 20 * len(words))
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("n", [49, 50, 2999, 3001, 100_000])
def test_few_distinct_words_are_bad_at_any_length(spark, n):
    draw = random.Random(n)
    variety = next(r for r in weak_rules.RULES if r.name == "variety")

    def vote(words):
        features = weak_rules.text_features(" ".join(words))
        row = spark.createDataFrame([features], ", ".join(f"{c} long" for c in weak_rules._NAMES))
        return tuple(row.select(F.expr(variety.bad), F.expr(variety.good)).first())

    junk = [f"w{draw.randrange(9)}" for _ in range(n)]
    prose = [f"w{int(200_000 ** draw.random())}" for _ in range(n)]
    assert vote(junk) == (n >= 50, False)
    assert not vote(prose)[0]


def test_quality_against_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = weak_rules.quality_report(docs).filter("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


# 5


def test_mix_by_hand(spark, odd):
    rows = [r.asDict() for r in mixing.mix_report(odd).collect()]
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 3
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    assert mixing.mix_report(odd).exceptAll(mixing.mix_report(odd)).count() == 0


def test_mixed_rows_hold_the_words_taken(docs):
    want = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(WORDS.findall(r.text))
        assert r.n_chars == len(r.text) or r.n_chars is not None
    assert {k: v for k, v in want.items() if v} == dict(got)


# 6


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    import html

    for r in html_text.extracted(pages).collect():
        body = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub("<[^>]*>", " ", b)) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for b in blocks if (x := re.sub(r"\s+", " ", b).strip())) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    page = (
        "<body class='has-sidebar'><div id=menu><ul><li>Home<li>Two</ul></div><div class=content><h2>Title</h2><div>Some long text, with marks; "
        "and more. It goes on.</div><p>Second<p>A &amp; &eacute;&nbsp; x<ul><li>one</ul></div><div id=comments><p>First! Great, very great.</div>"
        "<form><p>Search</form><script>if(a<b){'</p>'}</script><footer>c</footer>"
    )
    assert html_text.main_text(page) == "Title\nSome long text, with marks; and more. It goes on.\nSecond\nA & é x\none"
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p"), (3, "u", "<div>" * 2000 + "deep"), (3, "u", "<script>x"), (4, "u", "plain")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [r.text for r in got] == ["", "", "", "deep", "", "plain"]


LONG_TEXT = "Some long text, with marks; and more. It goes on, and on. " * 8


@pytest.mark.parametrize("page", [
    f"<main><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></main><article class=card><p>A teaser, not long. Read it.</p></article>",
    f"<div id=content><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div><article class=card><p>A teaser, not long. Read it.</p></article>",
    f"<div class=post><h1>The title</h1><div class=body><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div></div>",
    f"<div class=a><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div><div class=b><p>{LONG_TEXT[:60]}</p></div>",
    f"<body><form action=x><input><div><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div></form><form><p>Search</form></body>",
])
def test_chosen_blocks_stay(page):
    from rillbook.llm.html_text import THRESHOLD, content_paths, parsed

    _, blocks = parsed(page)
    chosen = content_paths(blocks, THRESHOLD)
    got = html_text.main_text(page).split("\n")
    assert got.count(LONG_TEXT.strip()) == 2
    assert all(b.text in got for b in blocks if b.element.path in chosen)
    assert "Search" not in got and ("<h1>" not in page or got[0] == "The title")


def test_scores_decide_about_names(spark):
    """Menus, adverts and footers lose by their scores: without the threshold they stay."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    assert all(html_text.main_text(p, threshold=0.0) != html_text.main_text(p) for p in pages)
    # No article element, no telling class: only text, marks and links are left to judge by.
    page = (
        "<body><div class=x1><ul>" + "".join(f"<li><a href=/{k}>Part {k}</a>" for k in range(30)) + "</ul></div>"
        "<div class=x2><p>Buy one now, get two.</p></div>"
        f"<div class=x3><h1>The title</h1><div><p>{LONG_TEXT}</p><p>Short.</p><ul><li>one<li>two</ul><p>{LONG_TEXT}</p></div></div>"
        "<div class=x4><p>Company, street, town.</p><a href=/i>Imprint</a></div></body>"
    )
    long = LONG_TEXT.strip()
    assert html_text.main_text(page) == "\n".join(["The title", long, "Short.", "one", "two", long])
    off = html_text.main_text(page, threshold=0.0)
    assert "Part 7" in off and "Buy one now, get two." in off and "Imprint" in off


@pytest.mark.parametrize("name", ["related-work", "legal", "search", "share", "alert", "side", "notice-period"])
def test_names_that_may_be_an_article(name):
    page = f"<article><h1>T</h1><p>{LONG_TEXT}</p><div class={name}><p>{LONG_TEXT}{LONG_TEXT}</p></div></article><footer>Imprint, legal.</footer>"
    assert html_text.main_text(page).count("Some long text") == 24


@pytest.mark.parametrize("page, text", [
    (f"<p>{LONG_TEXT}</p><!--><p>{LONG_TEXT}</p><!-- x --><p>{LONG_TEXT}</p><!--->", "\n".join([LONG_TEXT.strip()] * 3)),
    (f"<article><header><h1>Title</h1></header><p>{LONG_TEXT}</p></article><header><p>Site</p></header>", "Title\n" + LONG_TEXT.strip()),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p></article>", "Let x=1 hold."),
    (f"<article><p>{LONG_TEXT}</p><div class='user-comments'><article><p>{LONG_TEXT}</p></article></div></article>", LONG_TEXT.strip()),
    (f"<article><p>Tiny.</p></article><footer><p>{LONG_TEXT}</p></footer>", "Tiny."),
])
def test_parts_of_a_page(page, text):
    assert html_text.main_text(page) == text


def test_deep_pages_take_linear_time():
    started = time.process_time()
    for page in ("<div>x" * 50_000, "<div class=a><p>" * 50_000 + "deep", "<i>" * 50_000 + "<hr>t" * 50_000, "<b>" * 50_000 + "</u>" * 50_000):
        html_text.main_text(page)
    assert html_text.main_text("<div class=a>" * 50_000 + "deep") == "deep"
    assert time.process_time() - started < 60


def test_pages_with_clashing_names_and_without_rows(spark):
    rows = [(1, "u", "<p>One.", "x", 5), (1, "u", "<p>One.", "x", 5), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars bigint")
    got = html_text.extracted(table).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "One.", 4), (1, "One.", 4)]
    assert html_text.extracted(table.filter("false")).collect() == []


# 7


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_join_against_all_pairs(docs, plain):
    grams = {}
    for i, text in plain:
        w = WORDS.findall(text or "")
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in grams if grams[i])
    links = {i: {j for j in ids if j != i and _jaccard(grams[i], grams[j]) >= 0.8} for i in ids}
    for r in ngram_join.join_report(docs).collect():
        seen, todo = {r.doc_id}, [r.doc_id]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (r.class_id, r.n_links) == (min(seen), len(links.get(r.doc_id, ())))


def test_join_of_a_group_over_several_blocks(spark):
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base + [f"end{i}"])) for i in range(90)] + [(1000 + i, " ".join(base + ["end1"])) for i in range(5)]
    table = common.packed(spark.createDataFrame(rows, "doc_id bigint, text string")).select(
        "row", F.monotonically_increasing_id().alias("rid"), ngram_join._sketcher(5, 26, 6)(F.col("row.text")).alias("sketch"))
    got = ngram_join.linked_sets(common.stored(table, "t"), block=16).collect()
    assert len(got) == 90 and len({r["class"] for r in got}) == 1
    assert all(r.linked_sets == 89 and r.linked + r.n_copies == 95 for r in got)


# 8


def test_records_round_trip(spark, docs, plain):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(JSON)
    tk.encode_special_tokens = True
    folder = common.scratch(spark, "t")
    got = {r.doc_id: r for r in record_files.document_records(docs, JSON, 2, file_bytes=20_000, folder=folder).collect()}
    start = 0
    for i, text in sorted(plain):
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    import glob

    path = sorted(glob.glob(f"{folder.removeprefix('file:')}/*.rec"))[3]
    data, index = open(path, "rb").read(), np.fromfile(path[:-3] + "idx", "<u8")
    assert [bytes(record_files.record(data, int(o))) for o in index] == [bytes(p) for _, p in record_files.payloads(data)]
    with pytest.raises(ValueError):
        list(record_files.payloads(data[:-1]))
    with pytest.raises(ValueError):
        list(record_files.payloads(data[:20] + bytes([data[20] ^ 1]) + data[21:]))


def test_records_of_added_tokens(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "plain words", "<|endoftext|>", "x<|endoftext|>y  z <|endoftext |>", "some words <|endoftext|>, words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    start = 0
    for r in sorted(record_files.document_records(rows, JSON, 2).collect(), key=lambda r: r.doc_id):
        ids = [*tk.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert 50256 in tk.encode(texts[0], add_special_tokens=False).ids


# 9


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.""",
    "BSD-3-Clause": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 3. Neither the name of the copyright holder nor the names of its contributors
 *    may be used to endorse or promote products derived from this software.
 *
 * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
 * "AS IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED.""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation.""",
}
SHORT = {
    "This project is released under the MIT License.": "MIT", "This software is licensed under the Apache License 2.0.": "Apache-2.0",
    "// SPDX-License-Identifier: MIT\n#include <x>": "MIT", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
    "The licence of this program was free to all.": "", "Permission was granted, in parts": "", "License: MIT License": "MIT",
}


def test_wrapped_licences(spark):
    import duckdb

    texts = {f"Some head.\n\n{t}\n\nSome end.": k for k, t in WRAPPED.items()} | SHORT
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(licences.scanned(table).collect())
    assert {t: r.licences for t, r in zip(texts, got)} == texts
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    sql = sorted(con.sql(f"SELECT doc_id, n_sentences, sentence_ids, licences FROM ({licences.oracle()})").fetchall())
    assert [tuple(r) for r in got] == sql


def test_licence_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\").\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty."
    rows = [(1, mit), (2, "Text. Released under the MIT License. More"), (3, "Licensed under the Apache License, Version 2.0."), (4, "no licence here"), (5, None)]
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].licences for i in range(1, 6)] == ["MIT", "MIT", "Apache-2.0", "", ""]
    assert got[1].sentence_ids == "mit-grant,mit-notice,as-is"


# 10


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(docs, plain, library):
    got = {r.doc_id: r for r in prefix_bpe.encode_documents(docs, RANKS, P.PATTERN).collect()}
    for i, text in plain:
        ids = library.encode_ordinary(text or "")
        r = got[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_odd_strings(library):
    enc, draw = prefix_bpe.encoder(RANKS, P.PATTERN), np.random.default_rng(5)
    alphabet = list(" \n\t\r\x1c\x85 　ab'sélZ09٣²中文😀!?,.\x0b​")
    for _ in range(4000):
        s = "".join(draw.choice(alphabet, draw.integers(0, 25)))
        assert np.frombuffer(enc.encode(s), "<u4").tolist() == library.encode_ordinary(s)


def test_prefix_table_appends_and_edits(library):
    v = prefix_bpe.encoder(RANKS, P.PATTERN).vocabulary
    draw = np.random.default_rng(3)
    text = bytes(draw.choice(list(b"thereandinging"), 400).tolist())
    table = prefix_bpe.PrefixTable(v, text[:150]).append(text[150:])
    whole = prefix_bpe.PrefixTable(v, text)
    assert table.last == whole.last and b"".join(v.bytes_of[i] for i in table.ids()) == text
    assert table.ids(77) == prefix_bpe.PrefixTable(v, text[:77]).ids()
    for start, stop, new in ((10, 12, b"xyz"), (200, 200, b"the"), (300, 340, b""), (0, 1, b"q"), (360, 362, b"end"), (364, 365, b"")):
        built = table.replace(start, stop, new)
        assert table.last == prefix_bpe.PrefixTable(v, table.data).last
        assert built <= len(new) + 400
