"""Every question gives the rows of its SQL."""

import pytest

from rillbook.plans.registry import load_all
from rillbook.sources.fixtures import VIEWS, with_views
from tests.conftest import SF
from tools.oracle_check import compare, duck_frame, spark_frame

QUESTIONS = load_all()


@pytest.mark.parametrize("name", list(VIEWS))
def test_derived_table(name, tables, duck):
    got = spark_frame(getattr(tables, name))
    assert compare(got, duck_frame(duck, with_views([name], f"SELECT * FROM {name}", "duckdb"))) == ""
    assert len(got) > 0


@pytest.mark.parametrize("name", list(QUESTIONS))
def test_question(name, spark, duck):
    q = QUESTIONS[name]
    got = spark_frame(q.run(spark, SF))
    assert q.oracle() is not None
    assert compare(got, duck_frame(duck, q.oracle())) == ""


def test_every_survey_row_has_a_question():
    want = (
        [f"a{i:02}" for i in range(1, 15)] + [f"b{i:02}" for i in range(1, 20)] + [f"c{i:02}" for i in range(1, 30)]
        + [f"d{i:02}" for i in range(1, 8)] + [f"e{i:02}" for i in range(1, 11)] + [f"f{i:02}" for i in range(1, 9)]
        + [f"g{i:02}" for i in range(1, 5)] + ["h01", "h02"] + [f"i{i:02}" for i in range(1, 15)]
    )
    have = {n[:3] for n in QUESTIONS}
    assert sorted(set(want) - have) == []
