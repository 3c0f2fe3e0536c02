import re
import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bankrec.functions.text import company_key, key_of, normalize, strip_accents
from bankrec.functions.values import calendar, cosine, money_lenient, money_strict

LETTERS = st.text(alphabet=st.sampled_from(list(
    "aAeEsSlLdDoOzZ09 .,-'ÀÉÎõüçÇßøŉǄﬁﬀ½¼ªºĳŀ¨´ 　ＡＺ９ⅣéḀ")), max_size=20)
STOP = {"LDA", "SA", "DE", "DA", "DO", "E"}


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def norm(text):
    return re.sub("[^A-Z0-9]", "", plain(text).upper())


def key(text):
    return norm(" ".join(w for w in re.split(r"[\s,]+", text) if norm(w) not in STOP))


@settings(max_examples=5, deadline=None)
@given(st.lists(LETTERS, min_size=200, max_size=400))
def test_keys_follow_their_definition(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", strip_accents("t").alias("a"), normalize("t").alias("n"),
                       company_key("t").alias("k")).collect():
        assert r.a == plain(r.t)
        assert r.n == norm(r.t)
        assert r.k == key(r.t), repr(r.t)


def test_every_character_that_decomposes(spark):
    points = (chr(cp) for lo, hi in ((0x80, 0xD7FF), (0xE000, sys.maxunicode)) for cp in range(lo, hi + 1))
    texts = [f"a{c} DE{c}S" for c in points if plain(c) != c or c.isspace()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", strip_accents("t").alias("a"), normalize("t").alias("n"), company_key("t").alias("k")).collect()
    assert len(rows) > 15_000
    assert [r.t for r in rows if (r.a, r.n, r.k) != (plain(r.t), norm(r.t), key(r.t))] == []


def test_key_examples(spark):
    names = ["ANCORA APOGEU,LDA", "Ancora Apogeu", "Âncora  Apogeu, S.A.", "O'Neil \\ Filhos"]
    got = spark.range(1).select(*[key_of(n).alias(f"k{i}") for i, n in enumerate(names)]).first()
    assert list(got) == ["ANCORAAPOGEU"] * 3 + ["ONEILFILHOS"]


def test_money(spark):
    df = spark.createDataFrame([(" 1.234,56 ",), ("-50,00",)], "t string")
    assert [float(r[0]) for r in df.select(money_strict("t")).collect()] == [1234.56, -50.0]
    df = spark.createDataFrame([("141,24 EUR ",), ("n/d",), (None,), ("-1.000 EUR",)], "t string")
    assert [r[0] if r[0] is None else float(r[0]) for r in df.select(money_lenient("t")).collect()] == [
        141.24, None, None, -1000.0]
    with pytest.raises(Exception):
        spark.createDataFrame([("lixo",)], "t string").select(money_strict("t")).collect()


def test_calendar_and_cosine(spark):
    days = spark.sql("select explode(sequence(date'2026-07-20', date'2026-07-26')) d")
    rows = days.select(*[c.alias(n) for n, c in calendar("d").items()]).collect()
    assert [r.dia_semana for r in rows] == list(range(7))
    assert [r.fim_de_semana for r in rows] == [0] * 5 + [1, 1]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = v.select(cosine("a", "b").alias("x"), cosine("a", "z").alias("y")).first()
    assert abs(r.x - 0.5 ** 0.5) < 1e-9 and r.y == 0
