"""Predicates, templates, transforms and scalars."""

import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import scalars
from docloom.functions.predicate import Predicate, PredicateError
from docloom.functions.siv import Siv
from docloom.functions.templates import Template, TemplateError, index_name, key_id, matches
from docloom.functions.transforms import Transform, iso_date, java_pattern
from docloom.operators.store import point_id


@pytest.mark.parametrize("text", ["", "a", "a =", "1 = a", "a = NULL", "a LIKE 'x'", "a BETWEEN 1 AND 2", "lower(a) = 'x'", "a = 1 AND", "(a = 1", "a = 1 b", "a NOT = 1", "a IN ()", "a = b", "a ~ 1"])
def test_refused(text):
    with pytest.raises(PredicateError):
        Predicate(text)


def test_precedence_columns_and_sql():
    p = Predicate("a = 1 OR b <> 'x''y' AND NOT c IS NOT NULL")
    assert p.columns == ["a", "b", "c"]
    assert p.sql() == "((\"a\" = 1) OR ((\"b\" <> 'x''y') AND (NOT (\"c\" IS NOT NULL))))"
    assert Predicate(p.sql()).root == p.root


def told(spark, rows, schema, where):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.coalesce(1).select(Predicate(where).column(df.schema)).collect()]


def test_three_valued_truth_tables(spark):
    values = {"t": True, "f": False, "n": None}
    rows = [(1, 2, None)]
    atom = {"t": "a = 1", "f": "a = 2", "n": "c = 1"}
    for x in "tfn":
        for y in "tfn":
            a, b = values[x], values[y]
            both = False if False in (a, b) else None if None in (a, b) else True
            either = True if True in (a, b) else None if None in (a, b) else False
            assert told(spark, rows, "a int, b int, c int", f"{atom[x]} AND {atom[y]}") == [both]
            assert told(spark, rows, "a int, b int, c int", f"{atom[x]} OR {atom[y]}") == [either]
    assert told(spark, rows, "a int, b int, c int", "NOT c = 1") == [None]
    assert told(spark, rows, "a int, b int, c int", "a NOT IN (5, 1)") == [False]
    assert told(spark, rows, "a int, b int, c int", "c IN (1) OR d IS NULL") == [True]


def test_coercion(spark):
    texts = [("10.00",), ("abc",), ("2024-01-02",), ("9007199254740993",), (None,)]
    assert told(spark, texts, "d string", "d = 10") == [True, None, None, False, None]
    assert told(spark, texts, "d string", "d > 9007199254740992") == [False, None, None, True, None]
    assert told(spark, texts, "d string", "d >= '2024-01-01'") == [False, True, True, True, None]
    assert told(spark, [(5, True)], "n int, b boolean", "n = '5'") == [None]
    assert told(spark, [(5, True)], "n int, b boolean", "b = 1") == [None]
    assert told(spark, [(5, True)], "n int, b boolean", "b = TRUE") == [True]


def test_templates(spark):
    df = spark.createDataFrame([(7, "x", None)], "a int, b string, c string")
    show = lambda c: df.select(c).first()[0]
    assert show(Template.parse("p-{a}-{b}").render(df.schema)) == "p-7-x"
    assert Template.parse("p-{a}{b}-z").pattern() == "p-*-z" and Template.parse("{a}/{b}").only_of(["a", "b", "q"])
    with pytest.raises(Exception, match="null or missing"):
        show(Template.parse("{c}").render(df.schema))
    with pytest.raises(Exception, match="no index name"):
        show(index_name("Bad{b}", df.schema))
    for bad in ("", "{", "{}", "a}b"):
        with pytest.raises(TemplateError):
            Template.parse(bad)
    assert show(key_id(["b", "a"])) == "a=7,b=x" and show(key_id(["c"])) == "__null__"
    assert matches("a-*", "a-b") and not matches("a-*", "b-a") and not matches("a.b", "axb")


def applied(spark, rule, rows, schema="v string"):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    out = rule.apply(F.col("v"), df.schema["v"].dataType, "public.users.email")
    return [tuple(r) for r in df.select(out.value, out.unconverted).collect()]


def test_transforms(spark):
    quoted = hashlib.sha256(b'"x"').hexdigest()[:16]
    assert applied(spark, Transform("hash"), [("x",), (None,)]) == [(quoted, False), (None, False)]
    assert applied(spark, Transform("hash"), [(5,)], "v int") == [(hashlib.sha256(b"5").hexdigest()[:16], False)]
    assert applied(spark, Transform("redact"), [("x",), (None,)]) == [("***", False), (None, False)]
    assert applied(spark, Transform("split", by="."), [(" a . .b.",)]) == [(["a", "b"], False)]
    assert [(tuple(v), bad) for v, bad in applied(spark, Transform("number"), [(" 12 ",), ("1.5",), ("1e400",), ("1d",), ("NaN",)])] == [((12, 12.0), False), ((None, 1.5), False), ((None, None), True), ((None, None), True), ((None, None), True)]
    assert applied(spark, Transform("lookup", map={"1": "one"}), [(1,), (2,)], "v int") == [("one", False), ("2", True)]
    assert applied(spark, Transform("lookup", map={"1": "one"}, default="?"), [("2",)]) == [("?", True)]
    assert applied(spark, Transform("date", from_="%d/%m/%Y"), [("02/01/2024",), ("x",)]) == [("2024-01-02", False), ("x", True)]
    df = spark.createDataFrame([('{"b": 1}',), ("not json",)], "v string").coalesce(1)
    out = Transform("json").apply(F.col("v"), df.schema["v"].dataType, "")
    assert [tuple(r) for r in df.select(F.to_json(out.value), out.unconverted).collect()] == [('{"b":1}', False), ('"not json"', True)]


def test_dates_keep_their_offset(spark):
    df = spark.createDataFrame([("2024-03-01 10:00:00 +0530",)], "v string")
    assert df.select(iso_date(F.col("v"), "%Y-%m-%d %H:%M:%S %z")).first()[0] == "2024-03-01T10:00:00+05:30"
    assert java_pattern("%Y-%m-%dT%T") == "yyyy-MM-dd'T'HH:mm:ss"
    with pytest.raises(ValueError):
        java_pattern("%Q")


def test_pseudonyms(spark):
    key = bytes(range(64))
    many = ["", "a", "x" * 15, "y" * 16, "é" * 40, "alice@example.com", "a", "z" * 700]
    assert Siv(key).tokens("s", many) == [Siv(key).token("s", t) for t in many] and len(set(Siv(key).tokens("s", many))) == len(many) - 1
    # a fixed value: a known answer
    assert Siv(key).token("public.users.email", "alice@example.com") == "b755fBOIourHdXmQbAvHon5gj2lfvpmWx9gqaznhJdYd"
    os.environ["TEST_KEY"] = key.hex()
    got = applied(spark, Transform("pseudonym", key_env="TEST_KEY"), [("alice@example.com",), (None,)])
    assert got == [("b755fBOIourHdXmQbAvHon5gj2lfvpmWx9gqaznhJdYd", False), (None, False)]


def test_scalars(spark):
    df = spark.createDataFrame([(2**40 + 255, "1A/FF", "\\x6869", "{a,\"b c\",NULL,\"NULL\"}", "TRUNCATE TABLE `x`.`y`;")], "p long, t string, h string, a string, s string")
    row = df.select(scalars.position_text(F.col("p")), scalars.position_of(F.col("t")), scalars.base64_of_hex(F.col("h")), scalars.array_items(F.col("a")), scalars.truncated_table(F.col("s")), scalars.external_version(F.lit(0))).first()
    assert tuple(row) == ("100/FF", 0x1A * 2**32 + 255, "aGk=", ["a", "b c", None, "NULL"], "x.y", None)
    assert scalars.fresh_index_name("orders-1700000000", 5) == "orders-5"
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert df.select(point_id(space, F.col("t"))).first()[0] == str(uuid.uuid5(uuid.UUID(space), "1A/FF"))
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    b = a.select("a", "b")
    assert a.select(scalars.content_id(a.schema)).first() == b.select(scalars.content_id(b.schema)).first()
