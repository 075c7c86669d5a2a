import re

import pytest

from tessera.functions import glob_to_regex, strftime_to_pattern
from tessera.plans.dialect import rewrite
from tessera.plans.tokens import split_statements, tokenize
from tessera.types import length_limit, spark_type


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("h*", ["h", "hello"], ["ah", "H"]), ("hel?", ["help"], ["hel", "hello"]), ("[a-c]x", ["ax", "cx"], ["dx", "a"]), ("[!a]*", ["bc"], ["ab", ""]), ("[^a]", ["b"], ["a"]), ("a.b*", ["a.b", "a.bc"], ["axb"]), ("*[1-3]", ["x1"], ["x4"]), ("[", ["["], ["a"])],
)
def test_glob(pattern, yes, no):
    regex = re.compile(glob_to_regex(pattern).replace(r"\z", r"\Z").replace("^(?s)", "(?s)^"))
    assert all(regex.match(x) for x in yes) and not any(regex.match(x) for x in no)


def test_strftime():
    assert strftime_to_pattern("%Y-%m-%d at %H:%M:%S") == "yyyy-MM-dd' at 'HH:mm:ss"
    with pytest.raises(ValueError):
        strftime_to_pattern("%Q")


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a FROM t WHERE b GLOB 'x*'", r"SELECT a FROM t WHERE b RLIKE '^(?s)x.*\\z'"),
        ("SELECT a FROM t WHERE b NOT GLOB '?'", r"SELECT a FROM t WHERE b NOT RLIKE '^(?s).\\z'"),
        ("SELECT n COLLATE NOCASE FROM t", "SELECT n COLLATE UTF8_LCASE FROM t"),
        ("SELECT a / b, a / 2 FROM t", "SELECT a / nullif(b, 0), a / 2 FROM t"),
        ("SELECT CAST(a AS TEXT)", "SELECT try_cast(a AS STRING)"),
        ("SELECT a FROM t LIMIT 2, 3", "SELECT a FROM t LIMIT 3 OFFSET 2"),
        ("SELECT json_extract(j, '$.a')", "SELECT get_json_object(j, '$.a')"),
        ("SELECT 'it''s' -- no\n;", r"SELECT 'it\'s'"),
    ],
)
def test_rewrite(sql, want):
    assert rewrite(sql) == want


def test_what_it_does_not_know_passes():
    assert rewrite("SELECT percentile(x, 0.5) FROM t WHERE y ILIKE 'a%'") == "SELECT percentile(x, 0.5) FROM t WHERE y ILIKE 'a%'"


def test_statements():
    text = "CREATE TRIGGER a AFTER INSERT ON t BEGIN INSERT INTO u VALUES (1); DELETE FROM u; END; SELECT ';'"
    assert len(split_statements(text)) == 2
    assert [t.kind for t in tokenize("x'41' 'a''b' 1.5e3 ?2 `q`")] == ["binary", "string", "number", "param", "quoted"]


def test_types():
    assert (spark_type("varchar(20)"), spark_type("DECIMAL(10, 2)"), spark_type("VECTOR(3)"), spark_type("double precision")) == ("STRING", "DECIMAL(10, 2)", "ARRAY<FLOAT>", "DOUBLE")
    assert length_limit("CHAR(5)") == 5 and length_limit("TEXT") is None
