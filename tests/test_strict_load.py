import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillon.operators import strict_load as S

from .conftest import rows

GOOD = "1,Men,Apparel,Topwear,Shirts,Blue,Fall,2011,Casual,Name"
VALUES = [("gender", "Men"), ("gender", "Women"), ("season", "Fall"), ("season", "Summer")]


def _reason(line):
    field = r'"(?:[^"]|"")*"|[^",]*'
    if not re.fullmatch(rf"(?:{field})(?:,(?:{field}))*", line, re.S):
        return "quoting"
    v = [m[1:] for m in re.findall(rf",(?:{field})", "," + line, re.S)]
    if len(v) != 10:
        return "column_count"
    v = [x[1:-1].replace('""', '"') if x[:1] == '"' else x for x in v]
    ok = re.fullmatch("[0-9]{1,9}", v[0]) and v[1] in ("Men", "Women") and v[6] in ("", "Fall", "Summer")
    ok = ok and re.fullmatch("|20[01][0-9]|202[0-6]", v[7]) and re.search(r"\S", v[9])
    return None if ok else "invalid_value"


def _run(spark, lines):
    raw = spark.createDataFrame([(k, x, "extra") for k, x in enumerate(lines)], "line_no long, raw_line string, _fields string")
    allowed = spark.createDataFrame(VALUES, "field_name string, allowed_value string")
    got = {r.line_no: r.reason for r in S.failures(raw, "line_no", "raw_line", S.STYLES, allowed).collect()}
    loaded = {r.line_no: r for r in S.strict_load(raw, "line_no", "raw_line", S.STYLES, allowed).collect()}
    assert set(got) | set(loaded) == set(range(len(lines))) and not set(got) & set(loaded)
    return got, loaded


CASES = [
    GOOD, GOOD, GOOD.replace("Name", '"A ""b"", c\nd"'), GOOD.replace("Name", '"x'), GOOD.replace("Name", ' "x"'), GOOD.replace("Name", '"x" y'),
    GOOD.replace("Name", 'x" y'), GOOD + ",more", "1,Men", "", GOOD.replace("1,", "x1,", 1), GOOD.replace("1,", "1\n,", 1), GOOD.replace("Men", "men"),
    GOOD.replace("Fall", ""), GOOD.replace("Fall", "Autumn"), GOOD.replace("2011", ""), GOOD.replace("2011", "2027"), GOOD.replace("2011", "１９９９"),
    GOOD.replace("Name", ""), GOOD.replace("Name", "   "), GOOD.replace("Name", '""'), GOOD.replace("Name", '""""'), '"1","Men","a","b","c","d","Fall","2011","e","f"',
    GOOD.replace("1,", "1234567890,", 1), GOOD.replace("Name", '"' + 'a""' * 20000 + '"'), GOOD.replace("Name", "x" * 200000), GOOD.replace("Name", "\x01e\x01s"),
]


def test_reasons_and_types(spark):
    got, loaded = _run(spark, CASES)
    for k, line in enumerate(CASES):
        assert got.get(k) == _reason(line), (k, line[:80])
    assert loaded[2].productDisplayName == 'A "b", c\nd' and loaded[21].productDisplayName == '"'
    assert loaded[15].year is None and loaded[0].year == 2011 and loaded[13].season == ""
    assert loaded[26].productDisplayName == "\x01e\x01s"


def test_null_records_and_offsets(spark):
    raw = spark.createDataFrame([(None, GOOD), (None, "bad"), (3, None), (3, GOOD)], "line_no long, raw_line string")
    allowed = spark.createDataFrame(VALUES, "field_name string, allowed_value string")
    assert rows(S.failures(raw, "line_no", "raw_line", S.STYLES, allowed).select("line_no", "reason")) == [(3, "column_count"), (None, "column_count")]
    none = raw.limit(0)
    assert S.failures(none, "line_no", "raw_line", S.STYLES, allowed).count() == 0 == S.strict_load(none, "line_no", "raw_line", S.STYLES, allowed).count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='",a \n1', max_size=14), min_size=20, max_size=40))
def test_quoting_equals_the_pattern(spark, lines):
    lines = [GOOD.replace("Name", x) for x in lines] + lines
    got, _ = _run(spark, lines)
    assert {k: v for k, v in ((k, _reason(x)) for k, x in enumerate(lines)) if v} == got
