"""Calendars as YAML files."""

import datetime

import pytest

from confluence.sources.calendar_yaml import macro_yaml, write_yaml

GOOD = """# kept by hand
year: 2026

events:
  # first half
  - date: 2026-01-28
    kind: fomc   # two days
    description: "A \\"statement\\" - day #2: rates"

  - kind: cpi
    date: "2026-02-13"
    description: 'it''s # late'
  -
    date: 2026-03-01
    kind: other
    description: plain text, no: sign:of a field   # comment
# at the margin
  - date: 2026-03-02
    kind: gdp
source: by hand
"""


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def rows(df):
    return [tuple(r) for r in df.orderBy("date").collect()]


def test_a_calendar_is_read_as_it_is_written(spark, tmp_path):
    good = GOOD.replace("no: sign:of", "no sign:of")
    day = lambda m, d: datetime.date(2026, m, d)
    want = [(day(1, 28), "fomc", 'A "statement" - day #2: rates'), (day(2, 13), "cpi", "it's # late"), (day(3, 1), "other", "plain text, no sign:of a field"), (day(3, 2), "gdp", "")]
    assert rows(macro_yaml(spark, write(tmp_path / "a.yaml", good))) == want
    assert rows(macro_yaml(spark, write(tmp_path / "b.yaml", good.replace("\n", "\r\n")))) == want
    margin = "events:\n- date: 2026-01-02\n  kind: nfp\n- date: 2026-01-03\n  kind: ppi\n"
    assert [r[1] for r in rows(macro_yaml(spark, write(tmp_path / "c.yaml", margin)))] == ["nfp", "ppi"]
    back = spark.createDataFrame(want + [(datetime.date(2027, 1, 1), "cpi", 'back\\slash "x"')], "date date, kind string, description string")
    write_yaml(back, str(tmp_path / "years"))
    assert rows(macro_yaml(spark, str(tmp_path / "years"))) == rows(back)


@pytest.mark.parametrize("text", ["", "# nothing\n", "events:\n", "events: []\n", "events: [] # none\nother: 1\n", "events: null\n", "other:\n  - date: x\n"])
def test_calendars_without_entries(spark, tmp_path, text):
    assert rows(macro_yaml(spark, write(tmp_path / "a.yaml", text))) == []


def test_a_missing_calendar_is_empty(spark, tmp_path):
    assert rows(macro_yaml(spark, str(tmp_path / "none.yaml"))) == []


@pytest.mark.parametrize(
    ("entry", "said"),
    [
        ("- date: 2026-13-01\n  kind: cpi", "entry 2: bad date: 2026-13-01"), ("- date: 1/2/2026\n  kind: cpi", "bad date"), ("- kind: cpi", "bad date: none"), ("- date: 2026-01-01\n  kind: party", "unknown kind: party"),
        ("- date: 2026-01-01", "unknown kind: none"), ("- date: 2026-01-01\n  kind: cpi\n  words", "a line that is no field"), ("- date: 2026-01-01\n  kind: cpi\n  description: \"open", "can't be read"),
        ("- date: 2026-01-01\n  kind: cpi\n  description: a: b", "can't be read"), ("- {date: 2026-01-01, kind: cpi}", "entry 2"), ("- date: 2026-01-01\n\tkind: cpi", "a tab"),
    ],
)
def test_bad_entries_are_named(spark, tmp_path, entry, said):
    path = write(tmp_path / "bad.yaml", f"events:\n- date: 2026-01-02\n  kind: nfp\n{entry}\n")
    with pytest.raises(ValueError, match=said) as error:
        macro_yaml(spark, path)
    assert "bad.yaml" in str(error.value)


def test_lists_of_another_form_are_refused(spark, tmp_path):
    for text in ("events: [{date: 2026-01-01}]\n", "events: soon\n", "events:\n  date: 2026-01-01\n"):
        with pytest.raises(ValueError, match="entry 1"):
            macro_yaml(spark, write(tmp_path / "x.yaml", text))
