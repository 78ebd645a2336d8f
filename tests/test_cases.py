import pytest

from maskwell.sources.cases import CaseError, parse_cases, read_cases, render_case

FILE = """=== H001 | lookalike, shape:side
@user
Order {{NOT:ORD-######}} and card {{CARD@mine}},
again {{CARD@mine}} or {{EMAIL=a@example.com}}.
@assistant
Fine.

=== H002
@user
No values.
"""


def test_cases_are_parsed_and_rendered_alike_each_time():
    cases = list(parse_cases(FILE))
    assert [(c.case_id, c.tags, len(c.messages)) for c in cases] == [("H001", ["lookalike", "shape:side"], 2), ("H002", [], 1)]
    first, again = (list(render_case(cases[0], 7)) for _ in range(2))
    assert first == again != list(render_case(cases[0], 8))
    _, role, text, pieces = first[0]
    assert role == "user" and [p["type"] for p in pieces] == ["NOT", "CARD", "CARD", "EMAIL"]
    assert pieces[1]["value_id"] == pieces[2]["value_id"] and text[pieces[3]["start"] : pieces[3]["end"]] == "a@example.com"
    assert text[pieces[1]["start"] : pieces[1]["end"]] == text[pieces[2]["start"] : pieces[2]["end"]]


@pytest.mark.parametrize("bad", ["text first", "@user\nx", "=== A\nstray"])
def test_malformed_files_are_refused(bad):
    with pytest.raises(CaseError):
        list(parse_cases(bad))


def test_read_cases(spark, tmp_path):
    (tmp_path / "a.txt").write_text(FILE)
    rows = read_cases(spark, str(tmp_path)).orderBy("case_id", "turn").collect()
    assert [(r.case_id, r.turn, r.role) for r in rows] == [("H001", 0, "user"), ("H001", 1, "assistant"), ("H002", 0, "user")]
