import random

import pytest
from pyspark.sql import functions as F

from maskwell.operators import redact
from maskwell.operators.evaluation import KINDS, Random, case_seed, make_case, make_value
from maskwell.operators.placeholders import Numbering, TooManyValues, mentions, placeholder, undecided_from
from maskwell.operators.redact import lookup_in, redact_texts
from maskwell.operators.restore import Restorer, restore
from maskwell.operators.unsafe import Scanner, unsafe_regions
from maskwell.sources.tables import EventParser, check_request, content_text
from maskwell.streaming.restore_stream import step

ANSWER = "Hi [EMAIL_1], see http://x.org/[EMAIL_1] and [a]( [CARD_1] ) CARD_1. Email_1 [EMAIL_1].com <a href='[CARD_1]'> Pan 1 [PAN_9] end [CARD"


def mapping():
    return redact_texts(["mail a@example.com and card 4111 1111 1111 1111", "again a@Example.com pan ABCPE1234F"])[1]


def test_values_keep_their_number_and_loose_forms_are_reserved():
    texts, m = redact_texts(["mail a@example.com, PAN_1 noted [PAN_1]", "A@example.com pan ABCPE1234F"])
    assert texts == ["mail [EMAIL_1], PAN_1 noted [LITERAL_1]", "[EMAIL_1] pan [PAN_2]"]
    assert restore(texts[0], lookup_in(m))[0] == "mail a@example.com, PAN_1 noted [PAN_1]"


def test_a_late_loose_form_restores_only_the_exact_one():
    _, m = redact_texts(["pan ABCPE1234F", "what is PAN_1?"])
    out, _ = restore("[PAN_1] PAN_1", lookup_in(m))
    assert out == "ABCPE1234F PAN_1"


def test_restoration_holds_back_where_it_could_leak():
    out, counts = restore(ANSWER, lookup_in(mapping()))
    assert out.startswith("Hi a@example.com, see http://x.org/[EMAIL_1] and [a]( [CARD_1] ) 4111 1111 1111 1111. a@example.com [EMAIL_1].com <a href='[CARD_1]'>")
    assert counts["restored"] == 3 and counts["url"] == counts["markdown-destination"] == counts["html-attribute"] == counts["host"] == counts["bare-space"] == 1


def test_any_cut_gives_the_same_answer():
    whole, _ = restore(ANSWER, lookup_in(mapping()))
    for seed in range(200):
        rnd, r, i, out = random.Random(seed), Restorer(lookup_in(mapping())), 0, ""
        while i < len(ANSWER):
            k = rnd.randint(1, 12)
            out += r.push(ANSWER[i : i + k])
            assert len(r.held) <= 16
            i += k
        assert out + r.end() == whole


def test_regions_of_links_labels_attributes_urls_and_hosts():
    text = 'x [l](http://a b) <a href="q w">t</a> [n]: <u v> mailto:a@b c host.com/p q'
    assert [text[a:b] for a, b in unsafe_regions(text)] == ["http://a", "q w", "<u v>", "mailto:a@b", "host.com/p"]
    s = Scanner()
    s.feed('say ="never closed')
    assert s.at(8, 9) == "unclosed-quote"


def test_grammar_and_limits():
    assert [(m.namespace, m.index, m.bracketed) for m in mentions("[pan 1] PAN_2 Pan_3 pan_4 xPAN_5 AADHAAR 6 [PAN_0]")] == [("PAN", 1, True), ("PAN", 2, False), ("PAN", 3, False), ("AADHAAR", 6, False)]
    assert undecided_from("so [PA") == 3 and undecided_from("done.") == 5
    with pytest.raises(TooManyValues):
        placeholder("PAN", 10000)
    n = Numbering()
    n.reserve(1)
    assert n.index("k", "v") == 2 == n.index("k", "w") and n.values == {2: "v"}


def test_conversations_over_dataframes(spark):
    rows = [(1, 0, "user", "mail a@example.com PAN_1"), (1, 1, "user", "A@example.com, b@example.com pan ABCPE1234F"), (2, 0, "user", "b@example.com"), (2, 1, "user", None), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out, mapped = redact.redact_conversations(df)
    got = {(r.conv_id, r.turn): r.text for r in out.collect()}
    assert got == {(1, 0): "mail [EMAIL_1] PAN_1", (1, 1): "[EMAIL_1], [EMAIL_2] pan [PAN_2]", (2, 0): "[EMAIL_1]", (2, 1): None, (3, 0): ""}
    back = redact.restore_answers(out.filter("turn = 1"), mapped).collect()
    assert {r.conv_id: r.text for r in back}[1] == "a@example.com, b@example.com pan ABCPE1234F"
    assert redact.redact_conversations(df.limit(0))[0].count() == 0


def test_no_row_passes_whatever_its_ids_are(spark):
    rows = [
        (1, None, "user", "mail bob@example.com now"), (None, 1, "user", "mail amy@example.com now"), (None, None, None, "amy@example.com, bob@example.com"),
        (2, 0, "user", "mail first@example.com here"), (2, 0, "user", "short second@example.com ok"), (2, 0, "user", "short second@example.com ok"),
    ]
    out, mapped = redact.redact_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [(r.conv_id, r.turn, r.text) for r in out.collect()]
    assert len(got) == len(rows) and not any("@" in t for _, _, t in got)
    assert (1, None, "mail [EMAIL_1] now") in got and (None, None, "[EMAIL_1], [EMAIL_2]") in got and (None, 1, "mail [EMAIL_1] now") in got
    pair = sorted(t for c, _, t in got if c == 2)
    assert pair in ([f"mail [EMAIL_{i}] here"] + [f"short [EMAIL_{3 - i}] ok"] * 2 for i in (1, 2))
    back = redact.restore_answers(out, mapped, everywhere=True)
    assert sorted((r.conv_id or 0, r.text) for r in back.collect()) == sorted((c or 0, t) for c, _, _, t in rows)


def test_detectors_and_names_reach_the_tasks(spark):
    from maskwell.operators import resolve
    from maskwell.operators.candidates import Span

    df = spark.createDataFrame([(1, "ticket TKTABC for Dr Priya Sharma"), (2, "nothing"), (3, None)], "doc_id long, text string")
    names = frozenset(("priya", "sharma"))
    resolve.register_detector("tickets", lambda text, numbers: [Span("PAN", i, i + 6, True) for i in [text.find("TKTABC")] if i >= 0])
    try:
        rows = {r.doc_id: [(d.type, d.start, d.end) for d in r.detections] for r in redact.detect(df, names=names).collect()}
        out, _ = redact.redact_conversations(df.selectExpr("doc_id conv_id", "0L turn", "'user' role", "text"), names)
        texts = {r.conv_id: r.text for r in out.collect()}
    finally:
        resolve.EXTRA.clear()
    assert rows == {1: [("PAN", 7, 13), ("PERSON", 21, 33)], 2: [], 3: []}
    assert texts == {1: "ticket [PAN_1] for Dr [PERSON_1]", 2: "nothing", 3: None}


def test_unsafe_places_do_not_depend_on_the_pieces():
    from random import Random as R

    from maskwell.operators.unsafe import Scanner

    rnd = R(4)
    parts = ["[", "]", "(", ")", "<", ">", "\\", ":", "=", '"', "'", " ", "\n", "a", "b.", "c.com", "/", "://", "http", "mailto:", "-", "_", "](", "]:", "[PAN_1]", "é"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        whole, cut = Scanner(), Scanner()
        whole.feed(text)
        at = sorted(rnd.choices(range(len(text) + 1), k=3))
        for a, b in zip([0, *at], [*at, len(text)]):
            cut.feed(text[a:b])
        assert [whole.at(i, i + 1) for i in range(len(text))] == [cut.at(i, i + 1) for i in range(len(text))], (text, at)


def test_many_links_take_a_time_in_proportion():
    import time

    text = "".join(f"[l{i}](http://h.example/{i}) and [EMAIL_1] " for i in range(16_000))
    begin = time.time()
    out, counts = restore(text, lambda n, i: ("a@example.com", False))
    assert counts["restored"] == 16_000 and time.time() - begin < 10


def test_detection_of_a_frame_runs_one_python_stage(spark):
    df = spark.createDataFrame([(1, "a@example.com", "x"), (2, None, "y")], "doc_id long, text string, detections_ string")
    out = redact.detect(df)
    assert [(r.doc_id, [d.type for d in r.detections]) for r in out.orderBy("doc_id").collect()] == [(1, ["EMAIL"]), (2, [])]
    plan = out.filter(F.size("detections") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_pieces_out_of_order_and_twice():
    r = Restorer(lookup_in(mapping()))
    waiting, out, nxt = {}, "", 0
    for batch in ([(1, "IL_1] b", False)], [(0, "a [EMA", False), (1, "IL_1] b", False)], [(3, "!", True)], [(2, " c", False)]):
        rows, nxt, over = step(r, nxt, waiting, batch)
        out += "".join(t for _, t, _ in rows)
    assert out == "a a@example.com b c!" and over


def test_event_streams_and_requests():
    raw = b"\xef\xbb\xbfdata: a\r\n\r\n: c\ndata: b\ndata: c\n\ndata:d\r\r"
    for size in (1, 2, 5, 100):
        p = EventParser()
        assert [x for i in range(0, len(raw), size) for x in p.push(raw[i : i + size])] == ["a", "b\nc", "d"]
    assert check_request('{"model": "m", "messages": [{"role": "user", "content": "x"}]}') == (True, None, None)
    assert check_request('{"model": "m", "tools": []}')[1:] == ("unsupported_field", "tools")
    assert check_request("{")[1] == "invalid_json"
    assert content_text([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]) == "a b"


def test_generated_values_are_found_wholly():
    assert case_seed(1, "a") != case_seed(1, "b")
    for kind in KINDS:
        make_value(kind, Random(3))
    for i in range(100):
        text, pieces = make_case(7, f"C{i}")
        hidden = redact_texts([text])[0][0]
        assert all(text[p.start : p.end] not in hidden for p in pieces)


def test_evaluation_over_frames(spark):
    from maskwell.operators import evaluation as ev

    cases = ev.labelled_cases(spark, 60)
    scored = {r.type: r for r in ev.score(cases, redact.detect(cases, keep=["case_id"])).collect()}
    assert sum(r["values"] for r in scored.values()) == sum(r.redacted for r in scored.values()) > 60
    assert ev.echo(cases).filter("exact").count() == 60
    a = spark.createDataFrame([("x", 3), ("y", 5)], "k string, count long")
    b = spark.createDataFrame([("x", 4), ("z", 1)], "k string, count long")
    assert {r.k: r.verdict for r in ev.compare_baseline(a, b, ["k"]).collect()} == {"x": "better", "y": "gone", "z": "new"}
    spans = spark.createDataFrame([(1, 0, 5), (1, 9, 12)], "text_id long, start int, end int")
    row = ev.name_metrics(spans, spans.limit(1), 100).first()
    assert (row.covered, row.names, row.precision) == (1, 2, 1.0)
    assert ev.rewrite_fates("[PAN_1] [PAN_2] [IP_1]", "Pan 1, [PAN_2] [PAN_7]", "Pan 1, x [PAN_7]") == {"restored": 1, "held": 0, "rewritten": 1, "dropped": 1, "invented": 1}
    assert [ev.leak_form("AB 12-34 cd", v) for v in ("12-34", "ab 12", "1234cd", "zz")] == ["raw", "lower", "squashed", None]
    assert ev.markdown_table(["a"], [(1,)]).splitlines()[1] == "| - |"


def test_sql_functions(spark):
    from maskwell.functions.register import register

    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT s.type, s.start, s.`end` FROM detect_spans('x a@example.com') s").collect()] == [("EMAIL", 2, 15)]
    assert spark.sql("SELECT redact_text('x a@example.com') t, value_key('PAN', 'abcpe1234f') k").first() == ("x [EMAIL_1]", "ABCPE1234F")
