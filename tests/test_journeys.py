import json

from pyspark.sql import functions as F

from eventloom.functions import texts
from eventloom.operators import audit, flowcharts, journeys, payloads, users
from eventloom.operators.sessions import number_events, sessions_per_user
from tests.support import event

D = "2026-01-05 "


def label(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(
        texts.chart_label(F.col("t"))).first()[0]


def test_labels(spark):
    assert label(spark, 'A[b]{c}<d>|#&;"e\n\rf') == "A(b)(c)d-and'e f"
    assert label(spark, "x" * 30) == "x" * 30
    assert label(spark, "x" * 31) == "x" * 27 + "..."


def test_user_key(spark):
    df = spark.createDataFrame([("a/b\\c",)], "t string")
    assert df.select(texts.user_key(F.col("t"))).first()[0] == "a_b_c"


def three(spark):
    return event(spark, ("u", "open", D + "10:00:00"), ("u", "find", D + "10:01:00"),
                 ("u", "pay", D + "11:00:00"))


def test_chart_with_one_session(spark):
    df = three(spark).where("event_name <> 'pay'")
    assert flowcharts.flowchart_text(df).first().flowchart == "\n".join([
        "flowchart TD", '    N1["open"]', '    N2["find"]', "    N1 --> N2", "",
        "    classDef default fill:#4a5568,stroke:#2d3748,color:#fff"])


def test_chart_with_two_sessions(spark):
    whole = "\n".join([
        "flowchart TD",
        '    subgraph S0["Session 1: 2026-01-05 (10:00 - 10:01)"]',
        '        N1["open"]', '        N2["find"]', "        N1 --> N2", "    end",
        '    subgraph S1["Session 2: 2026-01-05 (11:00 - 11:00)"]',
        '        N3["pay"]', "    end", "",
        "    classDef default fill:#4a5568,stroke:#2d3748,color:#fff"])
    assert flowcharts.flowchart_text(three(spark)).first().flowchart == whole
    parts = flowcharts.flowcharts(number_events(three(spark)), sessions_per_part=1).orderBy("part").collect()
    assert len(parts) == 2
    assert "\n".join(p.flowchart for p in parts) == whole


def test_chart_without_events(spark):
    df = event(spark, ("u", "boot", D + "10:00:00", "system"))
    charts = flowcharts.flowchart_text(df, users.unique_users(df), category="application").collect()
    assert [c.flowchart for c in charts] == ["flowchart LR\n    A[No Events Found]"]


def test_label_of_a_truncated_session_ends_at_its_last_node(spark):
    chart = flowcharts.flowchart_text(three(spark), max_nodes=1).first().flowchart
    assert '"Session 1: 2026-01-05 (10:00 - 10:00)"' in chart
    assert 'N2["pay"]' in chart and "-->" not in chart


def test_path_parts_join_to_the_whole(spark):
    df = event(spark, *[("u", f"e{i}", f"{D}10:00:{i:02d}") for i in range(25)])
    whole = journeys.journey_path(number_events(df)).first().path
    assert whole == " -> ".join(f"e{i}" for i in range(25))
    parts = journeys.journey_path(number_events(df), 10).orderBy("part").collect()
    assert [p.event_count for p in parts] == [10, 10, 5]
    assert " -> ".join(p.path for p in parts) == whole


def test_transitions_cross_the_parts_of_a_session(spark):
    df = event(spark, *[("u", f"e{i}", f"{D}10:00:{i:02d}") for i in range(9)])
    for size in (1, 2, 3, 4, 100):
        steps = journeys.transitions(number_events(df), items_per_part=size).orderBy("step").collect()
        assert [(s.from_event, s.to_event) for s in steps] == [
            (f"e{i}", f"e{i + 1}") for i in range(8)]


def test_unnamed_events_have_transitions(spark):
    df = event(spark, ("u", "a", D + "10:00:00"), ("u", None, D + "10:00:01"))
    step = journeys.transitions(number_events(df)).first()
    assert (step.from_event, step.to_event) == ("a", None)


def test_unnamed_events_stay_in_charts_and_paths(spark):
    df = event(spark, ("u", "a", D + "10:00:00"), ("u", None, D + "10:00:01"), ("u", "c", D + "10:00:02"))
    chart = flowcharts.flowchart_text(df).first().flowchart.split("\n")
    assert chart[1:6] == ['    N1["a"]', '    N2["(unnamed)"]', "    N1 --> N2", '    N3["c"]', "    N2 --> N3"]
    path = journeys.journey_path(number_events(df)).first()
    assert (path.event_count, path.path) == (3, "a -> (unnamed) -> c")
    assert journeys.session_path(number_events(df)).first().path == "a -> (unnamed) -> c"


def test_users_without_events_have_rows(spark):
    df = event(spark, ("u", "a", D + "10:00:00"), ("v", "boot", D + "10:00:00", "system"),
               (None, "a", D + "10:00:00"))
    chosen, known = users.select_category(df), users.unique_users(df)
    metrics = users.user_metrics(chosen, known).orderBy("user_uuid").collect()
    assert [tuple(m) for m in metrics] == [
        ("u", 1, 1, "2026-01-05 10:00:00.000000", "2026-01-05 10:00:00.000000", 1), ("v", 0, 0, None, None, 0)]
    counts = sessions_per_user(chosen, users=known).orderBy("user_uuid").collect()
    assert [tuple(c) for c in counts] == [("u", 1), ("v", 0)]
    paths = journeys.journey_path(number_events(chosen), users=known).orderBy("user_uuid").collect()
    assert [tuple(p) for p in paths] == [("u", 1, 1, "a"), ("v", 1, 0, "No events found for this user.")]
    assert users.user_metrics(chosen).count() == 1


def test_record(spark):
    df = three(spark)
    numbered = number_events(df)
    row = journeys.journey_record(numbered, df, users.unique_users(df)).first()
    assert [e.event_name for e in row.events] == ["open", "find", "pay"]
    assert row.metadata.date_range.first_event == "2026-01-05 10:00:00.000000"
    assert row.metadata.date_range.span_days == 1
    assert row.metadata.event_breakdown == {"open": 1, "find": 1, "pay": 1}
    empty = journeys.journey_record(
        numbered.where("false"), df.where("false"), users.unique_users(df)).first()
    assert (empty.total_events, empty.events, empty.metadata) == (0, [], None)


def payload(raw, **kwargs):
    rows = payloads.payload_json(payloads.user_payloads(raw, raw, **kwargs)).orderBy("part")
    return [json.loads(r.payload_json) for r in rows.collect()]


def test_payload_includes_repeated_system_events(spark):
    raw = event(spark, ("u", "open", D + "10:00:00"),
                *[("u", "boot", f"{D}11:00:0{i}", "system") for i in range(3)])
    all_scopes = payload(raw)[0]
    assert all_scopes["repetition_summary"] == {
        "total_events": 1, "unique_event_types": 1, "most_repeated_event": "boot",
        "repeated_events": [{"event_name": "boot", "frequency": 3, "repetitions_removed": 2}]}
    assert all_scopes["events_ordered"] == [{
        "event_date": "2026-01-05", "event_time": "10:00:00.000000", "event_name": "open",
        "category": "Application", "event_day": "Monday"}]
    narrow = payload(raw, repetition_scope="category")[0]["repetition_summary"]
    assert (narrow["most_repeated_event"], narrow["repeated_events"]) == (None, [])


def test_payload_of_a_user_with_system_events_only(spark):
    raw = event(spark, *[("u", "boot", f"{D}11:00:0{i}", "system") for i in range(3)])
    assert payload(raw) == [{
        "user_id": "u", "events_ordered": [], "repetition_summary": {
            "total_events": 0, "unique_event_types": 0, "most_repeated_event": None,
            "repeated_events": []}}]


def test_payload_parts_hold_everything_once(spark):
    raw = event(spark, *[("u", f"e{i % 6}", f"{D}10:{i:02d}:00") for i in range(25)])
    whole = payload(raw)[0]
    parts = payload(raw, items_per_part=4)
    assert len(parts) == 7
    assert sum((p["events_ordered"] for p in parts), []) == whole["events_ordered"]
    assert sum((p["repetition_summary"]["repeated_events"] for p in parts), []) == \
        whole["repetition_summary"]["repeated_events"]
    assert {p["repetition_summary"]["total_events"] for p in parts} == {25}


def test_most_repeated_takes_the_first_name_then_the_first_date(spark):
    rows = [("u", n, f"2026-01-0{d} 10:00:0{i}") for n in "ba" for d in (6, 5) for i in range(2)]
    repetition = audit.daily_repetition(event(spark, *rows))
    assert users.most_repeated(repetition).first().most_repeated_event == "a"


def test_prompt(spark):
    prompt = payloads.prompt_table(
        payloads.user_payloads(three(spark), three(spark)), "Say.").first().prompt
    assert prompt.startswith('Say.\n\nUSER EVENT DATA:\n{"user_id":"u"')


def test_view_order(spark):
    view = users.in_time_order(users.user_events_view(three(spark), users="u"))
    assert [r.event_name for r in view.collect()] == ["open", "find", "pay"]
    assert users.user_events_view(three(spark), users=["v"]).count() == 0


def test_null_category_is_never_selected(spark):
    df = event(spark, ("u", "a", D + "10:00:00", None), ("u", "b", D + "10:00:00", "APPLICATION"))
    assert [r.event_name for r in users.select_category(df).collect()] == ["b"]
