import hashlib
import json
import re

from eventloom.operators import replies
from tests.support import event

GOOD = {"interpreted_sessions": [{"session_name": "", "events": ["a", "b"]}, {}],
        "overall_narrative": "n", "key_observations": ["1", "2", "3", "4"]}
BODY = json.dumps(GOOD)


def parse(spark, *contents):
    rows = [("u", part, content) for part, content in enumerate(contents, 1)]
    df = spark.createDataFrame(rows, "user_uuid string, part bigint, content string")
    return replies.parse_replies(df)


def structured(spark, *contents):
    rows = parse(spark, *contents).orderBy("part").collect()
    assert [r.content for r in rows] == list(contents)
    return [r.is_structured for r in rows]


def test_forms_that_parse(spark):
    assert structured(
        spark, BODY, f"```json\n{BODY}\n```", f"```\n{BODY}\n```", f"\n\t {BODY} \n",
        f"```json{BODY}```", json.dumps(GOOD, indent=2),
        '{"interpreted_sessions": null}', '{"interpreted_sessions": "none"}') == [True] * 8


def test_forms_that_do_not(spark):
    assert structured(
        spark, '{"other": 1}', "plain text", "[1]", "null", "3", '"interpreted_sessions"',
        '["interpreted_sessions"]', "", BODY + " and more", BODY + "}", BODY + "], [",
        BODY + ', "b": 2', f"Here it is:\n```json\n{BODY}\n```", BODY[:-1]) == [False] * 14


def test_no_strict_json(spark):
    assert structured(spark, "{'interpreted_sessions': []}",
                      '{"interpreted_sessions": [], "overall_narrative": "a\nb"}') == [False] * 2


def test_other_shapes_are_named_and_fail_the_audit(spark):
    parsed = parse(
        spark, '{"interpreted_sessions": ["a"]}', '{"interpreted_sessions": {"events": ["a"]}}',
        '{"interpreted_sessions": [{"events": "a"}]}',
        '{"interpreted_sessions": [{"events": ["a"]}], "key_observations": "one"}',
        '{"interpreted_sessions": [{"events": ["a"]}], "key_observations": ["one"]}')
    rows = parsed.orderBy("part").collect()
    assert [r.is_structured for r in rows] == [True] * 5
    assert [r.shape_error for r in rows] == [
        "interpreted_sessions", "interpreted_sessions", "events", "key_observations", None]
    audit = replies.reply_audit(parsed, event(spark, ("u", "a", "2026-01-05 10:00:00")))
    assert [r.passes for r in audit.orderBy("part").collect()] == [False] * 4 + [True]


def test_what_follows_the_value_is_seen(spark):
    """Also where it closes the list the text is parsed in, or looks like its end."""
    mark = hashlib.md5(BODY.encode()).hexdigest()
    assert structured(spark, BODY + "]", BODY + '] and "', BODY + f',"{mark}"]', BODY + f',"{mark}"] [' + BODY,
                      BODY + ",", BODY + ' "' + mark + '"', "," + BODY, BODY + "\n\t") == [False] * 7 + [True]


def test_the_whole_value_is_kept(spark):
    body = '{"interpreted_sessions": [{"events": ["a"], "mood": {"x": [1, null]}}], "more": true, "overall_narrative": 1.5}'
    row = parse(spark, body, "[1]").selectExpr(
        "to_json(reply) as reply", "parsed", "variant_get(reply, '$.interpreted_sessions[0].mood.x[0]', 'int') as x").collect()
    assert json.loads(row[0].reply) == json.loads(body)
    assert (row[0].x, row[0].parsed.overall_narrative) == (1, "1.5")
    assert (row[1].reply, row[1].parsed) == (None, None)


def test_one_json_pass(spark):
    plan = replies.parse_replies(spark.createDataFrame([("u", 1, BODY)], "user_uuid string, part bigint, content string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:try_)?parse_json\(|parseJson\(|from_json\(|json_object_keys\(|json_array_length\(", text)) == 1


def test_missing_reply(spark):
    row = parse(spark, None).first()
    assert (row.is_structured, row.parsed) == (False, None)


def test_errors_are_named(spark):
    rows = parse(spark, BODY, '{"other": 1}', "text").orderBy("part").collect()
    assert [r.parse_error for r in rows] == [
        None, "Missing interpreted_sessions field", "Not a JSON object"]


def test_session_defaults(spark):
    rows = replies.reply_sessions(parse(spark, BODY)).orderBy("session_number").collect()
    assert [r.session_name for r in rows] == ["Session 1", "Session 2"]
    assert (rows[0].date, rows[0].interpretation, rows[0].events) == ("", "", ["a", "b"])
    assert (rows[1].events, rows[1].event_count, rows[1].more_events) == ([], 0, 0)


def test_audit(spark):
    known = event(spark, ("u", "a", "2026-01-05 10:00:00"), ("v", "b", "2026-01-05 10:00:00"))
    row = replies.reply_audit(parse(spark, BODY), known).first()
    assert (row.session_count, row.empty_sessions, row.unknown_events, row.observation_count,
            row.passes) == (2, 1, 1, 4, False)
    fine = json.dumps({"interpreted_sessions": [{"events": ["a", "a"]}]})
    assert replies.reply_audit(parse(spark, fine), known).first().passes
    empty = replies.reply_audit(parse(spark, '{"interpreted_sessions": null}'), known).first()
    assert (empty.session_count, empty.unknown_events, empty.passes) == (0, 0, True)
