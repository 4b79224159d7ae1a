"""Every operator as a query over the ``events`` table; the SQL each is checked
against is in ``oracle.py`` under the same name."""

from pyspark.sql import DataFrame, functions as F

from eventloom.functions import texts, times
from eventloom.operators import (
    audit, cleaning, flowcharts, journeys, ordering, payloads, replies, sessions, user_days, users)
from eventloom.plans import jobs
from eventloom.schema import NODES_PER_SESSION, SESSION_GAP_MINUTES
from eventloom.sources import readers, shared
from eventloom.sources.sinks import with_user_key
from eventloom.sources.tables import load_events, stream_events, with_copies
from eventloom.streaming import bursts, finite, numbering

WIDE_BURST_MS = 30 * 60 * 1000
WIDE_GAP_MINUTES = 12 * 60
FEW_NODES = 3
FEW_ITEMS = 20
FEW_SESSIONS = 10
INSTRUCTION = "Group the events of this user into sessions and answer in JSON."

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def bursty(spark, sf_dir) -> DataFrame:
    return with_copies(load_events(spark, sf_dir))


def cleaned(spark, sf_dir) -> DataFrame:
    return cleaning.remove_bursts(bursty(spark, sf_dir))


def app(spark, sf_dir) -> DataFrame:
    return users.select_category(load_events(spark, sf_dir))


def rare(spark, sf_dir) -> DataFrame:
    """Events of a category that two thirds of the users lack, some without a name."""
    is_rare = (F.col("user_uuid").cast("bigint") % 3 == 0) & (F.col("event_pos") % 2 == 0)
    return users.select_category(load_events(spark, sf_dir).withColumns({
        "category": F.when(is_rare, F.lit("Rare")).otherwise(F.col("category")),
        "event_name": F.when(F.col("event_pos") % 5 != 0, F.col("event_name"))}), "rare")


def everyone(spark, sf_dir) -> DataFrame:
    return users.unique_users(load_events(spark, sf_dir))


def numbered(events, gap_minutes=SESSION_GAP_MINUTES, max_nodes=NODES_PER_SESSION) -> DataFrame:
    return sessions.number_events(events, gap_minutes, max_nodes)


def without_instants(df: DataFrame) -> DataFrame:
    """Times as text, so that both engines return the same type."""
    return df.withColumn("event_local", times.date_time_text(F.col("event_local"))).drop(
        "event_time", "event_offset")


# Reading times

# The offsets of the made time texts, and their minutes.
OFFSETS = [("+0000", 0), ("Z", 0), ("+05:30", 330), ("-0800", -480)]


def time_texts(spark, sf_dir, separator) -> DataFrame:
    """Events whose time is a text at one of several offsets, with three or six digits of fraction."""
    events = load_events(spark, sf_dir)
    text = times.date_time_text(F.col("event_local"))
    digits = F.when(F.col("event_pos") % 2 == 0, F.substring(text, 1, 23)).otherwise(text)
    offset = F.element_at(F.array(*[F.lit(name) for name, _ in OFFSETS]), (F.col("event_pos") % 4 + 1).cast("int"))
    return events.select("user_uuid", "event_name", "category", "event_pos", F.concat(
        F.replace(digits, F.lit(" "), F.lit(separator)), F.lit(" " if separator == " " else ""), offset).alias("event_time"))


def parsed_times(events):
    return without_instants(events.withColumns({
        "instant_us": F.unix_micros("event_time"), "offset_text": F.col("event_offset")}))


@query
def parse_raw_times(spark, sf_dir):
    """Raw times; every seventh text has a slash in its date and is rejected as it came."""
    texts_ = time_texts(spark, sf_dir, " ")
    odd = F.when(F.col("event_pos") % 7 == 0, F.replace("event_time", F.lit("-"), F.lit("/"))).otherwise(
        F.col("event_time"))
    good, rejected = readers.parse_raw_lenient(texts_.withColumn("event_time", odd))
    return parsed_times(good).unionByName(
        rejected.withColumnRenamed("event_time", "rejected_text"), allowMissingColumns=True)


@query
def parse_iso_times(spark, sf_dir):
    """ISO times; every fifth text has no offset, which counts as offset zero."""
    texts_ = time_texts(spark, sf_dir, "T")
    bare = F.when(F.col("event_pos") % 5 == 0, F.regexp_replace("event_time", readers.OFFSET_PATTERN, "")).otherwise(
        F.col("event_time"))
    return parsed_times(readers.parse_iso(texts_.withColumn("event_time", bare)))


# Cleaning

@query
def event_calendar(spark, sf_dir):
    return times.calendar(load_events(spark, sf_dir)).select(
        "event_pos", "user_uuid", "event_date", "event_day", "event_time_only")


@query
def event_gaps(spark, sf_dir):
    return without_instants(cleaning.event_gaps(bursty(spark, sf_dir)))


@query
def dedup_clean(spark, sf_dir):
    return without_instants(cleaning.cleaned_events(bursty(spark, sf_dir)))


def grown_store(spark, sf_dir):
    """A store to which the events came in three logs, each with events before and among those of the others."""
    store = shared.new_path(spark, "store")
    events = bursty(spark, sf_dir)
    for k in (2, 0, 1):
        jobs.add_events(spark, events.where(F.col("event_pos") % 3 == k), store, f"log-{k}")
    return jobs.read_store(spark, store)


@query
def incremental_clean(spark, sf_dir):
    return without_instants(grown_store(spark, sf_dir)[0])


@query
def incremental_repetition(spark, sf_dir):
    return grown_store(spark, sf_dir)[1]


@query
def dedup_wide(spark, sf_dir):
    return without_instants(
        cleaning.cleaned_events(load_events(spark, sf_dir), WIDE_BURST_MS))


@query
def dedup_by_gap(spark, sf_dir):
    gaps = cleaning.event_gaps(bursty(spark, sf_dir))
    return without_instants(gaps.where(cleaning.is_canonical()).drop("gap_us"))


@query
def timeline(spark, sf_dir):
    return without_instants(ordering.timeline(cleaned(spark, sf_dir)))


@query
def timeline_second_pass(spark, sf_dir):
    return without_instants(ordering.timeline(cleaned(spark, sf_dir), cleaning.BURST_MS))


# Audit

@query
def daily_repetition(spark, sf_dir):
    return audit.daily_repetition(load_events(spark, sf_dir))


@query
def daily_repetition_all(spark, sf_dir):
    return audit.daily_repetition(bursty(spark, sf_dir), repeated_only=False)


@query
def timeline_repetition(spark, sf_dir):
    return audit.daily_repetition(cleaned(spark, sf_dir))


def audit_micros(bursts):
    return bursts.withColumns({"burst_start": F.unix_micros("burst_start"),
                               "burst_end": F.unix_micros("burst_end")})


@query
def burst_audit(spark, sf_dir):
    return audit_micros(audit.burst_audit(bursty(spark, sf_dir)))


@query
def burst_audit_wide(spark, sf_dir):
    return audit_micros(audit.burst_audit(bursty(spark, sf_dir), WIDE_BURST_MS))


# Users

# Burst removal keeps the first event of every user, so the users of the raw
# events are those of the cleaned ones.

@query
def unique_users(spark, sf_dir):
    return users.unique_users(bursty(spark, sf_dir))


@query
def unique_users_count(spark, sf_dir):
    return users.unique_users_count(bursty(spark, sf_dir))


@query
def global_metrics(spark, sf_dir):
    return users.global_metrics(cleaned(spark, sf_dir))


@query
def user_metrics(spark, sf_dir):
    return users.user_metrics(app(spark, sf_dir))


@query
def user_metrics_rare(spark, sf_dir):
    return users.user_metrics(rare(spark, sf_dir), everyone(spark, sf_dir))


@query
def user_event_types(spark, sf_dir):
    return users.user_event_types(load_events(spark, sf_dir))


@query
def app_events(spark, sf_dir):
    return without_instants(app(spark, sf_dir))


@query
def user_events_view(spark, sf_dir):
    return users.user_events_view(load_events(spark, sf_dir), category="APPLICATION").drop(
        "event_local")


@query
def user_events_view_one_event(spark, sf_dir):
    return users.user_events_view(load_events(spark, sf_dir), event_name="click").drop(
        "event_local")


@query
def selected_users_view(spark, sf_dir):
    """Events of the users who repeated an event at least four times a day."""
    events = load_events(spark, sf_dir)
    chosen = audit.daily_repetition(events).where("frequency >= 4")
    return users.user_events_view(events, users=chosen).drop("event_local")


@query
def repetition_view(spark, sf_dir):
    return users.select_event(audit.daily_repetition(load_events(spark, sf_dir)), "view")


@query
def user_key(spark, sf_dir):
    pairs = load_events(spark, sf_dir).select(
        F.concat("user_uuid", F.lit("/a\\"), "event_name").alias("user_uuid")).distinct()
    return with_user_key(pairs)


@query
def event_breakdown(spark, sf_dir):
    return users.event_breakdown(app(spark, sf_dir))


@query
def category_breakdown(spark, sf_dir):
    return users.category_breakdown(load_events(spark, sf_dir))


@query
def most_repeated(spark, sf_dir):
    return users.most_repeated(audit.daily_repetition(load_events(spark, sf_dir)))


def user_days_of(spark, sf_dir) -> DataFrame:
    """Bitmaps of the events as two logs, the second with users of its own."""
    events = load_events(spark, sf_dir)
    late = F.col("event_pos") % 3 == 0
    numbers = user_days.numbered_users(events.where(~late & (F.col("user_uuid") % 5 != 0)))
    numbers = numbers.unionByName(user_days.numbered_users(events, numbers))
    return shared.stored(user_days.user_days(events.where(~late), numbers).unionByName(
        user_days.user_days(events.where(late), numbers)), "user-days")


@query
def monthly_users(spark, sf_dir):
    """Distinct users per month from bitmaps per day."""
    month = F.col("event_date").cast("string").substr(1, 7)
    return user_days.metrics_of_days(user_days_of(spark, sf_dir), month).withColumnRenamed("_group0", "month")


@query
def february_users(spark, sf_dir):
    """Distinct users over a range of days that no month or week matches."""
    days = user_days_of(spark, sf_dir).where(F.col("event_date").between("2024-01-20", "2024-02-17"))
    return user_days.metrics_of_days(days)


# Sessions

def without_session_times(df):
    return without_instants(df).drop("session_start", "session_end")


@query
def session_events(spark, sf_dir):
    return without_session_times(numbered(bursty(spark, sf_dir)))


@query
def session_events_wide(spark, sf_dir):
    return without_session_times(
        numbered(load_events(spark, sf_dir), WIDE_GAP_MINUTES, FEW_NODES))


@query
def session_summary(spark, sf_dir):
    return sessions.session_summary(load_events(spark, sf_dir))


@query
def session_summary_clean(spark, sf_dir):
    """Raw events to burst-free events to session summary."""
    return sessions.session_summary(cleaned(spark, sf_dir))


@query
def session_summary_wide(spark, sf_dir):
    return sessions.session_summary(load_events(spark, sf_dir), WIDE_GAP_MINUTES)


@query
def sessions_per_user(spark, sf_dir):
    return sessions.sessions_per_user(app(spark, sf_dir))


@query
def sessions_per_user_rare(spark, sf_dir):
    return sessions.sessions_per_user(rare(spark, sf_dir), users=everyone(spark, sf_dir))


def as_json(df, name):
    return df.withColumn(name, F.to_json(name, {"ignoreNullFields": "false"}))


@query
def session_cards(spark, sf_dir):
    return as_json(sessions.session_cards(numbered(bursty(spark, sf_dir)), items_per_part=2), "events")


@query
def session_preview(spark, sf_dir):
    preview = sessions.session_preview(numbered(bursty(spark, sf_dir), WIDE_GAP_MINUTES))
    return as_json(preview, "events")


@query
def session_labels(spark, sf_dir):
    return sessions.session_labels(numbered(bursty(spark, sf_dir), WIDE_GAP_MINUTES, FEW_NODES))


# Journeys

@query
def journey_events(spark, sf_dir):
    return journeys.journey_events(numbered(app(spark, sf_dir)))


@query
def journey_path(spark, sf_dir):
    return journeys.journey_path(numbered(app(spark, sf_dir)))


@query
def journey_path_parts(spark, sf_dir):
    return journeys.journey_path(numbered(app(spark, sf_dir)), FEW_ITEMS)


@query
def journey_path_rare(spark, sf_dir):
    return journeys.journey_path(numbered(rare(spark, sf_dir)), FEW_ITEMS, everyone(spark, sf_dir))


@query
def session_path_rare(spark, sf_dir):
    return journeys.session_path(numbered(rare(spark, sf_dir), WIDE_GAP_MINUTES), 4)


@query
def session_path(spark, sf_dir):
    return journeys.session_path(numbered(bursty(spark, sf_dir), WIDE_GAP_MINUTES), 4)


@query
def journey_nodes(spark, sf_dir):
    return journeys.journey_nodes(numbered(app(spark, sf_dir), WIDE_GAP_MINUTES, FEW_NODES)).drop(
        "event_local")


@query
def journey_edges(spark, sf_dir):
    return journeys.journey_edges(numbered(bursty(spark, sf_dir), WIDE_GAP_MINUTES, FEW_NODES))


@query
def transitions(spark, sf_dir):
    return journeys.transitions(numbered(bursty(spark, sf_dir), WIDE_GAP_MINUTES), items_per_part=2)


@query
def transition_counts(spark, sf_dir):
    return journeys.transition_counts(journeys.transitions(numbered(load_events(spark, sf_dir))))


@query
def chart_labels(spark, sf_dir):
    """Labels of the free-text properties, which hold characters to clean."""
    props = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "event_type", F.concat("event_type", F.lit(" & <#"), "props", F.lit("> [|;\r\n] \""),
                             F.repeat("event_type", 3)).alias("name"))
    return props.select("event_id", texts.chart_label(F.col("name")).alias("label"),
                        texts.chart_label(F.col("event_type")).alias("short_label"))


@query
def journey_record(spark, sf_dir):
    events = load_events(spark, sf_dir)
    chosen = users.select_category(events)
    record = journeys.journey_record(numbered(chosen), chosen, events, FEW_ITEMS)
    return as_json(as_json(record, "events"), "metadata")


@query
def flowchart_text(spark, sf_dir):
    events = load_events(spark, sf_dir)
    return flowcharts.flowchart_text(events, users.unique_users(events), category="application")


@query
def flowchart_rare(spark, sf_dir):
    return flowcharts.flowchart_text(rare(spark, sf_dir), everyone(spark, sf_dir))


@query
def flowchart_parts(spark, sf_dir):
    events = load_events(spark, sf_dir)
    everyone = users.unique_users(events)
    charts = flowcharts.flowcharts(numbered(events, WIDE_GAP_MINUTES, FEW_NODES), FEW_SESSIONS)
    return flowcharts.with_empty_charts(charts, everyone)


# Payloads

@query
def ai_payload(spark, sf_dir):
    events = load_events(spark, sf_dir)
    return payloads.payload_json(payloads.user_payloads(events, events))


@query
def ai_payload_parts(spark, sf_dir):
    raw = bursty(spark, sf_dir)
    clean = cleaning.remove_bursts(raw)
    return payloads.payload_json(payloads.user_payloads(
        raw, clean, repetition_scope="category", items_per_part=FEW_ITEMS))


@query
def prompt_table(spark, sf_dir):
    events = load_events(spark, sf_dir)
    return payloads.prompt_table(payloads.user_payloads(events, events), INSTRUCTION)


# Replies

CARDS_APART = 100_000


def made_replies(spark, sf_dir) -> DataFrame:
    """A reply per user and day, made from the sessions of that day, in thirteen forms: well-formed,
    unusable, not quite JSON, and of another shape; some name events that never happened.
    What goes on in a further part of a session card is in a reply of its own."""
    cards = sessions.session_cards(numbered(load_events(spark, sf_dir)))
    number = F.col("session_id")
    names = F.transform("events", lambda event: event["name"])
    names = (F.when(number % 11 == 0, F.slice(names, 1, 0))
             .when(number % 7 == 0, F.concat(names, F.array(F.lit("teleport"))))
             .otherwise(names))
    item = F.struct(
        F.when(number % 2 == 0, F.concat(F.lit("Visit "), number.cast("string")))
        .alias("session_name"),
        F.col("session_date").alias("date"), "start_time", "end_time",
        names.alias("events"),
        F.when(number % 3 == 0, F.lit('Said "so"')).alias("interpretation"))
    day = F.datediff(F.col("session_date").cast("date"), F.lit("2024-01-01").cast("date"))
    part = day.cast("bigint") + (F.col("part") - 1) * CARDS_APART
    listed = cards.groupBy("user_uuid", part.alias("part")).agg(
        sessions.in_sequence(number, item).alias("_sessions"))
    notes = F.to_json(F.transform("_sessions", lambda session: F.concat(F.lit("At "), session["start_time"])))
    listed = listed.withColumns({
        "_list": F.to_json("_sessions"), "_first": F.to_json(F.get("_sessions", F.lit(0))), "_notes": notes})
    told = F.when(F.col("part") % 2 == 0, F.lit('"A day"')).otherwise(F.lit("null"))

    def reply(listed_sessions, listed_notes=F.col("_notes"), rest=""):
        return F.concat(
            F.lit('{"interpreted_sessions":'), listed_sessions, F.lit(',"overall_narrative":'), told,
            F.lit(',"key_observations":'), listed_notes, F.lit(rest + "}"))

    body = reply(F.col("_list"))
    form = F.pmod(F.col("user_uuid").cast("bigint") + F.col("part"), F.lit(13))
    forms = [
        F.concat(F.lit("```json\n"), body, F.lit("\n```")),
        F.concat(F.lit(" \n\t"), body, F.lit("\n")),
        F.concat(F.lit("```\n"), body, F.lit("\n```  ")),
        F.concat(F.lit('{"sessions": '), body, F.lit("}")),
        F.concat(body, F.lit(" and more")),
        F.concat(F.lit("["), body, F.lit("]")),
        F.lit("No sessions."),
        F.translate(body, '"', "'"),
        reply(F.col("_list"), rest=',"note":"one\ntwo"'),
        reply(F.col("_notes")),
        reply(F.col("_first")),
        reply(F.col("_list"), F.lit('"One thing"')),
        reply(F.lit('[{"events":"click"}]')),
    ]
    content = F.element_at(F.array(*forms), (form + 1).cast("int"))
    return listed.select("user_uuid", "part", content.alias("content"))


@query
def ai_reply_parse(spark, sf_dir):
    parsed = replies.parse_replies(made_replies(spark, sf_dir))
    return parsed.select(
        "user_uuid", "part", "is_structured", "parse_error", "shape_error",
        F.size("parsed.interpreted_sessions").cast("bigint").alias("session_count"),
        F.col("parsed.overall_narrative").alias("overall_narrative"))


@query
def ai_reply_sessions(spark, sf_dir):
    rows = replies.reply_sessions(replies.parse_replies(made_replies(spark, sf_dir)))
    return as_json(as_json(rows, "events"), "preview")


@query
def ai_reply_notes(spark, sf_dir):
    notes = replies.reply_notes(replies.parse_replies(made_replies(spark, sf_dir)))
    return as_json(notes, "key_observations")


@query
def ai_reply_audit(spark, sf_dir):
    return replies.reply_audit(replies.parse_replies(made_replies(spark, sf_dir)),
                               load_events(spark, sf_dir))


# Streams, run to their end

@query
def stream_bursts(spark, sf_dir):
    """Burst removal over a file stream of the events and their copies, with a file sink."""
    folder = shared.new_path(spark, "stream-bursts")
    events = with_copies(stream_events(spark, sf_dir))
    kept = bursts.remove_bursts_stream(finite.with_end(events, f"{folder}/end"))
    start = lambda: finite.available_now(kept, f"{folder}/checkpoint").start(f"{folder}/kept")
    finite.run_to_end(events, f"{folder}/end", start)
    return without_instants(times.calendar(spark.read.schema(events.schema).parquet(f"{folder}/kept")))


@query
def stream_sessions(spark, sf_dir):
    """Numbered sessions of a file stream, the numbers carried from batch to batch."""
    folder = shared.new_path(spark, "stream-sessions")
    events = stream_events(spark, sf_dir)
    ended = finite.with_end(events, f"{folder}/end")
    finite.run_to_end(events, f"{folder}/end", lambda: numbering.start_numbering(ended, folder))
    return numbering.numbered_sessions(spark, folder)
