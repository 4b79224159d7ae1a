"""Stored model replies back into rows. A reply answers one prompt, so it is known
by user and part."""

from pyspark.sql import DataFrame, functions as F, types as T

from eventloom.schema import REPLY_SCHEMA

KEYS = ["user_uuid", "part"]

# What a reply must hold, the most it may hold, and how many events
# a preview shows.
REQUIRED_FIELD = "interpreted_sessions"
FENCE = "```"
FENCE_OPENS = r"^```(json)?\n?"
FENCE_CLOSES = r"\n?```$"
MAX_SESSIONS = 10
MAX_OBSERVATIONS = 3
PREVIEW_EVENTS = 4


def without_fence(reply):
    """Reply text without surrounding white space and, when it starts with a
    code fence, without the fence lines."""
    text = F.regexp_replace(reply, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(text, FENCE_OPENS, ""), FENCE_CLOSES, "")
    return F.when(F.startswith(text, F.lit(FENCE)), inner).otherwise(text)


FIELDS = {field.name: field.dataType.simpleString() for field in REPLY_SCHEMA}


def whole_value(text):
    """The text as a single strict JSON value (VARIANT); null for anything else.

    The parser stops after the first value. The text is therefore parsed as the first item of a list
    whose second is a hash of the text, which no text can hold itself: what follows the value, or
    closes the list early, moves that second item."""
    mark = F.md5(text.cast("binary"))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return F.struct(listed.alias("listed"), mark.alias("mark"))


def field(name: str, kind: str, of="reply"):
    return F.try_variant_get(of, f"$.{name}", kind)


def is_given(value):
    """True for a variant that is there and no JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def shape_error():
    """Name of the first field whose value is given but of another shape than a reply
    should have, from ``reply`` and ``parsed``; null if there is none."""
    listed = field(REQUIRED_FIELD, "array<struct<events variant>>")
    odd_events = F.exists(listed, lambda s: is_given(s["events"]) & F.try_variant_get(
        s["events"], "$", "array<string>").isNull())
    odd = {name: is_given(field(name, "variant")) & F.col(f"parsed.{name}").isNull() for name in FIELDS}
    odd[REQUIRED_FIELD] |= F.coalesce(F.exists(f"parsed.{REQUIRED_FIELD}", lambda s: s.isNull()), F.lit(False))
    found = F.when(F.coalesce(odd_events, F.lit(False)), F.lit("events"))
    order = [REQUIRED_FIELD, "key_observations", "overall_narrative"]
    return F.coalesce(*[F.when(odd[name], F.lit(name)) for name in order], found)


def parse_replies(replies: DataFrame) -> DataFrame:
    """Add ``is_structured``, ``reply``, ``parsed``, ``parse_error`` and ``shape_error`` to ``content``.

    ``reply`` is the whole value of a structured reply, with all it holds; ``parsed`` has the fields
    asked for. A field of another shape is no parse error: ``parsed`` lacks its contents,
    ``shape_error`` names it, and ``reply`` has it still."""
    value = F.when(F.try_variant_get("_whole.listed", "$[1]", "string") == F.col("_whole.mark"),
                   F.try_variant_get("_whole.listed", "$[0]", "variant"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("_value"), F.lit("OBJECT")), F.lit(False))
    has_field = field(REQUIRED_FIELD, "variant", "_value").isNotNull()
    parsed = F.struct(*[field(name, kind).alias(name) for name, kind in FIELDS.items()])
    return (
        replies.withColumn("_whole", whole_value(without_fence(F.col("content"))))
        .withColumn("_value", value)
        .withColumn("_object", is_object)
        .withColumn("is_structured", F.col("_object") & has_field)
        .withColumn("reply", F.when(F.col("is_structured"), F.col("_value")))
        .withColumn("parsed", F.when(F.col("is_structured"), parsed))
        .withColumn("parse_error",
                    F.when(~F.col("_object"), F.lit("Not a JSON object"))
                    .when(~has_field, F.lit(f"Missing {REQUIRED_FIELD} field")))
        .withColumn("shape_error", F.when(F.col("is_structured"), shape_error()))
        .drop("_whole", "_value", "_object")
    )


def reply_sessions(parsed: DataFrame) -> DataFrame:
    """One row per session a structured reply names, with defaults for what it
    leaves out."""
    empty = F.lit("")
    events = F.coalesce("_session.events", F.array().cast("array<string>"))
    number = F.col("_at") + 1
    return (
        parsed.where("is_structured")
        .select(*KEYS, F.posexplode("parsed.interpreted_sessions").alias("_at", "_session"))
        .select(
            *KEYS,
            number.cast("bigint").alias("session_number"),
            F.coalesce(F.when(F.col("_session.session_name") != "", F.col("_session.session_name")),
                       F.concat(F.lit("Session "), number.cast("string"))).alias("session_name"),
            *[F.coalesce(F.col(f"_session.{name}"), empty).alias(name)
              for name in ("date", "start_time", "end_time", "interpretation")],
            events.alias("events"),
            F.size(events).cast("bigint").alias("event_count"),
            F.slice(events, 1, PREVIEW_EVENTS).alias("preview"),
            F.greatest(F.size(events) - PREVIEW_EVENTS, F.lit(0)).cast("bigint")
            .alias("more_events"),
        )
    )


def reply_notes(parsed: DataFrame) -> DataFrame:
    """Narrative and observations of structured replies."""
    return parsed.where("is_structured").select(
        *KEYS,
        F.coalesce("parsed.overall_narrative", F.lit("")).alias("overall_narrative"),
        F.coalesce("parsed.key_observations", F.array().cast("array<string>"))
        .alias("key_observations"))


def reply_audit(parsed: DataFrame, events: DataFrame) -> DataFrame:
    """Whether each structured reply keeps to what was asked of it: at least one
    event per session, only events the user has, at most 10 sessions and at most
    3 observations. A reply with a field of another shape does not pass."""
    sessions = F.coalesce("parsed.interpreted_sessions",
                          F.array().cast(REPLY_SCHEMA["interpreted_sessions"].dataType))
    names = F.transform(sessions, lambda session: F.coalesce(
        session["events"], F.array().cast("array<string>")))
    notes = F.coalesce(F.size("parsed.key_observations"), F.lit(0))
    counts = {
        "session_count": F.size(sessions),
        "empty_sessions": F.size(F.filter(names, lambda listed: F.size(listed) == 0)),
        "observation_count": F.greatest(notes, F.lit(0)),
    }
    claimed = parsed.where("is_structured").select(
        *KEYS, F.col("shape_error").isNull().alias("_shaped"),
        *[count.cast("bigint").alias(name) for name, count in counts.items()],
        F.explode_outer(F.array_distinct(F.flatten(names))).alias("event_name"))
    real = events.select("user_uuid", "event_name").distinct().withColumn("_real", F.lit(True))
    unknown = F.col("event_name").isNotNull() & F.col("_real").isNull()
    return (
        claimed.join(real, ["user_uuid", "event_name"], "left")
        .groupBy(*KEYS, "_shaped", *counts).agg(F.count_if(unknown).alias("unknown_events"))
        .withColumn("passes", (F.col("empty_sessions") == 0) & (F.col("unknown_events") == 0)
                    & (F.col("session_count") <= MAX_SESSIONS)
                    & (F.col("observation_count") <= MAX_OBSERVATIONS) & F.col("_shaped"))
        .drop("_shaped")
    )
