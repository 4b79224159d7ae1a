"""Plain SQL for the queries of ``queries.py``, run by another engine on the same
tables. It uses whole-key windows throughout, so it shares no method with them."""

BASE = """
ev as (
  select event_id as event_pos, cast(user_id as varchar) as user_uuid, event_type as event_name,
    case when event_type in ('error', 'signup') then 'system' else 'Application' end as category,
    ts as event_local
  from events
),
app as (select * from ev where lower(category) = 'application'),
inj as (
  select event_pos * 10 + k as event_pos, user_uuid, event_name, category,
    event_local + to_microseconds(off) as event_local
  from ev, (values (0, 0), (1, 20000), (2, 70000), (3, 120001)) v(k, off)
  where k = 0 or event_pos % (k + 2) = 0
)"""

LOCAL = "strftime(event_local, '%Y-%m-%d %H:%M:%S.%f')"
CALENDAR = """strftime(event_local, '%Y-%m-%d') as event_date, dayname(event_local) as event_day,
    '''' || strftime(event_local, '%H:%M:%S.%f') as event_time_only"""


def gaps(source):
    return f"""
gaps as (
  select *, epoch_us(event_local) - lag(epoch_us(event_local)) over (
    partition by user_uuid, event_name order by event_local, event_pos) as gap_us
  from {source}
)"""


def kept(source, name, limit_us=50_000):
    return f"""{gaps(source)},
{name} as (
  select event_pos, user_uuid, event_name, category, event_local from gaps
  where gap_us is null or gap_us > {limit_us}
)"""


def repetition(source, name="rep", having="having count(*) > 1"):
    return f"""
{name} as (
  select user_uuid, event_name, strftime(event_local, '%Y-%m-%d') as event_date,
    strftime(min(event_local), '%H:%M:%S.%f') as start_time,
    strftime(max(event_local), '%H:%M:%S.%f') as end_time,
    count(*) as frequency, count(*) - 1 as repetitions_removed,
    dayname(min(event_local)) as event_day
  from {source} group by 1, 2, 3 {having}
)"""


def numbered(source, gap_minutes=30, nodes=50):
    """Events of a source with sequence, session and node numbers as ``num``."""
    return f"""
flagged as (
  select *, row_number() over w as sequence,
    case when lag(event_local) over w is null
      or cast(event_local as date) <> cast(lag(event_local) over w as date)
      or date_trunc('second', event_local) - date_trunc('second', lag(event_local) over w)
        > interval {gap_minutes} minutes then 1 else 0 end as is_new
  from {source}
  window w as (partition by user_uuid order by event_local, event_name, event_pos)
),
with_session as (
  select *, cast(sum(is_new) over (
    partition by user_uuid order by sequence rows unbounded preceding) as bigint) as session_id
  from flagged
),
ranked as (
  select *, row_number() over (
      partition by user_uuid, session_id order by sequence) as session_sequence,
    max(session_id) over (partition by user_uuid) as session_count
  from with_session
),
num as (
  select *, case when session_sequence <= {nodes} then cast(sum(
      case when session_sequence <= {nodes} then 1 else 0 end) over (
      partition by user_uuid order by sequence rows unbounded preceding) as bigint)
    end as node_sequence
  from ranked
)"""


SUMMARY = """
summary as (
  select user_uuid, session_id, strftime(min(event_local), '%Y-%m-%d') as session_date,
    strftime(min(event_local), '%H:%M:%S') as start_time,
    strftime(max(event_local), '%H:%M:%S') as end_time, count(*) as event_count
  from num group by 1, 2
)"""

ITEM = """{'name': event_name, 'time': strftime(event_local, '%H:%M:%S'), 'category': category}"""

LABEL = r"""replace(translate({0}, '"[]{{}}|' || chr(10) || '<>#;' || chr(13), '''()()- '),
  '&', 'and')"""


def label(text):
    safe = LABEL.format(text)
    return f"case when length({safe}) > 30 then substr({safe}, 1, 27) || '...' else {safe} end"


def sql(*ctes, select):
    return f"with {BASE.strip()}" + "".join("," + cte for cte in ctes) + "\n" + select


def events_out(columns, source):
    return f"select {columns}, {LOCAL} as event_local from {source}"


EVENT = "event_pos, user_uuid, event_name, category"
NUMBERS = """sequence, session_id, session_sequence, node_sequence, session_count,
  count(*) over (partition by user_uuid, session_id) as session_size"""


def part(place, size):
    return f"cast(floor(({place} - 1) / {size}) as bigint) + 1"


def timeline(source):
    return f"""select {EVENT}, {LOCAL} as event_local, row_number() over (
      partition by user_uuid order by event_local, event_name, event_pos) as sequence
    from {source}"""


def burst_audit(limit_us):
    return sql(gaps("inj"), f"""
islands as (
  select *, sum(case when gap_us is null or gap_us > {limit_us} then 1 else 0 end) over (
    partition by user_uuid, event_name order by event_local, event_pos
    rows unbounded preceding) as burst
  from gaps
)""", select="""
select user_uuid, event_name, epoch_us(min(event_local)) as burst_start,
  epoch_us(max(event_local)) as burst_end, count(*) as burst_size, count(*) - 1 as removed
from islands group by user_uuid, event_name, burst""")


def payload(size, events, raw):
    """Payload text as ``pay`` for events already numbered as ``num``."""
    return f"""
listed as (
  select user_uuid, {part('sequence', size)} as part,
    to_json(list({{'event_date': strftime(event_local, '%Y-%m-%d'),
      'event_time': strftime(event_local, '%H:%M:%S.%f'), 'event_name': event_name,
      'category': category, 'event_day': dayname(event_local)}} order by sequence))::varchar as body
  from num group by 1, 2
),
placed as (
  select *, row_number() over (partition by user_uuid order by event_name, event_date) as place
  from rep
),
repeated as (
  select user_uuid, {part('place', size)} as part,
    to_json(list({{'event_name': event_name, 'frequency': frequency,
      'repetitions_removed': repetitions_removed}} order by place))::varchar as body
  from placed group by 1, 2
),
most as (
  select distinct on (user_uuid) user_uuid, event_name as most_repeated_event
  from rep order by user_uuid, frequency desc, event_name, event_date
),
totals as (
  select user_uuid, count(*) as total_events, count(distinct event_name) as types
  from {events} group by 1
),
parts as (
  select user_uuid, part from listed
  union select user_uuid, part from repeated where user_uuid in (select user_uuid from totals)
  union select user_uuid, 1 from {raw}
),
pay as (
  select p.user_uuid, p.part, '{{"user_id":' || to_json(p.user_uuid)::varchar
    || ',"events_ordered":' || coalesce(l.body, '[]')
    || ',"repetition_summary":{{"total_events":' || coalesce(t.total_events, 0)
    || ',"unique_event_types":' || coalesce(t.types, 0)
    || ',"most_repeated_event":'
    || case when t.total_events is null or m.most_repeated_event is null then 'null'
       else to_json(m.most_repeated_event)::varchar end
    || ',"repeated_events":' || case when t.total_events is null then '[]'
       else coalesce(r.body, '[]') end || '}}}}' as payload_json
  from parts p
  left join totals t using (user_uuid) left join most m using (user_uuid)
  left join listed l on l.user_uuid = p.user_uuid and l.part = p.part
  left join repeated r on r.user_uuid = p.user_uuid and r.part = p.part
)"""


def flowchart(source, nodes, gap, sessions_per_part, everyone="ev"):
    return sql(numbered(source, gap, nodes), f"""
blocks as (
  select user_uuid, session_id, any_value(session_count) as session_count,
    string_agg(case when session_count > 1 then '        ' else '    ' end
      || 'N' || node_sequence || '["' || {label('event_name')} || '"]'
      || case when session_sequence > 1 then chr(10)
        || case when session_count > 1 then '        ' else '    ' end
        || 'N' || (node_sequence - 1) || ' --> N' || node_sequence else '' end,
      chr(10) order by session_sequence) as lines,
    strftime(min(event_local), '%Y-%m-%d (%H:%M') || ' - '
      || strftime(max(event_local), '%H:%M)') as span
  from num where session_sequence <= {nodes} group by 1, 2
),
charts as (
  select user_uuid, {part('session_id', sessions_per_part)} as part,
    case when {part('min(session_id)', sessions_per_part)} = 1
      then 'flowchart TD' || chr(10) else '' end
    || string_agg(case when session_count > 1
      then '    subgraph S' || (session_id - 1) || '["Session ' || session_id || ': ' || span
        || '"]' || chr(10) || lines || chr(10) || '    end' else lines end,
      chr(10) order by session_id)
    || case when max(session_id) = max(session_count) then chr(10) || chr(10)
      || '    classDef default fill:#4a5568,stroke:#2d3748,color:#fff' else '' end as flowchart
  from blocks group by 1, 2
)""", select=f"""
select user_uuid, part, flowchart from charts
union all
select distinct user_uuid, 1, 'flowchart LR' || chr(10) || '    A[No Events Found]'
from {everyone} where user_uuid not in (select user_uuid from charts)""")


def path(source, size, per_session=False, gap=30):
    if per_session:
        return sql(numbered(source, gap), select=f"""
select user_uuid, session_id, {part('session_sequence', size)} as part,
  string_agg(event_name, ' -> ' order by sequence) as path from num group by 1, 2, 3""")
    return sql(numbered(source, gap), select=f"""
select user_uuid, {part('sequence', size)} as part, count(*) as event_count,
  string_agg(event_name, ' -> ' order by sequence) as path from num group by 1, 2""")


RARE = """(
  select event_pos, user_uuid, case when event_pos % 5 <> 0 then event_name end as event_name,
    'Rare' as category, event_local
  from ev where cast(user_uuid as bigint) % 3 = 0 and event_pos % 2 = 0)"""

RARE_SHOWN = f"(select * replace (coalesce(event_name, '(unnamed)') as event_name) from {RARE})"

REPLIES = (numbered("ev"), SUMMARY, """
named as (
  select user_uuid, session_id, (session_sequence - 1) // 10000 as card, case when session_id % 11 = 0 then []
    when session_id % 7 = 0 then list_append(list(event_name order by sequence), 'teleport')
    else list(event_name order by sequence) end as names
  from num group by 1, 2, 3
),
listed as (
  select user_uuid, datediff('day', date '2024-01-01', cast(session_date as date)) + 100000 * card as part,
    to_json(list({
      'session_name': case when session_id % 2 = 0 then 'Visit ' || session_id end,
      'date': session_date, 'start_time': start_time, 'end_time': end_time, 'events': names,
      'interpretation': case when session_id % 3 = 0 then 'Said "so"' end
    } order by session_id))::varchar as sessions,
    to_json(list('At ' || start_time order by session_id))::varchar as notes
  from summary join named using (user_uuid, session_id) group by 1, 2
),
bodies as (
  select *, (cast(user_uuid as bigint) + part) % 13 as form,
    '{"interpreted_sessions":' as head, ',"overall_narrative":'
    || case when part % 2 = 0 then '"A day"' else 'null' end || ',"key_observations":' as middle,
    head || sessions || middle || notes || '}' as body
  from listed
),
replies as (
  select user_uuid, part, case form
    when 0 then '```json' || chr(10) || body || chr(10) || '```'
    when 1 then ' ' || chr(10) || chr(9) || body || chr(10)
    when 2 then '```' || chr(10) || body || chr(10) || '```  '
    when 3 then '{"sessions": ' || body || '}'
    when 4 then body || ' and more'
    when 5 then '[' || body || ']'
    when 7 then replace(body, '"', chr(39))
    when 8 then head || sessions || middle || notes || ',"note":"one' || chr(10) || 'two"}'
    when 9 then head || notes || middle || notes || '}'
    when 10 then head || (sessions::json->0)::varchar || middle || notes || '}'
    when 11 then head || sessions || middle || '"One thing"}'
    when 12 then head || '[{"events":"click"}]' || middle || notes || '}'
    else 'No sessions.' end as content
  from bodies
),
texts as (
  select *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') as trimmed from replies
),
unfenced as (
  select *, case when starts_with(trimmed, '```')
    then regexp_replace(regexp_replace(trimmed, '^```(json)?\\n?', ''), '\\n?```$', '')
    else trimmed end as body
  from texts
),
parsed as (
  select user_uuid, part, body, json_valid(body) and coalesce(
      json_type(case when json_valid(body) then body end) = 'OBJECT', false) as is_object,
    coalesce(json_exists(case when json_valid(body) then body end,
      '$.interpreted_sessions'), false) and is_object as is_structured
  from unfenced
),
counted as (
  select *, json_type(body, '$.interpreted_sessions') = 'ARRAY' as is_list,
    json_type(body, '$.key_observations') = 'ARRAY' as has_notes,
    case when is_list then cast(json_array_length(body, '$.interpreted_sessions') as bigint) end as session_count,
    case when has_notes then cast(json_array_length(body, '$.key_observations') as bigint) else 0 end
      as observation_count
  from parsed where is_structured
),
items as (
  select user_uuid, part, json_extract(body, '$.interpreted_sessions[' || (n - 1) || ']') as item, n
  from (select *, unnest(range(1, session_count + 1)) as n from counted)
),
rows_out as (
  select user_uuid, part, n as session_number,
    coalesce(item->>'$.session_name', 'Session ' || n) as session_name,
    coalesce(item->>'$.date', '') as date, coalesce(item->>'$.start_time', '') as start_time,
    coalesce(item->>'$.end_time', '') as end_time,
    coalesce(item->>'$.interpretation', '') as interpretation,
    case when json_type(item, '$.events') = 'ARRAY' then cast(item->'$.events' as varchar[]) else [] end
      as event_list,
    json_type(item) <> 'OBJECT' as odd, coalesce(json_type(item, '$.events') <> 'ARRAY', false) as odd_events
  from items
),
shaped as (
  select c.*, case when not is_list or coalesce(odd, false) then 'interpreted_sessions'
    when not has_notes then 'key_observations' when odd_events then 'events' end as shape_error
  from counted c left join (select user_uuid, part, bool_or(odd) as odd, bool_or(odd_events) as odd_events
    from rows_out group by 1, 2) using (user_uuid, part)
)""")

SQL = {
    "event_calendar": sql(select=f"select event_pos, user_uuid, {CALENDAR} from ev"),
    "event_gaps": sql(gaps("inj"), select=events_out(f"{EVENT}, gap_us", "gaps")),
    "dedup_clean": sql(kept("inj", "k"), select=events_out(f"{EVENT}, {CALENDAR}", "k")),
    "dedup_wide": sql(kept("ev", "k", 1_800_000_000),
                      select=events_out(f"{EVENT}, {CALENDAR}", "k")),
    "dedup_by_gap": sql(kept("inj", "k"), select=events_out(EVENT, "k")),
    "timeline": sql(kept("inj", "k"), select=timeline("k")),
    "timeline_second_pass": sql(kept("inj", "k"), select=timeline("k")),
    "daily_repetition": sql(repetition("ev"), select="select * from rep"),
    "daily_repetition_all": sql(repetition("inj", having=""), select="select * from rep"),
    "timeline_repetition": sql(kept("inj", "k"), repetition("k"), select="select * from rep"),
    "burst_audit": burst_audit(50_000),
    "burst_audit_wide": burst_audit(1_800_000_000),
    "unique_users": sql(kept("inj", "k"), select="select distinct user_uuid from k"),
    "unique_users_count": sql(kept("inj", "k"), select="""
select 'total_unique_users' as metric, count(*) as value from (select distinct user_uuid from k)"""),
    "global_metrics": sql(kept("inj", "k"), select="""
select count(distinct user_uuid) as total_users, count(*) as total_events from k"""),
    "user_metrics": sql(select="""
select user_uuid, count(*) as total_events, count(distinct event_name) as unique_event_types,
  strftime(min(event_local), '%Y-%m-%d %H:%M:%S.%f') as first_event,
  strftime(max(event_local), '%Y-%m-%d %H:%M:%S.%f') as last_event,
  datediff('day', min(event_local)::date, max(event_local)::date) + 1 as span_days
from app group by 1"""),
    "user_metrics_rare": sql(select=f"""
select user_uuid, count(r.event_pos) as total_events,
  count(distinct r.event_name) as unique_event_types,
  strftime(min(r.event_local), '%Y-%m-%d %H:%M:%S.%f') as first_event,
  strftime(max(r.event_local), '%Y-%m-%d %H:%M:%S.%f') as last_event,
  coalesce(datediff('day', min(r.event_local)::date, max(r.event_local)::date) + 1, 0) as span_days
from (select distinct user_uuid from ev) left join {RARE} r using (user_uuid) group by 1"""),
    "user_event_types": sql(select="""
select user_uuid, event_name, row_number() over (
  partition by user_uuid order by event_name) as position
from (select distinct user_uuid, event_name from ev)"""),
    "app_events": sql(select=events_out(EVENT, "app")),
    "user_events_view": sql(select=f"select {EVENT}, {CALENDAR} from app"),
    "user_events_view_one_event": sql(
        select=f"select {EVENT}, {CALENDAR} from ev where event_name = 'click'"),
    "selected_users_view": sql(repetition("ev"), select=f"""
select {EVENT}, {CALENDAR} from ev
where user_uuid in (select user_uuid from rep where frequency >= 4)"""),
    "repetition_view": sql(repetition("ev"), select="select * from rep where event_name = 'view'"),
    "user_key": sql(select=r"""
select distinct user_uuid || '/a\' || event_name as user_uuid,
  replace(replace(user_uuid || '/a\' || event_name, '/', '_'), '\', '_') as user_key from ev"""),
    "event_breakdown": sql(select="""
select *, row_number() over (
  partition by user_uuid order by event_count desc, event_name) as rank
from (select user_uuid, event_name, count(*) as event_count from app group by 1, 2)"""),
    "category_breakdown": sql(select="""
select user_uuid, category, count(*) as event_count from ev group by 1, 2"""),
    "most_repeated": sql(repetition("ev"), select="""
select user_uuid, event_name as most_repeated_event, frequency from (
  select *, row_number() over (
    partition by user_uuid order by frequency desc, event_name, event_date) as place from rep)
where place = 1"""),
    "session_events": sql(numbered("inj"), select=events_out(f"{EVENT}, {NUMBERS}", "num")),
    "session_events_wide": sql(numbered("ev", 720, 3),
                               select=events_out(f"{EVENT}, {NUMBERS}", "num")),
    "session_summary": sql(numbered("ev"), SUMMARY, select="select * from summary"),
    "session_summary_clean": sql(kept("inj", "k"), numbered("k"), SUMMARY,
                                 select="select * from summary"),
    "session_summary_wide": sql(numbered("ev", 720), SUMMARY, select="select * from summary"),
    "sessions_per_user": sql(numbered("app"), select="""
select user_uuid, max(session_id) as session_count from num group by 1"""),
    "sessions_per_user_rare": sql(numbered(RARE), select="""
select user_uuid, coalesce(max(session_id), 0) as session_count
from (select distinct user_uuid from ev) left join num using (user_uuid) group by 1"""),
    "session_cards": sql(numbered("inj"), SUMMARY, select=f"""
select s.*, c.part, c.events from summary s join (
  select user_uuid, session_id, {part('session_sequence', 2)} as part,
    to_json(list({ITEM} order by sequence))::varchar as events
  from num group by 1, 2, 3) c using (user_uuid, session_id)"""),
    "session_preview": sql(numbered("inj", 720), SUMMARY, select=f"""
select s.*, c.events, greatest(s.event_count - 6, 0) as more_events from summary s join (
  select user_uuid, session_id, to_json(list({ITEM} order by sequence))::varchar as events
  from num where session_sequence <= 6 group by 1, 2) c using (user_uuid, session_id)"""),
    "session_labels": sql(numbered("inj", 720), select="""
select user_uuid, session_id, 'Session ' || session_id
  || strftime(min(event_local), ': %Y-%m-%d (%H:%M - ') || strftime(max(event_local), '%H:%M)')
  as session_label
from num where session_sequence <= 3 group by 1, 2"""),
    "journey_events": sql(numbered("app"), select="""
select user_uuid, sequence, event_name, category, strftime(event_local, '%Y-%m-%d') as date,
  dayname(event_local) as day, strftime(event_local, '%H:%M:%S.%f') as time, session_id,
  session_sequence, event_pos from num"""),
    "journey_path": path("app", 10_000),
    "journey_path_parts": path("app", 20),
    "journey_path_rare": path(RARE_SHOWN, 20) + """
union all select distinct user_uuid, 1, 0, 'No events found for this user.' from ev
where user_uuid not in (select user_uuid from num)""",
    "session_path_rare": path(RARE_SHOWN, 4, per_session=True, gap=720),
    "session_path": path("inj", 4, per_session=True, gap=720),
    "journey_nodes": sql(numbered("app", 720, 3), select=f"""
select user_uuid, session_id, session_sequence, node_sequence, 'N' || node_sequence as node_id,
  event_name, {label('event_name')} as label, session_count
from num where session_sequence <= 3"""),
    "journey_edges": sql(numbered("inj", 720, 3), select="""
select a.user_uuid, a.session_id, 'N' || a.node_sequence as from_node,
  'N' || b.node_sequence as to_node, a.event_name as from_event, b.event_name as to_event
from num a join num b on a.user_uuid = b.user_uuid and a.session_id = b.session_id
  and b.session_sequence = a.session_sequence + 1
where b.session_sequence <= 3"""),
    "transitions": sql(numbered("inj", 720), select="""
select a.user_uuid, a.session_id, a.session_sequence as step, a.event_name as from_event,
  b.event_name as to_event
from num a join num b on a.user_uuid = b.user_uuid and a.session_id = b.session_id
  and b.session_sequence = a.session_sequence + 1"""),
    "transition_counts": sql(numbered("ev"), select="""
select a.event_name as from_event, b.event_name as to_event, count(*) as step_count,
  count(distinct a.user_uuid) as user_count
from num a join num b on a.user_uuid = b.user_uuid and a.session_id = b.session_id
  and b.session_sequence = a.session_sequence + 1
group by 1, 2"""),
    "chart_labels": f"""
with named as (
  select event_id, event_type, event_type || ' & <#' || props || '> [|;' || chr(13) || chr(10) || '] "'
    || repeat(event_type, 3) as name
  from events)
select event_id, {label('name')} as label, {label('event_type')} as short_label
from named""",
    "journey_record": sql(numbered("app"), f"""
listed as (
  select user_uuid, {part('sequence', 20)} as part,
    to_json(list({{'sequence': sequence, 'event_name': event_name, 'category': category,
      'date': strftime(event_local, '%Y-%m-%d'), 'day': dayname(event_local),
      'time': strftime(event_local, '%H:%M:%S.%f')}} order by sequence))::varchar as events
  from num group by 1, 2
),
maps as (
  select user_uuid, '{{' || string_agg(to_json(event_name)::varchar || ':' || n, ','
    order by event_name) || '}}' as event_breakdown
  from (select user_uuid, event_name, count(*) as n from app group by 1, 2) group by 1
),
meta as (
  select user_uuid, count(*) as total_events, count(distinct event_name) as unique_event_types,
    '{{"total_events":' || count(*) || ',"unique_event_types":' || count(distinct event_name)
    || ',"date_range":{{"first_event":"' || strftime(min(event_local), '%Y-%m-%d %H:%M:%S.%f')
    || '","last_event":"' || strftime(max(event_local), '%Y-%m-%d %H:%M:%S.%f')
    || '","span_days":'
    || (datediff('day', min(event_local)::date, max(event_local)::date) + 1)
    || '}},"event_categories":{{"Application":' || count(*) || '}},"event_breakdown":'
    || any_value(event_breakdown) || '}}' as metadata
  from app join maps using (user_uuid) group by 1
)""", select="""
select user_uuid, coalesce(part, 1) as part, coalesce(total_events, 0) as total_events,
  coalesce(unique_event_types, 0) as unique_event_types, coalesce(events, '[]') as events, metadata
from (select distinct user_uuid from ev) left join meta using (user_uuid)
left join listed using (user_uuid)"""),
    "flowchart_text": flowchart("app", 50, 30, 1000),
    "flowchart_rare": flowchart(RARE_SHOWN, 50, 30, 1000),
    "flowchart_parts": flowchart("ev", 3, 720, 10),
    "ai_payload": sql(numbered("app"), repetition("ev"), payload(10_000, "app", "ev"),
                      select="select * from pay"),
    "ai_payload_parts": sql(
        kept("inj", "k"), "k_app as (select * from k where lower(category) = 'application')",
        numbered("k_app"),
        repetition("(select * from inj where lower(category) = 'application')"),
        payload(20, "k_app", "k"), select="select * from pay"),
    "prompt_table": sql(numbered("app"), repetition("ev"), payload(10_000, "app", "ev"), select="""
select user_uuid, part, 'Group the events of this user into sessions and answer in JSON.'
  || chr(10) || chr(10) || 'USER EVENT DATA:' || chr(10) || payload_json as prompt from pay"""),
    "ai_reply_parse": sql(*REPLIES, select="""
select user_uuid, part, p.is_structured, case when not p.is_object then 'Not a JSON object'
    when not p.is_structured then 'Missing interpreted_sessions field' end as parse_error,
  shape_error, session_count,
  case when p.is_structured then json_extract_string(p.body, '$.overall_narrative') end as overall_narrative
from parsed p left join shaped using (user_uuid, part)"""),
    "ai_reply_sessions": sql(*REPLIES, select="""
select user_uuid, part, session_number, session_name, date, start_time, end_time, interpretation,
  to_json(event_list)::varchar as events, len(event_list) as event_count,
  to_json(event_list[1:4])::varchar as preview, greatest(len(event_list) - 4, 0) as more_events
from rows_out"""),
    "ai_reply_notes": sql(*REPLIES, select="""
select user_uuid, part, coalesce(json_extract_string(body, '$.overall_narrative'), '')
    as overall_narrative,
  case when has_notes then json_extract(body, '$.key_observations')::varchar else '[]' end as key_observations
from counted"""),
    "ai_reply_audit": sql(*REPLIES, select="""
select user_uuid, part, coalesce(session_count, 0) as session_count,
  coalesce(empty_sessions, 0) as empty_sessions, coalesce(unknown_events, 0) as unknown_events,
  observation_count,
  coalesce(empty_sessions, 0) = 0 and coalesce(unknown_events, 0) = 0 and coalesce(session_count, 0) <= 10
    and observation_count <= 3 and shape_error is null as passes
from shaped left join (
  select user_uuid, part, count(*) filter (where len(event_list) = 0) as empty_sessions,
    (select count(distinct e) from (select unnest(flatten(list(r.event_list))) as e)
      where e = 'teleport') as unknown_events
  from rows_out r group by 1, 2) using (user_uuid, part)"""),
}

# Times made as texts: the wall clock, cut to milliseconds where the position is even, less the offset.
TIMES = """
timed as (
  select *, case when event_pos % 2 = 0 then date_trunc('millisecond', event_local) else event_local end as shown,
    [0, 0, 330, -480][event_pos % 4 + 1] as minutes, ['+0000', 'Z', '+05:30', '-0800'][event_pos % 4 + 1] as given,
    ['+00:00', '+00:00', '+05:30', '-08:00'][event_pos % 4 + 1] as offset_text
  from ev
)"""

SQL |= {
    "parse_raw_times": sql(TIMES, select="""
select user_uuid, event_name, category, event_pos,
  case when event_pos % 7 <> 0 then strftime(shown, '%Y-%m-%d %H:%M:%S.%f') end as event_local,
  case when event_pos % 7 <> 0 then epoch_us(shown) - minutes::bigint * 60000000 end as instant_us,
  case when event_pos % 7 <> 0 then offset_text end as offset_text,
  case when event_pos % 7 = 0 then replace(
    left(strftime(shown, '%Y-%m-%d %H:%M:%S.%f'), case when event_pos % 2 = 0 then 23 else 26 end)
      || ' ' || given, '-', '/') end as rejected_text
from timed"""),
    "parse_iso_times": sql(TIMES, select="""
select user_uuid, event_name, category, event_pos, strftime(shown, '%Y-%m-%d %H:%M:%S.%f') as event_local,
  epoch_us(shown) - case when event_pos % 5 = 0 then 0 else minutes::bigint * 60000000 end as instant_us,
  case when event_pos % 5 = 0 then '+00:00' else offset_text end as offset_text
from timed"""),
}

DAY_METRICS = """count(distinct user_uuid) as total_users,
  count(distinct coalesce('=' || user_uuid, '')) as total_unique_users, count(*) as total_events from ev"""

SQL |= {
    "monthly_users": sql(select=f"select strftime(event_local, '%Y-%m') as month, {DAY_METRICS} group by 1"),
    "february_users": sql(select=f"select {DAY_METRICS} where event_local::date between '2024-01-20' and '2024-02-17'"),
}

# Logs merged one by one give what one log gives.
SQL |= {"incremental_clean": SQL["dedup_clean"], "incremental_repetition": SQL["daily_repetition_all"]}

# A stream run to its end gives what the batch operator gives.
SQL |= {"stream_bursts": SQL["dedup_clean"], "stream_sessions": SQL["session_summary"]}
