"""Adapter views: the engine's own tables, derived from the given ones.

The text is plain SQL that Spark and DuckDB read alike.  ``{ms:x}`` stands for
the milliseconds of a time, which the two spell differently.  Edge rows are
built in: blank users, two projects, shared devices, repeated keys, bots in
four spellings, missing paths, malformed items.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("events", "pages")


def _uuid(digest: str) -> str:
    parts = ", ".join(f"substring({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat_ws('-', {parts})"


DEV_SEED, SES_SEED = "concat('dev-', cast(user_id % 97 as string))", "concat('ses-', cast(user_id as string), '-', cast(cast(ts as date) as string))"
# Written out where a query may skip the ids or take few of them ...
LAZY_DEV, LAZY_SES = _uuid(f"md5({DEV_SEED})"), _uuid(f"md5({SES_SEED})")
# ... and columns of an inner select where all are needed, to hash once per row.
HASHED = f"""(select *, md5({DEV_SEED}) as dev_md5, md5({SES_SEED}) as ses_md5,
        md5(concat('usr-', cast(user_id as string))) as usr_md5 from events)"""
DEV, SES, PERSON = _uuid("dev_md5"), _uuid("ses_md5"), _uuid("usr_md5")
PROJ = "case when user_id % 10 = 0 then 'beta' else 'demo' end"
NONE = "cast(null as string)"

#: View name -> (views it reads, text).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_events": (
        ("events",),
        f"""select concat('evt_', cast(event_id as string)) as event_id, {LAZY_DEV} as device_id,
        case when event_id % 17 = 0 then '' else concat('u', cast(user_id as string)) end as user_id,
        {LAZY_SES} as session_id, event_type, {{ms:ts}} as event_timestamp, ts as created_at, props as properties, {PROJ} as project_id,
        concat('key-', cast(case when event_id % 25 = 0 and event_id > 0 then event_id - 1 else event_id end as string)) as idempotency_key
        from events""",
    ),
    # Events go round all pages; an event whose page id is missing keeps null urls.
    "v_traffic": (
        ("events", "pages"),
        f"""select concat('tm_', cast(e.event_id as string)) as metric_id, {LAZY_DEV} as device_id,
        concat('u', cast(user_id as string)) as user_id, {LAZY_SES} as session_id,
        case e.event_type when 'view' then 'PageView' when 'click' then 'page-view' else e.event_type end as raw_metric_type,
        case when e.event_type in ('view', 'click') then 'page_view' else e.event_type end as metric_type,
        case when e.event_id % 13 = 0 then null else regexp_extract(p.url, '^https?://[^/]+([^?#]*)', 1) end as page_path,
        case when e.event_id % 3 = 0 then null else regexp_extract(p.url, '^(https?://[^/]+)', 1) end as referrer,
        {{ms:e.ts}} as metric_timestamp,
        case when e.event_id % 11 = 0 then '{{"isBot":true}}' when e.event_id % 11 = 1 then '{{"isBot":false}}'
             when e.event_id % 11 = 2 then null else '{{"utm_source":"feed"}}' end as metadata,
        {PROJ} as project_id, e.ts as created_at
        from (select h.*, h.event_id % (select count(*) from pages) as page_no from events h) e left join (select page_id, url from pages) p on p.page_id = e.page_no""",
    ),
    "v_session_uploads": (
        ("events",),
        f"""select {SES} as session_id, {DEV} as device_id, concat('u', cast(user_id as string)) as user_id,
        min(ts) over w as session_start_time,
        {{ms:ts}} - {{ms:min(ts) over w}} as session_duration_ms,
        cast(row_number() over w as int) as event_count,
        cast(sum(case when event_type = 'view' then 1 else 0 end) over w as int) as screen_count,
        concat('model ', cast(event_id % 5 as string)) as device_model, concat('os ', cast(event_id % 4 as string)) as os_version,
        concat('1.', cast(event_id % 3 as string)) as app_version, cast(event_id as string) as build_number,
        event_id as seq, {PROJ} as project_id, ts as created_at from {HASHED} h
        window w as (partition by user_id, cast(ts as date) order by ts, event_id rows between unbounded preceding and current row)""",
    ),
    "v_sessions": (
        ("events",),
        f"""select session_id, device_id, user_id, min(ts) as session_start_time, {{ms:max(ts)}} - {{ms:min(ts)}} as session_duration_ms,
        {NONE} as device_model, {NONE} as os_version, {NONE} as app_version, {NONE} as build_number,
        cast(sum(case when event_type = 'view' then 1 else 0 end) as int) as screen_count, cast(count(*) as int) as event_count,
        project_id, min(ts) as created_at
        from (select {SES} as session_id, {DEV} as device_id, concat('u', cast(user_id as string)) as user_id, {PROJ} as project_id, ts, event_type from {HASHED} h) s
        group by session_id, device_id, user_id, project_id""",
    ),
    "v_device_registrations": (
        ("events",),
        f"""select {PROJ} as project_id, {DEV} as device_id, concat('model ', cast(event_id % 5 as string)) as device_model,
        concat('os ', cast(event_id % 4 as string)) as os_version, '1.0' as app_version,
        concat('ak_', substring(md5(cast(event_id as string)), 1, 16)) as api_key,
        concat('sk_', substring(md5(cast(-event_id as string)), 1, 16)) as secret_key,
        event_id as seq, ts as received_at from {HASHED} h where event_type = 'signup'""",
    ),
    "v_devices": (
        ("v_device_registrations",),
        f"""select project_id, device_id, concat('ak_', substring(md5(device_id), 1, 16)) as api_key,
        {NONE} as device_model, max(os_version) as os_version, max(app_version) as app_version,
        case when substring(device_id, 1, 1) = '0' then true else false end as is_banned, {NONE} as ban_reason,
        min(received_at) as created_at, max(received_at) as last_active_at
        from v_device_registrations group by project_id, device_id""",
    ),
    # The registry of projects; the last two have no tables.
    "v_projects": (
        ("events",),
        f"""select project_id, case when project_id = 'demo' then true else false end as is_active from (select distinct {PROJ} as project_id from events) p
        union all select 'idle', true from (select distinct {PROJ} as project_id from events) p where project_id = 'demo'
        union all select 'draft', cast(null as boolean) from (select distinct {PROJ} as project_id from events) p where project_id = 'demo'""",
    ),
    "v_project_reads": (
        ("events",),
        """select event_id, case user_id % 8 when 0 then 'demo' when 1 then ' demo ' when 2 then 'beta' when 3 then 'idle' when 4 then 'draft'
        when 5 then concat('none-', cast(user_id % 3 as string)) when 6 then 'Not An Id!' else case when event_id % 2 = 0 then '  ' else null end end as project_id from events""",
    ),
    # Devices over time: registered, banned, let in again, given a new key.
    "v_device_history": (
        ("v_devices",),
        """select project_id, device_id, api_key, false as is_banned, created_at as valid_from from v_devices
        union all select project_id, device_id, api_key, true, timestamp '2024-01-09 06:00:00' from v_devices where substring(device_id, 1, 1) in ('0', '1', '2', '3', '4')
        union all select project_id, device_id, api_key, false, timestamp '2024-01-17 18:30:00' from v_devices where substring(device_id, 1, 1) in ('1', '2', '3')
        union all select project_id, device_id, 'ak_renewed', false, timestamp '2024-01-24 00:00:00' from v_devices where substring(device_id, 1, 1) in ('3', '5')""",
    ),
    "v_event_items": (
        ("events",),
        f"""select concat('b', cast(cast(floor(event_id / 100.0) as bigint) as string)) as batch_id, cast(event_id % 100 as int) as item_no,
        {PROJ} as project_id, concat('ak_', substring(md5({DEV}), 1, 16)) as api_key, {DEV} as device_id,
        case when event_id % 43 = 0 then 'nobody' else {PERSON} end as user_id,
        {{ms:ts}} + case when event_id % 37 = 0 then 400000 when event_id % 37 = 1 then -300000 else 250 end as request_ms, ts as received_at,
        case when event_id % 29 = 0 then '  ' when event_id % 29 = 1 then null else event_type end as event_type,
        case when event_id % 31 = 0 then null else {{ms:ts}} end as "timestamp",
        case when event_id % 41 = 0 then 'not-a-uuid' when event_id % 41 = 1 then null else {SES} end as session_id,
        props as properties,
        case when event_id % 19 = 0 then '' when event_id % 19 = 1 then null
             else concat('key-', cast(case when event_id % 25 = 0 and event_id > 0 then event_id - 1 else event_id end as string)) end as idempotency_key
        from {HASHED} h""",
    ),
    "v_known_keys": (
        ("events",),
        f"""select {PROJ} as project_id, {{sha:concat('key-', cast(event_id as string))}} as key_hash
        from events where event_type = 'error'""",
    ),
    "v_traffic_items": (
        ("events", "pages"),
        f"""select concat('b', cast(cast(floor(e.event_id / 100.0) as bigint) as string)) as batch_id, cast(e.event_id % 100 as int) as item_no,
        case when e.event_id % 5 = 0 then null else {PROJ} end as header_project_id, concat(' ', {PROJ}) as query_project_id, {PROJ} as project_id,
        case when e.event_id % 6 = 0 then ' u1 ' else '' end as header_user_id, case when e.event_id % 9 = 0 then 'u2' else null end as query_user_id,
        case when e.event_id % 4 = 0 then 'junk' else {DEV} end as visitor_cookie, {DEV} as device_id, concat('u', cast(user_id as string)) as user_id,
        case when e.event_id % 8 = 0 then concat(' ', p.url, ' ') when e.event_id % 8 = 1 then '  ' else null end as referer_header,
        concat('203.0.113.', cast(user_id % 250 as string)) as remote_addr,
        case when e.event_id % 7 = 0 then concat('198.51.100.', cast(user_id % 250 as string), ' , 10.0.0.1') when e.event_id % 7 = 1 then ' ' else null end as forwarded_for,
        case when e.event_id % 11 = 0 then 'Mozilla/5.0 (compatible; ExampleBot/2.1)' when e.event_id % 11 = 1 then 'Some Spider'
             when e.event_id % 11 = 2 then null else 'Mozilla/5.0 (X11; Linux x86_64)' end as user_agent,
        e.ts as received_at,
        case e.event_type when 'view' then ' PageView ' when 'click' then 'page-view' when 'error' then 'JSError URL' when 'signup' then '--' else e.event_type end as metric_type,
        case when e.event_id % 13 = 0 then '  ' else concat(' ', regexp_extract(p.url, '^https?://[^/]+([^?#]*)', 1)) end as page_path,
        case when e.event_id % 3 = 0 then null else concat(regexp_extract(p.url, '^(https?://[^/]+)', 1), case when e.event_id % 3 = 1 then ' ' else '' end) end as referrer,
        case when e.event_id % 21 = 0 then -1 when e.event_id % 21 = 1 then null else {{ms:e.ts}} end as "timestamp",
        cast(null as string) as session_id,
        case when e.event_id % 10 = 0 then '[1,2]' when e.event_id % 10 = 1 then null when e.event_id % 10 = 2 then 'null'
             when e.event_id % 10 = 3 then '{{"utm_source":"feed","userAgent":"old","n":{{"a":1}}}}' when e.event_id % 10 = 4 then ' {{ }} '
             else '{{"utm_source":"feed","n":{{"a":1}}}}' end as metadata
        from (select h.*, h.event_id % (select count(*) from pages) as page_no from {HASHED} h) e left join (select page_id, url from pages) p on p.page_id = e.page_no""",
    ),
    "v_access_log": (
        ("events",),
        """select event_id as line_no, ts as logged_at,
        case event_id % 6 when 0 then concat('203.0.113.', cast(user_id as string)) when 1 then concat('2001:db8:85a3::', cast(user_id as string)) when 2 then '::1'
             when 3 then '' when 4 then 'not-an-ip' else '192.0.2.7' end as remote_addr,
        case when event_id % 5 = 0 then concat(' 198.51.100.', cast(user_id % 250 as string), ', 10.0.0.1') when event_id % 5 = 1 then ' ' else null end as forwarded_for
        from events""",
    ),
    "v_privacy_submissions": (
        ("events",),
        f"""select concat('prv_', cast(event_id as string)) as request_id, {PROJ} as project_id, concat('u', cast(user_id % 5 as string)) as user_id,
        {_uuid("md5(concat('dev-', cast(user_id % 5 as string)))")} as device_id,
        case when event_id % 2 = 0 then 'EXPORT' else 'DELETE' end as request_type,
        case when event_id % 3 = 0 then 'POSTHOG' else 'FIRST_PARTY' end as processor,
        concat('u', cast(user_id % 5 as string), '@example.org') as contact_email, event_id, ts as requested_at
        from events where event_type in ('error', 'click')""",
    ),
    # Status changes while a request may still be reused.
    "v_privacy_changes": (
        ("v_privacy_submissions",),
        """select project_id, user_id, device_id, request_type, processor, contact_email, request_id, 'IN_PROGRESS' as status,
        requested_at + interval 120 second as changed_at from v_privacy_submissions where event_id % 3 = 0
        union all select project_id, user_id, device_id, request_type, processor, contact_email, request_id, 'CANCELLED',
        requested_at + interval 30 second from v_privacy_submissions where event_id % 6 = 0
        union all select project_id, user_id, device_id, request_type, processor, contact_email, request_id, 'SUBMITTED',
        requested_at from v_privacy_submissions where event_id % 2 = 0""",
    ),
    "v_privacy_items": (
        ("events",),
        f"""select {PROJ} as project_id, {{us:ts}} as received_us, ts as received_at,
        case when event_id % 23 = 0 then ' ' else concat('u', cast(user_id as string)) end as user_id, {DEV} as device_id,
        case event_id % 4 when 0 then 'EXPORT' when 1 then ' delete ' when 2 then 'Export' else case when event_id % 31 = 0 then 'erase' else 'DELETE' end end as request_type,
        case when event_id % 3 = 0 then 'posthog' when event_id % 47 = 0 then 'elsewhere' else 'FIRST_PARTY' end as processor,
        case event_id % 5 when 0 then null when 1 then ' web-form ' when 2 then 'bad source!' else 'APP' end as source,
        case when event_id % 29 = 0 then null else concat(' u', cast(user_id as string), '@example.org ') end as contact_email,
        case when event_id % 2 = 0 then ' please ' when event_id % 7 = 0 then ' ' else null end as requester_note,
        cast(null as string) as metadata
        from {HASHED} h""",
    ),
    "v_privacy_status_log": (
        ("v_privacy_submissions",),
        """select request_id, 'SUBMITTED' as status, requested_at as changed_at, 0 as seq, cast(null as string) as operator from v_privacy_submissions
        union all select request_id, 'IN_PROGRESS', requested_at + interval 1 hour, 1, 'ann' from v_privacy_submissions where event_id % 2 = 0
        union all select request_id, 'COMPLETED', requested_at + interval 24 hour, 2, ' ' from v_privacy_submissions where event_id % 4 = 0
        union all select request_id, 'IN_PROGRESS', requested_at + interval 48 hour, 3, 'bob' from v_privacy_submissions where event_id % 8 = 0""",
    ),
    "v_auth_attempts": (
        ("events",),
        """select concat('203.0.113.', cast(user_id % 20 as string)) as ip, case when event_type = 'signup' then true else false end as success,
        timestamp '2024-01-01 00:00:00' + cast(event_id as int) * interval 5 second as attempted_at, event_id as seq from events""",
    ),
    # One rule per event type and project, with and without conditions.
    "v_counters": (
        ("events",),
        f"""select project_id, concat(event_type, 's') as counter_key, concat('{{"event_type":"', event_type, '"}}') as event_trigger
        from (select distinct {PROJ} as project_id, event_type from events) a
        union all
        select project_id, concat('k', k, '_', event_type) as counter_key,
        concat('{{"event_type":"', event_type, '","conditions":{{"k":"', k, '"}}}}') as event_trigger
        from (select distinct {PROJ} as project_id, event_type, {{json:props:k}} as k from events) b where k in ('7', '11', '42')""",
    ),
    # A change log: per project and type one counter, set, bumped and deleted along the events.
    "v_counter_changes": (
        ("events",),
        f"""select {PROJ} as project_id, concat(event_type, '_', cast(user_id % 7 as string)) as counter_key, event_id as seq, ts as changed_at,
        case when event_id % 101 = 0 then 'delete' when event_id % 23 = 0 then 'set' else 'inc' end as op,
        case when event_id % 46 = 0 then null when event_id % 23 = 0 then cast(user_id as bigint) when event_id % 5 = 0 then null else cast(event_id % 4 as bigint) end as amount,
        case when event_id % 23 = 0 and event_id % 3 <> 0 then concat('{{"zh":"n', cast(event_id as string), '","en":"e', cast(event_id as string), '"}}')
             when event_id % 69 = 0 then '{{"fr":"seul"}}' else null end as display_name,
        case when event_id % 23 = 0 then '"times"' else null end as unit,
        case when event_id % 46 = 23 then true when event_id % 92 = 0 then false else null end as is_public
        from events""",
    ),
}

_SPARK = {"us": "unix_micros(cast({0} as timestamp))", "ms": "unix_millis(cast({0} as timestamp))", "sha": "sha2({0}, 256)", "json": "get_json_object({0}, '$.{1}')"}
_DUCKDB = {"us": "epoch_us({0})", "ms": "(epoch_us({0}) // 1000)", "sha": "sha256({0})", "json": "json_extract_string({0}, '$.{1}')"}


def _spell(text: str, macros: dict[str, str], quote: str) -> str:
    def one(match: re.Match) -> str:
        return macros[match[1]].format(*match[2].split(":") if match[1] == "json" else [match[2]])

    # A macro argument may hold one level of parentheses, never braces.
    text = re.sub(r"\{(ms|us|sha|json):([^{}]*)\}", one, text)
    return text.replace('"timestamp"', f"{quote}timestamp{quote}")


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        if name in SOURCES:
            continue
        for dep in _needed(VIEWS[name][0]) + [name]:
            if dep not in out:
                out.append(dep)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over the Parquet tables of a folder."""
    return view_over(spark, sf_dir, name, None)


def view_over(spark: SparkSession, sf_dir: str, name: str, events: str | None) -> DataFrame:
    """The view with another relation, such as a stream, in place of the events."""
    views = _needed((name,))
    tables = sorted({t for v in views for t in VIEWS[v][0] if t in SOURCES})
    ctes = []
    for t in tables:
        origin = events if t == "events" and events else f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`"
        ctes.append(f"{t} as (select * from {origin})")
    ctes += [f"{v} as ({_spell(VIEWS[v][1], _SPARK, '`')})" for v in views]
    return spark.sql(f"with {', '.join(ctes)} select * from {name}")


def duckdb_with(*names: str) -> str:
    """The same views as a WITH list for the check SQL."""
    return "with recursive " + ",\n".join(f"{v} as ({_spell(VIEWS[v][1], _DUCKDB, chr(34))})" for v in _needed(names))
