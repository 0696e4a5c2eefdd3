"""Check SQL for the registered queries, for a separate SQL engine.

Written from the meaning of each query, in other forms than the Spark jobs use
where there is a choice: windows over whole actors, interval joins, recursion.
"""

from __future__ import annotations

from footfall.plans.fixtures import _uuid, duckdb_with

LO, HI = "timestamp '2024-01-01 00:00:00'", "timestamp '2024-02-01 00:00:00'"
IN_RANGE = f"project_id = 'demo' and created_at >= {LO} and created_at < {HI}"
NOT_BOT = "coalesce(json_extract_string(metadata, '$.isBot'), '') <> 'true'"
ACTOR = "case when trim(coalesce(user_id, '')) = '' then device_id else user_id end"
RATE = "floor(({0}) * 10000 + 0.5) / 10000.0"


def _sql(views: list[str], ctes: dict[str, str], final: str) -> str:
    head = duckdb_with(*views)
    return head + "".join(f",\n{name} as ({text})" for name, text in ctes.items()) + f"\n{final}"


def _funnel(steps: list[str], group: str) -> str:
    ctes = {"t0": f"select *, {ACTOR} as actor from v_events where {IN_RANGE} and event_type in ({', '.join(repr(s) for s in steps)})"}
    ctes["r0"] = f"select *, min(case when event_type = '{steps[0]}' then created_at end) over (partition by actor) as a0 from t0"
    for i, s in enumerate(steps[1:], 1):
        ctes[f"r{i}"] = (
            f"select *, min(case when event_type = '{s}' and created_at >= a{i - 1} then created_at end) over (partition by actor) as a{i} from r{i - 1}"
        )
    last = len(steps) - 1
    ctes["who"] = (
        f"select actor, min(case when event_type = '{steps[0]}' and created_at = a0 then {group} end) as group_value, "
        + ", ".join(f"max(a{i}) as a{i}" for i in range(last + 1))
        + f" from r{last} where a0 is not null group by actor"
    )
    ctes["u"] = "select group_value, " + ", ".join(f"count(a{i}) as u{i}" for i in range(last + 1)) + " from who group by group_value"
    rows = [
        f"select group_value, {i + 1} as step, '{s}' as event_type, u{i} as users, {RATE.format(f'u{i} / u0')} as conversion_rate, "
        + (f"case when u{i - 1} = 0 then 0.0 else {RATE.format(f'1 - u{i} / u{i - 1}')} end" if i else "0.0")
        + " as drop_off_rate from u"
        for i, s in enumerate(steps)
    ]
    return _sql(["v_events"], ctes, " union all ".join(rows))


def _retention() -> str:
    days = [0, 1, 2, 3, 7, 14]
    return _sql(
        ["v_events"],
        {
            "ev": f"select {ACTOR} as actor, event_type, created_at from v_events where project_id = 'demo'",
            "cohort": f"select actor, min(created_at) as t0 from ev where event_type = 'signup' and created_at >= {LO} and created_at < timestamp '2024-01-16 00:00:00' group by actor",
            "d": "select unnest([" + ", ".join(map(str, days)) + "]) as day",
            "hit": f"""select distinct c.actor, d.day from cohort c join ev on ev.actor = c.actor and ev.event_type = 'purchase'
                and ev.created_at >= {LO} and ev.created_at < timestamp '2024-01-31 00:00:00'
                join d on ev.created_at >= c.t0 + d.day * interval 24 hour and ev.created_at < c.t0 + (d.day + 1) * interval 24 hour""",
            "n": "select count(*) as cohort_users from cohort",
        },
        f"""select n.cohort_users, d.day, count(hit.actor) as retained_users, {RATE.format('count(hit.actor) / n.cohort_users')} as retention_rate
        from d cross join n left join hit on hit.day = d.day group by n.cohort_users, d.day""",
    )


def _overview() -> str:
    return _sql(
        ["v_devices", "v_sessions", "v_events"],
        {
            "d": f"select count(*) as a, count(*) filter (where last_active_at >= {LO} and last_active_at < {HI}) as b from v_devices where project_id = 'demo'",
            "s": f"select count(*) as a, coalesce(avg(session_duration_ms), 0) as b from v_sessions where project_id = 'demo' and session_start_time >= {LO} and session_start_time < {HI}",
            "e": f"select count(*) as a, count(distinct user_id) as b from v_events where {IN_RANGE}",
        },
        """select d.a as devices_total, d.b as devices_active, e.b as users_active, s.a as sessions_total, e.a as events_total,
        cast(floor(s.b + 0.5) as bigint) as avg_session_duration_ms, case when s.a = 0 then 0.0 else e.a / s.a end as avg_events_per_session
        from d, s, e""",
    )


def _spine(size: str) -> str:
    return f"select unnest(generate_series(date_trunc('{size}', {LO}), {HI} - interval 1 microsecond, interval 1 {size})) as bucket"


def _metric_trend(size: str) -> str:
    return _sql(
        ["v_sessions", "v_events"],
        {
            "spine": _spine(size),
            "e": f"select date_trunc('{size}', created_at) as bucket, count(*) as n from v_events where {IN_RANGE} group by 1",
            "s": f"select date_trunc('{size}', session_start_time) as bucket, count(*) as n from v_sessions where project_id = 'demo' and session_start_time >= {LO} and session_start_time < {HI} group by 1",
        },
        """select cast(spine.bucket as timestamp) as bucket, coalesce(e.n, 0) as events, coalesce(s.n, 0) as sessions from spine
        left join e on cast(e.bucket as timestamp) = cast(spine.bucket as timestamp) left join s on cast(s.bucket as timestamp) = cast(spine.bucket as timestamp)""",
    )


def _traffic_trend(size: str) -> str:
    return _sql(
        ["v_traffic"],
        {
            "spine": _spine(size),
            "m": f"""select date_trunc('{size}', created_at) as bucket, count(*) filter (where metric_type = 'page_view') as pv,
                count(distinct device_id) as uv from v_traffic where {IN_RANGE} and {NOT_BOT} group by 1""",
        },
        """select cast(spine.bucket as timestamp) as bucket, coalesce(m.pv, 0) as page_views, coalesce(m.uv, 0) as visitors
        from spine left join m on cast(m.bucket as timestamp) = cast(spine.bucket as timestamp)""",
    )


def _top_traffic(column: str, limit: int) -> str:
    return _sql(
        ["v_traffic"], {},
        f"""select {column} as item_key, count(*) as total from v_traffic where {IN_RANGE} and {NOT_BOT} and metric_type = 'page_view'
        and {column} is not null group by 1 order by total desc, item_key limit {limit}""",
    )


def _listed(views: list[str], ctes: dict[str, str], source: str, columns: str, where: str, time: str, key: str, size: int, offset: int) -> str:
    return _sql(
        views,
        {**ctes, "kept": f"select * from {source} where project_id = 'demo' and {time} >= {LO} and {time} < {HI} and {where}"},
        f"select {columns}, (select count(*) from kept) as total from kept order by {time} desc, {key} limit {size} offset {offset}",
    )


# --- ingest ------------------------------------------------------------------

UUID_RE = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"
EVENT_REASON = f"""case when trim(coalesce(event_type, '')) = '' then 'missing_event_type' when "timestamp" is null then 'invalid_timestamp'
    when session_id is not null and not regexp_matches(session_id, {UUID_RE}) then 'invalid_session_id' end"""


def _text(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(cast({c} as varchar), '')" for c in columns) + ")"


EVENT_CTES = {
    "checked": f"select *, {EVENT_REASON} as reason from v_event_items",
    "good": f"""select *, case when trim(coalesce(idempotency_key, '')) <> '' then sha256(idempotency_key) end as key_hash,
        concat('evt_', cast(epoch_us(received_at) // 1000 as varchar), '_', substring(sha256({_text('project_id', 'device_id', 'batch_id', 'item_no', 'event_type', '"timestamp"', 'idempotency_key')}), 1, 8)) as event_id
        from checked where reason is null""",
    "ranked": """select *, row_number() over (partition by project_id, key_hash order by received_at, batch_id, item_no) as nth from good""",
    "firsts": "select * from ranked where key_hash is null or nth = 1",
}
NEW_EVENTS = {
    **EVENT_CTES,
    "fresh": "select * from firsts f where not exists (select 1 from v_known_keys k where k.project_id = f.project_id and k.key_hash = f.key_hash)",
}


def _ingest_events() -> str:
    return _sql(
        ["v_event_items", "v_known_keys"], NEW_EVENTS,
        """select event_id, device_id, user_id, session_id, event_type, "timestamp" as event_timestamp, properties, project_id,
        received_at as created_at from fresh""",
    )


def _event_batches() -> str:
    return _sql(
        ["v_event_items", "v_known_keys"],
        {
            **NEW_EVENTS,
            "r": "select batch_id, count(*) as received from v_event_items group by 1",
            "a": "select batch_id, count(*) as accepted from fresh group by 1",
        },
        """select r.batch_id, r.received, coalesce(a.accepted, 0) as accepted, r.received - coalesce(a.accepted, 0) as rejected,
        coalesce(a.accepted, 0) = 0 as failed from r left join a on a.batch_id = r.batch_id""",
    )


def _gate() -> str:
    person = f"regexp_matches(user_id, {UUID_RE})"
    return _sql(
        ["v_event_items", "v_devices"], {},
        f"""select i.batch_id, i.item_no, case when not {person} then 'invalid_user_id'
        when abs(epoch_us(i.received_at) // 1000 - i.request_ms) > 300000 then 'timestamp_expired'
        when d.device_id is null then 'invalid_credentials' when d.is_banned then 'device_banned' end as reason
        from v_event_items i left join v_devices d on d.project_id = i.project_id and d.device_id = i.device_id and d.api_key = i.api_key""",
    )


def _gate_as_of() -> str:
    person = f"regexp_matches(user_id, {UUID_RE})"
    return _sql(
        ["v_event_items", "v_device_history"],
        {
            "last": """select i.batch_id, i.item_no, max(h.valid_from) as at from v_event_items i join v_device_history h
                on h.project_id = i.project_id and h.device_id = i.device_id and h.valid_from <= i.received_at group by 1, 2""",
            "known": """select l.batch_id, l.item_no, h.api_key, h.is_banned from last l join v_event_items i using (batch_id, item_no)
                join v_device_history h on h.project_id = i.project_id and h.device_id = i.device_id and h.valid_from = l.at""",
        },
        f"""select i.batch_id, i.item_no, case when not {person} then 'invalid_user_id'
        when abs(epoch_us(i.received_at) // 1000 - i.request_ms) > 300000 then 'timestamp_expired'
        when k.api_key is null or k.api_key <> i.api_key then 'invalid_credentials' when k.is_banned then 'device_banned' end as reason
        from v_event_items i left join known k using (batch_id, item_no)""",
    )


LETTERS = r"([\p{Lu}\p{Ll}])(\p{Lu})"


def _metric_type(column: str) -> str:
    # Without look-behind, overlapping pairs need a second pass.
    once = f"regexp_replace(trim({column}), '{LETTERS}', '\\1_\\2', 'g')"
    twice = f"regexp_replace({once}, '{LETTERS}', '\\1_\\2', 'g')"
    bare = f"trim(lower(regexp_replace({twice}, '[-_ ]+', '_', 'g')), '_')"
    return f"case when {bare} = 'pageview' then 'page_view' else {bare} end"


IP = "case when trim(coalesce(forwarded_for, '')) = '' then remote_addr else trim(split_part(forwarded_for, ',', 1)) end"


def _none_if_blank(column: str) -> str:
    return f"case when trim(coalesce({column}, '')) <> '' then {column} end"


def _traffic_rows(source: str) -> str:
    """Stored form of prepared items, with the metadata read member by member."""
    return f"""select concat('tm_', cast(epoch_us(received_at) // 1000 as varchar), '_',
        substring(sha256({_text('project_id', 'device_id', 'batch_id', 'item_no', 'mt', 'path')}), 1, 8)) as metric_id,
        batch_id, item_no, device_id, user_id, mt as metric_type, path as page_path, ref as referrer,
        case when "timestamp" > 0 then "timestamp" else epoch_us(received_at) // 1000 end as metric_timestamp, project_id, received_at as created_at,
        case when mt = '' then 'missing_metric_type' end as reason,
        sha256(concat('pepper|', ip)) as ip_hash, coalesce(user_agent, json_extract_string(obj, '$.userAgent')) as agent,
        json_extract_string(obj, '$.utm_source') as utm, bot_text as bot, resolved_text as resolved, data, json_extract_string(obj, '$.n') as n
        from {source}"""


def _signed_traffic() -> str:
    return _sql(
        ["v_traffic_items"],
        {
            "prepared": f"""select *, {_metric_type('metric_type')} as mt, nullif(trim(page_path), '') as path, nullif(trim(referrer), '') as ref,
                {IP} as ip, case when trim(metadata) like '{{%' then metadata end as obj, cast(null as varchar) as bot_text,
                cast(null as varchar) as resolved_text, case when metadata like '[%' then metadata end as data from v_traffic_items"""
        },
        _traffic_rows("prepared"),
    )


def _public_traffic() -> str:
    names = "batch_id, item_no, user_agent, received_at, \"timestamp\", metadata"
    return _sql(
        ["v_traffic_items"],
        {
            "named": f"""select {names}, visitor_cookie, page_path, referrer, metric_type, {IP} as ip,
                replace(coalesce({_none_if_blank('header_project_id')}, query_project_id), ' ', '') as project_id,
                trim(coalesce({_none_if_blank('header_user_id')}, {_none_if_blank('query_user_id')})) as given,
                coalesce(regexp_matches(lower(user_agent), 'bot|spider|crawler'), false) as is_bot,
                trim(coalesce({_none_if_blank('referrer')}, {_none_if_blank('referer_header')})) as res from v_traffic_items""",
            "seen": f"""select *, case when regexp_matches(visitor_cookie, {UUID_RE}) then visitor_cookie
                else {_uuid('md5(' + _text('batch_id', 'epoch_us(received_at)', 'ip', 'user_agent') + ')')} end as device_id,
                is_bot or (res is not null and res is distinct from referrer) as noted from named""",
            "prepared": f"""select *, coalesce(given, substring(sha256(device_id), 1, 32)) as user_id,
                {_metric_type('metric_type')} as mt, nullif(trim(page_path), '') as path,
                case when noted then coalesce(res, nullif(trim(referrer), '')) else nullif(trim(referrer), '') end as ref,
                case when trim(metadata) like '{{%' then metadata end as obj,
                case when is_bot then 'true' end as bot_text, case when noted then res end as resolved_text,
                case when metadata like '[%' and not noted then metadata end as data from seen""",
        },
        _traffic_rows("prepared"),
    )


def _mask() -> str:
    return _sql(
        ["v_access_log"],
        {"a": f"select line_no, logged_at, {IP} as ip from v_access_log"},
        r"""select line_no, logged_at, case when trim(coalesce(ip, '')) = '' then '-'
        when ip like '%:%' then case when regexp_matches(ip, '^:*[^:]+:+[^:]+') then regexp_replace(ip, '^:*([^:]+):+([^:]+).*$', '\1:\2:***') else '***' end
        when regexp_matches(ip, '^[^.]*[.][^.]*[.][^.]*[.][^.]+$') then regexp_replace(ip, '[.][^.]+$', '.***') else '***' end as client_ip from a""",
    )


# --- state -------------------------------------------------------------------


def _sessions() -> str:
    kept = ", ".join(f"arg_min({c}, seq) as {c}" for c in ("device_id", "user_id", "session_start_time", "project_id", "created_at"))
    now = ", ".join(
        f"arg_max({c}, seq) as {c}"
        for c in ("session_duration_ms", "screen_count", "event_count", "device_model", "os_version", "app_version", "build_number")
    )
    return _sql(["v_session_uploads"], {}, f"select session_id, {kept}, {now}, max(seq) as seq from v_session_uploads group by session_id")


def _devices() -> str:
    return _sql(
        ["v_device_registrations"],
        {"r": "select *, row_number() over (partition by project_id, device_id order by seq desc) as nth, min(received_at) over (partition by project_id, device_id) as first_at, count(*) over (partition by project_id, device_id) as n from v_device_registrations"},
        """select project_id, device_id, first_at as created_at, api_key, secret_key, device_model, os_version, app_version,
        received_at as last_active_at, false as is_banned, cast(null as varchar) as ban_reason, n as registrations, seq from r where nth = 1""",
    )


def _increments() -> str:
    return _sql(
        ["v_events", "v_counters"],
        {"r": "select project_id, counter_key, json_extract_string(event_trigger, '$.event_type') as et, json_extract_string(event_trigger, '$.conditions.k') as k from v_counters"},
        """select r.project_id, r.counter_key, count(*) as hits from v_events e join r on r.project_id = e.project_id and r.et = e.event_type
        where r.k is null or json_extract_string(e.properties, '$.k') = r.k group by 1, 2""",
    )


COUNTER_CTES = {
    "alive": """select * from (select *, max(case when op = 'delete' then seq end) over (partition by project_id, counter_key) as gone from v_counter_changes) x
        where gone is null or seq > gone""",
    "valued": "select *, max(case when op = 'set' and amount is not null then seq end) over (partition by project_id, counter_key) as base from alive",
    "counters": """select project_id, counter_key,
        cast(coalesce(sum(case when seq = base then amount when op = 'inc' and (base is null or seq > base) then coalesce(amount, 1) end), 0) as bigint) as counter_value,
        arg_max(display_name, seq) filter (where display_name is not null) as display_name, arg_max(unit, seq) filter (where unit is not null) as unit,
        coalesce(arg_max(is_public, seq) filter (where is_public is not null), false) as is_public,
        max(changed_at) as updated_at, max(seq) as seq from valued group by 1, 2""",
}


def _counters(final: str) -> str:
    return _sql(["v_counter_changes"], COUNTER_CTES, final)


# --- privacy and bans --------------------------------------------------------


def _privacy_submit() -> str:
    kind, handler, source = "upper(trim(request_type))", "upper(trim(processor))", "upper(trim(source))"
    return _sql(
        ["v_privacy_items"], {},
        f"""select concat('prv_', substring(sha256({_text('project_id', 'user_id', 'device_id', 'request_type', 'processor', 'contact_email', 'received_us')}), 1, 32)) as request_id,
        project_id, user_id, device_id, {kind} as request_type, {handler} as processor,
        case when source is null then 'APP_SETTINGS' when regexp_matches({source}, '^[A-Z0-9_-]+$') then {source} end as source,
        trim(contact_email) as contact_email, nullif(trim(requester_note), '') as requester_note, received_at as requested_at,
        case when trim(user_id) = '' then 'missing_user_id' when {kind} not in ('EXPORT', 'DELETE') then 'invalid_request_type'
        when {handler} not in ('FIRST_PARTY', 'POSTHOG') then 'invalid_processor' when contact_email is null then 'missing_contact_email'
        when not regexp_matches({source}, '^[A-Z0-9_-]+$') then 'invalid_source' end as reason from v_privacy_items""",
    )


def _stored_privacy() -> str:
    """Good requests that no earlier one of the same kind answers, counted."""
    same = "project_id, user_id, device_id, request_type, processor, contact_email"
    return _sql(
        ["v_privacy_items"],
        {
            "good": f"select * from ({_privacy_submit()}) s where reason is null and project_id = 'demo'",
            "n": f"select *, dense_rank() over (order by {same}) as grp, row_number() over (partition by {same} order by requested_at, request_id) as rn from good",
            "chain": """select grp, rn, request_type, processor, true as stored, requested_at as anchor from n where rn = 1
                union all select n.grp, n.rn, n.request_type, n.processor, n.requested_at > c.anchor + interval 600 second,
                case when n.requested_at > c.anchor + interval 600 second then n.requested_at else c.anchor end
                from chain c join n on n.grp = c.grp and n.rn = c.rn + 1""",
        },
        "select request_type, processor, count(*) as requests from chain where stored group by 1, 2",
    )


def _posted_batches() -> str:
    same = "batch_id, project_id, device_id, user_id"
    posted = f"""select * replace (concat_ws('|', {same}) as batch_id, max(received_at) over (partition by {same}) as received_at,
        cast(row_number() over (partition by {same} order by item_no) - 1 as int) as item_no) from v_event_items"""
    ctes = {"posted": posted} | {k: v.replace("from v_event_items", "from posted") for k, v in NEW_EVENTS.items()}
    ctes["r"] = "select batch_id, count(*) as received from posted group by 1 union all select null, count(*) from v_event_items where request_ms % 50 = 0 having count(*) > 0"
    ctes["a"] = "select batch_id, count(*) as accepted from fresh group by 1"
    return _sql(
        ["v_event_items", "v_known_keys"], ctes,
        """select r.batch_id, r.received, coalesce(a.accepted, 0) as accepted, r.received - coalesce(a.accepted, 0) as rejected,
        coalesce(a.accepted, 0) = 0 as failed from r left join a on a.batch_id = r.batch_id""",
    )


def _refused() -> str:
    return _sql(
        ["v_project_reads", "v_projects"],
        {"asked": "select trim(project_id) as raw, replace(project_id, ' ', '') as project_id from v_project_reads"},
        """select a.project_id, case when coalesce(a.project_id, '') = '' then 'missing_project_id' when not regexp_matches(a.project_id, '^[a-z0-9_-]{1,50}$') then 'malformed_project_id'
        when p.project_id is null then 'unknown_project' when not coalesce(p.is_active, false) then 'inactive_project' end as reason, count(*) as reads
        from asked a left join v_projects p on p.project_id = a.project_id group by 1, 2""",
    )


def _privacy_dedup(with_changes: bool = False) -> str:
    left = """left join (select request_id, min(changed_at) as left_at from v_privacy_changes where status <> 'SUBMITTED' group by 1) l using (request_id)"""
    until = "anchor + interval 600 second" + (" and (left_at is null or n.requested_at < left_at)" if with_changes else "")
    return _sql(
        ["v_privacy_submissions", *(["v_privacy_changes"] if with_changes else [])],
        {
            "n": f"""select *, dense_rank() over (order by project_id, user_id, device_id, request_type, processor, contact_email) as grp,
                row_number() over (partition by project_id, user_id, device_id, request_type, processor, contact_email order by requested_at, request_id) as rn
                from v_privacy_submissions {left if with_changes else 'cross join (select null as left_at)'}""",
            "chain": f"""select grp, rn, request_id, request_id as answered_by, requested_at as anchor, left_at from n where rn = 1
                union all select grp, rn, request_id, case when again then old else request_id end, case when again then anchor else requested_at end,
                case when again then old_left else left_at end
                from (select n.*, c.answered_by as old, c.anchor, c.left_at as old_left, n.requested_at <= c.{until.replace('left_at', 'c.left_at')} as again
                      from chain c join n on n.grp = c.grp and n.rn = c.rn + 1) s""",
        },
        "select request_id, answered_by from chain",
    )


STATE_CTES = {
    "last": "select *, row_number() over (partition by request_id order by seq desc) as nth from v_privacy_status_log",
    "info": "select request_id, min(changed_at) filter (where status <> 'SUBMITTED') as processed_at, arg_max(operator, seq) filter (where trim(operator) <> '') as operator from v_privacy_status_log group by 1",
    "requests": """select s.*, l.status, i.processed_at, case when l.status in ('COMPLETED', 'REJECTED', 'CANCELLED') then l.changed_at end as closed_at,
        l.changed_at as updated_at, i.operator from v_privacy_submissions s join last l on l.request_id = s.request_id and l.nth = 1 join info i on i.request_id = s.request_id""",
}


def _bans() -> str:
    return _sql(
        ["v_auth_attempts"],
        {
            "n": "select *, row_number() over (partition by ip order by attempted_at, seq) as rn from v_auth_attempts",
            # State after each attempt: failures and the time of the first; zero failures is a clean address.
            "walk": """select ip, rn, attempted_at, case when success then 0 else 1 end as fails, case when not success then attempted_at end as first_at, false as starts from n where rn = 1
                union all select ip, rn, attempted_at,
                case when banned then old_fails when success then 0 when expired then 1 else old_fails + 1 end,
                case when banned then old_first when success then null when expired then attempted_at else old_first end,
                not banned and not success and not expired and old_fails + 1 = 5
                from (select n.ip, n.rn, n.attempted_at, n.success, w.fails as old_fails, w.first_at as old_first,
                      w.fails >= 5 and n.attempted_at < w.first_at + interval 15 minute as banned,
                      w.fails = 0 or n.attempted_at >= w.first_at + interval 15 minute as expired
                      from walk w join n on n.ip = w.ip and n.rn = w.rn + 1) s""",
        },
        "select ip, first_at as first_failure_at, attempted_at as banned_from, first_at + interval 15 minute as banned_until from walk where starts",
    )


def all_checks() -> dict[str, str]:
    k = "coalesce(json_extract_string(properties, '$.k'), '(none)')"
    out = {
        "funnel": _funnel(["signup", "view", "purchase"], "'all'"),
        "funnel_grouped": _funnel(["view", "click", "purchase", "error"], k),
        "retention": _retention(),
        "overview": _overview(),
        "metric_trends_day": _metric_trend("day"),
        "metric_trends_hour": _metric_trend("hour"),
        "top_events": _sql(["v_events"], {}, f"select event_type, count(*) as total from v_events where {IN_RANGE} group by 1 order by total desc, event_type limit 10"),
        "event_types": _sql(["v_events"], {}, "select distinct event_type from v_events where project_id = 'demo'"),
        "traffic_summary": _sql(
            ["v_traffic"], {},
            f"""select count(*) filter (where metric_type = 'page_view') as page_views, count(distinct case when metric_type = 'page_view' then device_id end) as visitors
            from v_traffic where project_id = 'demo' and {NOT_BOT}""",
        ),
        **{f"traffic_trends_{s}": _traffic_trend(s) for s in ("hour", "day", "week", "month", "year")},
        "top_pages": _top_traffic("page_path", 10),
        "top_referrers": _top_traffic("referrer", 20),
        "list_events": _listed(["v_events"], {}, "v_events", "event_id, event_type, event_timestamp, created_at, device_id, user_id, session_id, properties", "event_type = 'view'", "created_at", "event_id", 100, 100),
        "list_events_after": _sql(
            ["v_events"],
            {"kept": f"select * from v_events where project_id = 'demo' and created_at >= {LO} and created_at < {HI} and event_type = 'view'"},
            """select event_id, event_type, event_timestamp, created_at, device_id, user_id, session_id, properties, (select count(*) from kept) as total
            from kept where created_at <= timestamp '2024-01-10 00:00:00' order by created_at desc, event_id limit 500""",
        ),
        "list_events_deep": _listed(["v_events"], {}, "v_events", "event_id, event_type, event_timestamp, created_at, device_id, user_id, session_id, properties", "true", "created_at", "event_id", 2, 1998),
        "list_events_total": _sql(["v_events"], {}, f"select count(*) as total from v_events where project_id = 'demo' and created_at >= {LO} and created_at < {HI} and event_type = 'view'"),
        "list_sessions": _listed(["v_sessions"], {}, "v_sessions", "session_id, device_id, user_id, session_start_time, session_duration_ms, device_model, os_version, app_version, build_number, screen_count, event_count, created_at", "true", "session_start_time", "session_id", 50, 0),
        "list_devices": _listed(["v_devices"], {}, "v_devices", "device_id, api_key, device_model, os_version, app_version, is_banned, ban_reason, created_at, last_active_at", "not is_banned", "created_at", "device_id", 200, 0),
        "list_traffic": _listed(["v_traffic"], {}, "v_traffic", "metric_id, metric_type, page_path, referrer, metric_timestamp, created_at, device_id, user_id, session_id, metadata", "metric_type = 'page_view'", "created_at", "metric_id", 40, 80),
        "list_privacy": _listed(["v_privacy_submissions", "v_privacy_status_log"], STATE_CTES, "requests", "request_id, user_id, device_id, request_type, processor, status, contact_email, requested_at, processed_at, closed_at, operator", "status = 'IN_PROGRESS'", "requested_at", "request_id", 75, 0),
        "ingest_events": _ingest_events(),
        "ingest_event_rejects": _sql(["v_event_items"], {"checked": EVENT_CTES["checked"]}, "select reason, count(*) as items from checked where reason is not null group by 1"),
        "ingest_event_batches": _event_batches(),
        "ingest_duplicate_answers": _sql(
            ["v_event_items"], EVENT_CTES,
            "select g.batch_id, g.item_no, g.project_id, g.key_hash, f.event_id from good g join firsts f on f.project_id = g.project_id and f.key_hash = g.key_hash",
        ),
        "ingest_gate": _gate(),
        "ingest_traffic_signed": _signed_traffic(),
        "ingest_traffic_public": _public_traffic(),
        "mask_access_log": _mask(),
        "session_upsert": _sessions(),
        "device_upsert": _devices(),
        "device_registrations": _sql(
            ["v_device_registrations"], {},
            "select project_id, device_id, seq, api_key, row_number() over (partition by project_id, device_id order by seq) = 1 as is_new from v_device_registrations",
        ),
        "counter_increments": _increments(),
        "counter_state": _counters("select * from counters"),
        "counter_list": _counters("select counter_key, counter_value, display_name, unit, is_public, updated_at from counters where project_id = 'demo' order by updated_at desc, counter_key"),
        "counter_public": _counters(
            """select counter_key, counter_value, case when display_name is null then '' else coalesce(json_extract_string(display_name, '$.en'), json_extract_string(display_name, '$.zh'), json_extract_string(display_name, '$.fr')) end as display_name,
            coalesce(json_extract_string(unit, '$'), '') as unit, updated_at from counters where project_id = 'demo' and is_public"""
        ),
        "privacy_submit": _privacy_submit(),
        "privacy_dedup": _privacy_dedup(),
        "privacy_state": _sql(["v_privacy_submissions", "v_privacy_status_log"], STATE_CTES, "select request_id, status, processed_at, closed_at, updated_at, operator from requests"),
        "privacy_latest": _sql(
            ["v_privacy_submissions"],
            {"r": "select *, row_number() over (partition by project_id, user_id order by requested_at desc, request_id desc) as nth from v_privacy_submissions"},
            "select project_id, user_id, request_id, requested_at from r where nth = 1",
        ),
        "ban_windows": _bans(),
    }
    out["stream_ingest_events"] = out["ingest_events"]
    out["ingest_gate_as_of"] = out["stream_gate"] = _gate_as_of()
    out["stream_dedup_keys"] = _sql(["v_event_items", "v_known_keys"], NEW_EVENTS, "select project_id, key_hash from fresh where key_hash is not null")
    out["counter_snapshot"] = out["counter_state"]
    out["stream_traffic_batches"] = f"""with r as (select t.reason, concat_ws('|', i.batch_id, i.project_id, i.device_id, i.user_id) as batch_id
            from ({out['ingest_traffic_signed']}) t join ({_sql(['v_traffic_items'], {}, 'select batch_id, item_no, project_id, device_id, user_id from v_traffic_items')}) i using (batch_id, item_no)
            union all select 'malformed_record', null from ({_sql(['v_traffic_items'], {}, 'select batch_id from v_traffic_items where item_no = 7')}))
        select batch_id, count(*) as received, count(*) filter (reason is null) as accepted, count(reason) as rejected, count(*) filter (reason is null) = 0 as failed from r group by 1"""
    out["overview_rollup"] = out["overview"]
    out["stream_visitors"] = out["traffic_trends_day"]
    out["stream_privacy_dedup"] = _privacy_dedup(with_changes=True)
    out["stream_ban_windows"] = out["ban_windows"]
    out["stream_counters"] = out["counter_increments"]
    out["pipeline_events"] = f"select event_type, count(*) as events from ({out['ingest_events']}) where project_id = 'demo' group by event_type"
    out["pipeline_sessions"] = f"""select cast(session_start_time as date) as day, count(*) as sessions, cast(sum(event_count) as bigint) as events
        from ({out['session_upsert']}) where project_id = 'demo' group by 1"""
    out["pipeline_event_batches"], out["pipeline_privacy"], out["pipeline_refused"] = _posted_batches(), _stored_privacy(), _refused()
    for name, kind in (("pipeline_traffic", "signed"), ("pipeline_public_traffic", "public")):
        out[name] = f"""select metric_type, count(*) as metrics, count(distinct device_id) as devices from ({out[f'ingest_traffic_{kind}']})
            where reason is null and project_id = 'demo' group by 1"""
    out["pipeline_devices"] = f"""select cast(created_at as date) as day, os_version, count(*) as devices from ({out['device_upsert']})
        where project_id = 'demo' group by 1, 2"""
    out["stream_page_views"] = _sql(
        ["v_traffic"], {},
        f"""select project_id, cast(date_trunc('day', created_at) as timestamp) as bucket, count(*) as page_views from v_traffic
        where {NOT_BOT} and metric_type = 'page_view' group by 1, 2""",
    )
    return out
