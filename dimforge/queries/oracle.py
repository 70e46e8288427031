"""SQL of what several queries share: instants of times in many notations, and records of delimited lines."""

from __future__ import annotations

from dimforge.operators.timestamps import _MONTH_ORDER, _MONTHS, _WEEKDAY_ORDER, _WEEKDAYS, ABBREVIATIONS

_CLOCK = r"(?:t|:|\s+(?:at\s+)?)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(.*)$"
_YMD = r"^(\d{4})(?:-(\d{1,2})-(\d{1,2})|/(\d{1,2})/(\d{1,2})|\.(\d{1,2})\.(\d{1,2}))" + _CLOCK
_DMY = rf"^(?:({_WEEKDAYS})\.?,?\s+)?(\d{{1,2}})[-/ ]({_MONTHS})\.?[-/ ](\d{{4}}),?" + _CLOCK
_MDY = rf"^(?:({_WEEKDAYS})\.?,?\s+)?({_MONTHS})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?" + _CLOCK
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:t|\s)?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(.*)$"
_TAIL = r"^(?:\s*([ap])\.?m\.?)?(?:\s*([+-])(\d{2})(?::?(\d{2}))?|\s*([a-z]{1,5}))?(?:\s*\[([^\[\]]+)\]|\s+\(?([a-z_]+(?:/[a-z0-9_+-]+)+)\)?)?$"


def _parts(pattern: str, names: str, alias: str) -> str:
    return f"regexp_extract(v, '{pattern}', [{', '.join(repr(n) for n in names.split())}], 'i') as {alias}"


def _offset(at: str) -> str:
    """Microseconds that clocks of zone `zn` are ahead at instant `at`."""
    return f"(epoch_us(timezone(zn, timezone('UTC', make_timestamp({at})))) - ({at}))"


def times(source: str) -> str:
    """CTEs up to `instants` (src, row_id, readable, plain, epoch_us) of the relation `source` (src, row_id, raw, zone)."""
    first = lambda n, of: "coalesce(" + ", ".join(f"nullif({a}.{n}, '')" for a in of) + ")"
    values = ", ".join(f"('{k}', {v})" for k, v in ABBREVIATIONS.items())
    return rf"""
abbreviations(name, minutes) as (values {values}),
zone_names as (select name from pg_timezone_names()),
tv as (select src, row_id, zone, regexp_replace(raw, '^\s+|\s+$', '', 'g') as v from {source}),
tp as (select *, regexp_extract(v, '^(\d{{10}}|\d{{13}}|\d{{16}}|\d{{19}})(?:\.(\d+))?$', ['n', 'f']) as k,
  {_parts(_YMD, 'y m1 d1 m2 d2 m3 d3 h i s f z', 'a')}, {_parts(_DMY, 'w d n y h i s f z', 'b')}, {_parts(_MDY, 'w n d y h i s f z', 'c')}, {_parts(_COMPACT, 'y m d h i s f z', 'e')} from tv),
tu as (select src, row_id, zone, v, k, {first('y', 'abce')}::int as y,
    coalesce(nullif(a.m1, ''), nullif(a.m2, ''), nullif(a.m3, ''), nullif(e.m, ''))::int as mn, lower({first('n', 'bc')}) as mname, coalesce(nullif(a.d1, ''), nullif(a.d2, ''), nullif(a.d3, ''), {first('d', 'bce')})::int as d,
    {first('h', 'abce')}::int as h, {first('i', 'abce')}::int as i, coalesce({first('s', 'abce')}::int, 0) as s, coalesce({first('f', 'abce')}, '') as f, lower({first('w', 'bc')}) as w, coalesce({first('z', 'abce')}, '') as z from tp),
tw as (select *, coalesce(mn, (instr('{_MONTH_ORDER}', mname[:3]) + 2) // 3) as m, regexp_extract(z, '{_TAIL}', ['ap', 'sg', 'oh', 'om', 'ab', 'bz', 'iz'], 'i') as t, regexp_matches(z, '{_TAIL}', 'i') as z_ok from tu),
tx as (select *, try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, m, d) as date) as day, nullif(t.bz || t.iz, '') as own,
    case when t.ap = '' then h else h % 12 + case when lower(t.ap) = 'p' then 12 else 0 end end as hour, t.ap = '' or h between 1 and 12 as clock_ok,
    case when t.sg <> '' then (nullif(t.oh, '')::int * 60 + coalesce(nullif(t.om, '')::int, 0)) * case when t.sg = '-' then -1 else 1 end else (select minutes from abbreviations where name = lower(t.ab)) end as off from tw),
ty as (select *, case when k.n = '' and v is not null and z_ok and y >= 1 and day is not null and hour <= 23 and i <= 59 and s <= 59 and clock_ok
    and (t.sg = '' or (nullif(t.oh, '')::int <= 18 and coalesce(nullif(t.om, '')::int, 0) <= 59)) and (t.ab = '' or off is not null) and (own is null or own in (select name from zone_names))
    and (w is null or instr('{_WEEKDAY_ORDER}', w[:3]) // 3 = (day - date '1970-01-01') % 7)
    then epoch_us(day::timestamp) + ((hour * 60 + i) * 60 + s)::bigint * 1000000 + rpad(f[:6], 6, '0')::bigint end as wall,
    case when off is null then coalesce(own, case when zone in (select name from zone_names) then zone end) end as zn from tx),
tz as (select *, wall - {_offset('wall - 86400000000')} as early, wall - {_offset('wall + 86400000000')} as late from ty),
instants as (select src, row_id, v, k.n <> '' and (k.f <> '' or k.n[1] <> '0') or wall is not null as readable, length(k.n) = 10 and k.f = '' and k.n[1] <> '0' and v not like '%.%' as plain,
  case when k.n <> '' and (k.f <> '' or k.n[1] <> '0') then case length(k.n) when 10 then nullif(k.n, '')::bigint * 1000000 + rpad(k.f[:6], 6, '0')::bigint when 13 then nullif(k.n, '')::bigint * 1000 + rpad(k.f[:3], 3, '0')::bigint when 16 then nullif(k.n, '')::bigint else nullif(k.n[:16], '')::bigint end
    when off is not null then wall - off::bigint * 60000000
    else case when wall - early = {_offset('early')} then case when early = late or wall - late <> {_offset('late')} then early end when wall - late = {_offset('late')} then late end end as epoch_us from tz)
"""


#: Relation of the stage's times, with the wall clock's zone.
STAGE = "(select 'visits_file_fact_stage' as src, line_id as row_id, time_key as raw, z.zone from visits_file_fact_stage left join (select tenant_id, max(time_zone) as zone from tenant_dimension group by tenant_id) z on z.tenant_id = tenant_dimension_tenant_id)"

_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
#: A YAML mapping as user files write it: keys at the margin, each with a plain or quoted scalar or a list of scalars.
_YAML = r"""(?:---\n)?(?::?[a-z_]+:(?: (?:[a-z0-9_.-]+|"(?:[^"\\]|\\.)*"|\[(?:"[^"]*"|[a-z0-9_]+)?(?:, ?(?:"[^"]*"|[a-z0-9_]+))*\]))?(?:\n|$))+"""

#: CTEs up to `records`: line_id, reason but for times, and the fields of each record.
RECORDS = rf"""
rl as (select line_id, regexp_replace(regexp_replace(raw_line, '^\x{{feff}}', ''), '\r$', '') as r from user_file where line_no <> 1),
rr as (select * from rl where trim(r, ' ' || chr(9) || chr(10) || chr(13)) <> '' and not starts_with(r, '#') and r <> 'id,tenant_id,admin,preferences,deleted_at'),
rf as (select line_id, regexp_full_match(r, '{_FIELD}(?:,{_FIELD})*') as quoted,
  list_transform(regexp_extract_all(',' || r, ',({_FIELD})', 1), lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) as f from rr),
records as (select line_id, f[2] as tenant_id, f[4] as preferences, f[5] as deleted_at, case when not quoted then 'quoting' when len(f) <> 5 then 'columns'
  when not regexp_full_match(trim(f[1]), '[+-]?[0-9]+') or try_cast(trim(f[1]) as bigint) is null then 'id'
  when not regexp_full_match(trim(f[2]), '[+-]?[0-9]+') or try_cast(trim(f[2]) as bigint) is null then 'tenant_id'
  when lower(trim(f[3])) not in ('', '0', '1', 'true', 'false') then 'admin'
  when trim(f[4], ' ' || chr(10)) <> '' and not coalesce(try_cast(f[4] as json) is not null and json_type(try_cast(f[4] as json)) = 'OBJECT', false) and not regexp_full_match(f[4], '{_YAML}') then 'preferences' end as reason from rf)
"""
#: Relation of the times of loadable records.
DELETED = "(select 'user_file' as src, line_id as row_id, deleted_at as raw, z.zone from records left join (select tenant_id, max(time_zone) as zone from tenant_dimension group by tenant_id) z on z.tenant_id = try_cast(trim(records.tenant_id) as bigint) where reason is null)"
