"""The tokenizer's queries in DuckDB's SQL."""

from __future__ import annotations

from statistics import NormalDist

from eventloom.operators.distfit import PERCENTS
from eventloom.plans.tokenizer_queries import EDGES, WORDS

CLINICAL = "(select * from demo where not (class = 'demographic' and text_value = 'birth_date'))"
NUMBERS = f"(select class, text_value, numeric_value as v from {CLINICAL} where numeric_value is not null and not isnan(numeric_value))"
ORDERS = "(select o_orderkey as _src, o_orderstatus as class, o_orderpriority as text_value, o_totalprice as v from orders)"


def _clipped(rows: str, low: float = 0.01, high: float = 0.99) -> str:
    return f"""
      r as (select * from {rows}),
      b as (select class, text_value, quantile_cont(v, {low}) as low, quantile_cont(v, {high}) as high from r group by class, text_value),
      c as (select r.class, r.text_value, least(greatest(r.v, b.low), b.high) as x from r join b on r.class is not distinct from b.class and r.text_value is not distinct from b.text_value),
      f as (select class, text_value, avg(x) as mean, var_pop(x) as var, coalesce(avg(ln(x)) filter (where x > 0), 0.0) as mu, coalesce(var_pop(ln(x)) filter (where x > 0), 1.0) as sigma2,
        avg(x) * avg(x) / greatest(var_pop(x), 1e-8) as alpha, var_pop(x) / greatest(avg(x), 1e-8) as beta, min(x) as vmin, max(x) as vmax from c group by class, text_value)"""


def _fit(names: list[str], rows: str = NUMBERS, digits: int = 6) -> str:
    return f"with {_clipped(rows)} select class, text_value, {', '.join(f'round({n} + 1e-9, {digits}) + 0.0::double as {n}' for n in names)} from f"


_SCALED = {
    "normal": "(x - mean) / sqrt(greatest(var, 1e-8))", "lognormal": "(ln(greatest(x, 1e-8)) - mu) / sqrt(greatest(sigma2, 1e-8))",
    "gamma": "(x - alpha * beta) / sqrt(greatest(alpha * beta * beta, 1e-8))", "minmax": "(x - vmin) / greatest(vmax - vmin, 1e-8)",
}
SCALED = f"""with {_clipped(ORDERS)},
      s as (select o._src, least(greatest(o.v, b.low), b.high) as x, f.* from {ORDERS} o join b on o.class = b.class and o.text_value = b.text_value join f on o.class = f.class and o.text_value = f.text_value)
      select _src, {', '.join(f'round({e}, 6) as {n}' for n, e in _SCALED.items())} from s"""

_E = f"[{', '.join(map(str, EDGES))}]::double[]"
_BIN = f"len(list_filter({_E}, lambda e: e <= v))"
DIGITIZED = f"""with b as (select _src, v, {_BIN} as q, len(list_filter({_E}, lambda e: e < v)) as l from {ORDERS})
      select _src, q::int as bin, case when q <= 0 then {EDGES[0]} when q >= {len(EDGES)} then {EDGES[-1]} else (({_E})[q] + ({_E})[q + 1]) / 2 end::double as midpoint,
        case when q <= 0 then {EDGES[1] - EDGES[0]} when q >= {len(EDGES)} then {EDGES[-1] - EDGES[-2]} else ({_E})[q + 1] - ({_E})[q] end::double as width, least(l, {len(EDGES) - 1})::int as level from b"""


def _edges(rows: str, keys: str) -> str:
    """Edges of groups whose values are spread so well that each cut has a gap of its own."""
    cuts = ", ".join(f"{0.01 + i * 0.98 / 8}::double" for i in range(9))
    return f"""
      v as (select {keys}, v, count(*) as c from {rows} group by {keys}, v),
      q as (select {keys}, unnest(quantile_cont(v, [{cuts}])) as cut, quantile_cont(v, 0.01) as low, quantile_cont(v, 0.99) as high from {rows} group by {keys}),
      u as (select v.*, row_number() over (partition by {keys} order by v) as i, count(*) over (partition by {keys}) as n, lead(v) over (partition by {keys} order by v) as nxt
        from v join (select distinct {keys}, low, high from q) using ({keys}) where v between low and high),
      g as (select distinct u.* from (select {', '.join(f'q.{k.strip()}' for k in keys.split(','))}, (select min(i) from u where {' and '.join(f'u.{k.strip()} = q.{k.strip()}' for k in keys.split(','))} and u.v >= q.cut) as i from q) x
        join u on {' and '.join(f'u.{k.strip()} = x.{k.strip()}' for k in keys.split(','))} and u.i = least(coalesce(x.i, u.n), u.n - 1)),
      e as (select {keys}, (v + nxt) / 2 as edge, row_number() over (partition by {keys} order by v) - 1 as i from g)"""


QUANTILE_EDGES = f"with {_edges(ORDERS, 'class, text_value')} select class, text_value, i::int as i, round(edge, 6) as edge from e"

LINE = """
      b as (select *, row_number() over (partition by id order by time nulls first, _src) as rn, coalesce(class = 'demographic' and text_value = 'birth_date', false) as birth from demo),
      s as (select *, sum(birth::int) over (partition by id order by rn rows unbounded preceding) as seg,
        last_value(case when birth then time end ignore nulls) over (partition by id order by rn rows between unbounded preceding and current row) as seen,
        lead(rn) over (partition by id order by rn) is null as ends from b),
      k as (select id, max_by(time, _src) as known from demo where class = 'demographic' and text_value = 'birth_date' and time is not null group by id),
      m as (select s.*, coalesce(seen, known) as born, case when not birth then time end as moment,
        case when not birth and class = 'admission' then 'inpatient' when not birth and class = 'discharge' then 'outpatient' end as goes from s left join k on s.id = k.id),
      p as (select *, last_value(moment ignore nulls) over w as prev, coalesce(last_value(goes ignore nulls) over w, 'outpatient') as state, coalesce(count(goes) over w, 0) as g from m
        window w as (partition by id, seg order by rn rows between unbounded preceding and 1 preceding)),
      t as (select *, case when moment > prev then epoch_us(moment) - epoch_us(prev) end as dt, floor((epoch_us(moment) - epoch_us(born)) / (365 * 86400e6))::int as years from p)"""

STATE = f"with {LINE} select _src, state, coalesce(dt // 1000, -1)::bigint as dt_ms from t where not birth"
BOUNDARIES = f"with {LINE} select _src, birth or rn = 1 as starts, ends from t where birth or rn = 1 or ends"
AGES = f"""with {LINE}, y as (select *, case when years between 0 and 120 then years end as ok from t),
      z as (select *, last_value(ok ignore nulls) over (partition by id, seg order by rn rows between unbounded preceding and 1 preceding) as before from y)
      select _src, ok as age from z where ok is not null and ok is distinct from before"""
_KINDS = {
    "week": ("'<|ms_week_' || week(time) || '|>'", "isoyear(time) || '-' || week(time)"), "month": ("'<|ms_month_' || month(time) || '|>'", "year(time) || '-' || month(time)"),
    "daily": ("'<|ms_day_' || isodow(time) || '|>'", "time::date::varchar"), "12hr": ("'<|ms_12hr_' || ((hour(time) + 17) % 24) // 12 || '|>'", "time::date || ' ' || ((hour(time) + 17) % 24) // 12"),
    "8hr": ("'<|ms_8hr_' || ((hour(time) + 17) % 24) // 8 || '|>'", "time::date || ' ' || ((hour(time) + 17) % 24) // 8"),
}


def _milestones(kind: str) -> str:
    mark, key = _KINDS[kind]
    return f"""with {LINE}, y as (select *, case when dt is not null then g || '/' || ({key}) end as key from t),
      z as (select *, last_value(key ignore nulls) over (partition by id, seg order by rn rows between unbounded preceding and 1 preceding) as before from y)
      select _src, {mark} as token from z where key is not null and key is distinct from before"""


def _advice() -> str:
    z = [NormalDist().inv_cdf(p / 100) for p in PERCENTS]
    at = lambda c, p: f"{c}[(floor((n - 1) * {p / 100.0}::double + 0.5) + 1)::bigint]"
    score = lambda f: f"sqrt(({' + '.join(f'power({f(f'q[{i + 1}]')} - ({x!r}), 2)' for i, x in enumerate(z))}) / {len(z)})"
    return f"""
      with l as (select class, text_value, count(*) as n, list(v order by v) as vs from {NUMBERS} group by class, text_value having count(*) >= 30),
      c as (select class, text_value, n, list_transform(vs, lambda v: least(greatest(v, {at('vs', 1.0)}), {at('vs', 99.0)})) as xs from l),
      e as (select class, text_value, n, unnest(xs) as x from c),
      m as (select class, text_value, avg(x) as mean, var_pop(x) as var, min(x) as lo, max(x) as hi, avg(case when x > 0 then ln(x) end) as mu, var_pop(case when x > 0 then ln(x) end) as s2 from e group by class, text_value),
      q as (select c.class, c.text_value, n, m.* exclude (class, text_value), [{', '.join(at('xs', p) for p in PERCENTS)}] as q, case when var > 0 then mean * mean / var else 1 end as a, case when mean > 0 then var / mean else 1 end as b
        from c join m on c.class is not distinct from m.class and c.text_value is not distinct from m.text_value),
      s0 as (select *, {score(lambda x: f'({x} - mean) / sqrt(greatest(var, 1e-8))')} as normal, case when lo > 0 then {score(lambda x: f'(ln({x}) - mu) / sqrt(greatest(s2, 1e-8))')} end as lognormal,
        case when lo > 0 then {score(lambda x: f'({x} - a * b) / sqrt(greatest(a * b * b, 1e-8))')} end as gamma, {score(lambda x: f'({x} - lo) / greatest(hi - lo, 1e-8)')} as minmax,
        hi - lo <= 100 and hi <= 100 and lo >= 0 and q[{PERCENTS.index(90) + 1}] > lo + 0.8 * (hi - lo) as high from q),
      s as (select * replace (round(normal, 9) as normal, round(lognormal, 9) as lognormal, round(gamma, 9) as gamma, round(minmax, 9) as minmax) from s0)
      select class, text_value, n as count, round(mean + 1e-9, 5) + 0.0::double as mean, q[{PERCENTS.index(50) + 1}] as p50, q[{PERCENTS.index(99.9) + 1}] as p99_9, round(normal + 1e-9, 4) as normal, coalesce(round(lognormal + 1e-9, 4), -1) as lognormal,
        coalesce(round(gamma + 1e-9, 4), -1) as gamma, round(minmax + 1e-9, 4) as minmax, high as is_clustered_high,
        case when high and minmax < 2 then 'minmax' when lo < 0 then 'normal' when normal <= least(coalesce(lognormal, 1e9), coalesce(gamma, 1e9), minmax) then 'normal'
          when lognormal <= least(coalesce(gamma, 1e9), minmax) then 'lognormal' when gamma <= minmax then 'gamma' else 'minmax' end as recommendation from s"""


STRUCTURE = f"""with {LINE},
      a as (select *, case when years between 0 and 120 then years end as ok,
        case when dt is not null then g || '/' || case state when 'inpatient' then {_KINDS['8hr'][1]} else {_KINDS['week'][1]} end end as key from t),
      c as (select *, last_value(ok ignore nulls) over w as old, last_value(key ignore nulls) over w as past from a window w as (partition by id, seg order by rn rows between unbounded preceding and 1 preceding)),
      l as (select id, rn, case when birth or rn = 1 then ['<|sos|>'] else [] end as s, case when ends then ['<|eos|>'] else [] end as e, case when birth then [] else
          (case when dt is not null then ['<|delta_time_' || case when dt <= 3600e6 then 0 when dt <= 86400e6 then 1 else 2 end || '|>'] else [] end)
          || (case when key is distinct from past and key is not null then [case state when 'inpatient' then {_KINDS['8hr'][0]} else {_KINDS['week'][0]} end] else [] end)
          || (case when ok is not null and ok is distinct from old then ['<|age_' || ok || '|>'] else [] end)
          || ['<|' || class || '|>'] || (case when text_value is not null then [text_value] else [] end) end as body from c),
      x as (select id, rn, unnest(s || body || e) as token, generate_subscripts(s || body || e, 1) as i, len(s) as a, len(s) + len(body) as b from l)
      select id, row_number() over (partition by id order by rn, i) as k, case when i <= a or i > b then -1 else rn - 1 end as row_no, token from x"""


GAPS = f"""(select id, (epoch_us(time) - epoch_us(prev)) // 1000000 as gap_s from (select id, time, lag(time) over (partition by id order by time nulls first, _src) as prev from {CLINICAL}) where time > prev)"""

SPECIAL = """
      with p as (select 0 as a, unnest(['sos', 'eos', 'pad', 'delta_time_0', 'delta_time_1', 'delta_time_2', 'NUM']) as x, generate_subscripts(['sos', 'eos', 'pad', 'delta_time_0', 'delta_time_1', 'delta_time_2', 'NUM'], 1) as i
        union all select 1, 'Q' || i, i from range(11) t(i) union all select 2, 'L' || i, i from range(11) t(i)
        union all select 3, 'ms_week_' || i, i from range(1, 54) t(i) union all select 4, 'ms_month_' || i, i from range(1, 13) t(i) union all select 5, 'ms_day_' || i, i from range(1, 8) t(i)
        union all select 6, 'ms_12hr_' || i, i from range(2) t(i) union all select 7, 'ms_8hr_' || i, i from range(3) t(i) union all select 8, 'age_' || i, i from range(121) t(i) union all select 9, 'ROW', 0)
      select '<|' || x || '|>' as token, row_number() over (order by a, i) - 1 as token_id,
        case when x in ('sos', 'eos', 'pad') then x when x = 'NUM' then 'num_marker' when x = 'ROW' then 'row' when x like 'delta%' then 'time_delta' when x like 'ms_%' then 'milestone' when x like 'age_%' then 'age' else left(x, 1) end as type from p"""

EVENTS = "(select event_id as _src, user_id as id, ts as time, event_type as text_value, value as v from events)"
_EV_GAPS = f"(select 'x' as k, ((epoch_us(time) - epoch_us(prev)) // 1000000)::double as v from (select time, lag(time) over (partition by id order by time, _src) as prev from {EVENTS}) where (epoch_us(time) - epoch_us(prev)) // 1000000 > 0)"


def _encoded(fused: bool) -> str:
    """Tokens of the events table: each row's list, then one row per token."""
    delta = "['<|delta_time_0_Q' || dq || '|>']" if fused else "['<|delta_time_0|>', '<|Q' || dq || '|>']"
    body = "['<|event|>', text_value || '::Q' || q]" if fused else "['<|event|>', text_value, '<|Q' || q || '|>']"
    return f"""
      with a as (with {_edges(EVENTS, 'text_value')} select text_value, list(edge order by i) as edges from e group by text_value),
      d as (with {_edges(_EV_GAPS, 'k')} select list(edge order by i) as edges from e),
      r as (select x.*, row_number() over w as rn, (epoch_us(time) - epoch_us(lag(time) over w)) / 1e6 as dt, lead(_src) over w is null as ends from {EVENTS} x window w as (partition by id order by time, _src)),
      n as (select r.*, a.edges as ve, d.edges as de, len(list_filter(a.edges, lambda z: z <= r.v)) as q, len(list_filter(d.edges, lambda z: z <= r.dt)) as dq from r join a using (text_value), d),
      l as (select id, rn, ends, (case when rn = 1 then ['<|sos|>'] else [] end) || (case when dt > 0 then {delta} else [] end) || {body} || (case when ends then ['<|eos|>'] else [] end) as t from n),
      x as (select id, rn, unnest(t) as token, generate_subscripts(t, 1) as i from l),
      z as (select id, case when token in ('<|sos|>', '<|eos|>') then -1 else rn - 1 end as row_no, row_number() over (partition by id order by rn, i) - 1 as pos, token from x)"""


def _vocabulary(fused: bool) -> str:
    """The vocabulary of the events table as further tables of ``_encoded``: token, token_id, type."""
    special = SPECIAL.replace("'delta_time_0', 'delta_time_1', 'delta_time_2'", "'delta_time_0'")
    more = """
        union all select 2, lpad(i::varchar, 3, '0'), '<|delta_time_0_Q' || i || '|>', 'time_delta_fused' from range(11) t(i)
        union all select 4, token, token, 'fused_concept_Q' from (select distinct text_value || '::Q' || i as token from events_, range(11) t(i))""" if fused else ""
    return f""",
      events_ as (select distinct text_value from {EVENTS}), sp as ({special}),
      parts(a, b, token, type) as (select 0, lpad(token_id::varchar, 6, '0'), token, type from sp union all select 1, '', '<|event|>', 'class'
        union all select 3, text_value, text_value, 'concept' from events_{more}),
      voc as (select token, row_number() over (order by a, b) - 1 as token_id, type from parts)"""


def _mid(edges: str, q: str) -> str:
    return f"case when {q} <= 0 then {edges}[1] when {q} >= len({edges}) then {edges}[len({edges})] else ({edges}[{q}] + {edges}[{q} + 1]) / 2 end"


def _width(edges: str, q: str) -> str:
    return f"case when {q} <= 0 then {edges}[2] - {edges}[1] when {q} >= len({edges}) then {edges}[len({edges})] - {edges}[len({edges}) - 1] else {edges}[{q} + 1] - {edges}[{q}] end"


IDS = {f: f"{_encoded(f)}{_vocabulary(f)} select id, row_no, pos, token, token_id from z join voc using (token)" for f in (False, True)}
VOCABULARY = f"{_encoded(True)}{_vocabulary(True)} select token, token_id, type from voc"
DECODED = f"""{_encoded(False)}, m as (select id, rn, text_value, {_mid('ve', 'q')} as v, case when dt > 0 then {_mid('de', 'dq')} else 0 end as s from n)
      select id, rn as k, 'event' as class, text_value, round(v, 6) as numeric_value, round(sum(round(s * 1e6) / 1e6) over (partition by id order by rn) * 1000)::bigint as ms from m"""
WIDTHS = f"""{_encoded(False)} select 'numeric' as "group", count(*) as n, round(sum(log2({_width('ve', 'q')})), 3) as bits from n
      union all select 'time', count(*), round(sum(log2({_width('de', 'dq')})), 3) from n where dt > 0"""

_GAP_FIT = f"""
      gb as (select quantile_cont(v, 0.01) as low, quantile_cont(v, 0.99) as high from {_EV_GAPS}),
      gf as (select any_value(low) as glow, any_value(high) as ghigh, avg(ln(x)) as gmu, var_pop(ln(x)) as gs from (select low, high, least(greatest(v, low), high) as x from {_EV_GAPS}, gb)),
      vb as (select text_value, quantile_cont(v, 0.01) as low, quantile_cont(v, 0.99) as high from {EVENTS} where v is not null and not isnan(v) group by text_value),
      vf as (select text_value, any_value(low) as low, any_value(high) as high, avg(least(greatest(v, low), high)) as mean, var_pop(least(greatest(v, low), high)) as var from {EVENTS} join vb using (text_value) where v is not null and not isnan(v) group by text_value),
      cr as (select x.*, row_number() over w as rn, (epoch_us(time) - epoch_us(lag(time) over w)) / 1e6 as dt, lead(_src) over w is null as ends from {EVENTS} x window w as (partition by id order by time, _src)),
      cn as (select cr.*, low, high, var, least(greatest(dt, glow), ghigh) as gx, gs, (least(greatest(v, low), high) - mean) / sqrt(greatest(var, 1e-8)) as z, (ln(least(greatest(dt, glow), ghigh)) - gmu) / sqrt(greatest(gs, 1e-8)) as gz from cr join vf using (text_value), gf)"""
CONTINUOUS = f"""{_encoded(False)}{_vocabulary(False)}, {_GAP_FIT},
      cl as (select id, rn, (case when rn = 1 then [('<|sos|>', null)] else [] end) || (case when dt > 0 then [('<|delta_time_0|>', null), ('<|NUM|>', gz)] else [] end)
        || [('<|event|>', null), (text_value, null), ('<|NUM|>', z)] || (case when ends then [('<|eos|>', null)] else [] end) as t from cn),
      cx as (select id, rn, unnest(t) as p, generate_subscripts(t, 1) as i from cl)
      select id, row_number() over (partition by id order by rn, i) - 1 as pos, voc.token, token_id, coalesce(round(p[2], 5) + 0.0::double, -99.0::double) as val from cx join voc on voc.token = p[1]"""
SLOPES = f"""with {_GAP_FIT.strip()} select 'numeric' as "group", count(*) as n, round(sum(log2(sqrt(var))), 3) as bits from cn
      union all select 'time', count(*), round(sum(log2(gx * sqrt(gs))), 3) from cn where dt > 0"""


TYPES = f"""{_encoded(True)} select case when token = '<|sos|>' then 'sos' when token = '<|eos|>' then 'eos' when token = '<|event|>' then 'class' when token like '<|delta%' then 'time_delta_fused' else 'fused_concept_Q' end as type, count(*) as n from z group by 1"""
CONTEXTS = f"""{_encoded(False)}, y as (select *, lag(token) over (partition by id order by pos) as before from z),
      k as (select case when token = '<|sos|>' then 'sos' when token = '<|eos|>' then 'eos' when token = '<|event|>' then 'class' when token like '<|delta%' then 'time_delta' when token like '<|Q%' then 'Q' else 'concept' end as type,
        case when token like '<|delta%' or before like '<|delta%' then 'time' when token like '<|Q%' then 'row' end as ctx_kind from y)
      select type, ctx_kind, case when ctx_kind is not null then 'bins' end as ctx_type, count(*) as n from k group by all"""
BPR = f"""{_encoded(False)}, y as (select *, (pos % 7 + 1)::double as bits from z where token <> '<|sos|>')
      select round(sum(bits) / n, 6) as bpr_raw, round(sum(bits) filter (where token = '<|eos|>') / n, 6) as eos_bpr, round(sum(bits) filter (where token = '<|event|>') / n, 6) as class_bpr,
        round(sum(bits) filter (where token not like '<|%') / n, 6) as text_bpr, round(count(*) / n, 6) as tokens_per_row, n as n_rows, 'width' as tail_mode
      from y, (select count(*) as n from z where token = '<|event|>') group by n"""

BYTES = f"""with c as (select unnest(regexp_extract_all(text, '{WORDS}')) as chunk from documents), n as (select chunk, count(*) as n, hex(encode(chunk)) as h from c group by chunk),
      p as (select n, h, unnest(range(len(h) // 2 - 1)) as i from n where len(h) >= 4)
      select ('0x' || substr(h, (i * 2 + 1)::int, 2))::int as "left", ('0x' || substr(h, (i * 2 + 3)::int, 2))::int as "right", sum(n)::bigint as n from p group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    few = f"(select class, text_value from {NUMBERS} group by class, text_value having count(distinct v) <= 10)"
    return {
        "text_mode_stats": f"select class, count(*) as n_texts, case when count(*) > 64 then 'bpe' else 'concept' end as mode from (select distinct class, text_value from {CLINICAL}) group by class",
        "numeric_group_stats": f"select class, text_value, count(distinct v) as n_distinct, count(*) as n from {NUMBERS} group by class, text_value",
        "level_tables": f"select n.class, n.text_value, (row_number() over (partition by n.class, n.text_value order by n.v) - 1)::int as level, n.v as value from (select distinct class, text_value, v from {NUMBERS}) n join {few} f on n.class = f.class and n.text_value is not distinct from f.text_value",
        "percentile_bounds": f"select class, text_value, round(quantile_cont(v, 0.01), 6) as low, round(quantile_cont(v, 0.99), 6) as high from {NUMBERS} group by class, text_value",
        "normal_params": _fit(["mean", "var"]),
        "lognormal_params": _fit(["mu", "sigma2"]),
        "gamma_params": _fit(["alpha", "beta"], ORDERS, 4),
        "minmax_params": _fit(["vmin", "vmax"]),
        "scaled_values": SCALED,
        "unscaled_values": "select o_orderkey as _src, round(o_totalprice, 2) as normal, round(o_totalprice, 2) as lognormal, round(o_totalprice, 2) as gamma, round(o_totalprice, 2) as minmax from orders",
        "digitized": DIGITIZED,
        "quantile_edges": QUANTILE_EDGES,
        "advice_scores": _advice(),
        "time_deltas": f"select id, gap_s from {GAPS} where gap_s > 0",
        "band_counts": f"select (case when gap_s <= 3600 then 0 when gap_s <= 86400 then 1 when gap_s <= 604800 then 2 else 3 end)::int as band, count(*) as n from {GAPS} where gap_s > 0 group by 1",
        "state_timeline": STATE,
        "age_tokens": AGES,
        "sos_eos_boundaries": BOUNDARIES,
        **{f"milestones_{k}": _milestones(k) for k in _KINDS},
        "concept_split_delim": "select _src, unnest([l_returnflag, l_linestatus]) as piece, unnest([0, 1])::int as i from (select *, l_orderkey * 100 + l_linenumber as _src from lineitem)",
        "concept_split_width": "select o_orderkey as _src, unnest([o_orderpriority[1], o_orderpriority[2], substr(o_orderpriority, 3)]) as piece, unnest([0, 1, 2])::int as i from orders",
        "class_fusion_tokens": "select l_orderkey * 100 + l_linenumber as _src, '<|line:' || l_returnflag || '|> line:' || l_linestatus as tokens, l_returnflag || '//' || l_linestatus as joined from lineitem",
        "vocab_special": SPECIAL,
        "encode_tokens_factored": IDS[False],
        "encode_tokens_fused": IDS[True],
        "encode_structure": STRUCTURE,
        "vocab_full": VOCABULARY,
        "encode_continuous": CONTINUOUS,
        "decode_values": DECODED,
        "density_widths": WIDTHS,
        "density_slopes": SLOPES,
        "encode_token_counts": f"{_encoded(False)} select token, count(*) as n from z group by token",
        "sequence_lengths": f"{_encoded(False)} select id, count(*) as n, sum((row_no < 0)::int)::bigint as n_edges from z group by id",
        "train_pairs": f"{_encoded(False)} select id, count(*) - 1 as n_x, count(*) - 1 as n_y from z group by id having count(*) >= 2",
        "row_idx_map": "select id, _src, row_number() over (order by id nulls first, time nulls first, _src) - 1 as row_idx from demo",
        "decode_roundtrip": "select id, row_number() over (partition by id order by time nulls first, _src) as k, class, text_value from demo where not coalesce(class = 'demographic' and text_value = 'birth_date', false)",
        "decode_levels": "select l_orderkey as id, l_returnflag || '//' || l_linestatus as text_value, l_quantity as numeric_value, count(*) as n from lineitem group by all",
        "token_type_counts": TYPES,
        "numeric_contexts": CONTEXTS,
        "bpr_groups": BPR,
        "meds_split": r"""with m as (select subject_id as id, code, contains(code, '//') as two from meds)
      select id, case when code = 'MEDS_BIRTH' then 'demographic' when two then lower(regexp_extract(code, '(?s)^(.*?)\s*//', 1)) else lower(code) end as class,
        case when code = 'MEDS_BIRTH' then 'birth_date' when two then regexp_replace(code, '(?s)^.*?\s*//\s*', '') end as text_value, count(*) as n from m group by all""",
        "bpe_chunk_bytes": "select sum(octet_length(encode(text)))::bigint as bytes, 3::bigint as longest_number from documents",
        "bpe_chunk_counts": f"select chunk, count(*) as n from (select unnest(regexp_extract_all(text, '{WORDS}')) as chunk from documents) group by chunk",
        "bpe_byte_pairs": BYTES,
        "bpe_roundtrip": "select doc_id, text from documents",
    }
