"""The same results in DuckDB's SQL, where SQL can express them."""

from eventloom.llm.percentiles import KEPT, PERMILLE
from eventloom.llm.splits import SHARES

DISTINCT = "select distinct id, time, class, text_value, numeric_value from demo"


USABLE = "numeric_value is not null and not isnan(numeric_value)"


def _within(by: str, counters: str) -> str:
    names = ", ".join(f"('{n}')" for n in PERMILLE)
    return f"""
        with d as ({DISTINCT} where {USABLE}), g as (select {by}, count(*) as n, {counters} as counters from d group by {by})
        select {by}, percentile, n, counters, true as within from g, (values {names}) p(percentile)"""


DAYS = f"""
    with d as ({DISTINCT} where {USABLE})
    select class, count(*) as n, true as days_equal, count(*) filter (where coalesce(id, 0) % 2 <> 0) as n_left, true as deletion_equal
    from d group by class having count(*) filter (where coalesce(id, 0) % 2 <> 0) > 0"""


TERMS = f"""
    with d as ({DISTINCT} where text_value is not null),
    per as (select class, text_value, count(*) as k from d group by class, text_value),
    runs as (select class, k, text_value, unnest(regexp_extract_all(lower(text_value), '[\\p{{L}}\\p{{N}}]+')) as term from per),
    kept as (select class, text_value, k, term, count(*) as m from runs where length(term) > 1 and regexp_matches(term, '^\\p{{L}}') group by all),
    counts as (select class, term, sum(k * m)::bigint as occurrences, sum(k)::bigint as records from kept group by class, term),
    total as (select class, sum(k) as n from per group by class)
    select c.class, c.term, c.occurrences, c.records,
      case when c.records > 0.25 * t.n then 'common' when c.records <= 2 then 'rare' end as mark
    from counts c join total t on c.class is not distinct from t.class"""

GROUPS = """
    with recursive named as (
      select id as a, try_cast(unnest(regexp_extract_all(text_value, '[0-9]+')) as bigint) as b from demo where class = 'demographic'),
    one_way as (select id_a as a, id_b as b from id_links where status = 'active' union all select a, b from named),
    e as (select distinct a, b from (select a, b from one_way union all select b, a from one_way) where a is not null and b is not null and a <> b),
    walk as (select distinct a as id, a as seen from e union select w.id, e.b from walk w join e on w.seen = e.a),
    groups as (select id, min(seen) as group_id from walk group by id)"""


def _splits() -> str:
    draw = lambda name, share: f"-ln((('0x' || substr(md5(':{name}:' || group_id), 1, 12))::bigint + 0.5) / 281474976710656.0::double) / {share}.0::double"
    rows = " union all ".join(f"select id, group_id, '{n}' as split, {draw(n, s)} as d from k" for n, s in SHARES.items())
    return f"""{GROUPS},
    k as (select i.id, coalesce(g.group_id, i.id) as group_id from (select distinct id from demo where id is not null) i left join groups g on i.id = g.id),
    drawn as ({rows})
    select id, group_id, arg_min(split, d) as split from drawn group by id, group_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_within": _within("class, text_value", f"count(distinct numeric_value) > {KEPT}"),
        "p1_sketched": _within("class", "true"),
        "p1_days": DAYS,
        "p4_found": f"select class, term, mark from ({TERMS}) where mark is not null",
        "p4_terms": TERMS,
        "p6_found": f"{GROUPS} select group_id, id from groups where id <> group_id",
        "p6_splits": _splits(),
        "p9_cover": "select container_kind, doc_id, text is null as unplaced, true as whole, true as fits from documents, (select distinct container_kind from containers)",
        "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }
