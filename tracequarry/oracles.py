"""DuckDB SQL with the results of the engine's queries, for those that SQL can express."""

from __future__ import annotations

from tracequarry.queries import PAIR, WEEK_FEATURES

DAY = "select 'EV_DAY' as log, user_id::varchar || '_' || ts::date::varchar as case_id, event_type as activity, ts, row_number() over (partition by user_id, ts::date order by ts, event_id) as pos from events"
WEEK = "select strftime(date_trunc('week', ts), '%Y-%m-%d') as log, user_id::varchar || '_' || ts::date::varchar as case_id, event_type as activity, ts, row_number() over (partition by user_id, ts::date order by ts, event_id) as pos from events"
CONV = "select 'CONV' as log, conv_id::varchar as case_id, role as activity, make_timestamp(turn * 1000000000) as ts, row_number() over (partition by conv_id order by turn, text) as pos from conversations"
ORD = "select 'ORD' as log, o_custkey::varchar as case_id, o_orderpriority as activity, o_orderdate as ts, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders"


def base(events: str) -> str:
    """Common table expressions: events, traces (with the variant as text) and variants."""
    return f"""with ev as ({events}),
    tr as (select log, case_id, count(*) as l, string_agg(activity, chr(31) order by pos) as v, arg_min(activity, pos) as a0, arg_max(activity, pos) as a1, min(ts) as t0 from ev group by log, case_id),
    va as (select log, v, count(*) as n, any_value(l) as l from tr group by log, v)"""


def xlnx(x: str) -> str:
    return f"(case when {x} > 0 then ({x}) * ln({x}) else 0 end)"


def stats(rows: str, names: dict[str, str]) -> str:
    """Moments and quantiles per log of ``rows`` (log, x): a select of the named statistics."""
    every = {
        "min": "min(x)::double", "max": "max(x)::double", "mean": "any_value(m)", "median": "quantile_cont(x, 0.5)::double", "std": "sqrt(avg(pow(x - m, 2)))", "variance": "avg(pow(x - m, 2))", "q1": "quantile_cont(x, 0.25)::double", "q3": "quantile_cont(x, 0.75)::double",
        "iqr": "quantile_cont(x, 0.75)::double - quantile_cont(x, 0.25)::double", "skewness": "case when avg(pow(x - m, 2)) > 0 then avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) end", "kurtosis": "case when avg(pow(x - m, 2)) > 0 then avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3 end",
    }
    picked = ", ".join(f"round({every[k]}, 6) as {name}" for k, name in names.items())
    return f"select log, {picked} from (select log, x, avg(x) over (partition by log) as m from ({rows})) group by log"


ALL = ("min", "max", "mean", "median", "std", "variance", "q1", "q3", "iqr", "skewness", "kurtosis")


def family(kind: str) -> str:
    counted = {"activities": "select log, activity, count(*) as x from ev group by 1, 2", "start_activities": "select log, a0, count(*) as x from tr group by 1, 2", "end_activities": "select log, a1, count(*) as x from tr group by 1, 2"}[kind]
    return f"{base(DAY)}, c as ({counted}), s as ({stats('select log, x from c', {k: f'{kind}_{k}' for k in ALL})}) select * from s join (select log, count(*) as n_unique_{kind} from c group by log) using (log)"


def simple(events: str) -> str:
    return f"{base(events)} select log, sum(n)::bigint as n_traces, count(*) as n_unique_traces, round(count(*) / sum(n), 6) as ratio_variants_per_number_of_traces from va group by log"


HIST = f"""{base(DAY)}, r as (select *, min(l) over w as lo, max(l) over w as hi, count(*) over w as n from tr window w as (partition by log)),
b as (select log, n, case when lo = hi then 0.1 else (hi - lo) / 10.0::double end as width, case when lo = hi then 5 else least(floor((l - lo) / ((hi - lo) / 10.0::double)), 9) end as bin from r),
h as (select log, {", ".join(f"sum(case when bin = {i} then 1 / (n * width) else 0 end) as h{i + 1}" for i in range(10))} from b group by log),
u as (select log, unnest([{", ".join(f"h{i + 1}" for i in range(10))}]) as x from h),
s as ({stats("select * from u", {"skewness": "trace_len_skewness_hist", "kurtosis": "trace_len_kurtosis_hist"})})
select log, {", ".join(f"round(h{i}, 6) as trace_len_hist{i}" for i in range(1, 11))}, trace_len_skewness_hist, trace_len_kurtosis_hist from h join s using (log)"""

LENGTHS = f"""{base(DAY)}, s as ({stats("select log, l as x from tr", {k: f"trace_len_{k}" for k in ALL})}),
m as (select log, arg_max(l, (n, -l))::double as trace_len_mode from (select log, l, count(*) as n from tr group by 1, 2) group by log),
e as (select log, round(case when min(l) = 0 then 0 else exp(avg(ln(l))) end, 6) as trace_len_geometric_mean, round(case when min(l) = 0 then 0 else exp(stddev_samp(ln(l))) end, 6) as trace_len_geometric_std,
  round(case when min(l) = 0 then 0 else count(*) / sum(1.0::double / l) end, 6) as trace_len_harmonic_mean, round(stddev_pop(l) / avg(l), 6) as trace_len_coefficient_variation,
  round(ln(sum(l)) - sum(l * ln(l)) / sum(l), 6) as trace_len_entropy from tr group by log)
select * from s join m using (log) join e using (log)"""

AUTOMATON = """, p as (select *, string_agg(activity, chr(31)) over w as pre from ev window w as (partition by log, case_id order by pos)),
q as (select p.*, coalesce(lag(pre) over (partition by log, case_id order by pos), '') as par, first_value(ts) over (partition by log, case_id order by pos) as t0 from p),
sp as (select log, min(ts) as lo, max(ts) as hi from ev group by log),
st as (select log, pre, any_value(par) as par, count(*) as n, any_value(pos) as pos, min((t0, case_id)) as seen from q group by log, pre),
hd as (select *, pos = 1 or row_number() over (partition by log, par order by seen) > 1 as opens from st),
pt as (select q.log, q.pre, q.ts, last_value(case when opens then hd.pre end ignore nulls) over (partition by q.log, q.case_id order by q.pos) as part from q join hd on q.log = hd.log and q.pre = hd.pre),
wt as (select pt.*, case when hi > lo then (epoch_us(hi) - epoch_us(ts)) / (epoch_us(hi) - epoch_us(lo))::double else 0 end as age from pt join sp using (log)),
ag as (select log, part, count(*) as n, count(distinct pre) as s, sum(1 - age) as wl, sum(exp(-age)) as we from wt group by log, part)"""


def automaton(events: str) -> str:
    value = lambda whole, part, by: f"{xlnx(f'sum({whole})')} - sum({xlnx(part)})"
    parts = {"epa_variant_entropy": ("s", "s", "s"), "epa_sequence_entropy": ("n", "n", "n"), "epa_sequence_entropy_linear_forgetting": ("wl", "greatest(wl, 1e-6)", "n"), "epa_sequence_entropy_exponential_forgetting": ("we", "we", "n")}
    out = []
    for name, (whole, part, by) in parts.items():
        out += [f"round({value(whole, part, by)}, 6) as {name}", f"round(({value(whole, part, by)}) / {xlnx(f'sum({by})')}, 6) as {name.replace('epa_', 'epa_normalized_')}"]
    return f"{base(events)}{AUTOMATON} select log, {', '.join(out)} from ag group by log"


def entropy(rows: str, name: str) -> str:
    """Entropy in bits per log of counts (log, n)."""
    return f"select log, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2), 6) as {name} from ({rows}) group by log"


PREFIX = f"""{base(DAY)}, one as (select log, v, min(case_id) as case_id from tr group by log, v),
p as (select ev.*, string_agg(activity, chr(31)) over (partition by log, case_id order by pos) as pre from ev),
a as ({entropy("select log, pre, count(*) as n from p group by 1, 2", "eventropy_prefix")}),
b as ({entropy("select p.log, pre, count(*) as n from p join one on p.log = one.log and p.case_id = one.case_id group by 1, 2", "eventropy_prefix_flattened")})
select * from a join b using (log)"""

GRAMS = f"""{base(DAY)}, g as (select log, k, gram, count(*) as n from (select ev.log, k, string_agg(activity, chr(31)) over (partition by ev.log, case_id, k order by pos rows between 4 preceding and current row) as tail, pos, activity, case_id,
  array_to_string(list(activity) over (partition by ev.log, case_id, k order by pos rows between 4 preceding and current row)[-k:], chr(31)) as gram from ev, range(1, 6) r(k)) where pos >= k group by 1, 2, 3),
h as (select log, k, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2) as h from g group by 1, 2),
w as (select log, {", ".join(f"coalesce(max(case when k = {k} then h end), 0) as h{k}" for k in range(1, 6))} from h group by log)
select log, round(h1, 6) as eventropy_k_block_ratio_1, round(h1, 6) as eventropy_k_block_diff_1, round(h3 / 3, 6) as eventropy_k_block_ratio_3, round(h3 - h2, 6) as eventropy_k_block_diff_3, round(h5 / 5, 6) as eventropy_k_block_ratio_5, round(h5 - h4, 6) as eventropy_k_block_diff_5 from w"""

BLOCKS = f"""{base(DAY)}, t as (select log, any_value(n) as n, acts from (select va.log, va.n, string_split(va.v, chr(31)) as acts from va) group by log, acts),
b as (select log, n, array_to_string(acts[i:j], chr(31)) as block from t, range(1, 200) a(i), range(1, 200) c(j) where i <= len(acts) and j >= i and j <= len(acts)),
x as ({entropy("select log, block, sum(n) as n from b group by 1, 2", "eventropy_global_block")}),
y as ({entropy("select log, block, count(*) as n from b group by 1, 2", "eventropy_global_block_flattened")})
select * from x join y using (log)"""

WEEKS = f"""{base(WEEK)}, wf as (select log, ratio_variants_per_number_of_traces, ratio_most_common_variant, trace_len_mean, trace_len_std, eventropy_trace
  from (select log, count(*) / sum(n) as ratio_variants_per_number_of_traces, max(n) / sum(n) as ratio_most_common_variant, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2) as eventropy_trace from va group by log)
  join (select log, avg(l) as trace_len_mean, stddev_pop(l) as trace_len_std from tr group by log) using (log)),
wt as (select strftime(log::date + 7, '%Y-%m-%d') as log, {PAIR[0]}, case when {PAIR[1]} >= 0.01 then {PAIR[1]} end as {PAIR[1]}, {", ".join(WEEK_FEATURES[2:])} from wf)"""


def long(table: str) -> str:
    return f"select log, feature, value from (unpivot {table} on {', '.join(WEEK_FEATURES)} into name feature value value) where value is not null"


COMMON = f"{WEEKS}, lf as ({long('wf')}), lt as ({long('wt')}), cm as (select lt.log, lt.feature, lt.value as target, lf.value as achieved from lt join lf on lt.log = lf.log and lt.feature = lf.feature)"
KEPT = f"{WEEKS}, kt as (select * from wt where {PAIR[0]} is not null and {PAIR[1]} is not null), km as (select * from wf where log not in (select log from wt where {PAIR[0]} is null or {PAIR[1]} is null)), f1 as (select * from kt order by log limit 1)"
DISTANCES = f"""{KEPT}, ds as (select km.log, coalesce(kt.{PAIR[0]}, f1.{PAIR[0]}) as x, coalesce(kt.{PAIR[1]}, f1.{PAIR[1]}) as y,
  sqrt(pow(km.{PAIR[0]} - coalesce(kt.{PAIR[0]}, f1.{PAIR[0]}), 2) + pow(km.{PAIR[1]} - coalesce(kt.{PAIR[1]}, f1.{PAIR[1]}), 2)) as distance from km cross join f1 left join kt on km.log = kt.log)"""
PAIRS = f"{COMMON}, pd as (select a.feature as feat1, b.feature as feat2, a.log, sqrt(pow(a.target - a.achieved, 2) + pow(b.target - b.achieved, 2)) as distance from cm a join cm b on a.log = b.log and a.feature < b.feature)"


def rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


ORACLES = {
    "event_log_traces": f"{base(DAY)} select log, case_id, l as n_events, a0 as first_activity, a1 as last_activity, epoch_us(t0) as first_us from tr",
    "event_positions": f"{base(DAY)} select case_id, pos, activity, pos * 1000 as clock from ev",
    "simple_stats": simple(DAY),
    "simple_stats_conversations": simple(CONV),
    "simple_stats_customers": simple(ORD),
    "trace_length_counts": f"{base(DAY)} select log, l as length, count(*) as n from tr group by 1, 2",
    "trace_length_stats": LENGTHS,
    "trace_length_hist": HIST,
    "variant_counts": f"{base(CONV)} select log, l as n_events, n, count(*) as n_variants from va group by 1, 2, 3",
    "variant_stats": f"{base(DAY)}, s as ({stats('select log, n as x from va', {k: f'{k}_variant_occurrence' for k in ('mean', 'std', 'skewness', 'kurtosis')})}) select * from s join (select log, round(max(n) / sum(n), 6) as ratio_most_common_variant from va group by log) using (log)",
    "ratio_top_variants": f"{base(DAY)}, r as (select log, n, row_number() over (partition by log order by n desc) as rn, count(*) over (partition by log) as v from va) select log, " + ", ".join(f"round(coalesce(sum(case when rn <= (v * {p}) // 100 then n end), 0) / sum(n), 6) as ratio_top_{p}_variants" for p in (1, 5, 10, 20, 50, 75)) + " from r group by log",
    "activity_counts": f"{base(DAY)} select log, activity, count(*) as n from ev group by 1, 2",
    "activities_stats": family("activities"),
    "start_activities_stats": family("start_activities"),
    "end_activities_stats": family("end_activities"),
    "epa_states": f"{base(DAY)}{AUTOMATON} select log, pos as depth, count(*) as states, sum(n)::bigint as events, count_if(opens)::bigint as openings from hd group by 1, 2",
    "epa_partitions": f"{base(DAY)}{AUTOMATON} select log, s as states, n as events, count(*) as n from ag group by 1, 2, 3",
    "epa_entropy": automaton(DAY),
    "epa_entropy_conversations": automaton(CONV),
    "eventropy_trace": f"{base(DAY)} {entropy('select log, n from va', 'eventropy_trace')}",
    "eventropy_prefix": PREFIX,
    "eventropy_k_block": GRAMS,
    "eventropy_global_block": BLOCKS,
    "feature_table_weeks": f"{WEEKS} select log, {rounded(WEEK_FEATURES)} from wf",
    "feature_table_long": f"{COMMON} select log, feature, round(value, 6) as value from lf",
    "feature_table_pivot": f"{WEEKS} select log, {rounded(WEEK_FEATURES)} from wf",
    "target_similarity": f"{COMMON} select l.log, round(s, 6) as target_similarity from (select distinct log from lt) l left join (select log, 1 / (1 + sqrt(sum(pow(target - achieved, 2)))) as s from cm group by log) c on l.log = c.log",
    "objective_abs_error": f"{COMMON} select log, feature, round(abs(target - achieved), 6) as error from cm",
    "scalar_cost": f"{COMMON} select log, round(avg(abs(target - achieved)), 6) as cost from cm group by log",
    "first_match_fallback_join": f"{WEEKS}, f1 as (select {PAIR[0]} as f from wt order by log limit 1) select wf.log, round(wf.{PAIR[0]}, 6) as {PAIR[0]}, round(wf.{PAIR[1]}, 6) as {PAIR[1]}, round(case when wt.log is not null then wt.{PAIR[0]} else f end, 6) as right_{PAIR[0]} from wf cross join f1 left join wt on wf.log = wt.log",
    "anti_filter_nulls": f"{KEPT} select log, {rounded(PAIR)} from km",
    "merge_outer": f"{WEEKS} select coalesce(wf.log, wt.log) as log, round(wf.{PAIR[0]}, 6) as achieved, round(wt.{PAIR[0]}, 6) as target from wf full join wt on wf.log = wt.log",
    "cumulated_distance": f"{DISTANCES} select 'rvpnot_rmcv' as pair, round(sum(distance), 6) as cumulated_distance, count(*) as n from ds",
    "distance_grid": f"""{DISTANCES}, e as (select min(x) as x0, min(y) as y0, round((max(x) - min(x)) / 10, 4) as dx, round((max(y) - min(y)) / 10, 4) as dy from ds),
        c as (select case when dx > 0 then round_even((x - x0) / dx, 0) else 0 end::int as i, case when dy > 0 then round_even((y - y0) / dy, 0) else 0 end::int as j, distance from ds cross join e),
        m as (select i, j, count(*) as n, avg(distance) as value from c group by 1, 2)
        select f.i::int as i, g.j::int as j, coalesce(n, 0)::bigint as n, round(coalesce(value, sqrt(2)), 6) as value from range(0, 11) f(i) cross join range(0, 11) g(j) left join m on m.i = f.i and m.j = g.j""",
    "distinct_value_grid": f"""{DISTANCES}, r as (select log, round(x, 1) as x, round(y, 2) as y, distance from ds),
        a as (select x, (row_number() over (order by min(log)) - 1)::int as i from r group by x), b as (select y, (row_number() over (order by min(log)) - 1)::int as j from r group by y)
        select i, j, count(*) as n, round(avg(distance), 6) as value from r join a using (x) join b using (y) group by 1, 2""",
    "distance_matrix": f"{PAIRS}, m as (select feat1, feat2, avg(distance) as value from pd group by 1, 2) select feat1, feat2, round(value, 6) as value from m union all select feat2, feat1, round(value, 6) from m",
    "instance_selection": f"{PAIRS} select feat1, feat2, log, round(distance, 6) as distance from pd where distance < 0.1",
    "distance_histogram": f"""{DISTANCES}, e as (select case when min(distance) = max(distance) then min(distance) - 0.5 else min(distance) end as lo, case when min(distance) = max(distance) then max(distance) + 0.5 else max(distance) end as hi from ds),
        b as (select least(floor((distance - lo) * 30 / (hi - lo)), 29)::int as bin, count(*) as n from ds cross join e group by 1)
        select r.bin::int as bin, round(lo + r.bin * (hi - lo) / 30, 6) as low, round(lo + (r.bin + 1) * (hi - lo) / 30, 6) as high, coalesce(n, 0)::bigint as n from range(0, 30) r(bin) cross join e left join b on b.bin = r.bin""",
    "feature_box_stats": f"{COMMON} select source, feature, count(*) as n, " + ", ".join(f"round(quantile_cont(value, {p}), 6) as {c}" for p, c in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high"))) + " from (select 'Real' as source, * from lt union all select 'Generated', * from lf) group by 1, 2",
    "feature_ranges": f"{COMMON} select feature, count(*) as n, round(min(value), 6) as low, round(max(value), 6) as high, round(avg(value), 6) as mean from lf group by 1",
    "unit_range_features": f"{COMMON} select feature from lf group by feature having min(value) >= 0 and max(value) <= 1",
    "objective_pairs": "with f as (select unnest([" + ", ".join(f"'{f}'" for f in WEEK_FEATURES) + "]) as x) select a.x as feat1, b.x as feat2 from f a join f b on a.x < b.x",
    "value_grid": "select 'task_' || (i * 11 + j + 1)::varchar as task, round(i * 0.1::double, 6) as v1, round(j * 0.1::double, 6) as v2 from range(0, 11) a(i), range(0, 11) b(j)",
    "range_grid": f"{WEEKS}, p as (select [min({PAIR[0]}), avg({PAIR[0]}), max({PAIR[0]})] as a, [min({PAIR[1]}), avg({PAIR[1]}), max({PAIR[1]})] as b from wf) select 'task_' || (3 * i + j + 1)::varchar as task, round(a[i + 1], 6) as v1, round(b[j + 1], 6) as v2 from p, range(0, 3) x(i), range(0, 3) y(j)",
    "key_abbreviation": "select event_type || '_' || f as name, array_to_string(list_transform(string_split(event_type || '_' || f, '_'), lambda t: t[1] || regexp_replace(t[2:], '[^0-9]', '', 'g')), '') as short from (select distinct event_type from events), (select unnest([" + ", ".join(f"'{f}'" for f in WEEK_FEATURES) + "]) as f)",
    "natural_sort": "select 'Log_' || n_nationkey::varchar as name, row_number() over (order by n_nationkey)::int as place from nation",
    "output_key": f"{WEEKS} select log, '2_rmcv_rvpnot' as folder, log || '_' || replace(round({PAIR[1]}, 4)::varchar, '.', '') || '_' || replace(round({PAIR[0]}, 4)::varchar, '.', '') as name from wf",
    "impute_mean": f"{WEEKS} select log, round({PAIR[0]}, 6) as {PAIR[0]}, round(coalesce({PAIR[1]}, avg({PAIR[1]}) over ()), 6) as {PAIR[1]} from wt",
    "standardize": f"{WEEKS} select log, " + ", ".join(f"round(case when stddev_pop({c}) over () > 0 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end, 6) as {c}" for c in WEEK_FEATURES) + " from wf",
    "l2_normalize": f"{WEEKS} select log, " + ", ".join(f"round({c} / sqrt({' + '.join(f'pow({d}, 2)' for d in WEEK_FEATURES)}), 6) as {c}" for c in WEEK_FEATURES) + " from wf",
    "config_space": "select * from (values ('mode', 5.0::double, 40.0::double, true, false), ('sequence', 0.01, 1.0, false, false), ('choice', 0.01, 1.0, false, false), ('parallel', 0.01, 1.0, false, false), ('loop', 0.01, 1.0, false, false), ('silent', 0.01, 1.0, false, false), ('lt_dependency', 0.01, 1.0, false, false), ('num_traces', 100.0, 1001.0, true, false), ('duplicate', 0.0, 0.0, false, true), ('or', 0.0, 0.0, false, true)) t(param, lo, hi, is_int, is_const)",
    "stream_event_counts": "select epoch(date_trunc('day', ts))::bigint as window_start, event_type, count(*) as n from events group by 1, 2",
    "stream_case_prefixes": "select user_id::varchar || '_' || ts::date::varchar as case_id, count(*) as n_events, string_agg(event_type, '>' order by ts, event_id) as prefix from events group by 1",
}

PARTS = "select 'part ' || (conv_id % 5)::varchar as log, conv_id::varchar as case_id, role as activity, make_timestamp(turn * 1000000000) as ts, row_number() over (partition by conv_id order by turn, role) as pos from conversations"
TARGETS = f"{WEEKS} select log, {rounded(WEEK_FEATURES)} from wt"
SHORT = lambda x: f"array_to_string(list_transform(string_split({x}, '_'), lambda t: t[1] || regexp_replace(t[2:], '[^0-9]', '', 'g')), '')"
FAMILIES = ("simple_stats", "trace_length_stats", "trace_length_hist", "variant_stats", "ratio_top_variants", "activities_stats", "start_activities_stats", "end_activities_stats", "epa_entropy", "eventropy_trace", "eventropy_prefix", "eventropy_k_block", "eventropy_global_block")
CUSTOMERS = "with a as (select c_custkey::varchar as log, c_acctbal / 10000 as a, case when c_custkey % 3 <> 0 then c_nationkey / 25 end as b from customer), t as (select (log::bigint + 1)::varchar as log, a, b from a)"

CODES = "code as (select activity, chr(64 + row_number() over (order by activity)::int) as c from (select distinct activity from ev))"


def neighbours(events: str) -> str:
    """Edit distances of all pairs of variants, each activity a letter; a variant's copies are at distance 0."""
    return f"""{base(events)}, {CODES},
        cs as (select log, w, count(*) as n from (select log, case_id, string_agg(c, '' order by pos) as w from ev join code using (activity) group by log, case_id) group by log, w),
        ds as (select a.log, a.w, a.n, case when a.w = b.w then 0 else levenshtein(a.w, b.w) end as d, sum(case when a.w = b.w then b.n - 1 else b.n end) as m from cs a join cs b on a.log = b.log group by 1, 2, 3, 4),
        cu as (select *, sum(m) over (partition by log, w order by d) as upto, (select sum(n) from cs t where t.log = ds.log) as total from ds),
        nn as (select log, w, any_value(n) as n, any_value(total) as total, {", ".join(f"min(case when upto >= {k} then d end) as d{k}" for k in (3, 5, 7))} from cu group by log, w)
        select log, {", ".join(f"round(sum(coalesce(n * log2(total * d{k} / {k} + 1), 0)) / any_value(total), 6) as eventropy_knn_{k}" for k in (3, 5, 7))} from nn group by log"""


def lempel_ziv(events: str) -> str:
    """The parsing phrase by phrase: each is the shortest text (of up to 60 letters) that none before it is."""
    return f"""{base(events).replace("with ev as", "with recursive ev as", 1)}, {CODES},
        ws as (select log, case_id, string_agg(c, '' order by pos) as w from ev join code using (activity) group by log, case_id),
        os as (select ws.log, w, t0, case_id, row_number() over (partition by ws.log, w order by t0, case_id) as nth from ws join tr using (log, case_id)),
        s as (select log, 'every' as kind, string_agg(w, '' order by t0, case_id) as w from os group by log union all select log, 'flat', string_agg(w, '' order by t0, case_id) from os where nth = 1 group by log),
        p as (select log, kind, w, 1 as here, []::varchar[] as known, 0 as n from s
            union all select log, kind, w, here + size, list_append(known, w[here:here + size - 1]), n + 1 from (select *, 1 + len(list_filter(range(1, 60), lambda l: list_contains(known, w[here:here + l - 1]) and here + l <= length(w))) as size from p where here <= length(w))),
        q as (select log, kind, max(n) * log2(any_value(length(w))) / any_value(length(w)) as rate from p group by log, kind)
        select log, round(max(case when kind = 'every' then rate end), 6) as eventropy_lempel_ziv, round(max(case when kind = 'flat' then rate end), 6) as eventropy_lempel_ziv_flattened from q group by log"""


def iterated(matrix: str, source: str) -> str:
    """2,000 steps of the power method: the first eigenvector ``v`` of a 5 x 5 matrix (a list of rows), its largest entry positive."""
    times = f"list_transform(range(1, 6), lambda i: list_sum(list_transform(range(1, 6), lambda j: {matrix}[i][j] * v[j])))"
    return f"""(select list_transform(v, lambda e: e * sign(list_filter(v, lambda g: abs(g) = list_max(list_transform(v, lambda h: abs(h))))[1])) as v from (
        with recursive it as (select 0 as t, [0.5, 0.4, 0.3, 0.2, 0.1]::double[] as v, {matrix} from {source}
            union all select t + 1, list_transform(u, lambda e: e / sqrt(list_sum(list_transform(u, lambda g: g * g)))), {matrix} from (select t, {times} as u, {matrix} from it where t < 2000))
        select v from it where t = 2000))"""


SCALED = ", ".join(f"case when stddev_pop({c}) over () > 0 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end" for c in WEEK_FEATURES)
COMPONENTS = f"""{WEEKS}, z as (select log, [{SCALED}] as x from wf),
    c as (select [{", ".join("[" + ", ".join(f"avg(x[{i}] * x[{j}])" for j in range(1, 6)) + "]" for i in range(1, 6))}] as c from z),
    e1 as (select c, v as p1 from c cross join {iterated("c", "c")}),
    e2 as (select c, p1, list_sum(list_transform(range(1, 6), lambda i: p1[i] * list_sum(list_transform(range(1, 6), lambda j: c[i][j] * p1[j])))) as l from e1),
    f as (select p1, list_transform(range(1, 6), lambda i: list_transform(range(1, 6), lambda j: c[i][j] - l * p1[i] * p1[j])) as c2 from e2),
    d as (select p1, v as p2 from f cross join {iterated("c2", "f")})"""

ORACLES |= {
    # sources and sinks: the tables that go through files
    "xes_round_trip": f"{base(PARTS)} select log, case_id, pos, activity, epoch(ts)::bigint as second from ev",
    "xes_files": f"{base(PARTS)} select log || '.xes' as file, 3::bigint as extensions, 2::bigint as defaults, count(*) as traces, sum(l)::bigint as events from tr group by log",
    "trace_numbers": f"{base(PARTS)} select log, case_id, row_number() over (partition by log order by t0, case_id)::int as trace_idx from tr",
    "feature_extraction_of_files": f"{base(PARTS)} select log, sum(n)::double as n_traces, count(*)::double as n_unique_traces, round(count(*) / sum(n), 6) as ratio_variants_per_number_of_traces, round(sum(n * l) / sum(n), 6) as trace_len_mean from va group by log",
    "csv_features": f"{WEEKS} select log, {rounded(WEEK_FEATURES)} from wf",
    "json_features": TARGETS,
    "json_lines_features": f"{WEEKS} select log, {rounded(PAIR)} from wf union all select 'again ' || log, {rounded(PAIR)} from wf",
    "json_to_csv": TARGETS,
    "file_listing": f"{WEEKS} select log || '.json' as file from wf",
    "merge_csv_files": ORACLES["merge_outer"],
    "tasks_of_a_file": f"{WEEKS} select log, {rounded(PAIR)} from wt",
    "tasks_of_a_folder": f"{WEEKS} " + " union all ".join(f"select '{f}' as competitor, log, round({PAIR[0]}, 6) as reference, round({f}, 6) as value from wt" for f in WEEK_FEATURES[1:]),
    "tasks_with_objectives": f"{WEEKS} select log, round({PAIR[1]}, 6) as {PAIR[1]} from wt",
    "tasks_inline": "select * from (values ('1', 0.2::double, 4.0::double), ('2', 0.5, null)) t(log, ratio_most_common_variant, mean_variant_occurrence)",
    "unknown_task_source": "select * from (values ('nowhere.txt', 'ValueError'), ('[]', 'ValueError'), ('[1]', 'ValueError'), ('5', 'ValueError')) t(source, error)",
    "experiment_files": "with f as (select unnest([" + ", ".join(f"'{f}'" for f in WEEK_FEATURES) + f"]) as x), p as (select a.x as feat1, b.x as feat2 from f a join f b on a.x < b.x where a.x in ('{PAIR[0]}', '{PAIR[1]}')) select 'grid_2objectives_' || {SHORT('feat1')} || '_' || {SHORT('feat2')} || '.json' as file, feat1, feat2, 'task_' || (3 * i + j + 1)::varchar as log, i * 0.5::double as v1, j * 0.5::double as v2 from p, range(0, 3) x(i), range(0, 3) y(j)",
    "distance_matrix_of_files": f"""{WEEKS}, b as (select wf.log, {", ".join(f"wf.{f} as w_{f}, wt.{f} as t_{f}" for f in (*PAIR, WEEK_FEATURES[4]))} from wf join wt on wf.log = wt.log),
        m as ({" union all ".join(f"select '{a}' as feat1, '{b}' as feat2, avg(sqrt(pow(w_{a} - t_{a}, 2) + {0 if a == b else f'pow(w_{b} - t_{b}, 2)'})) as value from b" for a, b in ((PAIR[1], PAIR[0]), (WEEK_FEATURES[4], PAIR[0]), (PAIR[0], PAIR[0])))})
        select feat1, feat2, round(value, 6) as value from m union all select feat2, feat1, round(value, 6) from m where feat1 <> feat2""",
    "instance_copies": f"{WEEKS} select 'made_' || log || '.json' as file from wf where {PAIR[0]} < 0.9",
    "pipeline_of_a_config": f"{COMMON} select wf.log, round(wf.{PAIR[0]}, 6) as reloaded, round(wf.{PAIR[0]}, 6) as extracted, round(s, 6) as target_similarity from wf left join (select log, 1 / (1 + sqrt(sum(pow(target - achieved, 2)))) as s from cm group by log) c on wf.log = c.log",
    "suffix_numbers": "select lower(n_name) || '_el_' || n_nationkey || '.xes' as file, n_nationkey::int as number from nation",
    "wrapped_text": "select item_id, regexp_replace(text, '(.{140})', '\\1' || chr(10), 'g') as text from benchmark",
    "numeric_columns": "select c_name as log, c_custkey, c_nationkey, round(c_acctbal, 6) as c_acctbal from customer",
    "rows_above_mean": f"{WEEKS} select log, {rounded(PAIR)} from wf where {PAIR[0]} > {PAIR[1]} and trace_len_mean > 1",
    "numbered_tasks": f"{WEEKS} select log, round({PAIR[0]}, 6) as {PAIR[0]}, 'task_' || row_number() over (order by {PAIR[0]}, log)::varchar as task from wf",
    "instances_near_targets": f"{CUSTOMERS} select a.log, round(abs(t.a - a.a), 6) as distance from a join t on a.log = t.log where abs(t.a - a.a) < 0.1",
    "customer_similarity": f"{CUSTOMERS} select t.log, round(1 / (1 + sqrt(pow(t.a - a.a, 2) + coalesce(pow(t.b - a.b, 2), 0))), 6) as target_similarity from t left join a on a.log = t.log",
    "first_match_of_targets": f"{WEEKS}, f1 as (select {PAIR[0]} as f from wf order by log limit 1) select wt.log, {', '.join(f'round(wt.{p}, 6) as {p}' for p in PAIR)}, round(case when wf.log is not null then wf.{PAIR[0]} else f end, 6) as right_{PAIR[0]} from wt cross join f1 left join wf on wf.log = wt.log",
    # features and hulls
    "feature_table_families": "select * from " + " join ".join(f"({ORACLES[f]}) {f}" + (" using (log)" if k else "") for k, f in enumerate(FAMILIES)),
    "eventropy_knn": neighbours(CONV),
    "eventropy_lempel_ziv": lempel_ziv(DAY),
    "feature_table_wide": "select * from " + " join ".join(f"({sql}) t{k}" + (" using (log)" if k else "") for k, sql in enumerate((*(ORACLES[f] for f in FAMILIES), lempel_ziv(DAY), neighbours(DAY)))),
    "pca_2d": f"{COMPONENTS} select log, {', '.join(f'round(list_sum(list_transform(range(1, 6), lambda i: p{k}[i] * x[i])), 6) as pc{k}' for k in (1, 2))} from z cross join d",
    "pca_weights": f"{COMPONENTS} select f[i] as feature, round(p1[i], 6) as pc1, round(p2[i], 6) as pc2 from d, range(1, 6) r(i), (select [{', '.join(chr(39) + f + chr(39) for f in WEEK_FEATURES)}] as f)",
    "convex_hull": f"""{WEEKS}, pts as (select distinct source, x, y from (select 'Real' as source, {PAIR[0]} as x, {PAIR[1]} as y from wt union all select 'Generated', {PAIR[0]}, {PAIR[1]} from wf) where x is not null and y is not null),
        co as (select p.source, p.x, p.y from pts p join pts q on p.source = q.source join pts r on p.source = r.source where p.x <> q.x or p.y <> q.y group by p.source, p.x, p.y, q.x, q.y
            having bool_and((r.x = p.x and r.y = p.y) or (r.x = q.x and r.y = q.y) or (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0
                or ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 and (q.x - p.x) * (r.x - p.x) + (q.y - p.y) * (r.y - p.y) > 0 and pow(r.x - p.x, 2) + pow(r.y - p.y, 2) < pow(q.x - p.x, 2) + pow(q.y - p.y, 2)))),
        an as (select distinct source, x, y, atan2(y - avg(y) over s, x - avg(x) over s) as a from (select distinct * from co) window s as (partition by source)),
        st as (select source, arg_min(a, (x, y)) as a0 from an group by source)
        select source, (row_number() over (partition by source order by case when a < a0 then a + 2 * pi() else a end) - 1) as corner, round(x, 6) as {PAIR[0]}, round(y, 6) as {PAIR[1]} from an join st using (source)""",
    "play_out_laws": "select * from (values ('trial_0', 1500.0::double, 6.0::double, 6.0::double, 6.0::double, 1::bigint, 0::bigint, true), ('trial_1', 1500.0, 1.0, 1.0, 6.0, 1, 0, false), ('trial_2', 1500.0, 6.0, 6.0, 6.0, 1, 0, false)) t(log, n_traces, trace_len_min, trace_len_max, n_unique_activities, repeats, clock_off, one_variant)",
    "search_of_known_targets": "select 'r0_' || i::varchar as log, 0.0::double as cost, 1.0::double as target_similarity from range(0, 4) t(i)",
    # streams
    "stream_sliding_counts": "select (epoch_us(ts) // 21600000000 - k) * 21600 as window_start, event_type, count(*) as n from events, range(0, 4) r(k) group by 1, 2",
    "stream_sessions": "with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), b as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from a) select epoch_us(min(ts)) as session_start, epoch_us(max(ts)) + 21600000000 as session_end, user_id, count(*) as n from b group by user_id, s",
    "stream_decayed_sums": "select event_type, count(*)::bigint as n, round(sum(exp((epoch_us(ts) - (select epoch_us(max(ts)) from events)) / 86400000000.0::double)), 6) as weight from events group by event_type",
    "stream_replay": simple(DAY),
}
