"""Relational bar queries, declared once and run by Spark's SQL.

Each plan reads {bars} (four-hour bars: symbol, t, o, h, l, c, v) and gives rows whose value at t depends on
bars that closed by then, but for outcomes and labels. All windows are partitioned by symbol.
"""

from __future__ import annotations

import re

from . import pattern_plans

_RET = "select *, case when lag(c) over s > 0 and c > 0 then ln(c / lag(c) over s) end as r, row_number() over s as n from {bars} window s as (partition by symbol order by t)"
_PIVOT = """select symbol, t, h, l, lead(t, 3) over s as known_t, count(*) over w as n,
    max(h) over (partition by symbol order by t rows between 3 preceding and 1 preceding) as hb, max(h) over (partition by symbol order by t rows between 1 following and 3 following) as ha,
    min(l) over (partition by symbol order by t rows between 3 preceding and 1 preceding) as lb, min(l) over (partition by symbol order by t rows between 1 following and 3 following) as la
    from {bars} window s as (partition by symbol order by t), w as (partition by symbol order by t rows between 3 preceding and 3 following)"""
_PIVOTS = f"""select symbol, t, known_t, h as price, 'high' as kind from ({_PIVOT}) p where n = 7 and h > hb and h > ha
    union all select symbol, t, known_t, l as price, 'low' as kind from ({_PIVOT}) p where n = 7 and l < lb and l < la"""
_DRIFT = f"select symbol, t, n, c, case when n >= 21 then avg(r) over (partition by symbol order by t rows between 18 preceding and current row) end as d from ({_RET}) q"
_GRID = "select symbol, t, c, n from (select *, row_number() over (partition by symbol order by t) as n from {bars}) g"
_PAIRS = "select a.symbol as sym, b.symbol as other, a.t as t, a.c as ac, b.c as bc from {bars} a join {bars} b on a.t = b.t where a.symbol = (select min(symbol) from {bars}) and b.symbol <> a.symbol"
_PRET = f"select *, case when ac > 0 and lag(ac) over s > 0 then ln(ac / lag(ac) over s) end as ar, case when bc > 0 and lag(bc) over s > 0 then ln(bc / lag(bc) over s) end as br from ({_PAIRS}) q window s as (partition by other order by t)"

PLANS = {
    "f2_visible_as_of": "select symbol, t, round(c, 6) as c from {bars} where t + 14400 <= 1705276800",
    "f7_period_end": "select symbol, t, t + 14400 as period_end from {bars}",
    "f10_availability": "select symbol, max(t) as last_open, max(t) + 14400 as known_at, count(*) as closed_bars from {bars} group by symbol",
    "f13_duplicates": "select symbol, t, count(*) as copies, case when count(distinct c) > 1 then 1 else 0 end as conflict from (select symbol, t, c from {bars} union all select symbol, t, case when v > 20 then c + 1 else c end from {bars} where v > 15) q group by symbol, t having count(*) > 1",
    "f14_ohlc_violations": "select symbol, t, concat_ws('; ', case when h < l then 'high<low' end, case when h < greatest(o, c) then 'high<max(open,close)' end, case when l > least(o, c) then 'low>min(open,close)' end, case when v < 0 then 'volume<0' end) as detail from (select symbol, t, o, case when v > 18 then l - 1 else h end as h, l, c, case when v < 3 then -v else v end as v from {bars}) q where h < l or h < greatest(o, c) or l > least(o, c) or v < 0",
    "k4_realized_vol": "select symbol, t, case when count(x) over w = 24 then round(stddev_pop(x) over w, 8) end as vol24 from (select symbol, t, c / nullif(lag(c) over (partition by symbol order by t), 0) - 1 as x from {bars}) q window w as (partition by symbol order by t rows between 23 preceding and current row)",
    "k5_window_logret": "select symbol, t, " + ", ".join(f"case when c > 0 and lag(c, {k}) over s > 0 then round(ln(c / lag(c, {k}) over s), 8) end as logret_{k}" for k in (1, 2, 3, 6, 12, 24, 48)) + " from {bars} window s as (partition by symbol order by t)",
    "k7_geometry": "select symbol, t, case when h > l then round(abs(c - o) / (h - l), 8) else 0.0e0 end as body, case when h > l then round((h - greatest(o, c)) / (h - l), 8) else 0.0e0 end as upper_wick, case when h > l then round((least(o, c) - l) / (h - l), 8) else 0.0e0 end as lower_wick, case when h > l and c <> 0 then round((h - l) / c, 8) else 0.0e0 end as range_pct, case when h > l then round((c - l) / (h - l), 8) else 0.5e0 end as close_loc from {bars}",
    "k8_rolling_extrema": "select symbol, t, case when count(*) over w = 24 then round(c / nullif(max(h) over w, 0) - 1, 8) end as to_high, case when count(*) over w = 24 then round(c / nullif(min(l) over w, 0) - 1, 8) end as to_low from {bars} window w as (partition by symbol order by t rows between 23 preceding and current row)",
    "k9_volume_stats": "select symbol, t, round((v - m) / nullif(s, 0), 8) as z, round(v / nullif(m, 0), 8) as ratio, case when v > 1.5 * m then 1 else 0 end as expansion from (select symbol, t, v, avg(v) over w as m, stddev_pop(v) over w as s, count(*) over w as n from {bars} window w as (partition by symbol order by t rows between 23 preceding and current row)) q where n = 24",
    "k12_k13_corr_beta": f"select other, t, case when count(ar) over w = 24 and var_pop(ar) over w > 0 and var_pop(br) over w > 0 then round(covar_pop(ar, br) over w / sqrt((var_pop(ar) over w) * (var_pop(br) over w)), 6) end as corr24, case when count(ar) over w = 24 and var_pop(br) over w > 0 then round(covar_pop(ar, br) over w / (var_pop(br) over w), 6) end as beta24, case when ar is null or br is null then null when abs(ar) < 0.001 or abs(br) < 0.001 then 0 when sign(ar) = sign(br) then 1 else 0 end as sync1 from (select * from ({_PRET}) z where ar is not null and br is not null) q window w as (partition by other order by t rows between 23 preceding and current row)",
    "k15_quantiles": f"select symbol, round(percentile_(r, 0.1), 8) as q10, round(percentile_(r, 0.5), 8) as q50, round(percentile_(r, 0.9), 8) as q90 from ({_RET}) q where r is not null group by symbol",
    "a4_aligned_closes": f"select other, t, round(ac, 6) as ac, round(bc, 6) as bc from ({_PAIRS}) q",
    "j2_exact_grid": "select a.symbol, a.t, round(a.c - b.c, 6) as move3 from {bars} a left join {bars} b on b.symbol = a.symbol and b.t = a.t - 43200",
    "x1_move_class": f"select other, t, case when ar is null or br is null then 'unknown' when abs(ar) < 0.001 or abs(br) < 0.001 then 'quiet' when ar > 0 and br > 0 then 'synchronized_breakout' when ar < 0 and br < 0 then 'synchronized_breakdown' else 'decoupled' end as move from ({_PRET}) q",
    "x2_pair_state": f"select other, t, round(ar - br, 8) as strength1, round(case when ac > 0 and bc > 0 and lag(ac, 24) over s > 0 and lag(bc, 24) over s > 0 then ln(ac / lag(ac, 24) over s) - ln(bc / lag(bc, 24) over s) end, 8) as strength24 from ({_PRET}) q window s as (partition by other order by t)",
    "m1_drift": f"select symbol, t, round(d, 8) as drift from ({_DRIFT}) q",
    "m2_baseline_forecast": f"select symbol, t, h, round(d * h, 8) as expected from ({_DRIFT}) q cross join (select explode_(1, 10) as h) k where d is not null",
    "p1_window_pivots": f"select symbol, t, known_t, known_t + 14400 as known_close, round(price, 6) as price, kind from ({_PIVOTS}) q",
    "p6_swing_state": f"select symbol, case when hn < 2 or ln_ < 2 then 'insufficient' when h1 > h2 and l1 > l2 then 'HH_HL' when h1 <= h2 and l1 <= l2 then 'LH_LL' else 'mixed' end as swing from (select symbol, max(case when kind = 'high' and k = 1 then price end) as h1, max(case when kind = 'high' and k = 2 then price end) as h2, max(case when kind = 'low' and k = 1 then price end) as l1, max(case when kind = 'low' and k = 2 then price end) as l2, sum(case when kind = 'high' then 1 else 0 end) as hn, sum(case when kind = 'low' then 1 else 0 end) as ln_ from (select *, row_number() over (partition by symbol, kind order by t desc) as k from ({_PIVOTS}) q) z group by symbol) y",
    "p7_zone_range": f"select symbol, t, kind, round(price - greatest(0.001 * abs(price), 0.00000001) / 2, 6) as lower_, round(price + greatest(0.001 * abs(price), 0.00000001) / 2, 6) as upper_ from ({_PIVOTS}) q",
    "h4_compression": "select symbol, t, case when n >= 16 and (h8 - l8) < 0.6 * (ph - pl) then 1 else 0 end as compressed from (select symbol, t, row_number() over (partition by symbol order by t) as n, max(h) over w as h8, min(l) over w as l8, max(h) over p as ph, min(l) over p as pl from {bars} window w as (partition by symbol order by t rows between 7 preceding and current row), p as (partition by symbol order by t rows between 15 preceding and 8 preceding)) q",
    "h10_evidence_score": "select symbol, round((e + 2 * k - x) * 1.0e0 / (e + x + k + 1), 8) as score from (select symbol, sum(case when c > o then 1 else 0 end) as e, sum(case when c < o then 1 else 0 end) as x, sum(case when h - l > 0 and (c - l) / (h - l) > 0.9 then 1 else 0 end) as k from (select symbol, t, o, h, l, c from {bars}) q where h > l group by symbol) z",
    "t1_rule_firing": "select symbol, min(case when c > lvl then t end) as close_above, min(case when c < lvl then t end) as close_below, min(case when h > lvl then t end) as high_above, min(case when l < lvl then t end) as low_below from (select *, avg(c) over (partition by symbol order by t rows between 20 preceding and 1 preceding) as lvl from {bars}) q where lvl is not null group by symbol",
    "j8_unjournaled_origins": f"select a.symbol, a.t from (select symbol, t, n from ({_GRID}) g where n >= 21) a left join (select symbol, t from ({_GRID}) g where n % 3 = 0) j on a.symbol = j.symbol and a.t = j.t where j.t is null",
    "q2_latest_forecast": f"select symbol, t, round(d, 8) as drift from (select *, row_number() over (partition by symbol order by t desc) as k from ({_DRIFT}) q where t + 14400 <= 1705276800) z where k = 1",
    "f18_freshness": "select symbol, case when 1706659200 - (max(t) + 14400) <= 720 then 'live' else 'stale' end as freshness from {bars} group by symbol",
    "h1_continuation": f"select symbol, h1, h2, l1, l2, case when h1 > h2 and l1 > l2 then 'bull_continuation' when h1 <= h2 and l1 <= l2 then 'bear_continuation' else 'none' end as pattern from (select symbol, round(max(case when kind = 'high' and k = 1 then price end), 6) as h1, round(max(case when kind = 'high' and k = 2 then price end), 6) as h2, round(max(case when kind = 'low' and k = 1 then price end), 6) as l1, round(max(case when kind = 'low' and k = 2 then price end), 6) as l2 from (select *, row_number() over (partition by symbol, kind order by t desc) as k from ({_PIVOTS}) q) z group by symbol) y",
    "h2_flag_impulse": f"select symbol, t as impulse_t, round(move, 6) as impulse from (select *, row_number() over (partition by symbol order by abs(move) desc, t) as k from (select symbol, t, price - lag(price) over (partition by symbol order by t, kind) as move from ({_PIVOTS}) q) z where move is not null) y where k = 1",
    "h8_alternating_six": f"select symbol, count(*) as pivots, sum(case when kind <> pk or pk is null then 1 else 0 end) as alternating from (select symbol, kind, lag(kind) over (partition by symbol order by t, kind) as pk, row_number() over (partition by symbol order by t desc, kind desc) as k from ({_PIVOTS}) q) z where k <= 6 group by symbol",
    "k20_simple_returns": f"select symbol, t, h, round(exp(d * h) - 1, 8) as simple_return from ({_DRIFT}) q cross join (select explode_(1, 10) as h) k where d is not null",
    "m4_in_sample_drift": f"select symbol, t, case when count(r) over w = 20 then round(avg(r) over w, 8) end as drift from ({_RET}) q window w as (partition by symbol order by t rows between 19 preceding and current row)",
    "m7_eligible_origins": f"select symbol, t, t + 11 * 14400 as matured from (select *, max(n) over (partition by symbol) as last_n from ({_GRID}) g) q where n >= 24 and n + 10 <= last_n",
    "t4_structure_extreme": f"select b.symbol, round(coalesce(p.hi, b.hi), 6) as structure_high, round(coalesce(p.lo, b.lo), 6) as structure_low from (select symbol, max(h) as hi, min(l) as lo from {{bars}} group by symbol) b left join (select symbol, max(price) as hi, min(price) as lo from ({_PIVOTS}) q group by symbol) p on b.symbol = p.symbol",
    "x4_return_regime": f"select other, t, case when bc > 0 and lag(bc, 24) over s > 0 then case when ln(bc / lag(bc, 24) over s) > 0.005 then 'bullish' when ln(bc / lag(bc, 24) over s) < -0.005 then 'bearish' else 'neutral' end else 'unknown' end as regime from ({_PAIRS}) q window s as (partition by other order by t)",
}
PLANS |= pattern_plans.plans(_PIVOTS)

_SPARK = {"percentile_(": "percentile(", "explode_(": "explode(sequence("}
_DUCK = {"percentile_(": "quantile_cont(", "explode_(": "unnest(generate_series("}


def _dialect(body: str, words: dict[str, str]) -> str:
    for a, b in words.items():
        if a == "explode_(":
            body = re.sub(r"explode_\(([^)]*)\)", b + r"\1))", body)
        body = body.replace(a, b)
    return body


def spark_sql(name: str) -> str:
    return _dialect(PLANS[name], _SPARK)


def duck_sql(name: str, bars: str) -> str:
    return f"with bars_ as materialized ({bars}) " + _dialect(PLANS[name], _DUCK).replace("{bars}", "bars_")
