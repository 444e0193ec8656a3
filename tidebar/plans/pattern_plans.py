"""Chart patterns and their evaluation, declared as relational plans over {bars} (four-hour bars) and their confirmed window pivots.

Pivots are ordered by time, a low after a high of the same bar. A pattern reads at most a symbol's last few pivots or one level's bars;
every join is on the symbol and every window is partitioned by symbol or by level.
"""

from __future__ import annotations


def plans(pivots: str) -> dict[str, str]:
    """Plans by name, for the given query of pivots (symbol, t, known_t, price, kind)."""
    ranked = f"""select *, row_number() over (partition by symbol, kind order by t desc) as kr, count(*) over (partition by symbol, kind) as kn,
        row_number() over (partition by symbol order by t desc, kind desc) as pr from ({pivots}) p"""
    of = lambda kind, rank: f"max(case when kind = '{kind}' and kr = {rank} then price end)"
    count = lambda kind: f"coalesce(max(case when kind = '{kind}' then kn end), 0)"

    # the last four highs and lows: the range at their start and at their end
    edges = f"""select symbol, {of("high", "least(4, kn)")} as h0, {of("high", 1)} as h1, {of("low", "least(4, kn)")} as l0, {of("low", 1)} as l1,
        max(case when kind = 'high' and kr <= 4 then price end) as upper, min(case when kind = 'low' and kr <= 4 then price end) as lower
        from ({ranked}) p group by symbol having {count("high")} >= 3 and {count("low")} >= 3"""
    subtype = """case when h1 > h0 and l1 > l0 then 'rising_wedge' when h1 < h0 and l1 < l0 then 'falling_wedge'
        when abs(h1 - h0) <= 0.15e0 * greatest(abs(h0), 1e-9) and l1 > l0 then 'ascending_triangle'
        when abs(l1 - l0) <= 0.15e0 * greatest(abs(l0), 1e-9) and h1 < h0 then 'descending_triangle'
        when h1 < h0 and l1 > l0 then 'symmetrical_triangle' end"""
    wedge = f"select * from (select *, {subtype} as subtype from ({edges}) e where h0 > l0 and h1 - l1 < (h0 - l0) * 0.92e0) e where subtype is not null"

    # the largest move between neighbouring pivots (the first of equals), and the range of the pivots known after it
    moves = f"select *, lag(price) over (partition by symbol order by t, kind) as origin from ({pivots}) p"
    impulse = f"select symbol, t, known_t, price, origin from (select *, row_number() over (partition by symbol order by abs(price - origin) desc, t, kind) as k from ({moves}) p where origin is not null) p where k = 1 and price <> origin"
    flag = f"""select i.symbol, i.t as impulse_t, i.origin, i.price as impulse_end, max(p.price) as flag_high, min(p.price) as flag_low
        from ({impulse}) i join ({pivots}) p on p.symbol = i.symbol and p.known_t > i.known_t
        group by i.symbol, i.t, i.origin, i.price having count(*) >= 2 and max(p.price) - min(p.price) < 0.62e0 * abs(i.price - i.origin)"""

    # the last six pivots as five waves
    wave = lambda rank: f"max(case when pr = {rank} then price end)"
    six = f"""select symbol, max(case when pr = 6 then kind end) as start_kind, {", ".join(f"{wave(6 - k)} as w{k}" for k in range(6))}
        from (select *, lead(kind) over (partition by symbol order by pr) as before from ({ranked}) p where pr <= 6) p
        group by symbol having count(*) = 6 and sum(case when kind = before then 1 else 0 end) = 0"""
    sign = "(case when start_kind = 'low' then 1.0e0 else -1.0e0 end)"
    waves = f"""select *, case when {sign} * (w2 - w0) > 0 then 1 else 0 end as holds_origin, case when {sign} * (w4 - w1) > 0 then 1 else 0 end as no_overlap,
        case when abs(w3 - w2) > least(abs(w1 - w0), abs(w5 - w4)) then 1 else 0 end as not_shortest from ({six}) w"""

    score = "round((e + 2.0e0 * k - x) / (e + x + k + 1), 8)"
    kinds = f"""select symbol, case when subtype like '%wedge' then 'wedge' else 'triangle' end as kind, case when subtype in ('falling_wedge', 'ascending_triangle') then 'bull' when subtype = 'symmetrical_triangle' then 'neutral' else 'bear' end as direction, 3 as e, 0 as x, 0 as k from ({wedge}) w
        union all select symbol, 'flag', case when impulse_end > origin then 'bull' else 'bear' end, 2, case when (impulse_end > origin and flag_low < origin) or (impulse_end < origin and flag_high > origin) then 1 else 0 end, 0 from ({flag}) f
        union all select symbol, 'elliott_impulse', case when start_kind = 'low' then 'bull' else 'bear' end, 1 + holds_origin + no_overlap + not_shortest, 3 - holds_origin - no_overlap - not_shortest, 0 from ({waves}) w where holds_origin + no_overlap + not_shortest > 0
        union all select symbol, 'elliott_correction', case when start_kind = 'low' then 'bear' else 'bull' end, 1, 1, 0 from ({waves}) w where holds_origin + no_overlap + not_shortest > 0"""

    return {
        "h2_flag": f"select symbol, impulse_t, case when impulse_end > origin then 'bull' else 'bear' end as direction, round(origin, 6) as origin, round(flag_high, 6) as flag_high, round(flag_low, 6) as flag_low, case when (impulse_end > origin and flag_low < origin) or (impulse_end < origin and flag_high > origin) then 1 else 0 end as lost_origin from ({flag}) f",
        "h3_wedge_triangle": f"select symbol, subtype, round(h0 - l0, 6) as early_width, round(h1 - l1, 6) as late_width, round(upper, 6) as upper, round(lower, 6) as lower from ({wedge}) w",
        "h8_five_waves": f"select symbol, case when start_kind = 'low' then 'bull' else 'bear' end as direction, {', '.join(f'round(w{k}, 6) as w{k}' for k in range(6))}, holds_origin, no_overlap, not_shortest from ({waves}) w",
        "h9_ranked_hypotheses": f"select symbol, kind, direction, {score} as score, cast(row_number() over (partition by symbol order by {score} desc, kind, direction) as bigint) as rank from ({kinds}) h",
    }
