"""The strategies' rules said in SQL: one step of a recursive query is one bar of every run.

Windows are slices of a series' lists of prices. This is the twin that the queries' machines are compared with.
"""

from __future__ import annotations


def _walk(name: str, low: str, high: str, close: str) -> str:
    """Columns of the walk over a window: last lowest low, best point after it, peak and drop since the peak."""
    return f"""list_min({low}) as {name}_base, len({low}) - list_position(list_reverse({low}), list_min({low})) as {name}_at, {low}[1] as {name}_first, list_max({high}) as {name}_top,
    greatest({close}[1], list_max({high}[2:])) as {name}_peak, case when list_max({high}[2:]) > {close}[1] then list_position({high}[2:], list_max({high}[2:])) else 0 end as {name}_pk"""


def _ends(name: str, low: str, high: str, close: str) -> str:
    return f"""greatest({close}[{name}_at + 1], list_max({high}[{name}_at + 2:])) - {name}_base as {name}_rise,
    {name}_peak - least({close}[{name}_pk + 1], list_min({low}[{name}_pk + 2:])) as {name}_drop"""


def _share(x: str, base: str) -> str:
    return f"(case when {base} = 0 then 0.0 else {x} / abs({base}) end)"


def _exact(x: str, digits: int) -> str:
    """Rounded as the number's decimals say, which a product with a power of ten would not always do."""
    return f"cast(format('{{:.{digits}f}}', {x}) as double)"


def _price(x: str) -> str:
    return f"case when digits = 2 then {_exact(x, 2)} else {_exact(x, 5)} end"


_STATE = "series_id, param_id, idx as i"

#: Columns of a row of signals with their types.
_ROW = {
    "have_holding": "int", "holding_signal": "int", "execution": "double", "close_type": "int", "reset_reason": "varchar", "withdrawal": "double", "wd_per": "double", "wd_signal": "int", "increase": "double",
    "inc_per": "double", "inc_signal": "int", "ana_inc": "double", "a_inc_per": "double", "total_inc": "double", "t_inc_per": "double", "total_inc_signal": "int", "max_inc": "double", "max_wd": "double",
    "holding_wd": "double", "hld_wd_per": "double", "holding_wd_signal": "int", "holding_inc": "double", "speed_close_signal": "int", "period": "bigint", "low_index": "bigint", "high_index": "bigint",
    "low_price": "double", "high_price": "double", "last_index": "bigint", "new_opening_count": "bigint",
}

#: Steps of one bar, each on the columns of those before.
_STEPS = [
    """i + 1 as idx, not holding as flat, case when cnt >= open_bar then i + 2 - open_bar when fresh then i else last end as from_, kind = 'legacy' as legacy,
    case when cnt >= close_bar then i + 1 - close_bar when fresh then low else last end as hold_from, case when fresh then i + 1 else entered end as since_entry,
    case when kind = 'legacy' then cnt + 1 >= close_bar else cnt >= close_bar end as ready""",
    "l[from_ + 1:idx + 1] as wl, h[from_ + 1:idx + 1] as wh, c[from_ + 1:idx + 1] as wc, flat and stage = 0 as looking",
    _walk("w", "wl", "wh", "wc"),
    _ends("w", "wl", "wh", "wc"),
    f"{_share('w_rise', 'case when legacy then w_first else w_base end')} as w_share, {_share('w_drop', 'w_peak')} as w_lost",
    "looking and w_share >= open_threshold as fast, looking and (legacy or w_lost < open_withdrawal) as calm",
    "fast and calm as armed, case when fast and calm then from_ + w_at else low end as anchor_at",
    "case when armed then anchor_at else from_ end as flat_last, case when armed then idx - anchor_at + 1 when looking and not calm then 1 else cnt + 1 end as flat_cnt, flat and (armed or stage = 2) as active",
    "l[anchor_at + 1:idx + 1] as sl, h[anchor_at + 1:idx + 1] as sh, c[anchor_at + 1:idx + 1] as sc, idx - anchor_at + 1 as n",
    _walk("s", "sl", "sh", "sc"),
    _ends("s", "sl", "sh", "sc"),
    f"{_share('s_drop', 's_peak')} as s_lost, case when legacy then s_first else s_base end as s_from, case when n > open_bar then s_top - list_max(sh[:n - open_bar]) end as open_gain, case when n > close_bar then s_top - list_max(sh[:n - close_bar]) end as hold_gain",
    f"active and s_lost < open_withdrawal as still, active and not s_lost < open_withdrawal as lost, {_share('s_rise', 's_from')} as s_share, {_share('open_gain', 's_first')} as open_share, {_share('hold_gain', 'l[hold_from + 2]')} as hold_share",
    """still and flat_cnt >= open_bar as timed, coalesce(still and flat_cnt >= open_bar and open_share < close_threshold, false) as slow, still and s_share >= continue_threshold as opens,
    holding and kind in ('long', 'short') and s_lost > close_withdrawal as stopped, coalesce(holding and ready and hold_share < close_threshold, false) as slowed""",
    "holding and (stopped or slowed) as closes, lost or slow or (holding and (stopped or slowed)) as reports, case when slow or lost then 0.0 when still then s_from else anchor end as anchor_price, idx - list_position(list_reverse(l[flat_last + 1:idx + 1]), list_min(l[flat_last + 1:idx + 1])) + 1 as recent",
    f"case when n = 1 or abs(list_max(sh[2:]) - sc[1]) <= 1e-10 then 0 else list_position(sh[2:], list_max(sh[2:])) end as r_top, {_price('side * anchor_price * (1 + side * continue_threshold)')} as wanted",
    "case when reports then sl[:r_top + 1] end as rl, case when reports then sh[:r_top + 1] end as rh, case when reports then sc[:r_top + 1] end as rc",
    """list_min(rl) as r_base, len(rl) - list_position(list_reverse(rl), list_min(rl)) as r_at,
    greatest(0.0, list_max(list_transform(range(2, len(rh) + 1), lambda t: (list_max(rh[1:t]) - least(rc[list_position(rh[1:t], list_max(rh[1:t]))], list_min(rl[list_position(rh[1:t], list_max(rh[1:t])) + 1:t]))) / nullif(abs(list_max(rh[1:t])), 0)))) as r_worst""",
    "greatest(rc[r_at + 1], list_max(rh[r_at + 2:])) - r_base as r_rise",
]

_NEXT = """case when holding then not closes else opens end, case when holding then closes else (looking and not calm) or lost or opens end,
  case when closes then 0 when holding then cnt + 1 when opens then idx - anchor_at when lost then 0 when slow then idx - recent + 1 else flat_cnt end,
  case when holding then stage when opens or lost or slow then 0 when active then 2 else stage end, case when holding then hold_from when slow then recent else flat_last end, anchor_at, anchor_price,
  case when holding then since_entry else entered end"""

_VALUES = {
    "have_holding": "holding::int",
    "holding_signal": "case when holding then case when closes then 0 else 3 end when opens then 1 else 0 end",
    "execution": f"case when opens then case when wanted * side < o[idx + 1] then side * o[idx + 1] else wanted end when stopped then {_price('side * least(side * (side * s_top * (1 - side * close_withdrawal)), o[idx + 1])')} when slowed then case when legacy then side * c[idx + 1] else {_price('side * c[idx + 1]')} end end",
    "close_type": "case when stopped then 1 when slowed then 2 end",
    "reset_reason": "case when lost then 'open withdraw' when slow then 'open speed' end",
    "withdrawal": "case when active then s_drop when looking then w_drop end",
    "wd_per": f"case when looking then {_exact('w_lost * 100', 4)} end",
    "wd_signal": "case when active then still::int when looking then calm::int else 0 end",
    "increase": "case when looking then w_rise end",
    "inc_per": f"case when looking then {_exact('w_share * 100', 4)} end",
    "inc_signal": "coalesce(fast, false)::int",
    "ana_inc": "case when timed then coalesce(open_gain, 'nan'::double) end",
    "a_inc_per": f"case when timed then coalesce(case when legacy then open_share * 100 else {_exact('open_share * 100', 4)} end, 'nan'::double) end",
    "total_inc": "case when still then s_rise end",
    "t_inc_per": f"case when still then {_exact('s_share * 100', 4)} end",
    "total_inc_signal": "coalesce(opens, false)::int",
    "max_inc": f"case when reports then case when legacy then {_exact(_share('r_rise', 'rl[1]'), 5)} * 100 else {_exact(_share('r_rise', 'r_base') + ' * 100', 4)} end end",
    "max_wd": f"case when reports then case when legacy then {_exact('coalesce(r_worst, 0.0)', 5)} * 100 else {_exact('coalesce(r_worst, 0.0) * 100', 4)} end end",
    "holding_wd": "case when holding then s_drop end",
    "hld_wd_per": f"case when holding then {_exact('s_lost * 100', 4)} end",
    "holding_wd_signal": "coalesce(stopped, false)::int",
    "holding_inc": "case when holding and ready then coalesce(hold_gain, 'nan'::double) end",
    "speed_close_signal": "coalesce(slowed, false)::int",
    "period": "case when closes then idx - since_entry + 1 when reports then flat_cnt when armed then flat_cnt end",
    "low_index": "case when reports or opens or armed then anchor_at end",
    "high_index": "case when reports then anchor_at + r_top end",
    "low_price": "case when opens then side * anchor_price + 0.0 end",
    "high_price": "case when holding then side * s_top end",
    "last_index": "case when holding then hold_from when slow then recent else flat_last end",
    "new_opening_count": "case when closes then 0 when holding then cnt + 1 when opens then idx - anchor_at when lost then 0 when slow then idx - recent + 1 else flat_cnt end",
}


def machine_sql(sets: list) -> str:
    """CTEs after ``gb`` (series_id, bar_idx, ts and prices): ``signals`` with a row for each bar of each series and set."""
    rows = ", ".join(
        f"({p.param_id}::bigint, '{p.kind}', {-1.0 if p.kind == 'short' else 1.0!r}::double, {p.open_bar}::bigint, {p.open_threshold!r}::double, {p.continue_threshold!r}::double, {p.open_withdrawal!r}::double, {p.close_bar}::bigint, {p.close_threshold!r}::double, {p.close_withdrawal!r}::double, {2 if p.kind == 'legacy' else p.precision})"
        for p in sets
        if p.usable()
    )
    source = "(select m.*, px.* exclude (series_id, side), sets.* exclude (param_id) from m join sets on sets.param_id = m.param_id join px on px.series_id = m.series_id and px.side = sets.side where m.i + 1 < px.bars)"
    for step in _STEPS:
        source = f"(select *, {step} from {source})"
    empty = ", ".join(f"null::{t}" for t in _ROW.values())
    values = ", ".join(f"({_VALUES[c]})::{t}" for c, t in _ROW.items())
    columns = ", ".join(_ROW)
    return f"""sides(side) as (values (1.0::double), (-1.0::double)),
px as (select series_id, side, count(*) as bars, list(side * open order by bar_idx) as o, list(case when side > 0 then high else -low end order by bar_idx) as h, list(case when side > 0 then low else -high end order by bar_idx) as l, list(side * close order by bar_idx) as c from gb cross join sides group by series_id, side),
sets(param_id, kind, side, open_bar, open_threshold, continue_threshold, open_withdrawal, close_bar, close_threshold, close_withdrawal, digits) as (values {rows}),
m(series_id, param_id, i, holding, fresh, cnt, stage, last, low, anchor, entered, {columns}) as (
  select distinct px.series_id, sets.param_id, -1::bigint, false, false, 0::bigint, 0, 0::bigint, 0::bigint, 0.0::double, 0::bigint, {empty} from px cross join sets
  union all select {_STATE}, {_NEXT}, {values} from {source}),
signals as (select m.series_id, m.param_id, m.i as bar_idx, gb.ts, gb.close, {", ".join("m." + c for c in _ROW)}, case when m.low_index < m.i then lo.ts end as low_date, case when m.high_index < m.i then hi.ts end as high_date
  from m join gb on gb.series_id = m.series_id and gb.bar_idx = m.i left join gb lo on lo.series_id = m.series_id and lo.bar_idx = m.low_index left join gb hi on hi.series_id = m.series_id and hi.bar_idx = m.high_index where m.i >= 0)"""


def book_sql() -> str:
    """CTEs after ``signals`` and ``sets``: ``book`` with the capital at every bar, ``tx`` of entries and exits, ``trade`` of pairs."""
    return """b0 as (select s.*, sets.side, last_value(case when holding_signal = 1 then execution end ignore nulls) over (partition by s.series_id, s.param_id order by bar_idx rows unbounded preceding) as cost from signals s join sets on sets.param_id = s.param_id),
b1 as (select *, case when holding_signal = 0 and have_holding = 1 then case when side > 0 then execution / cost else cost / execution end end as percent, case when side > 0 then close / cost else cost / close end as mark from b0),
b2 as (select *, 100 * product(coalesce(percent, 1.0)) over (partition by series_id, param_id order by bar_idx rows unbounded preceding) as k from b1),
b3 as (select *, case when holding_signal = 3 then k * mark else k end as capital from b2),
book as (select *, max(capital) over (partition by series_id, param_id order by bar_idx rows unbounded preceding) as peak from b3),
tx as (select *, holding_signal = 1 as opened, case when holding_signal = 1 then case when side > 0 then 'long' else 'short' end when side > 0 then 'sell' else 'buy' end as type from book where holding_signal = 1 or percent is not null),
pair as (select *, lead(bar_idx) over w as exit_idx, lead(ts) over w as exit_ts, lead(execution) over w as exit_price, lead(close_type) over w as exit_type, lead(percent) over w as exit_percent, lead(capital) over w as exit_capital from tx window w as (partition by series_id, param_id order by bar_idx)),
trade as (select series_id, param_id, row_number() over (partition by series_id, param_id order by bar_idx) as trade_id, bar_idx as entry_idx, ts as entry_ts, execution as entry_price, exit_idx, exit_ts, exit_price, exit_type as close_type, exit_percent as percent, exit_capital as capital from pair where opened and exit_percent is not null),
top as (select series_id, param_id, arg_max(bar_idx, (capital * side, -bar_idx)) as ti, arg_max(capital, (capital * side, -bar_idx)) as hi from book group by all),
back as (select b.series_id, b.param_id, any_value(hi) as outcome_high, any_value(hi * side) - min(capital * side) as biggest_back from book b join top on top.series_id = b.series_id and top.param_id = b.param_id where bar_idx >= ti group by b.series_id, b.param_id),
stat as (select series_id, param_id, count(*) filter (holding_signal = 1 or percent is not null) as txs, arg_max(capital, bar_idx) filter (percent is not null) as final, count(*) filter (close_type = 1) as closed_by_withdrawal, count(*) filter (close_type = 2) as closed_by_speed, max(peak - capital) as max_drawdown from book group by all),
stats as (select stat.series_id, stat.param_id, case when txs > 1 then round(final, 2) else 100.0 end as capital, txs / 2 as trade_num, closed_by_withdrawal, closed_by_speed, outcome_high, biggest_back, max_drawdown from stat join back on back.series_id = stat.series_id and back.param_id = stat.param_id)"""
