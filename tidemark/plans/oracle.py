"""DuckDB SQL for the queries, over the same tables."""

from __future__ import annotations

_VIEWS = """
prices as (select cast(user_id as varchar) card_id, cast(ts as date) date, round(avg(value), 9) price from events group by all),
long_prices as (select cast(l_suppkey as varchar) card_id, cast(l_shipdate as date) date, round(avg(l_extendedprice / nullif(l_quantity, 0)), 9) price from lineitem group by all),
sparse_prices as (select cast(l_partkey as varchar) card_id, cast(l_shipdate as date) date, round(avg(l_extendedprice / nullif(l_quantity, 0)), 9) price from lineitem group by all),
catalog as (select cast(p_partkey as varchar) id, p_partkey tcgplayer_id, p_name as name, p_brand set_name, p_type rarity, p_size cost, p_retailprice retail, date '1994-12-01' + cast(p_size * 10 as integer) released_at from part),
listings as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date)) item_id, cast(l_partkey as varchar) id, round(l_extendedprice / nullif(l_quantity, 0), 9) price_val,
    l_returnflag = 'R' is_graded, cast(l_shipdate as date) date_pulled,
    concat_ws(' ', p_name, p_brand, p_type, (['japanese', 'fr', 'box', 'sleeve', 'psa 10', 'near mint', 'italian'])[(l_linenumber - 1) % 7 + 1]) listing_title,
    case when l_linestatus = 'O' then 'EPID' else 'TEXT' end pull_source
  from lineitem join part on l_partkey = p_partkey
),
runs as (select 1 run_id, max(date) - 14 run_date from prices union all select 2, max(date) - 7 from prices),
past as (select p.*, run_id, run_date, row_number() over (partition by card_id, run_id order by date desc) rn from prices p join runs on date <= run_date),
base as (select card_id, run_id, run_date, max_by(price, date) as last, avg(price) ma from past where rn <= 7 group by all),
models as (
  select card_id, run_id, run_date, 'Last' model, round(last, 9) pred_price from base union all
  select card_id, run_id, run_date, 'MA7', round(ma, 9) from base union all
  select card_id, run_id, run_date, 'Mean', round((last + ma) / 2, 9) from base
),
forecasts as (
  select card_id, run_id, run_date, run_date + cast(h as integer) target_date, model, pred_price, round(pred_price * 0.9, 9) conf_low, round(pred_price * 1.1, 9) conf_high
  from models, range(1, 8) r(h)
)
"""

_GUIDE = "guide as (select card_id id, cast(date_trunc('month', date) + interval 1 month as date) price_date, round(avg(price), 6) price_then from sparse_prices group by all)"
_LATEST = "latest as (select card_id, max(date) date, max_by(price, date) price from prices group by card_id)"
_FILLED = """
days as (select card_id, unnest(generate_series(min(date), max(date), interval 1 day))::date date from prices group by card_id),
filled as (select d.card_id, d.date, last_value(price ignore nulls) over (partition by d.card_id order by d.date) price from days d left join prices p using (card_id, date)),
holes as (select card_id, date, case when day(date) % 3 <> 0 then price end price from filled)
"""
_APE = "abs(actual_price - pred_price) / nullif(abs(actual_price), 0)"


def _chaos(src: str, holdout: int, name: str = "chaos") -> str:
    return f"""
{name}_r as (select *, count(*) over (partition by card_id) n, row_number() over (partition by card_id order by date desc) rn from {src}),
{name}_s as (select *, abs(price - lag(price) over (partition by card_id order by date)) step from {name}_r where n > {holdout} and rn > {holdout}),
{name}_a as (
  select card_id, abs(max_by(price, date) - min_by(price, date)) net_change, coalesce(sum(step), 0.0) sum_of_changes, (max(price) - min(price)) / nullif(avg(price), 0) span_range
  from {name}_s group by card_id
),
{name}_e as (select *, case when sum_of_changes > 0 then net_change / nullif(sum_of_changes, 0) else 1.0 end efficiency_ratio from {name}_a),
{name}_c as (select *, span_range * (1 - efficiency_ratio) chaos_cv from {name}_e),
{name} as (select *, cast(ntile(3) over (order by round(chaos_cv, 9), card_id) as integer) volatility_tier from {name}_c)
"""


_POOL = (
    _chaos("prices", 7)
    + f""",
resid as (
  select card_id, model model_type, cast(target_date - run_date as integer) horizon, price actual_price, pred_price, target_date, run_date
  from forecasts join (select card_id, date target_date, price from prices) using (card_id, target_date)
),
residuals as (select card_id, model_type, horizon, actual_price, pred_price, round({_APE}, 4) error_abs_pct, target_date, run_date from resid),
pool as (
  select card_id, model_type model, horizon day_offset, actual_price, pred_price, {_APE} ape, target_date, run_date, volatility_tier
  from resid left join chaos using (card_id)
)
"""
)

_ENTROPY = """
recent as (select card_id, date, price, count(*) over (partition by card_id) n, stddev_samp(price) over (partition by card_id) sd, row_number() over (partition by card_id order by date desc) rn from prices),
tpl as (
  select card_id, sd, row_number() over w i, price x1, lead(price, 1) over w x2, lead(price, 2) over w x3 from recent where n >= 10
  window w as (partition by card_id order by date)
),
pairs as (
  select a.card_id, count(*) b, count(*) filter (where abs(a.x3 - b.x3) < 0.2 * a.sd) a
  from tpl a join tpl b on a.card_id = b.card_id and a.i < b.i and abs(a.x1 - b.x1) < 0.2 * a.sd and abs(a.x2 - b.x2) < 0.2 * a.sd
  where a.x3 is not null and b.x3 is not null group by a.card_id
),
entropy as (select c.card_id, case when a > 0 then round(ln(b / a), 6) end samp_entropy from (select distinct card_id from tpl) c left join pairs using (card_id)),
dev as (select card_id, date, n, sd, price - avg(price) over (partition by card_id) y from recent where n >= 10),
cum as (select *, sum(y) over (partition by card_id order by date) c from dev),
hurst as (select card_id, case when max(sd) > 0 and max(c) > min(c) then round(ln((max(c) - min(c)) / max(sd)) / ln(max(n)), 6) end hurst_exp from cum group by card_id),
lagged as (select card_id, price, lag(price) over (partition by card_id order by date) before, n from recent),
lag1 as (
  select card_id, case when stddev_samp(price) > 0 and stddev_samp(before) > 0 then round(corr(price, before), 6) end lag1_corr
  from lagged where n >= 3 and before is not null group by card_id
)
"""

_LANGUAGE = r"""case when regexp_matches(lower(listing_title), 'japanese|jpn|\bjp\b') then 'Japanese' when regexp_matches(lower(listing_title), 'chinese|\bchn\b|\bcn\b') then 'Chinese'
  when regexp_matches(lower(listing_title), 'french|\bfr\b') then 'French' when regexp_matches(lower(listing_title), 'german|\bger\b') then 'German'
  when regexp_matches(lower(listing_title), 'italian|\bita\b') then 'Italian' else 'English' end"""

_FITS = r"""
titled as (select l.*, c.name, c.set_name version, c.rarity, cast(c.cost as varchar) number, lower(listing_title) t from listings l join catalog c using (id)),
fits as (
  select * from titled
  where len(list_filter(string_split_regex(lower(name), '\s+|-'), lambda w: len(w) >= 3 and not contains(t, w))) = 0
    and (pull_source = 'EPID' or (len(list_filter([lower(rarity), 'enchanted', 'promo', 'alt art', 'aa', 'variant'], lambda w: contains(t, w))) > 0
         and (regexp_matches(t, '\b' || number || '\b') or len(list_filter(string_split_regex(regexp_replace(lower(version), '[^\w\s]|_', ' ', 'g'), '\s+'), lambda w: len(w) > 3 and contains(t, w))) > 0)))
    and not regexp_matches(t, 'case|box|proxy|replica|repro|custom|fan art|digital|wafer') and price_val >= 20
)
"""

_MOMENTUM = """
latest as (select card_id, max_by(price, date) price from prices group by card_id),
before as (select card_id, max_by(price, date) price from prices where date <= (select max(date) - 7 from prices) group by card_id),
change as (
  select card_id, l.price price_cur, b.price price_past, round(l.price - b.price, 6) abs_change, round(100 * (l.price - b.price) / nullif(b.price, 0), 6) pct_change
  from latest l join before b using (card_id)
),
movers as (
  (select *, 'top_pct' tag from change order by pct_change desc, card_id limit 1) union all (select *, 'low_pct' from change order by pct_change, card_id limit 1) union all
  (select *, 'top_abs' from change order by abs_change desc, card_id limit 1) union all (select *, 'low_abs' from change order by abs_change, card_id limit 1)
)
"""

_HEAD = """
wide as (
  select card_id, round(avg(ape) filter (where model = 'Last'), 9) a, round(avg(ape) filter (where model = 'MA7'), 9) b, round(avg(ape) filter (where model = 'Mean'), 9) c from pool group by card_id
)
"""
_FEATURES = """
ok as (select card_id from prices group by card_id having count(distinct date) >= 25),
own as (select * from prices where card_id in (select card_id from ok)),
days as (select card_id, unnest(generate_series(min(date), max(date), interval 1 day))::date date from own group by card_id),
filled as (select d.card_id, d.date, last_value(price ignore nulls) over (partition by d.card_id order by d.date) price from days d left join own p using (card_id, date)),
meta as (
  select f.card_id, date, price, name, set_name, rarity, released_at, cost, cast(greatest(date - released_at, 0) as integer) days_since_release, min(price) over (partition by f.card_id) card_min_price,
    max(price) over (partition by f.card_id) card_max_price
  from filled f join catalog c on f.card_id = c.id where lower(rarity) not like '%promo%'
),
ends as (select min(cost) a, max(cost) b, min(days_since_release) x, max(days_since_release) y from meta),
nm as (select name, row_number() over (order by name) - 1 i from (select distinct name from meta)),
st as (select set_name, row_number() over (order by set_name) - 1 i from (select distinct set_name from meta)),
ra as (select rarity, row_number() over (order by rarity) - 1 i from (select distinct rarity from meta))
"""
_TYPES = ", ".join(f"cast(rarity = '{t}' as integer) as \"rarity_{t}\"" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
_FC = "card_id, run_id, run_date, target_date, model, pred_price, conf_low, conf_high"


def _cents(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: cast(cast(round(x * 100) as bigint) as varchar)), ',')"


def _q(body: str, *extra: str) -> str:
    return "with " + ",".join([_VIEWS, *extra]) + body


SQL: dict[str, str] = {
    "prices_eligible": _q("select * from sparse_prices where card_id in (select card_id from sparse_prices group by card_id having count(distinct date) >= 30)"),
    "prices_gapfilled": _q("select * from filled", _FILLED),
    "prices_locf_with_nulls": _q("select card_id, date, last_value(price ignore nulls) over (partition by card_id order by date) price from holes", _FILLED),
    "prices_bfill_ffill": _q(
        "select card_id, date, coalesce(first_value(price ignore nulls) over (partition by card_id order by date rows between current row and unbounded following), last_value(price ignore nulls) over (partition by card_id order by date), 0.5) price from holes",
        _FILLED,
    ),
    "price_scaled_per_card": _q(
        "select card_id, date, price, a card_min_price, b card_max_price, round(case when a = b then 0.5 else (price - a) / (b - a) end, 6) price_scaled from (select *, min(price) over (partition by card_id) a, max(price) over (partition by card_id) b from prices)"
    ),
    "global_minmax": _q(
        "select id, cost, retail, round((cost - a) / nullif(b - a, 0), 6) cost_scaled, round((retail - x) / nullif(y - x, 0), 6) retail_scaled from catalog, (select min(cost) a, max(cost) b, min(retail) x, max(retail) y from catalog)"
    ),
    "zscore": _q("select id, cost, retail, round((cost - a) / b, 6) cost_z, round((retail - x) / y, 6) retail_z from catalog, (select avg(cost) a, stddev_samp(cost) b, avg(retail) x, stddev_samp(retail) y from catalog)"),
    "label_encode": _q("select set_name, id, cast(dense_rank() over (order by set_name) - 1 as integer) set_idx from catalog"),
    "vocabulary_size": _q("select cast(count(distinct set_name) as integer) n from catalog"),
    "one_hot": _q(f"select id, rarity, {_TYPES} from catalog"),
    "multi_hot": _q("select id, name, cast(contains(name, 'red') as integer) has_red, cast(contains(name, 'blue') as integer) has_blue, cast(contains(name, 'small') as integer) has_small, cast(contains(name, 'bolt') as integer) has_bolt from catalog"),
    "feature_table": _q(
        "select card_id, date, price, name, set_name, rarity, released_at, cost, days_since_release, card_min_price, card_max_price, "
        "round(case when card_min_price = card_max_price then 0.5 else (price - card_min_price) / (card_max_price - card_min_price) end, 6) price_scaled, "
        "round((cost - a) / nullif(b - a, 0), 6) cost_scaled, round((days_since_release - x) / nullif(y - x, 0), 6) days_since_release_scaled, "
        "cast(nm.i as integer) name_idx, cast(st.i as integer) set_idx, cast(ra.i as integer) rarity_idx from meta, ends, nm, st, ra where meta.name = nm.name and meta.set_name = st.set_name and meta.rarity = ra.rarity",
        _FEATURES,
    ).replace("select card_id, date, price, name, set_name, rarity, released", "select card_id, date, price, meta.name, meta.set_name, meta.rarity, released"),
    "tabular_matrix": _q(
        "select id, character_id, cast(coalesce(contains(type_clean, 'Character'), false) as integer) is_character, "
        + ", ".join(f"cast(contains(name, '{w}') as integer) ink_{w}" for w in ("red", "blue", "small", "bolt"))
        + ", "
        + ", ".join(f"coalesce(cast(type_clean = '{t}' as integer), 0) as \"type_clean_{t}\"" for t in ("Character", "Action", "Item - Character"))
        + f", {_TYPES}, round(ln(1 + coalesce(foil, non)), 6) log_price, "
        + ", ".join(f"round(({c} - avg({c}) over ()) / (stddev_samp({c}) over ()), 6) {c}" for c in ("cost", "strength", "willpower", "lore", "days_since_launch"))
        + " from (select id, name, rarity, cast(dense_rank() over (order by name) - 1 as integer) character_id, case cost % 4 when 0 then 'Character' when 1 then 'Action' when 2 then 'Item - Character' end type_clean, "
        "cast(cost as double) as cost, cast(cost % 5 as double) strength, cast(cost % 7 as double) willpower, cast(cost % 3 as double) lore, cast(released_at - date '2023-08-18' as double) days_since_launch, "
        "case when cost % 3 > 0 then retail end foil, case when cost % 9 > 0 then retail / 2 end as non from catalog)"
    ),
    "sliding_windows": _q(
        f"select card_id, start_date, {_cents('w[1:14]')} inputs, {_cents('w[15:21]')} targets from (select card_id, date start_date, list(price) over (partition by card_id order by date rows between current row and 20 following) w from prices) where len(w) = 21"
    ),
    "split_windows": _q(
        f"select card_id, split, start_date, {_cents('w[1:30]')} inputs, {_cents('w[31:45]')} targets, array_to_string(list_transform(t[31:45], lambda x: cast(x as varchar)), ',') target_dates from "
        "(select card_id, split, date start_date, list(price) over z w, list(date) over z t from parts window z as (partition by card_id, split order by date rows between current row and 44 following)) where len(w) = 45",
        "ranked as (select *, row_number() over (partition by card_id order by date desc) rn, count(*) over (partition by card_id) n from long_prices)",
        "parts as (select *, 'train' split from ranked where n >= 180 and rn > 40 union all select *, 'val' from ranked where n >= 180 and rn between 21 and 65 union all select *, 'test' from ranked where n >= 180 and rn <= 45)",
    ),
    "price_unscaled": _q("select card_id, date, round(price, 6) price from prices"),
    "split_train": _q("select card_id, date, price from (select *, row_number() over (partition by card_id order by date desc) rn from long_prices) where rn > 40"),
    "split_val": _q("select card_id, date, price from (select *, row_number() over (partition by card_id order by date desc) rn from long_prices) where rn between 21 and 65"),
    "split_test": _q("select card_id, date, price from (select *, row_number() over (partition by card_id order by date desc) rn from long_prices) where rn <= 45"),
    "context_window": _q(
        f"select card_id, cast(len(w) as integer) n, {_cents('w')} context from (select card_id, list(price order by date) w from (select *, row_number() over (partition by card_id order by date desc) rn from long_prices) where rn <= 256 group by card_id)"
    ),
    "day_offsets": _q("select *, cast(row_number() over (partition by card_id order by date) - count(*) over (partition by card_id) as integer) as \"offset\" from prices"),
    "sample_entropy": _q("select * from entropy", _ENTROPY),
    "hurst_rs": _q("select * from hurst", _ENTROPY),
    "lag1_autocorr": _q("select * from lag1", _ENTROPY),
    "ts_metrics": _q(
        "select b.*, samp_entropy, hurst_exp, lag1_corr from (select card_id, count(*) n_days, max_by(price, date) current_price, round(avg(price), 6) avg_price, round(stddev_samp(price) / nullif(avg(price), 0), 6) cv, "
        "round((avg(price ** 3) - 3 * avg(price) * avg(price ** 2) + 2 * avg(price) ** 3) / nullif(var_pop(price), 0) ** 1.5, 6) skewness from recent where n >= 10 group by card_id) b "
        "left join entropy using (card_id) left join hurst using (card_id) left join lag1 using (card_id)",
        _ENTROPY,
    ),
    "chaos_index": _q(
        "select card_id, round(net_change, 6) net_change, round(sum_of_changes, 6) sum_of_changes, round(span_range, 6) span_range, round(efficiency_ratio, 6) efficiency_ratio, round(chaos_cv, 6) chaos_cv, volatility_tier from chaos",
        _chaos("long_prices", 30),
    ),
    "cv_volatility": _q(
        "select card_id, round(avg(price), 6) avg_price, round(stddev_samp(price), 6) sd_price, round(stddev_samp(price) / nullif(avg(price), 0), 6) price_cv from chaos_r where n > 30 and rn > 30 group by card_id", _chaos("long_prices", 30)
    ),
    "tiers_by_card": _q("select card_id, volatility_tier from chaos", _chaos("long_prices", 30)),
    "tiers_by_row": _q("select card_id, date, cast(ntile(3) over (order by round(chaos_cv, 9), card_id, date) as integer) volatility_tier from prices join chaos using (card_id)", _chaos("prices", 7)),
    "exemplar_index": _q(
        "select card_id, date, price, volatility_tier, round(price / first_value(price) over (partition by card_id order by date), 6) as \"index\" from long_prices join (select volatility_tier, min(card_id) card_id from chaos group by 1) using (card_id)",
        _chaos("long_prices", 30),
    ),
    "latest_price": _q("select * from latest", _LATEST),
    "price_asof_cutoff": _q("select card_id, max(date) date, max_by(price, date) price from prices where date <= date '2024-01-20' group by card_id"),
    "momentum": _q("select * from change", _MOMENTUM),
    "momentum_movers": _q("select * from movers", _MOMENTUM),
    "movers_sparkline": _q("select card_id, tag, date, price from movers left join (select * from prices where date > (select max(date) - 7 from prices)) using (card_id)", _MOMENTUM),
    "market_daily_dive": _q(
        f"select date_pulled, id, name, set_name, rarity, {_LANGUAGE} as language, is_graded, pull_source, count(*) n_listings, round(quantile_cont(price_val, 0.05), 9) floor_price, round(avg(price_val), 9) avg_price, max(price_val) max_price from listings join catalog using (id) group by all"
    ),
    "listing_overview": _q("select date_pulled, rarity, is_graded, count(*) n from listings join catalog using (id) group by all"),
    "top20_active": _q(
        "select id, n, name, rarity from (select id, count(*) n from listings where date_pulled = (select max(date_pulled) from listings) group by id) join catalog using (id) order by n desc, id limit 20"
    ),
    "top10_active": _q(
        "select id, n, name, set_name, price, cast(row_number() over (order by n desc, id) as integer) as rank from (select id, count(*) n from listings where date_pulled = (select max(date_pulled) from listings) group by id order by n desc, id limit 10) "
        "left join catalog using (id) left join (select card_id id, max_by(price, date) price from sparse_prices group by card_id) using (id)"
    ),
    "volume_by_day": _q("select date_pulled, is_graded, count(*) n from listings group by all"),
    "raw_float_value": _q(
        "select date_pulled, round(sum(price), 2) market_cap, count(*) n_listings from listings left join (select card_id id, max_by(price, date) price from sparse_prices group by card_id) using (id) where not is_graded group by date_pulled"
    ),
    "float_value_on_day": _q(
        "select date_pulled, round(sum(n * price_then), 6) market_cap, cast(sum(n) as bigint) n_listings, cast(sum(case when price_then is not null then n else 0 end) as bigint) n_priced "
        "from (select date_pulled, id, count(*) n from listings where not is_graded group by all) l asof left join guide g on l.id = g.id and l.date_pulled >= g.price_date group by date_pulled", _GUIDE
    ),
    "listing_premiums": _q(
        "select item_id, date_pulled, case when ok then price_date end price_date, case when ok then price_then end price_then, round(price_val / nullif(case when ok then price_then end, 0) - 1, 6) premium "
        "from (select l.*, price_date, price_then, date_pulled - price_date <= 365 ok from listings l asof left join guide g on l.id = g.id and l.date_pulled >= g.price_date)", _GUIDE
    ),
    "card_listings_latest": _q("select item_id, price_val, is_graded, date_pulled from listings where id = '7' and date_pulled = (select max(date_pulled) from listings where id = '7')"),
    "card_listing_count": _q("select count(*) n, max(date_pulled) date_pulled from listings where id = '7' and date_pulled = (select max(date_pulled) from listings where id = '7')"),
    "selector_list": _q("select distinct set_name from catalog where rarity <> 'PROMO'"),
    "language_detect": _q(f"select {_LANGUAGE} as language, count(*) n from listings group by 1"),
    "display_name": _q("select id, name || ' - ' || set_name || ' - ' || rarity cardname, regexp_replace(name, '[ '']', '_', 'g') folder_name from catalog"),
    "title_filter": _q("select item_id, id, price_val, listing_title from fits", _FITS),
    "second_blacklist": _q("select id, count(*) n from listings where not regexp_matches(listing_title, 'D23|repack|pin|proxy|custom|oversized|coin|sleeve', 'i') group by id"),
    "not_promo": _q("select id, rarity from catalog where not regexp_matches(rarity, 'promo', 'i')"),
    "incremental_queue": _q(
        "select id, item_id, listing_title, name, rarity from (select distinct item_id, id, listing_title from listings where cast(split_part(item_id, '-', 1) as bigint) % 3 <> 0) join catalog using (id)"
    ),
    "parse_enrichment": _q(
        "select case when bad then 'ERROR' else 'OK' end status, case when not bad then true end is_valid, case when not bad then g end is_graded, case when not bad and g then 'PSA' end grading_company, case when not bad and g then '10' end grade_val, count(*) n "
        "from (select split_part(item_id, '-', 2) = '6' bad, listing_title like '%psa 10' g from listings) group by all"
    ),
    "rarity_in_stated_order": _q("select rarity, count(*) n, cast(coalesce(list_position(['STANDARD', 'PROMO', 'SMALL'], rarity) - 1, 3) as integer) place from catalog group by rarity"),
    "verified_listings": _q(
        "select distinct item_id, id, price_val, date_pulled, g is_graded, case when g then 'PSA' end grading_company, case when g then '10' end grade_val from (select *, listing_title like '%psa 10' g from listings) where split_part(item_id, '-', 2) <> '6'"
    ),
    "cheapest_listings": _q(
        "select id, name, item_id, price_val from (select id, item_id, price_val, row_number() over (partition by id order by price_val, item_id) rn from listings) join catalog using (id) where rn <= 3"
    ),
    "fetched_pages": _q(
        "select cast(ceil(k / 20.0) as integer) batch, cast(floor(((k - 1) % 20) / 7) as integer) page, tcgplayer_id id, cast(list_sum(list_transform(string_split(cast(tcgplayer_id as varchar), ''), lambda c: cast(c as integer))) as integer) price "
        "from (select tcgplayer_id, row_number() over (order by tcgplayer_id) k from (select distinct tcgplayer_id from catalog))"
    ),
    "observed_rates": _q(
        "select count(*) rows_written, count(*) as rows, round(avg(is_graded::int), 6) graded, round(avg(coalesce(ok, 0)), 6) matched, round(avg(coalesce(price_val >= 20, false)::int), 6) dear "
        "from listings left join (select distinct item_id, 1 ok from fits) using (item_id)", _FITS
    ),
    "api_listings": _q(
        "select item_id, listing_title, price_val, regexp_matches(lower(listing_title), 'psa|cgc|bgs|sgc|grade|graded|slab') is_graded, case n % 3 when 1 then 'FIXED_PRICE' when 2 then 'AUCTION, BEST_OFFER' else 'UNKNOWN' end listing_type, cast(date_pulled as varchar) posted_date "
        "from (select *, cast(split_part(item_id, '-', 2) as integer) n from listings)"
    ),
    "files_by_id": "select distinct strftime(o_orderdate, '%Y%m') id, 'year=' || year(o_orderdate) || '/file=' || strftime(o_orderdate, '%Y%m') || '.front' folder from orders where month(o_orderdate) <> 1",
    "column_probe": _q("select card_id, cast(null as date) date, price from prices"),
    "lenient_casts": "select p_partkey, case when p_partkey % 3 = 1 then cast(p_size as double) end as cost, case when p_partkey % 3 = 1 then p_size else 0 end cost_code from part",
    "create_if_absent": _q("select distinct item_id, true is_valid from listings where split_part(item_id, '-', 2) <> '6'"),
    "csv_inferred": _q("select * from prices"),
    "batch_forecast": _q(
        "select card_id, target[1] - 1 run_date, target[h] target_date, round(quantile_cont(last + step * 0.1 * k * h, 0.5), 4) pred_price, round(quantile_cont(last + step * 0.1 * k * h, 0.1), 4) conf_low, round(quantile_cont(last + step * 0.1 * k * h, 0.9), 4) conf_high, 'Drift' model "
        "from b, range(1, 31) r(h), range(8, 13) s(k) group by card_id, target, h",
        "whole as (select card_id, list(price order by date) p, list(date order by date) t from long_prices group by card_id having count(*) >= 180)",
        "seen as (select card_id, p[greatest(len(p) - 30 - 255, 1):len(p) - 30] c, t[len(t) - 29:] target from whole)",
        "b as (select card_id, target, c[len(c)] as last, (c[len(c)] - c[1]) / greatest(1, len(c) - 1) step from seen)",
    ),
    "error_loess": _q(
        "select model, x0 day_offset, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)), 5) smooth from moments",
        _POOL,
        "means as (select model, cast(day_offset as double) x, avg(ape) y from pool group by all)",
        "near as (select a.model, a.x x0, b.x - a.x d, b.y, row_number() over (partition by a.model, a.x order by abs(b.x - a.x)) r, count(*) over (partition by a.model, a.x) n from means a join means b using (model))",
        "reach as (select model, x0, max(abs(d)) h from near where r <= floor(0.75 * n + 1e-5) group by all)",
        "weighed as (select *, greatest(0, 1 - (abs(d) / h) ** 3) ** 3 w from near join reach using (model, x0))",
        "moments as (select model, x0, sum(w) s0, sum(w * d) s1, sum(w * d ** 2) s2, sum(w * d ** 3) s3, sum(w * d ** 4) s4, sum(w * y) t0, sum(w * d * y) t1, sum(w * d ** 2 * y) t2 from weighed group by all)",
    ),
    "error_by_age": _q(
        "select model, cast(x0 as bigint) days_since_release, any_value(own) n, round(case when abs(det) < 1e-9 * s0 ** 3 then t0 / s0 else (t0 * p - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det end, 5) smooth "
        "from (select *, s2 * s4 - s3 * s3 p, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) det from moments) group by all",
        _POOL,
        "e as (select card_id, model, avg(ape) mape from pool group by all)",
        "points as (select model, cast(greatest(0, newest - released_at) as double) x, count(*) n, sum(mape) t from e join catalog on id = card_id, (select max(date) newest from prices) where mape is not null group by all)",
        "near as (select a.model, a.x x0, a.n own, b.x - a.x d, b.n, b.t, sum(b.n) over (partition by a.model, a.x order by abs(b.x - a.x)) c, sum(b.n) over (partition by a.model, a.x) every from points a join points b using (model))",
        "reach as (select model, x0, min(abs(d)) h from near where c >= greatest(1, floor(0.75 * every + 1e-5)) group by all)",
        "weighed as (select *, greatest(0, 1 - (abs(d) / greatest(h, 1e-12)) ** 3) ** 3 w, d / greatest(h, 1e-12) u from near join reach using (model, x0))",
        "moments as (select model, x0, any_value(own) own, sum(w * n) s0, sum(w * n * u) s1, sum(w * n * u ** 2) s2, sum(w * n * u ** 3) s3, sum(w * n * u ** 4) s4, sum(w * t) t0, sum(w * t * u) t1, sum(w * t * u ** 2) t2 from weighed group by model, x0)",
    ),
    "metrics_by_day": _q(
        "select card_id, count(*) n_days, max_by(price, date) current_price, round(avg(price), 5) avg_price, round(stddev_samp(price) / nullif(avg(price), 0), 5) cv, "
        "round((avg(price ** 3) - 3 * avg(price) * avg(price ** 2) + 2 * avg(price) ** 3) / nullif(var_pop(price), 0) ** 1.5, 5) skewness, "
        "round(covar_pop(price, b) / nullif(stddev_pop(case when b is not null then price end) * stddev_pop(b), 0), 5) lag1_corr from l group by card_id having count(*) >= 10",
        "l as (select *, lag(price) over (partition by card_id order by date) b from prices)",
    ),
    "chaos_by_day": _q(
        "select card_id, round(net_change, 5) net_change, round(sum_of_changes, 5) sum_of_changes, round(span_range, 5) span_range, round(efficiency_ratio, 5) efficiency_ratio, round(chaos_cv, 5) chaos_cv from chaos", _chaos("prices", 7)
    ),
    "retention_delete": _q(
        "select target_date, count(*) n, any_value(gone) dropped, 0 dropped_again from resid, (select cast(count(distinct target_date) as integer) gone from resid where target_date < date '2024-04-22' - 90) "
        "where target_date >= date '2024-04-22' - 90 group by target_date", _POOL
    ),
    "queue_stream": _q("select distinct item_id, id, name from listings join catalog using (id)"),
    "scored_rounds": _q(
        "select case when bad then 'ERROR' else 'OK' end status, case when not bad then true end is_valid, case when not bad then g end is_graded, case when not bad and g then 'PSA' end grading_company, case when not bad and g then '10' end grade_val, "
        "cast(case when bad then 2 else 1 end as bigint) rounds, count(*) n from (select distinct item_id, listing_title like '%italian' bad, listing_title like '%psa 10' g from listings) group by all"
    ),
    "card_search": _q(
        "select id, date_pulled, item_id, round(any_value(price_val), 6) price_val, any_value(regexp_matches(lower(listing_title), 'psa|cgc|bgs|sgc|grade|graded|slab')) is_graded, "
        "max(case when n % 2 = 1 or pull_source = 'TEXT' then 'Text' else 'EPID' end) pull_source, any_value(case when n > 1 then 'FIXED_PRICE, AUCTION' else 'UNKNOWN' end) listing_type, cast(date_pulled as varchar) posted_date "
        "from (select *, cast(split_part(item_id, '-', 2) as integer) n from listings) group by id, date_pulled, item_id"
    ),
    "outlier_flags": _q(
        "select card_id, model, round(mape, 6) mape, coalesce(round(mape, 9) > round(a + 2 * coalesce(s, 0), 9), false) is_outlier from e join (select model, avg(mape) a, stddev_samp(mape) s from e group by model) using (model)",
        _POOL, "e as (select card_id, model, avg(ape) mape from pool group by all)",
    ),
    "union_schema_drift": _q("select id, count(*) filter (where is_graded) titles, count(*) filter (where not is_graded) sources from listings group by id"),
    "flatten_history": _q("select cast(l_suppkey as varchar) card_id, l_returnflag variant_id, cast(epoch(l_shipdate) as bigint) as timestamp, cast(l_shipdate as date) date, round(l_extendedprice, 2) price from lineitem"),
    "history_metadata": _q("select distinct cast(l_suppkey as varchar) card_id, l_returnflag variant_id from lineitem"),
    "catalog_build": _q("select id, tcgplayer_id, name, set_name, rarity, case when len(name) > 8 then name else 'none' end ink_clean from catalog where rarity in ('PROMO', 'LARGE') and tcgplayer_id % 11 > 0"),
    "mixed_dates": _q("select o_orderkey, case when o_orderkey % 3 < 2 then cast(o_orderdate as date) end as day from orders"),
    "json_props": _q("select cast(json_extract_string(props, '$.k') as integer) k, count(*) n, round(sum(value), 2) total from events group by 1"),
    "batch_requests": _q("select cast(ceil(k / 20) as integer) batch, cast(count(*) as integer) n, min(tcgplayer_id) first_id, max(tcgplayer_id) last_id from (select tcgplayer_id, row_number() over (order by tcgplayer_id) k from catalog) group by 1"),
    "offset_page": _q("select tcgplayer_id, name from catalog order by tcgplayer_id limit 25 offset 50"),
    "csv_round_trip": _q("select * from prices"),
    "missing_source": _q("select card_id, count(*) n_days, max(date) last_day from prices group by card_id"),
    "parquet_append": _q("select date, count(*) n from prices group by date"),
    "day_replace": _q("select card_id, date, round(price + case when date = date '2024-01-20' then 1 else 0 end, 6) price from prices"),
    "run_replace": _q("select run_date, model, count(*) n, 1::bigint run_ids from forecasts group by all"),
    "residual_upsert": _q("select model_type, horizon, count(*) n from residuals group by all", _POOL),
    "retention": _q("select target_date, count(*) n from residuals where target_date >= date '2024-04-20' - 90 group by all", _POOL),
    "volume_stream": _q("select cast(ts as date) as day, event_type, count(*) n from events where cast(ts as date) + 1 <= (select max(ts) from events) - interval 2 days group by all"),
    "forecast_quantiles": _q(
        "select card_id, run_date, run_date + cast(h as integer) target_date, round(quantile_cont(v, 0.5), 6) pred_price, round(quantile_cont(v, 0.1), 6) conf_low, round(quantile_cont(v, 0.9), 6) conf_high "
        "from (select card_id, date run_date, h, price * (1 + 0.01 * k * h) v from latest, range(1, 6) a(h), range(-5, 6) b(k)) group by all",
        _LATEST,
    ),
    "gru_ensemble": _q(
        "select card_id, run_date, target_date, 'Ensemble' model, round(avg(pred_price), 6) pred_price, round(avg(conf_low) filter (where model <> 'Mean'), 6) conf_low, round(avg(conf_high) filter (where model <> 'Mean'), 6) conf_high from forecasts group by 1, 2, 3"
    ),
    "forecast_current": _q(f"select {_FC} from forecasts where run_id = 2"),
    "forecast_shadow": _q(f"select {_FC} from forecasts where run_id < 2"),
    "latest_run_rows": _q("select model, count(*) n from forecasts where run_id = (select max(run_id) from forecasts) group by model"),
    "anchored_path": _q(
        "select card_id, date, price pred_price, price conf_low, price conf_high, 'Actual' model from s union all select card_id, target_date, pred_price, conf_low, conf_high, model from forecasts join s using (card_id) where run_id = 2 and target_date > date and target_date <= date + 5",
        "s as (select card_id, max(date) date, max_by(price, date) price from prices where date <= date '2024-01-20' group by card_id)",
    ),
    "shadow_path": _q(
        "select card_id, run_id, run_date, model, pred_price, target_date date from forecasts where run_id = 1 union all "
        "select f.card_id, run_id, run_date, model, p.price, run_date from (select distinct card_id, run_id, run_date, model from forecasts where run_id = 1) f join prices p on p.card_id = f.card_id and p.date = f.run_date"
    ),
    "residuals": _q("select * from residuals", _POOL),
    "residual_rollup": _q(
        "select model_type, horizon, target_date, round(avg(error_abs_pct), 6) mean_error_pct, round(quantile_cont(error_abs_pct, 0.5), 6) median_error_pct, count(card_id) card_count from residuals group by all", _POOL
    ),
    "diag_card": _q("select card_id, model, volatility_tier, round(avg(ape), 6) mape, round(max(ape), 6) max_error from pool group by all", _POOL),
    "diag_daily": _q("select target_date, model, round(avg(ape), 6) daily_mape from pool group by all", _POOL),
    "diag_volatility": _q(
        "select card_id, round(net_change, 6) net_change, round(sum_of_changes, 6) sum_of_changes, round(span_range, 6) span_range, round(efficiency_ratio, 6) efficiency_ratio, round(chaos_cv, 6) chaos_cv, volatility_tier, date '2024-01-20' diagnostic_run_date from chaos",
        _POOL,
    ),
    "diag_horizon": _q("select model, day_offset, volatility_tier, round(avg(ape), 6) horizon_mape from pool group by all", _POOL),
    "milestones": _q("select model, day_offset, volatility_tier, round(avg(ape), 6) horizon_mape from pool where day_offset in (1, 7) group by all", _POOL),
    "head_to_head": _q(
        "select card_id, round(a, 6) \"mape_Last\", round(b, 6) \"mape_MA7\", case when a <= b then 'Last' when b < a then 'MA7' end winner, round(abs(a - b), 6) margin from wide", _POOL, _HEAD
    ),
    "blowouts": _q(
        "select * from (select *, cast(row_number() over (partition by winner order by margin desc, card_id) as integer) as rank from (select card_id, round(a, 6) \"mape_Last\", round(b, 6) \"mape_MA7\", case when a <= b then 'Last' when b < a then 'MA7' end winner, round(abs(a - b), 6) margin from wide) where winner is not null) where rank <= 5",
        _POOL, _HEAD,
    ),
    "leaderboard": _q(
        "select card_id, round(a, 6) \"Last\", round(b, 6) \"MA7\", round(c, 6) \"Mean\", case least(a, b, c) when a then 'Last' when b then 'MA7' when c then 'Mean' end winner, round(greatest(a, b, c) - least(a, b, c), 6) margin from wide", _POOL, _HEAD
    ),
    "naive_baselines": _q(
        "select day_offset, 'persistence' baseline, round(avg(abs(price - l) / nullif(abs(price), 0)), 6) mape from a group by 1 union all select day_offset, 'moving_average', round(avg(abs(price - m) / nullif(abs(price), 0)), 6) from a group by 1",
        "h as (select *, row_number() over (partition by card_id order by date desc) rn from prices where date <= (select max(date) - 7 from prices))",
        "b as (select card_id, max_by(price, date) l, avg(price) m from h where rn <= 30 group by card_id)",
        "a as (select card_id, price, l, m, cast(date - (select max(date) - 7 from prices) as integer) day_offset from prices join b using (card_id) where date > (select max(date) - 7 from prices))",
    ),
    "fan_chart": _q("select model, day_offset, round(quantile_cont(ape, 0.5), 6) median_ape, round(quantile_cont(ape, 0.75), 6) p75_ape, round(quantile_cont(ape, 0.9), 6) p90_ape from pool group by all", _POOL),
    "error_ols": _q(
        "select model, round(regr_slope(mape, chaos_cv), 5) slope, round(regr_intercept(mape, chaos_cv), 5) as intercept, round(regr_r2(mape, chaos_cv), 5) r2, count(*) n from (select card_id, model, avg(ape) mape from pool group by all) join chaos using (card_id) group by model",
        _POOL,
    ),
    "error_boxstats": _q(
        "select model, volatility_tier, round(a, 6) q1, round(m, 6) median, round(b, 6) q3, round(greatest(lo, a - 1.5 * (b - a)), 6) low, round(least(hi, b + 1.5 * (b - a)), 6) high, n from "
        "(select model, volatility_tier, quantile_cont(ape, 0.25) a, quantile_cont(ape, 0.5) m, quantile_cont(ape, 0.75) b, min(ape) lo, max(ape) hi, count(ape) n from pool group by all)",
        _POOL,
    ),
    "ml_diag_table": _q(
        "select card_id, model, round(mape, 6) mape, price current_price, pred_price, round(pred_price - price, 6) change, round(100 * (pred_price - price) / nullif(price, 0), 6) pct_change from (select card_id, model, avg(ape) mape from pool group by card_id, model, volatility_tier) "
        "join latest using (card_id) join (select card_id, model, pred_price from forecasts where run_id = 2 and target_date = run_date + 7) using (card_id, model)",
        _POOL, _LATEST,
    ),
    "regression_eval": "select round(o_totalprice, 2) actual, round(o_totalprice - 1.5, 2) predicted, round((o_totalprice - 1.5) - o_totalprice, 2) difference from orders",
    "hash_split": _q("select id, case when b < 70 then 'train' when b < 85 then 'val' else 'test' end split from (select id, (tcgplayer_id * 2654435761) % 100 b from catalog)"),
    "set_rarity_trend": _q(
        "select set_name, rarity, year, 'mean_price' measure, a as value from t union all select set_name, rarity, year, 'median_price', b from t",
        "t as (select set_name, rarity, cast(date_trunc('year', date) as date) as year, round(avg(price), 6) a, round(quantile_cont(price, 0.5), 6) b from sparse_prices join catalog on card_id = id group by 1, 2, 3)",
    ),
    "rarity_by_median": _q("select rarity, m median_retail, cast(row_number() over (order by m, rarity) as integer) place from (select rarity, quantile_cont(retail, 0.5) m from catalog group by rarity)"),
    "quote_latest": _q("select id, item_id, pull_source from listings qualify row_number() over (partition by id order by pull_source desc, date_pulled, item_id) = 1"),
    "match_rate_by_day": _q("select date_pulled, round(count(ok) / count(*), 6) match_rate from listings left join (select distinct item_id, 1 ok from fits) using (item_id) group by 1", _FITS),
    "model_divergence": _q(
        "select card_id, run_id, target_date, round(abs(max(pred_price) filter (where model = 'Last') - max(pred_price) filter (where model = 'MA7')), 4) divergence from forecasts group by all"
    ),
    "blue_chip_index": _q(
        "select cast(date_trunc('year', date) as date) as year, round(sum(i * m) / sum(m), 6) index_value from (select date, m, price / first_value(price) over (partition by card_id order by date) i from long_prices join dear using (card_id)) group by 1",
        "dear as (select card_id, round(avg(price), 4) m from long_prices group by 1 order by m desc, card_id limit 50)",
    ),
}
