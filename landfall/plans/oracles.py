"""DuckDB SQL for the queries of the catalogue, written on its own from the rules."""

from __future__ import annotations

from ..operators import checks as k
from ..operators import explore as x

SALES = """
lines as (select *, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as line_no from lineitem),
signed as (select *, case when l_returnflag = 'R' and l_linestatus = 'F' then -1 else 1 end as s from lines),
sales as (
  select l_orderkey as order_no, line_no, cast(o_orderdate as date) as order_date, o_custkey as customer_code, c_name as customer_name, c_mktsegment as customer_area,
    r_name as department, n_name as sales_rep, p_type as product, p_brand as category, cast(s * cast(l_quantity as bigint) as bigint) as quantity, l_discount as discount, l_tax as tax,
    cast(s * cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint)) as bigint) as amount,
    cast(s * cast(l_quantity as bigint) * cast(round(p_retailprice * 100) as bigint) * 100 as bigint) as cost
  from signed join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey),
fact as (select *, amount - cost as profit from sales)"""
LABELS = """,
labels as (select order_no, line_no, 'quantity_typo' as kind from fact where abs(quantity) = 50
  union all select order_no, line_no, 'discount_error' from fact where discount = 0.10 and tax = 0.08
  union all select order_no, line_no, 'push_sale' from fact where quantity < 0 and day(order_date) >= 25)"""
DAILY = """,
dept_daily as (select department, order_date, cast(sum(amount) as bigint) as amount, count(distinct order_no) as orders, count(distinct customer_code) as customers from fact group by all),
daily as (select * from dept_daily union all
  select 'ALL', order_date, cast(sum(amount) as bigint), count(distinct order_no), count(distinct customer_code) from fact group by order_date)"""
DAYS = """,
cal as (select cast(unnest(generate_series((select min(order_date) from fact) - interval 4 day, (select max(order_date) from fact), interval 1 day)) as date) as d),
h0 as (select d, isodow(d) as w,
  (month(d), day(d)) in ((1,1),(2,11),(2,23),(4,29),(5,3),(5,4),(5,5),(8,11),(11,3),(11,23))
  or (isodow(d) = 1 and ((month(d) = 1 and day(d) between 8 and 14) or (month(d) in (7, 9) and day(d) between 15 and 21) or (month(d) = 10 and day(d) between 8 and 14)))
  or (month(d) = 3 and day(d) = floor(20.8431 + 0.242194 * (year(d) - 1980) - floor((year(d) - 1980) / 4)))
  or (month(d) = 9 and day(d) = floor(23.2488 + 0.242194 * (year(d) - 1980) - floor((year(d) - 1980) / 4))) as h from cal),
h1 as (select d, w, h, lag(h, 1) over (order by d) as a, lag(h, 2) over (order by d) as b, lag(h, 3) over (order by d) as c from h0),
hol as (select d, w, h or coalesce((w = 1 and a) or (w = 2 and a and b) or (w = 3 and a and b and c), false) or (month(d) = 12 and day(d) >= 30) or (month(d) = 1 and day(d) <= 3) as is_holiday
  from h1 where d >= (select min(order_date) from fact)),
grid as (select d as order_date, cast(date_trunc('month', d) as date) as month, cast(row_number() over (partition by date_trunc('month', d) order by d) as integer) as step,
  count(*) over (partition by date_trunc('month', d)) as cal_days from hol where w <= 5 and not is_holiday)"""
PANEL = """,
dense as (select g.department, grid.order_date, month, step, cal_days, coalesce(amount, 0) as amount, coalesce(orders, 0) as orders, coalesce(customers, 0) as customers
  from (select distinct department from daily) g cross join grid left join daily on daily.department = g.department and daily.order_date = grid.order_date),
panel as (select *, cast(sum(amount) over (partition by department, month) as bigint) as landing from dense),
cum as (select *, cast(sum(amount) over w as bigint) as cum_amount, cast(sum(orders) over w as bigint) as cum_orders, cast(sum(customers) over w as bigint) as cum_customers, max(amount) over w as cum_max_daily
  from panel window w as (partition by department, month order by step rows between unbounded preceding and current row)),
monthly as (select department, month, max(landing) as landing from panel group by all),
lags as (select department, month, landing, lag(landing, 1) over o as prev_month, case when count(*) over r3 = 3 then cast(sum(landing) over r3 as double) / 3 end as prev_mean3,
    lag(landing, 12) over o as prev_year, lag(landing, 13) over o as prev_year_month_before,
    case when count(*) over r3 = 3 and count(*) over p3 = 3 then cast(sum(landing) over r3 as double) / nullif(cast(sum(landing) over p3 as double), 0) end as prev_growth3
  from monthly window o as (partition by department order by month), r3 as (partition by department order by month rows between 3 preceding and 1 preceding), p3 as (partition by department order by month rows between 15 preceding and 13 preceding)),
prior as (select department, cast(month + interval 12 month as date) as month, step, cum_amount / nullif(landing, 0) as prev_progress, cum_amount as prev_cum_amount, cum_orders as prev_cum_orders from cum),
hist as (select c.*, prev_month, prev_mean3, prev_year, prev_year_month_before, prev_growth3, prev_cum_amount, prev_cum_orders,
    case when prev_progress is null and prev_year is not null and prev_cum_amount is null then 1.0 else prev_progress end as prev_progress
  from cum c left join lags l on c.department = l.department and c.month = l.month left join prior p on c.department = p.department and c.month = p.month and c.step = p.step),
feat as (select *, cal_days - step as cal_remaining, step / cal_days as cal_progress, cast(month(month) as integer) as cal_month, cast(quarter(month) as integer) as cal_quarter,
    cum_amount / step * cal_days as linear, cum_amount / nullif(prev_progress, 0) as by_progress, cum_amount / nullif(prev_year, 0) as feat_cum,
    (cum_amount / nullif(cum_orders, 0)) / nullif(prev_year / nullif(prev_cum_orders, 0), 0) as feat_unit_price_yoy, cum_orders / nullif(prev_cum_orders, 0) as feat_orders_yoy,
    cum_amount / nullif(prev_cum_amount, 0) as feat_cum_yoy, cum_max_daily / nullif(prev_year, 0) as feat_max_daily, cum_amount / step * cal_days / nullif(prev_year, 0) as feat_linear,
    cum_amount / nullif(prev_progress, 0) / nullif(prev_year, 0) as feat_by_progress, cum_amount / nullif(prev_year, 0) + (1 - step / cal_days) as feat_remaining_share,
    prev_progress as feat_prev_progress, prev_month / nullif(prev_year, 0) as feat_prev_month, prev_mean3 / nullif(prev_year, 0) as feat_prev_mean3,
    prev_year_month_before / nullif(prev_year, 0) as feat_prev_year_month_before, prev_growth3 as feat_growth3 from hist),
base as (select *, prev_year * coalesce(prev_growth3, 1.0) as base_last_year, linear as base_linear, cum_amount + prev_year * (1 - step / cal_days) as base_remaining_share,
    by_progress as base_by_progress, cast(cum_amount + prev_year - prev_cum_amount as double) as base_remaining_actual from feat),
usable as (select * from base where prev_year > 0)"""
FOLDS = """,
fm as (select month, row_number() over (order by month desc) - 1 as back, count(*) over () as n from (select distinct month from usable)),
fb as (select cast(back // 3 as bigint) as b, min(month) as val_start, max(month) as val_end, max(n) as n, count(*) as size from fm where back < 9 group by 1),
ff as (select * from fb where size = 3 and n > (b + 1) * 3),
folds as (select cast((select count(*) from ff) - 1 - b as integer) as fold, cast(val_start - interval 1 month as date) as train_end, val_start, val_end from ff),
folded as (select fold, case when month < val_start then 'train' else 'val' end as role, usable.* from usable join folds on month <= val_end)"""
SCORES = """,
long as (unpivot (select department, month, step, landing, base_last_year, base_linear, base_remaining_share, base_by_progress, base_remaining_actual from folded where role = 'val')
  on base_last_year, base_linear, base_remaining_share, base_by_progress, base_remaining_actual into name baseline value forecast)"""
QUANTS = """,
tr as (select *, (landing - cum_amount) / prev_year as target from folded where role = 'train'),
qo as (select fold, department, step, quantile_cont(target, 0.1) as a, quantile_cont(target, 0.5) as b, quantile_cont(target, 0.9) as c from tr group by all),
qa as (select fold, step, quantile_cont(target, 0.1) as a, quantile_cont(target, 0.5) as b, quantile_cont(target, 0.9) as c from tr group by all),
qj as (select v.*, list_sort([greatest(coalesce(qo.a, qa.a), 0), greatest(coalesce(qo.b, qa.b), 0), greatest(coalesce(qo.c, qa.c), 0)]) as q
  from folded v left join qo on v.fold = qo.fold and v.department = qo.department and v.step = qo.step left join qa on v.fold = qa.fold and v.step = qa.step where role = 'val'),
preds as (select fold, department, month, step, landing, cum_amount + q[1] * prev_year as pred_q10, cum_amount + q[2] * prev_year as pred_q50, cum_amount + q[3] * prev_year as pred_q90 from qj)"""

_PANEL = f"with {SALES}{DAILY}{DAYS}{PANEL} "
_FOLDS = f"with {SALES}{DAILY}{DAYS}{PANEL}{FOLDS} "
_SCORES = f"with {SALES}{DAILY}{DAYS}{PANEL}{FOLDS}{SCORES} "
_QUANTS = f"with {SALES}{DAILY}{DAYS}{PANEL}{FOLDS}{QUANTS} "
_FACT = f"with {SALES} "
_LABELS = f"with {SALES}{LABELS} "
_SCORE = "count(*) as n, round(sum(abs(forecast - landing)) / nullif(sum(abs(landing)), 0), 6) as wape, round(sum(forecast - landing) / nullif(sum(landing), 0), 6) as bias from long where forecast is not null"


def _round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


FEATURES = "feat_cum feat_unit_price_yoy feat_orders_yoy feat_cum_yoy feat_max_daily feat_linear feat_by_progress feat_remaining_share feat_prev_progress feat_prev_month feat_prev_mean3 feat_prev_year_month_before feat_growth3"

sales_fact_profile = _FACT + "select quantity < 0 as negative, count(*) as n, cast(sum(amount) as bigint) as amount, cast(sum(cost) as bigint) as cost, cast(sum(profit) as bigint) as profit, cast(sum(quantity) as bigint) as quantity from fact group by 1"
business_day_grid = f"with {SALES}{DAYS} select * from grid"
holiday_flags = f"with {SALES}{DAYS} select d as date, is_holiday from hol"
calendar_features = f"with {SALES}{DAYS} select d as date, cast(w as tinyint) as cal_dow, cast(month(d) as tinyint) as cal_month, cast(day(d) as tinyint) as cal_day, cast(week(d) as tinyint) as cal_week, cast(dayofyear(d) as smallint) as cal_doy, cast(is_holiday as tinyint) as cal_is_holiday, cast(w >= 6 as tinyint) as cal_is_weekend, cast(day(d) <= 5 as tinyint) as cal_is_month_start, cast(day(d) >= 25 as tinyint) as cal_is_month_end, " + ", ".join(
    f"round({f}(2 * pi() * {n} * dayofyear(d) / 365.25), 9) as cal_yearly_{f}_{n}" for n in (1, 2, 3) for f in ("sin", "cos")
) + " from hol"
daily_by_department = f"with {SALES}{DAILY} select * from dept_daily"
daily_with_company = f"with {SALES}{DAILY} select * from daily"
dense_panel = _PANEL + "select * from panel"
landing_cumulative = _PANEL + "select * from cum"
monthly_lags = _PANEL + "select department, month, landing, prev_month, round(prev_mean3, 6) as prev_mean3, prev_year, prev_year_month_before, round(prev_growth3, 6) as prev_growth3 from lags"
prior_year_progress = _PANEL + "select department, month, step, round(prev_progress, 6) as prev_progress, prev_cum_amount, prev_cum_orders from hist"
landing_features = _PANEL + f"select department, month, step, cal_days, cal_remaining, cal_month, cal_quarter, {_round('cal_progress ' + FEATURES)}, {_round('linear by_progress', 0)} from feat"
landing_baselines = _PANEL + f"select department, month, step, landing, cum_amount, {_round('base_last_year base_linear base_remaining_share base_by_progress base_remaining_actual', 0)} from base"
usable_rows = _PANEL + "select department, month, step, prev_year from usable"
training_target = _PANEL + "select department, month, step, round((landing - cum_amount) / prev_year, 6) as target from usable"
baseline_scores = _SCORES + f"select baseline, {_SCORE} group by baseline"
best_baseline = _SCORES + f"select baseline, {_SCORE} group by baseline order by wape, baseline limit 1"
baseline_scores_by_step = _SCORES + f"select baseline, step, {_SCORE} and step in (1, 3, 5, 10, 15, 20) group by baseline, step"
baseline_scores_by_group = _SCORES + f"select baseline, department, {_SCORE} group by baseline, department"
month_folds = _FOLDS + "select * from folds"
step_folds = f"""with {SALES}{DAYS}, s as (select order_date, row_number() over (order by order_date) as i, count(*) over () as n from grid)
select cast(f as integer) as fold, min(order_date) filter (i = 1) as train_start, min(order_date) filter (i = n - 80 + 20 * f - 5) as train_end, min(order_date) filter (i = n - 80 + 20 * f + 1) as val_start,
  min(order_date) filter (i = n - 80 + 20 * f + 20) as val_end, cast(max(n) - 80 + 20 * f - 5 as integer) as train_steps, cast(20 as integer) as val_steps from s cross join (select unnest([0, 1, 2, 3]) as f) group by f"""
fold_split_counts = _FOLDS + "select fold, role, count(*) as n from folded group by all"
point_metrics = _QUANTS + """select fold, round(sum(abs(pred_q50 - landing)) / nullif(sum(abs(landing)), 0), 4) as wape, round(avg(abs(pred_q50 - landing)), 0) as mae, round(sqrt(avg((pred_q50 - landing) * (pred_q50 - landing))), 0) as rmse,
  round(avg(case when abs(landing) + abs(pred_q50) > 0 then abs(pred_q50 - landing) * 2 / (abs(landing) + abs(pred_q50)) end), 4) as smape, round(sum(pred_q50 - landing) / nullif(sum(landing), 0), 4) as bias from preds group by fold"""
pinball_metrics = _QUANTS + "select fold, " + ", ".join(f"round(avg(greatest((landing - pred_q{q}) * {q / 100}, (landing - pred_q{q}) * ({q / 100} - 1))), 0) as pinball_q{q}" for q in (10, 50, 90)) + " from preds group by fold"
quantile_metrics = point_metrics.replace(" from preds group by fold", ", " + ", ".join(f"round(avg(greatest((landing - pred_q{q}) * {q / 100}, (landing - pred_q{q}) * ({q / 100} - 1))), 0) as pinball_q{q}" for q in (10, 50, 90)) + ", round(avg(cast(landing between pred_q10 and pred_q90 as double)), 4) as interval_coverage, cast(0.8 as double) as interval_nominal from preds group by fold")
interval_metrics = _QUANTS + "select fold, round(avg(cast(landing between pred_q10 and pred_q90 as double)), 6) as interval_coverage, cast(0.8 as double) as interval_nominal from preds group by fold"
empirical_quantile_forecast = _QUANTS + "select fold, department, month, step, landing, round(pred_q10, 0) as pred_q10, round(pred_q50, 0) as pred_q50, round(pred_q90, 0) as pred_q90 from preds"
forecast_noncrossing = _QUANTS + "select fold, count(*) filter (pred_q10 <= pred_q50 and pred_q50 <= pred_q90) as ordered, count(*) as n from preds group by fold"
encode_groups = f"with {SALES}{DAILY} select department, cast(row_number() over (order by department) - 1 as integer) as feat_department_code from (select distinct department from daily) union all select 'no such department', cast(-1 as integer)"

_YOY = """, mm as (select cast(date_trunc('month', order_date) as date) as month, cast(sum(amount) as bigint) as amount from fact group by 1),
my as (select * from (select month, amount, lag(amount, 12) over (order by month) as last_year from mm) where last_year is not null),
mg as (select sum(amount) / nullif(cast(sum(last_year) as double), 0) as growth from my)"""
_VALUES = {
    "check_yoy_wape": ("yoy_wape", _YOY, "select sum(abs(amount - last_year * growth)) / nullif(cast(sum(amount) as double), 0) as v from my, mg", f"v between {k.YOY_WAPE[0]} and {k.YOY_WAPE[1]}", f"between {k.YOY_WAPE[0]} and {k.YOY_WAPE[1]}"),
    "check_churn_ratio": ("churn_ratio", "", f"select avg(cast(l < (select max(order_date) from fact) - interval {k.CHURN_DAYS} day as double)) as v from (select max(order_date) as l from fact group by customer_code)", f"v between {k.CHURN[0]} and {k.CHURN[1]}", f"between {k.CHURN[0]} and {k.CHURN[1]}"),
    "check_anomaly_rate": ("anomaly_rate", LABELS, "select (select count(*) from (select distinct order_no, line_no from labels)) / (select count(*) from fact) as v", f"v between {k.ANOMALY[0]} and {k.ANOMALY[1]}", f"between {k.ANOMALY[0]} and {k.ANOMALY[1]}"),
    "check_large_deal_share": ("large_deal_share", "", f"select avg(cast(amount > (select median(amount) from fact where amount > 0) * {k.LARGE_TIMES} as double)) as v from fact where amount > 0", f"v between {k.LARGE[0]} and {k.LARGE[1]}", f"between {k.LARGE[0]} and {k.LARGE[1]}"),
    "check_empty_department_months": ("empty_department_months", "", "select count(distinct date_trunc('month', order_date)) * count(distinct department) - (select count(*) from (select distinct department, date_trunc('month', order_date) from fact where quantity > 0)) as v from fact", "v = 0", "0"),
    "check_orders_per_customer_month": ("orders_per_customer_month", "", "select count(distinct order_no) filter (quantity > 0) / (count(distinct customer_code) * count(distinct date_trunc('month', order_date))) as v from fact", f"v >= {k.MIN_ORDERS_PER_CUSTOMER_MONTH}", f"at least {k.MIN_ORDERS_PER_CUSTOMER_MONTH}"),
    "check_below_cost": ("below_cost", LABELS, "select count(*) as v from fact f where quantity > 0 and profit < 0 and not exists (select 1 from labels l where l.order_no = f.order_no and l.line_no = f.line_no)", "v = 0", "0"),
}


def _check(name: str, note: bool = False) -> str:
    title, _, value, passed, text = _VALUES[name]
    extra = f", case when not ({passed}) then 'expected {text}' end as note" if note else ""
    return f"select '{title}' as name, round(v, 6) as value, {passed} as passed{extra} from (select cast(v as double) as v from ({value}))"


for _name, (_, _ctes, *_rest) in _VALUES.items():
    globals()[_name] = f"with {SALES}{_ctes} {_check(_name)}"
check_report = f"with {SALES}{LABELS}{_YOY} " + " union all ".join(_check(n, True) for n in _VALUES)


def _level(name: str, keys: tuple[str, ...]) -> str:
    key = "".join(f"{c}, " for c in keys)
    part = f"partition by {', '.join(keys)}" if keys else ""
    n = f"count(distinct ({', '.join(keys)}))" if len(keys) > 1 else f"count(distinct {keys[0]})" if keys else "cast(1 as bigint)"
    return f"""select '{name}' as level, {n} as n_series, round(sum(abs(f - amount)) / nullif(sum(abs(amount)), 0), 6) as wape from (
      select *, case when count(*) over w = 5 then cast(sum(amount) over w as double) / 5 end as f from (select {key}order_date, cast(sum(amount) as bigint) as amount from fact group by all)
      window w as ({part} order by order_date rows between 5 preceding and 1 preceding)) where f is not null"""


granularity_ladder = _FACT + " union all ".join(_level(n, keys) for n, keys in x.LADDER)
monthly_naive_scores = f"""with {SALES}{_YOY}, m3 as (select * from (select amount, case when count(*) over w = 3 then cast(sum(amount) over w as double) / 3 end as f from mm window w as (order by month rows between 3 preceding and 1 preceding)) where f is not null),
e as (select 'mean3' as method, amount, f from m3 union all select 'last_year', amount, cast(last_year as double) from my union all select 'last_year_growth', amount, last_year * growth from my, mg)
select method, count(*) as n_months, round(sum(abs(amount - f)) / nullif(cast(sum(amount) as double), 0), 6) as wape from e group by method"""
_CHURN = f""", pos as (select * from fact where quantity > 0), gone as (select * from (select customer_code, max(order_date) as last_order from pos group by 1) where last_order < (select max(order_date) from pos) - interval {k.CHURN_DAYS} day)"""
churned_customers = f"with {SALES}{_CHURN} select * from gone"
_CEILING = "case product " + " ".join(f"when '{p}' then {c}" for p, c in x.CEILINGS.items()) + " end"
churn_signals = f"""with {SALES}{_CHURN} select order_date > last_order - interval {x.LATE_DAYS} day as late, count(*) as n_lines, round(avg(discount / cast({_CEILING} as double)), 4) as discount_pressure, round(avg(quantity), 1) as mean_quantity
from pos join gone using (customer_code) group by 1"""
_PAIRS = ", pairs as (select pair, count(*) as n from (select array_to_string(list_sort(list(product)), ' + ') as pair from fact where quantity > 0 group by order_no having count(*) = 2) group by pair)"
basket_pairs = f"with {SALES}{_PAIRS} select * from pairs"
basket_skew = f"with {SALES}{_PAIRS} select cast(sum(n) as bigint) as n_orders, count(*) as n_pairs, max(n) as most, min(n) as least, round(max(n) / min(n), 6) as skew, (select pair from pairs order by n desc, pair limit 1) as top_pair from pairs"
anomaly_kind_counts = _LABELS + "select kind, count(*) as n from labels group by kind"
naive_anomaly_fp_rate = _LABELS + "select count(*) as negative, count(*) filter (hit) as flagged, round(1 - count(*) filter (hit) / count(*), 6) as fp_rate from (select exists (select 1 from labels l where l.order_no = f.order_no and l.line_no = f.line_no) as hit from fact f where quantity < 0)"
unlabelled_lines = _LABELS + "select order_no, line_no, quantity, amount from fact f where not exists (select 1 from labels l where l.order_no = f.order_no and l.line_no = f.line_no)"
first_months_extract = _FACT + "select order_no, line_no, order_date, amount from fact where order_date < (select date_trunc('month', min(order_date)) + interval 3 month from fact)"
legacy_series_summary = f"""with {SALES}{DAYS}, b as (select count(*) as n_lines, count(distinct customer_code) as n_customers, count(distinct sales_rep) as n_reps, count(distinct product) as n_products,
  cast(max(order_date) - min(order_date) + 1 as bigint) as n_days, cast(sum(amount) as bigint) as amount, round(sum(profit) / nullif(cast(sum(amount) as double), 0), 6) as margin from fact),
c as (select *, (select count(*) from (select distinct department, product from fact)) as n_series, (select count(*) from (select distinct department, product, order_date from fact)) as observed, (select count(*) from grid) as n_business_days from b)
select *, round(1 - observed / (n_series * n_business_days), 6) as zero_share_business, round(1 - observed / (n_series * n_days), 6) as zero_share_days from c"""
weekday_order_counts = _FACT + "select cast(isodow(order_date) as integer) as weekday, count(*) as n from fact group by 1"
_KINDS = {
    "order_no": "bigint", "line_no": "bigint", "order_date": "date", "customer_code": "bigint", "customer_name": "string", "customer_area": "string", "department": "string", "sales_rep": "string", "product": "string",
    "category": "string", "quantity": "bigint", "discount": "double", "tax": "double", "amount": "bigint", "cost": "bigint", "profit": "bigint",
}
column_profile = _FACT + " union all ".join(f"select '{c}' as \"column\", '{t}' as kind, count(*) filter ({c} is null) as n_nulls, round(count(*) filter ({c} is null) * 100.0 / count(*), 6) as null_percent, count(distinct {c}) + cast(count(*) filter ({c} is null) > 0 as bigint) as n_unique from fact" for c, t in _KINDS.items())
numeric_summary = _FACT + " union all ".join(f"select '{c}' as \"column\", count(v) as n, count(*) filter (v is null) as n_nulls, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, min(v) as min, quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as q50, quantile_cont(v, 0.75) as q75, max(v) as max from (select cast({c} as double) as v from fact)" for c, t in _KINDS.items() if t in ("bigint", "double"))
low_cardinality_values = _FACT + " union all ".join(f"select '{c}' as \"column\", cast(value as varchar) as value from (select distinct {c} as value from fact) where (select count(distinct {c}) from fact) <= 15" for c in _KINDS)
date_span = _FACT + "select 'order_date' as \"column\", min(order_date) as first_day, max(order_date) as last_day, cast(max(order_date) - min(order_date) + 1 as bigint) as n_days, count(distinct order_date) as n_present, cast(max(order_date) - min(order_date) + 1 as bigint) - count(distinct order_date) as n_missing from fact"
duplicate_rows = "select cast(sum(c) as bigint) as n_rows, count(*) as n_distinct, cast(sum(c) as bigint) - count(*) as n_duplicates from (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, count(*) as c from lineitem group by all)"
encode_customers_products = _FACT + """select 'customer_code' as "column", count(distinct customer_code) as n, cast(count(distinct customer_code) - 1 as integer) as highest, count(distinct customer_code) as n_codes, cast(0 as bigint) as n_disordered from fact
union all select 'product', count(distinct product), cast(count(distinct product) - 1 as integer), count(distinct product), cast(0 as bigint) from fact"""
