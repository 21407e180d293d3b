"""Driver-table queries: sources, cleaning, metering, outliers, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwater.config import ColumnNames
from fieldwater.functions import codes
from fieldwater.functions.scalar import contains_text, days_in_month, is_true, month_end, month_name, one_of, season_months, zero_padded
from fieldwater.operators import clean, cropstats, features, metering, outliers, split
from fieldwater.operators.quantiles import quantiles
from fieldwater.operators.ranking import hash_rank
from fieldwater.plans import domain
from fieldwater.plans.domain import VIEW as V
from fieldwater.plans.registry import query
from fieldwater.sources import rasters, stages, tables

NARROW_FENCE = outliers.Fence(reach=0.2)


def r(column, digits: int):
    return F.round(column, digits)


# ---------------------------------------------------------------- sources


@query("scan_readings", """
    select cast(user_id as varchar) as site_no, count(*) as n, round(sum(value), 4) as total, max(value) as top
    from events group by 1""")
def scan_readings(spark, d):
    names = ColumnNames(site_id_readings="user_id", timestamp="ts", reading="value")
    rows = tables.read_readings(spark, f"{d}/events.parquet", names)
    return rows.groupBy("site_no").agg(
        F.count("datetime").alias("n"), r(F.sum("value"), 4).alias("total"), F.max("value").alias("top")
    )


@query("csv_round_trip", f"""
    select crop, yr as "Year", count(*) as n, round(sum(wu), 2) as total, max(site) as top_site
    from {V['annual']} a group by 1, 2""")
def csv_round_trip(spark, d):
    rows = domain.annual(spark, d).select(
        F.col("crop").alias("Crop(s)"),
        F.col("yr").alias("ReportYear"),
        F.col("wu").alias("AF_Acre"),
        F.col("site").cast("double").alias("Latitude"),
        F.col("mon").cast("double").alias("Longitude"),
    )
    path = tables.write_csv(rows, domain.scratch(spark, "annual") + ".csv")
    back = tables.read_annual(spark, path)
    return back.groupBy("crop", "Year").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("AF_Acre"), 2).alias("total"), F.max("lat_dd").cast("bigint").alias("top_site")
    )


@query("resolve_files", """
    select dataset, month, path, size from (
      select p_type as dataset, p_size as month, p_name as path, p_retailprice as size,
             row_number() over (partition by p_type, p_size order by p_retailprice desc, p_name desc) as k from part) t
    where k = 1""")
def resolve_files(spark, d):
    listing = domain.parts(spark, d).select(
        F.col("crop").alias("dataset"), F.col("cls").alias("month"), F.col("name").alias("path"), F.col("value").alias("size")
    )
    return rasters.pick_largest(listing, ["dataset", "month"])


@query("fallback_product", f"""
    with s as (select yr + 18 as yr, sum(val) as v from {V['cube']} q group by 1),
         o as (select yr + 18 as yr, sum(k4) as v from {V['cube']} q group by 1)
    select 'SSEBop' as dataset, yr as year, round(v, 2) as total from s
    union all
    select 'OpenET' as dataset, yr as year, round(v, 2) as total from s where yr < 2016
    union all
    select 'OpenET' as dataset, yr as year, round(v, 2) as total from o where yr >= 2016""")
def fallback_product(spark, d):
    cube = domain.cube(spark, d).withColumn("year", F.col("year") + 18)
    both = F.array(
        F.struct(F.lit("SSEBop").alias("dataset"), F.col("value").alias("v")),
        F.struct(F.lit("OpenET").alias("dataset"), F.col("k4").alias("v")),
    )
    long = cube.select("row", "col", "year", F.explode(both).alias("_p")).select("row", "col", "year", "_p.dataset", "_p.v")
    yearly = long.groupBy("dataset", "year", "row", "col").agg(F.sum("v").alias("value"))
    filled = rasters.with_fallbacks(yearly, ["OpenET", "SSEBop"])
    return filled.groupBy("dataset", "year").agg(r(F.sum("value"), 2).alias("total"))


@query("stage_reuse", f"""
    select site, cast(year(ts) as int) as yr, cast(month(ts) as int) as mon, round(sum(value), 4) as wu
    from {V['reading']} q where value >= 0 group by 1, 2, 3""")
def stage_reuse(spark, d):
    """Write the monthly totals as a stage; the second call must read it back instead of building."""
    path = domain.scratch(spark, "monthly")
    stages.stage(spark, path, lambda: monthly_total(spark, d))

    def build_again():
        raise AssertionError("the finished stage was not reused")

    return stages.stage(spark, path, build_again, reuse=True)


# ---------------------------------------------------------------- projections and filters


@query("reorder_columns", f"""
    select cast(null as double) as absent, c as across, cls as code, val as price, r as "row" from {V['cell']} a""")
def reorder_columns(spark, d):
    rows = domain.parts(spark, d).withColumnsRenamed({"col": "across", "cls": "code", "value": "price"})
    kept = clean.drop_attributes(rows, ["crop", "brand", "name"])
    return clean.order_columns(kept, [*kept.columns, "absent"], alphabetical=True)


@query("state_filter", f"""
    select state, count(*) as n, min(acres) as least from {V['site']} s
    where lower(crop) in ('building', 'machinery', 'household') and lower(crop) like '%ing%' and acres > 0
    group by state""")
def state_filter(spark, d):
    sites = domain.sites(spark, d)
    wanted = one_of(F.col("crop"), ["Building", "MACHINERY", "household"], ignore_case=True)
    rows = sites.where(wanted & contains_text(F.col("crop"), "ing") & (F.col("acres") > 0))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("acres").alias("least"))


@query("clean_rows", f"""
    select crop, count(*) as n, round(sum(value), 4) as total from {V['reading']} q
    where crop not in ('error', 'click', 'view') group by crop""")
def clean_rows(spark, d):
    spoiled = (
        F.when(F.col("crop") == "error", F.lit(float("nan")))
        .when(F.col("crop") == "click", F.lit(float("inf")))
        .when(F.col("crop") == "view", F.lit(None))
        .otherwise(F.col("value"))
    )
    rows = clean.clean_rows(domain.readings(spark, d).withColumn("value", spoiled))
    return rows.groupBy("crop").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


@query("normalize_category", """
    select case when lower(p_name) like '%red%' then 'Red' when lower(p_name) like '%small%' then 'Small' else p_name end as cat,
           count(*) as n from part group by 1""")
def normalize_category(spark, d):
    named = clean.normalize_category(F.col("name"), {"red": "Red", "small": "Small"})
    return cropstats.value_counts(domain.parts(spark, d).select(named.alias("cat")), "cat")


@query("collapse_label", """
    select case when p_name like '%ring%' then 'Rings' else trim(p_name) end as label, count(*) as n from part group by 1""")
def collapse_label(spark, d):
    label = clean.collapse_label(F.concat(F.lit(" "), F.col("name"), F.lit(" ")), "ring", "Rings")
    return cropstats.value_counts(domain.parts(spark, d).select(label.alias("label")), "label")


CROP_OF_CLASS = (
    "case cls when 1 then 'Corn' when 2 then 'Cotton' when 3 then 'Rice' when 5 then 'Soybeans' else 'Other' end"
)


@query("recode_crop", f"""
    select {CROP_OF_CLASS} as crop, count(*) as n,
           round(sum(val * case {CROP_OF_CLASS} when 'Corn' then 1.2e0 when 'Cotton' then 1.2e0 when 'Rice' then 1.2e0
                 when 'Soybeans' then 1.15e0 else 1e0 end), 3) as weighed
    from {V['cell']} a group by 1""")
def recode_crop(spark, d):
    rows = domain.parts(spark, d).withColumn("crop", clean.recode_crop(F.col("cls")))
    weighed = F.col("value") * clean.crop_coefficient(F.col("crop"))
    return rows.groupBy("crop").agg(F.count(F.lit(1)).alias("n"), r(F.sum(weighed), 3).alias("weighed"))


@query("soil_infiltration", f"""
    select r as "row", c as col, case when g in (1, 5) then 7.62e0 when g in (2, 6) then 5.715e0 when g in (3, 7) then 2.54e0
           when g in (4, 8) then 0.635e0 when g = -9999 then 4.1275e0 end as inf_rate
    from (select r, c, case when cls = 50 then -9999 else cls end as g from {V['cell']} a) t""")
def soil_infiltration(spark, d):
    group = F.when(F.col("cls") == 50, -9999).otherwise(F.col("cls"))
    rows = domain.parts(spark, d).select("row", "col", group.alias("SWB_HSG"))
    return clean.soil_group_to_infiltration(rows).withColumnRenamed("INF_RATE", "inf_rate")


@query("unit_conversion", f"""
    select r as "row", c as col, round(val * 304.8, 4) as target, round(cls * 25.4e0, 4) as irrigation, cls as soil_group,
           round((val - cls) * 25.4, 4) as effective, round(val * 304.8 * 10, 4) as volume,
           round(val * 304.8 * 2.471 * 4.047, 4) as compared
    from {V['cell']} a""")
def unit_conversion(spark, d):
    rows = domain.parts(spark, d).select(
        "row",
        "col",
        F.col("value").alias("AF_Acre"),
        F.col("cls").cast("double").alias("SWB_IRR"),
        F.col("cls").alias("SWB_HSG"),
        clean.effective_precipitation(F.col("value"), F.col("cls")).alias("EFF_PPT"),
    )
    mm = clean.to_millimetres(rows)
    return mm.select(
        "row",
        "col",
        r(F.col("AF_Acre"), 4).alias("target"),
        r(F.col("SWB_IRR"), 4).alias("irrigation"),
        F.col("SWB_HSG").alias("soil_group"),
        r(F.col("EFF_PPT"), 4).alias("effective"),
        r(clean.depth_to_volume(F.col("AF_Acre")), 4).alias("volume"),
        r(clean.depth_to_comparison_units(F.col("AF_Acre")), 4).alias("compared"),
    )


@query("season_mask", f"""
    select crop, mon, count(case when crop = '1-URGENT' or mon between 4 and 9 then wu end) as n_kept, count(*) as n
    from {V['annual']} a group by 1, 2""")
def season_mask(spark, d):
    kept = clean.mask_outside_season(F.col("wu"), F.col("crop"), F.col("mon"), "1-URGENT")
    return domain.annual(spark, d).groupBy("crop", "mon").agg(F.count(kept).alias("n_kept"), F.count(F.lit(1)).alias("n"))


@query("impute_flag", f"""
    select crop, count(*) as n, cast(count(case when cls > 40 or cls < 5 then 1 end) as bigint) as n_missing,
           round(sum(case when cls > 40 then 0 else val end), 3) as filled
    from {V['cell']} a group by crop""")
def impute_flag(spark, d):
    rows = domain.parts(spark, d).select(
        "crop",
        F.when(F.col("cls") <= 40, F.col("value")).alias("a"),
        F.when(F.col("cls") < 5, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("b"),
    )
    filled = clean.impute_remembering(rows, ["a", "b"])
    return filled.groupBy("crop").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("any_missing").alias("n_missing"), r(F.sum("a"), 3).alias("filled")
    )


@query("scalar_dates", f"""
    select cast(year(ts) as int) as yr, lpad(cast(month(ts) as varchar), 2, '0') as mm, strftime(ts, '%b') as label,
           cast(day(last_day(ts)) as int) as days, cast(last_day(ts) as varchar) as month_end, count(*) as n
    from {V['cube']} q group by 1, 2, 3, 4, 5""")
def scalar_dates(spark, d):
    rows = domain.cube(spark, d)
    return rows.groupBy(
        F.col("year").alias("yr"),
        zero_padded(F.col("month")).alias("mm"),
        month_name(F.col("month")).alias("label"),
        days_in_month(F.col("year"), F.col("month")).alias("days"),
        month_end(F.col("ts")).cast("string").alias("month_end"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("season_calendar", f"""
    select distinct case when m >= 10 then yr - 1 else yr end as year, m as month
    from (select distinct yr from {V['annual']} a) y cross join (select unnest(generate_series(1, 12)) as m) g
    where m >= 10 or m <= 9""")
def season_calendar(spark, d):
    years = domain.annual(spark, d).select(F.col("yr").alias("year")).distinct()
    months = season_months(years, 10, 9)
    return months.select("year", F.col("month").cast("bigint").alias("month"))


# ---------------------------------------------------------------- metering


@query("monthly_total", f"""
    select site, cast(year(ts) as int) as yr, cast(month(ts) as int) as mon, round(sum(value), 4) as wu
    from {V['reading']} q where value >= 0 group by 1, 2, 3""")
def monthly_total(spark, d):
    totals = metering.monthly_totals(domain.readings(spark, d), "site", "ts")
    return totals.select("site", F.col("Year").alias("yr"), F.col("Month").alias("mon"), r(F.col("value"), 4).alias("wu"))


@query("use_per_acre", f"""
    select m.site, m.mon, s.crop, round(m.wu / s.acres, 6) as per_acre
    from (select site, cast(month(ts) as int) as mon, sum(value) as wu from {V['reading']} q where value >= 0 group by 1, 2) m
    join {V['site']} s on m.site = s.site where s.acres > 0""")
def use_per_acre(spark, d):
    totals = metering.monthly_totals(domain.readings(spark, d), "site", "ts")
    joined = metering.use_per_area(totals, domain.sites(spark, d), ["site"])
    return joined.select("site", F.col("Month").alias("mon"), "crop", r(F.col("AF_Acre"), 6).alias("per_acre"))


@query("climatology", f"""
    select mon, cast(cast(avg(m) as float) as double) as wu from (select site, yr, mon, avg(wu) as m from {V['annual']} a group by 1, 2, 3) q group by mon""")
def climatology(spark, d):
    rows = domain.annual(spark, d).groupBy("site", "yr", F.col("mon").alias("Month")).agg(F.avg("wu").alias("value"))
    return metering.climatology(rows).select(F.col("Month").alias("mon"), F.col("value").cast("float").cast("double").alias("wu"))


@query("weights", f"select crop, mon, round(wt, 8) as wt from {V['weight']} w")
def weights(spark, d):
    made = metering.monthly_weights(domain.profile(spark, d))
    return made.select("crop", F.col("month").alias("mon"), r(F.col("weight"), 8).alias("wt"))


@query("disaggregate", f"""
    select a.crop, a.yr, w.mon, round(sum(a.wu * w.wt), 2) as wu, count(*) as n
    from {V['annual']} a join {V['weight']} w on a.crop = w.crop group by 1, 2, 3""")
def disaggregate(spark, d):
    spread = metering.disaggregate(domain.annual(spark, d).drop("mon"), metering.monthly_weights(domain.profile(spark, d)), "wu")
    return spread.groupBy("crop", "yr", F.col("Month").alias("mon")).agg(
        r(F.sum("wu"), 2).alias("wu"), F.count(F.lit(1)).alias("n")
    )


FENCED = f"""
    select a.* from {V['annual']} a join (select crop, quantile_cont(wu, 0.25) as q1, quantile_cont(wu, 0.75) as q3
    from {V['annual']} b group by crop) f on a.crop = f.crop where a.wu <= f.q3 + 0.2 * (f.q3 - f.q1)"""


@query("monthly_estimates", f"""
    select t.crop, t.yr, w.mon, round(sum(t.wu * w.wt), 2) as wu, count(*) as n
    from ({FENCED}) t join {V['weight']} w on t.crop = w.crop group by 1, 2, 3""")
def monthly_estimates(spark, d):
    """The flagship: fence the annual readings by class, spread them over the months, total by class and month."""
    rows = domain.annual(spark, d).select("id", "crop", "yr", "wu")
    kept = outliers.remove_outliers(rows, "wu", "crop", "yr", outliers.BY_CROP, NARROW_FENCE, crops=None)
    spread = metering.disaggregate(kept, metering.monthly_weights(domain.profile(spark, d)), "wu")
    return spread.groupBy("crop", "yr", F.col("Month").alias("mon")).agg(
        r(F.sum("wu"), 2).alias("wu"), F.count(F.lit(1)).alias("n")
    )


@query("relative", f"select id, crop, round(wu / avg(wu) over (partition by crop), 6) as rel from {V['annual']} a")
def relative(spark, d):
    made = metering.relative_to_group(domain.annual(spark, d), ["wu"], "crop")
    return made.select("id", "crop", r(F.col("Relative_wu"), 6).alias("rel"))


@query("union_sources", f"""
    select data, count(*) as n, count(acres) as with_acres from (select 'RT' as data, site, acres from {V['site']} s
    union all select 'VMP' as data, site, cast(null as double) as acres from {V['annual']} a) t group by data""")
def union_sources(spark, d):
    metered = domain.sites(spark, d).select(F.lit("RT").alias("data"), "site", "acres")
    reported = domain.annual(spark, d).select(F.lit("VMP").alias("data"), "site")
    both = metered.unionByName(reported, allowMissingColumns=True)
    return both.groupBy("data").agg(F.count(F.lit(1)).alias("n"), F.count("acres").alias("with_acres"))


@query("null_safe_split", f"""
    select count(case when coalesce(s.state = 3 or a.crop = '5-LOW', false) then 1 end) as linked,
           count(case when not coalesce(s.state = 3 or a.crop = '5-LOW', false) then 1 end) as passed
    from {V['annual']} a left join {V['site']} s on a.site = s.site and s.acres > 5000""")
def null_safe_split(spark, d):
    rich = domain.sites(spark, d).where(F.col("acres") > 5000).select("site", "state")
    rows = domain.annual(spark, d).join(rich, "site", "left")
    linked = is_true((F.col("state") == 3) | (F.col("crop") == "5-LOW"))
    return rows.agg(F.count_if(linked).alias("linked"), F.count_if(~linked).alias("passed"))


# ---------------------------------------------------------------- outliers and quantiles


@query("outlier_global", f"""
    select a.id, a.crop, a.wu from {V['annual']} a cross join (select quantile_cont(wu, 0.25) as q1, quantile_cont(wu, 0.75) as q3
    from {V['annual']} b) f where a.wu <= f.q3 + 0.2 * (f.q3 - f.q1)""")
def outlier_global(spark, d):
    rows = domain.annual(spark, d).select("id", "crop", "yr", "wu")
    kept = outliers.remove_outliers(rows, "wu", "crop", "yr", outliers.GLOBAL, NARROW_FENCE, crops=None)
    return kept.select("id", "crop", "wu")


def _audit(group: str) -> str:
    return f"""
    with f as (select {group}, quantile_cont(wu, 0.25) as q1, quantile_cont(wu, 0.75) as q3 from {V['annual']} a group by {group})
    select a.{group}, count(*) as n_rows, count(case when a.wu > f.q3 + 0.2 * (f.q3 - f.q1) then 1 end) as flagged
    from {V['annual']} a join f on a.{group} = f.{group} group by a.{group}"""


@query("outlier_by_crop", _audit("crop"))
def outlier_by_crop(spark, d):
    flagged = outliers.flag_outliers(domain.annual(spark, d), "wu", "crop", "yr", outliers.BY_CROP, NARROW_FENCE)
    return outliers.outlier_audit(flagged, "crop")


@query("outlier_by_year", _audit("yr"))
def outlier_by_year(spark, d):
    flagged = outliers.flag_outliers(domain.annual(spark, d), "wu", "crop", "yr", outliers.BY_YEAR, NARROW_FENCE)
    return outliers.outlier_audit(flagged, "yr")


CROP_OF_CLASS_NAME = {
    "1-URGENT": "Rice", "2-HIGH": "Fish Culture", "3-MEDIUM": "Soybeans", "4-NOT SPECIFIED": "Peanuts", "5-LOW": "Corn",
}


@query("outlier_limits", f"""
    select crop, count(*) as kept, round(max(feet), 6) as top from (
      select case crop when '1-URGENT' then 'Rice' when '2-HIGH' then 'Fish Culture' when '3-MEDIUM' then 'Soybeans'
             when '5-LOW' then 'Corn' end as crop, wu / 40000 as feet from {V['annual']} a) t
    where crop is not null and feet <= case crop when 'Rice' then 8 when 'Fish Culture' then 10 else 5 end group by crop""")
def outlier_limits(spark, d):
    named = clean.normalize_category(F.col("crop"), CROP_OF_CLASS_NAME)
    rows = domain.annual(spark, d).select("id", named.alias("crop"), "yr", (F.col("wu") / 40000).alias("feet"))
    kept = outliers.remove_outliers(rows, "feet", "crop", "yr", outliers.FIXED_LIMIT)
    return kept.groupBy("crop").agg(F.count(F.lit(1)).alias("kept"), r(F.max("feet"), 6).alias("top"))


@query("boxplot", f"""
    with f as (select crop, quantile_cont(wu, 0.25) as q1, quantile_cont(wu, 0.5) as med, quantile_cont(wu, 0.75) as q3
               from {V['annual']} a group by crop)
    select a.crop, round(max(q1), 4) as q1, round(max(med), 4) as med, round(max(q3), 4) as q3,
           min(case when wu >= q1 - 0.4 * (q3 - q1) and wu <= q3 + 0.4 * (q3 - q1) then wu end) as whisker_low,
           max(case when wu >= q1 - 0.4 * (q3 - q1) and wu <= q3 + 0.4 * (q3 - q1) then wu end) as whisker_high,
           count(case when wu < q1 - 0.4 * (q3 - q1) or wu > q3 + 0.4 * (q3 - q1) then 1 end) as n_outliers
    from {V['annual']} a join f on a.crop = f.crop group by a.crop""")
def boxplot(spark, d):
    stats = cropstats.box_stats(domain.annual(spark, d), ["crop"], "wu", reach=0.4)
    return stats.withColumns({c: r(F.col(c), 4) for c in ("q1", "med", "q3")})


@query("quantiles_ranked", f"""
    select crop, round(quantile_cont(wu, 0.05), 4) as p05, round(quantile_cont(wu, 0.5), 4) as p50,
           round(quantile_cont(wu, 0.95), 4) as p95 from {V['annual']} a group by crop""")
def quantiles_ranked(spark, d):
    """With a coarse sketch, so that brackets do not hold their whole group."""
    made = quantiles(domain.annual(spark, d), ["crop"], "wu", [0.05, 0.5, 0.95], ["p05", "p50", "p95"], accuracy=50)
    return made.withColumns({c: r(F.col(c), 4) for c in ("p05", "p50", "p95")})


def _extreme(order: str) -> str:
    """Every 7th reading infinite, every 11th minus infinite, every 13th missing; others with a heavy tail."""
    return (
        f"case when {order} % 7 = 0 then cast('inf' as double) when {order} % 11 = 0 then cast('-inf' as double) "
        f"when {order} % 13 = 0 then cast('nan' as double) when {order} % 17 = 0 then wu * 1e200 else wu end"
    )


@query("quantiles_extremes", f"""
    with v as (select crop, {_extreme('id')} as v from {V['annual']} a),
    g as (select 'all' as scope, v from v where not isnan(v) union all select crop, v from v where not isnan(v)),
    k as (select scope, v, row_number() over (partition by scope order by v) as r, count(*) over (partition by scope) as n from g),
    p as (select * from (values ('p05', 0.05), ('p50', 0.5), ('p80', 0.8), ('p99', 0.99)) t(name, p)),
    e as (select scope, name, max(v) filter (r = floor((n - 1) * p) + 1) as lo, max(v) filter (r = ceil((n - 1) * p) + 1) as hi,
          max((n - 1) * p - floor((n - 1) * p)) as part from k, p group by scope, name),
    q as (select scope, name, case when part = 0 or lo = hi or isinf(lo) then lo when isinf(hi) then hi else lo + part * (hi - lo) end as x from e)
    select scope, max(case when name = 'p05' then cast(x as varchar) end) = '-inf' as low_is_infinite,
           max(round(case when name = 'p50' then x end, 4)) as p50, max(case when name = 'p80' and isinf(x) then 1 when name = 'p80' then 0 end) as p80_infinite,
           max(case when name = 'p99' then cast(x as varchar) end) = 'inf' as high_is_infinite
    from q group by scope""")
def quantiles_extremes(spark, d):
    """Quantiles among infinities, NaN and a heavy tail, by class and over all rows."""
    rows = domain.annual(spark, d).select("crop", F.expr(_extreme("id").replace("'inf'", "'Infinity'").replace("'-inf'", "'-Infinity'")).alias("v"))
    probs, names = [0.05, 0.5, 0.8, 0.99], ["p05", "p50", "p80", "p99"]
    made = quantiles(rows, ["crop"], "v", probs, names, accuracy=200).withColumnRenamed("crop", "scope").unionByName(
        quantiles(rows, [], "v", probs, names, accuracy=200).withColumn("scope", F.lit("all"))
    )
    infinite = F.lit(float("inf"))
    return made.select(
        "scope", (F.col("p05") == -infinite).alias("low_is_infinite"), r(F.col("p50"), 4).alias("p50"),
        (F.abs("p80") == infinite).cast("int").alias("p80_infinite"), (F.col("p99") == infinite).alias("high_is_infinite"),
    )


# ---------------------------------------------------------------- splits, folds, samples


@query("holdout", f"""
    select id, crop from (select id, crop, row_number() over (partition by crop order by md5(concat('42|', cast(id as varchar))), id) as k,
    count(*) over (partition by crop) as n from {V['annual']} a) t where k <= ceil(n * 0.2)""")
def holdout(spark, d):
    parted = split.split_train_test(domain.annual(spark, d), "id", 2, 0.2, None, "yr", "crop", seed=42)
    return parted.where(F.col("DATA") == split.TEST).select("id", "crop")


@query("year_holdout", f"""
    select case when yr in (1996, 2000) then 'TEST' else 'TRAIN' end as split, yr, count(*) as n from {V['annual']} a group by 1, 2""")
def year_holdout(spark, d):
    parted = split.split_train_test(domain.annual(spark, d), "id", 1, test_years=(1996, 2000), year_col="yr")
    return parted.groupBy(F.col("DATA").alias("split"), "yr").agg(F.count(F.lit(1)).alias("n"))


@query("random_split", f"""
    select id from (select id, row_number() over (order by md5(concat('7|', cast(id as varchar))), id) as k,
    count(*) over () as n from {V['annual']} a) t where k <= ceil(n * 0.25)""")
def random_split(spark, d):
    parted = split.split_train_test(domain.annual(spark, d), "id", 0, 0.25, seed=7)
    return parted.where(F.col("DATA") == split.TEST).select("id")


@query("kfold", f"""
    select crop, fold, count(*) as n, cast(sum(id) as bigint) as ids from (select id, crop, cast((row_number() over (partition by crop
    order by md5(concat('0|', cast(id as varchar))), id) - 1) % 5 as int) as fold from {V['annual']} a) t group by 1, 2""")
def kfold(spark, d):
    folded = split.repeated_folds(domain.annual(spark, d), "id", 5, 1, ["crop"], seed=0)
    return folded.groupBy("crop", F.col("fold_0").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")
    )


@query("group_sample", f"""
    select id, crop, yr from (select id, crop, yr, row_number() over (partition by crop, yr
    order by md5(concat('1|', cast(id as varchar))), id) as k from {V['annual']} a) t where k <= 100""")
def group_sample(spark, d):
    return split.sample_per_group(domain.annual(spark, d), ["crop", "yr"], "id", 100, seed=1).select("id", "crop", "yr")


@query("hash_order", f"""
    select id, cast(row_number() over (partition by status order by md5(concat('5|', cast(id as varchar))), id) as bigint) as rank
    from {V['annual']} a""")
def hash_order(spark, d):
    return hash_rank(domain.annual(spark, d), ["status"], "id", 5).select("id", "rank")


# ---------------------------------------------------------------- features


@query("minmax", f"""
    select a.id, round((a.wu - b.lo) / (b.hi - b.lo), 8) as s, round(a.wu, 4) as back
    from {V['annual']} a cross join (select min(wu) as lo, max(wu) as hi from {V['annual']} q) b""")
def minmax(spark, d):
    rows = domain.annual(spark, d).select("id", "wu")
    scaler = features.MinMaxScaler.fit(rows, ["wu"])
    scaler = features.MinMaxScaler.from_table(scaler.table(spark))
    scaled = scaler.transform(rows)
    back = scaler.unscale("wu", F.col("wu"))
    return scaled.select("id", r(F.col("wu"), 8).alias("s"), r(back, 4).alias("back"))


@query("onehot", f"""
    select crop, {', '.join(f'cast(sum(case when mon = {m} then 1 else 0 end) as bigint) as month_{m}' for m in range(1, 13))}
    from {V['annual']} a group by crop""")
def onehot(spark, d):
    coded = features.one_hot(domain.annual(spark, d).withColumnRenamed("mon", "month"), {"month": features.MONTHS})
    return coded.groupBy("crop").agg(*[F.sum(f"month_{m}").cast("bigint").alias(f"month_{m}") for m in features.MONTHS])


@query("undo_onehot", f"select crop, mon, count(*) as n from {V['annual']} a group by 1, 2")
def undo_onehot(spark, d):
    rows = domain.annual(spark, d)
    words = features.vocabulary(rows, "crop")
    coded = features.one_hot(rows, {"crop": words, "mon": features.MONTHS})
    return coded.groupBy(
        features.undo_one_hot(coded, "crop", words).alias("crop"), features.undo_one_hot(coded, "mon", features.MONTHS).alias("mon")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("topk", f"""
    select crop, n from (select crop, count(*) as n from {V['annual']} a group by crop) t order by n desc, crop limit 3""")
def topk(spark, d):
    return cropstats.value_counts(domain.annual(spark, d), "crop").limit(3)


@query("month_order", f"""
    select mon, strftime(make_date(2001, mon, 1), '%b') as label, count(distinct crop) as crops, min(wu) as least
    from {V['annual']} a group by 1, 2""")
def month_order(spark, d):
    rows = domain.annual(spark, d).groupBy("mon").agg(F.count_distinct("crop").alias("crops"), F.min("wu").alias("least"))
    return rows.orderBy("mon").select("mon", month_name(F.col("mon")).alias("label"), "crops", "least")


@query("distinct_values", f"select distinct crop, yr from {V['annual']} a")
def distinct_values(spark, d):
    return domain.annual(spark, d).select("crop", "yr").distinct()


