"""SQL for the same results, written independently of the operators and run by DuckDB on the same tables."""

from __future__ import annotations

# Substrings that mark a category, from top to bottom, and the wind components; the caption of each step.
TEMPERATURE = ["temp", "tas", "t2m", "tmax", "tmin", "tasmax", "tasmin", "air_temp", "t_ref", "2m_temperature"]
RAINFALL = ["pr", "precip", "rain", "prc", "prcp", "tp", "precipitation"]
WIND = ["uas", "vas", "u10", "v10", "wind", "wnd", "sfcwind", "u_wind", "v_wind", "ws"]
HUMIDITY = ["hurs", "huss", "rh", "humid", "q2m", "specific_humidity", "relative_humidity"]
SNOW = ["snw", "snd", "snowfall", "snow_depth", "snc", "snowcover", "snow"]
WIND_U, WIND_V = ["uas", "u10", "u_wind"], ["vas", "v10", "v_wind"]
CATEGORY_KEYS = {"temperature": TEMPERATURE, "rainfall": RAINFALL, "wind": WIND, "humidity": HUMIDITY, "snow": SNOW}
CAPTIONS = [
    "Baseline conditions – a reference climate state.",
    "First notable shift – emerging anomalies in the field.",
    "Stronger event – larger departures from the baseline.",
    "Persistent change – anomalies becoming the new normal.",
    "Extreme episode – peak intensity in this record.",
    "Post‑event climate – residual changes after extremes.",
]


def q(x: str) -> str:
    """Six digits, cut off the ties."""
    return f"floor(({x}) * 1000000 + 0.123) / 1000000"


def place(key: str, lon_steps: str = "") -> str:
    return (
        f"cast(-60 + 30 * ({key} % 5) as double) as lat, "
        f"cast(-144 + 72 * (({key} // 5){lon_steps}) as double) as lon"
    )


GRIDS = {
    "t": f"""select cast(o_orderdate as date) as time, {place("c_nationkey")},
        cast(floor(max(o_totalprice) * 64 / 10000) as double) / 64 as value
        from orders join customer on o_custkey = c_custkey group by 1, 2, 3""",
    "r": f"""select date_trunc('minute', ts) as time, {place("user_id", " % 5")},
        cast((cast(sum(cast(round(value * 100) as bigint)) as bigint) * 64) // 100 as double) / 64 as value
        from events group by 1, 2, 3""",
    "w": f"""select cast(l_shipdate as date) as time, {place("l_suppkey", " % 5")},
        min(l_quantity) - cast(25.5 as double) as u,
        cast(min(cast(round(l_tax * 100) as int) - 4) * 6 as double) as v,
        cast(sum(cast(round(l_discount * 100) as int)) as double) * 10 / count(*) as hurs
        from lineitem group by 1, 2, 3""",
    "lev": f"""select cast(l_shipdate as date) as time, l_linenumber as lev, {place("l_suppkey", " % 5")},
        max(l_quantity) as value from lineitem group by 1, 2, 3, 4""",
    "runs_wide": f"""select l_linenumber as run, cast(l_shipdate as date) as time, {place("l_suppkey", " % 5")},
        min(l_quantity) as a, min(l_discount) as b, min(l_tax) as c from lineitem group by 1, 2, 3, 4""",
}
# Later grids that build on earlier ones.
DERIVED = {
    "h": ("w", "select time, lat, lon, hurs as value from w"),
    "gappy": (
        "h",
        """select time, lat, lon, case when value < 30 then null when value > 90 then 'infinity'::double
           else value end as value from h""",
    ),
    "ts": ("t", "select time, avg(value) as value from t group by 1"),
    "rs": ("r", "select time, avg(value) as value from r group by 1"),
    "axis": ("t", "select time, cast(row_number() over (order by time) - 1 as int) as time_idx from (select distinct time from t)"),
    "uv": ("w", "select *, sqrt(u * u + v * v) as speed from w"),
    "runs": (
        "runs_wide",
        """select 'run' || run as dataset_id, time, lat, lon,
             case run % 4 when 0 then 'tas' when 1 then 'uas' when 2 then 'hurs' else 'snw' end as variable, a as value from runs_wide
           union all select 'run' || run, time, lat, lon,
             case run % 4 when 0 then 'pr' when 1 then 'vas' when 2 then 'u10' else 'sst' end, b from runs_wide
           union all select 'run' || run, time, lat, lon,
             case run % 4 when 0 then 'sfcWind' when 1 then 'hurs' when 2 then 'precip' else 'prsn' end, c from runs_wide""",
    ),
    "cat": (
        "runs",
        """select dataset_id, variable, count(distinct time) as n_time, count(distinct lat) as n_lat,
             count(distinct lon) as n_lon, count(*) as n_cells, count(value) as n_present,
             cast(row_number() over (partition by dataset_id order by variable) - 1 as int) as ordinal
           from runs group by 1, 2""",
    ),
}
WORDS = """words as (select doc_id as dataset_id, unnest(found) as variable, generate_subscripts(found, 1) - 1 as ordinal
  from (select doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') as found from documents))"""


def given(*grids: str) -> str:
    """The WITH clause that defines the named grids and what they build on."""
    needed: list[str] = []
    for name in grids:
        chain = [name]
        while chain[-1] in DERIVED:
            chain.append(DERIVED[chain[-1]][0])
        needed += [n for n in reversed(chain) if n not in needed]
    body = ", ".join(f"{n} as ({GRIDS.get(n) or DERIVED[n][1]})" for n in needed)
    return f"with {body} "


def histogram(value: str, table: str, by: str = "") -> str:
    """Bins of the narrowest round width that needs at most 40 of them."""
    widths = ", ".join(f"{m}e{k}::double" for k in range(-12, 15) for m in (1, 2, 5))
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    using = f"join layout using ({by})" if by else "cross join layout"
    return f""", present as (select {keys}{value} as x from {table} where {value} is not null and abs({value}) < 'infinity'::double),
      limits as (select {keys}min(x) as lo, max(x) as hi from present {group}),
      layout as (select {keys}case when lo = hi then 1.0::double else (select min(s) from (select unnest([{widths}]) as s)
          where s >= (hi - lo) / 40 and floor(hi / s) - floor(lo / s) + 1 <= 40) end as width, lo, hi from limits),
      binned as (select {keys}cast(floor((x - start) / width) as int) as bin, start, width from
        (select present.*, width, case when lo = hi then lo else floor(lo / width) * width end as start from present {using}))
      select {keys}bin, start + bin * width as bin_start, start + (bin + 1) * width as bin_end, count(*) as n
      from binned group by {keys}bin, start, width"""


def streak(table: str, limit: float, by: str = "") -> str:
    """Longest run by the difference of two row numbers."""
    part = f"partition by {by}" if by else ""
    keys = f"{by}, " if by else ""
    runs = f"""select {keys}dry, row_number() over ({part} order by time)
      - row_number() over (partition by {keys}dry order by time) as island
      from (select *, value < {limit} as dry from {table} where value is not null)"""
    lengths = f"select {keys}dry, island, count(*) as n from ({runs}) group by {keys}dry, island"
    final = f"group by {by}" if by else ""
    return f"select {keys}cast(max(case when dry then n else 0 end) as bigint) as longest_dry_streak from ({lengths}) {final}"


def slice_of(index: str) -> str:
    return f"select t.* from t join axis using (time) where time_idx = {index}"


def compass(degrees: str) -> str:
    # The eight points.
    names = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
    cases = " ".join(f"when {i} then '{n}'" for i, n in enumerate(names))
    return f"case cast(floor(({degrees} + 22.5) / 45) as int) % 8 {cases} end"


def matches(name: str, keys: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({name}), '{k}')" for k in keys) + ")"


def category(name: str) -> str:
    cases = " ".join(f"when {matches(name, keys)} then '{label}'" for label, keys in CATEGORY_KEYS.items())
    return f"case {cases} else 'general' end"


DIRECTION = "(degrees(atan2(mean_u, mean_v)) + 360) % 360"
SPHERE = f"""{q("cos(radians(lat)) * cos(radians(lon))")} as x, {q("cos(radians(lat)) * sin(radians(lon))")} as y,
  {q("sin(radians(lat))")} as z"""
SCALED = "case when hi = lo then 0.0::double else (value - lo) / (hi - lo) end"

STORY = """, nt as (select count(*) as nt from axis), n as (select nt, least(6, greatest(4, nt)) as n from nt),
  steps as (select cast(k as int) as step, cast((k * (nt - 1)) // (n - 1) as int) as time_idx
    from (select nt, n, unnest(generate_series(0, n - 1)) as k from n)) """


def annual(bounds: tuple[int, int]) -> str:
    return given("ts") + f"""select cast(year(time) as int) as year, {q("avg(value)")} as mean,
      case when year(time) <= {bounds[0]} then 'Baseline' when year(time) <= {bounds[1]} then 'Current' else 'Future' end as period
      from ts where value is not null group by year(time)"""


def months() -> str:
    # The month labels.
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    return "case month(time) " + " ".join(f"when {i + 1} then '{n}'" for i, n in enumerate(names)) + " end"


def extreme(table: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    group = f"group by {by}" if by else ""
    return f"""select {keys}max(value) as hottest, max(case when hot = 1 then cast(time as varchar) end) as hottest_date,
      min(value) as coldest, max(case when cold = 1 then cast(time as varchar) end) as coldest_date,
      count(*) filter (value > 30) as hot_days, count(*) filter (value > 20) as tropical_nights
      from (select *, row_number() over ({part} order by value desc, time) as hot,
        row_number() over ({part} order by value, time) as cold from {table}) {group}"""


def vertices() -> str:
    corners = [(0, 0), (1, 0), (1, 1), (0, 0)]
    points = " union all ".join(
        f"select {kind} as kind, {part} as part, {i} as vertex, {shift + dx}::double as dx, {dy}::double as dy"
        for kind, part, shift in ((0, 0, 0), (1, 0, 0), (1, 1, 3))
        for i, (dx, dy) in enumerate(corners)
    )
    return f"""with points as ({points}), v as (select c_name as name, part, vertex,
      (c_custkey % 360) - 180 + dx as lon, (c_custkey % 160) - 80 + dy as lat
      from customer join points on c_custkey % 4 = kind)
      select name, cast(part as int) as part, cast(vertex as int) as vertex, lon, lat, {SPHERE} from v"""


def netcdf_cells() -> str:
    """Files hold dense cubes: every time of the year at every latitude and longitude of that year."""
    return given("w") + """, y as (select *, year(time) as yr from w),
      times as (select yr, time, row_number() over (partition by yr order by time) - 1 as time_idx from (select distinct yr, time from y)),
      lats as (select yr, lat, row_number() over (partition by yr order by lat) - 1 as lat_idx from (select distinct yr, lat from y)),
      lons as (select yr, lon, row_number() over (partition by yr order by lon) - 1 as lon_idx from (select distinct yr, lon from y)),
      dense as (select 'wind_' || yr as dataset_id, time, lat, lon, time_idx, lat_idx, lon_idx, u, v, hurs
        from times join lats using (yr) join lons using (yr) left join y using (yr, time, lat, lon)) """


def dispatch() -> str:
    roles = f"""roles as (select dataset_id,
      min_by(variable, ordinal) filter ({matches("variable", WIND_U)}) as u_variable,
      min_by(variable, ordinal) filter ({matches("variable", WIND_V)}) as v_variable,
      min_by(variable, ordinal) filter ({matches("variable", RAINFALL)}) as rain from cat group by 1)"""
    return given("cat") + f""", {roles},
      c as (select dataset_id, variable, {category("variable")} as category, u_variable, v_variable, rain
        from cat left join roles using (dataset_id)),
      p as (
        select *, 0 as position, case when category in ('rainfall', 'wind', 'humidity') then category else 'temperature' end as panel,
          variable as target from c
        union all select *, 1, case category when 'rainfall' then 'temperature' when 'wind' then 'temperature'
          when 'humidity' then 'wind' else 'rainfall' end,
          case when category = 'humidity' then null when category in ('rainfall', 'wind') then variable
            else coalesce(rain, variable) end from c
        union all select *, 2, 'distribution', variable from c
        union all select *, 3, 'wind', case when category = 'wind' then variable end from c)
      select dataset_id, variable, category, cast(position as int) as position, panel, target, u_variable, v_variable,
        case when panel = 'wind' then case when u_variable is not null and v_variable is not null then 'components'
          when target is not null then 'fallback' else 'none' end end as wind_source from p"""


def flattened(panel: str, metrics: dict[str, str], table: str, item: str = "0") -> str:
    """Rows (dataset, variable, position, panel, item, metric, value) of a table that has the first three."""
    return " union all ".join(
        f"""select dataset_id, variable, cast(position as int) as position, '{panel}' as panel, cast({item} as int) as item,
        '{name}' as metric, {q(f'cast({value} as double)')} as value from {table}"""
        for name, value in metrics.items()
    )


def pages() -> str:
    """Every panel of the page of each variable of each run. ``x`` are cells of whole numbers, ``s`` spatial means."""
    widths = ", ".join(f"{m}e{k}::double" for k in range(-6, 6) for m in (1, 2, 5))

    def bins(name: str, table: str, by: str) -> str:
        return f"""{name}_l as (select *, case when lo = hi then 1.0::double else (select min(w) from (select unnest([{widths}]) as w)
            where w >= (hi - lo) / 40 and floor(hi / w) - floor(lo / w) + 1 <= 40) end as width
            from (select {by}, min(value) as lo, max(value) as hi from {table} where value is not null group by {by})),
          {name} as (select {by}, cast(floor((value - start) / width) as int) as bin, start, width, count(*) as n from
            (select {table}.*, width, case when lo = hi then lo else floor(lo / width) * width end as start
             from {table} join {name}_l using ({by}) where value is not null) group by {by}, bin, start, width)"""

    def opened(panel: str, table: str, where: str = "true") -> str:
        return f"""(select d.dataset_id, d.variable, position, {table}.* exclude (dataset_id, variable) from d join {table}
          on {table}.dataset_id = d.dataset_id and {table}.variable = d.target where d.panel = '{panel}' and {where})"""

    both = "(select d.dataset_id, d.variable, position, {0}.* exclude (dataset_id) from d join {0} using (dataset_id) where wind_source = 'components')"
    edges = {"bin_start": "start + bin * width", "bin_end": "start + (bin + 1) * width", "n": "n"}
    values = {"n": "n", "mean": "mean", "max": "max", "min": "min"}
    views = "(select *, -1 as position from shown)"
    base, listing = dispatch().split(" select dataset_id, variable, category, cast(position as int)", 1)
    head = base.rstrip() + f""", d as (select dataset_id, variable, category, cast(position as int){listing}),
      x as (select * replace (cast(cast(round(value * 100) as bigint) % 64 as double) as value) from runs),
      s as (select dataset_id, variable, time, avg(value) as value from x group by all),
      years as (select dataset_id, variable, year(time) as item, avg(value) as mean, sum(value) as total from s group by all),
      months as (select dataset_id, variable, month(time) as item, avg(value) as mean, sum(value) as total from s group by all),
      peaks as ({extreme("s", "dataset_id, variable")}),
      facts as (select dataset_id, variable, count(*) filter (value > 20) as heavy_days, count(*) filter (value > 0) as snow_days,
        sum(value) as snow_amount from s group by all),
      dry as ({streak("s", 15, "dataset_id, variable")}),
      v as (select dataset_id, variable, count(value) as n, avg(value) as mean, max(value) as max, min(value) as min from x group by all),
      uvs as (select dataset_id, a.value as u, b.value as v, sqrt(a.value * a.value + b.value * b.value) as value
        from (select distinct dataset_id, u_variable, v_variable from d where wind_source = 'components') names
        join x a using (dataset_id) join x b using (dataset_id, time, lat, lon) where a.variable = u_variable and b.variable = v_variable),
      gusts as (select *, {DIRECTION} as direction from (select dataset_id, count(*) as n_speed, avg(value) as mean_speed,
        max(value) as max_speed, {WIND_MEANS}, count(*) filter (value > 20) as storm_samples,
        count(*) filter (value > 32) as severe_samples from uvs group by 1)),
      ranked as (select *, dense_rank() over (partition by dataset_id, variable order by time) - 1 as i from x),
      shown as (select dataset_id, variable, count(value) as n, sum(value) as total, min(value) as lo, max(value) as hi,
        max(abs(value)) as top from ranked join (select dataset_id, variable, max(i) as last from ranked group by all) using (dataset_id, variable)
        where i = least(50, last) group by all),
      {bins("hv", "x", "dataset_id, variable")}, {bins("hs", "uvs", "dataset_id")} """
    day = "date_diff('day', date '1970-01-01', cast({} as date))".format
    peak = {"hottest": "hottest", "hottest_date": day("hottest_date"), "coldest": "coldest", "coldest_date": day("coldest_date"),
            "hot_days": "hot_days", "tropical_nights": "tropical_nights"}
    gust = {c: c for c in ("n_speed", "mean_speed", "max_speed", "mean_u", "mean_v", "storm_samples", "severe_samples", "direction")}
    return head + " union all ".join([
        flattened("temperature.annual_mean", {"mean": "mean"}, opened("temperature", "years"), "item"),
        flattened("temperature.monthly_cycle", {"mean": "mean"}, opened("temperature", "months"), "item"),
        flattened("temperature.extremes", peak, opened("temperature", "peaks")),
        flattened("rainfall.annual_total", {"total": "total"}, opened("rainfall", "years"), "item"),
        flattened("rainfall.monthly_total", {"total": "total"}, opened("rainfall", "months"), "item"),
        flattened("rainfall.heavy_days", {"heavy_days": "heavy_days"}, opened("rainfall", "facts")),
        flattened("rainfall.dry_streak", {"longest_dry_streak": "longest_dry_streak"}, opened("rainfall", "dry")),
        flattened("rainfall.snow", {"snow_days": "snow_days", "snow_amount": "snow_amount"}, opened("rainfall", "facts")),
        flattened("humidity.humidity", values, opened("humidity", "v")),
        flattened("humidity.histogram", edges, opened("humidity", "hv"), "bin"),
        flattened("distribution.mean", {"n": "n", "mean": "mean"}, opened("distribution", "v")),
        flattened("distribution.histogram", edges, opened("distribution", "hv"), "bin"),
        flattened("wind.fallback", values, opened("wind", "v", "wind_source = 'fallback'")),
        flattened("wind.wind", gust | {"peak_speed": "max_speed"}, both.format("gusts")),
        flattened("wind.histogram", edges, both.format("hs"), "bin"),
        flattened("view.cells", {"n": "n", "total": "total"}, views),
        flattened("view.range", {"vmin": "lo", "vmax": "hi", "symmetric_min": "-top", "symmetric_max": "top"}, views),
    ])


RUN_VARIABLES = ["hurs", "pr", "precip", "prsn", "sfcWind", "snw", "sst", "tas", "u10", "uas", "vas"]
T_TIME = "cast(time as varchar) as time"
WIND_MEANS = "avg(u) as mean_u, avg(v) as mean_v"
STATS = f"count(*) as n_points, {q('avg(value)')} as mean, min(value) as min, max(value) as max, {q('stddev_pop(value)')} as std"

# All variables of the files, with what names a dataset and numbers a step.
FILE_CELLS = " union all ".join(
    f"""select {{dataset}} as dataset_id, '{name}' as variable, cast({{step}} as int) as time_idx, strftime(time, '%Y-%m-%d') as time,
    cast(lat_idx as int) as lat_idx, lat, cast(lon_idx as int) as lon_idx, lon, {q(column)} as value from dense join steps using (time)"""
    for name, column in (("uas", "u"), ("vas", "v"), ("hurs", "hurs"))
)
JOINED = ", steps as (select time, row_number() over (order by time) - 1 as step from (select distinct time from w)) "


def model(year: str, month: str) -> str:
    """Spatial means with their position and the year and month of a model calendar in which days since 1995 are read."""
    return given("ts") + f""", numbered as (select date_diff('day', date '1995-01-01', time) as n, value,
      row_number() over (order by time) - 1 as i from ts), m as (select *, {year} as y, {month} as mon from numbered)"""


FILE_WIND = f""", f as (select count(*) as n_speed, avg(speed) as mean_speed, max(speed) as max_speed, avg(u) as mean_u, avg(v) as mean_v,
    count(*) filter (speed > 20) as storm_samples, count(*) filter (speed > 32) as severe_samples
    from (select u, v, sqrt(u * u + v * v) as speed from w))
  select 'wind' as dataset_id, n_speed, {q("mean_speed")} as mean_speed, {q("max_speed")} as max_speed, {q("mean_u")} as mean_u,
    {q("mean_v")} as mean_v, storm_samples, severe_samples, {q("max_speed")} as peak_speed, {q(DIRECTION)} as direction,
    {compass(DIRECTION)} as compass from f"""
NOLEAP_MONTH = "1 + " + " + ".join(f"(n % 365 >= {days})::int" for days in (31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334))
MODEL_TEXT = "printf('%04d-%02d-%02d 00:00:00', y, mon, n % 30 + 1)"
# Month labels, January first.
MONTH_NAMES = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"

ORACLE = {
    "spatial_mean": given("ts") + f"select {T_TIME}, value from ts",
    "spatial_mean_levels": given("lev") + f"select {T_TIME}, lev, {q('avg(value)')} as value from lev group by time, lev",
    "spatial_mean_levels_found": given("lev")
    + f"select {T_TIME}, cast(lev - 1 as int) as lev_idx, lev, {q('avg(value)')} as value from lev group by time, lev",
    "series_rows": given("t") + f"select {T_TIME}, value from t",
    "annual_mean_periods": annual((1997, 1999)),
    "annual_mean_default_periods": annual((2010, 2040)),
    "monthly_cycle": given("ts")
    + f"select cast(month(time) as int) as month, {q('avg(value)')} as mean, {months()} as month_name from ts group by month(time)",
    "annual_total": given("ts")
    + f"select cast(year(time) as int) as year, {q('coalesce(sum(value), 0)')} as total from ts group by year(time)",
    "annual_total_rain": given("rs")
    + f"select cast(year(time) as int) as year, {q('coalesce(sum(value), 0)')} as total from rs group by year(time)",
    "monthly_total": given("ts")
    + f"select cast(month(time) as int) as month, {q('coalesce(sum(value), 0)')} as total from ts group by month(time)",
    "monthly_total_per_cell": given("t")
    + f"select lat, lon, cast(month(time) as int) as month, {q('coalesce(sum(value), 0)')} as total from t group by lat, lon, month(time)",
    "extremes": given("ts") + extreme("ts"),
    "extremes_per_cell": given("t") + extreme("t", "lat, lon"),
    "heavy_days": given("rs") + "select count(*) filter (value > 20) as heavy_days from rs",
    "snow_days": given("rs")
    + f"select count(*) filter (value > 0) as snow_days, {q('coalesce(sum(value), 0)')} as snow_amount from rs",
    "longest_dry_streak": given("rs") + streak("rs", 15),
    "longest_dry_streak_default": given("rs") + streak("rs", 1),
    "dry_streak_per_cell": given("r") + streak("r", 15, "lat, lon"),
    "dry_streak_zonal": given("r")
    + """, z as (select time, lat, max(value) as value from r group by 1, 2),
      runs_of as (select dry, row_number() over (order by time, lat) - row_number() over (partition by dry order by time, lat) as island
        from (select *, value < 15 as dry from z)),
      lengths as (select dry, island, count(*) as n from runs_of group by 1, 2)
      select cast(max(case when dry then n else 0 end) as bigint) as longest_dry_streak from lengths""",
    "dry_streak_by_position": given("ts") + streak("ts", 25),
    "time_axis": given("r")
    + f"select cast(row_number() over (order by time) - 1 as int) as time_idx, {T_TIME} from (select distinct time from r)",
    "time_slice": given("axis") + f"select {T_TIME}, lat, lon, value from ({slice_of('100')})",
    "time_slice_clipped": given("axis")
    + f"select {T_TIME}, lat, lon, value from ({slice_of('(select least(1000000, count(*) - 1) from axis)')})",
    "time_slice_per_dataset": given("runs")
    + f""", ranked as (select *, dense_rank() over (partition by dataset_id, variable order by time) - 1 as i from runs),
      n as (select dataset_id, variable, max(i) as last from ranked group by 1, 2)
      select dataset_id, {T_TIME}, lat, lon, variable, value from ranked join n using (dataset_id, variable) where i = least(50, last)""",
    "slices_at_many": given("axis")
    + f""", steps as (select cast(k as int) as step, cast((k * (nt - 1)) // 11 as int) as time_idx
        from (select count(*) as nt from axis), (select unnest(generate_series(0, 11)) as k))
      select step, {T_TIME}, lat, lon, value from steps join axis using (time_idx) join t using (time)""",
    "slice_range": given("axis")
    + f"""select min(value) as vmin, max(value) as vmax, -max(abs(value)) as symmetric_min, max(abs(value)) as symmetric_max
      from ({slice_of('100')})""",
    "compare_slices": given("axis")
    + f"""select 'A' as slice, {T_TIME}, lat, lon, value from ({slice_of('10')})
      union all select 'B', {T_TIME}, lat, lon, value from ({slice_of('500')})""",
    "compare_ranges": given("axis")
    + f"""select slice, min(value) as vmin, max(value) as vmax, -max(abs(value)) as symmetric_min, max(abs(value)) as symmetric_max
      from (select 'A' as slice, * from ({slice_of('10')}) union all select 'B', * from ({slice_of('500')})) group by slice""",
    "story_steps": given("axis")
    + STORY
    + f"""select step, time_idx, {T_TIME}, strftime(time, '%Y-%m-%d 00:00:00') as label,
      case step {" ".join(f"when {i} then '{c}'" for i, c in enumerate(CAPTIONS))} end as caption
      from steps join axis using (time_idx)""",
    "story_hotspots": given("axis")
    + STORY
    + """, cells as (select step, time_idx, lat, lon, value,
        row_number() over (partition by step order by abs(value) desc, lat, lon) as place
        from steps join axis using (time_idx) join t using (time))
      select step, time_idx, max(abs(value)) as symmetric_max, max(lat) filter (place = 1) as hot_lat,
        max(lon) filter (place = 1) as hot_lon, max(value) filter (place = 1) as hot_value from cells group by 1, 2""",
    "story_globe": given("axis")
    + STORY
    + f"""select {T_TIME}, lat, lon, value, step, {q(SCALED)} as normalised, {SPHERE} from
      (select t.*, step, min(value) over (partition by step) as lo, max(value) over (partition by step) as hi
       from steps join axis using (time_idx) join t using (time))""",
    "hotspot_per_time": given("w")
    + f"""select {T_TIME}, lat as hot_lat, lon as hot_lon, u as hot_value from
      (select *, row_number() over (partition by time order by abs(u) desc, lat, lon) as place from w) where place = 1""",
    "globe_points": given("axis")
    + f"""select {T_TIME}, lat, lon, value, {q(SCALED)} as normalised, {SPHERE} from
      (select *, min(value) over () as lo, max(value) over () as hi from ({slice_of('100')}))""",
    "normalise_slice": given("axis")
    + f"""select {T_TIME}, lat, lon, value, {q(SCALED)} as normalised from
      (select *, min(value) over () as lo, max(value) over () as hi
       from ({slice_of('(select least(2000, count(*) - 1) from axis)')}))""",
    "normalise_per_time": given("t")
    + f"""select {T_TIME}, lat, lon, value, {q(SCALED)} as normalised from
      (select *, min(value) over (partition by time) as lo, max(value) over (partition by time) as hi from t)""",
    "sphere_of_grid": given("h") + f"select lat, lon, count(*) as n, {SPHERE} from h group by lat, lon",
    "axis_lookup": given("h")
    + f"""select cast((lat + 60) / 30 as int) as lat_idx, lat, count(*) as n, {q("avg(value)")} as mean from h group by lat""",
    "boundary_vertices": vertices(),
    "boundary_scan": vertices(),
    "boundary_collection": vertices(),
    "boundary_split_collection": vertices(),
    "boundary_shapefile": vertices(),
    "histogram": given("h") + histogram("value", "h"),
    "histogram_temperature": given("t") + histogram("value", "t"),
    "histogram_per_latitude": given("h") + histogram("value", "h", "lat"),
    "histogram_finite": given("gappy") + histogram("value", "gappy"),
    "histogram_infinite_cells": given("gappy")
    + """select floor(lo / 2) * 2 as start, 2.0::double as width, n_infinite from (select
      min(value) as lo, count(*) filter (value = 'infinity'::double) as n_infinite from gappy)""",
    "distribution_mean": given("h") + f"select count(value) as n, {q('avg(value)')} as mean from h",
    "global_stats": given("h") + f"select {STATS} from h",
    "global_stats_finite": given("gappy") + f"select {STATS} from gappy where abs(value) < 'infinity'::double",
    "missing_cells": given("gappy")
    + f"""select {T_TIME}, count(*) as n_cells, count(value) as n_present, count(*) filter (value > 50) as n_above
      from gappy group by time""",
    "wind_gaps": given("w")
    + f"""select n_speed, mean_speed, max_speed, {q("mean_u")} as mean_u, {q("mean_v")} as mean_v, {q(DIRECTION)} as direction,
      {compass(DIRECTION)} as compass from
      (select count(speed) as n_speed, {q("avg(speed)")} as mean_speed, {q("max(speed)")} as max_speed, {WIND_MEANS} from
        (select *, sqrt(u * u + v * v) as speed from
          (select case when lat <> -60 then u end as u, case when lon <> -144 then v end as v from w)))""",
    "wind_stats": given("uv") + f"select count(speed) as n_speed, {q('avg(speed)')} as mean_speed, {q('max(speed)')} as max_speed from uv",
    "wind_stats_per_cell": given("uv")
    + f"""select lat, lon, n_speed, mean_speed, max_speed, {q("mean_u")} as mean_u, {q("mean_v")} as mean_v,
      {q(DIRECTION)} as direction, {compass(DIRECTION)} as compass from
      (select lat, lon, count(speed) as n_speed, {q("avg(speed)")} as mean_speed, {q("max(speed)")} as max_speed, {WIND_MEANS}
       from uv group by lat, lon)""",
    "wind_stats_long": given("runs")
    + f"""select dataset_id, n_speed, mean_speed, max_speed, {q("mean_u")} as mean_u, {q("mean_v")} as mean_v,
      {q(DIRECTION)} as direction, {compass(DIRECTION)} as compass from
      (select dataset_id, count(*) as n_speed, {q("avg(sqrt(u * u + v * v))")} as mean_speed,
         {q("max(sqrt(u * u + v * v))")} as max_speed, {WIND_MEANS} from
        (select dataset_id, time, lat, lon, a.value as u, b.value as v
         from (select * from runs where variable = 'uas') a join (select * from runs where variable = 'vas') b
         using (dataset_id, time, lat, lon)) group by 1)""",
    "explore_pages": pages(),
    "prevailing_direction": given("w")
    + f"""select {q("mean_u")} as mean_u, {q("mean_v")} as mean_v, {q(DIRECTION)} as direction, {compass(DIRECTION)} as compass
      from (select {WIND_MEANS} from w)""",
    "storm_counts": given("uv")
    + f"""select count(*) filter (speed > 20) as storm_samples, count(*) filter (speed > 32) as severe_samples,
      {q("max(speed)")} as peak_speed from uv""",
    "wind_panel": given("uv")
    + f"""select n_speed, mean_speed, max_speed, {q("mean_u")} as mean_u, {q("mean_v")} as mean_v, storm_samples,
      severe_samples, max_speed as peak_speed, {q(DIRECTION)} as direction, {compass(DIRECTION)} as compass from
      (select count(speed) as n_speed, {q("avg(speed)")} as mean_speed, {q("max(speed)")} as max_speed, {WIND_MEANS},
        count(*) filter (speed > 20) as storm_samples, count(*) filter (speed > 32) as severe_samples from uv)""",
    "temperature_panel_extremes": given("ts") + extreme("ts"),
    "rainfall_panel_streak": given("rs") + streak("rs", 15),
    "wind_histogram": given("uv") + f", rounded as (select {q('speed')} as speed from uv)" + histogram("speed", "rounded"),
    "wind_fallback": given("t") + f"select count(value) as n, {q('avg(value)')} as mean, max(value) as max from t",
    "humidity_stats": given("h")
    + f"select count(value) as n, {q('avg(value)')} as mean, {q('max(value)')} as max, {q('min(value)')} as min from h",
    "humidity_panel": given("h")
    + f"select count(value) as n, {q('avg(value)')} as mean, {q('max(value)')} as max, {q('min(value)')} as min from h",
    "catalog_of_runs": given("cat") + "select * from cat",
    "mappable_variables": given("cat") + "select dataset_id, variable from cat where variable not in ('hurs', 'sst')",
    "unpivot_variables": given("w")
    + " union all ".join(f"select {T_TIME}, lat, lon, '{c}' as variable, {q(c)} as value from w" for c in ("u", "v", "hurs")),
    "pivot_variables": given("runs")
    + f"""select dataset_id, {T_TIME}, lat, lon, {", ".join(f"max(value) filter (variable = '{v}') as {v}" for v in RUN_VARIABLES)}
      from runs group by dataset_id, time, lat, lon""",
    "classify_variables": f"""with {WORDS}, named as (select distinct variable, {category("variable")} as category from words)
      select variable, category, upper(category[1]) || category[2:] as category_label from named""",
    "find_variable": f"""with {WORDS} select dataset_id, min_by(variable, ordinal) as found
      from words where {matches("variable", RAINFALL)} group by 1""",
    "find_roles": given("cat")
    + f"""select dataset_id, min_by(variable, ordinal) filter ({matches("variable", WIND_U)}) as u_variable,
      min_by(variable, ordinal) filter ({matches("variable", WIND_V)}) as v_variable,
      min_by(variable, ordinal) filter ({matches("variable", HUMIDITY)}) as humidity_variable,
      min_by(variable, ordinal) filter ({matches("variable", RAINFALL)}) as rain_variable from cat
      where {matches("variable", WIND_U + WIND_V + HUMIDITY + RAINFALL)} group by 1""",
    "choose_variable": given("cat")
    + """select dataset_id, case when bool_or(variable = 'hurs') then 'hurs' when bool_or(variable = 'sst') then 'sst'
      else min_by(variable, ordinal) end as variable from cat group by 1""",
    "select_variable": given("cat")
    + """, picked as (select dataset_id, case when bool_or(variable = 'hurs') then 'hurs' else min_by(variable, ordinal) end as variable
        from cat group by 1)
      select dataset_id, variable, count(*) as n, max(value) as max from runs join picked using (dataset_id, variable) group by 1, 2""",
    "dispatch": dispatch(),
    "time_decode": """select o_orderkey, cast(timestamp '1995-01-01 06:00:00' + to_minutes(o_orderkey * 15) as varchar) as time
      from orders""",
    "time_parse": """select o_orderkey, case when o_orderkey % 7 <> 0
      then cast(cast(cast(o_orderdate as date) as timestamp) as varchar) end as time from orders""",
    "time_labels": """select distinct o_orderstatus, raw, case when o_orderstatus = 'F' then raw
      when raw = '?' then 'NaT' else raw || ' 00:00:00' end as label from (select o_orderstatus,
      case when o_orderstatus = 'F' then 'step ' || cast(cast(o_orderdate as date) as varchar)
        when day(o_orderdate) = 1 then '?' else cast(cast(o_orderdate as date) as varchar) end as raw from orders)""",
    "time_numeric": given("ts") + f"select {T_TIME}, value from ts",
    "time_zoned": given("ts") + "select strftime(time, '%Y-%m-%d 01') as time, value from ts",
    "story_labels_raw": given("axis")
    + STORY
    + "select step, time_idx, 'day ' || cast(time as varchar) as label from steps join axis using (time_idx)",
    "export_slice_preview": given("axis")
    + f"select lat, lon, {T_TIME}, value as t2m from ({slice_of('100')}) order by lat, lon limit 50",
    "export_series_preview": given("ts") + f"select {T_TIME}, value as t2m from ts order by ts.time limit 50",
    "export_stats": given("h") + f"select 'hurs' as variable, {STATS} from h",
    "csv_roundtrip": given("ts") + f"select {T_TIME}, value as t2m from ts",
    "csv_slice_roundtrip": given("axis") + f"select lat, lon, {T_TIME}, value as t2m from ({slice_of('2000')})",
    "stats_csv_roundtrip": given("h") + f"select 'hurs' as variable, {STATS} from h",
    "grid_roundtrip": given("runs")
    + """select case when cast(dataset_id[4:] as int) % 2 = 0 then '001' else '1' end as dataset_id, variable, count(*) as n,
      max(value) as max from runs group by 1, 2""",
    "netcdf_scan_all": netcdf_cells()
    + " union all ".join(
        f"""select dataset_id, '{name}' as variable, cast(time_idx as int) as time_idx, {T_TIME}, cast(lat_idx as int) as lat_idx,
        lat, cast(lon_idx as int) as lon_idx, lon, {q(column)} as value from dense"""
        for name, column in (("uas", "u"), ("vas", "v"), ("hurs", "hurs"))
    ),
    "netcdf_scan": netcdf_cells()
    + " union all ".join(
        f"""select dataset_id, '{name}' as variable, cast(time_idx as int) as time_idx, {T_TIME}, cast(lat_idx as int) as lat_idx,
        lat, cast(lon_idx as int) as lon_idx, lon, {column} as value from dense"""
        for name, column in (("uas", "u"), ("vas", "v"))
    ),
    "netcdf_catalog": netcdf_cells()
    + " union all ".join(
        f"""select dataset_id, '{name}' as variable, max(time_idx) + 1 as n_time, max(lat_idx) + 1 as n_lat,
        max(lon_idx) + 1 as n_lon, count(*) as n_cells, count({column}) as n_present, cast({i} as int) as ordinal
        from dense group by dataset_id"""
        for i, (name, column) in enumerate((("uas", "u"), ("vas", "v"), ("hurs", "hurs")))
    ),
    "stored_catalog": netcdf_cells()
    + " union all ".join(
        f"""select dataset_id, '{name}' as variable, max(time_idx) + 1 as n_time, max(lat_idx) + 1 as n_lat,
        max(lon_idx) + 1 as n_lon, count(*) as n_cells, cast({i} as int) as ordinal from dense group by dataset_id"""
        for i, name in enumerate(("uas", "vas", "hurs"))
    ),
    "explore_page": given("runs_wide")
    + """, cells as (select a as u, b as v, c as h, sqrt(a * a + b * b) as speed from runs_wide where run = 1),
      found as (select count(h) as n, avg(h) as mean_h, max(h) as max_h, min(h) as min_h, count(speed) as n_speed,
        avg(speed) as mean_speed, max(speed) as max_speed, avg(u) as mean_u, avg(v) as mean_v,
        count(*) filter (speed > 20) as storms, count(*) filter (speed > 32) as severe from cells) """
    + " union all ".join(
        f"select '{panel}' as panel, '{metric}' as metric, {q(f'cast({value} as double)')} as value from found"
        for panel, metric, value in (
            ("0_humidity.humidity", "n", "n"), ("0_humidity.humidity", "mean", "mean_h"), ("0_humidity.humidity", "max", "max_h"),
            ("0_humidity.humidity", "min", "min_h"), ("1_wind.wind", "n_speed", "n_speed"), ("1_wind.wind", "mean_speed", "mean_speed"),
            ("1_wind.wind", "max_speed", "max_speed"), ("1_wind.wind", "mean_u", "mean_u"), ("1_wind.wind", "mean_v", "mean_v"),
            ("1_wind.wind", "storm_samples", "storms"), ("1_wind.wind", "severe_samples", "severe"),
            ("1_wind.wind", "peak_speed", "max_speed"), ("1_wind.wind", "direction", DIRECTION),
            ("2_distribution.mean", "n", "n"), ("2_distribution.mean", "mean", "mean_h"),
        )
    ),
    "netcdf_header": netcdf_cells()
    + """, sizes as (select dataset_id, max(time_idx) + 1 as nt, max(lat_idx) + 1 as ny, max(lon_idx) + 1 as nx from dense group by 1)
      select dataset_id, variable, variable in ('time', 'lat', 'lon') as is_coordinate,
        case when variable in ('time', 'lat', 'lon') then variable else 'time,lat,lon' end as dims,
        case variable when 'time' then cast(nt as varchar) when 'lat' then cast(ny as varchar) when 'lon' then cast(nx as varchar)
          else concat(nt, ',', ny, ',', nx) end as sizes
      from sizes cross join (select unnest(['time', 'lat', 'lon', 'uas', 'vas', 'hurs']) as variable)""",
    "hdf5_scan": netcdf_cells() + JOINED + FILE_CELLS.format(dataset="dataset_id", step="time_idx"),
    "hdf5_catalog": netcdf_cells()  # every fourth file keeps no order of its variables but that of their names
    + " union all ".join(
        f"""select dataset_id, '{name}' as variable, max(time_idx) + 1 as n_time, max(lat_idx) + 1 as n_lat, max(lon_idx) + 1 as n_lon,
        count(*) as n_cells, cast(case when cast(dataset_id[6:] as int) % 4 = 0 then {by_name} else {i} end as int) as ordinal from dense group by dataset_id"""
        for i, (name, by_name) in enumerate((("uas", 1), ("vas", 2), ("hurs", 0)))
    ),
    "netcdf_joined": netcdf_cells() + JOINED + FILE_CELLS.format(dataset="'wind'", step="step"),
    "hdf5_joined_steps": netcdf_cells() + JOINED
    + f"""select 'wind' as dataset_id, 'hurs' as variable, cast(step as int) as time_idx, {T_TIME}, cast(lat_idx as int) as lat_idx,
      lat, cast(lon_idx as int) as lon_idx, lon, {q("hurs")} as value from dense join steps using (time) where step between 300 and 420""",
    "wind_from_files": given("w") + FILE_WIND,
    "wind_from_hdf5": given("w") + FILE_WIND,
    "annual_mean_noleap": model("1995 + n // 365", NOLEAP_MONTH)
    + f"""select cast(y as int) as year, {q("avg(value)")} as mean,
      case when y <= 1997 then 'Baseline' when y <= 1999 then 'Current' else 'Future' end as period from m group by y""",
    "monthly_total_noleap": model("1995 + n // 365", NOLEAP_MONTH)
    + f"select cast(mon as int) as month, {q('coalesce(sum(value), 0)')} as total from m group by mon",
    "monthly_cycle_360": model("1995 + n // 360", "n % 360 // 30 + 1")
    + f"select cast(mon as int) as month, {q('avg(value)')} as mean, {MONTH_NAMES}[mon] as month_name from m group by mon",
    "story_labels_360": model("1995 + n // 360", "n % 360 // 30 + 1")
    + f""", nt as (select count(*) as nt from m),
      chosen as (select k, (k * (nt - 1)) // (least(6, greatest(4, nt)) - 1) as i from nt, range(6) r(k) where k < least(6, greatest(4, nt)))
      select cast(k as int) as step, cast(i as int) as time_idx, {MODEL_TEXT} as label from chosen join m using (i)
      union all select -1, cast(i as int), {MODEL_TEXT} from m where n % 360 = 59""",
    "extremes_360": model("1995 + n // 360", "n % 360 // 30 + 1")
    + f"""select max(value) as hottest, min(value) as coldest, count(*) filter (value > 30) as hot_days,
      count(*) filter (value > 20) as tropical_nights,
      (select {MODEL_TEXT} from m order by value desc, i limit 1) as hottest_label,
      (select {MODEL_TEXT} from m order by value, i limit 1) as coldest_label from m""",
    "footer_catalog": netcdf_cells() + JOINED
    + " union all ".join(
        f"""select 'wind' as dataset_id, '{name}' as variable, max(step) + 1 as n_time, max(lat_idx) + 1 as n_lat, max(lon_idx) + 1 as n_lon,
        count(*) as n_cells, count({column}) as n_present, cast({i} as int) as ordinal from dense join steps using (time)"""
        for i, (name, column) in enumerate((("uas", "u"), ("vas", "v"), ("hurs", "hurs")))
    ),
}
ORACLE["wind_stats_colocated"] = ORACLE["wind_stats_long"]
