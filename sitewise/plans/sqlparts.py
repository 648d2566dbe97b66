"""SQL building blocks for the oracle: the same stand-in mapping as
``sitewise.sources.standin`` and the same cleaning as
``sitewise.sources.readers.clean_observations``, as DuckDB CTEs."""

OBS = """obs AS (
  SELECT 'T' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS SITECODE,
         l_suppkey AS LCODE,
         strftime(l_shipdate, '%d-%b-%y') AS SDATE,
         CASE WHEN l_returnflag = 'N' THEN 'Q' || CAST(l_linenumber % 5 + 1 AS VARCHAR)
              ELSE CAST(l_partkey AS VARCHAR) END AS FIELDNAME,
         nullif(l_quantity, 13.0) AS VALUE
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def parse_date_sql(text: str, pivot: int = 69) -> str:
    yy = f"right({text}, 2)"
    century = f"CASE WHEN TRY_CAST({yy} AS INTEGER) >= {pivot} THEN '19' ELSE '20' END"
    return (f"CAST(try_strptime(substr({text}, 1, length({text}) - 2) || {century} || {yy}, "
            f"'%d-%b-%Y') AS DATE)")


CLEAN = f"""clean AS (
  SELECT SITECODE, LCODE, FIELDNAME, VALUE,
         SITECODE || '-' || CAST(LCODE AS VARCHAR) AS station,
         CASE WHEN regexp_matches(FIELDNAME, 'Q[1-5]') THEN VALUE END AS FLAGID,
         {parse_date_sql('SDATE')} AS DATE
  FROM obs WHERE NOT contains(FIELDNAME, 'Q'))"""

GROUPS = """grp AS (
  SELECT CAST(p_partkey AS VARCHAR) AS IM_SPEC, p_type AS IM_GROUP,
         p_name AS DESC_COMMON, p_brand AS DESC_LATIN FROM part)"""

TRAITS = """traits AS (
  SELECT CAST(p_partkey AS VARCHAR) AS IM_CODE, p_brand AS Genus, p_name AS species,
         p_name AS COMMON_NAME, p_type AS Family, CAST(p_size AS DOUBLE) AS WINGSPAN FROM part)"""

WEATHER = """weather AS (
  SELECT 'T' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS SITECODE,
         CAST(o_orderdate AS DATE) AS DATE, o_orderpriority AS FIELDNAME,
         avg(o_totalprice) AS daily
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY ALL)"""

# G1 daily count by station (null if any value null)
DAILY = """daily AS (
  SELECT SITECODE, station, DATE,
         CASE WHEN count(VALUE) = count(*) THEN sum(VALUE) END AS count
  FROM clean GROUP BY SITECODE, station, DATE)"""

# W1 + W2: rate over the days since the previous record of the station
DRATE = """drate AS (
  SELECT SITECODE, DATE, station, count / "interval" AS value,
         'daily_abun_rate' AS value_type, "interval", count
  FROM (SELECT *, date_diff('day', lag(DATE) OVER (PARTITION BY station ORDER BY DATE), DATE)
                  AS "interval" FROM daily)
  WHERE "interval" IS NOT NULL)"""

# Sum of daily rates over the days of the month, at month end
MRATE = """mrate AS (
  SELECT SITECODE, station, last_day(DATE) AS date,
         (CASE WHEN count(value) = count(*) THEN sum(value) END) / day(last_day(DATE)) AS value,
         'monthly_abun_rate' AS value_type
  FROM drate GROUP BY SITECODE, station, last_day(DATE))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def calendar_sql(src: str, keys: list[str], idx: str, unit: str = "month",
                 anchor: str = "start", out: str | None = None) -> str:
    """Per-key calendar between the key's first and last date (a SELECT)."""
    out = out or idx
    ks = ", ".join(keys)
    if unit == "month":
        lo, hi = f"date_trunc('month', min({idx}))", f"date_trunc('month', max({idx}))"
    else:
        lo, hi = f"min({idx})", f"max({idx})"
    d = f"CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 {unit})) AS DATE)"
    sel = f"last_day({d})" if anchor == "end" else d
    return (f"SELECT {ks}, {sel} AS {out} FROM "
            f"(SELECT {ks}, {lo} AS lo, {hi} AS hi FROM {src} GROUP BY {ks})")


def runs_sql(key: str) -> str:
    """Missing days (C6) of ``clean`` per key and their runs."""
    return f"""dayf AS (SELECT {key}, DATE, bool_or(VALUE IS NULL) AS anynull FROM clean GROUP BY ALL),
dcal AS ({calendar_sql("dayf", [key], "DATE", unit="day")}),
miss AS (SELECT c.{key}, c.DATE FROM dcal c LEFT JOIN dayf d USING ({key}, DATE)
         WHERE coalesce(d.anynull, true)),
brk AS (SELECT *, CASE WHEN date_diff('day', lag(DATE) OVER (PARTITION BY {key} ORDER BY DATE), DATE) = 1
                       THEN 0 ELSE 1 END AS b FROM miss),
seq AS (SELECT {key}, DATE, sum(b) OVER (PARTITION BY {key} ORDER BY DATE
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS seq_id
        FROM brk),
runs AS (SELECT *, min(DATE) OVER r AS STARTDATE, max(DATE) OVER r AS ENDDATE, count(*) OVER r AS duration,
                date_diff('day', DATE, max(DATE) OVER r) + 1 AS next_meas
         FROM seq WINDOW r AS (PARTITION BY {key}, seq_id))"""


def spread_sql(key: str, cnt: str, zero_fill: bool, max_gap: int = 3) -> str:
    """Daily grid with catches shared over short gaps (C9); needs ``runs``."""
    x = "CASE WHEN counts IS NULL AND duration IS NULL THEN 0 ELSE counts END" if zero_fill else "counts"
    return f"""cnt AS ({cnt}),
gcal AS ({calendar_sql("cnt", [key], "DATE", unit="day")}),
ends AS (SELECT {key}, DATE + 1 AS DATE, duration AS prev_dur FROM runs WHERE DATE = ENDDATE),
grid AS (SELECT g.{key}, g.DATE, c.counts, r.duration, e.prev_dur
         FROM gcal g LEFT JOIN cnt c USING ({key}, DATE) LEFT JOIN runs r USING ({key}, DATE)
                     LEFT JOIN ends e USING ({key}, DATE)),
sh AS (SELECT *, CASE WHEN coalesce(duration, 0) <= {max_gap}
                      THEN first_value(({x}) IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY DATE
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / (coalesce(duration, 0) + 1)
                 END AS shared FROM grid),
spread AS (SELECT {key}, DATE, coalesce(duration, 0) AS duration,
                  CASE WHEN prev_dur IS NOT NULL THEN lag(shared) OVER (PARTITION BY {key} ORDER BY DATE)
                       ELSE shared END AS counts FROM sh)"""


NORMAL_MEANVAR_SQL = "dn * (ln(2 * pi()) + ln(greatest(dq / dn - pow(dz / dn, 2), 1e-8)) + 1)"
POISSON_SQL = "CASE WHEN ds > 0 THEN 2 * ds * (ln(dn) - ln(ds)) ELSE 0 END"
NORMAL_VAR_SQL = "dn * (ln(2 * pi()) + ln(greatest(dq / dn, 1e-8)) + 1)"


def changepoint_sql(p: str, ser: str, cost: str, beta_sql: str, min_seg: int = 2) -> str:
    """Exact optimal partitioning as a recursive CTE (prefix ``p``).

    ``ser``: CTE with (g, k, d, y): group, series, date, value.
    ``cost``: segment cost of one series over dn, ds (count and sum in the
    segment), dz and dq (sum and sum of squares of the values less the mean
    of the whole series); may use k.
    ``beta_sql``: per-series penalty over n (and k).
    Defines ``{p}grid`` (g, d, t), ``{p}fin`` (g, t, cost, prev) and
    ``{p}locs`` (g, loc).
    """
    return f"""{p}grid AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) AS t
               FROM (SELECT DISTINCT g, d FROM {ser})),
{p}keys AS (SELECT DISTINCT g, k FROM {ser}),
{p}mu AS (SELECT g, k, avg(y) AS mu FROM {ser} GROUP BY ALL),
{p}pre AS (SELECT gr.g, ks.k, gr.t, count(s.y) OVER w AS n, coalesce(sum(s.y) OVER w, 0) AS s,
                  coalesce(sum(s.y - m.mu) OVER w, 0) AS z, coalesce(sum(pow(s.y - m.mu, 2)) OVER w, 0) AS q
           FROM {p}grid gr JOIN {p}keys ks ON ks.g = gr.g JOIN {p}mu m ON m.g = ks.g AND m.k = ks.k
           LEFT JOIN {ser} s ON s.g = gr.g AND s.k = ks.k AND s.d = gr.d
           WINDOW w AS (PARTITION BY gr.g, ks.k ORDER BY gr.t ROWS UNBOUNDED PRECEDING)),
{p}pre0 AS MATERIALIZED (SELECT * FROM {p}pre UNION ALL SELECT g, k, 0, 0, 0, 0, 0 FROM {p}keys),
{p}beta AS (SELECT g, sum({beta_sql}) AS b FROM (SELECT g, k, count(*) AS n FROM {ser} GROUP BY ALL) GROUP BY g),
{p}cm AS MATERIALIZED (SELECT g, t, list(cost ORDER BY j) AS cs FROM (
           SELECT g, t, j,
                  CASE WHEN min(dn) >= {min_seg} THEN sum(CASE WHEN dn > 0 THEN {cost} END)
                       ELSE 'inf'::DOUBLE END AS cost
           FROM (SELECT b.g, b.t, a.t AS j, a.k, b.n - a.n AS dn, b.s - a.s AS ds, b.z - a.z AS dz, b.q - a.q AS dq
                 FROM {p}pre0 a JOIN {p}pre0 b ON a.g = b.g AND a.k = b.k AND a.t < b.t)
           GROUP BY g, t, j)
         GROUP BY g, t),
{p}r AS (SELECT g, b, 0::BIGINT AS t, [-b]::DOUBLE[] AS f, []::BIGINT[] AS prev FROM {p}beta
         UNION ALL
         SELECT g, b, t + 1, list_append(f, list_min(x) + b), list_append(prev, list_position(x, list_min(x)) - 1)
         FROM (SELECT r.g, r.b, r.t, r.f, r.prev, list_transform(cm.cs, lambda c, i: c + r.f[i]) AS x
               FROM {p}r r JOIN {p}cm cm ON cm.g = r.g AND cm.t = r.t + 1)),
{p}fin AS MATERIALIZED (SELECT g, t, f[t + 1] AS cost, prev FROM {p}r QUALIFY t = max(t) OVER (PARTITION BY g)),
{p}walk AS (SELECT g, prev, prev[t] AS s FROM {p}fin
            UNION ALL SELECT g, prev, prev[s] FROM {p}walk WHERE s > 0),
{p}locs AS (SELECT w.g, gr.d AS loc FROM {p}walk w JOIN {p}grid gr ON gr.g = w.g AND gr.t = w.s
            WHERE w.s > 0)"""
