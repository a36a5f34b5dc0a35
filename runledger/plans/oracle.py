"""DuckDB SQL for the registered queries, written apart from the Spark code.

Each text derives the source tables from ``events`` with common table
expressions, builds the merged table from them, and then answers the query.
"""

from __future__ import annotations

_SUFFIX = r"(\.raw|\.d)$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_SOURCES = r"""
named AS (
    SELECT e.*,
        CASE WHEN event_id < 4 THEN 'R0_x_B0' WHEN event_id < 24 THEN 'R1_x_B0'
             ELSE concat('P', user_id % 12, '_', event_type, '_B', user_id % 3) END AS pfx,
        CASE WHEN event_id % 53 = 0 THEN NULL ELSE epoch_us(ts) / 1e6 END AS ep
    FROM events e
),
keyed AS (
    SELECT *, concat(pfx, '_',
        CASE WHEN event_id % 23 = 0 THEN 'HSstd' WHEN event_id % 29 = 0 THEN 'Standard'
             WHEN event_id % 31 = 0 THEN '[Ss]tandar[dt]' ELSE concat('S', event_id % 4) END,
        '_', event_id) AS nm
    FROM named
),
report_a AS (
    SELECT nm AS "Name", ep AS "System_Time_s", value AS m_1,
        CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(event_id * 2 AS varchar) END AS m2
    FROM keyed WHERE event_id % 10 <> 7
    UNION ALL
    SELECT concat(nm, CASE WHEN event_id % 2 = 0 THEN '.raw' ELSE '.d' END), ep, value + 1000,
        CAST(event_id * 3 AS varchar)
    FROM keyed WHERE event_id % 10 IN (3, 7) AND event_id % 3 <> 0
),
report_b AS (
    SELECT nm AS "Name", ep AS "System_Time_s", value AS m_1 FROM keyed WHERE event_id % 10 IN (0, 1)
),
sample_meta AS (
    SELECT concat(nm, '.raw') AS "SampleName_ID",
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE pfx END AS "ProjectID",
        CASE WHEN event_id % 41 = 0 THEN '1970-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "CreationDate",
        CASE WHEN event_id % 37 = 0 THEN 'corrupt' END AS "Error",
        concat('MS', user_id % 2) AS "MSInstrument",
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('LC', user_id % 3) END AS "HPLCInstrument",
        concat('C:', chr(92), 'methods', chr(92), 'grad_', event_type, '.meth') AS "InstrumentMethod_print"
    FROM keyed WHERE event_id % 5 <> 4
),
project_meta AS (
    SELECT DISTINCT "ProjectID", '2024' AS "TimeRange", concat('name of ', "ProjectID") AS "ProjectName"
    FROM sample_meta WHERE "ProjectID" LIKE 'P%'
),
reports AS (
    SELECT 0 AS src_idx, "Name", "System_Time_s", m_1, m2 FROM report_a
    UNION ALL
    SELECT 1, "Name", "System_Time_s", m_1, NULL FROM report_b
),
named_reports AS (
    SELECT *, regexp_replace("Name", '@SUFFIX', '') AS run, regexp_matches("Name", '@SUFFIX') AS is_control
    FROM reports WHERE "Name" IS NOT NULL
),
chosen AS (
    SELECT * FROM named_reports
    QUALIFY row_number() OVER (PARTITION BY run, is_control ORDER BY src_idx, "System_Time_s" DESC NULLS LAST,
        "Name", m_1 NULLS FIRST, m2 NULLS FIRST) = 1
),
regular AS (SELECT * FROM chosen WHERE NOT is_control),
control AS (SELECT * FROM chosen WHERE is_control),
aligned AS (
    SELECT coalesce(r.run, c.run) AS run,
        r."Name", r."System_Time_s", r.m_1, r.m2,
        c."Name" AS "Name_iQC", c."System_Time_s" AS "System_Time_s_iQC", c.m_1 AS "m_1_iQC", c.m2 AS "m2_iQC"
    FROM regular r FULL JOIN control c ON r.run = c.run
)
""".replace("@SUFFIX", _SUFFIX)

_MERGED = r"""
joined AS (
    SELECT a.*, s.* EXCLUDE ("ProjectID"), s."ProjectID" AS sample_project,
        coalesce(regexp_replace(s."SampleName_ID", '@SUFFIX', ''), a.run) AS "RawFileName",
        coalesce(TRY_CAST(s."CreationDate" AS timestamp),
            make_timestamp(CAST(coalesce(a."System_Time_s", a."System_Time_s_iQC") AS bigint) * 1000000)) AS "DateTime"
    FROM aligned a FULL JOIN @SAMPLES s ON a.run = regexp_replace(s."SampleName_ID", '@SUFFIX', '')
),
base AS (
    SELECT "Name", "System_Time_s", m_1, m2, "Name_iQC", "System_Time_s_iQC", "m_1_iQC", "m2_iQC",
        "SampleName_ID", "CreationDate", "Error", "MSInstrument", "HPLCInstrument", "InstrumentMethod_print",
        "RawFileName",
        coalesce(sample_project, array_to_string(list_slice(string_split(run, '_'), 1, 3), '_'), '') AS "ProjectID",
        CAST("DateTime" AS date) AS "Date",
        strftime("DateTime", '%H:%M:%S.%f') AS "Time",
        "DateTime",
        CASE WHEN contains("RawFileName", 'HSstd') THEN 'HSstd'
             WHEN @STANDARD THEN 'OtherStandard'
             ELSE regexp_replace("RawFileName", '_[^_]*$', '') END AS "FileType"
    FROM joined
),
merged AS (
    SELECT b.*, p."ProjectName" FROM base b LEFT JOIN project_meta p ON b."ProjectID" = p."ProjectID"
),
flagged AS (
    SELECT *, (coalesce("Date" < DATE '2000-01-01', false) OR "Error" IS NOT NULL) AS is_error FROM merged
)
"""

_LONG = r"""
wide AS (
    SELECT "ProjectID", "DateTime", "RawFileName", "FileType",
        coalesce("FileType" IN ('HSstd', 'OtherStandard'), false) AS is_std,
        m_1 AS m1, "m_1_iQC" AS "m1_iQC",
        TRY_CAST(CASE WHEN regexp_matches(m2, '@NUMBER') THEN trim(m2) END AS double) AS m2,
        TRY_CAST(CASE WHEN regexp_matches("m2_iQC", '@NUMBER') THEN trim("m2_iQC") END AS double) AS "m2_iQC"
    FROM flagged WHERE NOT is_error
),
stacked AS (
    SELECT "ProjectID", 'm1' AS metric, "DateTime", "RawFileName", "FileType", is_std, m1 AS value FROM wide
    UNION ALL SELECT "ProjectID", 'm1_iQC', "DateTime", "RawFileName", "FileType", is_std, "m1_iQC" FROM wide
    UNION ALL SELECT "ProjectID", 'm2', "DateTime", "RawFileName", "FileType", is_std, m2 FROM wide
    UNION ALL SELECT "ProjectID", 'm2_iQC', "DateTime", "RawFileName", "FileType", is_std, "m2_iQC" FROM wide
),
long AS (SELECT * FROM stacked WHERE value IS NOT NULL),
trend_rows AS (
    SELECT *, count(*) OVER (PARTITION BY "ProjectID", metric) AS n FROM long WHERE NOT is_std
),
trended AS (
    SELECT "ProjectID", metric, "DateTime", value, "RawFileName" AS "Name", "FileType",
        CASE WHEN n >= 30 THEN 'rolling' WHEN n > 5 THEN 'static' ELSE 'none' END AS mode,
        CASE WHEN n >= 30 THEN quantile_cont(value, 0.5) OVER latest
             WHEN n > 5 THEN quantile_cont(value, 0.5) OVER whole END AS med,
        CASE WHEN n >= 30 THEN stddev_samp(value) OVER latest
             WHEN n > 5 THEN stddev_samp(value) OVER whole END AS sd
    FROM trend_rows
    WINDOW latest AS (PARTITION BY "ProjectID", metric ORDER BY "DateTime" NULLS LAST, "RawFileName" NULLS LAST, value
                      ROWS BETWEEN 14 PRECEDING AND CURRENT ROW),
           whole AS (PARTITION BY "ProjectID", metric)
),
trends AS (
    SELECT "ProjectID", metric, "DateTime", value, "Name", "FileType", mode,
        round(med, 6) AS "Median", round(sd, 6) AS std, round(med - sd, 6) AS "Lower", round(med + sd, 6) AS "Upper"
    FROM trended
),
summary AS (
    SELECT "ProjectID", metric, count(*) AS n,
        CASE WHEN count(*) > 5 THEN round(avg(value), 6) END AS mean,
        CASE WHEN count(*) > 5 THEN round(quantile_cont(value, 0.5), 6) END AS median,
        CASE WHEN count(*) > 5 THEN round(stddev_samp(value), 6) END AS std
    FROM trend_rows GROUP BY ALL
),
catalogue AS (
    SELECT * FROM (VALUES ('m1', 'Metric one', 0), ('m1_iQC', 'Metric one control', 1),
                          ('m2', 'Metric two', 2), ('m2_iQC', 'Metric two control', 3)) AS c(metric, label, ord)
),
counted AS (
    SELECT p."ProjectID", c.metric,
        count(l.value) AS n_points, count(CASE WHEN NOT l.is_std THEN l.value END) AS n
    FROM (SELECT DISTINCT "ProjectID" FROM wide) p CROSS JOIN catalogue c
    LEFT JOIN long l ON l."ProjectID" = p."ProjectID" AND l.metric = c.metric
    GROUP BY ALL
)
""".replace("@NUMBER", _NUMBER)

_RECENT = r"""
recent_meta AS (
    SELECT DISTINCT regexp_replace("SampleName_ID", '@SUFFIX', '') AS sample_id,
        TRY_CAST("CreationDate" AS timestamp) AS "Time"
    FROM sample_meta
),
recent_a AS (
    SELECT regexp_replace("Name", '@SUFFIX', '') AS sample_id,
        make_timestamp(CAST("System_Time_s" AS bigint) * 1000000) AS "Time"
    FROM report_a
),
recent_b AS (
    SELECT regexp_replace("Name", '@SUFFIX', '') AS sample_id,
        make_timestamp(CAST("System_Time_s" AS bigint) * 1000000) AS "Time"
    FROM report_b
),
recent AS (
    (SELECT * FROM recent_meta ORDER BY "Time" DESC NULLS LAST, sample_id LIMIT 500)
    UNION ALL (SELECT * FROM recent_a ORDER BY "Time" DESC NULLS LAST, sample_id LIMIT 500)
    UNION ALL (SELECT * FROM recent_b ORDER BY "Time" DESC NULLS LAST, sample_id LIMIT 500)
),
updates AS (
    SELECT * FROM merged WHERE "RawFileName" IN (SELECT sample_id FROM recent)
    QUALIFY row_number() OVER (PARTITION BY "RawFileName" ORDER BY "DateTime" DESC NULLS LAST, "SampleName_ID") = 1
),
stale AS (
    SELECT * REPLACE (0.0::double AS m_1) FROM merged
    WHERE CAST(string_split("RawFileName", '_')[-1] AS bigint) % 6 <> 0
)
""".replace("@SUFFIX", _SUFFIX)

_LITERAL = """contains("RawFileName", '[Ss]tandar[dt]')"""
_PATTERN = """regexp_matches("RawFileName", '[Ss]tandar[dt]')"""


def _with(*parts: str, body: str, samples: str = "sample_meta", standard: str = _LITERAL) -> str:
    text = "WITH " + ",".join(p.rstrip() for p in parts) + "\n" + body.strip()
    return text.replace("@SAMPLES", samples).replace("@STANDARD", standard).replace("@SUFFIX", _SUFFIX)


def _sources(body: str) -> str:
    return _with(_SOURCES, body=body)


def _merged(body: str, **kw: str) -> str:
    return _with(_SOURCES, _MERGED, body=body, **kw)


def _long(body: str) -> str:
    return _with(_SOURCES, _MERGED, _LONG, body=body)


def _recent(body: str) -> str:
    return _with(_SOURCES, _MERGED, _RECENT, body=body)


_ALL_REPORT = 'src_idx, "Name", "System_Time_s", m_1, m2'

_LAST = """
    SELECT "ProjectID", "RawFileName" AS last_measured, "DateTime" AS last_measured_time,
        CASE WHEN "RawFileName" IS NULL OR "RawFileName" = '' THEN ''
             WHEN "DateTime" IS NULL THEN 'Last measured: ' || "RawFileName"
             ELSE 'Last measured: ' || "RawFileName" || ' Time: ' || strftime("DateTime", '%Y-%m-%d %H:%M') END
            AS last_measured_text
    FROM merged
    QUALIFY row_number() OVER (PARTITION BY "ProjectID" ORDER BY "DateTime" DESC NULLS FIRST, "RawFileName" DESC) = 1
"""

_AUDIT = """
WITH days AS (SELECT CAST(ts AS date) AS day, max(ts) AS updated_at, count(*) AS n FROM events GROUP BY 1),
audit AS (SELECT updated_at, CAST(sum(n) OVER (ORDER BY day) AS bigint) AS row_count FROM days),
last AS (
    SELECT updated_at, row_count, row_count - lag(row_count) OVER (ORDER BY updated_at) AS new_rows
    FROM audit ORDER BY updated_at DESC LIMIT 1
)
"""

ORACLE: dict[str, str] = {
    "union_reports": _sources(f"SELECT {_ALL_REPORT} FROM reports"),
    "split_regular_control": _sources("""
        SELECT src_idx, is_control, count(*) AS n, count(DISTINCT "Name") AS n_names FROM named_reports GROUP BY ALL"""),
    "dedup_regular": _sources(f"SELECT {_ALL_REPORT} FROM regular"),
    "dedup_control": _sources(f"SELECT {_ALL_REPORT} FROM control"),
    "align_control": _sources('SELECT run AS "RawFileName", * EXCLUDE (run) FROM aligned'),
    "attach_samples": _merged("SELECT * FROM base"),
    "merged": _merged("SELECT * FROM merged"),
    "merged_pattern_standards": _merged(
        'SELECT "FileType", count(*) AS n FROM merged GROUP BY ALL', standard=_PATTERN),
    "merge_coverage": _merged("""
        SELECT "ProjectID", "Name" IS NOT NULL AS has_regular, "Name_iQC" IS NOT NULL AS has_control,
            "SampleName_ID" IS NOT NULL AS has_sample, "ProjectName" IS NOT NULL AS has_project, count(*) AS n
        FROM merged GROUP BY ALL"""),
    "assert_unique_report": _merged(
        'SELECT "RawFileName", count(*) AS n FROM merged WHERE "RawFileName" IS NOT NULL GROUP BY ALL HAVING count(*) > 1',
        samples="""(SELECT * FROM sample_meta UNION ALL
            SELECT * REPLACE (regexp_replace("SampleName_ID", '\\.raw$', '.d') AS "SampleName_ID")
            FROM sample_meta WHERE "Error" IS NOT NULL)"""),
    "distinct_samples": _recent("SELECT * FROM recent_meta"),
    "recent_samples": _recent("SELECT * FROM recent"),
    "recent_merge": _recent("SELECT * FROM updates"),
    "recent_semi": _recent("""
        SELECT "RawFileName", "ProjectID", "DateTime" FROM stale WHERE "RawFileName" IN (SELECT sample_id FROM recent)"""),
    "upsert_result": _recent("""
        SELECT * FROM stale WHERE "RawFileName" IS NULL OR "RawFileName" NOT IN (SELECT "RawFileName" FROM updates)
        UNION ALL SELECT * FROM updates"""),
    "upsert_touched_files": _recent("""
        SELECT * FROM stale WHERE "RawFileName" IS NULL OR "RawFileName" NOT IN (
            SELECT "RawFileName" FROM merged WHERE "ProjectID" = 'P1_click_B1' AND "RawFileName" IS NOT NULL)
        UNION ALL SELECT * FROM merged WHERE "ProjectID" = 'P1_click_B1' """),
    "refresh_counts": _recent("""
        SELECT (SELECT count(*) FROM stale) AS rows_before,
            count(s."RawFileName") AS rows_updated,
            count(*) - count(s."RawFileName") AS rows_inserted,
            (SELECT count(*) FROM stale) + count(*) - count(s."RawFileName") AS rows_final,
            (SELECT count(*) FROM recent) AS samples_processed
        FROM updates u LEFT JOIN stale s ON u."RawFileName" = s."RawFileName" """),
    "project_slice_like": _merged("""SELECT * FROM merged WHERE "ProjectID" LIKE 'P1_click_B_'
        ORDER BY "DateTime" NULLS LAST, "RawFileName" NULLS LAST"""),
    "project_slice_exact": _merged("""SELECT * FROM merged WHERE "ProjectID" = 'P4_view_B1'
        ORDER BY "DateTime" NULLS LAST, "RawFileName" NULLS LAST"""),
    "valid_error_split": _merged('SELECT "ProjectID", "RawFileName", "Date", "Error", is_error FROM flagged'),
    "error_table": _merged(
        'SELECT "ProjectID", "RawFileName" AS "Rawfile Name", "Error" FROM flagged WHERE is_error'),
    "projects_by_recency": _merged("""
        SELECT "ProjectID", max("DateTime") AS newest FROM merged GROUP BY ALL ORDER BY newest DESC NULLS LAST, "ProjectID" """),
    "search_projects": _merged("""
        SELECT "ProjectID", max("DateTime") AS newest FROM merged WHERE contains(lower("ProjectID"), 'click_b')
        GROUP BY ALL ORDER BY newest DESC NULLS LAST, "ProjectID" LIMIT 10"""),
    "project_page": _merged("""
        SELECT "ProjectID", max("DateTime") AS newest FROM merged GROUP BY ALL
        ORDER BY newest DESC NULLS LAST, "ProjectID" LIMIT 20"""),
    "last_measured": _merged(_LAST),
    "project_overview": _merged(f"""
        SELECT o."ProjectID", n_valid, n_error, newest, last_measured, last_measured_time, n_valid >= 75 AS single_column,
            last_measured_text
        FROM (SELECT "ProjectID", count(*) FILTER (NOT is_error) AS n_valid, count(*) FILTER (is_error) AS n_error,
                max("DateTime") AS newest FROM flagged GROUP BY ALL) o
        JOIN ({_LAST}) l ON o."ProjectID" = l."ProjectID" """),
    "project_detail": _merged("""
        SELECT "ProjectID", "column", column_ord, value, count(*) OVER same AS n_runs,
            "DateTime" IS NULL AS first_no_time, "DateTime" AS first_time, "RawFileName" AS first_file
        FROM (
            SELECT "ProjectID", "DateTime", "RawFileName", 'MSInstrument' AS "column", 0 AS column_ord,
                coalesce("MSInstrument", 'not available') AS value FROM flagged WHERE NOT is_error
            UNION ALL SELECT "ProjectID", "DateTime", "RawFileName", 'HPLCInstrument', 1,
                coalesce("HPLCInstrument", 'not available') FROM flagged WHERE NOT is_error
            UNION ALL SELECT "ProjectID", "DateTime", "RawFileName", 'InstrumentMethod', 2,
                coalesce(string_split(replace("InstrumentMethod_print", chr(92), '/'), '/')[-1], 'not available')
            FROM flagged WHERE NOT is_error)
        WINDOW same AS (PARTITION BY "ProjectID", "column", value)
        QUALIFY row_number() OVER (PARTITION BY "ProjectID", "column", value
            ORDER BY "DateTime" NULLS LAST, "RawFileName") = 1"""),
    "metric_long": _long('SELECT "ProjectID", metric, "DateTime", "RawFileName", "FileType", value FROM long'),
    "points": _long("""
        SELECT "ProjectID", l.metric, "DateTime", value, "FileType", "RawFileName", label, CAST(ord AS bigint) AS ord
        FROM long l JOIN catalogue c ON l.metric = c.metric WHERE l.metric IN ('m1', 'm2_iQC')"""),
    "series_by_type": _long("""
        SELECT "ProjectID", metric, "FileType", count(*) OVER (PARTITION BY "ProjectID", metric, "FileType") AS n_points,
            "DateTime" AS first_time, "RawFileName" AS first_file
        FROM long WHERE "FileType" IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY "ProjectID", metric, "FileType"
            ORDER BY "DateTime" NULLS LAST, "RawFileName") = 1"""),
    "exclude_standards": _long(
        'SELECT metric, "FileType", count(*) AS n FROM long WHERE NOT is_std GROUP BY ALL'),
    "trend_mode": _long("""
        SELECT "ProjectID", metric, n, CASE WHEN n >= 30 THEN 'rolling' WHEN n > 5 THEN 'static' ELSE 'none' END AS mode
        FROM counted"""),
    "metric_availability": _long('SELECT "ProjectID", metric, n_points, n_points > 0 AS available FROM counted'),
    "metric_trends": _long("SELECT * FROM trends"),
    "rolling_trend": _long("SELECT * FROM trends WHERE mode = 'rolling'"),
    "static_trend": _long("SELECT * FROM trends WHERE mode = 'static'"),
    "metric_summary": _long("SELECT * FROM summary"),
    "metric_report": _long("""
        SELECT c."ProjectID", c.metric, k.label, CAST(k.ord AS bigint) AS ord, c.n_points, c.n AS n_trend,
            CASE WHEN c.n >= 30 THEN 'rolling' WHEN c.n > 5 THEN 'static' ELSE 'none' END AS mode, mean, median, std,
            CASE WHEN mean IS NULL THEN NULL WHEN abs(mean * 100 - floor(mean * 100) - 0.5) > 1e-6 THEN 'mean: ' || printf('%.2f', mean) END AS mean_text,
            CASE WHEN median IS NULL THEN NULL WHEN abs(median * 100 - floor(median * 100) - 0.5) > 1e-6 THEN 'median: ' || printf('%.2f', median) END AS median_text,
            CASE WHEN std IS NULL THEN NULL WHEN abs(std * 100 - floor(std * 100) - 0.5) > 1e-6 THEN 'std dev: ' || printf('%.2f', std) END AS std_text
        FROM counted c JOIN catalogue k ON c.metric = k.metric
        LEFT JOIN summary s ON c."ProjectID" = s."ProjectID" AND c.metric = s.metric
        WHERE c.n_points > 0"""),
    "summary_texts": _long("""
        SELECT "ProjectID", metric, 'mean: ' || printf('%.2f', max(value)) AS mean_text,
            'std dev: ' || printf('%.2f', min(value / 7 - 50)) AS std_text
        FROM long GROUP BY ALL"""),
    "latest_refresh": _AUDIT + "SELECT updated_at, '{}' AS source_mtimes, row_count, new_rows FROM last",
    "freshness": _AUDIT + """
        SELECT updated_at, new_rows, 'Data refreshed ' || strftime(updated_at, '%Y-%m-%d %H:%M') ||
            CASE WHEN new_rows > 0 THEN ' · +' || new_rows || ' samples' ELSE '' END AS text FROM last""",
    "mtimes_json": """
        WITH newest AS (SELECT event_type, max(ts) AS ts FROM events GROUP BY 1)
        SELECT '{' || string_agg('"' || event_type || '":"' || CASE WHEN event_type = 'signup' THEN 'unavailable'
            ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || '"', ',' ORDER BY event_type) || '}' AS source_mtimes FROM newest""",
    "route_changes": """
        SELECT '/ext/' || event_type || '.sqlite' AS path,
            CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' WHEN 'error' THEN 'meta' END AS source,
            CASE event_type WHEN 'click' THEN 'report' WHEN 'view' THEN 'report' WHEN 'error' THEN 'metadata'
                ELSE 'unknown' END AS role,
            count(*) AS n_events
        FROM events GROUP BY ALL""",
}

for _name in ("full_refresh_stored", "incremental_all_changes", "stream_refresh_stored"):
    ORACLE[_name] = ORACLE["merged"]
ORACLE["merged_error_in_projects"] = f"""
    SELECT * REPLACE (CASE WHEN "ProjectName" IS NOT NULL AND suffix("ProjectID", '_B1') THEN 'broken' END AS "Error")
    FROM ({ORACLE["merged"]})"""
ORACLE["export_roundtrip"] = f"""
    SELECT * REPLACE (nullif("ProjectID", '') AS "ProjectID"), coalesce('id:' || "ProjectID", 'none') AS folder
    FROM ({ORACLE["merged"]})"""
ORACLE["trends_after_refresh"] = ORACLE["metric_trends"]
ORACLE["edited_sources_stored"] = ORACLE["merged"]
ORACLE["validation_outcomes"] = _with(_SOURCES, body="""
    SELECT 'ra' AS "source", 'SingleFileReport' AS "table", 'ok' AS state, (SELECT count(*) FROM report_a) AS n_rows, false AS failed
    UNION ALL SELECT 'rb', 'SingleFileReport', 'missing', NULL, true
    UNION ALL SELECT 'rc', 'SingleFileReport', 'absent', NULL, true
    UNION ALL SELECT 'meta', 'Metadata_Project', 'missing', NULL, true
    UNION ALL SELECT 'meta', 'Metadata_Sample', 'ok', (SELECT count(*) FROM sample_meta), true""")
ORACLE["audit_history"] = _merged("""
    SELECT * , row_count - lag(row_count) OVER (ORDER BY refresh) AS gained, 'meta,ra,rb' AS sources FROM (
        SELECT 1::BIGINT AS refresh, count(*) FILTER (event % 6 <> 0) AS row_count FROM (SELECT CAST(string_split("RawFileName", '_')[-1] AS BIGINT) AS event FROM merged)
        UNION ALL SELECT 2, count(*) FILTER (event % 12 <> 0) FROM (SELECT CAST(string_split("RawFileName", '_')[-1] AS BIGINT) AS event FROM merged)
        UNION ALL SELECT 3, count(*) FROM merged)""")
ORACLE["report_tables_all"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS section, count(*) AS n, round(sum(CAST({what} AS DOUBLE)), 6) AS total FROM ({ORACLE[source]}) WHERE "ProjectID" = 'P1_click_B1'"""
    for name, source, what in (
        ("overview", "project_overview", "n_valid"), ("detail", "project_detail", "n_runs"), ("errors", "error_table", "1"),
        ("metrics", "metric_report", "n_points"), ("points", "metric_long", "value"), ("series", "series_by_type", "n_points"),
        ("trends", "metric_trends", '"Median"')))
ORACLE["summary_after_refresh"] = ORACLE["project_overview"]
