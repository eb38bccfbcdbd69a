"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from tidemill.functions.schemas import COUNTERS, HOURS
from tidemill.operators.ranking import TOP

EPOCH = "TIMESTAMP '1970-01-01'"
K = "regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::BIGINT"
FRIENDS = f"friends AS (SELECT event_id, ts, user_id AS u1, {K} AS u2 FROM events)"
PAIRS = f"{FRIENDS}, pairs AS (SELECT greatest(u1, u2) AS hi, least(u1, u2) AS lo, ts, event_id FROM friends QUALIFY row_number() OVER (PARTITION BY greatest(u1, u2), least(u1, u2) ORDER BY ts, event_id) = 1)"
COMMENTS = f"comments AS (SELECT ts, event_id AS comment_id, user_id, event_type <> 'error' AS is_post_comment, {K} AS parent_id FROM events WHERE event_type IN ('click', 'view', 'error'))"
POSTS_HIT = f"{COMMENTS}, hits AS (SELECT ts, parent_id AS id FROM comments WHERE is_post_comment)"
ACTIVITY = "activity AS (SELECT ts, user_id, (event_type = 'signup')::INT AS a, (event_type = 'purchase')::INT AS b, (event_type IN ('click', 'view', 'error'))::INT AS c FROM events)"
ORDER = f"score DESC, last_ts DESC, id DESC) <= {TOP}"


def _hour(ts: str = "ts") -> str:
    return f"hour(timezone('Europe/Dublin', timezone('UTC', {ts})))"


def _counters(source: str, window: str, keys: str = "") -> str:
    counts = ", ".join(f"count(*) FILTER (h = {h}) AS {c}" for h, c in zip(HOURS, COUNTERS, strict=True))
    return f"SELECT {keys}{window} AS ts, {counts} FROM (SELECT *, {_hour()} AS h FROM {source}) GROUP BY ALL"


def _sums(source: str, window: str, keys: str = "") -> str:
    return f"SELECT {keys}{window} AS ts, {', '.join(f'sum({c})::BIGINT AS {c}' for c in COUNTERS)} FROM {source} GROUP BY ALL"


def bucket(size: str, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{size}', {ts}, {EPOCH})"


def _starts(size: str, slide: str, n: int) -> str:
    return f"{bucket(slide)} - t.k * INTERVAL '{slide}' AS w FROM %s, range({n}) t(k)"


DAILY = f"{PAIRS}, daily AS ({_counters('pairs', bucket('1 day'))})"


def _windows(source: str, size: str, slide: str | None, n: int) -> str:
    """Rows with the start of each of their windows."""
    if slide is None:
        return f"SELECT *, {bucket(size)} AS w FROM {source}"
    return f"SELECT s.*, {_starts(size, slide, n) % (source + ' s')}"


def _posts(size: str, slide: str | None = None, n: int = 1) -> str:
    return (
        f"WITH {POSTS_HIT}, placed AS ({_windows('hits', size, slide, n)}), scores AS (SELECT w, id, count(*) AS score, max(ts) AS last_ts FROM placed GROUP BY ALL)"
        f" SELECT w AS window_start, rank::INT AS rank, id AS post_id, score AS num_comments FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, last_ts DESC, id DESC) AS rank FROM scores) WHERE rank <= {TOP}"
    )


USER_SUMS = "sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(a + b + c)::BIGINT AS score, max(%s) AS last_ts"


def _users(size: str, slide: str | None = None, n: int = 1) -> str:
    return (
        f"WITH {ACTIVITY}, placed AS ({_windows('activity', size, slide, n)}), scores AS (SELECT w, user_id AS id, {USER_SUMS % 'ts'} FROM placed GROUP BY ALL)"
        f" SELECT w AS window_start, rank::INT AS rank, id AS user_id, a, b, c, score FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, last_ts DESC, id DESC) AS rank FROM scores) WHERE rank <= {TOP}"
    )


def _ranked(name: str, source: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, last_ts DESC, id DESC) AS rank FROM {source} QUALIFY row_number() OVER (PARTITION BY w ORDER BY {ORDER})"


def _rollup(users: bool, weekly: bool) -> str:
    base, source = (ACTIVITY, "activity") if users else (POSTS_HIT, "hits")
    first = f"user_id AS id, {USER_SUMS % 'ts'}" if users else "id, count(*)::BIGINT AS score, max(ts) AS last_ts"
    again = f"id, {USER_SUMS % 'last_ts'}" if users else "id, sum(score)::BIGINT AS score, max(last_ts) AS last_ts"
    steps = [base, f"s0 AS (SELECT {bucket('1 hour')} AS w, {bucket('1 hour')} AS st, {first} FROM {source} GROUP BY ALL)", _ranked("r0", "s0")]
    for i, size in enumerate(["1 day", "7 days"][: 1 + weekly], 1):
        steps.append(f"m{i} AS (SELECT {bucket(size, 'st')} AS w, min(st) AS st FROM r{i - 1} GROUP BY 1)")
        steps.append(f"s{i} AS (SELECT x.w, m.st, x.* EXCLUDE (w) FROM (SELECT {bucket(size, 'st')} AS w, {again} FROM r{i - 1} GROUP BY 1, id) x JOIN m{i} m USING (w))")
        steps.append(_ranked(f"r{i}", f"s{i}"))
    columns = "id AS user_id, a, b, c, score" if users else "id AS post_id, score AS num_comments"
    return f"WITH {', '.join(steps)} SELECT w AS window_start, rank::INT AS rank, {columns}, st AS ts FROM r{1 + weekly}"


def _wide(inner: str, id_col: str, score: str, id_name: str, score_name: str) -> str:
    columns = ", ".join(f"coalesce(max({c}) FILTER (rank = {i}), 0)::BIGINT AS {n}_{i}" for i in range(1, TOP + 1) for c, n in ((id_col, id_name), (score, score_name)))
    return f"SELECT window_start AS ts, {columns} FROM ({inner}) GROUP BY 1"


def _halves(combine: str) -> str:
    half = lambda n, c: f"{n} AS (SELECT date_trunc('day', ts) AS w, id, count(*) AS score, max(ts) AS last_ts FROM hits WHERE {c} GROUP BY date_trunc('day', ts), id QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY count(*) DESC, max(ts) DESC, id DESC) <= {TOP})"
    return f"WITH {POSTS_HIT}, {half('am', 'hour(ts) < 12')}, {half('pm', 'hour(ts) >= 12')}, both_ AS (SELECT * FROM am UNION ALL SELECT * FROM pm), merged AS ({combine}), {_ranked('best', 'merged')} SELECT w::TIMESTAMP AS day, rank::INT AS rank, id, score FROM best"


def _board(scores: str) -> str:
    return f"WITH scores AS ({scores}) SELECT rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, last_ts DESC, id DESC) AS rank FROM scores) WHERE rank <= {TOP}"


MS = "sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(a + b + c)::BIGINT AS score, max(%s) AS last_ts"


def _users(size: str, slide: str | None = None, n: int = 1) -> str:
    return (
        f"WITH {ACTIVITY}, placed AS ({_windows('activity', size, slide, n)}), scores AS (SELECT w, user_id AS id, {USER_SUMS % 'ts'} FROM placed GROUP BY ALL)"
        f" SELECT w AS window_start, rank::INT AS rank, id AS user_id, a, b, c, score FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, last_ts DESC, id DESC) AS rank FROM scores) WHERE rank <= {TOP}"
    )


def _ranked(name: str, source: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, last_ts DESC, id DESC) AS rank FROM {source} QUALIFY row_number() OVER (PARTITION BY w ORDER BY {ORDER})"


def _rollup(users: bool, weekly: bool) -> str:
    base, source = (ACTIVITY, "activity") if users else (POSTS_HIT, "hits")
    first = f"user_id AS id, {USER_SUMS % 'ts'}" if users else "id, count(*)::BIGINT AS score, max(ts) AS last_ts"
    again = f"id, {USER_SUMS % 'last_ts'}" if users else "id, sum(score)::BIGINT AS score, max(last_ts) AS last_ts"
    steps = [base, f"s0 AS (SELECT {bucket('1 hour')} AS w, {bucket('1 hour')} AS st, {first} FROM {source} GROUP BY ALL)", _ranked("r0", "s0")]
    for i, size in enumerate(["1 day", "7 days"][: 1 + weekly], 1):
        steps.append(f"m{i} AS (SELECT {bucket(size, 'st')} AS w, min(st) AS st FROM r{i - 1} GROUP BY 1)")
        steps.append(f"s{i} AS (SELECT x.w, m.st, x.* EXCLUDE (w) FROM (SELECT {bucket(size, 'st')} AS w, {again} FROM r{i - 1} GROUP BY 1, id) x JOIN m{i} m USING (w))")
        steps.append(_ranked(f"r{i}", f"s{i}"))
    columns = "id AS user_id, a, b, c, score" if users else "id AS post_id, score AS num_comments"
    return f"WITH {', '.join(steps)} SELECT w AS window_start, rank::INT AS rank, {columns}, st AS ts FROM r{1 + weekly}"


def _wide(inner: str, id_col: str, score: str, id_name: str, score_name: str) -> str:
    columns = ", ".join(f"coalesce(max({c}) FILTER (rank = {i}), 0)::BIGINT AS {n}_{i}" for i in range(1, TOP + 1) for c, n in ((id_col, id_name), (score, score_name)))
    return f"SELECT window_start AS ts, {columns} FROM ({inner}) GROUP BY 1"


def _halves(combine: str) -> str:
    half = lambda n, c: f"{n} AS (SELECT date_trunc('day', ts) AS w, id, count(*) AS score, max(ts) AS last_ts FROM hits WHERE {c} GROUP BY date_trunc('day', ts), id QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY count(*) DESC, max(ts) DESC, id DESC) <= {TOP})"
    return f"WITH {POSTS_HIT}, {half('am', 'hour(ts) < 12')}, {half('pm', 'hour(ts) >= 12')}, both_ AS (SELECT * FROM am UNION ALL SELECT * FROM pm), merged AS ({combine}), {_ranked('best', 'merged')} SELECT w::TIMESTAMP AS day, rank::INT AS rank, id, score FROM best"


def _board(scores: str) -> str:
    return f"WITH scores AS ({scores}) SELECT rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, last_ts DESC, id DESC) AS rank FROM scores) WHERE rank <= {TOP}"


def _spoilt_id(kind: str) -> str:
    """Fields of the synthesised lines: the own id, if it survives validation."""
    return "CASE WHEN event_id % 7 IN (1, 2) THEN NULL ELSE event_id END"


MS = "date_trunc('millisecond', ts)"
_RUN = "OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _running(source: str) -> str:
    return ", ".join(f"(sum({c}) {_RUN})::BIGINT AS {c}" for c in COUNTERS) + f" FROM {source}"


def sql() -> dict[str, str]:
    latency = f"SELECT {bucket('1 hour')} AS window_start, max(value) AS max_latency, min(value) AS min_latency, round(avg(value), 6) AS avg_latency, count(*) AS n, sum((value * 100)::BIGINT)::BIGINT AS sum_cents FROM events GROUP BY 1"
    rendered = f"SELECT '(' || strftime(window_start, '%Y-%m-%d %H:%M:%S') || ', List(' || string_agg('(ID: ' || post_id || ', score: ' || num_comments || ')', ', ' ORDER BY rank) || '), {TOP})' AS value FROM ({_posts('1 day')}) GROUP BY window_start"
    labelled = " UNION ALL ".join(f"SELECT '{n}' AS granularity, * FROM ({_posts(s)})" for n, s in (("hourly", "1 hour"), ("daily", "1 day"), ("weekly", "7 days")))
    member = "'{\"window_start\":\"' || strftime(window_start, '%Y-%m-%dT%H:%M:%S.000') || '\",\"rank\":' || rank || ',\"post_id\":' || post_id || ',\"num_comments\":' || num_comments || '}'"
    found = {
        "q1_dedupe_pairs": f"WITH {PAIRS} SELECT hi, lo, ts, event_id FROM pairs",
        "q1_pair_key": f"WITH {FRIENDS} SELECT least(u1, u2) || '-' || greatest(u1, u2) AS pair_key, count(*) AS n FROM friends GROUP BY 1",
        "q1_daily": f"WITH {DAILY} SELECT * FROM daily",
        "q1_daily_dst": _counters("(SELECT o_orderdate AS ts FROM orders)", bucket("1 day")),
        "q1_daily_by_user": _counters("events", bucket("1 day"), "user_id, "),
        "q1_weekly_by_user": _counters("events", bucket("7 days"), "user_id, "),
        "q1_weekly_sliding": f"WITH {DAILY} {_sums('(SELECT d.*, ' + _starts('7 days', '1 day', 7) % 'daily d' + ')', 'w')}",
        "q1_weekly_tumbling": f"WITH {DAILY} {_sums('daily', bucket('7 days'))}",
        "q1_alltime": f"WITH {DAILY} SELECT min(ts) AS ts, {', '.join(f'sum({c})::BIGINT AS {c}' for c in COUNTERS)} FROM daily HAVING count(*) > 0",
        "q1_alltime_by_week": f"WITH {DAILY}, weekly AS ({_sums('daily', bucket('7 days'))}) SELECT ts, {_running('weekly')}",
        "q1_alltime_running": f"WITH {DAILY} SELECT min(ts) {_RUN} AS ts, ts AS upto, {_running('daily')}",
        "q2_hourly_tumbling": _posts("1 hour"),
        "q2_weekly_tumbling": _posts("7 days"),
        "q2_hourly_sliding": _posts("1 hour", "30 minutes", 2),
        "q2_daily_sliding": _posts("24 hours", "1 hour", 24),
        "q2_weekly_sliding": _posts("7 days", "1 day", 7),
        "q2_daily_sliding_direct": _posts("24 hours", "1 hour", 24),
        "q2_daily_rollup": _rollup(users=False, weekly=False),
        "q2_weekly_rollup": _rollup(users=False, weekly=True),
        "q2_hourly_wide": _wide(_posts("1 hour"), "post_id", "num_comments", "post_id", "num_comments"),
        "q2_daily_rendered": rendered,
        "q3_hourly_tumbling": _users("1 hour"),
        "q3_hourly_sliding": _users("1 hour", "30 minutes", 2),
        "q3_daily_sliding": _users("24 hours", "1 hour", 24),
        "q3_weekly_sliding": _users("7 days", "1 day", 7),
        "q3_daily_rollup": _rollup(users=True, weekly=False),
        "q3_weekly_rollup": _rollup(users=True, weekly=True),
        "q3_hourly_wide": _wide(_users("1 hour"), "user_id", "score", "user", "rating"),
        "parse_friendships": f"SELECT {MS} AS ts, CASE WHEN event_id % 7 = 0 THEN event_id ELSE user_id END AS user_id1, {K} AS user_id2 FROM events WHERE event_id % 7 NOT IN (1, 2)",
        "parse_comments": f"SELECT {MS} AS ts, event_id AS comment_id, user_id, event_type AS content, 'user ' || user_id AS user_name, event_type <> 'error' AS is_post_comment, {K} AS parent_id FROM events WHERE event_id % 7 NOT IN (1, 2, 3, 4)"
        # a reply with a pipe in its text has the seven fields of a comment on a post
        f" UNION ALL SELECT {MS}, event_id, user_id, 'a', 'b', true, {K} FROM events WHERE event_id % 7 = 4 AND event_type = 'error'",
        "parse_posts": f"SELECT {MS} AS ts, event_id AS post_id, user_id, CASE WHEN event_id % 7 = 3 THEN '' ELSE event_type END AS content, 'user ' || user_id AS user_name FROM events WHERE event_id % 7 NOT IN (1, 2, 4)",
        "parse_unchecked": f"SELECT {MS} AS ts, user_id FROM events",
        "filter_post_comments": f"WITH {COMMENTS} SELECT ts, comment_id, parent_id FROM comments WHERE is_post_comment",
        "union_activity": f"WITH {ACTIVITY} SELECT user_id, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c FROM activity GROUP BY 1",
        "union_granularities": labelled,
        "split_streams": "SELECT event_type AS tag, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
        "rank_merge": _halves("SELECT w, id, score, max(last_ts) AS last_ts FROM both_ GROUP BY ALL"),
        "rank_incremental_merge": _halves("SELECT w, id, sum(score)::BIGINT AS score, max(last_ts) AS last_ts FROM both_ GROUP BY w, id"),
        "board_topk": _board("SELECT user_id AS id, count(*) AS score, max(ts) AS last_ts FROM events GROUP BY 1"),
        "board_insert_last_wins": _board(f"SELECT user_id AS id, {K} AS score, ts AS last_ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
        "board_score_of": f"WITH board AS (SELECT user_id AS id, count(*) AS score FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT id, coalesce(score, -1) AS score FROM (SELECT DISTINCT {K} AS id FROM events) LEFT JOIN board USING (id)",
        "latency_by_window": latency,
        "latency_running_mean": f"SELECT window_start, round((sum(sum_cents) OVER w / sum(n) OVER w / 100.0)::DOUBLE, 6) AS mean_latency FROM ({latency}) WINDOW w AS (ORDER BY window_start ROWS UNBOUNDED PRECEDING)",
        "results_store_roundtrip": f"SELECT 'posts_day' AS key, {member} AS member FROM ({_posts('1 day')})",
    }
    same = {"stream_q1_daily": "q1_daily", "stream_q2_hourly": "q2_hourly_tumbling", "stream_q2_daily_rollup": "q2_daily_rollup", "stream_q3_hourly": "q3_hourly_tumbling", "stream_q1_alltime": "q1_alltime"}
    return found | {name: found[twin] for name, twin in same.items()}
