"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

from tidebook.operators.histogram import DECODE, RESYNC, TICK_TO_BOOK
from tidebook.operators.tracker import BUFFER
from tidebook.plans.catalogue import CAPACITY, CUT, CUT_SHARE, SHOWN
from tidebook.sources.feed import LATE, TAKEN

_LEVELS = """lv AS (SELECT user_id % 8 AS symbol, event_id AS arrival, CASE WHEN event_type IN ('view', 'click') THEN 'B' ELSE 'A' END AS side,
    CAST(round(value * 100) AS BIGINT) % 97 + 1 AS price, CASE WHEN event_type = 'error' THEN 0 ELSE user_id + 1 END AS qty,
    event_id AS first_id, event_id + (user_id % 5) * 10 AS last_id, user_id, event_type, ts FROM events)"""
_LWW = f"{_LEVELS}, bk AS (SELECT * FROM (SELECT symbol, side, price, arg_max(qty, arrival) AS qty FROM lv GROUP BY ALL) WHERE qty <> 0)"
_DENSE = f"""{_LEVELS}, dn AS (SELECT symbol, arrival, side, price + CASE WHEN side = 'A' THEN 100 ELSE 0 END AS price, qty, 2 * rn - 1 AS first_id,
    2 * rn + CASE WHEN user_id % 5 = 0 THEN 5 ELSE 0 END AS last_id
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival) AS rn FROM lv) WHERE rn % 400 < 390)"""


def _classes(rows: str, anchor: str) -> str:
    return f"""po AS (SELECT *, greatest({anchor}, max(last_id) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS position FROM {rows}),
cl AS (SELECT *, CASE WHEN last_id <= position THEN 'stale' WHEN first_id <= position + 1 THEN 'contiguous' ELSE 'gapped' END AS raw FROM po),
gp AS (SELECT symbol, min(arrival) AS gap_at FROM cl WHERE raw = 'gapped' GROUP BY symbol),
la AS (SELECT cl.*, CASE WHEN gap_at IS NULL OR arrival <= gap_at THEN raw ELSE 'buffered' END AS class FROM cl LEFT JOIN gp USING (symbol))"""


_LATCHED = f"{_DENSE}, {_classes('dn', 'CAST(0 AS BIGINT)')}"
_CUT = f"(SELECT count(*) // {CUT_SHARE} FROM events)"
_SNAP = f"""{_DENSE}, sn AS (SELECT * FROM (SELECT symbol, side, price, arg_max(qty, arrival) AS qty FROM dn WHERE arrival < {_CUT} GROUP BY ALL) WHERE qty <> 0),
an AS (SELECT symbol, max(last_id) AS anchor FROM dn WHERE arrival < {_CUT} GROUP BY symbol),
da AS (SELECT dn.*, anchor FROM dn JOIN an USING (symbol)), {_classes('da', 'anchor')},
ab AS (SELECT * FROM (SELECT symbol, side, price, arg_max(qty, arrival) AS qty FROM (
    SELECT symbol, side, price, qty, -1 AS arrival FROM sn UNION ALL SELECT symbol, side, price, qty, arrival FROM la WHERE class = 'contiguous') GROUP BY ALL) WHERE qty <> 0)"""
_TOP = f"tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank FROM sn) WHERE rank <= {SHOWN})"
_VIEW = """max(CASE WHEN side = 'B' THEN price END) AS bid_price, arg_max(CASE WHEN side = 'B' THEN qty END, CASE WHEN side = 'B' THEN price END) AS bid_qty,
    min(CASE WHEN side = 'A' THEN price END) AS ask_price, arg_min(CASE WHEN side = 'A' THEN qty END, CASE WHEN side = 'A' THEN price END) AS ask_qty"""
_COUNTS = "count(*) FILTER (side = 'B') AS bids, count(*) FILTER (side = 'A') AS asks"
_CROSSED = "coalesce(max(CASE WHEN side = 'B' THEN price END) >= min(CASE WHEN side = 'A' THEN price END), false) AS crossed"
_AT = "ps AS (SELECT symbol, count(*) FILTER (class = 'gapped') = 0 AS live, coalesce(max(last_id) FILTER (class = 'contiguous'), max(anchor)) AS local_id, max(anchor) AS snapshot_id FROM la GROUP BY symbol)"
_GAPS = """ga AS (SELECT * FROM (SELECT symbol, arrival, CASE WHEN arrival % 100 = 13 THEN -gap ELSE gap END % 12000000000 AS ns FROM (
    SELECT user_id % 8 AS symbol, event_id AS arrival, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id % 8 ORDER BY event_id)) * 1000 AS gap FROM events)) WHERE ns IS NOT NULL)"""

_LOSSY = f"""{_LEVELS}, lr AS (SELECT CASE WHEN symbol < 6 THEN 0 ELSE symbol END AS k, arrival, side, price + CASE WHEN side = 'A' THEN 100 ELSE 0 END AS price, qty, user_id FROM lv),
ln AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY arrival) AS rn FROM lr),
ll AS (SELECT *, 2 * rn + CASE WHEN user_id % 5 = 0 THEN 5 ELSE 0 END AS last_id, rn % 400 < 390 AS kept, max(rn) OVER (PARTITION BY k) AS total FROM ln),
lp AS (SELECT *, coalesce(max(last_id) OVER (PARTITION BY k ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position, k = 0 AND total < {LATE} AS dead FROM ll),
lk AS (SELECT k, CASE WHEN k = 0 AND rn <= {LATE} THEN 'buffered' WHEN rn % 400 = 0 THEN 'gapped' WHEN last_id <= position THEN 'discarded' ELSE 'applied' END AS status FROM lp WHERE kept),
lh AS (SELECT k, any_value(dead) AS dead, count(*) FILTER (rn % 400 = 399 AND (k <> 0 OR rn > {TAKEN})) AS useful, count(*) FILTER (rn % 400 = 399 AND (k <> 0 OR rn > {LATE})) AS useless,
    count(*) FILTER (rn % 400 = 0 AND (k <> 0 OR rn > {LATE})) AS met, max(rn) FILTER (kept) AS seen, max(last_id) AS sent FROM lp GROUP BY k),
lc AS (SELECT k, status, count(*) AS n FROM lk GROUP BY ALL
    UNION ALL SELECT k, 'snapshot', 1 + useful + useless FROM lh WHERE NOT dead UNION ALL SELECT k, 'refetch', met + useful - useless FROM lh WHERE NOT dead UNION ALL SELECT k, 'anchored', 1 + met FROM lh WHERE NOT dead),
lb AS (SELECT * FROM (SELECT k, side, price, arg_max(qty, rn) AS qty FROM lp JOIN lh USING (k) WHERE rn <= seen AND NOT lh.dead AND last_id > position GROUP BY ALL) WHERE qty <> 0),
lw AS (SELECT k, max(CASE WHEN rn <= seen AND NOT lh.dead THEN last_id ELSE 0 END) AS local_id FROM lp JOIN lh USING (k) GROUP BY k)"""


def _histogram(values: str, bounds: tuple[int, ...], keys: str) -> str:
    rows = ", ".join(f"({i}, {b})" for i, b in enumerate(bounds)) + f", ({len(bounds)}, NULL)"
    case = " ".join(f"WHEN ns <= {b} THEN {i}" for i, b in enumerate(bounds))
    by, using, frame = (f"{keys}, ", f"{keys}, bucket", f"(SELECT DISTINCT {keys} FROM {values}), ") if keys else ("", "bucket", "")
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""bd(bucket, le) AS (SELECT CAST(b AS BIGINT), CAST(l AS BIGINT) FROM (VALUES {rows}) AS t(b, l)),
sb AS (SELECT {by}CAST(CASE {case} ELSE {len(bounds)} END AS BIGINT) AS bucket, count(*) AS n FROM {values} WHERE ns >= 0 GROUP BY ALL),
hs AS (SELECT {by}bucket, le, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER ({part}ORDER BY bucket) AS BIGINT) AS cumulative FROM (SELECT * FROM {frame}bd) LEFT JOIN sb USING ({using}))"""


_HIST = f"{_GAPS}, {_histogram('ga', RESYNC, 'symbol')}"
_QUANTILE = """qs(q, share) AS (VALUES ('p00', CAST(0.0 AS DOUBLE)), ('p50', 0.5), ('p75', 0.75), ('p100', 1.0)),
hx AS (SELECT *, sum(n) OVER (PARTITION BY symbol) AS total, coalesce(lag(le) OVER (PARTITION BY symbol ORDER BY bucket), 0) AS lower, max(le) OVER (PARTITION BY symbol) AS largest FROM hs),
rc AS (SELECT * FROM hx, qs WHERE cumulative >= share * total OR le IS NULL),
fr AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY symbol, q ORDER BY bucket) = 1)"""
_PAIRS = "pr AS (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, upper(n_name) AS base, upper(r_name) AS quote FROM nation JOIN region ON n_regionkey = r_regionkey)"
_FNV = "list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(symbol, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT))"
_DECODED = f"""{_LEVELS}, dc AS (SELECT arrival, symbol AS k, price, qty, side, first_id, last_id, user_id, epoch_us(ts) AS us, event_type = 'purchase' AS is_trade,
    CASE WHEN event_type <> 'purchase' AND arrival % 50 = 49 THEN 'unknown type' WHEN arrival % 70 = 69 THEN 'unknown symbol' END AS decode_error FROM lv)"""
_TEXT = """CASE event_id % 12 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN concat('-', event_id, '.5') WHEN 2 THEN concat(event_id, '.25000000')
    WHEN 3 THEN concat(event_id, '.125') WHEN 4 THEN '' WHEN 5 THEN concat('.', event_id % 10) WHEN 6 THEN concat(event_id, 'e5')
    WHEN 7 THEN concat('92233720368547758', event_id) WHEN 8 THEN '-' WHEN 9 THEN concat('+', event_id) WHEN 10 THEN concat(event_id, '.00a') ELSE '-.' END"""

ORACLES: dict[str, str] = {
    "book_lww": f"WITH {_LWW} SELECT * FROM bk",
    "book_asof_k": f"WITH {_LEVELS} SELECT * FROM (SELECT symbol, side, price, arg_max(qty, arrival) AS qty FROM lv WHERE arrival <= {CUT} GROUP BY ALL) WHERE qty <> 0",
    "best_bid_ask": f"WITH {_LWW} SELECT symbol, {_VIEW} FROM bk GROUP BY symbol",
    "book_top": f"WITH {_LWW} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank FROM bk) WHERE rank <= 5",
    "book_depth": f"WITH {_LWW} SELECT symbol, {_COUNTS} FROM bk GROUP BY symbol",
    "book_view": f"WITH {_LWW} SELECT symbol, {_VIEW}, {_COUNTS}, {_CROSSED} FROM bk GROUP BY symbol",
    "book_crossed": f"WITH {_LWW}, up AS (SELECT symbol, side, price + CASE WHEN side = 'A' THEN 100 ELSE 0 END AS price FROM bk) SELECT symbol, {_CROSSED} FROM up GROUP BY symbol",
    "seq_classify": f"WITH {_LEVELS}, {_classes('lv', 'CAST(0 AS BIGINT)')} SELECT symbol, arrival, position, raw AS class FROM cl",
    "seq_latched": f"WITH {_LATCHED} SELECT symbol, arrival, class FROM la",
    "seq_class_counts": f"WITH {_LATCHED} SELECT symbol, class, count(*) AS n FROM la GROUP BY ALL",
    "seq_first_gap": f"WITH {_LATCHED} SELECT * FROM gp",
    "seq_contiguity_audit": f"WITH {_LATCHED} SELECT symbol, count(*) AS n, count(*) FILTER (first_id = position + 1) AS exact, count(*) FILTER (first_id > position + 1) AS holes, count(*) FILTER (first_id < position + 1) AS overlaps, max(first_id - position - 1) AS widest FROM cl GROUP BY symbol",
    "book_after_snapshot": f"WITH {_SNAP} SELECT * FROM ab",
    "snapshot_bounds": f"WITH {_SNAP}, {_TOP} SELECT symbol, min(CASE WHEN side = 'B' THEN price END) AS bid_floor, max(CASE WHEN side = 'A' THEN price END) AS ask_ceil FROM tp GROUP BY symbol",
    "snapshot_duplicates": f"WITH {_LEVELS} SELECT symbol, side, price, count(*) AS copies FROM lv WHERE arrival < {_CUT} AND qty <> 0 GROUP BY ALL HAVING count(*) > 1",
    "level_validate": f"WITH {_LEVELS} SELECT arrival, price - 3 <= 0 OR qty - 2 < 0 AS invalid FROM lv",
    "compare_full": f"WITH {_SNAP} SELECT * FROM (SELECT symbol, side, price, coalesce(ab.qty, 0) AS local, coalesce(sn.qty, 0) AS remote FROM ab FULL JOIN sn USING (symbol, side, price)) WHERE local <> remote",
    "compare_bounded": f"""WITH {_SNAP}, {_TOP}, bo AS (SELECT symbol, min(CASE WHEN side = 'B' THEN price END) AS f, max(CASE WHEN side = 'A' THEN price END) AS c FROM tp GROUP BY symbol),
        fu AS (SELECT symbol, side, price, coalesce(ab.qty, 0) AS local, coalesce(tp.qty, 0) AS remote FROM ab FULL JOIN tp USING (symbol, side, price))
        SELECT symbol, side, price, local, remote, concat(CASE WHEN side = 'B' THEN 'bid' ELSE 'ask' END, ' ', price, ': local ', local, ', snapshot ', remote) AS text
        FROM fu LEFT JOIN bo USING (symbol) WHERE local <> remote AND NOT coalesce(side = 'B' AND price < f, false) AND NOT coalesce(side = 'A' AND price > c, false)""",
    "check_verdict": f"""WITH {_SNAP}, {_AT}, fu AS (SELECT symbol, count(*) AS compared, count(*) FILTER (coalesce(ab.qty, 0) <> coalesce(sn.qty, 0)) AS diffs FROM ab FULL JOIN sn USING (symbol, side, price) GROUP BY symbol)
        SELECT symbol, live, local_id, snapshot_id, coalesce(compared, 0) AS compared, coalesce(diffs, 0) AS diffs, snapshot_id - local_id AS id_skew,
        CASE WHEN NOT live THEN 'skipped' WHEN coalesce(diffs, 0) = 0 THEN 'ok' WHEN snapshot_id <> local_id THEN 'skewed' ELSE 'diverged' END AS verdict FROM ps LEFT JOIN fu USING (symbol)""",
    "hist_buckets": f"WITH {_HIST} SELECT symbol, bucket, le, n, cumulative FROM hs",
    "hist_mean": f"WITH {_GAPS} SELECT symbol, count(*) FILTER (ns >= 0) AS n, CAST(coalesce(sum(ns) FILTER (ns >= 0), 0) AS BIGINT) AS total, count(*) FILTER (ns < 0) AS negative, CAST(CASE WHEN count(*) FILTER (ns >= 0) > 0 THEN sum(ns) FILTER (ns >= 0) // count(*) FILTER (ns >= 0) ELSE 0 END AS BIGINT) AS mean FROM ga GROUP BY symbol",
    "hist_quantile_ns": f"""WITH {_HIST}, {_QUANTILE} SELECT symbol, q, CAST(CASE WHEN total = 0 THEN 0 WHEN le IS NULL THEN largest WHEN n = 0 THEN le
        ELSE lower + floor((le - lower) * ((share * total - (cumulative - n)) / n)) END AS BIGINT) AS value FROM fr""",
    "run_summary": f"""WITH {_GAPS}, {_histogram('ga', TICK_TO_BOOK, '')}, qs(q, share) AS (VALUES ('p50', CAST(0.5 AS DOUBLE)), ('p95', 0.95), ('p99', 0.99)),
        hx AS (SELECT *, sum(n) OVER () AS total, coalesce(lag(le) OVER (ORDER BY bucket), 0) AS lower, max(le) OVER () AS largest FROM hs),
        fr AS (SELECT * FROM hx, qs WHERE cumulative >= share * total OR le IS NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY bucket) = 1),
        v AS (SELECT q, CAST(CASE WHEN total = 0 THEN 0 WHEN le IS NULL THEN largest WHEN n = 0 THEN le ELSE lower + floor((le - lower) * ((share * total - (cumulative - n)) / n)) END AS BIGINT) AS value FROM fr),
        t AS (SELECT count(*) AS n, CAST(sum(ns) // count(*) AS BIGINT) AS mean FROM ga WHERE ns >= 0),
        e AS (SELECT count(*) AS events, max(epoch_us(ts)) - min(epoch_us(ts)) AS us FROM events)
        SELECT events, CAST(CASE WHEN us > 0 THEN events * 1000000 // us ELSE 0 END AS BIGINT) AS per_second, n, mean,
        (SELECT value FROM v WHERE q = 'p50') AS p50, (SELECT value FROM v WHERE q = 'p95') AS p95, (SELECT value FROM v WHERE q = 'p99') AS p99 FROM e, t""",
    "decode_events": f"""WITH {_DECODED} SELECT arrival, CASE WHEN ok THEN CASE WHEN is_trade THEN 'trade' ELSE 'delta' END END AS kind, CASE WHEN ok THEN concat('S', k, '-USDT') END AS symbol,
        CASE WHEN ok THEN us // 1000 * 1000000 END AS exchange_time, CASE WHEN ok AND is_trade THEN user_id % 2 <> 0 END AS is_buy,
        CASE WHEN ok AND is_trade THEN price END AS price, CASE WHEN ok AND is_trade THEN qty END AS qty,
        CASE WHEN ok AND NOT is_trade THEN first_id END AS first_id, CASE WHEN ok AND NOT is_trade THEN last_id END AS last_id,
        CAST(CASE WHEN ok AND NOT is_trade THEN CASE WHEN side = 'B' THEN 1 ELSE 0 END END AS BIGINT) AS bids, CAST(CASE WHEN ok AND NOT is_trade THEN CASE WHEN side = 'A' THEN 1 ELSE 0 END END AS BIGINT) AS asks, decode_error
        FROM (SELECT *, decode_error IS NULL AS ok FROM dc)""",
    "decode_levels": f"WITH {_DECODED} SELECT concat('S', k, '-USDT') AS symbol, arrival, side, price, qty, CAST(0 AS BIGINT) AS pos FROM dc WHERE decode_error IS NULL AND NOT is_trade",
    "decode_damaged": """WITH f AS (SELECT event_id AS id, event_id % 16 AS k, event_id % 32 < 16 AS t, event_id % 3 = 0 AS wrapped FROM events),
        g AS (SELECT *, CASE WHEN t AND k IN (10, 15) OR NOT t AND k = 14 THEN 'unknown type' WHEN t AND (k IN (1, 4, 5, 7) OR k IN (11, 12) AND NOT wrapped) OR NOT t AND k IN (1, 5, 7, 9, 13, 15) THEN 'malformed'
            WHEN t AND k = 14 OR NOT t AND k IN (2, 3, 10, 11) THEN 'syntax' END AS decode_error, t AND k <> 9 AS trade FROM f),
        h AS (SELECT *, decode_error IS NULL AS ok, decode_error IS NULL AND NOT trade AS delta, CASE WHEN t OR k = 6 THEN 0 ELSE 1 END AS n, CASE WHEN t THEN 0 ELSE 1 END AS m FROM g)
        SELECT id AS arrival, CASE WHEN ok THEN CASE WHEN trade THEN 'trade' ELSE 'delta' END END AS kind, CASE WHEN ok THEN 'S1-USDT' END AS symbol, CASE WHEN ok THEN CASE WHEN t AND k = 6 THEN 0 ELSE (id + 1) * 1000000 END END AS exchange_time,
            CASE WHEN ok AND trade THEN k IN (2, 3) END AS is_buy, CASE WHEN ok AND trade THEN id + 100 END AS price, CASE WHEN ok AND trade THEN id + 1 END AS qty,
            CASE WHEN delta THEN CASE WHEN t OR k = 8 THEN 0 ELSE id END END AS first_id, CASE WHEN delta THEN CASE WHEN t THEN 0 ELSE id + 2 END END AS last_id,
            CAST(CASE WHEN delta THEN n END AS BIGINT) AS bids, CAST(CASE WHEN delta THEN m END AS BIGINT) AS asks,
            CASE WHEN delta THEN m * (id + 100) * (id + 1) + n * CASE WHEN k = 4 THEN 200 ELSE (id + 100) * (id + 1) END END AS levels_value, decode_error FROM h""",
    "depth_damaged": """WITH f AS (SELECT event_id AS id, event_id % 12 AS k FROM events),
        g AS (SELECT *, CASE WHEN k IN (1, 4, 8, 9, 11) THEN 'malformed' WHEN k = 2 THEN 'syntax' WHEN k IN (3, 5) THEN 'bad last id' WHEN k = 6 THEN 'too_many_decimals' END AS parse_error FROM f)
        SELECT 'S1-USDT' AS symbol, CASE WHEN parse_error IS NULL THEN id + 1 END AS last_id, CASE WHEN parse_error IS NULL THEN k <> 10 END AS truncated, parse_error,
            CASE WHEN parse_error IS NULL THEN CASE WHEN k = 10 THEN 0 ELSE id + 200 END END AS bid_value, CASE WHEN parse_error IS NULL THEN (id + 100) * 3 END AS ask_value FROM g""",
    "frame_latency": f"WITH {_DECODED}, va AS (SELECT us * 1000 + 5000 - us // 1000 * 1000000 AS ns FROM dc WHERE decode_error IS NULL), {_histogram('va', DECODE, '')} SELECT bucket, le, n, cumulative FROM hs",
    "metric_counters": f"""WITH {_LATCHED}, dc AS (SELECT count(*) AS f, count(*) FILTER ((event_type <> 'purchase' AND arrival % 50 = 49) OR arrival % 70 = 69) AS e FROM lv),
        ct AS (SELECT count(*) AS n, count(*) FILTER (class = 'contiguous') AS a, count(*) FILTER (class = 'stale') AS s, count(*) FILTER (class = 'buffered') AS b, count(*) FILTER (class = 'gapped') AS g FROM la)
        SELECT 'frames' AS family, f AS value FROM dc UNION ALL SELECT 'decode_errors', e FROM dc UNION ALL SELECT 'events', n FROM ct UNION ALL SELECT 'deltas_applied', a FROM ct
        UNION ALL SELECT 'deltas_discarded', s FROM ct UNION ALL SELECT 'deltas_buffered', b FROM ct UNION ALL SELECT 'gaps', g FROM ct""",
    "log_lines": f"""WITH {_DECODED} SELECT arrival, 'INFO' AS level, CASE WHEN is_trade
        THEN concat('{{"msg":"trade","symbol":"S', k, '-USDT","price":"', price // 100, '.', lpad(CAST(price % 100 AS VARCHAR), 2, '0'), '","qty":"', qty, '","side":"', CASE WHEN user_id % 2 <> 0 THEN 'buy' ELSE 'sell' END, '"}}')
        ELSE concat('{{"msg":"book_delta","symbol":"S', k, '-USDT","first_id":', first_id, ',"last_id":', last_id, ',"bids":', CASE WHEN side = 'B' THEN 1 ELSE 0 END, ',"asks":', CASE WHEN side = 'A' THEN 1 ELSE 0 END, '}}') END AS line
        FROM dc WHERE decode_error IS NULL""",
    "snapshot_parse": f"""WITH {_LWW}, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank FROM bk)
        SELECT concat('S', symbol, '-USDT') AS symbol, max(price) AS last_id, count(*) FILTER (side = 'B') >= {SHOWN} OR count(*) FILTER (side = 'A') >= {SHOWN} AS truncated, CAST(NULL AS VARCHAR) AS parse_error,
        CAST(coalesce(sum(price * qty) FILTER (side = 'B'), 0) AS BIGINT) AS bid_value, CAST(coalesce(sum(price * qty) FILTER (side = 'A'), 0) AS BIGINT) AS ask_value FROM rk WHERE rank <= 30 GROUP BY symbol""",
    "fixed_parse": f"""WITH t AS (SELECT event_id, {_TEXT} AS text FROM events),
        p AS (SELECT *, starts_with(text, '-') AS neg, ltrim(text, '-') AS rest FROM t),
        c AS (SELECT *, CASE WHEN contains(rest, '.') THEN split_part(rest, '.', 1) ELSE rest END AS whole, CASE WHEN contains(rest, '.') THEN split_part(rest, '.', 2) ELSE '' END AS frac FROM p),
        d AS (SELECT *, concat(CASE WHEN whole = '' THEN '0' ELSE whole END, rpad(substr(frac, 1, 2), 2, '0')) AS digits, length(frac) > 2 AND regexp_matches(substr(frac, 3), '[^0]') AS beyond FROM c),
        e AS (SELECT *, TRY_CAST(concat(CASE WHEN neg THEN '-' ELSE '' END, digits) AS BIGINT) AS v FROM d),
        f AS (SELECT *, CASE WHEN text IN ('', '-') THEN 'syntax' WHEN beyond THEN 'too_many_decimals' WHEN NOT regexp_full_match(digits, '[0-9]+') THEN 'syntax' WHEN v IS NULL THEN 'overflow' END AS error FROM e)
        SELECT event_id, text, CASE WHEN error IS NULL THEN v END AS value, error FROM f""",
    "fixed_format": """WITH t AS (SELECT event_id, CAST(event_id % 5 AS INT) AS d, event_id % 3 = 0 AND event_id > 0 AS neg, lpad(CAST(event_id AS VARCHAR), CAST(greatest(event_id % 5 + 1, length(CAST(event_id AS VARCHAR))) AS INT), '0') AS s FROM events)
        SELECT event_id, concat(CASE WHEN neg THEN '-' ELSE '' END, CASE WHEN d = 0 THEN s ELSE concat(substr(s, 1, length(s) - d), '.', substr(s, length(s) - d + 1)) END) AS text FROM t""",
    "trade_tape": """SELECT event_id, event_type = 'purchase' AS is_buy, concat(CAST(round(value * 100) AS BIGINT) // 100, '.', lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')) AS price FROM events""",
    "notional_checked": """WITH t AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(round(l_extendedprice * 100) AS HUGEINT) * 100000 AS p, (CAST(l_quantity AS HUGEINT) - 2) * 1000000 AS q FROM lineitem),
        u AS (SELECT *, q < 0 OR p * q > 9223372036854775807 AS overflow FROM t)
        SELECT l_orderkey, l_linenumber, CASE WHEN NOT overflow THEN CAST(p * q AS BIGINT) END AS notional, overflow FROM u""",
    "symbol_normalise": f"WITH {_PAIRS} SELECT n_nationkey, concat(base, '-', quote) AS symbol, replace(concat(base, '-', quote), '-', '') AS raw FROM pr",
    "symbol_validate": f"WITH {_PAIRS} SELECT n_nationkey, CASE WHEN n_nationkey % 5 IN (0, 4) THEN concat(base, '-', quote) END AS symbol FROM pr",
    "fnv_shard": f"WITH {_PAIRS}, s AS (SELECT concat(base, '-', quote) AS symbol FROM pr), h AS (SELECT symbol, {_FNV} AS h FROM s) SELECT symbol, CAST(h % 4 AS BIGINT) AS of_4, CAST(h % 7 AS BIGINT) AS of_7, CAST(h % 64 AS BIGINT) AS of_64 FROM h",
    "size_decimals": "SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 2 WHEN 3 THEN event_id % 8 + 1 ELSE 0 END AS BIGINT) AS decimals FROM events",
    "instrument_parse": f"""WITH {_PAIRS} SELECT concat(base, quote) AS raw, concat(base, '-', quote) AS symbol, CAST(n_nationkey % 6 + 1 AS BIGINT) AS price_decimals,
        CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE CAST(0 AS BIGINT) END AS qty_decimals, CASE WHEN n_nationkey % 5 = 4 THEN 'missing lot size' END AS parse_error FROM pr WHERE n_nationkey % 4 <> 3""",
    "hourly_rotation": "SELECT strftime(make_timestamp(epoch_us(ts) + 5), '%Y-%m-%dT%H') AS hour, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1",
    "drop_oldest_burst": f"WITH {_LEVELS} SELECT symbol, arrival FROM lv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY arrival DESC) <= {CAPACITY}",
    "drop_oldest_counts": f"WITH {_LEVELS} SELECT symbol, least(count(*), {CAPACITY}) AS kept, greatest(count(*) - {CAPACITY}, 0) AS dropped FROM lv GROUP BY symbol",
    "drop_newest_markers": f"""WITH {_LEVELS}, b AS (SELECT arrival, arrival // 1000 AS burst, price, row_number() OVER (PARTITION BY arrival // 1000 ORDER BY arrival) AS r, count(*) OVER (PARTITION BY arrival // 1000) AS n FROM lv)
        SELECT burst, arrival, arrival * 10 AS received_at, CASE WHEN r <= {CAPACITY} THEN price END AS price, CASE WHEN r > {CAPACITY} THEN n - {CAPACITY} END AS dropped FROM b WHERE r <= {CAPACITY + 1}""",
    "snapshot_serve_order": f"WITH {_LEVELS} SELECT symbol, arrival, row_number() OVER (PARTITION BY symbol ORDER BY arrival) AS serve FROM lv",
    "tracker_status_counts": f"WITH {_SNAP} SELECT CAST(symbol AS VARCHAR) AS symbol, CASE class WHEN 'contiguous' THEN 'applied' WHEN 'stale' THEN 'discarded' ELSE class END AS status, count(*) AS n FROM la GROUP BY ALL",
    "tracker_book": f"WITH {_SNAP} SELECT CAST(symbol AS VARCHAR) AS symbol, side, price, qty FROM ab",
    "tracker_resync": f"WITH {_LOSSY} SELECT concat('S', k, '-USDT') AS symbol, status, CAST(n AS BIGINT) AS n FROM lc WHERE n > 0",
    "tracker_resync_book": f"WITH {_LOSSY} SELECT concat('S', k, '-USDT') AS symbol, side, price, qty FROM lb",
    "tracker_counters": f"""WITH {_LOSSY}, fa(family, status) AS (VALUES ('applied', 'applied'), ('discarded', 'discarded'), ('buffered', 'buffered'), ('gapped', 'gapped'), ('refetches', 'refetch'), ('resyncs', 'anchored')),
        bu AS (SELECT lh.k, coalesce(n, 0) AS n FROM lh LEFT JOIN lc ON lh.k = lc.k AND lc.status = 'buffered'),
        va AS (SELECT lh.k, family, coalesce(n, 0) AS value FROM lh CROSS JOIN fa LEFT JOIN lc ON lh.k = lc.k AND lc.status = fa.status UNION ALL SELECT k, 'dropped', greatest(n - {BUFFER}, 0) FROM bu)
        SELECT concat('S', k, '-USDT') AS symbol, NOT dead AS live, local_id AS last_id, CAST(CASE WHEN dead THEN least(bu.n, {BUFFER}) ELSE 0 END AS BIGINT) AS held, family, CAST(value AS BIGINT) AS value FROM va JOIN lh USING (k) JOIN lw USING (k) JOIN bu USING (k)""",
    "tracker_check": f"""WITH {_LOSSY}, al AS (SELECT * FROM (SELECT k, side, price, arg_max(qty, rn) AS qty FROM lp WHERE last_id > position GROUP BY ALL) WHERE qty <> 0),
        fu AS (SELECT k, count(*) AS compared, count(*) FILTER (coalesce(lb.qty, 0) <> coalesce(al.qty, 0)) AS diffs FROM lb FULL JOIN al USING (k, side, price) GROUP BY k)
        SELECT concat('S', k, '-USDT') AS symbol, NOT dead AS live, local_id, sent AS snapshot_id, coalesce(compared, 0) AS compared, coalesce(diffs, 0) AS diffs, sent - local_id AS id_skew,
        CASE WHEN dead THEN 'skipped' WHEN coalesce(diffs, 0) = 0 THEN 'ok' WHEN sent <> local_id THEN 'skewed' ELSE 'diverged' END AS verdict FROM lh JOIN lw USING (k) LEFT JOIN fu USING (k)""",
    "replay_dump": f"""WITH {_SNAP}, ps AS (SELECT symbol, count(*) FILTER (class = 'gapped') = 0 AS live, greatest(max(anchor), max(last_id) FILTER (class = 'contiguous')) AS last_id FROM la GROUP BY symbol),
        vw AS (SELECT symbol, {_COUNTS}, {_CROSSED} FROM ab GROUP BY symbol),
        li AS (SELECT symbol, 0 AS section, 0 AS spot, concat('symbol ', symbol, ' live=', live, ' last_id=', last_id, ' crossed=', coalesce(crossed, false), ' bids=', coalesce(bids, 0), ' asks=', coalesce(asks, 0)) AS line FROM ps LEFT JOIN vw USING (symbol)
            UNION ALL SELECT symbol, CASE WHEN side = 'B' THEN 1 ELSE 2 END, CASE WHEN side = 'B' THEN -price ELSE price END, concat(side, ' ', price, ' ', qty) FROM ab)
        SELECT CAST(symbol AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY symbol ORDER BY section, spot) AS number, line FROM li""",
    "ohlcv_hourly": """SELECT user_id % 8 AS symbol, epoch_us(ts) // 3600000000 AS hour, arg_min(p, event_id) AS open, max(p) AS high, min(p) AS low, arg_max(p, event_id) AS close, CAST(sum(user_id + 1) AS BIGINT) AS volume, count(*) AS trades
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS p FROM events WHERE event_type = 'purchase') GROUP BY ALL""",
    "asof_quotes": f"""WITH {_LEVELS}, tr AS (SELECT symbol, arrival, CAST(round(value * 100) AS BIGINT) AS price FROM lv JOIN events ON event_id = arrival WHERE lv.event_type = 'purchase'),
        bi AS (SELECT symbol, arrival, price, qty FROM lv WHERE side = 'B')
        SELECT tr.symbol, tr.arrival, tr.price, bi.arrival AS matched_arrival, bi.price AS bid_price, bi.qty AS bid_qty FROM tr ASOF LEFT JOIN bi ON tr.symbol = bi.symbol AND tr.arrival > bi.arrival""",
}
