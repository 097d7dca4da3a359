"""The catalogue's results in DuckDB SQL, written for the same definitions."""

from __future__ import annotations

from stridefold import config

SHORTS, LONGS, LOOKBACKS = config.SHORT_WINDOWS, config.LONG_WINDOWS, config.LOOKBACKS
WINDOWS = sorted({*SHORTS, *LONGS})
PAIRS = [(s, n) for s in SHORTS for n in LONGS if s < n]
YEAR = "sqrt(252.0)"
EQUAL = "CAST('1.000000000001' AS DOUBLE)"  # means that are nearer than this are equal
NAN, INF = "CAST('nan' AS DOUBLE)", "CAST('inf' AS DOUBLE)"
Q, R = 1e-4, 1e-3
X = (Q + (Q * Q + 4 * Q * R) ** 0.5) / 2
STEADY = X / (X + R)


def safe(a: str, b: str, floor: str, other: str) -> str:
    return f"CASE WHEN {b} IS NULL OR {b} < {floor} THEN {other} ELSE ({a}) / ({b}) END"


def sharpe(r: str) -> str:
    return f"(CASE WHEN stddev_samp({r}) IS NULL OR stddev_samp({r}) < 1e-10 THEN 0 ELSE avg({r}) / stddev_samp({r}) END) * {YEAR}"


def sortino(r: str) -> str:
    down = f"sqrt(avg(pow(least({r}, 0), 2)))"
    return f"(CASE WHEN {down} < 1e-10 THEN {INF} ELSE avg({r}) / {down} END) * {YEAR}"


def calmar(r: str, dd: str) -> str:
    return f"CASE WHEN abs(min({dd})) < 1e-10 THEN {INF} ELSE (pow(product(1 + greatest({r}, -0.9999)), 252.0 / count(*)) - 1) / abs(min({dd})) END"


def omega(r: str) -> str:
    return f"CASE WHEN sum(greatest(-{r}, 0)) < 1e-10 THEN {INF} ELSE sum(greatest({r}, 0)) / sum(greatest(-{r}, 0)) END"


def bars(symbol: str = "'IDX'") -> str:
    return f"""
days AS (SELECT {symbol} AS symbol, l_shipdate AS ts, avg(l_extendedprice / l_quantity) AS a, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
zs AS (SELECT *, coalesce((a - avg(a) OVER s) / nullif(stddev_samp(a) OVER s, 0), 0) AS z FROM days WINDOW s AS (PARTITION BY symbol)),
closed AS (SELECT symbol, ts, volume, CAST(row_number() OVER o - 1 AS INTEGER) AS i, round(100 * exp(sum(0.01 * z) OVER o), 6) AS close FROM zs WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
bars AS (SELECT symbol, ts, i, close, round(close * 1.005, 6) AS high, round(close * 0.995, 6) AS low, volume FROM closed),
sized AS (SELECT *, greatest((count(*) OVER (PARTITION BY symbol) - 756) // 252, 0) AS nf FROM bars),
folds AS (SELECT symbol, CAST(unnest(range(max(nf))) AS INTEGER) AS fold FROM sized GROUP BY symbol),
test AS (SELECT symbol, ts, i, close, high, low, CAST((i - 756) // 252 AS INTEGER) AS fold, CAST((i - 756) % 252 AS INTEGER) AS t FROM sized WHERE i >= 756 AND (i - 756) // 252 < nf),
train AS (SELECT b.symbol, b.ts, b.i, b.close, f.fold, b.i - f.fold * 252 AS j FROM bars b JOIN folds f ON b.symbol = f.symbol AND b.i >= f.fold * 252 AND b.i < f.fold * 252 + 756),
mean AS (SELECT symbol, ts, i, close, lead(close) OVER o / close - 1 AS nxt, {", ".join(f"avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in WINDOWS)} FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY i)),
nexts AS (SELECT symbol, i, (lead(close) OVER (PARTITION BY symbol ORDER BY i) - close) / close AS nxt FROM bars)"""


def ruled(short: int = 50, long: int = 200, name: str = "") -> str:
    """Test signals of a fixed pair."""
    return f"""
up{name} AS (SELECT symbol, i, m{short} > m{long} * {EQUAL} AS up, lag(m{short} > m{long} * {EQUAL}) OVER (PARTITION BY symbol ORDER BY i) AS was FROM mean),
sig{name} AS (SELECT t.symbol, t.fold, t.t, t.ts, t.close, t.high, t.low, CASE WHEN t.t = 0 THEN (CASE WHEN up THEN 1 WHEN was THEN -1 ELSE 0 END) ELSE CAST(up AS INTEGER) - CAST(was AS INTEGER) END AS sig FROM test t JOIN up{name} u ON t.symbol = u.symbol AND t.i = u.i)"""


def run(configs: list[tuple[float, float]], delay: int = 1, sig: str = "sig", name: str = "") -> str:
    """Execution of the signals under (cost, slippage) pairs."""
    rows = ", ".join(f"({i}, CAST({c!r} AS DOUBLE), CAST({s!r} AS DOUBLE))" for i, (c, s) in enumerate(configs))
    late = f"coalesce(lag(sig, {delay}) OVER w, 0)" if delay else "sig"
    return f"""
cfg{name}(cfg_id, cost, slippage) AS (VALUES {rows}),
late{name} AS (SELECT *, {late} AS ds FROM {sig} WINDOW w AS (PARTITION BY symbol, fold ORDER BY t)),
held{name} AS (SELECT *, coalesce(last_value(nullif(ds, 0) IGNORE NULLS) OVER (PARTITION BY symbol, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS pos FROM late{name}),
filled{name} AS (SELECT h.*, c.*, close + slippage * (high - low) AS buy, close - slippage * (high - low) AS sell, coalesce(lag(pos) OVER w, false) AS had, lead(1) OVER w IS NULL AS last FROM held{name} h, cfg{name} c WINDOW w AS (PARTITION BY symbol, fold, cfg_id ORDER BY t)),
legs{name} AS (SELECT *, last_value(CASE WHEN pos AND NOT had THEN buy END IGNORE NULLS) OVER w AS ef, sum(CASE WHEN pos AND NOT had THEN 1 ELSE 0 END) OVER w AS trade FROM filled{name} WINDOW w AS (PARTITION BY symbol, fold, cfg_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
based{name} AS (SELECT *, 100000 * product(CASE WHEN had AND NOT pos THEN sell * (1 - cost) / (ef * (1 + cost)) ELSE 1 END) OVER (PARTITION BY symbol, fold, cfg_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size FROM legs{name}),
eq{name} AS (SELECT *, CASE WHEN pos AND last THEN size * sell * (1 - cost) / (ef * (1 + cost)) WHEN pos THEN size * close / (ef * (1 + cost)) ELSE size END AS equity FROM based{name}),
ret{name} AS (SELECT symbol, fold, cfg_id, t, r FROM (SELECT symbol, fold, cfg_id, t, equity / lag(equity) OVER (PARTITION BY symbol, fold, cfg_id ORDER BY t) - 1 AS r FROM eq{name}) WHERE r IS NOT NULL),
grown{name} AS (SELECT *, product(1 + r) OVER (PARTITION BY symbol, fold, cfg_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ret{name}),
fallen{name} AS (SELECT *, g / greatest(1, max(g) OVER (PARTITION BY symbol, fold, cfg_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM grown{name}),
measured{name} AS (SELECT symbol, fold, cfg_id, {sharpe("r")} AS sharpe_ratio, {sortino("r")} AS sortino_ratio, min(dd) AS max_drawdown, {calmar("r", "dd")} AS calmar_ratio, {omega("r")} AS omega_ratio FROM fallen{name} GROUP BY ALL),
trips{name} AS (
  SELECT symbol, fold, cfg_id, CAST(trade AS BIGINT) AS trade, min(ts) FILTER (WHERE pos AND NOT had) AS entry_ts, max(ts) FILTER (WHERE (had AND NOT pos) OR (pos AND last)) AS exit_ts,
         max(buy) FILTER (WHERE pos AND NOT had) AS entry_price, max(sell) FILTER (WHERE (had AND NOT pos) OR (pos AND last)) AS exit_price, max(size) FILTER (WHERE pos AND NOT had) AS cash, max(cost) AS cost
  FROM based{name} WHERE pos OR had GROUP BY symbol, fold, cfg_id, trade),
trades{name} AS (SELECT *, cash / ((1 + cost) * entry_price) AS shares, cash / ((1 + cost) * entry_price) * (entry_price + exit_price) * cost AS transaction_costs, cash / ((1 + cost) * entry_price) * (exit_price * (1 - cost) - entry_price * (1 + cost)) AS pnl FROM trips{name}),
tm{name} AS (
  SELECT symbol, fold, cfg_id, CAST(count(*) AS INTEGER) AS trade_count, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
         CASE WHEN count(*) FILTER (WHERE pnl > 0) = 0 THEN 0 WHEN count(*) FILTER (WHERE pnl < 0) = 0 THEN {INF} ELSE avg(pnl) FILTER (WHERE pnl > 0) / abs(avg(pnl) FILTER (WHERE pnl < 0)) END AS avg_win_loss_ratio,
         avg(CAST(date_diff('day', CAST(entry_ts AS DATE), CAST(exit_ts AS DATE)) AS DOUBLE)) AS avg_holding_days
  FROM trades{name} GROUP BY symbol, fold, cfg_id),
exposed{name} AS (SELECT symbol, fold, cfg_id, avg(CASE WHEN pos OR had THEN 1.0 ELSE 0.0 END) AS exposure_fraction FROM eq{name} GROUP BY symbol, fold, cfg_id),
wm{name} AS (
  SELECT e.symbol, e.fold, e.cfg_id, CASE WHEN trade_count IS NULL THEN 0 ELSE sharpe_ratio END AS sharpe_ratio, CASE WHEN trade_count IS NULL THEN 0 ELSE sortino_ratio END AS sortino_ratio,
         CASE WHEN trade_count IS NULL THEN 0 ELSE max_drawdown END AS max_drawdown, CASE WHEN trade_count IS NULL THEN {NAN} ELSE calmar_ratio END AS calmar_ratio, CASE WHEN trade_count IS NULL THEN {NAN} ELSE omega_ratio END AS omega_ratio,
         CASE WHEN trade_count IS NULL THEN 0 ELSE exposure_fraction END AS exposure_fraction, coalesce(win_rate, {NAN}) AS win_rate, coalesce(avg_win_loss_ratio, {NAN}) AS avg_win_loss_ratio, coalesce(avg_holding_days, {NAN}) AS avg_holding_days,
         coalesce(trade_count, 0) AS trade_count, trade_count IS NULL AS flat
  FROM exposed{name} e LEFT JOIN measured{name} m USING (symbol, fold, cfg_id) LEFT JOIN tm{name} USING (symbol, fold, cfg_id))"""


#: Buy and hold at the standard cost and 5 % slippage.
HOLD = f"""
bhx AS (SELECT symbol, fold, t, close, high - low AS spread, lead(close) OVER w AS nx, lead(high - low) OVER w AS nspread, lag(1) OVER w IS NULL AS first, lead(1, 2) OVER w IS NULL AS last FROM test WINDOW w AS (PARTITION BY symbol, fold ORDER BY t)),
bh AS (SELECT symbol, fold, t, (nx - close) / close - CASE WHEN first THEN 0.001 + 0.05 * spread / greatest(close, 1e-10) ELSE 0 END - CASE WHEN last THEN 0.001 + 0.05 * nspread / greatest(nx, 1e-10) ELSE 0 END AS r FROM bhx WHERE nx IS NOT NULL),
bhg AS (SELECT *, product(1 + r) OVER (PARTITION BY symbol, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM bh),
bhd AS (SELECT *, g / greatest(1, max(g) OVER (PARTITION BY symbol, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM bhg),
bhw AS (SELECT symbol, fold, {sharpe("r")} AS bh_sharpe, {sortino("r")} AS bh_sortino, min(dd) AS bh_max_drawdown FROM bhd GROUP BY symbol, fold)"""

#: The moving-average grid: indicator of each pair by bar, Sharpe on training parts, winners.
MA_GRID = f"""
cands(cand_id, s, l) AS (VALUES {", ".join(f"({i}, {s}, {n})" for i, (s, n) in enumerate(PAIRS))}),
long AS (UNPIVOT (SELECT symbol, i, {", ".join(f"m{n}" for n in WINDOWS)} FROM mean) ON {", ".join(f"m{n}" for n in WINDOWS)} INTO NAME w VALUE m),
lm AS (SELECT symbol, i, CAST(substr(w, 2) AS INTEGER) AS l, m FROM long),
state AS (SELECT c.cand_id, c.s, c.l, a.symbol, a.i, a.m > b.m * {EQUAL} AS up FROM cands c JOIN lm a ON a.l = c.s JOIN lm b ON b.l = c.l AND b.i = a.i AND b.symbol = a.symbol),
grid AS (SELECT t.symbol, t.fold, s.cand_id, {sharpe("CASE WHEN t.j >= s.l - 1 AND s.up THEN n.nxt ELSE 0 END")} AS sharpe FROM train t JOIN state s USING (symbol, i) JOIN nexts n USING (symbol, i) WHERE t.j < 755 GROUP BY t.symbol, t.fold, s.cand_id),
best AS (SELECT * FROM grid JOIN cands USING (cand_id) QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY round(sharpe, 12) DESC, cand_id) = 1)"""

MOMENTUM_GRID = f"""
looks(cand_id, lb) AS (VALUES {", ".join(f"({i}, {n})" for i, n in enumerate(LOOKBACKS))}),
mom AS (SELECT l.cand_id, l.lb, b.symbol, b.i, coalesce(ln(greatest(b.close, 1e-10)) - ln(greatest(p.close, 1e-10)) > 0, false) AS up FROM bars b CROSS JOIN looks l LEFT JOIN bars p ON p.symbol = b.symbol AND p.i = b.i - l.lb),
mgrid AS (SELECT t.symbol, t.fold, s.cand_id, {sharpe("CASE WHEN t.j >= s.lb AND s.up THEN n.nxt ELSE 0 END")} AS sharpe FROM train t JOIN mom s USING (symbol, i) JOIN nexts n USING (symbol, i) WHERE t.j < 755 GROUP BY t.symbol, t.fold, s.cand_id),
mbest AS (SELECT * FROM mgrid JOIN looks USING (cand_id) QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY round(sharpe, 12) DESC, cand_id) = 1),
mrows AS (
  SELECT m.symbol, f.fold, m.cand_id, m.lb, m.i - 756 - f.fold * 252 AS t, m.i, m.up, b.lb AS ctx FROM mom m JOIN folds f ON f.symbol = m.symbol AND m.i >= 755 + f.fold * 252 AND m.i < 756 + f.fold * 252 + 252
  JOIN mbest b ON b.symbol = m.symbol AND b.fold = f.fold),
mpos AS (SELECT *, min(CASE WHEN NOT up THEN t END) OVER (PARTITION BY symbol, fold, cand_id) AS flat_at FROM mrows),
mcand AS (
  SELECT p.symbol, p.fold, p.cand_id, p.t, CASE WHEN up AND p.t >= lb - ctx AND NOT (lb < ctx AND (flat_at IS NULL OR p.t < flat_at)) THEN n.nxt ELSE 0 END AS r
  FROM mpos p JOIN nexts n USING (symbol, i) WHERE p.t >= 0 AND p.t < 251)"""


def tail(half: str, k: str) -> str:
    """The chi-squared tail of 2k degrees at 2 * half; small statistics need no log space."""
    return f"(SELECT least(1.0, exp(-{half}) * sum(pow({half}, i) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE))) FROM range(0, {k}) r(i))"


def hashed(blocks: str, periods: str) -> str:
    """Block starts of all resamples; ``blocks`` and ``periods`` are SQL."""
    return f"starts AS (SELECT CAST(b AS INTEGER) AS boot, CAST(k AS INTEGER) AS block, CAST(CAST('0x' || substr(md5(b || '_' || k), 1, 8) AS BIGINT) % {periods} AS INTEGER) AS start FROM range({config.RESAMPLES}) x(b), range(CAST({blocks} AS BIGINT)) y(k))"


def with_(*parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n" + body


def check(active: bool) -> str:
    """All periods of a run in one ring; blocks of the root of their number, the last one cut, summed by prefix sums."""
    x, periods, size = ("c.r - b.r" if active else "c.r"), "(SELECT periods FROM np)", "(SELECT size FROM np)"
    return with_(
        bars(), HOLD, MOMENTUM_GRID,
        f"cx AS MATERIALIZED (SELECT c.symbol, c.cand_id, {x} AS x, CAST(row_number() OVER (PARTITION BY c.symbol, c.cand_id ORDER BY c.fold, c.t) - 1 AS INTEGER) AS k FROM mcand c JOIN bh b USING (symbol, fold, t))",
        "np AS MATERIALIZED (SELECT max(k) + 1 AS periods, CAST(floor(sqrt(max(k) + 1)) AS INTEGER) AS size FROM cx)",
        hashed(f"ceil({periods} / {size})", periods),
        f"ring AS (SELECT symbol, cand_id, k, x FROM cx UNION ALL SELECT symbol, cand_id, k + {periods}, x FROM cx)",
        "upto AS MATERIALIZED (SELECT symbol, cand_id, k + 1 AS k, sum(x) OVER (PARTITION BY symbol, cand_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM ring UNION ALL SELECT DISTINCT symbol, cand_id, 0, 0.0 FROM cx)",
        f"ends AS (SELECT boot, start, start + least({size}, {periods} - block * {size}) AS stop FROM starts)",
        f"bm AS (SELECT a.symbol, a.cand_id, e.boot, sum(z.s - a.s) / {periods} AS boot_mean FROM ends e JOIN upto a ON a.k = e.start JOIN upto z ON z.k = e.stop AND z.symbol = a.symbol AND z.cand_id = a.cand_id GROUP BY ALL)",
        "own AS (SELECT symbol, cand_id, avg(x) AS mean FROM cx GROUP BY ALL)",
        "top AS (SELECT symbol, max(mean) AS observed FROM own GROUP BY symbol)",
        "stat AS (SELECT symbol, boot, max(boot_mean - mean) AS stat FROM bm JOIN own USING (symbol, cand_id) GROUP BY ALL)",
        body="SELECT symbol, avg(CASE WHEN stat >= observed THEN 1.0 ELSE 0.0 END) AS p FROM stat JOIN top USING (symbol) GROUP BY symbol",
    )


STANDARD = [(0.001, 0.05)]
SWEEP = [(c, s) for c in config.SWEEP_COSTS for s in config.SWEEP_SLIPPAGES]
BASE, RUN = (bars(), ruled()), (bars(), ruled(), run(STANDARD))
MULTI = (bars("'S' || CAST(l_suppkey % 4 AS VARCHAR)"), ruled(), run(STANDARD))
CHAIN = """
seg AS (SELECT symbol, fold, t, ts, equity / first_value(equity) OVER w AS within, last_value(equity) OVER w / first_value(equity) OVER w AS growth FROM eq WINDOW w AS (PARTITION BY symbol, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
reach AS (SELECT symbol, fold, coalesce(product(growth) OVER (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS reached FROM seg WHERE t = 0),
curve AS (SELECT s.symbol, s.ts, s.fold, 100000 * reached * within AS equity FROM seg s JOIN reach USING (symbol, fold))"""
HOLD_CHAIN = """
hseg AS (SELECT symbol, fold, t, ts, close / first_value(close) OVER w AS within, last_value(close) OVER w / first_value(close) OVER w AS growth FROM test WINDOW w AS (PARTITION BY symbol, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hreach AS (SELECT symbol, fold, coalesce(product(growth) OVER (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS reached FROM hseg WHERE t = 0),
hcurve AS (SELECT s.symbol, s.ts, 100000 * reached * within AS bh_equity FROM hseg s JOIN hreach USING (symbol, fold))"""
COMPARE = "both_ AS (SELECT w.symbol, w.fold, w.sharpe_ratio, b.bh_sharpe, w.sharpe_ratio - b.bh_sharpe AS diff FROM wm w JOIN bhw b USING (symbol, fold))"
KALMAN = f"""
ks AS (SELECT b.symbol, f.fold, b.i - 756 - f.fold * 252 AS t, CAST(b.i - 706 - f.fold * 252 AS INTEGER) AS k, ln(b.close) AS y FROM bars b JOIN folds f ON b.symbol = f.symbol AND b.i >= 706 + f.fold * 252 AND b.i < 1008 + f.fold * 252),
kf AS (
  SELECT symbol, fold, 0 AS k, y AS m, (1 - (1 + {Q}) / (1 + {Q} + {R})) * (1 + {Q}) AS p FROM ks WHERE k = 0
  UNION ALL
  SELECT f.symbol, f.fold, s.k, f.m + (CASE WHEN s.k < 50 THEN (f.p + {Q}) / (f.p + {Q} + {R}) ELSE {STEADY!r} END) * (s.y - f.m),
         (1 - (CASE WHEN s.k < 50 THEN (f.p + {Q}) / (f.p + {Q} + {R}) ELSE {STEADY!r} END)) * (f.p + {Q})
  FROM kf f JOIN ks s ON s.symbol = f.symbol AND s.fold = f.fold AND s.k = f.k + 1)"""
LOGLIK = f"""
ls AS (SELECT symbol, fold, CAST(j AS INTEGER) AS k, ln(close) AS y FROM train),
lf AS (
  SELECT symbol, fold, -1 AS k, y AS m, CAST(1 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll FROM ls WHERE k = 0
  UNION ALL
  SELECT f.symbol, f.fold, s.k, f.m + (f.p + {Q}) / (f.p + {Q} + {R}) * (s.y - f.m), (1 - (f.p + {Q}) / (f.p + {Q} + {R})) * (f.p + {Q}),
         f.ll - 0.5 * (ln(2 * pi() * (f.p + {Q} + {R})) + (s.y - f.m) * (s.y - f.m) / (f.p + {Q} + {R}))
  FROM lf f JOIN ls s ON s.symbol = f.symbol AND s.fold = f.fold AND s.k = f.k + 1)"""
MEASURES = ("sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "omega_ratio")
WINDOW_COLUMNS = (*MEASURES, "exposure_fraction", "win_rate", "avg_win_loss_ratio", "avg_holding_days")
MEANS = ("sharpe_ratio", "sortino_ratio", "omega_ratio", "exposure_fraction", "win_rate", "avg_win_loss_ratio", "avg_holding_days")
RAW = "raw AS (SELECT 'IDX' AS symbol, ts, round(close * 0.99, 6) AS adj_close, close, high, low, volume FROM (SELECT l_shipdate AS ts, round(avg(l_extendedprice / l_quantity), 6) AS close, round(max(l_extendedprice / l_quantity), 6) AS high, round(min(l_extendedprice / l_quantity), 6) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1))"
REPORT = "rep AS (SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (WHERE close IS NULL OR isnan(close)) AS nulls, count(*) FILTER (WHERE close <= 0) AS nonpositive FROM bars GROUP BY symbol)"
P = "round(1 / (1 + exp(sharpe_ratio)), 9)"
RULES3 = [(50, 200), (20, 100), (80, 250)]
T_SERIES = "(SELECT 1 - (2 / pi()) * (atan2(abs(t), sqrt(5)) + sin(atan2(abs(t), sqrt(5))) * (cos(atan2(abs(t), sqrt(5))) + 2.0 / 3.0 * pow(cos(atan2(abs(t), sqrt(5))), 3))))"

SQL: dict[str, str] = {
    "bars_index": with_(bars(), body="SELECT symbol, ts, i, close, high, low, volume FROM bars"),
    "bars_raw_ohlc": with_(RAW, body="SELECT symbol, ts, adj_close, close, high, low, volume FROM raw"),
    "bars_adjusted_clip": with_(
        RAW, "adj AS (SELECT symbol, ts, adj_close AS close, high * (adj_close / close) AS high, low * (adj_close / close) AS low, volume FROM raw)",
        body="SELECT symbol, ts, round(greatest(low, least(high, close)), 6) AS close, round(high, 6) AS high, round(low, 6) AS low, volume FROM adj",
    ),
    "band_gap_report": with_(
        bars(), "off AS (SELECT symbol, CASE WHEN i % 50 = 7 THEN close * 1.01 ELSE close END AS close, high, low FROM bars)",
        body="SELECT symbol, round(max(greatest(low - close, close - high) / close), 8) AS max_gap FROM off WHERE greatest(low - close, close - high) > 0 GROUP BY symbol",
    ),
    "validate_report": with_(
        MULTI[0], REPORT,
        body="SELECT *, CASE WHEN duplicates > 0 THEN duplicates || ' duplicate timestamps' WHEN nulls > 0 THEN nulls || ' null closes' WHEN nonpositive > 0 THEN nonpositive || ' closes not above zero' WHEN n_rows < 2300 THEN n_rows || ' rows, fewer than 2300' END AS reason FROM rep",
    ),
    "validate_skipped": with_(MULTI[0], REPORT, body="SELECT symbol, n_rows || ' rows, fewer than 2500' AS reason FROM rep WHERE n_rows < 2500"),
    "inclusive_end": with_(bars(), body="SELECT symbol, min(ts) AS first, max(ts) AS last, count(*) AS n FROM bars WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-07-01' GROUP BY symbol"),
    "folds_plan": with_(
        bars(),
        body="""SELECT f.symbol, f.fold, f.fold * 252 AS train_lo, f.fold * 252 + 756 AS test_lo, f.fold * 252 + 1008 AS test_hi, max(ts) FILTER (WHERE i = f.fold * 252) AS train_start, max(ts) FILTER (WHERE i = f.fold * 252 + 755) AS train_end,
max(ts) FILTER (WHERE i = f.fold * 252 + 756) AS test_start, max(ts) FILTER (WHERE i = f.fold * 252 + 1007) AS test_end FROM folds f JOIN bars b ON b.symbol = f.symbol GROUP BY f.symbol, f.fold""",
    ),
    "fold_membership_train": with_(bars(), body="SELECT symbol, fold, count(*) AS n, min(i) AS lo, max(i) AS hi, CAST(sum(j) AS BIGINT) AS sum_j FROM train GROUP BY symbol, fold"),
    "fold_membership_test": with_(bars(), body="SELECT symbol, i, fold, t FROM test"),
    "fold_context": with_(bars(), body="SELECT b.symbol, f.fold, count(*) AS n, min(b.i - 756 - f.fold * 252) AS lo, max(b.i - 756 - f.fold * 252) AS hi, min(b.i) AS first_i FROM bars b JOIN folds f ON b.symbol = f.symbol AND b.i >= 456 + f.fold * 252 AND b.i < 1008 + f.fold * 252 GROUP BY b.symbol, f.fold"),
    "rolling_ma": with_(bars(), body="SELECT symbol, i, " + ", ".join(f"round(m{n}, 9) AS m{n}" for n in (20, 50, 100, 200, 250)) + " FROM mean WHERE i >= 249"),
    "ma_signals": with_(
        bars(), "u AS (SELECT symbol, i, CAST(i >= 199 AND m50 > m200 AS INTEGER) AS up FROM mean)", "x AS (SELECT symbol, i, up - coalesce(lag(up) OVER (PARTITION BY symbol ORDER BY i), up) AS sig FROM u)",
        body="SELECT symbol, i, sig FROM x WHERE sig <> 0",
    ),
    "ma_carryover_signals": with_(*BASE, body="SELECT symbol, fold, t, sig FROM sig WHERE sig <> 0 OR t = 0"),
    "momentum_signals": with_(
        bars(), "m AS (SELECT symbol, i, coalesce(ln(greatest(close, 1e-10)) - lag(ln(greatest(close, 1e-10)), 60) OVER (PARTITION BY symbol ORDER BY i) > 0, false) AS up FROM bars)",
        "mm AS (SELECT *, lag(up) OVER (PARTITION BY symbol ORDER BY i) AS was FROM m)",
        "ms AS (SELECT t.symbol, t.fold, t.t, CASE WHEN t.t = 0 THEN CAST(up AS INTEGER) ELSE CAST(up AS INTEGER) - CAST(was AS INTEGER) END AS sig FROM test t JOIN mm USING (symbol, i))",
        body="SELECT symbol, fold, t, sig FROM ms WHERE sig <> 0",
    ),
    "momentum_candidates": with_(bars(), MOMENTUM_GRID, body="SELECT symbol, fold, cand_id, round(sum(r), 9) AS total, count(*) FILTER (WHERE r <> 0) AS held FROM mcand GROUP BY symbol, fold, cand_id"),
    "ma_candidates": with_(
        bars(), MA_GRID,
        "mc AS (SELECT t.symbol, t.fold, s.cand_id, t.t, CASE WHEN t.t >= s.l - 1 - (b.l + 1) AND s.up THEN n.nxt ELSE 0 END AS r FROM test t JOIN state s USING (symbol, i) JOIN nexts n USING (symbol, i) JOIN best b ON b.symbol = t.symbol AND b.fold = t.fold WHERE t.t < 251)",
        body="SELECT symbol, fold, cand_id, round(sum(r), 9) AS total, count(*) FILTER (WHERE r <> 0) AS held FROM mc GROUP BY symbol, fold, cand_id",
    ),
    "ma_grid_sharpe": with_(bars(), MA_GRID, body="SELECT symbol, fold, cand_id, round(sharpe, 8) AS sharpe FROM grid"),
    "ma_best_params": with_(bars(), MA_GRID, body="SELECT symbol, fold, s AS short_window, l AS long_window, 'MA(' || s || '/' || l || ')' AS label, round(sharpe, 8) AS sharpe FROM best"),
    "momentum_best_params": with_(bars(), MOMENTUM_GRID, body="SELECT symbol, fold, lb AS lookback, 'MOM(' || lb || ')' AS label, round(sharpe, 8) AS sharpe FROM mbest"),
    "signal_returns": with_(
        *BASE, "h AS (SELECT *, coalesce(last_value(nullif(sig, 0) IGNORE NULLS) OVER w, 0) = 1 AS pos, lead(close) OVER (PARTITION BY symbol, fold ORDER BY t) AS nx FROM sig WINDOW w AS (PARTITION BY symbol, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        body="SELECT symbol, fold, t, round(CASE WHEN pos THEN (nx - close) / close ELSE 0 END, 9) AS r FROM h WHERE nx IS NOT NULL",
    ),
    "delayed_signals": with_(
        *BASE, "l AS (SELECT *, coalesce(lag(sig, 2) OVER (PARTITION BY symbol, fold ORDER BY t), 0) AS late FROM sig)",
        "h AS (SELECT *, CAST(coalesce(last_value(nullif(late, 0) IGNORE NULLS) OVER (PARTITION BY symbol, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS INTEGER) AS position FROM l)",
        body='SELECT symbol, fold, t, late, "position" FROM h WHERE late <> 0 OR "position" = 1',
    ),
    "signal_domain": with_(*BASE, "s2 AS (SELECT symbol, fold, CASE WHEN t % 100 = 3 THEN 2 WHEN t % 100 = 5 THEN NULL ELSE sig END AS sig FROM sig)", body="SELECT symbol, fold, count(*) AS bad FROM s2 WHERE sig IS NULL OR sig NOT IN (-1, 0, 1) GROUP BY symbol, fold"),
    "execution_equity": with_(*RUN, body="SELECT symbol, fold, t, round(equity, 5) AS equity FROM eq"),
    "execution_baseline": with_(*BASE, run([(0.001, 0.0)], 0), body="SELECT symbol, fold, t, round(equity, 5) AS equity FROM eq"),
    "trade_list": with_(*RUN, body="SELECT symbol, fold, trade, entry_ts, exit_ts, round(entry_price, 5) AS entry_price, round(exit_price, 5) AS exit_price, round(shares, 5) AS shares, round(transaction_costs, 5) AS transaction_costs, round(pnl, 5) AS pnl FROM trades"),
    "trade_diagnostics": with_(*RUN, body="SELECT symbol, fold, trade_count, round(win_rate, 8) AS win_rate, round(avg_win_loss_ratio, 8) AS avg_win_loss_ratio, round(avg_holding_days, 8) AS avg_holding_days FROM tm"),
    "exposure": with_(*RUN, body="SELECT symbol, fold, round(exposure_fraction, 9) AS exposure_fraction FROM exposed"),
    **{m: with_(*RUN, body=f"SELECT symbol, fold, round({m}, 8) AS {m} FROM measured") for m in MEASURES},
    "window_metrics": with_(*RUN, body="SELECT symbol, fold, " + ", ".join(f"round({m}, 8) AS {m}" for m in WINDOW_COLUMNS) + ", trade_count FROM wm"),
    "flat_cash_windows": with_(*RUN, body="SELECT symbol, count(*) AS flat_cash_window_count FROM wm WHERE flat GROUP BY symbol UNION ALL SELECT symbol, count(*) FROM wm GROUP BY symbol"),
    "summary_means": with_(*RUN, body="SELECT symbol, " + ", ".join(f"round(coalesce(avg({m}) FILTER (WHERE isfinite({m})), {NAN}), 8) AS {m}" for m in MEANS) + ", round(min(max_drawdown), 8) AS max_drawdown, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM wm GROUP BY symbol"),
    "calmar_stitched": with_(
        *RUN, "sg AS (SELECT symbol, fold, t, r, product(1 + r) OVER (PARTITION BY symbol ORDER BY fold, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ret)",
        "sd AS (SELECT *, g / greatest(1, max(g) OVER (PARTITION BY symbol ORDER BY fold, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM sg)", body=f"SELECT symbol, round({calmar('r', 'dd')}, 8) AS calmar_ratio FROM sd GROUP BY symbol",
    ),
    "fisher_p": with_(*RUN, f"fp AS (SELECT symbol, -sum(ln(least(greatest({P}, 1e-300), 1 - 1e-10))) AS half, count(*) AS k FROM wm GROUP BY symbol)", body=f"SELECT symbol, round({tail('half', 'k')}, 9) AS fisher_p FROM fp"),
    "candidate_matrix_means": with_(bars(), MOMENTUM_GRID, body="SELECT symbol, cand_id, CAST(count(*) AS INTEGER) AS n_periods, round(avg(r), 10) AS mean FROM mcand GROUP BY symbol, cand_id"),
    "rc_common_keys": with_(bars(), MOMENTUM_GRID, "part AS (SELECT * FROM mcand WHERE NOT (cand_id = 3 AND fold = 2))", body="SELECT symbol, cand_id FROM part p GROUP BY symbol, cand_id HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM part q WHERE q.symbol = p.symbol)"),
    "rc_hash_bootstrap_cash": check(False),
    "rc_hash_bootstrap_bh": check(True),
    "block_bootstrap_hash": with_(
        *RUN, "np AS (SELECT max(t) AS periods, CAST(floor(sqrt(max(t))) AS INTEGER) AS size FROM ret)",
        hashed("(SELECT periods // size + 1 FROM np)", "(SELECT periods FROM np)"),
        f"own AS (SELECT symbol, fold, avg(r) AS m, {sharpe('r')} AS observed FROM ret GROUP BY symbol, fold)",
        "cx AS MATERIALIZED (SELECT r.symbol, r.fold, r.t - 1 AS k, r.r - o.m AS x FROM ret r JOIN own o USING (symbol, fold))",
        "places AS (SELECT boot, (start + o) % (SELECT periods FROM np) AS k FROM starts, range((SELECT size FROM np)) z(o) WHERE block * (SELECT size FROM np) + o < (SELECT periods FROM np))",
        f"bs AS (SELECT c.symbol, c.fold, p.boot, {sharpe('c.x')} AS s FROM places p JOIN cx c ON p.k = c.k GROUP BY ALL)",
        body="SELECT symbol, fold, avg(CASE WHEN s >= observed THEN 1.0 ELSE 0.0 END) AS p FROM bs JOIN own USING (symbol, fold) JOIN wm USING (symbol, fold) WHERE NOT flat GROUP BY symbol, fold",
    ),
    "bh_returns": with_(bars(), HOLD, body="SELECT symbol, fold, t, round(r, 10) AS r FROM bh"),
    "benchmark_window": with_(bars(), HOLD, body="SELECT symbol, fold, round(bh_sharpe, 8) AS bh_sharpe, round(bh_sortino, 8) AS bh_sortino, round(bh_max_drawdown, 8) AS bh_max_drawdown FROM bhw"),
    "information_ratio": with_(*RUN, HOLD, "act AS (SELECT r.symbol, r.r - b.r AS a FROM ret r JOIN bh b ON b.symbol = r.symbol AND b.fold = r.fold AND b.t = r.t - 1)", body=f"SELECT symbol, round({sharpe('a')}, 8) AS information_ratio FROM act GROUP BY symbol"),
    "sharpe_ttest": with_(
        *RUN, HOLD, COMPARE, "ts AS (SELECT symbol, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t, count(*) AS k FROM both_ GROUP BY symbol)",
        body=f"SELECT symbol, round(t, 8) AS sharpe_diff_t_stat, round({T_SERIES}, 8) AS sharpe_diff_p_value FROM ts",
    ),
    "beats_fraction": with_(*RUN, HOLD, COMPARE, body="SELECT symbol, round(avg(CASE WHEN sharpe_ratio > bh_sharpe THEN 1.0 ELSE 0.0 END), 8) AS strategy_beats_benchmark_fraction, round(avg(bh_sharpe), 8) AS benchmark_sharpe FROM both_ GROUP BY symbol"),
    "cost_sweep_sharpe": with_(*BASE, run(SWEEP), body="SELECT symbol, cfg_id, fold, round(sharpe_ratio, 8) AS sharpe_ratio FROM measured"),
    "cost_sweep_equity": with_(*BASE, run(SWEEP), body="SELECT symbol, cfg_id, fold, cost, slippage, round(equity, 5) AS equity FROM eq WHERE last"),
    "cost_heatmap_pivot": with_(
        *BASE, run(SWEEP), body="SELECT symbol, cost, " + ", ".join(f"round(avg(equity) FILTER (WHERE slippage = {s!r}), 4) AS slip_{f'{s:g}'.replace('.', '_')}" for s in config.SWEEP_SLIPPAGES) + " FROM eq WHERE last GROUP BY symbol, cost"
    ),
    "multi_symbol_summary": with_(*MULTI, body="SELECT symbol, round(avg(sharpe_ratio), 8) AS sharpe, round(min(max_drawdown), 8) AS worst, CAST(sum(trade_count) AS BIGINT) AS trade_count, count(*) AS n_folds FROM wm GROUP BY symbol"),
    "verdicts": with_(
        *MULTI, f"fp AS (SELECT symbol, -sum(ln(least(greatest({P}, 1e-300), 1 - 1e-10))) AS half, count(*) AS k, max({P}) AS rc FROM wm GROUP BY symbol)", f"fq AS (SELECT symbol, rc, round({tail('half', 'k')}, 9) AS f FROM fp)",
        body="SELECT symbol, CASE WHEN f < 0.05 AND rc >= 0.05 THEN 'MARGINAL' WHEN f < 0.05 THEN 'SIGNIFICANT' ELSE 'NOT SIGNIFICANT' END AS verdict FROM fq",
    ),
    "best_of_three": with_(
        bars(), *(ruled(s, n, f"_{s}") for s, n in RULES3), *(run(STANDARD, 1, f"sig_{s}", f"_{s}") for s, _ in RULES3),
        "alls AS (" + " UNION ALL ".join(f"SELECT symbol, 'MA({s}/{n})' AS strategy, round(avg(sharpe_ratio), 8) AS sharpe, round(min(max_drawdown), 8) AS drawdown FROM measured_{s} GROUP BY symbol" for s, n in RULES3) + ")",
        "lg AS (SELECT symbol, strategy, 'sharpe' AS metric, sharpe AS value FROM alls UNION ALL SELECT symbol, strategy, 'drawdown', drawdown FROM alls)",
        body="SELECT symbol, metric, strategy, value FROM lg QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY value DESC, strategy) = 1",
    ),
    "equity_chained": with_(*RUN, CHAIN, body="SELECT symbol, ts, fold, round(equity, 5) AS equity FROM curve"),
    "bh_chained": with_(bars(), HOLD_CHAIN, body="SELECT symbol, ts, round(bh_equity, 5) AS bh_equity FROM hcurve"),
    "drawdown_series": with_(*RUN, CHAIN, body="SELECT symbol, ts, round(equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 8) AS drawdown FROM curve"),
    "rolling_sharpe_63": with_(
        bars(), HOLD_CHAIN, "hr AS (SELECT symbol, ts, bh_equity / lag(bh_equity) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM hcurve QUALIFY r IS NOT NULL)",
        "hw AS (SELECT symbol, ts, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s, count(r) OVER w AS n FROM hr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))",
        body=f"SELECT symbol, ts, round(m / s * {YEAR}, 6) AS rolling_sharpe FROM hw WHERE n = 63 AND s > 1e-12",
    ),
    "return_histogram": with_(
        bars(), HOLD, "x AS (SELECT symbol, round(r, 9) AS r FROM bh)", "e AS (SELECT symbol, min(r) AS lo, max(r) AS hi, CAST(least(80, greatest(20, count(*) // 10)) AS INTEGER) AS bins FROM x GROUP BY symbol)",
        body="SELECT symbol, CAST(CASE WHEN hi > lo THEN least(floor((r - lo) / (hi - lo) * bins), bins - 1) ELSE 0 END AS INTEGER) AS bin, count(*) AS n, max(bins) AS bins FROM x JOIN e USING (symbol) GROUP BY 1, 2",
    ),
    "return_moments": with_(
        bars(), HOLD, "x AS (SELECT symbol, round(r, 9) AS r FROM bh)", "m AS (SELECT symbol, avg(r) AS mu, stddev_samp(r) AS sd FROM x GROUP BY symbol)",
        body="SELECT symbol, round(max(mu), 7) AS mean, round(max(sd), 7) AS std, round(avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5), 7) AS skewness, round(avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3, 7) AS excess_kurtosis FROM x JOIN m USING (symbol) GROUP BY symbol",
    ),
    "normal_density": with_(
        bars(), HOLD, "x AS (SELECT symbol, round(r, 9) AS r FROM bh)", "m AS (SELECT symbol, avg(r) AS mu, stddev_samp(r) AS sd, min(r) AS lo, max(r) AS hi FROM x GROUP BY symbol)",
        "pts AS (SELECT symbol, mu, sd, CAST(k AS INTEGER) AS k, lo + (hi - lo) * k / 299 AS x FROM m, range(300) z(k))", body="SELECT symbol, k, round(x, 6) AS x, round(exp(-((x - mu) / sd) * ((x - mu) / sd) / 2) / (sd * sqrt(2 * pi())), 6) AS density FROM pts",
    ),
    "fold_bar_colours": with_(*RUN, HOLD, COMPARE, body="SELECT symbol, fold, CASE WHEN sharpe_ratio >= bh_sharpe THEN 'positive' ELSE 'negative' END AS colour FROM both_"),
    "param_evolution": with_(bars(), MA_GRID, body="SELECT symbol, fold, 'short_window' AS key, CAST(s AS DOUBLE) AS value FROM best UNION ALL SELECT symbol, fold, 'long_window', CAST(l AS DOUBLE) FROM best"),
    "kalman_filter_fixed": with_(bars(), KALMAN, body="SELECT symbol, fold, k - 50 AS t, round(m, 9) AS level FROM kf WHERE k >= 50", recursive=True),
    "kalman_signals_fixed": with_(
        bars(), KALMAN, "ku AS (SELECT symbol, fold, k - 50 AS t, coalesce(m > lag(m) OVER (PARTITION BY symbol, fold ORDER BY k), false) AS up FROM kf)",
        "kw AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY symbol, fold ORDER BY t), up) AS was FROM ku)", "kx AS (SELECT symbol, fold, t, CASE WHEN t = 0 AND up THEN 1 ELSE CAST(up AS INTEGER) - CAST(was AS INTEGER) END AS sig FROM kw)",
        body="SELECT symbol, fold, t, sig FROM kx WHERE t >= 0 AND sig <> 0", recursive=True,
    ),
    "walk_forward_fixed": with_(
        *RUN, HOLD, COMPARE, "sg AS (SELECT symbol, fold, t, r, product(1 + r) OVER (PARTITION BY symbol ORDER BY fold, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ret)",
        "sd AS (SELECT *, g / greatest(1, max(g) OVER (PARTITION BY symbol ORDER BY fold, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM sg)",
        f"st AS (SELECT symbol, round({calmar('r', 'dd')}, 8) AS calmar_ratio FROM sd GROUP BY symbol)",
        "act AS (SELECT r.symbol, r.r - b.r AS a FROM ret r JOIN bh b ON b.symbol = r.symbol AND b.fold = r.fold AND b.t = r.t - 1)",
        f"ir AS (SELECT symbol, round({sharpe('a')}, 8) AS information_ratio FROM act GROUP BY symbol)",
        "bf AS (SELECT symbol, round(avg(CASE WHEN sharpe_ratio > bh_sharpe THEN 1.0 ELSE 0.0 END), 8) AS strategy_beats_benchmark_fraction, round(avg(bh_sharpe), 8) AS benchmark_sharpe FROM both_ GROUP BY symbol)",
        "sm AS (SELECT symbol, " + ", ".join(f"round(coalesce(avg({m}) FILTER (WHERE isfinite({m})), {NAN}), 8) AS {m}" for m in MEANS if m != "avg_win_loss_ratio") + ", round(min(max_drawdown), 8) AS max_drawdown, CAST(sum(trade_count) AS BIGINT) AS trade_count, count(*) AS window_count, CAST(count(*) FILTER (WHERE flat) AS BIGINT) AS flat_cash_window_count FROM wm GROUP BY symbol)",
        body="SELECT * FROM sm JOIN st USING (symbol) JOIN ir USING (symbol) JOIN bf USING (symbol)",
    ),
    "kalman_loglik_fixed": with_(bars(), LOGLIK, body="SELECT symbol, fold, round(ll, 6) AS log_likelihood FROM lf WHERE k = 755", recursive=True),
}
