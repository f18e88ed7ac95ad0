"""DuckDB SQL for the analytic queries, put together from shared common table expressions."""

from __future__ import annotations

from ..config import CLASS_STATES, CLASSES, Params
from ..config import TABLES as P

K = P.bins
W = "OVER (PARTITION BY code ORDER BY date)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = tuple(needs.split()), sql


def query(needs: str, sql: str) -> str:
    """WITH all needed expressions, in order, then sql."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs.split():
        visit(n)
    return sql if not order else "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + sql


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


cte("panel", "", "SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS trade_value FROM lineitem GROUP BY 1, 2")
cte("raw0", "panel", f"SELECT *, ln(close) AS p, ln(1 + volume) AS v, ln(1 + trade_value) AS tv FROM panel")
cte("raw1", "raw0", f"SELECT *, p - lag(p) {W} AS r, tv - lag(tv) {W} AS flow FROM raw0")
frame = lambda n, m: f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n} PRECEDING AND {m})"
f20 = frame(P.w_sigma - 1, "CURRENT ROW")
cte("feats", "raw1", f"SELECT *, CASE WHEN count(r) {f20} = {P.w_sigma} THEN stddev_samp(r) {f20} END AS sigma, CASE WHEN count(v) {f20} = {P.w_liq} THEN avg(v) {f20} END AS l FROM raw1")
fz = frame(P.w_z, "1 PRECEDING")
z = ", ".join(f"CASE WHEN count({c}) {fz} = {P.w_z} THEN ({c} - avg({c}) {fz}) / nullif(stddev_samp({c}) {fz}, 0) END AS z_{c}" for c in ("r", "sigma", "v", "flow"))
cte("zs", "feats", f"SELECT *, {z} FROM feats")


def bin_sql(c: str) -> str:
    """Ranks of values to nine digits, as the query takes them: equal volumes give equal scores, whose last bits are chance."""
    a = f"(rank() OVER (PARTITION BY code ORDER BY round(z_{c}, 9) ASC NULLS LAST) - 1)"
    n = f"count(z_{c}) OVER (PARTITION BY code)"
    return f"CASE WHEN z_{c} IS NOT NULL THEN " + " + ".join(f"CASE WHEN ({n} - 1) * {j} < {K} * {a} THEN 1 ELSE 0 END" for j in range(1, K)) + f" END AS bin_{c}"


cte("bins", "zs", "SELECT *, " + ", ".join(bin_sql(c) for c in ("r", "sigma", "v", "flow")) + " FROM zs")
cte("states", "bins", f"SELECT *, CAST(bin_r + {K} * bin_sigma + {K**2} * bin_v + {K**3} * bin_flow AS BIGINT) AS state_id FROM bins WHERE bin_r + bin_sigma + bin_v + bin_flow IS NOT NULL")
cte("fwd", "states", f"SELECT *, lead(r) {W} AS next_r, lead(z_r) {W} AS next_r_z, lead(state_id) {W} AS next_state FROM states")
cte("valid", "fwd", "SELECT * FROM fwd WHERE next_r IS NOT NULL AND next_r_z IS NOT NULL AND next_state IS NOT NULL")
cte("stats", "valid", f"""SELECT s.state_id, coalesce(visits, 0) AS visits, mu_r_raw, sigma_r_raw, mu_r, sigma_r, p_stay,
  s.state_id % {K} AS bin_r, (s.state_id // {K}) % {K} AS bin_sigma, (s.state_id // {K**2}) % {K} AS bin_v, (s.state_id // {K**3}) % {K} AS bin_flow
  FROM (SELECT range AS state_id FROM range({P.states})) s LEFT JOIN (SELECT state_id, count(*) AS visits, avg(next_r) AS mu_r_raw, stddev_samp(next_r) AS sigma_r_raw,
  avg(next_r_z) AS mu_r, stddev_samp(next_r_z) AS sigma_r, avg(CASE WHEN next_state = state_id THEN 1.0 ELSE 0.0 END) AS p_stay FROM valid GROUP BY state_id) g USING (state_id)""")
cte("trans", "valid", "SELECT state_id AS s, next_state AS s_next, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY state_id) AS p FROM valid GROUP BY 1, 2")
cte("ent", "stats trans", f"SELECT stats.*, coalesce(entropy, 0.0) AS entropy FROM stats LEFT JOIN (SELECT s AS state_id, sum(-p * ln(p + {P.eps})) AS entropy FROM trans GROUP BY 1) e USING (state_id)")
cte("cuts", "ent", """SELECT quantile_cont(sigma_r, 0.7) AS q70_sigma, quantile_cont(sigma_r, 0.3) AS q30_sigma, quantile_cont(sigma_r, 0.5) AS med_sigma,
  quantile_cont(abs(mu_r), 0.7) AS q70_mu, quantile_cont(abs(mu_r), 0.5) AS med_mu, quantile_cont(entropy, 0.5) AS med_entropy FROM ent WHERE visits > 0""")
cte("reg", "ent cuts", """SELECT ent.*, CASE WHEN visits = 0 THEN 'UNKNOWN' WHEN sigma_r >= q70_sigma AND entropy >= med_entropy THEN 'SHOCK'
  WHEN abs(mu_r) >= q70_mu AND sigma_r >= med_sigma THEN 'TREND' WHEN sigma_r <= q30_sigma AND abs(mu_r) < med_mu THEN 'RANGE' ELSE 'TRANSITION' END AS regime FROM ent, cuts""")
cte("edge", "reg", """SELECT *, mu_r_raw AS E_raw, mu_r AS E_z, mu_r_raw / nullif(sigma_r_raw, 0) AS E_sharpe_raw, mu_r / nullif(sigma_r, 0) AS E_sharpe_z,
  mu_r_raw * p_stay AS E_stay_raw, mu_r * p_stay AS E_stay_z, mu_r_raw / nullif(sigma_r_raw / sqrt(nullif(visits, 0)), 0) AS t_stat FROM reg""")
cte("lab", "fwd reg", "SELECT fwd.*, reg.regime FROM fwd LEFT JOIN reg USING (state_id)")
REG = ", ".join(f"'{x}'" for x in P.regimes)


def identify(src: str, ret: str, keys: str = "") -> str:
    """State statistics over training rows; mode by count and then name."""
    on = f"USING ({keys}state_id)"
    return f"""SELECT *, coalesce(mu_r > 0 AND visits >= {P.min_visits} AND t_stat >= {P.t_least} AND regime IN ({REG}), false) AS tradeable FROM (
  SELECT g.*, m.regime, mu_r / nullif(sigma_r / sqrt(visits), 0) AS t_stat FROM (SELECT {keys}state_id, count(*) AS visits, avg({ret}) AS mu_r, stddev_samp({ret}) AS sigma_r FROM {src} GROUP BY ALL) g
  LEFT JOIN (SELECT {keys}state_id, regime FROM (SELECT {keys}state_id, regime, row_number() OVER (PARTITION BY {keys}state_id ORDER BY count(*) DESC, regime) AS k FROM {src} WHERE regime IS NOT NULL GROUP BY {keys}state_id, regime) WHERE k = 1) m {on})"""


cte("train1", "lab", f"SELECT * FROM lab WHERE date <= DATE '{P.train_end}' AND next_r IS NOT NULL")
cte("pick1", "train1", identify("train1", "next_r"))
UPTO = "ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
cte("daily1", "lab pick1", f"""SELECT *, product(1 + ret_gross) OVER ({UPTO}) - 1 AS cum_gross, product(1 + ret_net) OVER ({UPTO}) - 1 AS cum_net FROM (
  SELECT date, count(*) AS n_trades, avg(next_r) AS ret_gross, avg(next_r) - {P.cost} AS ret_net, sum(CASE WHEN next_r > 0 THEN 1 ELSE 0 END) AS n_win, sum(next_r) AS sum_gross
  FROM lab WHERE date >= DATE '{P.test_start}' AND next_r IS NOT NULL AND state_id IN (SELECT state_id FROM pick1 WHERE tradeable) GROUP BY date)""")
cte("hor", "lab", f"SELECT *, lead(close, {P.horizon}) {W} / close - 1 AS ret_h, lead(date, {P.horizon}) {W} AS exit_date FROM lab")
cte("trainh", "hor", f"SELECT * FROM hor WHERE ret_h IS NOT NULL AND date <= DATE '{P.train_end}'")
cte("pickh", "trainh", identify("trainh", "ret_h"))
cte("cand", "hor pickh", f"SELECT 0 AS fold, code, date, exit_date, state_id, regime, ret_h FROM hor WHERE ret_h IS NOT NULL AND date >= DATE '{P.test_start}' AND state_id IN (SELECT state_id FROM pickh WHERE tradeable)")


def greedy(src: str) -> str:
    """Each trade leads to the first candidate after its exit."""
    return f"""SELECT fold, code, date, exit_date, state_id, regime, ret_h FROM (SELECT *, row_number() OVER (PARTITION BY fold, code ORDER BY date) AS k FROM {src}) WHERE k = 1
  UNION ALL SELECT c.fold, c.code, c.date, c.exit_date, c.state_id, c.regime, c.ret_h FROM @ t JOIN {src} c ON c.fold = t.fold AND c.code = t.code AND c.date > t.exit_date
  AND c.date = (SELECT min(x.date) FROM {src} x WHERE x.fold = t.fold AND x.code = t.code AND x.date > t.exit_date)"""


cte("trades0", "cand", greedy("cand").replace("@", "trades0"))
cte("trades", "trades0", f"SELECT fold, date AS entry_date, exit_date, code, state_id, regime, ret_h AS ret_gross, ret_h - {P.cost} AS ret_net FROM trades0")
cte("bear", "lab", f"""SELECT date, close, sma, CASE WHEN sma IS NOT NULL THEN CAST(close < sma AS BIGINT) END AS is_bear FROM (SELECT date, close, CASE WHEN count(close) OVER w = {P.sma} THEN avg(close) OVER w END AS sma
  FROM (SELECT date, avg(close) AS close FROM lab GROUP BY date) WINDOW w AS (ORDER BY date ROWS BETWEEN {P.sma - 1} PRECEDING AND CURRENT ROW))""")
cte("candb", "cand bear", "SELECT * FROM cand WHERE date NOT IN (SELECT date FROM bear WHERE is_bear = 1)")
cte("tradesb", "candb", greedy("candb").replace("@", "tradesb"))
cte("retd", "lab", f"SELECT code, date, close / lag(close) {W} - 1 AS ret_d FROM lab")


def path(trades: str, days: str, clamp: bool) -> str:
    inside = f"EXISTS (SELECT 1 FROM {days} x WHERE x.fold = t.fold AND x.date = t.exit_date)"
    last = f"(SELECT max(x.date) FROM {days} x WHERE x.fold = t.fold)"
    exit_date = f"CASE WHEN {inside} THEN t.exit_date ELSE {last} END" if clamp else "t.exit_date"
    return f"""SELECT fold, date, n_active, port_ret, product(1 + port_ret) OVER (PARTITION BY fold {UPTO}) AS equity FROM (
  SELECT d.fold, d.date, coalesce(n, 0) AS n_active, CASE WHEN n > 0 THEN (pnl - {P.cost} * coalesce(exits, 0)) / n ELSE 0.0 END AS port_ret FROM {days} d
  LEFT JOIN (SELECT fold, date, sum(coalesce(ret_d, 0)) AS pnl, count(*) AS n FROM (SELECT t.fold, d.date, rd.ret_d FROM (SELECT t.fold, t.code, t.entry_date, {exit_date} AS exit_date FROM {trades} t WHERE EXISTS (SELECT 1 FROM {days} x WHERE x.fold = t.fold AND x.date = t.entry_date) {'' if clamp else 'AND ' + inside}) t
  JOIN {days} d ON d.fold = t.fold AND d.date > t.entry_date AND d.date <= t.exit_date LEFT JOIN retd rd ON rd.code = t.code AND rd.date = d.date) GROUP BY 1, 2) USING (fold, date)
  LEFT JOIN (SELECT t.fold, {exit_date} AS date, count(*) AS exits FROM {trades} t WHERE EXISTS (SELECT 1 FROM {days} x WHERE x.fold = t.fold AND x.date = t.entry_date) {'' if clamp else 'AND ' + inside} GROUP BY 1, 2) USING (fold, date))"""


cte("days", "lab", f"SELECT DISTINCT 0 AS fold, date FROM lab WHERE date >= DATE '{P.test_start}'")
cte("path", "trades days retd", path("trades", "days", False))


def metrics(path_: str, trades: str, join: str = "") -> str:
    root = f"sqrt({float(P.ann)})"
    return f"""SELECT fold, coalesce(n_trades, 0) AS n_trades, win_rate_net, avg_active, CASE WHEN sd > 0 THEN mu / sd * {root} END AS sharpe, CASE WHEN dn > 1 AND dsd > 0 THEN mu / dsd * {root} END AS sortino, mdd, cagr,
  CASE WHEN mdd < 0 THEN cagr / abs(mdd) END AS calmar, final_equity, coalesce(CASE WHEN sd > 0 THEN mu / sd * {root} END > {P.pass_sharpe} AND mdd > {P.pass_mdd}, false) AS passed FROM (
  SELECT *, CASE WHEN final_equity > 0 AND last > first THEN pow(final_equity, 1 / ((last - first) / 365.25)) - 1 END AS cagr FROM (
  SELECT fold, avg(CASE WHEN n_active > 0 THEN port_ret END) AS mu, stddev_pop(CASE WHEN n_active > 0 THEN port_ret END) AS sd, stddev_pop(CASE WHEN n_active > 0 AND port_ret < 0 THEN port_ret END) AS dsd,
  count(CASE WHEN n_active > 0 AND port_ret < 0 THEN 1 END) AS dn, min(dd) AS mdd, avg(n_active) AS avg_active, min(date) AS first, max(date) AS last, arg_max(equity, date) AS final_equity
  FROM (SELECT *, equity / max(equity) OVER (PARTITION BY fold {UPTO}) - 1 AS dd FROM {path_}) GROUP BY fold)
  {join}JOIN (SELECT fold, count(*) AS n_trades, avg(CASE WHEN ret_net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate_net FROM {trades} GROUP BY fold) USING (fold))"""


cte("folds", "", f"SELECT unnest([{', '.join(map(str, P.folds))}]) AS fold")
cte("trainf", "hor folds", "SELECT fold, hor.* FROM hor, folds WHERE ret_h IS NOT NULL AND date < make_date(fold, 1, 1)")
cte("pickf", "trainf", identify("trainf", "ret_h", "fold, "))
cte("testf", "hor folds", "SELECT fold, hor.* FROM hor, folds WHERE year(date) = fold")
cte("candf", "testf pickf", "SELECT fold, code, date, exit_date, state_id, regime, ret_h FROM testf SEMI JOIN (SELECT fold, state_id FROM pickf WHERE tradeable) USING (fold, state_id) WHERE ret_h IS NOT NULL")
cte("candfb", "candf bear", "SELECT * FROM candf WHERE date NOT IN (SELECT date FROM bear WHERE is_bear = 1)")
cte("daysf", "testf", "SELECT DISTINCT fold, date FROM testf")
for s in ("", "b"):
    cte(f"tradesf{s}0", f"candf{s}", greedy(f"candf{s}").replace("@", f"tradesf{s}0"))
    cte(f"tradesf{s}", f"tradesf{s}0", f"SELECT fold, date AS entry_date, exit_date, code, state_id, regime, ret_h AS ret_gross, ret_h - {P.cost} AS ret_net FROM tradesf{s}0")
    cte(f"pathf{s}", f"tradesf{s} daysf retd", path(f"tradesf{s}", "daysf", True))
    cte(f"metf{s}", f"pathf{s} tradesf{s}", metrics(f"pathf{s}", f"tradesf{s}"))
cte("met", "path trades", metrics("path", "trades", "LEFT "))
cte("equity", "lab", f"""SELECT date, equity_market, equity_market / max(equity_market) OVER ({UPTO}) - 1 AS dd FROM (SELECT date, exp(sum(m) OVER ({UPTO})) AS equity_market FROM (
  SELECT date, coalesce(avg(CASE WHEN day = lday + 1 THEN ln(close) - ln(lclose) END), 0.0) AS m FROM (SELECT *, lag(day) {W} AS lday, lag(close) {W} AS lclose FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS day FROM lab)) GROUP BY date))""")
cte("eqn", "equity", "SELECT *, row_number() OVER (ORDER BY date) AS i FROM equity")


def fsm(name: str, p: Params) -> str:
    step = lambda cur: f"CASE WHEN {cur} IN ('BULL', 'RECOVERY') AND e.dd <= {p.dd_bear} THEN 'BEAR' WHEN {cur} = 'BEAR' AND e.dd >= {p.dd_recover} THEN 'RECOVERY' WHEN {cur} = 'RECOVERY' AND e.dd >= {p.dd_bull} THEN 'BULL' ELSE {cur} END"
    return f"SELECT i, date, dd, {step(chr(39) + 'BULL' + chr(39))} AS regime FROM eqn e WHERE i = 1 UNION ALL SELECT e.i, e.date, e.dd, {step('f.regime')} FROM {name} f JOIN eqn e ON e.i = f.i + 1"


def decomposed(pre: str, p: Params) -> None:
    """Regimes, trades by regime, decomposition, flip map, classes and attribution of the trades in <pre>trades."""
    trades, labels = f"{pre}trades", f"{pre}fsm"
    cte(labels, "eqn", fsm(labels, p))
    cte(f"{pre}mtr", f"{trades} {labels}", f"SELECT {trades}.*, {labels}.regime AS macro_regime FROM {trades} JOIN {labels} ON {labels}.date = {trades}.entry_date")
    cte(f"{pre}dec", f"{pre}mtr", f"SELECT *, mean / (se + {p.eps}) AS t_one_sample FROM (SELECT *, std / sqrt(n) AS se FROM (SELECT state_id, macro_regime, count(*) AS n, avg(ret_net) AS mean, coalesce(stddev_samp(ret_net), 0.0) AS std, sum(ret_net) AS sum FROM {pre}mtr GROUP BY 1, 2))")
    side = lambda x, n: f"SELECT state_id, mean AS mu_{n}, n AS n_{n}, std * std AS s2_{n}, t_one_sample AS t_{n}_pos FROM {pre}dec WHERE macro_regime = '{x}'"
    cte(f"{pre}flip", f"{pre}dec", f"SELECT *, (mu_bull - mu_bear) / (sqrt(s2_bull / n_bull + s2_bear / n_bear) + {p.eps}) AS t_flip, n_bull >= {p.cell_visits} AND n_bear >= {p.cell_visits} AS reliable FROM ({side('BULL', 'bull')}) JOIN ({side('BEAR', 'bear')}) USING (state_id)")
    cte(f"{pre}classes", f"{pre}flip", f"""SELECT state_id, CASE WHEN NOT reliable THEN 'INSUFFICIENT' WHEN t_bull_pos > {p.t_least} AND t_bear_pos > {p.t_least} THEN 'INVARIANT' WHEN t_bull_pos > {p.t_least} AND t_bear_pos < -{p.t_least} THEN 'TRAP'
  WHEN t_bull_pos > {p.t_least} AND abs(t_bear_pos) <= {p.t_least} THEN 'CONDITIONAL' WHEN t_bull_pos <= 0 AND t_bear_pos <= 0 THEN 'DEAD' ELSE 'AMBIGUOUS' END AS state_class FROM {pre}flip""")
    cte(f"{pre}attr", f"{trades} {pre}classes", f"SELECT {trades}.*, coalesce(state_class, 'UNCLASSIFIED') AS state_class FROM {trades} LEFT JOIN {pre}classes USING (state_id)")


decomposed("", P)
cte("ctrades", "valid reg", f"SELECT date AS entry_date, code, state_id % {CLASS_STATES} AS state_id, regime, next_r AS ret_gross, next_r - {P.cost} AS ret_net FROM valid JOIN reg USING (state_id)")
decomposed("c", CLASSES)
cte("drift", "fwd fsm", "SELECT regime, state_id, next_state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY regime, state_id) AS P FROM fwd JOIN fsm USING (date) WHERE next_state IS NOT NULL GROUP BY 1, 2, 3")
cte("klm", "drift", "SELECT state_id, next_state, coalesce(a.P, 0.0) AS pb, coalesce(b.n, 0) AS ne FROM (SELECT * FROM drift WHERE regime = 'BULL') a FULL JOIN (SELECT * FROM drift WHERE regime = 'BEAR') b USING (state_id, next_state)")
cte("kl", "klm", f"""SELECT state_id, sum(CASE WHEN pb > 0 THEN pb * ln((pb + {P.eps}) / ((ne + 1) / (total + k) + {P.eps})) ELSE 0.0 END) AS kl_bull_bear
  FROM (SELECT *, sum(ne) OVER (PARTITION BY state_id) AS total, (SELECT count(DISTINCT next_state) FROM klm) AS k FROM klm) GROUP BY 1""")
cte("hid", "states", "SELECT code, date, p, state_id, CASE WHEN day(date) = 1 THEN -1 ELSE state_id % 8 END AS Z_t FROM states")
cte("hp", "hid", f"SELECT * FROM (SELECT *, lead(Z_t) {W} AS z_next, lead(p) {W} - p AS r_t FROM hid) WHERE Z_t <> -1 AND z_next <> -1")
cte("grid", "", "SELECT a.range AS z, b.range AS z_next FROM range(8) a, range(8) b")
cte("hmat", "grid hp", "SELECT z, z_next, c, CASE WHEN sum(c) OVER (PARTITION BY z) > 0 THEN c / sum(c) OVER (PARTITION BY z) ELSE 0.0 END AS t FROM (SELECT z, grid.z_next, coalesce(c, 0) AS c FROM grid LEFT JOIN (SELECT Z_t, z_next, count(*) AS c FROM hp GROUP BY 1, 2) h ON h.Z_t = grid.z AND h.z_next = grid.z_next)")
cte("hes", "hp", "SELECT range AS z, e, coalesce(n, 0) AS n FROM range(8) LEFT JOIN (SELECT Z_t, avg(r_t) AS e, count(*) AS n FROM hp WHERE r_t IS NOT NULL GROUP BY 1) ON Z_t = range")
fl = frame(P.live_window, "1 PRECEDING")
LIVE = ("r", "sigma", "v", "l", "p")
cte("live", "feats", f"SELECT code, date, p, r, sigma, v, l FROM (SELECT code, date, p, r, sigma, v, CASE WHEN count(volume) {f20} = {P.w_liq} THEN avg(volume) {f20} END AS l FROM feats) WHERE r IS NOT NULL AND sigma IS NOT NULL AND l IS NOT NULL")
cte("livez", "live", "SELECT * FROM (SELECT *, " + ", ".join(f"CASE WHEN count({c}) {fl} = {P.live_window} THEN greatest(-{P.z_clip}, least({P.z_clip}, ({c} - avg({c}) {fl}) / (greatest(stddev_samp({c}) {fl}, {P.std_floor}) + {P.live_eps}))) END AS z_{c}" for c in LIVE) + " FROM live) WHERE z_r IS NOT NULL AND z_sigma IS NOT NULL AND z_v IS NOT NULL AND z_l IS NOT NULL AND z_p IS NOT NULL")
cte("livek", "livez", f"SELECT *, row_number() {W} AS k FROM livez")
below = lambda c: f"least({K - 1}, CAST(floor(count(CASE WHEN round(x.z_{c}, 9) < round(a.z_{c}, 9) THEN 1 END) / {float(P.live_window)} * {K}) AS BIGINT))"
cte("lives", "livek", "SELECT *, " + " + ".join(f"z_{c}_bin * {K**i}" for i, c in enumerate(LIVE)) + " AS state_id FROM (SELECT a.code, a.date, " + ", ".join(f"{below(c)} AS z_{c}_bin" for c in LIVE) + f" FROM livek a JOIN livek x ON x.code = a.code AND x.k BETWEEN a.k - {P.live_window} AND a.k - 1 WHERE a.k > {P.live_window} GROUP BY a.code, a.date)")
