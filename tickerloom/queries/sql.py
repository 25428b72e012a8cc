"""SQL text shared by the checks: the derived tables and rolling expressions."""

from __future__ import annotations

TRADES = """trades AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS price, l_quantity AS qty, l_extendedprice AS amount,
         row(l_orderkey, l_linenumber, l_extendedprice) AS seq
  FROM lineitem)"""

BARS = TRADES + """,
bars AS (
  SELECT ticker, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / sum(qty) AS vwap
  FROM trades GROUP BY ticker, date)"""

SECTORS = """sectors AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ACTIONS = """actions AS (
  SELECT ticker, date, CASE WHEN n = 100 THEN 'symbol_change' ELSE 'split' END AS action_type,
         CASE n WHEN 200 THEN 2.0 WHEN 300 THEN 0.5 WHEN 400 THEN 3.0 ELSE 1.0 END::DOUBLE AS factor
  FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars)
  WHERE n IN (100, 200, 300, 400))"""

DIVIDENDS = """dividends AS (
  SELECT b.ticker, min(b.date) AS ex_date, any_value(m.mean_close) * 0.005::DOUBLE AS amount
  FROM bars b JOIN (SELECT ticker, avg(close) AS mean_close FROM bars GROUP BY ticker) m ON b.ticker = m.ticker
  GROUP BY b.ticker, date_trunc('quarter', b.date))"""

SPLIT_BARS = """split_bars AS (
  SELECT b.ticker, b.date, b.open / f AS open, b.high / f AS high, b.low / f AS low, b.close / f AS close,
         b.volume * f AS volume, b.vwap
  FROM (SELECT b.*, coalesce((SELECT product(a.factor) FROM actions a
          WHERE a.ticker = b.ticker AND a.date >= b.date AND a.action_type = 'split' AND a.factor > 1), 1.0) AS f
        FROM bars b) b)"""


def dividend_bars(source: str) -> str:
    """Total factor = 1 - sum of amount / previous close, frozen once it is used up."""
    return f"""paid AS (
  SELECT d.ticker, d.ex_date, d.amount / p.close AS term
  FROM dividends d ASOF JOIN {source} p ON d.ticker = p.ticker AND d.ex_date > p.date
  WHERE d.amount > 0 AND p.close > 0),
running AS (SELECT ticker, ex_date, sum(term) OVER (PARTITION BY ticker ORDER BY ex_date DESC) AS s FROM paid),
div_bars AS (
  SELECT b.ticker, b.date, b.open * k AS open, b.high * k AS high, b.low * k AS low, b.close * k AS close,
         b.volume, b.vwap
  FROM (SELECT b.*, 1 - coalesce(
          (SELECT min(s) FROM running p WHERE p.ticker = b.ticker AND p.ex_date >= b.date AND s >= 1),
          (SELECT max(s) FROM running p WHERE p.ticker = b.ticker AND p.ex_date >= b.date), 0.0) AS k
        FROM {source} b) b)"""


SILVER = """silver AS (
  SELECT *, close AS adj_close, 1.0::DOUBLE AS split_factor, 0.0::DOUBLE AS dividend_yield, TRUE AS is_market_date,
         CASE WHEN abs(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) > 0.20 THEN 'suspicious'
              WHEN volume = 0 THEN 'thin' ELSE 'good' END AS data_quality
  FROM div_bars)"""

GOLD = """gold AS (
  SELECT s.*, coalesce(c.sector, 'Unknown') AS sector, a20 AS avg_volume_20d, a60 AS avg_volume_60d,
         CASE WHEN a60 > 0 THEN volume / a60 ELSE 1.0 END AS volume_ratio,
         'mid' AS market_cap_bucket, TRUE AS universe_date
  FROM (SELECT *, CASE WHEN count(volume) OVER w20 >= 20 THEN avg(volume) OVER w20 END AS a20,
               CASE WHEN count(volume) OVER w60 >= 60 THEN avg(volume) OVER w60 END AS a60
        FROM silver
        WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING),
               w60 AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)) s
  LEFT JOIN sectors c ON s.ticker = c.ticker)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


LAKE = ctes(BARS, SECTORS, ACTIONS, DIVIDENDS, SPLIT_BARS, dividend_bars("split_bars"), SILVER, GOLD)


def r(expr: str, digits: int = 6) -> str:
    """Rounded double; the boundary lies just beside the half."""
    return f"floor(CAST({expr} AS DOUBLE) * 1e{digits} + 0.501) / 1e{digits}"


def frame(n: int, keys: str = "ticker", ts: str = "date") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY {ts} ROWS {n - 1} PRECEDING)"


def _guarded(fn: str, x: str, n: int, m: int | None, keys: str, ts: str) -> str:
    f = frame(n, keys, ts)
    return f"(CASE WHEN count({x}) {f} >= {n if m is None else m} THEN {fn}({x}) {f} END)"


def rm(x: str, n: int, m: int | None = None, keys: str = "ticker", ts: str = "date") -> str:
    return _guarded("avg", x, n, m, keys, ts)


def rs(x: str, n: int, m: int | None = None, keys: str = "ticker", ts: str = "date") -> str:
    return _guarded("stddev_samp", x, n, m, keys, ts)


def rv(x: str, n: int, m: int | None = None, keys: str = "ticker", ts: str = "date") -> str:
    return _guarded("var_samp", x, n, m, keys, ts)


def rz(x: str, n: int, m: int | None = None, keys: str = "ticker", ts: str = "date") -> str:
    return f"(({x} - {rm(x, n, m, keys, ts)}) / nullif({rs(x, n, m, keys, ts)}, 0))"


def z60(x: str, keys: str = "ticker", ts: str = "date") -> str:
    return f"tanh({rz(x, 60, 30, keys, ts)})"


def lag(x: str, n: int = 1, keys: str = "ticker", ts: str = "date") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {keys} ORDER BY {ts})"


def pct(x: str, n: int, keys: str = "ticker", ts: str = "date") -> str:
    return f"({x} / nullif({lag(x, n, keys, ts)}, 0) - 1)"


def avg_rank(x: str, keys: str) -> str:
    """Average-tie rank: lowest rank of the value plus half of its other peers."""
    return (
        f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + "
        f"(count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"
    )


def stages(base: str, *steps: dict[str, str]) -> tuple[str, str]:
    """Chained CTEs, each adding columns to the one before; returns (text, last name)."""
    out, prev = [], base
    for i, step in enumerate(steps):
        cols = ", ".join(f"{expr} AS {name}" for name, expr in step.items())
        out.append(f"t{i} AS (SELECT *, {cols} FROM {prev})")
        prev = f"t{i}"
    return ",\n".join(out), prev
