"""DuckDB text of the inputs, shared by the oracle queries."""

STAY = """a AS (
  SELECT user_id pid, date_trunc('hour', ts) h,
         avg(CASE WHEN event_type = 'click' THEN value END) click,
         avg(CASE WHEN event_type IN ('view','purchase') THEN value END) engage,
         avg(CASE WHEN event_type = 'signup' THEN value END) signup,
         avg(value) anyv,
         avg(CASE WHEN event_type = 'refund' THEN value END) refund,
         max(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END) hit
  FROM events GROUP BY 1, 2),
stay AS MATERIALIZED (
  SELECT CAST(pid AS BIGINT) pid,
         CAST(row_number() OVER (PARTITION BY pid ORDER BY h) - 1 AS INTEGER) t,
         click, engage, signup, anyv, refund,
         CAST(max(hit) OVER (PARTITION BY pid ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS INTEGER) y
  FROM a)"""

ITEMS = """items AS MATERIALIZED (
  SELECT CAST(o_custkey AS BIGINT) pid,
         CAST(row_number() OVER (PARTITION BY o_custkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) t,
         l_quantity qty, l_extendedprice price,
         nullif(l_discount, 0) disc, nullif(l_tax, 0) tax,
         CASE WHEN l_linestatus = 'F' THEN l_quantity END qf,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

PREDS = """preds AS (
  SELECT CAST(vec_id AS BIGINT) vec_id,
         [CAST(0.5 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.2 AS DOUBLE)] pis,
         [list_sum(CAST(embedding[1:21] AS DOUBLE[])) * 4, list_sum(CAST(embedding[22:42] AS DOUBLE[])) * 4,
          list_sum(CAST(embedding[43:64] AS DOUBLE[])) * 4] mus,
         CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS INTEGER) y
  FROM embeddings)"""

CATEGORIES = """cats(category, category_ord, feature, feature_ord) AS (
  VALUES ('VITAL', 0, 'anyv', 0), ('VITAL', 0, 'engage', 1),
         ('LAB', 1, 'click', 0), ('LAB', 1, 'signup', 1), ('LAB', 1, 'refund', 2))"""

POINT_FEATURES = ["click", "engage", "signup", "anyv"]

SPLIT = f"""means AS (SELECT {", ".join(f"avg({f}) AS {f}" for f in POINT_FEATURES)} FROM stay),
imputed AS (
  SELECT s.pid, s.t, s.y, {", ".join(f"coalesce(s.{f}, m.{f}) AS {f}" for f in POINT_FEATURES)}
  FROM stay s, means m),
split AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(pid || '|' || t || '|42'))
            <= ceil(0.25 * count(*) OVER (PARTITION BY y)) AS is_test FROM imputed)"""

POINTS = f"""{SPLIT},
scale AS (SELECT {", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1.0) AS s_{f}" for f in POINT_FEATURES)}
  FROM split WHERE NOT is_test),
points AS MATERIALIZED (
  SELECT pid || ':' || t AS id, y, is_test,
         {", ".join(f"round(({f} - m_{f}) / s_{f}, 6) + 0 AS {f}" for f in POINT_FEATURES)}
  FROM split, scale),
train AS MATERIALIZED (SELECT * FROM points WHERE NOT is_test),
test AS MATERIALIZED (SELECT * FROM points WHERE is_test)"""


def d2(a: str, b: str, features=POINT_FEATURES) -> str:
    return " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in features)


FEATURES = ["click", "engage", "signup", "anyv", "refund"]


def long_form(source: str = "stay", features=FEATURES, extra: str = "pid, t, y") -> str:
    """One SELECT per feature: (extra, feature, value)."""
    return " UNION ALL ".join(
        f"SELECT {extra}, '{f}' AS feature, {f} AS value FROM {source}" for f in features
    )


def uniform(key: str) -> str:
    return f"(CAST('0x' || left(md5({key}), 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))"


def with_stay(body: str) -> str:
    """``body`` starts with ``SELECT`` or with further CTEs followed by one."""
    return f"WITH {STAY}{_glue(body)}"


def with_items(body: str) -> str:
    return f"WITH {ITEMS}{_glue(body)}"


def with_preds(body: str) -> str:
    return f"WITH {PREDS}{_glue(body)}"


def _glue(body: str) -> str:
    text = body.strip()
    return ("\n" if text[:6].upper() == "SELECT" else ",\n") + text
