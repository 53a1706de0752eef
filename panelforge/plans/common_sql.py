"""Common table expressions that the queries' SQL starts from."""

EVENTS = """ev AS (SELECT l_suppkey AS geo, l_shipdate AS t, CAST(year(l_shipdate) AS INT) AS ano, CAST(month(l_shipdate) AS INT) AS mes,
 CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS p, l_extendedprice AS frp, l_returnflag AS sensor, l_quantity AS risk, l_discount AS dry FROM lineitem)"""
OBSERVED = EVENTS + """, obs AS (SELECT geo, ano, mes, p, CAST(count(*) AS DOUBLE) AS y FROM ev GROUP BY geo, ano, mes, p)"""
SPINE = OBSERVED + """, ends AS (SELECT min(p) AS lo, max(p) AS hi FROM obs),
 spine AS (SELECT geo, CAST(unnest(generate_series(lo, hi)) AS INT) AS p FROM (SELECT DISTINCT geo FROM obs), ends)"""
_CAL = "CAST((s.p - 1) // 12 AS INT) AS ano, CAST((s.p - 1) % 12 + 1 AS INT) AS mes"
PANEL = SPINE + f""", panel AS (SELECT s.geo, s.p, {_CAL}, coalesce(o.y, 0.0) AS y, o.y IS NULL AS assumed_zero FROM spine s LEFT JOIN obs o ON s.geo = o.geo AND s.p = o.p)"""
GAPPED = SPINE + f""", panel AS (SELECT s.geo, s.p, {_CAL}, o.y FROM spine s LEFT JOIN obs o ON s.geo = o.geo AND s.p = o.p)"""
ENTITIES = """ent AS (SELECT s_suppkey AS geo, n_regionkey AS uf, (s_suppkey * 37 % 1000) / 100 - 12 AS lat, (s_suppkey * 91 % 1000) / 100 - 45 AS lon, s_acctbal AS area
 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
CLIMATE = """clim AS (SELECT *, coalesce(avg(y) OVER (PARTITION BY geo, mes ORDER BY ano ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS clim,
 count(y) OVER (PARTITION BY geo ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before,
 coalesce(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY geo, mes ORDER BY ano ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS occ,
 coalesce(lag(y, 12) OVER (PARTITION BY geo ORDER BY p), 0.0) AS naive FROM panel)"""
CHAMPION = PANEL + ", " + CLIMATE + """, mon AS (SELECT p, sum(y) AS o, sum(clim) AS e FROM clim GROUP BY p),
 ratio AS (SELECT p, least(greatest((coalesce(sum(o) OVER w, 0.0) + 100.0) / (coalesce(sum(e) OVER w, 0.0) + 100.0), 0.5), 2.0) AS ratio FROM mon
  WINDOW w AS (ORDER BY p RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)),
 champ AS (SELECT c.*, r.ratio, c.clim * r.ratio AS champion FROM clim c JOIN ratio r ON c.p = r.p WHERE n_before >= 36)"""
