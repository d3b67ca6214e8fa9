"""Registration of queries: a Spark callable and, where SQL can express it, the SQL of the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acutance.session import read_table

#: Views that make rasters, edge samples, measurements and curves of the given tables: more tables' rows make more pictures and edges, not larger ones.
#: The text is both Spark and DuckDB SQL.
VIEWS = {
    "v_pixels": """select cast(l_suppkey % 4 + 4*floor(l_orderkey / 15000.0E0) as int) image_id, cast(l_orderkey % 48 as int) y, cast(l_partkey % 32 as int) x,
  cast(floor(avg(l_extendedprice)*0.6) as int) v from lineitem group by 1, 2, 3""",
    "v_samples": """select cast(l_suppkey % 20 + 20*floor(l_orderkey / 15000.0E0) as int) edge_id,
  (l_orderkey % 1000)/1000.0E0*56 - 28 + (l_partkey % 97)/776.0E0 perp, cast(l_partkey % 200 as double) par,
  2000.0E0 + 40000.0E0/(1.0E0+exp(-((l_orderkey % 1000)/1000.0E0*56 - 28 + (l_partkey % 97)/776.0E0)
    /(0.5E0+(l_suppkey % 20)*0.1E0))) + (l_quantity-25.5)*4 v from lineitem""",
    "v_edges": """select cast(s_suppkey as int) edge_id, cast(s_suppkey % 4 + 4*floor(s_suppkey / 100.0E0) as int) image_id,
  cast((s_suppkey*37) % 640 as double) ex, cast((s_suppkey*53) % 480 as double) ey, s_suppkey*0.37E0 angle,
  0.1E0 + cast(s_acctbal+1000 as double)/30000 mtf, case when s_suppkey % 7=0 then 0.2E0 when s_suppkey % 3=0 then 0.5E0 else 1.0E0 end quality from supplier""",
    "v_targets": """select image_id, y, x, 45000 - 37000*(1/(1 + exp(-(u + 32)/s)) - 1/(1 + exp(-(u - 32)/s)))*(1/(1 + exp(-(w + 32)/s)) - 1/(1 + exp(-(w - 32)/s)))
  + ((image_id*7919 + y*y*613 + x*x*331 + x*y*(31 + image_id % 7)) % 1001 - 500)*0.2E0 v from
  (select image_id, s, y, x, (x - 55.21E0)*cos(a) + (y - 54.87E0)*sin(a) u, (y - 54.87E0)*cos(a) - (x - 55.21E0)*sin(a) w from
    (select cast(s_suppkey as int) image_id, 0.35E0 + cast(s_acctbal + 1000 as double)/20000 s, radians(3 + (s_suppkey*73 % 390)/10.0E0) a from supplier)
    cross join (select cast(y as int) y from range(110) ty(y)) cross join (select cast(x as int) x from range(110) tx(x)))""",
    "v_events": """select cast(user_id as int) edge_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) i, value v from events""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_found: dict[str, tuple[Callable, str | None]] = {}


def _steady_mean(c: str) -> str:
    """avg(c) as Spark SQL, the same whatever the order of the rows: whole and broken parts of c in steps of 2^-20 and 2^-52 are summed as integers, and the sum is rounded once.
    With a value of 10^12 or more, or not a number, it is Spark's avg."""
    x = f"if(abs({c}) < 1e12, {c}, null)*1048576e0"
    return f"""case when count(if(abs({c}) < 1e12, 1, null)) = count({c})
  then (sum(cast(floor({x}) as bigint)) + sum(cast(floor(({x} - floor({x}))*4294967296e0) as bigint))/4294967296e0)/1048576e0/nullif(count({c}), 0) else avg({c}) end"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over the tables of sf_dir.

    A mean of doubles depends on the order in which they are summed, by a last bit that floor() makes a whole step of a pixel; here it is taken from exact sums.
    """
    text = re.sub(r"\bavg\((\w+)\)", lambda m: _steady_mean(m[1]), VIEWS[name])
    tables = {t: read_table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", text)}
    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)


def register(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name; views that the SQL names are put in front of it."""

    def wrap(fn):
        _found[name] = (fn, sql)
        return fn

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, (_, sql) in _found.items():
        if sql:
            sql = sql.strip()
            used = [f"{v} as ({VIEWS[v]})" for v in VIEWS if re.search(rf"\b{v}\b", sql)]
            body = sql[5:].lstrip() if sql.lower().startswith("with ") else None
            recursive = "recursive " if body and body.lower().startswith("recursive ") else ""
            body = body[10:] if recursive else body
            out[k] = (f"with {recursive}{', '.join(used)}" + (f", {body}" if body else f" {sql}") if used else sql)
    return out
