"""Relation traversal and expressions along relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import expressions as E
from recordloom.operators.expressions import this
from recordloom.operators.integrity import replace_edges
from recordloom.operators.traverse import edges, follow, follow_members
from recordloom.plans.registry import query
from recordloom.plans.star import star

# JSON text of a number, as SQL
_NUM = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR), '0'), '.')"
_PARTS = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
_SUPPLIERS = "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"


@query(
    "hop_scalar",
    """SELECT CAST(o_orderkey AS VARCHAR) sys_root, CAST(c_custkey AS VARCHAR) c_custkey, c_name
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def hop_scalar(spark, sf):
    return follow(star(spark, sf), "orders", ["o_custkey"]).select("sys_root", "c_custkey", "c_name")


@query(
    "hop_array",
    f"""SELECT CAST(o_orderkey AS VARCHAR) sys_root, CAST(p_partkey AS VARCHAR) p_partkey, p_name
        FROM orders JOIN {_PARTS} ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
)
def hop_array(spark, sf):
    return follow(star(spark, sf), "orders", ["parts"]).select("sys_root", "p_partkey", "p_name")


@query(
    "hop_chain",
    f"""SELECT CAST(o_orderkey AS VARCHAR) sys_root, CAST(r_regionkey AS VARCHAR) r_regionkey, r_name,
               count(*) AS paths
        FROM orders JOIN {_SUPPLIERS} ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY ALL""",
)
def hop_chain(spark, sf):
    reached = follow(star(spark, sf), "orders", ["suppliers", "s_nationkey", "n_regionkey"])
    return reached.groupBy("sys_root", "r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("paths"))


@query(
    "hop_array_after_array",
    f"""SELECT CAST(c_custkey AS VARCHAR) sys_root, p_brand, count(*) AS paths
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN {_PARTS} ON o_orderkey = l_orderkey
        JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
)
def hop_array_after_array(spark, sf):
    reached = follow(star(spark, sf), "customer", ["orders", "parts"])
    return reached.groupBy("sys_root", "p_brand").agg(F.count(F.lit(1)).alias("paths"))


@query(
    "related_records",
    """SELECT '37' AS sys_root, CAST(o_orderkey AS VARCHAR) o_orderkey, o_orderstatus FROM orders
       WHERE o_custkey = 37""",
)
def related_records(spark, sf):
    reached = follow(star(spark, sf), "customer", ["orders"], roots=["37"])
    return reached.select("sys_root", "o_orderkey", "o_orderstatus")


_MEMBERS = """(SELECT o_custkey, o_orderkey, CAST(o_orderkey AS VARCHAR) member,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) rk FROM orders)"""


@query(
    "related_with_array",
    f"""SELECT CAST(o_custkey AS VARCHAR) sys_array_root, member AS sys_root,
               CAST(p_partkey AS VARCHAR) p_partkey, p_name
        FROM {_MEMBERS} m JOIN {_PARTS} ON m.o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
        WHERE rk BETWEEN 3 AND 5""",
)
def related_with_array(spark, sf):
    reached = follow_members(star(spark, sf), "customer", ["orders"], ["parts"], page_size=3, offset=2)
    return reached.select("sys_array_root", "sys_root", "p_partkey", "p_name")


@query(
    "edge_replace",
    f"""SELECT CAST(l_orderkey AS VARCHAR) from_id, CAST(l_partkey AS VARCHAR) to_id FROM {_PARTS}
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
        UNION ALL
        SELECT CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR) FROM {_SUPPLIERS}
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
)
def edge_replace(spark, sf):
    tables = star(spark, sf)
    orders = tables["orders"]
    touched = orders.df.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("record_id"))
    new = edges(orders, "suppliers").join(touched, F.col("from_id") == F.col("record_id"), "left_semi")
    return replace_edges(edges(orders, "parts"), touched, new)


@query("expr_attr", "SELECT CAST(c_custkey AS VARCHAR) record_id, '\"' || c_name || '\"' AS result FROM customer")
def expr_attr(spark, sf):
    return E.evaluate(star(spark, sf), "customer", {"result": this("c_name")})


@query(
    "expr_path",
    """SELECT CAST(o_orderkey AS VARCHAR) record_id, '"' || r_name || '"' AS result FROM orders
       LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def expr_path(spark, sf):
    path = this("o_custkey", "c_nationkey", "n_regionkey", "r_name")
    return E.evaluate(star(spark, sf), "orders", {"result": path})


@query(
    "expr_shared",
    f"""SELECT CAST(o_orderkey AS VARCHAR) record_id, '"' || c_name || '"' AS customer,
               '"' || n_name || '"' AS nation, {_NUM.format("c_acctbal")} AS balance
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def expr_shared(spark, sf):
    return E.evaluate(
        star(spark, sf), "orders",
        {
            "customer": this("o_custkey", "c_name"),
            "nation": this("o_custkey", "c_nationkey", "n_name"),
            "balance": this("o_custkey", "c_acctbal"),
        },
    )


@query(
    "expr_shape",
    f"""SELECT CAST(o_orderkey AS VARCHAR) record_id, coalesce(names, '[]') AS names, coalesce(sizes, '[]') AS sizes,
               '"' || o_orderstatus || '"' AS status
        FROM orders LEFT JOIN (
          SELECT l_orderkey, '[' || string_agg('"' || p_name || '"', ',' ORDER BY CAST(p_partkey AS VARCHAR)) || ']' AS names,
                 '[' || string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) || ']' AS sizes
          FROM {_PARTS} JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def expr_shape(spark, sf):
    return E.evaluate(
        star(spark, sf), "orders",
        {"names": this("parts", "p_name"), "sizes": this("parts", "p_size"), "status": this("o_orderstatus")},
    )


@query("expr_pk", "SELECT CAST(o_orderkey AS VARCHAR) record_id, '\"' || o_custkey || '\"' AS result FROM orders")
def expr_pk(spark, sf):
    return E.evaluate(star(spark, sf), "orders", {"result": this("o_custkey", "C_CustKey")})


@query(
    "expr_template",
    f"""SELECT CAST(o_orderkey AS VARCHAR) record_id,
          '{{"order":{{"price":' || {_NUM.format("o_totalprice")} || ',"flags":[true,null,1.5,"' || o_orderstatus ||
          '"]}},"customer":"' || c_name || '","missing":null}}' AS result
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def expr_template(spark, sf):
    template = {
        "order": {"price": this("o_totalprice"), "flags": [True, None, 1.5, this("o_orderstatus")]},
        "customer": this("o_custkey", "c_name"),
        "missing": this("no_such_attribute"),
    }
    return E.evaluate(star(spark, sf), "orders", {"result": template})


@query(
    "expr_eval",
    """SELECT '37' AS record_id, coalesce('[' || string_agg('"' || o_orderstatus || '"', ',' ORDER BY CAST(o_orderkey AS VARCHAR)) || ']', '[]') AS statuses,
              (SELECT '"' || n_name || '"' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 37) AS nation
       FROM orders WHERE o_custkey = 37""",
)
def expr_eval(spark, sf):
    wanted = {"statuses": this("orders", "o_orderstatus"), "nation": this("c_nationkey", "n_name")}
    return E.evaluate(star(spark, sf), "customer", wanted, roots=["37"])


@query(
    "expr_eval_array",
    f"""SELECT CAST(m.o_custkey AS VARCHAR) sys_array_root, member AS record_id, n > 4 AS has_next,
               '"' || o_orderstatus || '"' AS status, coalesce(parts, 'null') AS parts
        FROM {_MEMBERS} m JOIN orders o ON o.o_orderkey = m.o_orderkey
        JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) t ON t.o_custkey = m.o_custkey
        LEFT JOIN (SELECT l_orderkey, '[' || string_agg('"' || p_name || '"', ',' ORDER BY CAST(p_partkey AS VARCHAR)) || ']' AS parts
                   FROM {_PARTS} JOIN part ON p_partkey = l_partkey GROUP BY 1) ON l_orderkey = m.o_orderkey
        WHERE rk BETWEEN 2 AND 4""",
)
def expr_eval_array(spark, sf):
    return E.evaluate_members(
        star(spark, sf), "customer", ["orders"],
        {"status": this("o_orderstatus"), "parts": this("parts", "p_name")},
        page_size=3, offset=1,
    )


@query(
    "expr_rows",
    f"""SELECT CAST(l_orderkey AS VARCHAR) record_id, CAST(p_partkey AS VARCHAR) target_id,
               '"' || p_name || '"' AS p_name, {_NUM.format("p_retailprice")} AS p_retailprice
        FROM {_PARTS} JOIN part ON p_partkey = l_partkey""",
)
def expr_rows(spark, sf):
    return E.lookup_rows(star(spark, sf), "orders", ["parts"], ["p_name", "p_retailprice"])


_COUNTED = """(SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"""


@query(
    "expr_bounded_shaped",
    f"""SELECT CAST(c_custkey AS VARCHAR) record_id, coalesce(statuses, '[]') AS statuses FROM {_COUNTED} LEFT JOIN (
          SELECT o_custkey, '[' || string_agg('"' || o_orderstatus || '"', ',' ORDER BY CAST(o_orderkey AS VARCHAR)) || ']' AS statuses
          FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n <= 10""",
)
def expr_bounded_shaped(spark, sf):
    """Arrays of the customers with few orders."""
    wanted = {"statuses": this("orders", "o_orderstatus")}
    return E.evaluate_bounded(star(spark, sf), "customer", wanted, max_values=10)[0]


@query(
    "expr_bounded_rows",
    f"""SELECT CAST(c_custkey AS VARCHAR) record_id, 'orders' AS path, 'o_orderstatus' AS attribute,
               CAST(o_orderkey AS VARCHAR) target_id, '"' || o_orderstatus || '"' AS value
        FROM {_COUNTED} JOIN orders ON o_custkey = c_custkey WHERE n > 10""",
)
def expr_bounded_rows(spark, sf):
    """The values of the customers with many, in long form."""
    wanted = {"statuses": this("orders", "o_orderstatus")}
    return E.evaluate_bounded(star(spark, sf), "customer", wanted, max_values=10)[1]
