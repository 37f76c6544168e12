import duckdb
from conftest import SF
from oracle import compare, views

from grantloom.plans import queries as plans


def test_packages_whose_neighbours_have_no_line_items(spark, tmp_path):
    """Without line items of the fifth to seventh order, packages 4 and 8 stand side by side."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    gone = f"SELECT o_orderkey FROM '{SF}/orders.parquet' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) BETWEEN 5 AND 7"
    con.sql(f"COPY (SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey NOT IN ({gone})) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    compare(views(str(tmp_path)), plans.queries()["effort_layouts"](spark, str(tmp_path)), plans.oracle_sql()["effort_layouts"])
