"""Per-user order, navigation and work queues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics.operators import ordering
from workload import fixtures as fx
from workload.registry import query


def _salt(spark, sf) -> Column:
    """The salt of the project: one value, looked up like any project setting."""
    return F.lit(fx.projects(spark, sf).where(F.col("project_id") == fx.PROJECT).first()["salt"])


def _num_rows(spark, sf) -> int:
    """The dataset's size, which the catalog keeps; here a footer read."""
    return fx.dataset(spark, sf).count()


@query(
    "user_row_order",
    "SELECT row_index, pos AS order_position, lang FROM user_order JOIN dataset USING (row_index) WHERE user_id='u7'",
)
def user_row_order(spark, sf):
    ordered = ordering.user_row_order(fx.dataset(spark, sf), F.lit(fx.ME), _salt(spark, sf), _num_rows(spark, sf))
    return ordered.select("row_index", "order_position", "lang")


@query(
    "next_row",
    """WITH free AS (SELECT user_id, pos, row_index FROM user_order o
         WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.user_id=o.user_id AND a.row_index=o.row_index))
       SELECT user_id, arg_min(row_index, pos) AS row_index FROM users LEFT JOIN free USING (user_id) GROUP BY 1""",
)
def next_row(spark, sf):
    return ordering.next_row(fx.users(spark, sf), fx.project_rows(spark, sf), _salt(spark, sf), _num_rows(spark, sf))


@query(
    "label_queue",
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS queue_no, row_index FROM user_order o
         WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.user_id=o.user_id AND a.row_index=o.row_index)
       QUALIFY queue_no<=10""",
)
def label_queue(spark, sf):
    return ordering.label_queue(fx.users(spark, sf), fx.project_rows(spark, sf), _salt(spark, sf), _num_rows(spark, sf), 10)


@query(
    "navigate",
    """SELECT a.user_id, a.row_index, p.row_index AS prev_row, n.row_index AS next_row FROM ann a
         JOIN user_order c ON c.user_id=a.user_id AND c.row_index=a.row_index
         LEFT JOIN user_order p ON p.user_id=a.user_id AND p.pos=c.pos-1
         LEFT JOIN user_order n ON n.user_id=a.user_id AND n.pos=c.pos+1""",
)
def navigate(spark, sf):
    current = fx.project_rows(spark, sf).select("user_id", "row_index")
    return ordering.navigate(current, _salt(spark, sf), _num_rows(spark, sf))


@query(
    "navigate_rows",
    """SELECT a.user_id, a.row_index AS from_row, n.row_index, d.lang,
         EXISTS (SELECT 1 FROM ann x WHERE x.row_index=n.row_index AND x.user_id=a.user_id) AS by_me,
         EXISTS (SELECT 1 FROM ann x WHERE x.row_index=n.row_index) AS by_any FROM ann a
         JOIN user_order c ON c.user_id=a.user_id AND c.row_index=a.row_index
         JOIN user_order n ON n.user_id=a.user_id AND n.pos=c.pos+1 JOIN dataset d ON d.row_index=n.row_index""",
)
def navigate_rows(spark, sf):
    annotations = fx.project_rows(spark, sf)
    rows = fx.dataset(spark, sf).select("row_index", "lang")
    current = annotations.select("user_id", "row_index")
    return ordering.navigate_rows(current, rows, annotations, _salt(spark, sf), _num_rows(spark, sf))
