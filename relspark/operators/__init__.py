"""Relational operators as functions from DataFrames to DataFrames; Catalyst plans them."""

from relspark.operators.aggregate import Agg, aggregate
from relspark.operators.join import cross_join, equi_join, theta_join
from relspark.operators.rows import distinct, order_limit, project, scan, where

__all__ = ["Agg", "aggregate", "cross_join", "distinct", "equi_join", "order_limit", "project", "scan", "theta_join", "where"]
