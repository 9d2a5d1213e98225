"""Water-measurement analytics on Spark DataFrames."""

from acequia.plans.warehouse import Warehouse

__all__ = ["Warehouse"]
