"""Spark SQL expressions, as text.

Every function takes column names or SQL expressions and returns a SQL expression, so the same text serves
``F.expr``, ``df.selectExpr`` and ``spark.sql``, nests inside array lambdas, and is parsed by Spark in one call.
"""
