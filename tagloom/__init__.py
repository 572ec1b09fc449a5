"""tagloom: multilabel text-classification data work as Spark DataFrame operators.

Every operator is ``f(df, ...) -> DataFrame`` and stays lazy unless its docstring says
that it counts something on the driver.  Row order is always an explicit id column.
"""
