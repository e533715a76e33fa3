"""palaver: DataFrame operators for conversational knowledge bases on Spark.

Every operator takes DataFrames and returns a DataFrame; functions take and
return Columns.  Nothing is collected inside an operator except values with a
checked bound (see ``palaver.plans.scale``).
"""
