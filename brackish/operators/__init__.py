"""DataFrame operators. Every one is `f(df, ...) -> DataFrame` and leaves the plan to Spark."""
