"""DataFrame → DataFrame operators: profiling, filters, frequency tables and crosstabs, treatment effects,
Kaplan–Meier survival, distributions, classification metrics, splits, Spark ML wrappers and the findings report."""
