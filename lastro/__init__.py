"""Credit-market analytics on Spark: versioned observations, comparisons, rules, matching and text, as DataFrame operators."""
