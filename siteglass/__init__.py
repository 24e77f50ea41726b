"""A website-audit analytics engine on Spark DataFrames."""
