"""Version-transition analytics on Spark: facts, drift, scores, features, curation, audits."""
