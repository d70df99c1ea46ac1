"""Vector and graph operators on DataFrames."""
