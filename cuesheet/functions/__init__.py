"""Column expressions; all JVM-side except Unicode normalisation."""
