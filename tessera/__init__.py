"""Evidence analytics over mixed source material, as Spark DataFrame operators."""
