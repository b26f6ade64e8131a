"""graphqa: graph queries whose answers come with validation facts, on Spark."""
