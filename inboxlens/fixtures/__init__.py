"""Mail-shaped views over the shared test tables (FIXTURES.md part 2)."""
