"""What is computed: quality checks, the order-level fact, rollups and findings."""
