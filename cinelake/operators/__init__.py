"""DataFrame operators: lookups, dedupes, rollups, diffs, rules, facets and exports."""
