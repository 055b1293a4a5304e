"""DataFrame operators: joins, ranks, splits, probes, metrics, audits."""
