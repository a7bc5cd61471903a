"""Set-oriented lead intelligence on Spark: results, sites, contacts, people, leads, metrics, ledger."""
