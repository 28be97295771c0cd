"""DataFrame transforms: latest rows, ranking, demand, joins, anonymity, de-duplication, merges, rules, scoring."""
