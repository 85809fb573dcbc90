"""The governed metric layer: catalog, policy, rules, joins, gates, execution."""
