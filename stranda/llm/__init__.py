"""Operators for preparing training text: rules, shards, language, joins, chat, leaks, licences, PII, pages, packing."""
