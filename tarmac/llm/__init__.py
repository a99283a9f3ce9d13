"""Training-data operators: near duplicates, toxicity, quality, URLs, language, chat, tokens.

Nothing else in the library imports this subpackage; ``queries.py`` holds its registered
queries and ``oracle.py`` their DuckDB statements.
"""
