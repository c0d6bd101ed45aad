"""Training-data operators: near-duplicates, tokens, licences, secrets, languages, media, leaks, repeats and URL rules.

Nothing else in the library imports this subpackage. Each module holds one operator with its general interface; the
thin queries of the driver contract are in ``catalog``.
"""
