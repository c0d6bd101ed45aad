"""DataFrame operators: sampling, encoding, decoding, token analytics, dictionaries per group, work on encoded values."""
