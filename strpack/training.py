"""Dictionary training on a bounded, ordered sample: adjacent tokens merge online once a pair is frequent enough.

The result depends on the order of rows, so it is one sequential pass by design; what keeps it scalable is that the
sample is bounded whatever the size of the table (see ``operators.sampling``).
"""

from __future__ import annotations

from collections.abc import Iterable

from .config import BYTES, Config
from .matching import Matcher, identity_tokens


def train_tokens(rows: Iterable[bytes], config: Config, threshold: int) -> tuple[list[bytes], Matcher]:
    """All tokens by id, and a matcher that holds them. Pairs never span rows; a merge may go on merging at once."""
    tokens = identity_tokens()
    matcher = Matcher(config.max_token_length, tokens)
    last_id, longest, seen = config.last_id, config.max_token_length, {}
    for row in rows:
        if not row:
            continue
        left, size = matcher.find(row, 0)
        at, end = size, len(row)
        while at < end:
            right, more = matcher.find(row, at)
            start, at = at - size, at + more
            if longest > 0 and size + more > longest:
                left, size = right, more
                continue
            pair = left << 16 | right
            count = seen.get(pair, 0) + 1
            if count < threshold:
                seen[pair] = count
                left, size = right, more
                continue
            new = len(tokens)
            if new > last_id:
                return tokens, matcher
            seen.pop(pair, None)
            merged = row[start:at]
            if not matcher.insert(merged, new):
                left, size = right, more
                continue
            tokens.append(merged)
            if new == last_id:
                return tokens, matcher
            left, size = new, size + more
    return tokens, matcher


def train_rows(rows: list[bytes], config: Config, ordinals_shuffled: bool = False) -> list[bytes]:
    """Train on rows in their given order: shuffle, sample, threshold, merge - all on one machine, for small groups."""
    from .operators.sampling import budget_prefix, permutation

    if not rows:
        return identity_tokens()
    order = range(len(rows)) if ordinals_shuffled else permutation(len(rows))
    shuffled = [rows[i] for i in order]
    total = sum(map(len, rows))
    if total > config.budget:
        if config.stratified:
            from .functions.templates import template_key
            from .operators.sampling import stratified_order

            chosen = stratified_order([template_key(r) for r in shuffled], [len(r) for r in shuffled], config.budget, config.clusters)
            shuffled = [shuffled[i] for i in chosen]
        else:
            shuffled = shuffled[: budget_prefix([len(r) for r in shuffled], config.budget)]
        total = sum(map(len, shuffled))
    return train_tokens(shuffled, config, config.pair_threshold(total))[0]


assert BYTES == 256
