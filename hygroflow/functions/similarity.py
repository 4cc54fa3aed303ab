"""String similarities without a column form; small helpers for Arrow batches."""

from __future__ import annotations


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """Jaro similarity with a bonus for up to four leading characters, given above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    matched_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                matched_a.append(ch)
                break
    m = len(matched_a)
    if m == 0:
        return 0.0
    matched_b = (ch for ch, used in zip(b, taken) if used)
    swapped = sum(x != y for x, y in zip(matched_a, matched_b)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * prefix_weight * (1 - jaro)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per character."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(distance: int, total: int) -> float:
    """0..100 from the number of unmatched characters and both lengths."""
    return 100.0 - 100.0 * distance / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """0..100 similarity of the word sets: shared words against each side's remainder."""
    words_a, words_b = set(a.split()), set(b.split())
    if not words_a or not words_b:
        return 0.0
    shared, rest_a, rest_b = (
        " ".join(sorted(s)) for s in (words_a & words_b, words_a - words_b, words_b - words_a)
    )
    if shared and (not rest_a or not rest_b):
        return 100.0
    lead = len(shared) + 1 if shared else 0
    size_a, size_b = lead + len(rest_a), lead + len(rest_b)
    # the shared words lead both texts, so only the remainders can differ
    unmatched = len(rest_a) + len(rest_b) - 2 * common_subsequence(rest_a, rest_b)
    best = _ratio(unmatched, size_a + size_b)
    if shared:
        best = max(
            best,
            _ratio(1 + len(rest_a), len(shared) + size_a),
            _ratio(1 + len(rest_b), len(shared) + size_b),
        )
    return best
