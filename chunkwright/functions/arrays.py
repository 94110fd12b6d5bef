"""Array expressions, as SQL text, that built-ins lack."""

from __future__ import annotations

BLOCK = 64


def prefix_sums(array: str) -> str:
    """SQL for the sums of all proper prefixes of a bigint array, and of the whole: n + 1 values, first 0.

    A fold that appends copies its accumulator each time; going block by block keeps the work of n
    values near n * (64 + n / 64) copied values rather than n squared.
    """
    blocks = f"transform(sequence(0, greatest(size({array}) - 1, 0), {BLOCK}), __b -> slice({array}, __b + 1, {BLOCK}))"
    block_sum = "aggregate(__k, 0L, (__s, __v) -> __s + __v)"
    starts = f"aggregate({blocks}, array(0L), (__a, __k) -> concat(__a, array(element_at(__a, -1) + {block_sum})))"
    inner = "slice(aggregate(__k, array(__s0), (__a, __v) -> concat(__a, array(element_at(__a, -1) + __v))), 2, size(__k))"
    return f"concat(array(0L), flatten(zip_with({blocks}, slice({starts}, 1, size({starts}) - 1), (__k, __s0) -> {inner})))"
