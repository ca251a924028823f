"""Token vectors as arrays: the built-in embedder, pooling, cosine, MaxSim.

The array versions here need no Python. Dense work on wide vectors goes to the
Arrow kernels in ``cinderlog.operators.similarity``, for which ``maxsim`` here
is the test double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIM = 16


def hash_sums(sentence: Column) -> Column:
    """Whole-number token vectors: byte b of a token's md5 becomes 2b - 255."""
    words = F.split(sentence, " ")

    def one(word: Column) -> Column:
        digest = F.unhex(F.md5(word.cast("binary")))
        return F.transform(
            F.sequence(F.lit(1), F.lit(HASH_DIM)),
            lambda i: F.conv(F.hex(F.substring(digest, i, 1)), 16, 10).cast("int") * 2 - 255,
        )

    return F.transform(words, one)


def hash_tokens(sentence: Column) -> Column:
    """Deterministic stand-in for a language model: slot 0 is the mean of the
    hashed token vectors, the rest are the vectors themselves."""
    sums = hash_sums(sentence)
    total = F.aggregate(
        sums,
        F.array_repeat(F.lit(0), HASH_DIM),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
    )
    mean = F.transform(total, lambda x: (x / (F.size(sums) * 255)).cast("float"))
    each = F.transform(sums, lambda v: F.transform(v, lambda x: (x / F.lit(255)).cast("float")))
    return F.concat(F.array(mean), each)


def pool_first(tokens: Column) -> Column:
    return F.element_at(tokens, 1)


def pool_mean(tokens: Column) -> Column:
    """Mean over tokens, per dimension."""
    dims = F.size(F.element_at(tokens, 1))
    total = F.aggregate(
        tokens,
        F.array_repeat(F.lit(0.0), dims),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")),
    )
    return F.transform(total, lambda x: x / F.size(tokens))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector is all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def maxsim(test: Column, bank: Column, metric: str = "cos") -> Column:
    """Sum over test tokens of the best similarity to any bank token."""
    measure = {"cos": cosine, "dot": dot}[metric]
    return F.aggregate(
        F.transform(test, lambda t: F.array_max(F.transform(bank, lambda b: measure(t, b)))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
