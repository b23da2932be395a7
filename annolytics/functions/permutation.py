"""A keyed shuffle that can be evaluated, and inverted, one position at a time.

Every (user, project salt) pair gets its own permutation of ``0 .. num_rows - 1``. It is a
swap-or-not shuffle (Hoang, Morris and Rogaway, CRYPTO 2012): in each round a position is
either kept or exchanged with its mirror about a keyed pivot, and a coin that both of them
share decides. Each round is its own inverse, so running the rounds backwards gives the
position of a row. Nothing is sorted and no other row is looked at.

The rounds run as vector arithmetic over Arrow batches. As SQL expressions every round would
repeat the one before it several times over; one projection per round avoids that but takes
seconds to plan.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 16
# Modulus of the round arithmetic, the Mersenne prime 2^31 - 1: products stay within 64 bits.
PRIME = 2147483647


def project_salt(project_id: Column, name: Column) -> Column:
    """A project's salt: the first 16 hex digits of sha256 of ``id:name``."""
    return F.substring(F.sha2(F.concat_ws(":", project_id, name), 256), 1, 16)


def order_seed(user_id: Column, salt: Column) -> Column:
    """The seed of a user's order in a project: sha256 of ``user:salt`` in hex."""
    return F.sha2(F.concat_ws(":", user_id, salt), 256)


def _shuffle(x: pd.Series, seeds: pd.Series, n: int, rounds: Iterable[int]) -> pd.Series:
    codes, distinct = pd.factorize(seeds)
    # The seed is eight 32-bit words; round i draws its pivot and its coin from them.
    words = np.frombuffer(b"".join(distinct), dtype=">u4").reshape(-1, 8).astype("int64")
    w = words[0] if len(words) == 1 else words[codes].T
    at = x.to_numpy(dtype="int64", copy=True)
    for i in rounds:
        pivot = ((w[0] + i * w[1]) % PRIME * PRIME + (w[2] + i * w[3]) % PRIME) % n
        mirror = (pivot - at) % n
        scale = (w[4] + i * w[5]) % (PRIME - 1) + 1
        shift = (w[6] + i * w[7]) % PRIME
        coin = (np.maximum(at, mirror) % PRIME * scale + shift) % PRIME % 2
        at = np.where(coin == 1, mirror, at)
    return pd.Series(at, dtype="int64")


def _shuffle_column(x: Column, seed: Column, num_rows: int, rounds: Iterable[int]) -> Column:
    @F.pandas_udf("bigint")
    def keyed_shuffle(at: pd.Series, seeds: pd.Series) -> pd.Series:
        return _shuffle(at, seeds, num_rows, rounds)

    # Never null. Saying so keeps joins on the result from testing it, which would run it twice.
    return F.coalesce(keyed_shuffle(x.cast("bigint"), F.unhex(seed)), F.lit(-1).cast("bigint"))


def row_at(position: Column, seed: Column, num_rows: int) -> Column:
    """The row at a 0-based position of the order with this seed."""
    return _shuffle_column(position, seed, num_rows, range(1, ROUNDS + 1))


def position_of(row_index: Column, seed: Column, num_rows: int) -> Column:
    """The 0-based position of a row in the order with this seed."""
    return _shuffle_column(row_index, seed, num_rows, range(ROUNDS, 0, -1))
