"""A reversible bucket hash of vertex ids, as Column expressions.

Ids below height * parts are dealt over ``parts`` = 128 * buckets columns of
``height`` ids each, so that consecutive ids end far apart; ids beyond stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts per bucket; fixed value.
MULTIPLIER = 128


@dataclass(frozen=True)
class BucketHash:
    domain: int
    buckets: int

    @property
    def parts(self) -> int:
        return self.buckets * MULTIPLIER

    @property
    def height(self) -> int:
        return self.domain // self.parts

    def _deal(self, v: Column, low: int, high: int) -> Column:
        """(v div low) + (v mod low) * high within the dealt range."""
        dealt = F.call_function("div", v, F.lit(low)) + (v % low) * high
        return F.when(v >= self.height * self.parts, v).otherwise(dealt).cast("long") if self.height else v.cast("long")

    def hash(self, v: Column) -> Column:
        return self._deal(v, self.parts, self.height)

    def unhash(self, v: Column) -> Column:
        return self._deal(v, max(1, self.height), self.parts)


@dataclass(frozen=True)
class NoHash:
    def hash(self, v: Column) -> Column:
        return v

    def unhash(self, v: Column) -> Column:
        return v


def hasher(kind: str, domain: int, buckets: int):
    if kind == "none":
        return NoHash()
    if kind == "bucket":
        return BucketHash(domain, buckets)
    raise ValueError(f"unknown hashing {kind!r}")
