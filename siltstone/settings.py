"""Settings from nested ``key: value`` text, with single values overridden by the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "REGISTRY"


def parse(text: str) -> dict[str, str]:
    """Dotted keys and their values; nesting is by indentation, ``#`` starts a comment line, quotes are taken off."""
    out: dict[str, str] = {}
    above: list[tuple[int, str]] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        name, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"no key in {line!r}")
        while above and above[-1][0] >= depth:
            above.pop()
        value = value.strip()
        if value:
            out[".".join([*(n for _, n in above), name])] = value.strip("'\"")
        else:
            above.append((depth, name))
    return out


def load(text: str, environment: Mapping[str, str]) -> dict[str, str]:
    """Settings of the text; ``REGISTRY_A_B`` overrides ``a.b`` and may add keys that the text lacks."""
    out = parse(text)
    known = {k.replace(".", "_").upper(): k for k in out}
    for name, value in environment.items():
        if name.startswith(PREFIX + "_"):
            short = name[len(PREFIX) + 1 :]
            out[known.get(short, short.lower().replace("_", "."))] = value
    return out


@dataclass(frozen=True)
class Engine:
    """What the engine reads from its settings, by dotted key with the dots as underscores."""

    dedup_warmup: int = 200
    dedup_factor: float = 1.1
    cache_size: int = 64
    cache_policy: str = "arc"
    spark_shuffle_partitions: int = 200

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Engine:
        given = {f.name: f.type for f in fields(cls)}
        kinds = {"int": int, "float": float, "str": str}
        flat = {k.replace(".", "_"): v for k, v in values.items()}
        return cls(**{n: kinds[str(t)](flat[n]) for n, t in given.items() if n in flat})

    def apply(self, spark: SparkSession) -> None:
        spark.conf.set("spark.sql.shuffle.partitions", str(self.spark_shuffle_partitions))
