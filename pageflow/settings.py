"""Settings of a reader: stored values over defaults, with a guard on what an older version stored."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Versions, and the least and usual speed of reveal.
SCHEMA_VERSION, LEAST_SPEED, USUAL_SPEED = 2, 10, 80


@dataclass(frozen=True)
class Settings:
    provider: str = "default"
    endpoint: str = ""
    model: str = ""
    effort: str = "low"
    language: str = "English"
    nearby_pages: int = 2
    concurrency: int = 4
    characters_per_second: int = USUAL_SPEED
    schema_version: int = SCHEMA_VERSION

    @classmethod
    def restore(cls, stored: str | None) -> Settings:
        """Defaults overlaid with what is stored; unreadable text gives the defaults."""
        try:
            own = json.loads(stored or "{}")
        except ValueError:
            own = {}
        if not isinstance(own, dict):
            own = {}
        known = {f.name: own[f.name] for f in fields(cls) if f.name in own and type(own[f.name]) is type(f.default)}
        out = replace(cls(), **known)
        speed = out.characters_per_second
        if speed < LEAST_SPEED or own.get("schema_version") != SCHEMA_VERSION:
            speed = USUAL_SPEED
        return replace(out, characters_per_second=speed, schema_version=SCHEMA_VERSION)

    def store(self) -> str:
        return json.dumps(asdict(self))

    def key_parts(self) -> tuple[str, ...]:
        """What tells translations of one page apart."""
        return self.provider, self.endpoint, self.model, self.effort, self.language


def restored(stored: Column) -> Column:
    """`Settings.restore` of a column of stored texts, as a struct of the same fields.

    Texts count as texts and whole numbers as numbers; what is of another kind, and what is no
    object, gives the defaults.
    """
    v = F.try_parse_json(stored)
    held = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)

    def own(f):
        x = F.try_variant_get(held, f"$.{f.name}", "variant")
        if isinstance(f.default, str):
            return F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit(f.default))
        return F.coalesce(F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "long")), F.lit(f.default).cast("long"))

    told = F.coalesce(F.try_variant_get(held, "$.schema_version", "long") == SCHEMA_VERSION, F.lit(False))

    def value(f):
        if f.name == "schema_version":
            return F.lit(SCHEMA_VERSION).cast("long").alias(f.name)
        if f.name == "characters_per_second":
            return F.when(told & (own(f) >= LEAST_SPEED), own(f)).otherwise(F.lit(USUAL_SPEED).cast("long")).alias(f.name)
        return own(f).alias(f.name)

    return F.struct(*(value(f) for f in fields(Settings)))


def next_version(last: int, now_ms: int) -> int:
    """A version above the last one that follows the clock."""
    return max(last + 1, now_ms * 1000)
