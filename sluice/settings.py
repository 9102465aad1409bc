"""Settings from the environment, with their allowed ranges."""

from __future__ import annotations

import dataclasses
import os


@dataclasses.dataclass(frozen=True)
class Settings:
    """Each field is read from ``SLUICE_<NAME>``; a value outside its range is an error."""

    warehouse: str = "warehouse"
    max_search_results: int = dataclasses.field(default=100, metadata={"range": (1, 1000)})
    max_fetches: int = dataclasses.field(default=50, metadata={"range": (0, 1000)})
    request_timeout_s: int = dataclasses.field(default=30, metadata={"range": (1, 300)})
    max_retries: int = dataclasses.field(default=3, metadata={"range": (0, 10)})
    backoff_base_s: float = dataclasses.field(default=2.0, metadata={"range": (0.0, 60.0)})
    #: Seconds between two calls to one host.
    pace_s: float = dataclasses.field(default=0.0, metadata={"range": (0.0, 3600.0)})
    cooldown_s: int = dataclasses.field(default=3600, metadata={"range": (0, 31_536_000)})
    extraction_schema_version: str = "1.0"

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            low, high = f.metadata.get("range", (None, None))
            if low is not None and not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must be from {low} to {high}")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ if env is None else env)
        kinds = {"str": str, "int": int, "float": float}
        return cls(**{f.name: kinds[f.type](env[f"SLUICE_{f.name.upper()}"]) for f in dataclasses.fields(cls) if f"SLUICE_{f.name.upper()}" in env})
