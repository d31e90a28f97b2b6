"""Settings of the engine, with the defaults that a deployment may override."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Token budgets, search depths and thresholds."""

    target_tokens: int = 512
    max_tokens: int = 1024
    min_tokens: int = 100
    forced_split_overlap: int = 50
    parent_tokens: int = 2048
    boilerplate_frequency: float = 0.6
    fused_top_k: int = 15
    rerank_top_n: int = 8
    score_floor: float = 0.15
    context_token_budget: int = 10_000
    rrf_constant: int = 60
    pipeline_version: int = 1
    no_answer_text: str = "I could not find this in the indexed documents."

    def override(self, **values: object) -> Settings:
        """A copy with some settings changed; unknown names are refused."""
        known = {f.name for f in fields(self)}
        if unknown := set(values) - known:
            raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
        return replace(self, **values)

    @classmethod
    def load(cls, path: str | None = None, environment: Mapping[str, str] = os.environ) -> Settings:
        """The defaults, overridden by a JSON file and then by variables such as LECTERN_TARGET_TOKENS."""
        values = {}
        if path is not None:
            with open(path, encoding="utf-8") as file:
                values = json.load(file)
        for f in fields(cls):
            given = environment.get(f"LECTERN_{f.name.upper()}")
            if given is not None:
                values[f.name] = type(f.default)(given)
        return cls().override(**values)

    def fingerprint(self) -> str:
        """Identifies the settings that decide what an index holds."""
        from hashlib import sha256

        own = (self.target_tokens, self.max_tokens, self.min_tokens, self.forced_split_overlap, self.parent_tokens, self.boilerplate_frequency, self.pipeline_version)
        return sha256(repr(own).encode()).hexdigest()[:16]


DEFAULTS = Settings()
