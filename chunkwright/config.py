"""Parameters, passed explicitly; nothing reads a global or the clock."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

# Names of groups and classifiers in results, and context lengths of known encoders.
POSITIVE, UNRELATED, DISCARDED = "novel_crypto", "non_crypto_unrelated", "non_crypto_discarded"
FOREST, LINEAR = "random_forest_classifier", "neural_network_binary_classifier"
CONTEXT_LENGTHS = {"microsoft/codebert-base": 512, "Salesforce/codet5-small": 512, "bigcode/starcoder2-15b": 16384, "Qwen/Qwen2.5-7B-Instruct": 32768}
LARGE_MODEL_MARKS, LARGE_MODEL_CHUNK = ("7B", "15B"), 8192


@dataclass(frozen=True)
class Params:
    model: str = "microsoft/codebert-base"
    classifier: str = LINEAR
    representation: str = "text"
    overlap_proportion: float = 0.25
    threshold: float = 0.95
    n_eval: int = 50
    seed: int = 20240601
    size: int | None = None
    hyperparameters: dict = field(default_factory=dict)

    @property
    def chunk_size(self) -> int:
        """The effective chunk size: large models are cut shorter than their context."""
        if self.size is not None:
            return self.size
        if any(mark in self.model for mark in LARGE_MODEL_MARKS):
            return LARGE_MODEL_CHUNK
        return CONTEXT_LENGTHS.get(self.model, 512)

    @property
    def overlap(self) -> int:
        return int(self.chunk_size * self.overlap_proportion)

    @property
    def stride(self) -> int:
        return self.chunk_size - self.overlap

    @property
    def model_tag(self) -> str:
        """The model's own name, fit for a path."""
        return re.sub("[-.]", "_", PurePosixPath(self.model).name)

    @property
    def overlap_tag(self) -> str:
        """The overlap as a fraction of one, rounded down; a name of its own without overlap."""
        if not self.overlap_proportion > 0:
            return "overlap_none"
        return f"overlap_1_{math.floor(1 / self.overlap_proportion)}"
