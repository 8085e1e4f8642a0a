"""Engine settings: typed keys, defaults, validation and the ``key=value`` file."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

# The stopword list of the shipped configuration.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")


class SettingsError(ValueError):
    """An unknown key, a malformed line or a value out of range."""


@dataclass(frozen=True)
class Settings:
    enable_exact: bool = True
    enable_shingle: bool = True
    enable_fuzzy: bool = True
    enable_graph: bool = True
    word_shingle_size: int = 4
    character_shingle_size: int = 9
    min_exact_phrase_characters: int = 28
    candidate_threshold: float = 0.12
    review_threshold: float = 0.30
    graph_edge_threshold: float = 0.28
    weight_exact: float = 0.35
    weight_shingle: float = 0.30
    weight_fuzzy: float = 0.25
    weight_graph: float = 0.10
    max_evidence: int = 8
    worker_count: int = 4
    max_file_bytes: int = 2_000_000
    remove_stopwords: bool = True
    submissions_directory: str = "data/submissions"
    references_directory: str = "data/references"
    reports_directory: str = "reports"
    stopword_file: str = "data/stopwords.txt"

    def __post_init__(self) -> None:
        if not (self.enable_exact or self.enable_shingle or self.enable_fuzzy or self.enable_graph):
            raise SettingsError("every score family is off")
        if self.word_shingle_size < 1 or self.character_shingle_size < 2 or self.min_exact_phrase_characters < 4:
            raise SettingsError("a shingle or phrase size is too small")
        if not all(0 <= t <= 1 for t in (self.candidate_threshold, self.review_threshold, self.graph_edge_threshold)):
            raise SettingsError("thresholds lie between 0 and 1")
        weights = self.weights()
        if not all(math.isfinite(w) and w >= 0 for w in (self.weight_exact, self.weight_shingle, self.weight_fuzzy, self.weight_graph)) or sum(weights) <= 0:
            raise SettingsError("weights are finite, not negative, and not all zero")
        if min(self.max_evidence, self.worker_count, self.max_file_bytes) < 1:
            raise SettingsError("capacities are positive")
        for path in (self.submissions_directory, self.references_directory, self.reports_directory, self.stopword_file):
            if not path.strip() or "\0" in path:
                raise SettingsError("paths are not blank")

    def weights(self) -> tuple[float, float, float, float]:
        """Weights of exact, shingle, fuzzy, graph; 0 for a family that is off."""
        return tuple(
            w if on else 0.0
            for w, on in ((self.weight_exact, self.enable_exact), (self.weight_shingle, self.enable_shingle), (self.weight_fuzzy, self.enable_fuzzy), (self.weight_graph, self.enable_graph))
        )

    def for_request(self, candidate: float = math.nan, review: float = math.nan, edge: float = math.nan, **switches: bool) -> Settings:
        """A run's overrides; NaN keeps a threshold."""
        keep = lambda new, old: old if math.isnan(new) else new
        return replace(self, candidate_threshold=keep(candidate, self.candidate_threshold), review_threshold=keep(review, self.review_threshold), graph_edge_threshold=keep(edge, self.graph_edge_threshold), **switches)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def parse_settings(text: str) -> Settings:
    """Strict ``key=value`` lines with ``#`` comments."""
    kinds = {_camel(f.name): (f.name, f.type) for f in fields(Settings)}
    found: dict[str, object] = {}
    for number, line in enumerate(text.lstrip("﻿").splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq or key not in kinds:
            raise SettingsError(f"line {number}: {'unknown key' if eq else 'no ='}: {line}")
        name, kind = kinds[key]
        try:
            if kind == "bool":
                found[name] = {"true": True, "false": False}[value.lower()]
            else:
                found[name] = {"int": int, "float": float, "str": str}[kind](value)
        except (KeyError, ValueError) as e:
            raise SettingsError(f"line {number}: bad value for {key}: {value}") from e
    return Settings(**found)


def format_settings(s: Settings) -> str:
    """The file that ``parse_settings`` reads back."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return "".join(f"{_camel(f.name)}={show(getattr(s, f.name))}\n" for f in fields(Settings))
