"""Settings of a retrieval run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    """threshold: similarity below which a frame counts for nothing; before, after: weight of the neighbours' best context score;
    window: rows looked at on either side; candidates: kept by task before the text rerank; results: kept by task in the end."""

    threshold: float = 0.24
    before: float = 0.10
    after: float = 0.10
    window: int = 6
    candidates: int = 500
    results: int = 10
    #: "global": neighbours are rows of the frame index, whatever their video; "video": only rows of the same video.
    neighbours: str = "global"


@dataclass(frozen=True)
class TextRerank:
    """accept: least ratio that counts; weight: bonus per unit of ratio; most: bonus at most."""

    accept: float = 0.9
    weight: float = 0.10
    most: float = 0.20


@dataclass(frozen=True)
class Sampling:
    """interval: seconds between sampled frames; change: least distance to the last kept frame; dark, grey: day/night bounds."""

    interval: float = 1.0
    change: float = 0.12
    dark: float = 40.0
    grey: float = 20.0


#: Tasks in a chunk of the reference schedule.
CHUNK = 25

#: Image and text models by name of the set-up (fixed values: name, weights, length of a vector).
MODELS = {"1280D": ("ViT-bigG-14", "laion2b_s39b_b160k", 1280)}


def model_of(name: str, other: tuple[str, str, int] | None = None) -> tuple[str, str, int]:
    """The model of a set-up, or `other` where the name is none of MODELS; both stages take it from here."""
    if name in MODELS:
        return MODELS[name]
    if other is None:
        raise ValueError(f"{name!r} is no set-up of {sorted(MODELS)}, and no other model is given")
    return other
