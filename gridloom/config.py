"""Default parameters of the pipelines. The values are fixed: they are part of the results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FuseA:
    """Proposals by visual prompt, fused by weighted boxes."""

    conf: float = 0.06
    nms_iou: float = 0.45
    sim: float = 0.65
    wbf_score: float = 0.10
    result: float = 0.50
    containment: float = 0.70
    mask_padding: float = 0.05
    mask_score: float = 0.50
    mask_area: float = 0.10
    small_area: float = 0.01


#: The interactive front end starts the same pipeline with another limit of small objects.
FUSE_A_INTERACTIVE = FuseA(small_area=0.02)


@dataclass(frozen=True)
class FuseB:
    """Detections by exemplars on a canvas, gated and suppressed."""

    vertical: bool = True
    split: float = 0.5
    canvas: int = 1008
    threshold: float = 0.6
    max_refs: int = 5
    bank_size: int = 100
    hash_distance: int = 4
    containment: float = 0.85
    duplicate_iou: float = 0.85
    combined: float = 0.2
    small_area: float = 0.01
    padding: float = 0.01


@dataclass(frozen=True)
class Extract:
    """Reference crops, hashed, clustered and capped."""

    stride: int = 2
    padding: float = 0.0
    hash_distance: int = 6
    eps: float = 0.15
    min_samples: int = 2
    percentile: float = 85.0
    cap: int = 100


@dataclass(frozen=True)
class ExtractPlain:
    """Reference crops of every image, neither hashed nor clustered."""

    stride: int = 1
    padding: float = 0.0


@dataclass(frozen=True)
class Evaluate:
    iou: float = 0.50
    coco: tuple[float, ...] = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
