"""Settings of detection, rectification, classification and reranking, and how a user's own are laid over them."""

from __future__ import annotations

# The settings that hold where a user gives none.
DEFAULTS = {
    "detection": {
        "scales": (0.85, 1.0, 1.25, 1.5, 1.8, 2.2, 2.6),
        "valid": {"area_ratio": (0.0003, 0.20), "width_ratio": (0.08, 0.80), "height_ratio": (0.02, 0.20)},
        "least": {"extent": 0.10, "solidity": 0.10},
        "centre": {"horizontal": (0.50, 0.05, 0.95), "vertical": (0.76, 0.18, 0.96)},
        "keep": 40,
        "same": 0.6,
        "min_area_pixels": 30,
        "min_mask_area_ratio": 0.00008,
        "mser_aspect": (0.12, 2.00),
        "padding": 0.35,
        "region": (0.15, 0.45, 0.85, 0.95),
        "expand": {"edge_full": (1.55, 1.18), "edge_priority": (1.72, 1.20), "text_priority": (1.70, 2.20), "text_dark_priority": (1.55, 2.80), "dark_priority": (1.25, 1.35), "mser_text": (1.85, 2.10)},
        "weights": {"geometry": 0.16, "shape": 0.07, "texture": 0.10, "branch": 0.08, "evidence": 0.18, "count": 0.10, "coverage": 0.08, "position": 0.07, "span": 0.08, "band": 0.10, "layout": 0.06},
        "penalties": {"empty": 0.04, "split": 0.04, "clip": 0.08, "boundary": 0.14},
    },
    "rectification": {"max_degrees": 12, "min_length": 18, "padding": 0.06, "left": 0.03, "right": 0.10, "vertical": 0.06, "min_crop_height": 36, "row_gap": 0.10},
    "classification": {"suffix_letter": True},
    "reranking": {
        "evaluate": 10,
        "weights": {"detector": 0.20, "evidence": 0.16, "recognition": 0.12, "regex": 0.19, "state": 0.11, "composition": 0.06, "length": 0.03, "structure": 0.10, "framing": 0.03},
        "weak_ocr": 0.35,
        "weak_detector_bonus": 0.14,
        "weak_evidence_bonus": 0.08,
        "exact_bonus": 0.10,
        "partial_bonus": 0.04,
        "mixed_bonus": 0.08,
        "empty": 0.55,
        "weak_texture": 0.24,
        "no_digit": 0.16,
        "no_letter": 0.12,
        "weak_composition": 0.10,
        "bad_length": 0.08,
        "bad_prefix": 0.18,
        "truncated": 0.12,
        "short_read": 0.14,
        "forbidden_suffix": 0.10,
        "weak_framing": 0.08,
        "overlap": 0.42,
        "fuller_bonus": 0.08,
        "substring_penalty": 0.16,
        "overlap_suffix_penalty": 0.18,
        "overlap_base_bonus": 0.10,
    },
    "report": {"detection": 12, "evaluated": 10},
}


def settings(overrides: dict | None = None, base: dict | None = None) -> dict:
    """The defaults with a user's own values in their place: a group is merged value by value, anything else replaces what was there."""
    out = dict(DEFAULTS if base is None else base)
    for k, v in (overrides or {}).items():
        out[k] = settings(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
