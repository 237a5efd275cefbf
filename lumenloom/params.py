"""Parameter sets. Every value a caller may choose lives here, none in a session object."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values ---------------------------------------------------------
DEFAULT_AREA = 1024 * 1024
DEFAULT_STEP = 64
MIN_TARGET_MP = 0.05
MAX_TARGET_MP = 9.0
MIN_STEP = 8
MAX_STEP = 512
FAMILY_MAX_AR = 4.5
FAMILY_STEPS = 63
SNAP_LOSS = 0.12
SNAPSHOTS_KEPT = 12
THUMB_SIDE = 384
THUMB_QUALITY = 78
VIDEO_THUMB_SIDE = 512
RESIZE_STRATEGIES = ("resize", "bucket_resize", "legacy")
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Target:
    """Training target: pixel area and bucket grid."""

    area: int = DEFAULT_AREA
    step: int = DEFAULT_STEP

    @staticmethod
    def of(megapixels: float, step: int) -> "Target":
        mp = min(MAX_TARGET_MP, max(MIN_TARGET_MP, float(megapixels)))
        grid = int(step) // 8 * 8 or MIN_STEP
        return Target(int(mp * 1024 * 1024), min(MAX_STEP, max(MIN_STEP, grid)))


@dataclass(frozen=True)
class ArbOptions:
    """Aspect-ratio bucketing options."""

    base_resos: tuple[int, ...] | str | None = None
    min_base_reso: int = 0
    max_base_reso: int = 0
    output_max_base_reso: int = 0
    base_reso_step: int = 256
    min_reso: int = 512
    max_reso: int = 2048
    step: int = DEFAULT_STEP
    no_upscale: bool = True


@dataclass(frozen=True)
class SimilarityOptions:
    """Pair-test thresholds."""

    threshold: int = 6
    ar_tolerance: float = 0.15
    require_dual_hash: bool = True
    color_distance_max: float | None = 0.55
    method: str = "phash"

    @property
    def secondary_threshold(self) -> int:
        return self.threshold + 4


# --- fixed values: the named similarity settings -----------------------------------
SIMILARITY_PRESETS = {
    "strict": SimilarityOptions(4, 0.05, True),
    "balanced": SimilarityOptions(6, 0.15, True),
    "loose": SimilarityOptions(10, 0.25, False),
}
# ---------------------------------------------------------------------------------


# --- fixed values: settings that stored presets start from where they differ from a request's
PRESET_DEFAULTS = {
    "replace_underscore_excludes": "0_0, (o)_(o), +_+, +_-, ._., <o>_<o>, <|>_<|>, =_=, >_<, 3_3, 6_9, >_o, @_@, ^_^, o_o, u_u, x_x, |_|, ||_||",
    "remove_duplicates": True,
    "save_json": False,
}
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class CaptionOptions:
    """How a score list becomes a caption. List-valued settings are comma strings."""

    name: str = "default"
    threshold: float = 0.35
    additional_tags: str = ""
    exclude_tags: str = ""
    excluded_categories: str = ""
    replace_underscore: bool = True
    replace_underscore_excludes: str = ""
    escape_tag: bool = False
    sort_alphabetical: bool = False
    core_tags: str = ""
    core_tags_weight: float = 1.0
    add_confident_as_weight: bool = False
    use_weight_mapping: bool = False
    weight_mapping_exponent: float = 1.0
    weight_min: float = 0.9
    weight_max: float = 1.1
    max_tags: int = 0
    token_limit: int = 75
    tag_precision: int = 2
    output_format: str = "[name].txt"
    conflict_mode: str = "ignore"
    remove_duplicates: bool = True
    save_json: bool = False


@dataclass(frozen=True)
class KeyframeOptions:
    scene_threshold: float = 0.4
    sample_rate_hz: float = 4.0
    max_candidates: int = 0
    min_scene_seconds: float = 5.0


@dataclass(frozen=True)
class AutoCropOptions:
    padding_ratio: float = 0.10
    min_padding: int = 40
    max_padding: int = 200
    min_subject_area_ratio: float = 0.03
    compact_spacing: float = 2.8
    compact_density: float = 0.3
    preserve_top_bias: float = 1.0
    horizontal_center_bias: float = 1.0
    vertical_safety_margin: float = 0.97
    vertical_focus_threshold: float = 0.6
    ar_slack: float = 0.1
    min_side: int = 10


@dataclass(frozen=True)
class ExportOptions:
    """One batch export run."""

    target: Target = field(default_factory=Target)
    arb: ArbOptions = field(default_factory=ArbOptions)
    strategy: str = "resize"
    min_bucket_size: int = 1
    texture_max_ar: float = 2.0
    texture_subdir: str = "texture"
