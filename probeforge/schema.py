"""Record schemas, closed domains and thresholds.

The domain values and field names below are fixed values of the data format.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

VERSION = "1.0.0"
ACCESS_REGIMES = ("R0_BLACK_BOX", "R1_INFERENCE_STATE", "R2_WHITE_BOX")
MODEL_STATES = ("M0", "M_acq", "M_u")
PROBE_FAMILIES = ("P0_CONTROL", "P1_DIRECT", "P2_INDIRECT", "P3_ADVERSARIAL")
FORMATS = ("mcq", "short_answer", "matching")
CONDITIONS = ("normal_image", "no_image", "shuffled_image", "option_only", "question_only")
CONTROLS = ("no_image", "option_only", "shuffled_image")
SPLITS = ("train_forget", "train_retain", "test_forget", "test_retain", "utility", "audit")
STATUSES = ("correct", "incorrect", "refusal", "invalid_format", "api_error", "model_error", "policy_block")
SCORABLE = ("correct", "incorrect")
RUN_STATUSES = ("planned", "running", "completed", "failed", "unsupported")
FAILURE_CODES = ("INSUFFICIENT_SAMPLES", "LOW_NORMAL_ACCESS", "MISSING_CONTROL", "LOW_VISUAL_GAP", "CI_BELOW_FLOOR", "VARIANT_INSTABILITY")
LEGACY_CONDITIONS = ("BASELINE_NORMAL", "UNLEARN_SOFT", "UNLEARN_MEDIUM", "ORACLE_HARD", "ORACLE_REVERSE")
CAPABILITIES = (
    "supports_images", "supports_batching", "supports_logits", "supports_hidden_states", "supports_gradients", "supports_weight_updates", "supports_logit_bias", "supports_output_filtering",
)
PAIR_KEYS = ("sample_id", "probe_id", "prompt_variant_id", "input_condition")
BALANCE_BLOCK = ("dataset_id", "split", "probe_id", "prompt_variant_id")
DERANGE_GROUP = ("dataset_id", "split", "probe_id", "question_format", "prompt_variant_id")

_text, _texts = T.StringType(), T.ArrayType(T.StringType())
ITEM = T.StructType(
    [T.StructField(n, _text) for n in ("schema_version", "item_id", "sample_id", "dataset_id", "image_id", "image", "concept_id", "concept_name")]
    + [T.StructField("concept_aliases", _texts)]
    + [T.StructField(n, _text) for n in ("forgetting_level", "concept_axis", "split", "probe_id", "probe_family", "question_format", "prompt_variant_id", "input_condition", "question")]
    + [T.StructField("choices", _texts), T.StructField("accepted_answers", _texts), T.StructField("answer_index", T.IntegerType()), T.StructField("matched_retain_id", _text)]
    + [T.StructField("source", T.MapType(_text, _text)), T.StructField("license", T.MapType(_text, _text)), T.StructField("provenance_note", _text), T.StructField("metadata", T.MapType(_text, _text))]
)
LEGACY = T.StructType(
    [T.StructField(n, _text) for n in ("id", "image", "question")]
    + [T.StructField("choices", _texts), T.StructField("answer_index", T.IntegerType())]
    + [T.StructField(n, _text) for n in ("forgetting_level", "concept_axis", "target_split")]
    + [T.StructField("meta", T.MapType(_text, _text))]
)
PUBLIC_FIELDS = tuple(f.name for f in LEGACY.fields)


@dataclass(frozen=True)
class Thresholds:
    """Eligibility gates; the defaults are fixed values."""

    n_min: int = 50
    tau_acc_mcq: float = 0.60
    tau_acc_short: float = 0.50
    tau_visual: float = 0.20
    variant_min: float = 0.50
    variant_spread: float = 0.15
    replicates: int = 2000
    alpha: float = 0.05


class ConstraintError(ValueError):
    """A constraint's violations, the first few in the message."""

    def __init__(self, what: str, rows: list):
        self.rows = rows
        super().__init__(f"{what}: " + "; ".join(map(str, rows[:10])))


class CapabilityMismatch(ValueError):
    """A method needs capabilities that a model lacks."""

    def __init__(self, missing: list[str], context: str):
        self.missing, self.context = missing, context
        super().__init__(f"{context}: missing {', '.join(missing)}")

    def to_record(self) -> dict:
        return {"reason": "CAPABILITY_MISMATCH", "context": self.context, "missing": self.missing}


def require_none(violations, what: str) -> None:
    """Raise if a violations DataFrame has rows; only a handful comes to the driver."""
    rows = violations.limit(11).collect()
    if rows:
        raise ConstraintError(what, rows)
