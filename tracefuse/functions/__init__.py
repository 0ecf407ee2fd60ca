from tracefuse.functions.fusion import (CURRENT_RULE, LEGACY_RULE, FusionRule, fuse,
                                        probability_band)
from tracefuse.functions.scalar import (at_least, base_name, clip01, epoch_seconds,
                                        label_from_name, nan_to_null, predict, safe_div,
                                        to_int_or_zero)

__all__ = ["CURRENT_RULE", "LEGACY_RULE", "FusionRule", "fuse", "probability_band", "at_least",
           "base_name", "clip01", "epoch_seconds", "label_from_name", "nan_to_null", "predict",
           "safe_div", "to_int_or_zero"]
