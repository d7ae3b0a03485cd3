"""Personal-data detection, masking and pseudonymisation for Spark DataFrames."""

from .functions import contains_pii, extract_pii, mask_pii, mask_pii_audit, mask_pii_fpe, register, register_keyed, rekey_pii_fpe
from .keys import derive_key, derive_tweak, validate_key, validate_tweak
from .plans.manifest import masking_manifest, write_manifest
from .plans.policy import Policy, load_policy

__all__ = [
    "Policy", "contains_pii", "derive_key", "derive_tweak", "extract_pii", "load_policy", "mask_pii", "mask_pii_audit", "mask_pii_fpe",
    "masking_manifest", "register", "register_keyed", "rekey_pii_fpe", "validate_key", "validate_tweak", "write_manifest",
]
