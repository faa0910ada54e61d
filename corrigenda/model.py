"""Table schemas. Every table is keyed by ``system_id, sample_id``; many systems run in one job."""

KEYS = ["system_id", "sample_id"]
TARGET = [*KEYS, "side", "target_id"]
SAMPLES = "system_id string, sample_id bigint, src_tokens array<string>"
TARGETS = "system_id string, sample_id bigint, side string, target_id int, tgt_tokens array<string>"
EDITS = (
    "system_id string, sample_id bigint, side string, target_id int, edit_no int, src_start int, src_end int,"
    " tgt_start int, tgt_end int, src_tokens array<string>, tgt_tokens array<string>, types array<string>"
)
HYP, REF = "hyp", "ref"
