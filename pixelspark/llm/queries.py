"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pixelspark.llm.licenses import OP6_SQL, op6_license_scan
from pixelspark.llm.media import op5_image_copies
from pixelspark.llm.mixing import op4_mix
from pixelspark.llm.near_duplicates import OP7_SQL, op7_jaccard_join
from pixelspark.llm.packing import op1_pack
from pixelspark.llm.quality import OP3_SQL, op3_line_frequency
from pixelspark.llm.secrets import op8_secret_scan
from pixelspark.llm.token_counts import op10_token_counts
from pixelspark.llm.token_files import op9_token_files
from pixelspark.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_pack": op1_pack,
    "op2_toxicity": op2_toxicity,
    "op3_line_frequency": op3_line_frequency,
    "op4_mix": op4_mix,
    "op5_image_copies": op5_image_copies,
    "op6_license_scan": op6_license_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
}
ORACLE: dict[str, str] = {"op3_line_frequency": OP3_SQL, "op6_license_scan": OP6_SQL, "op7_jaccard_join": OP7_SQL}
