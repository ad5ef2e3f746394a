"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP2_SQL, op2_preference
from .decontaminate import op1_decontaminate
from .exact_dedup import op4_exact_dedup
from .language_model import op6_language_model
from .mixing import op10_mixing
from .passages import op9_passages
from .quality import op3_quality
from .sharding import op8_jump_sharding
from .simhash import op7_simhash
from .toxicity import op5_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_preference": op2_preference,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_language_model": op6_language_model,
    "op7_simhash": op7_simhash,
    "op8_jump_sharding": op8_jump_sharding,
    "op9_passages": op9_passages,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op2_preference": OP2_SQL,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)
    """,
}
