"""Queries p1_ to p10_ and their SQL oracles."""

from __future__ import annotations

import importlib

#: Module of each query.
_OF = {
    "splits": ["p1_found", "p1_splits"],
    "near_duplicates": ["p7_found", "p7_groups"],
    "personal_data": ["p2_found", "p2_redacted"],
    "defective_pairs": ["p3_found", "p3_labels"],
    "chunking": ["p4_found", "p4_pieces"],
    "quota_sample": ["p5_found", "p5_sample"],
    "truncation": ["p6_found", "p6_rates"],
    "tokenize": ["p8_ids", "p8_roundtrip"],
    "eval_leaks": ["p9_found", "p9_items"],
    "toxic_content": ["p10_found", "p10_scores", "p10_rates"],
}

QUERIES = {name: getattr(importlib.import_module(f"spindrift.llm.{module}"), name) for module, names in _OF.items() for name in names}

_CELLS = """with p as (select distinct id, task, case when task='bloom_rewrite' then coalesce(lower(trim(source_bloom_level)),'') else 'none' end a, case when task='bloom_rewrite' then coalesce(lower(trim(target_bloom_level)),'') else 'none' end b from predictions where id is not null),
m as (select mix_id, task, lower(trim(source_level)) a, lower(trim(target_level)) b, share, min_rows from target_mix), n as (select floor(count(*)/5) s from p), c as (select mix_id, count(*) have from m join p using(task,a,b) group by 1)"""

ORACLES: dict[str, str] = {
    "p4_found": "select distinct source, chunk_id from document_chunks join split_limits using(modality) where length(text)>max_chars",
    "p5_found": _CELLS + " select mix_id from m left join c using(mix_id), n where coalesce(have,0)<greatest(min_rows, floor(share*s+0.5))".replace("from m left join c using(mix_id), n", "from (select * from m left join c using(mix_id)) x, n"),
}
