"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from rillflow.llm import divergence, twins, urls
from rillflow.llm.chaining import op3_chained_passages
from rillflow.llm.conversations import op12_conversation_repair
from rillflow.llm.decontaminate import op4_decontaminate
from rillflow.llm.divergence import op11_source_divergence
from rillflow.llm.language import op7_language_id
from rillflow.llm.minhash import op10_minhash_dedup
from rillflow.llm.packing import op9_pack_documents
from rillflow.llm.preference import op13_quality_preference
from rillflow.llm.quality import op1_quality_rules
from rillflow.llm.sitetree import op5_site_tree
from rillflow.llm.suffixes import op2_suffix_dedup
from rillflow.llm.tokenfiles import op8_token_files
from rillflow.llm.urls import op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_suffix_dedup, op3_chained_passages, op4_decontaminate, op5_site_tree, op6_url_filter, op7_language_id, op8_token_files,
        op9_pack_documents, op10_minhash_dedup, op11_source_divergence, op12_conversation_repair,
        op13_quality_preference,
    )
}
ORACLES = {"op1_quality_rules": twins.QUALITY, "op4_decontaminate": twins.BENCHMARK, "op6_url_filter": urls.SQL, "op11_source_divergence": divergence.SQL}
