"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, collocations, graph_ann, html_text, jaccard_join, langid, merkle, mixing, nb_svm, packing, pii, quality, simple8b

QUERIES = {
    "op1_simple8b": simple8b.op1_simple8b,
    "op2_pii": pii.op2_pii,
    "op3_html": html_text.op3_html,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_langid": langid.op6_langid,
    "op7_ann": graph_ann.op7_ann,
    "op8_chat": chat.op8_chat,
    "op9_quality": quality.op9_quality,
    "op10_jaccard": jaccard_join.op10_jaccard,
    "op11_collocations": collocations.op11_collocations,
    "op12_merkle": merkle.op12_merkle,
    "op13_quality_classifier": nb_svm.op13_quality_classifier,
}

SQL = {"op4_mixing": mixing.OP4_SQL, "op8_chat": chat.OP8_SQL, "op9_quality": quality.OP9_SQL, "op10_jaccard": jaccard_join.OP10_SQL, "op11_collocations": collocations.OP11_SQL, "op12_merkle": merkle.OP12_SQL}
