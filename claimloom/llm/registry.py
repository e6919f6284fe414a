"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from claimloom.llm import chat, decontaminate, divergence, hmm, langid, manifest, mixing, secrets, simhash, substrings, tokencount, urlfilter, vectors


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_chat": chat.op2_chat,
        "op3_langid": langid.op3_langid,
        "op4_urlfilter": urlfilter.op4_urlfilter,
        "op5_simhash": simhash.op5_simhash,
        "op6_tokencount": tokencount.op6_tokencount,
        "op7_mixing": mixing.op7_mixing,
        "op7_mixing_copies": mixing.op7_mixing_copies,
        "op8_hmm": hmm.op8_hmm,
        "op9_vectors": vectors.op9_vectors,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_substrings": substrings.op11_substrings,
        "op12_divergence": divergence.op12_divergence,
        "op13_manifest": manifest.op13_manifest,
        "op1_secrets_base": secrets.op1_secrets_base,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets_base": secrets.BASE_ORACLE, "op4_urlfilter": urlfilter.ORACLE, "op7_mixing": mixing.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op11_substrings": substrings.ORACLE, "op12_divergence": divergence.ORACLE, "op13_manifest": manifest.ORACLE}
